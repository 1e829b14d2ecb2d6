"""Exact duplicates: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.llm.common import with_whole_rows
from tablelens.session import materialize

# fixed value: runs of white space of the contract
SPACE_RUN = r"[\x20\x09-\x0D]+"
# the same runs without the single blanks, which stay as they are
_UNEVEN_RUN = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    """Every run of white space becomes one blank; NULL is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN_RUN, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash) -> DataFrame:
    """One row per row of ``docs``: ``_row``, ``_id``, ``keep_id``, ``group_size``, ``text_sha256``, ``kept``.

    The rows of a hash meet one row that holds the group's first text, so a hot group needs no window and no
    list, and the join may split it. Rows whose bytes differ from that text (a collision) are grouped by hash
    and whole text instead. Ids that are NULL come last; of rows with equal id and text, one is kept. NULL text
    is empty; an empty table gives an empty result; other columns are carried along whatever their names.
    """
    text = normalised(F.col(f"`{text_col}`"))
    light = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_norm")).select("_id", "_norm", digest(F.col("_norm")).alias("_hash"))
    groups = light.groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_keep"), F.min_by("_norm", F.coalesce("_id", F.lit(2**63 - 1))).alias("_first")
    ).select(F.col("_hash").alias("_key"), "_n", "_keep", F.when(F.col("_n") > 1, F.col("_first")).alias("_first"))
    # written first: the join below then has two plain sides, and its large partitions can be split
    groups = materialize(groups)
    rows = with_whole_rows(docs, F.col(f"`{id_col}`").alias("_id"), text.alias("_norm"))
    rows = rows.select("_row", "_id", "_norm", digest(F.col("_norm")).alias("_hash"))
    met = rows.join(groups, F.col("_hash") == F.col("_key")).withColumn("_same", F.col("_first").isNull() | (F.col("_first") == F.col("_norm")))
    keep = met.select(
        "_row", "_id", F.sha2("_norm", 256).alias("text_sha256"), "_hash", "_n", "_keep", "_same",
        F.when(~F.col("_same"), F.col("_norm")).alias("_other"),
    )
    return keep


def _resolved(met: DataFrame) -> DataFrame:
    """Split the groups in which some bytes differ; the rest stays as it is."""
    clash = met.where(~F.col("_same")).select("_hash").distinct()
    if clash.isEmpty():
        return met.select("_row", "_id", "text_sha256", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"))
    fine = met.join(clash, "_hash", "left_anti").select("_row", "_id", "text_sha256", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"))
    mixed = met.join(clash, "_hash", "left_semi")
    sizes = mixed.groupBy("_hash", "_other").agg(F.count(F.lit(1)).alias("group_size"), F.min("_id").alias("keep_id"))
    sizes = sizes.select(F.col("_hash").alias("_h"), F.col("_other").alias("_o"), "group_size", "keep_id")
    same = (F.col("_hash") == F.col("_h")) & F.col("_other").eqNullSafe(F.col("_o"))
    return fine.unionByName(mixed.join(sizes, same).select("_row", "_id", "text_sha256", "keep_id", "group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash) -> DataFrame:
    """Contract form: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``."""
    slim = docs.select(F.col(f"`{id_col}`").alias("_source_id"), F.col(f"`{text_col}`").alias("_source_text"))
    met = materialize(duplicate_groups(slim, "_source_id", "_source_text", digest).drop("_row").withColumn("_row", F.lit(0)))
    rows = _resolved(met).drop("_row")
    # rows with equal id and text: counted and told apart by number, so that exactly one is kept
    counted = rows.groupBy("_id", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("_m"))
    each = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))).alias("_i"))
    return each.select(
        F.col("_id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "text_sha256",
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash) -> DataFrame:
    """The kept rows with all their columns. Of rows with equal id and text any one stays."""
    found = duplicate_groups(docs, id_col, text_col, digest)
    # the smallest id of a hash has the group's first text, so rows that share it need not be written
    met = materialize(found.where(~F.col("_same") | F.col("_id").eqNullSafe(F.col("_keep"))))
    kept = _resolved(met).where(F.col("_id").eqNullSafe(F.col("keep_id")))
    return kept.dropDuplicates(["_id", "text_sha256"]).select("_row.*")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""
