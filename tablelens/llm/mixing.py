"""Mixing sources to target weights by Pareto order sampling.

A source gets a share of all words by its weight, but no more than ``max_copies`` times its own words. Inside a
source, documents are expected ``m`` times, ``m`` growing with the size class of the document (longer documents
are likelier). ``floor(m)`` copies are certain; the fraction is an inclusion probability, and documents enter in
the order of their random odds divided by their inclusion odds until the source's words are spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.llm.common import with_whole_rows
from tablelens.session import materialize

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKET_BITS = 10  # ranks are refined by so many bits a pass
PASSES = 4
# fixed value: what separates words
WORD_GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters; NULL has none. Counted as gaps between trimmed words."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(gaps, WORD_GAP, "")).cast("long")


def _levels(groups: DataFrame, keys: list[str], total: Column, weight: str, cap: Column, name: str) -> DataFrame:
    """Share ``total`` by ``weight`` with no share above ``cap``; the excess goes to the others by weight.

    Groups fill up in the order of weight by cap, so the full ones are a prefix of that order and one running
    sum finds them. One row per source or size class goes in, whatever the number of documents.
    """
    part = Window.partitionBy(*keys)
    order = part.orderBy(F.try_divide(F.col(weight), cap).desc_nulls_first(), F.col("_tie")).rowsBetween(Window.unboundedPreceding, -1)
    before_cap, before_weight = F.coalesce(F.sum(cap).over(order), F.lit(0)), F.coalesce(F.sum(weight).over(order), F.lit(0))
    left_weight = F.sum(weight).over(part) - before_weight
    full = (total - before_cap) * F.col(weight) > cap * left_weight
    marked = groups.withColumn("_full", full)
    rest = total - F.coalesce(F.sum(F.when(F.col("_full"), cap)).over(part), F.lit(0))
    rest_weight = F.sum(F.when(~F.col("_full"), F.col(weight))).over(part)
    share = F.when(F.col("_full"), cap.cast("double")).otherwise(F.try_divide(rest * F.col(weight), rest_weight))
    return marked.withColumn(name, share).drop("_full")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``_source, source_size, target`` per source; ``sizes`` has ``_source`` and ``size``. Sources weigh 5, 2, 1,
    repeating, by code point, NULL last."""
    groups = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("_source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    groups = groups.withColumn("_tie", rank).withColumn("_weight", F.get(weights, F.col("_tie") % len(WEIGHTS)).cast("long"))
    groups = groups.withColumn("_all", F.sum("source_size").over(every)).withColumn("_group", F.lit(0))
    shared = _levels(groups, ["_group"], F.col("_all"), "_weight", MAX_COPIES * F.col("source_size"), "target")
    return shared.select("_source", "source_size", "target")


def size_class(size: Column) -> Column:
    """1 for one word, 2 for two and three, 3 for four to seven, ...; 0 for none."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def class_copies(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``_source, _class, _copies``: expected copies of the documents of a size class.

    Copies are proportional to the class number up to ``MAX_COPIES``, and the words of all classes add up to the
    target of the source.
    """
    classes = sizes.where("size > 0").groupBy("_source", "_class").agg(F.sum("size").alias("_words"))
    joined = classes.join(targets.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    joined = joined.withColumn("_tie", F.col("_class")).withColumn("_weight", F.col("_words") * F.col("_class"))
    shared = _levels(joined, ["_source"], F.col("target"), "_weight", MAX_COPIES * F.col("_words"), "_share")
    return shared.select("_source", "_class", "_words", "target", (F.col("_share") / F.col("_words")).alias("_copies"))


def pareto_rank(key: Column, chance: Column, seed: int = 0) -> Column:
    """Random odds of ``key`` divided by the odds of ``chance``; the random part is 48 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{seed}"))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return (u / (1 - u)) / (chance / (1 - chance))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``_row, doc_id, size, source_size, target, taken`` per row of ``docs``.

    The last document taken is the one whose words cross what is left of the target, if that comes nearer.
    Instead of sorting a source, its words are summed by bucket of the rank; only the bucket in which the
    target falls is looked at again, bit by bit, so that at last a handful of rows is sorted. NULL or empty texts
    have size 0 and are taken 0 times; NULL sources form one source, NULL ids rank as the empty id; ties are
    broken by id and size, and of rows equal in these as many are taken as fit, by their place in the table. Very long
    texts are counted whole. Ids may have any type with an order. ``_row`` holds the columns of ``docs`` under their own
    names, so these may clash with those above. An empty table gives an empty result.
    """
    rows = with_whole_rows(docs, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("_source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    return rows_with_copies(rows, seed)


def rows_with_copies(rows: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` has ``doc_id``, ``_source``, ``size``; see ``mix``. Other columns are carried."""
    rows = materialize(rows.withColumn("_class", size_class(F.col("size"))).withColumn("_place", F.monotonically_increasing_id()))
    targets = materialize(source_targets(rows))
    plan = materialize(class_copies(rows, targets))
    left = plan.groupBy("_source").agg((F.max("target") - F.sum(F.floor("_copies") * F.col("_words"))).alias("_left"))
    by_source = targets.join(left.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # per source a map from size class to copies: at most 64 entries
    lists = plan.groupBy("_source").agg(F.map_from_entries(F.collect_list(F.struct("_class", "_copies"))).alias("_by_class"))
    facts = by_source.join(lists.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    facts = materialize(facts.withColumnRenamed("_source", "_key"))
    met = rows.join(facts, F.col("_source").eqNullSafe(F.col("_key"))).drop("_key")
    copies = F.coalesce(F.col("_by_class")[F.col("_class")], F.lit(0.0))
    met = met.withColumn("_copies", copies).withColumn("_sure", F.floor("_copies").cast("long"))
    chance = F.col("_copies") - F.col("_sure")
    met = met.withColumn("_rank", F.when((F.col("size") > 0) & (chance > 0), pareto_rank(F.col("doc_id"), chance, seed)))
    met = met.drop("_by_class", "_copies", "_class")
    cut = materialize(_cuts(met))
    upto = F.lit(None).cast("long")
    if not cut.where("_fit < _equal").isEmpty():
        met_ties = _places(met, cut).withColumnRenamed("_cut_source", "_s")
        cut = cut.join(met_ties, F.col("_cut_source").eqNullSafe(F.col("_s")), "left").drop("_s")
        upto = F.col("_upto_place")
    placed = met.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    fits = (_at() < F.col("_last")) | (_at().eqNullSafe(F.col("_last")) & F.coalesce(F.col("_place") <= upto, F.lit(True)))
    extra = F.when(F.col("_rank").isNotNull() & fits, 1).otherwise(0)
    taken = ((F.col("_sure") + extra) * F.col("size")).alias("taken")
    carried = [c for c in rows.columns if c not in ("doc_id", "size", "_class", "_source", "_place")]
    return placed.select(*carried, "doc_id", "size", "source_size", "target", taken)


def _at() -> Column:
    """Place of a row in the order of its source."""
    return F.struct(F.col("_rank").alias("r"), F.col("doc_id").alias("d"), F.col("size").alias("s"))


def _slot(level: int) -> Column:
    """Bucket of the rank at a level: the rank mapped to (0, 1), cut into ``BUCKET_BITS`` more bits per level."""
    return F.floor(F.col("_rank") / (1 + F.col("_rank")) * float(1 << BUCKET_BITS * level)).cast("long")


def _cuts(met: DataFrame) -> DataFrame:
    """Per source the last place taken: ``_cut_source, _last``."""
    rest = met.where("_rank is not null").select("_source", "_rank", "doc_id", "size", "_left")
    for level in range(1, PASSES + 1):
        sums = rest.groupBy("_source", _slot(level).alias("_slot")).agg(F.sum("size").alias("_words"), F.max("_left").alias("_left"))
        run = F.sum("_words").over(Window.partitionBy("_source").orderBy("_slot"))
        sums = sums.withColumn("_upto", run)
        # the first bucket that reaches what is left, or else the last one
        hit = sums.groupBy("_source").agg(
            F.min_by(F.struct("_slot", "_upto", "_words"), F.struct(F.when(F.col("_upto") >= F.col("_left"), 0).otherwise(1), F.when(F.col("_upto") >= F.col("_left"), F.col("_slot")).otherwise(-F.col("_slot")))).alias("_hit")
        )
        hit = materialize(hit.select(F.col("_source").alias("_s"), F.col("_hit._slot").alias("_pick"), (F.col("_hit._upto") - F.col("_hit._words")).alias("_done")))
        inside = rest.join(hit, F.col("_source").eqNullSafe(F.col("_s")) & (_slot(level) == F.col("_pick")))
        rest = inside.select("_source", "_rank", "doc_id", "size", (F.col("_left") - F.col("_done")).alias("_left"))
    # rows with equal places are one group, however many they are
    groups = rest.groupBy("_source", "_rank", "doc_id", "size").agg(F.count(F.lit(1)).alias("_equal"), F.max("_left").alias("_left"))
    order = Window.partitionBy("_source").orderBy("_rank", F.col("doc_id").asc_nulls_first(), "size")
    before = F.coalesce(F.sum(F.col("size") * F.col("_equal")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a document is taken if that brings the sum nearer to the target
    one = F.when(F.col("_before") + F.col("size") - F.col("size") / 2 <= F.col("_left"), 1).otherwise(0)
    several = F.least(F.greatest(F.floor((F.col("_left") - F.col("_before")) / F.col("size") + 0.5), F.lit(0)), F.col("_equal"))
    run = groups.withColumn("_before", before).withColumn("_fit", F.when(F.col("_equal") == 1, one).otherwise(several).cast("long"))
    last = run.where("_fit > 0").groupBy("_source").agg(F.max(_at()).alias("_last"), F.max_by(F.struct("_fit", "_equal"), _at()).alias("_n"))
    first = rest.groupBy("_source").agg(F.min("_rank").alias("_low"))
    both = first.join(last.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    # where nothing of the bucket is taken, everything before the bucket is
    nothing = F.struct(F.col("_low").alias("r"), F.lit(None).cast(rest.schema["doc_id"].dataType).alias("d"), F.lit(-1).cast("long").alias("s"))
    return both.select(F.col("_source").alias("_cut_source"), F.coalesce("_last", nothing).alias("_last"), F.col("_n._fit").alias("_fit"), F.col("_n._equal").alias("_equal"))


def _places(met: DataFrame, cut: DataFrame) -> DataFrame:
    """``_cut_source, _upto_place`` for sources of whose last equal rows only a part fits: the place of the last taken.

    Equal rows are counted by partition of the table; only the partition in which the last one stands is put in order.
    """
    split = cut.where("_fit < _equal").select("_cut_source", "_last", "_fit")
    tied = met.join(split, F.col("_source").eqNullSafe(F.col("_cut_source")) & _at().eqNullSafe(F.col("_last")))
    tied = tied.select("_cut_source", "_place", F.shiftright("_place", 33).alias("_part"), "_fit")
    parts = tied.groupBy("_cut_source", "_part").agg(F.count(F.lit(1)).alias("_n"), F.max("_fit").alias("_fit"))
    upto = F.sum("_n").over(Window.partitionBy("_cut_source").orderBy("_part"))
    parts = parts.withColumn("_before", upto - F.col("_n"))
    hit = parts.where((F.col("_before") < F.col("_fit")) & (F.col("_fit") <= F.col("_before") + F.col("_n")))
    hit = materialize(hit.select(F.col("_cut_source").alias("_s"), F.col("_part").alias("_p"), (F.col("_fit") - F.col("_before")).alias("_nth")))
    inside = tied.join(hit, F.col("_cut_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    number = F.row_number().over(Window.partitionBy("_cut_source").orderBy("_place"))
    return materialize(inside.withColumn("_number", number).where(F.col("_number") == F.col("_nth")).select("_cut_source", F.col("_place").alias("_upto_place")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Contract form of ``mix``: ``doc_id, size, source_size, target, taken``."""
    slim = docs.select("doc_id", F.col("source").alias("_source"), word_count(F.col("text")).alias("size"))
    return rows_with_copies(slim)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
sw AS (SELECT *, [5, 2, 1][i % 3 + 1] AS w, CAST(sum(source_size) OVER () AS BIGINT) AS al FROM s),
-- targets: fill up sources whose share is above three times their size, until none is
fill AS (SELECT 0 AS step, [-1]::BIGINT[] AS done, al AS rest, CAST((SELECT sum(w) FROM sw) AS BIGINT) AS rw FROM (SELECT DISTINCT al FROM sw)
  UNION ALL
  SELECT step + 1, list_concat(done, over_), CAST(rest - (SELECT sum(3 * source_size) FROM sw WHERE list_contains(over_, i)) AS BIGINT), CAST(rw - (SELECT sum(w) FROM sw WHERE list_contains(over_, i)) AS BIGINT)
  FROM (SELECT *, (SELECT list(i) FROM sw WHERE NOT list_contains(f.done, i) AND f.rest * w > 3 * source_size * f.rw) AS over_ FROM fill f) WHERE len(over_) > 0),
t AS (SELECT source, source_size, CASE WHEN list_contains(done, i) THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest * w AS DOUBLE) / rw END AS target
  FROM sw, (SELECT * FROM fill ORDER BY step DESC LIMIT 1)),
c AS (SELECT source, length(bin(size)) AS k, CAST(sum(size) AS BIGINT) AS words, CAST(sum(size) * length(bin(size)) AS BIGINT) AS cw FROM d WHERE size > 0 GROUP BY source, k),
-- size classes, fullest first: class k is full if what is left over of the target gives it more than three copies
co AS (SELECT c.source, k, words, cw, target, k AS wk,
  coalesce(CAST(sum(3 * words) OVER hi AS BIGINT), 0) AS bc, CAST(sum(cw) OVER (PARTITION BY c.source) AS BIGINT) - coalesce(CAST(sum(cw) OVER hi AS BIGINT), 0) AS lw
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW hi AS (PARTITION BY c.source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cf AS (SELECT *, (target - bc) * cw > 3 * words * lw AS fu FROM co),
cs AS (SELECT *, CASE WHEN fu THEN CAST(3 * words AS DOUBLE) ELSE (target - coalesce(CAST(sum(CASE WHEN fu THEN 3 * words END) OVER p AS BIGINT), 0)) * cw / CAST(sum(CASE WHEN NOT fu THEN cw END) OVER p AS BIGINT) END / words AS m
  FROM cf WINDOW p AS (PARTITION BY source)),
l AS (SELECT source, target - CAST(sum(CAST(floor(m) AS BIGINT) * words) AS BIGINT) AS left_ FROM cs GROUP BY source, target),
e AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target, coalesce(m, 0) AS m, CAST(floor(coalesce(m, 0)) AS BIGINT) AS sure, left_,
  (CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '#0'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN cs ON d.source IS NOT DISTINCT FROM cs.source AND d.size > 0 AND cs.k = length(bin(d.size))
  LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source),
r AS (SELECT *, CASE WHEN size > 0 AND m - sure > 0 THEN (u / (1 - u)) / ((m - sure) / (1 - (m - sure))) END AS q FROM e),
a AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) END AS upto FROM r)
SELECT doc_id, size, source_size, target, (sure + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= left_ THEN 1 ELSE 0 END) * size AS taken FROM a"""
