"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are cut at half depth. The upper half of a sequence gets a name, which stands for its prefix; the lower
half hangs below that name. Both halves are cut in the same way, all of them of one height at once, so a trie of depth
D takes log D rounds whatever its number of nodes:

* Up: two neighbouring blocks of turns make one of twice the length, named by the hash of the two names.
* Down: the node at the middle of a stretch is named by the node at its top and the block between.
* Totals: an upper trie and its lower forests have their totals apart; a forest's total is then added to the nodes
  between its root and the top of the upper trie.

No sequence is ever held as a whole: a conversation is a set of rows ``(conversation, depth)``, so one that holds a
third of all turns is spread like the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelens.operators.joins import join_stats
from tablelens.operators.ordering import with_row_index
from tablelens.session import materialize

GROUP = 5  # conversation c - c % GROUP gives its first turns
HEADS = 9  # their number is below this
PIECE = 1 << 16  # characters of an id list that are handed on at once
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _hash(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``c, pos, name, bytes`` per turn: its 0-based place in the conversation, a hash of role and text, and the UTF-8
    length of the text. Equal turn numbers go by that hash."""
    who, said = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in (role, text))
    # the length in front keeps role and text apart
    named = _hash(F.encode(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), "UTF-8"))
    rows = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), named.alias("name"), F.octet_length(said).cast("long").alias("bytes")
    )
    return with_row_index(rows, [F.asc_nulls_first("turn"), F.asc("name")], ["c"], name="pos").select("c", "pos", "name", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequences to be stored: ``c, d, name, bytes`` with depths from 1, and ``c, length`` of all conversations.

    A conversation takes the first h turns of the one whose id is the next lower multiple of ``GROUP`` and then its
    own from turn h on; h is the checksum of its id modulo ``HEADS``.
    """
    turns = materialize(turns)
    ids = turns.select("c").distinct().withColumns({"h": F.crc32(F.col("c").cast("string").cast("binary")) % HEADS, "b": F.col("c") - F.col("c") % GROUP})
    ids = materialize(ids)
    first = turns.where(F.col("pos") < HEADS).select(F.col("c").alias("b"), "pos", "name", "bytes")
    head = materialize(ids.join(first, "b").where("pos < h").select("c", (F.col("pos") + 1).alias("d"), "name", "bytes"))
    taken = ids.join(head.groupBy("c").agg(F.count(F.lit(1)).alias("m")), "c", "left").select("c", "h", F.coalesce("m", F.lit(0)).alias("m"))
    tail = join_stats(turns, taken, ["c"]).where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("d"), "name", "bytes")
    rows = materialize(head.unionByName(tail))
    lengths = ids.select("c").join(rows.groupBy("c").agg(F.max("d").alias("length")), "c", "left")
    return rows, materialize(lengths.select("c", F.coalesce("length", F.lit(0)).alias("length")))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def name_prefixes(rows: DataFrame, lengths: DataFrame, height: int) -> DataFrame:
    """``c, d, node``: the name of every prefix of every sequence, the empty one at depth 0 included."""
    blocks = [rows.select("c", (F.col("d") - 1).alias("b"), "name")]
    for _ in range(height - 1):
        even, odd = (F.max(F.when(F.col("b") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = blocks[-1].groupBy("c", F.shiftright("b", 1).alias("b")).agg(even.alias("x"), odd.alias("y"))
        blocks.append(materialize(pairs.where("y is not null").select("c", "b", _hash(F.col("x"), F.col("y")).alias("name"))))
    root = F.unhex(F.md5(F.lit("").cast("binary")))
    parts = [materialize(lengths.select("c", F.lit(0).cast("long").alias("d"), root.alias("node")))]
    for j in range(height - 1, -1, -1):
        # blocks of 2^j turns at even places lead from the top of a stretch to its middle
        between = blocks[j].where("b % 2 = 0").select("c", F.shiftleft("b", j).alias("top"), "name")
        above = _union(parts).select("c", F.col("d").alias("top"), "node")
        middle = between.join(above, ["c", "top"]).select("c", (F.col("top") + (1 << j)).alias("d"), _hash(F.col("node"), F.col("name")).alias("node"))
        parts.append(materialize(middle))
    return _union(parts)


def trie_nodes(names: DataFrame, rows: DataFrame) -> DataFrame:
    """``d, node, conv_id, n_convs, parent, parent_conv_id, n_children, bytes``; conv_id is the smallest member."""
    members = materialize(names.groupBy("d", "node").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")))
    up = names.select(F.col("c").alias("conv_id"), (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
    last = rows.select(F.col("c").alias("conv_id"), "d", "bytes")
    own = members.join(up, ["conv_id", "d"], "left").join(last, ["conv_id", "d"], "left")
    own = materialize(own)
    above = members.select((F.col("d") + 1).alias("d"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = own.where("parent is not null").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = join_stats(own, above, ["d", "parent"]).join(below, ["d", "node"], "left")
    return linked.select("d", "node", "conv_id", "n_convs", "parent_conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def graft_totals(nodes: DataFrame, names: DataFrame, height: int, sums: list[str]) -> DataFrame:
    """``d, node, *sums`` with every column of ``sums`` added up over the subtree of each node.

    Round j joins stretches of 2^j depths: the roots of the lower ones, at odd multiples of 2^j, hand their totals to
    their ancestors in the upper one. A root has 2^j of those, so a round hands on half as many values as there are
    nodes on the roots' paths, however deep the trie is.
    """
    totals = nodes.select("d", "node", "conv_id", *sums)
    for j in range(height):
        lower = totals.where(F.col("d") % (2 << j) == 1 << j).select("conv_id", *sums, F.explode(F.sequence(F.col("d") - (1 << j), F.col("d") - 1)).alias("d"))
        on_path = lower.join(names.withColumnRenamed("c", "conv_id"), ["conv_id", "d"])
        gained = on_path.groupBy("d", "node").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        added = totals.join(gained, ["d", "node"], "left")
        totals = materialize(added.select("d", "node", "conv_id", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums]))
    return totals.drop("conv_id")


def _runs(node: np.ndarray) -> list[int]:
    """Where runs of equal values begin, and the length at the end."""
    if not len(node):
        return [0]
    return [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]


def end_hashes(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: hash of the ascending ids ``c`` of each node's ``ends(node, c)``.

    Ids are sorted by range over all tasks and written as pieces of text, so that a node with very many of them is
    put together from few rows, which one hash takes in piece after piece.
    """
    kinds = ends.select(F.hex("node").alias("node"), "c")
    ranged = kinds.repartitionByRange("node", "c").sortWithinPartitions("node", "c")

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, c = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            rows = []
            bounds = _runs(node)
            for a, b in zip(bounds, bounds[1:]):
                # an id and its comma take 20 characters or fewer
                for i in range(a, b, PIECE // 21):
                    part = c[i : min(b, i + PIECE // 21)]
                    rows.append((node[i], part[0], ",".join(map(str, part))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["node", "first", "piece"])

    def joined(batches) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for batch in batches:
            for node, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node == current:
                    state.update(b"," + piece.encode())
                    continue
                if current is not None:
                    done.append((current, state.hexdigest()))
                current, state = node, hashlib.sha256(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], names=["node", "ends_sha256"])
                done = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    pieces = ranged.mapInArrow(cut, "node string, first long, piece string")
    whole = pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(joined, "node string, ends_sha256 string")
    return whole.select(F.unhex("node").alias("node"), "ends_sha256")


def sequence_trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of sequences ``rows(c, d, name, bytes)`` of ``lengths(c, length)``; see ``conversation_trie``."""
    deepest = lengths.agg(F.max("length")).first()[0]
    height = max(1, (deepest or 0).bit_length())
    names = name_prefixes(rows, lengths, height)
    nodes = materialize(trie_nodes(names, rows).withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes"),
    }))
    totals = graft_totals(nodes, names, height, ["n_leaves", "saved_tokens"])
    ends = names.join(lengths.withColumnRenamed("length", "d"), ["c", "d"]).select("node", "c")
    hashes = materialize(end_hashes(ends))
    plain = nodes.select("d", "node", "conv_id", "parent_conv_id", "n_convs", "n_children")
    out = plain.join(totals, ["d", "node"]).join(hashes, "node", "left")
    return out.select(
        "conv_id", F.col("d").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per trie node.

    Conversations are rebuilt (see ``rebuilt``), each distinct sequence of first turns is a node. A NULL role or text
    is empty; a NULL turn stands first; equal turn numbers go by a hash of role and text, and repeated rows are turns
    of their own. Rows with a NULL id belong to no conversation and are left out. Texts of any length count by their
    hash and size. A conversation left without turns is a member of the root. An empty table has no node at all, not
    even a root. Further columns are not read, so their names cannot clash. Ids are whole numbers of 64 bits.
    """
    return sequence_trie(*rebuilt(turn_rows(conversations, conv_id, turn, role, text)))


SQL = f"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v
    FROM (SELECT i::BIGINT AS i FROM range(256) r(i)))),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % {GROUP} AS b,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, s: xor(a >> 8, t[(xor(a, s) & 255) + 1])), 4294967295::BIGINT) % {HEADS} AS h
  FROM (SELECT DISTINCT c FROM turns), tab),
parts AS (
  SELECT ids.c, 0 AS side, pos, role, text FROM ids JOIN turns ON turns.c = b WHERE pos < h
  UNION ALL SELECT ids.c, 1, pos, role, text FROM ids JOIN turns ON turns.c = ids.c WHERE pos >= h),
seqs AS (
  SELECT ids.c, coalesce(list({{'role': role, 'text': text}} ORDER BY side, pos) FILTER (WHERE role IS NOT NULL), []) AS s
  FROM ids LEFT JOIN parts ON parts.c = ids.c GROUP BY ids.c),
prefixes AS (SELECT c, len(s) AS length, d, list_slice(s, 1, d) AS p FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = length), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].text) END AS own
  FROM prefixes GROUP BY p, d),
linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND list_slice(k.p, 1, n.d) = n.p) AS n_children
  FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = list_slice(n.p, 1, n.d - 1)),
below AS (
  SELECT v.own, v.n_children, list_slice(v.p, 1, e) AS p, e AS d FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM linked) v),
totals AS (SELECT p, d, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM below GROUP BY p, d)
SELECT conv_id, linked.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM linked JOIN totals ON totals.d = linked.d AND totals.p = linked.p
"""
