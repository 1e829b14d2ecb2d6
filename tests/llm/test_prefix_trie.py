import hashlib
import random
import zlib

import pytest

from tablelens.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, c string, d string, node string, name string, length string"


def brute_force(rows):
    """The contract, read word by word, for rows ``(conv_id, turn, role, text)``."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        low = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        rebuilt[c] = own.get(low, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", None, "y", "z", "0") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in pt.conversation_trie(df).collect()), key=repr)


def test_shared_beginnings(spark):
    rng = random.Random(4)
    rows = []
    for c in list(range(40)) + [100, 101, 103, 512, -1, -7, 10**15]:
        for turn in range(rng.randrange(0, 9)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], rng.choice(["hi", "ho", "é漢", ""])))
    assert trie(spark, rows) == brute_force(rows)


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None), (1, None, None, "x"), (1, 3, "user", None), (1, 3, "user", "same"), (1, 3, "user", "same"), (2, 1, "u", "ser"), (2, 1, "us", "er"),
        (None, 1, "user", "lost"), (None, None, None, None), (3, -5, "", ""), (4, 0, "user", "long " * 200_000), (6, 0, "user", "alone"), (11, 0, "user", "alone"), (16, 0, "a", "b"),
    ]
    assert trie(spark, rows) == brute_force(rows)


def test_one_conversation_with_most_turns(spark):
    rng = random.Random(9)
    rows = [(5, t, "user", rng.choice("ab")) for t in range(150)] + [(c, t, "user", "a") for c in (0, 1, 2, 3, 4, 7) for t in range(3)]
    assert trie(spark, rows) == brute_force(rows)


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 100)  # ids are handed on four at a time
    rows = [(c, t, "user", "same") for c in range(300) for t in range(12)]
    assert trie(spark, rows) == brute_force(rows)


def test_no_conversations(spark):
    assert trie(spark, []) == [] == trie(spark, [(None, 1, "user", "lost")])


@pytest.mark.parametrize("height,depth", [(1, 1), (3, 6), (5, 17)])
def test_totals_of_a_path(spark, height, depth):
    rows = spark.createDataFrame([(1, d, bytearray([d]), 1) for d in range(1, depth + 1)], "c long, d long, name binary, bytes long")
    lengths = spark.createDataFrame([(1, depth), (2, 0)], "c long, length long")
    got = {r.depth: (r.n_leaves, r.n_children, r.n_convs) for r in pt.sequence_trie(rows, lengths).collect()}
    assert got == {d: (1, int(d < depth), 2 if d == 0 else 1) for d in range(depth + 1)}
