import random

from tablelens.llm import suffix_dedup as sd
from tests.llm.fixtures import NOT_SPACE, SCHEMA, sentence, words


def brute(rows, size):
    docs = {(r[0], r[1] or ""): words(r[1], NOT_SPACE) for r in rows}
    seen = {}
    for k, w in docs.items():
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), set()).add(k)
    out = []
    for k, w in docs.items():
        hit = [i for i in range(len(w) - size + 1) if len(seen[tuple(w[i : i + size])]) > 1]
        spans = []
        for i in hit:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + size
            else:
                spans.append([i, i + size])
        out += [(k[0], a, b, b - a) for a, b in spans]
    return sorted(out, key=repr)


def test_awkward_rows(odd, odd_rows, none):
    assert sorted(map(tuple, sd.repeated_passages(odd).collect()), key=repr) == brute(odd_rows, 50)
    assert sd.repeated_passages(none).count() == 0


def test_passages_around_the_least_length(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        passage = sentence(rng, 44 + i % 14)
        for k in range(2 + i % 3):
            rows.append((3 * i + k, sentence(rng, rng.randrange(0, 60)) + " " + passage + " " + sentence(rng, rng.randrange(0, 60)), *[None] * 9))
    common = sentence(rng, 60, 12)  # few words: many equal grams
    rows += [(1000 + i, f"{sentence(rng, 20, 12)} {common} {sentence(rng, 30, 12)}", *[None] * 9) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 50)
    assert sorted(map(tuple, sd.repeated_passages(df.repartition(5)).collect()), key=repr) == want


def test_a_hot_passage_over_many_tasks(spark):
    """One passage in all documents with different ends: its grams lie in several tasks."""
    rng = random.Random(6)
    passage = sentence(rng, 55)
    rows = [(i, f"{sentence(rng, 5, 3)} {passage} {sentence(rng, 9, 3)}", *[None] * 9) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, sd.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, 50)
