import hashlib
import itertools
import math
import random
import re
import time

import pytest

from tablelens.llm import pii

SCHEMA = "doc_id long, text string, spans string, _text string, n_ip string"
PHONE, CARD = "+1 (269) 555-3296", "4524132264652876"


def plain_base(text):
    """The patterns as the contract writes them."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])]
            right = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 13 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": lambda: 9 <= len(digits) <= 15}
            if right[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choice("a.@-+% 12345(é)") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choice(["1", "25", "255", "256", ".", ".", " ", "-", "+", "4111111111111111", "a@b.c", "@", "00012"]) for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += ["é@b.cd", "a@b.c@d.e", "a@b@c.d", "x" + CARD, f"{PHONE} {CARD}", "+1" + "2" * 30, "1.2.3.4.5.6.7.8", "0000001.2.3.4"]
    for text in texts:
        assert pii.base_spans(text) == plain_base(text), text


def weighted(seed):
    rng = random.Random(seed)
    model = pii.Model()
    model.weights[:] = [rng.gauss(0, 0.7) for _ in range(pii.WIDTH)]
    return model


def segmentations(net, p=0):
    """Every way to cut the region, as lists of span numbers."""
    n = len(net.cuts) - 1
    if p == n:
        yield []
        return
    yield from segmentations(net, p + 1)
    for x, (i, j, _, _) in enumerate(net.spans):
        if i == p:
            for rest in segmentations(net, j):
                yield [x, *rest]


def value(model, net, ways):
    total, before, end = 0.0, 0, 0
    for x in ways:
        i, j, k, columns = net.spans[x]
        total += model.weights[columns].sum() + model.weights[pii.STEPS[before if i == end else 0][k]]
        before, end = k, j
    return total


@pytest.mark.parametrize("seed,text", list(enumerate(["12.34.56.78 1234567", "(123)456-789", "a.b@c.de", "+12345 678 90", "1.2.3.4.5.6.7"])))
def test_dynamic_programming_against_all_segmentations(seed, text):
    model, (net,) = weighted(seed), [pii.lattice(text, a, b) for a, b in pii.regions(text)]
    every = list(segmentations(net))
    assert net.spans and len(every) > 1
    scores = [value(model, net, w) for w in every]
    assert value(model, net, model.best(net)) == pytest.approx(max(scores))
    total, spans, steps = model.sums(net)
    assert total == pytest.approx(math.log(sum(map(math.exp, scores))))
    for x in range(len(net.spans)):
        assert spans[x] == pytest.approx(sum(math.exp(s - total) for s, w in zip(scores, every) if x in w))
    assert sum(steps.values()) == pytest.approx(sum(spans))


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8)))
    values = {
        "email": lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": lambda: pii._with_checksum(rng, "4", 16), "phone": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10000):04}",
    }
    rows = []
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 2:
            words[rng.randrange(30)] = values[pii.KINDS[i // 2 % 4]]()
        rows.append((i, " ".join(words) + ".", None, "x", "y"))
    return rows


@pytest.fixture(scope="module")
def model(spark, documents):
    return pii.learn(pii.sample_regions(spark.createDataFrame(documents, SCHEMA).repartition(4)))


def found(model, text):
    base = pii.base_spans(text)
    return sorted((k, text[a:b]) for k, a, b in {*base, *model.added(text, base)})


def test_added_spans(model):
    rng = random.Random(8)
    hits = tries = 0
    for _ in range(60):
        phone, card, ip = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10000):04}", pii._with_checksum(rng, "4", 16), ".".join(str(rng.randrange(10, 256)) for _ in range(4))
        for a, b in itertools.permutations([("phone", phone), ("card", card), ("ip", ip)], 2):
            tries += 2
            got = found(model, f"so {a[1]} {b[1]} end")
            hits += (a in got) + (b in got)
    assert hits / tries > 0.97
    assert ("email", "ann [at] mail [dot] example [dot] com") in found(model, "or ann [at] mail [dot] example [dot] com, says")


def test_clean_texts_stay_clean(model):
    clean = [
        "on 2024-01-15 10:22:33 and 12.05.2021", "order 4524132264652877 of", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", "see 300.400.1.2", "version 12.4.100", "token=0641917ea4e9feb9cda83477b57",
        "call (at) noon", "x @ y", "978-3-16-148410-1", "1,234,567.89", "", "(((((((((", "a@b", "12345 67890 12345 67890 12345",
    ]
    for text in clean:
        assert found(model, text) == [], text


def test_query_rows(spark, model, odd_rows):
    rows = [(r[0], r[1], "x", None, "y") for r in odd_rows]
    rows += [(50, f"é漢 {PHONE} {CARD} 🙂 a@b.cd", None, None, None), (51, "1.2.3.4", None, None, None), (51, "1.2.3.4", None, None, None)]
    got = pii.personal_data(spark.createDataFrame(rows, SCHEMA).repartition(3), model=model).collect()
    want = []
    for i, text, *_ in rows:
        base = plain_base(text or "")
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = sorted({*base, *model.added(text or "", base)}, key=lambda s: (pii.KINDS.index(s[0]), s[1:]))
        want.append((i, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(digest.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in every)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    there = next(r for r in got if r.doc_id == 50)
    assert there.spans == "email:40:46,card:21:37,phone:3:20" and (there.n_card, there.n_phone) == (0, 0)


def test_nothing_to_learn_from(spark, none):
    assert pii.personal_data(none).count() == 0
    rows = spark.createDataFrame([(1, "no data", None, None, None), (None, None, None, None, None)], SCHEMA)
    assert {r.spans for r in pii.personal_data(rows).collect()} == {""}


@pytest.mark.parametrize("unit", ["1", "1 ", "a", "1.", "(", "+1", "a@", "@", "a.", "1-2 ", "(at) ", " ", "a1"])
def test_long_texts_take_linear_time(unit):
    text = unit * (300_000 // len(unit))
    start = time.time()
    base = pii.base_spans(text)
    weighted(1).added(text, base)
    assert time.time() - start < 60
