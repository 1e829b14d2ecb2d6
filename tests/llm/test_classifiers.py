import itertools
import random
import zlib

import numpy as np
import pytest

from tablelens.llm import language, quality, toxicity
from tests.llm.fixtures import SCHEMA

LABELS = "doc_id long, quality int, toxic int, text string"


def fold_of(i):
    return zlib.crc32(str(i).encode()) % 5


def table(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or [None] * len(texts))[i], None, None, *["x"] * 6) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(1)
    parts = {"aa": ["the", "ing", "th", "and", "er", "on"], "bb": ["le", "eau", "oi", "que", "ment", "é"], "cc": ["sch", "ung", "ß", "der", "ein", "ü"]}
    texts, langs = [], []
    for i in range(240):
        lang = sorted(parts)[i % 3]
        texts.append(" ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30, 200))))
        langs.append(lang if i % 11 else None)
    return texts, langs


def test_language(spark, tongues):
    texts, langs = tongues
    got = {r.doc_id: r for r in language.predict(table(spark, texts, langs)).collect()}
    held = [i for i in got if fold_of(i) == 0]
    assert all(got[i].held_out == (fold_of(i) == 0) for i in got)
    assert np.mean([got[i].lang_pred == sorted(("aa", "bb", "cc"))[i % 3] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_never_learns_from_held_out_rows(spark, tongues):
    texts, langs = tongues
    other = ["cc" if fold_of(i) == 0 else x for i, x in enumerate(langs)]
    a = language.predict(table(spark, texts, langs)).collect()
    b = language.predict(table(spark, texts, other)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_language_of_awkward_rows(odd, odd_rows, none):
    got = language.predict(odd).collect()
    assert len(got) == len(odd_rows)
    kept = language.accepted(odd)
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert all(r.lang_pred == "und" and not r.accepted for r in got if r.doc_id in (4, 5, 6))
    assert language.predict(none).count() == 0 and language.accepted(none).count() == 0


def test_a_mixture_is_rejected_more_than_its_parts(spark, tongues):
    texts, langs = tongues
    rows = texts + [" ".join(a + " " + b for a, b in zip(texts[0].split(), texts[1].split()))]
    got = {r.doc_id: r for r in language.predict(table(spark, rows, [*langs, None])).collect()}
    assert got[240].score < min(got[0].score, got[1].score)


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(300):
        words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 400))]
        good = i % 3 != 0
        texts.append(" ".join(words if good else [w + "***" for w in words]))
        labels.append((i, int(good), 0, None))
    return texts, labels


def test_quality(spark, noisy):
    texts, labels = noisy
    got = quality.predict(table(spark, texts), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 300 and all(r.held_out == (fold_of(r.doc_id) == 0) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_sees_the_whole_text():
    network = quality.Network(1)
    text = bytes(random.Random(3).choices(range(97, 123), k=20_000))
    data = np.frombuffer(text, np.uint8)
    (chunks, row, size), = quality.chunk_slices(data, np.array([0, len(data)]))
    assert chunks[-1][: size[-1]].tobytes() == text[-int(size[-1]) :] and len(chunks) == -(-(20_000 - 64) // 960)
    changed = data.copy()
    changed[-500:] = 33
    assert network.scores(data, np.array([0, 20_000]))[0] != network.scores(changed, np.array([0, 20_000]))[0]


def test_quality_equals_a_loop_over_bytes():
    network, rng = quality.Network(5), random.Random(5)
    texts = [bytes(rng.choices(range(32, 127), k=n)) for n in (0, 1, 7, 1023, 1024, 1025, 1984, 1985, 5000)]
    got = network.scores(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for text, score in zip(texts, got):
        sums, weight, begin = 0.0, 0, 0
        while begin == 0 or begin + quality.CHUNK - quality.STEP < len(text):
            piece = text[begin : begin + quality.CHUNK]
            cells = piece.ljust(quality.CHUNK)
            best = np.max([sum(network.taps[t][cells[i + t]] for t in range(quality.TAPS)) for i in range(quality.CHUNK - quality.TAPS + 1)], axis=0)
            sums += max(1, len(piece)) * float(np.maximum(best + network.bias, 0) @ network.out + network.shift[0])
            weight += max(1, len(piece))
            begin += quality.STEP
        assert abs(score - 1 / (1 + np.exp(-sums / weight))) < 1e-5


def test_slices_of_a_long_text_change_nothing(monkeypatch):
    network, text = quality.Network(6), np.random.default_rng(6).integers(32, 127, 200_000).astype(np.uint8)
    at = np.array([0, 0, 150_000, 150_003, 200_000])
    whole = network.scores(text, at)
    assert [len(c) for c, _, _ in quality.chunk_slices(text, at, 100)] == [100, 100, len(np.concatenate([r for _, r, _ in quality.chunk_slices(text, at)])) - 200]
    monkeypatch.setattr(quality.chunk_slices, "__defaults__", (64,))
    assert (network.scores(text, at) == whole).all() and len(network.scores(text[:0], np.array([0]))) == 0


def test_pair_tables_equal_single_taps():
    network = quality.Network(2)
    chunks = np.random.default_rng(0).integers(0, 256, (3, quality.CHUNK)).astype(np.uint8)
    assert np.allclose(network.activations(chunks), network.activations_single(chunks), atol=1e-5)


def test_a_pattern_is_seen_at_every_byte():
    network = quality.Network(4)
    chunks = np.full((2, quality.CHUNK), 97, np.uint8)
    for row, place in enumerate((500, 501)):
        chunks[row, place : place + 8] = np.arange(40, 48)
    assert np.allclose(*network.logits(chunks), atol=1e-6)


def test_slopes_of_the_network_are_right():
    """One step of Adam lowers the loss on its batch; labels that cannot be learned stay near chance."""
    rng = np.random.default_rng(0)
    chunks = rng.integers(97, 123, (128, quality.CHUNK)).astype(np.uint8)
    labels = np.arange(128) % 2
    chunks[labels == 1, 500:508] = 42
    network = quality.Network(0)
    network.fit(chunks, labels)
    assert np.mean((network.logits(chunks) > 0) == labels) > 0.95


def test_toxicity(spark):
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 7))) for _ in range(n)]
    texts, labels = [], []
    for i in range(400):
        w = words(rng.randrange(30, 150))
        if i % 4 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["moron", "zorg" + rng.choice("abcdef") * rng.randrange(1, 3)]))
        texts.append(" ".join(w))
        labels.append((i, None, int(i % 4 == 0), None))
    extra = ["you are an 1d10t", "ІDІОТ talk", "trash can and class clown", "put it in the trash can, you moron", "", None, "m​oron here", "so p@thetic", "idiots' tale"]
    got = {r.doc_id: r for r in toxicity.predict(table(spark, texts + extra), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i in range(400) if fold_of(i) == 0]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) >= 0.97
    assert [got[400 + k].predicted for k in range(8)] == [1, 1, 0, 1, 0, 0, 1, 1]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_equals_plain_search():
    """Scores against ``str.find`` of every term and exception, all pairs compared."""
    rng, lexicon = random.Random(8), toxicity.Lexicon({" bad ": 1.0, " bad": 0.5, " trash ": 2.0, " idio": 1.5}, [" trash can ", " bad idiom ", " idiom "])
    words = ["bad", "trash", "can", "idiot", "idiom", "trash can idiot", "b4d", "good", "badly"]
    spots = lambda text, term: [(i, i + len(term) - 1) for i in range(len(text)) if text.startswith(term, i)]
    for n in (0, 1, 2, 5, 30, 200):
        text = " ".join(rng.choice(words) for _ in range(n))
        folded = toxicity.fold(text)
        spared = [s for e in lexicon.exceptions for s in spots(folded, e)]
        total = sum(w for term, w in lexicon.weights.items() for a, b in spots(folded, term) if not any(c <= a and b <= d for c, d in spared))
        count = max(1, folded.count(" ") - 1)
        want = (np.log1p(total), np.log1p(100 * total / count)) if text else (0.0, 0.0)
        assert np.allclose(lexicon.features(text), want)


def test_exceptions_are_met_in_one_pass():
    import time

    lexicon = toxicity.Lexicon({" idiot ": 1.0, " trash ": 1.0}, [" trash can "])
    begin = time.process_time()
    assert lexicon.features("trash can idiot " * 125_000)[0] == pytest.approx(np.log1p(125_000))
    assert time.process_time() - begin < 10


def test_no_learned_entry_is_cut_off(spark):
    """Over 2000 terms are in all toxic texts, one is in fewer of them and is learned all the same."""
    rng = random.Random(7)
    common = ["".join(w) for w in rng.sample(list(itertools.product("bcdfghkmn", repeat=4)), 2100)]
    texts, labels = [], []
    for i in range(100):
        words = [*common, *["xyzw"] * (i % 20 != 0)] if i % 2 == 0 else ["".join(rng.choices("aeou", k=5)) for _ in range(50)]
        texts.append(" ".join(rng.sample(words, len(words))))
        labels.append((i, None, int(i % 2 == 0), None))
    weights = toxicity.learn(table(spark, texts), spark.createDataFrame(labels, LABELS)).weights
    assert " xyzw " in weights and sum(f" {w} " in weights for w in common) == len(common)


def test_awkward_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, (i % 2) if i != 3 else None, (i + 1) % 2 if i != 4 else 7, "t") for i in range(12)] + [(None, 1, 1, None), (0, 0, 1, None)], LABELS)
    nothing = spark.createDataFrame([], LABELS)
    for op in (quality, toxicity):
        for docs, marks, n in ((odd, labels, len(odd_rows)), (odd, nothing, len(odd_rows)), (none, labels, 0), (none, nothing, 0)):
            rows = op.predict(docs, marks).collect()
            assert len(rows) == n and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
