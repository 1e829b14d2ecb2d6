import random

import pytest

from tablelens.functions.lexicon import built_in_rules, rules_frame
from tablelens.operators import words as w
from tablelens.operators.joins import join_frequent

LEMMAS = {
    "running": "run", "missed": "miss", "missing": "miss", "cookies": "cookie", "knives": "knife", "biggest": "big", "bigger": "big",
    "television": "tv", "televisions": "tv", "advertisements": "ad", "AI": "ai", "ai": "ai", "eating": "eat", "heating": "heate",
    "colors": "colour", "stories": "story", "heroes": "hero", "boxes": "box", "danced": "dance", "walked": "walk", "opened": "open",
    "created": "create", "happiest": "happy", "happier": "happy", "tried": "tri", "carried": "carry", "thing": "thing", "water": "water",
    "bus": "bus"[:2] and "bus", "don't": "dont", "adding": "add", "stopped": "stop", "talking": "talk", "making": "make", "entering": "enter",
    "cases": "case", "lives": "life", "leaves": "leave", "data": "datum", "is": "is", "was": "be", "best": "good", "access": "access",
}
LEMMAS["bus"] = "bus"


@pytest.fixture(scope="module")
def rules(spark):
    return w.effective_rules(rules_frame(spark))


def test_lemmas(spark, rules):
    df = spark.createDataFrame([(x,) for x in LEMMAS], "word string")
    got = {r["word"]: r["lemma"] for r in w.word_lemmas(df, "word", rules).collect()}
    # three letters and a plain -s: "bus" has a stem of two and stays
    assert got == LEMMAS


def test_verb_forms_by_table_and_by_suffix_rule(spark, rules):
    """Every form of a verb has its base form as lemma, whether a table or a suffix rule gives it."""
    forms = {
        "go": "goes going went gone", "do": "does doing did done", "leave": "leaves leaving left", "lie": "lies lying lay lain", "fly": "flies flying flew flown",
        "freeze": "freezes freezing froze frozen", "forgive": "forgives forgiving forgave forgiven", "drive": "drives driving drove driven", "put": "puts putting",
        "catch": "catches catching caught", "begin": "begins beginning began begun", "use": "uses using used", "read": "reads reading", "take": "takes taking took taken",
        "swim": "swims swimming swam swum", "buy": "buys buying bought", "see": "sees seeing saw seen", "undertake": "undertakes undertaking undertook undertaken",
    }
    want = {f: base for base, listed in forms.items() for f in listed.split()} | {"lay": "lie"}
    got = w.word_lemmas(spark.createDataFrame([(f,) for f in want], "word string"), "word", rules)
    assert {r["word"]: r["lemma"] for r in got.collect()} == want
    assert len({(c, k) for c, k, _ in built_in_rules()}) == len(built_in_rules())


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_longest_phrase_wins_and_the_scan_goes_on_behind_it(spark):
    extra = [("compound_nouns", p, p.upper()) for p in ("a b", "b c", "a b c", "c d")]
    rules = w.effective_rules(rules_frame(spark), rules_frame(spark, extra))
    text = "A b c d b c d x ab c\n\nartificial intelligence, as soon as possible"
    rows = w.word_table(docs(spark, text), rules).orderBy("word_id").collect()
    got = [(r["paragraph_id"], r["position"], r["word"], r["lemma"]) for r in rows]
    assert got == [
        (0, 0, "a", "A B C"), (0, 3, "d", "d"), (0, 4, "b", "B C"), (0, 6, "d", "d"), (0, 7, "x", "x"), (0, 8, "ab", "ab"), (0, 9, "c", "c"),
        (1, 0, "artificial", "ai"), (1, 2, "as", "asap"),
    ]
    assert [r["word_id"] for r in rows] == list(range(9))


def _scan(words, lemmas, longest):
    """Position and phrase of every head: the longest phrase at a position, then on behind it."""
    out, i = [], 0
    while i < len(words):
        n = next((n for n in range(min(longest, len(words) - i), 1, -1) if " ".join(words[i : i + n]) in lemmas), 1)
        if n > 1:
            out.append((i, lemmas[" ".join(words[i : i + n])]))
        i += n
    return out


def test_many_phrases_against_a_scan(spark):
    """A hundred thousand phrases, most of which begin with the same pair; long runs that overlap themselves."""
    rng = random.Random(2)
    word = lambda: rng.choice("abcd")
    phrases = {" ".join(word() for _ in range(rng.randrange(2, 7))) for _ in range(900)} | {"a a", "a a a"}
    far = [f"a b {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}x" for i in range(100_000)]
    lemmas = {p: p.replace(" ", "_") for p in (*phrases, *far)}
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(120)] + ["a " * 301, "a b aaaax a b zzzax", "", "c"]
    rules = spark.createDataFrame([("compound_nouns", p, v) for p, v in lemmas.items()], "category string, key string, value string")
    heads = w.tokens_with_phrases(w.paragraph_table(docs(spark, *texts)), w.phrase_table(rules)).where("phrase is not null")
    got = {}
    for r in heads.collect():
        assert r["p_lemma"] == r["phrase"].replace(" ", "_")
        got.setdefault(r["doc_id"], []).append((r["position"], r["p_lemma"]))
    want = {i: _scan(t.split(), lemmas, 6) for i, t in enumerate(texts)}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}


def test_paragraphs_and_counts(spark):
    rows = w.paragraph_table(docs(spark, "  One two \n\n\t\n three\u00e9x 4 ", "", "!!!")).orderBy("doc_id", "paragraph_id").collect()
    assert [(r["doc_id"], r["paragraph_id"], r["text"], r["word_count"]) for r in rows] == [
        (0, 0, "One two", 2), (0, 1, "three\u00e9x 4", 2), (2, 0, "!!!", 0),
    ]


def test_vocabulary_entries(spark, rules):
    entries = ["AI (=artificial intelligence)", "apologise (apologize)*", "actor/actress", "abandon**", "a.m.", "mobile phone (old)", "Ice cream*", "red (red)", "***"]
    df = spark.createDataFrame(list(enumerate(entries)), "id long, entry string")
    got = {r["entry"]: (r["abbreviation"], r["variants"], r["forms"]) for r in w.parse_entries(df, "entry", rules).collect()}
    assert got["AI (=artificial intelligence)"] == ("ai", [], ["ai"])
    assert got["apologise (apologize)*"] == (None, ["apologize"], ["apologise"])
    assert got["actor/actress"][2] == ["actor", "actress"]
    assert got["abandon**"][2] == ["abandon"] and got["a.m."][2] == ["am"]
    assert got["mobile phone (old)"][2] == ["mobilephone"]
    assert got["Ice cream*"][2] == ["ice cream"]
    assert got["red (red)"][2] == ["red"] and got["***"][2] == []
    fresh = {r["entry"]: r["lemma"] for r in w.refresh_lemmas(df, "entry", rules).collect()}
    assert fresh["Ice cream*"] == "ice cream" and fresh["AI (=artificial intelligence)"] == "ai"
    counts = w.refresh_counts(w.refresh_lemmas(df, "entry", rules)).first()
    assert (counts["entries"], counts["abbreviations"]) == (9, 1)


def test_rule_overlay_and_removal(spark, rules):
    own = rules_frame(spark, [("irregular_nouns", "Mice", "mickey"), ("no_strip", "blessing", "blessing")])
    merged = w.effective_rules(rules_frame(spark), own)
    got = {(r["category"], r["key"]): r["value"] for r in merged.collect()}
    assert got["irregular_nouns", "mice"] == "mickey" and got["no_strip", "blessing"] == "blessing"
    assert merged.count() == rules.count() + 1
    assert w.without_rules(own, own.where("category = 'no_strip'")).count() == 1
    assert w.add_rules(own, rules_frame(spark, [("irregular_nouns", "mice", "x")])).where("key = 'mice' and value = 'x'").count() == 1
    assert w.list_rules(merged, "irregular_adjectives").count() == 16


def test_rules_list_all_forms_of_irregular_verbs(spark, rules):
    verbs = {r["key"]: r["value"] for r in w.list_rules(rules, "irregular_verbs").collect()}
    assert len(verbs) == 323
    assert {f: verbs.get(f) for f in ("makes", "making", "made", "puts", "putting", "lies", "lying")} == {
        "makes": "make", "making": "make", "made": "make", "puts": "put", "putting": "put", "lies": "lie", "lying": "lie",
    }


@pytest.mark.parametrize("head", [0, 1, 3, 100])
def test_join_of_frequent_keys_is_a_plain_inner_join(spark, head):
    rows = [(i, "a" if i % 2 else "bcdefgh"[i % 7]) for i in range(300)] + [(300, "x"), (301, None)]
    stats = [("a", 150, 1.0), *((c, 20 + i, float(i)) for i, c in enumerate("bcdefgh")), ("z", 1, 9.0)]
    big, small = spark.createDataFrame(rows, "i long, w string"), spark.createDataFrame(stats, "w string, n long, v double")
    got = join_frequent(big, small, "w", "n", head).select("i", "w", "n", "v").collect()
    of = {s[0]: s[1:] for s in stats}
    assert sorted(map(tuple, got)) == [(i, w, *of[w]) for i, w in rows if w in of]


def test_words_of_the_word_table_are_not_shuffled_by_word(spark, rules):
    """Frequent words get their lemma without a sort by word."""
    table = w.word_table(docs(spark, "cats and a cat", "Cats"), rules, with_ids=False)
    assert "SortMergeJoin" not in table._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r["word"], r["lemma"]) for r in table.collect()) == [("a", "a"), ("and", "and"), ("cat", "cat"), ("cats", "cat"), ("cats", "cat")]


def test_normal_forms_and_counts(spark, rules):
    df = spark.createDataFrame([(" TV ",), ("cats",)], "word string")
    assert {r["word"]: r["forms"] for r in w.normal_forms(df, "word", rules).collect()} == {"tv": ["tv", "television"], "cats": ["cat"]}
    words = w.word_table(docs(spark, "cats and a cat\nCats"), rules, with_ids=False)
    vocab = w.with_lemma(spark.createDataFrame([("cat",), ("cats",), ("dog",)], "word string"), "word", rules)
    assert {r["word"]: r["n"] for r in w.vocabulary_counts(vocab, words).collect()} == {"cat": 3, "cats": 3, "dog": 0}
