"""Corpus to words: paragraphs, tokens, phrases, lemmas, vocabulary counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions.text import clean_word, paragraphs, strip_suffix, word_runs, word_tokens
from tablelens.operators.joins import if_few, join_frequent, join_stats
from tablelens.operators.ordering import value_prefix_counts
from tablelens.session import materialize



# ---- rules ---------------------------------------------------------------------------------

def effective_rules(built_in: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """Built-in rules overlaid by user rules: one value per category and key."""
    ranked = built_in.withColumn("_p", F.lit(1))
    if user is not None:
        own = user.select("category", F.lower("key").alias("key"), "value", F.lit(0).alias("_p"))
        ranked = ranked.unionByName(own)
    return ranked.groupBy("category", "key").agg(F.min_by("value", F.struct("_p", "value")).alias("value"))


def without_rules(rules: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop the ``(category, key)`` rows named in ``removed``."""
    gone = removed.select("category", F.lower("key").alias("key")).distinct()
    keyed = rules.withColumn("key", F.lower("key"))
    return keyed.join(gone, ["category", "key"], "left_anti").select("category", "key", "value")


def add_rules(user: DataFrame, added: DataFrame) -> DataFrame:
    """User rules with new ones; a new value replaces the old one of the same key."""
    new = added.select("category", F.lower("key").alias("key"), "value")
    return without_rules(user, new).unionByName(new)


def rules_summary(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category")


def list_rules(rules: DataFrame, category: str) -> DataFrame:
    return rules.where(F.col("category") == category).select("key", "value").orderBy("key")


def phrase_table(rules: DataFrame) -> DataFrame:
    """Multi-word phrases and their lemma: abbreviation full forms and compound nouns."""
    full = rules.where(F.col("category") == "abbreviations").select(F.lower("value").alias("phrase"), F.col("key").alias("lemma"))
    compound = rules.where(F.col("category") == "compound_nouns").select(F.lower("key").alias("phrase"), F.col("value").alias("lemma"))
    return full.unionByName(compound).withColumn("words", F.size(F.split("phrase", r"\s+"))).where(F.col("words") >= 2)


def _lookups(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole-word lemmas (first category in order wins) and those looked up again after a suffix rule."""
    r = rules
    parts = [
        r.where(F.col("category") == "abbreviations").select(F.col("key").alias("word"), F.col("key").alias("lemma"), F.lit(0).alias("p")),
        r.where((F.col("category") == "abbreviations") & ~F.lower("value").rlike(r"\s")).select(F.lower("value").alias("word"), F.col("key").alias("lemma"), F.lit(1).alias("p")),
    ]
    for p, category in enumerate(("spelling_variants", "irregular_verbs", "irregular_nouns", "irregular_adjectives"), start=2):
        parts.append(r.where(F.col("category") == category).select(F.col("key").alias("word"), F.col("value").alias("lemma"), F.lit(p).alias("p")))
    parts.append(r.where(F.col("category") == "no_strip").select(F.col("key").alias("word"), F.col("key").alias("lemma"), F.lit(6).alias("p")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    direct = rows.groupBy("word").agg(F.min_by("lemma", F.struct("p", "lemma")).alias("direct"))
    after = rows.where(F.col("p").isin(1, 2)).groupBy("word").agg(F.min_by("lemma", F.struct("p", "lemma")).alias("after"))
    return direct, after


# ---- lemmas --------------------------------------------------------------------------------

def word_lemmas(words: DataFrame, word: str, rules: DataFrame) -> DataFrame:
    """``(word, lemma)`` for each distinct value: tables first, then suffix rules."""
    direct, after = _lookups(rules)
    clean = words.select(F.col(word)).where(F.col(word).isNotNull()).distinct().withColumn("_w", clean_word(F.col(word)))
    known = join_stats(clean, direct.withColumnRenamed("word", "_w"), ["_w"])
    stripped = known.withColumn("_s", F.when(F.col("direct").isNull(), strip_suffix(F.col("_w"))))
    again = join_stats(stripped, after.withColumnRenamed("word", "_s"), ["_s"])
    lemma = F.when(F.length("_w") <= 2, F.col("_w")).otherwise(F.coalesce("direct", "after", "_s"))
    return again.select(word, lemma.alias("lemma"))


def with_lemma(df: DataFrame, word: str, rules: DataFrame, name: str = "lemma") -> DataFrame:
    """Lemma of every row; rules run once per distinct word."""
    return join_stats(df, word_lemmas(df, word, rules).withColumnRenamed("lemma", name), [word])


# ---- corpus --------------------------------------------------------------------------------

def paragraph_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, paragraph_id, text, word_count)``, ids from 0 per document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(paragraphs(F.col(text))).alias("paragraph_id", "text"))
    return rows.withColumn("word_count", F.size(word_runs(F.col("text"))))


def token_table(paras: DataFrame) -> DataFrame:
    """``(doc_id, paragraph_id, position, word)``."""
    return paras.select("doc_id", "paragraph_id", F.posexplode(word_tokens(F.col("text"))).alias("position", "word"))


def _phrase_index(phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first two levels of the phrases' trie, and its ends: ``(pair, sizes)`` with the lengths in words of the
    phrases below each first pair, and ``(phrase, p_lemma)``."""
    clean = F.regexp_replace(F.trim("phrase"), r"\s+", " ")
    listed = phrases.select(clean.alias("phrase"), "lemma").groupBy("phrase").agg(F.min("lemma").alias("p_lemma"))
    listed = materialize(listed.withColumn("words", F.size(F.split("phrase", " "))).where("words >= 2"))
    pairs = listed.groupBy(F.substring_index("phrase", " ", 2).alias("pair")).agg(F.collect_set("words").alias("sizes"))
    return pairs, listed.select("phrase", "p_lemma")


def phrase_matches(paras: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(doc_id, paragraph_id, heads)``: phrases of each paragraph of ``(doc_id, paragraph_id, tokens)`` that has some.

    The longest phrase at a position wins and the scan goes on behind it. Phrases are joined: pairs of neighbouring
    words with the first pairs of phrases, then what begins there with the phrases themselves, so the cost per word does
    not depend on how many there are. ``heads`` are structs ``(at, n, phrase, p_lemma)`` in order.
    """
    pairs, listed = _phrase_index(phrases)
    pairs, listed = if_few(materialize(pairs)), if_few(listed)
    both = F.zip_with("tokens", F.slice("tokens", 2, F.size("tokens")), lambda x, y: F.concat(x, F.lit(" "), y))
    starts = materialize(paras.select("doc_id", "paragraph_id", F.posexplode(both).alias("at", "pair")).join(pairs, "pair").drop("pair"))
    ahead = if_few(starts).join(paras, ["doc_id", "paragraph_id"])
    ahead = ahead.select("doc_id", "paragraph_id", "at", "tokens", F.explode("sizes").alias("n")).where(F.col("at") + F.col("n") <= F.size("tokens"))
    named = ahead.select("doc_id", "paragraph_id", "at", "n", F.array_join(F.slice("tokens", F.col("at") + 1, F.col("n")), " ").alias("phrase"))
    longest = named.join(listed, "phrase").groupBy("doc_id", "paragraph_id", "at").agg(F.max(F.struct("n", "phrase", "p_lemma")).alias("m"))
    found = longest.groupBy("doc_id", "paragraph_id").agg(F.array_sort(F.collect_list(F.struct("at", "m.n", "m.phrase", "m.p_lemma"))).alias("found"))
    kind = found.schema["found"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("heads"))
    take = lambda s, m: F.when(m["at"] >= s["free"], F.struct((m["at"] + m["n"]).alias("free"), F.concat(s["heads"], F.array(m)).alias("heads"))).otherwise(s)
    return found.select("doc_id", "paragraph_id", F.aggregate("found", start, take, lambda s: s["heads"]).alias("heads"))


def _cell(at: Column, word: Column, phrase: Column, p_lemma: Column) -> Column:
    return F.struct(at.alias("position"), word.alias("word"), phrase.alias("phrase"), p_lemma.alias("p_lemma"))


def _marked(paras: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(doc_id, paragraph_id, tokens, heads)`` of each paragraph; no heads where there is no phrase."""
    tokens = materialize(paras.select("doc_id", "paragraph_id", word_tokens(F.col("text")).alias("tokens")))
    return join_stats(tokens, phrase_matches(tokens, phrases), ["doc_id", "paragraph_id"])


def _cells() -> Column:
    """Structs ``(position, word, phrase, p_lemma)`` of the words that stay."""
    none = F.lit(None).cast("string")
    plain = F.transform("tokens", lambda w, i: _cell(i, w, none, none))
    covered = F.flatten(F.transform("heads", lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1)))
    others = F.array_except(F.sequence(F.lit(0), F.size("tokens") - 1), covered)
    kept = F.transform(others, lambda i: _cell(i, F.get("tokens", i), none, none))
    first = F.transform("heads", lambda h: _cell(h["at"], F.get("tokens", h["at"]), h["phrase"], h["p_lemma"]))
    return F.when(F.col("heads").isNull(), plain).otherwise(F.sort_array(F.concat(kept, first)))


def tokens_with_phrases(paras: DataFrame, phrases: DataFrame) -> DataFrame:
    """Tokens of each paragraph; a phrase keeps its first word, with the phrase and its lemma beside it.

    Positions keep their gaps.
    """
    return _marked(paras, phrases).select("doc_id", "paragraph_id", F.inline(_cells()))


def word_table(docs: DataFrame, rules: DataFrame, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """``(word_id, doc_id, paragraph_id, position, word, lemma)`` of a corpus with unique ids.

    The text is read once; the tokens of each paragraph are written out for the later passes. Word
    ids need no sort of the words: a paragraph knows the order of its own, so only the word counts of
    the paragraphs are ordered and summed. What meets them is the tokens as one array a paragraph, and
    words are opened behind that join; the lemmas of frequent words go to them, so that only rare words move.
    """
    marked = _marked(paragraph_table(docs, doc_id, text), phrase_table(rules))
    if with_ids:
        hidden = F.coalesce(F.aggregate("heads", F.lit(0), lambda s, h: s + h["n"] - 1), F.lit(0))
        counts = marked.select(F.struct("doc_id", "paragraph_id").alias("place"), (F.size("tokens") - hidden).alias("n"))
        before = value_prefix_counts(counts, "place", weight="n").select("place.*", F.col("before").alias("_before"))
        placed = join_stats(marked, before, ["doc_id", "paragraph_id"])
    else:
        placed = marked.withColumn("_before", F.lit(0))
    opened = placed.select("doc_id", "paragraph_id", "_before", F.posexplode(_cells()).alias("_i", "_c"))
    tokens = opened.select((F.col("_before") + F.col("_i")).cast("long").alias("word_id"), "doc_id", "paragraph_id", "_c.*")
    words = materialize(marked.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_n")))
    known = materialize(join_stats(words, word_lemmas(words, "word", rules), ["word"]))
    lemmas = join_frequent(tokens, known, "word", "_n")
    # the phrase lemma counts where it differs from the word
    lemma = F.when(F.col("p_lemma").isNotNull() & (F.col("p_lemma") != F.col("word")), F.col("p_lemma")).otherwise(F.col("lemma"))
    ids = ["word_id"] if with_ids else []
    return lemmas.select(*ids, "doc_id", "paragraph_id", "position", "word", lemma.alias("lemma"))


# ---- vocabulary ----------------------------------------------------------------------------

# fixed values: vocabulary entry formats
ABBREVIATION_ENTRY = r"^([a-zA-Z]+)\s*\(?=\s*(.+?)\)?\s*$"
VARIANT_ENTRY = r"^([a-zA-Z]+(?:\s+[a-zA-Z]+)*)\s*\(([^=][^)]*)\)\s*\**\s*$"


def entry_abbreviation(entry: Column) -> Column:
    return F.when(entry.rlike(ABBREVIATION_ENTRY), F.lower(F.regexp_extract(entry, ABBREVIATION_ENTRY, 1)))


def entry_variants(entry: Column) -> Column:
    """Other spellings of a ``primary (a, b)`` entry; empty when it is none."""
    primary = clean_word(F.regexp_extract(entry, VARIANT_ENTRY, 1))
    inside = F.split(F.regexp_extract(entry, VARIANT_ENTRY, 2), "[,，]\\s*")
    forms = F.filter(F.transform(inside, clean_word), lambda v: (v != "") & (v != primary))
    return F.when(entry.rlike(VARIANT_ENTRY), forms).otherwise(F.array().cast("array<string>"))


def parse_entries(vocab: DataFrame, entry: str, rules: DataFrame) -> DataFrame:
    """Add ``abbreviation``, ``variants`` and the cleaned ``forms`` of each vocabulary entry."""
    e = F.col(entry)
    bare = F.trim(F.regexp_replace(F.regexp_replace(e, r"\s*\(.*?\)\s*", ""), r"\*+", ""))
    compounds = rules.where(F.col("category") == "compound_nouns").select(F.lower("key").alias("_bare"), F.col("value").alias("_compound"))
    parsed = vocab.withColumns({"abbreviation": entry_abbreviation(e), "variants": entry_variants(e), "_bare": F.lower(bare)})
    joined = join_stats(parsed, compounds, ["_bare"])
    alternatives = F.array_distinct(F.filter(F.transform(F.split(bare, "/"), clean_word), lambda w: w != ""))
    primary = F.array(clean_word(F.regexp_extract(e, VARIANT_ENTRY, 1)))
    forms = (
        F.when(F.col("abbreviation").isNotNull(), F.array("abbreviation"))
        .when(F.size("variants") > 0, primary)
        .when(F.col("_compound").isNotNull(), F.array("_compound"))
        .otherwise(alternatives)
    )
    return joined.withColumn("forms", forms).drop("_bare", "_compound")


def refresh_lemmas(vocab: DataFrame, entry: str, rules: DataFrame) -> DataFrame:
    """New lemma per entry with flags for abbreviations and changed entries."""
    parsed = parse_entries(vocab, entry, rules).withColumn("_first", F.coalesce(F.get("forms", F.lit(0)), F.col(entry)))
    tagged = with_lemma(parsed, "_first", rules, "_lemma")
    lemma = F.coalesce("abbreviation", F.when(F.col("_first").contains(" "), F.col("_first")).otherwise(F.col("_lemma")))
    done = tagged.withColumn("lemma", lemma)
    multi = F.col("abbreviation").isNull() & F.col("_first").contains(" ")
    changed = F.col("abbreviation").isNull() & (multi | (F.col("lemma") != F.lower(entry)))
    return done.select(*vocab.columns, "lemma", F.col("abbreviation").isNotNull().alias("is_abbreviation"), changed.alias("changed"))


def refresh_counts(refreshed: DataFrame) -> DataFrame:
    return refreshed.agg(F.count(F.lit(1)).alias("entries"), F.count_if("is_abbreviation").alias("abbreviations"), F.count_if("changed").alias("changed"))


def normal_forms(words: DataFrame, word: str, rules: DataFrame) -> DataFrame:
    """Lemma and, for abbreviations, the full form: ``(word, full_form, forms)``."""
    base = words.select(F.lower(F.trim(F.col(word))).alias("word")).distinct()
    full = rules.where(F.col("category") == "abbreviations").select(F.col("key").alias("word"), F.col("value").alias("full_form"))
    both = join_stats(with_lemma(base, "word", rules), full, ["word"])
    return both.select("word", "full_form", F.array_distinct(F.array_compact(F.array("lemma", "full_form"))).alias("forms"))


def vocabulary_counts(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """Occurrences of each vocabulary word by lemma; unused words count 0."""
    counts = words.groupBy("lemma").agg(F.count(F.lit(1)).alias("cnt"))
    hit = join_stats(vocab.select("word", "lemma"), counts, ["lemma"])
    return hit.groupBy("word").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("n"))


def occurrences(words: DataFrame, paras: DataFrame, lemma: str) -> DataFrame:
    """Every occurrence of a lemma with its paragraph."""
    hits = words.where(F.col("lemma") == lemma).select("doc_id", "paragraph_id", "position", "word")
    return hits.join(paras.select("doc_id", "paragraph_id", "text"), ["doc_id", "paragraph_id"])
