"""Word tables of the document corpus and vocabularies taken from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions.lexicon import IE_WORDS, built_in_rules, rules_frame
from tablelens.operators import words as w
from tablelens.plans.registry import query, table
from tablelens.session import spread

RULES_SQL = "rules(category, key, value) AS (VALUES " + ", ".join(f"('{c}', '{k}', '{v}')" for c, k, v in built_in_rules()) + ")"

PARAS_SQL = """paras AS (SELECT doc_id, CAST(i - 1 AS INT) AS paragraph_id, ps[i] AS text FROM
    (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM
     (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n+'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents)))"""
TOKENS_SQL = f"""{PARAS_SQL}, toks AS (SELECT doc_id, paragraph_id, CAST(i - 1 AS INT) AS position, lower(ws[i]) AS word FROM
    (SELECT doc_id, paragraph_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '[a-zA-Z]+') AS ws FROM paras)))"""


def _doubled(n: int) -> str:
    """The stem (word without its last n letters) ends in a doubled consonant and keeps three letters without it."""
    stem = f"left(w, length(w) - {n})"
    return f"length(w) >= {n + 4} AND right({stem}, 1) = substr(w, length(w) - {n + 1}, 1) AND right({stem}, 1) NOT IN ('a', 'e', 'i', 'o', 'u')"


_C = "[bcdfghjklmnpqrstvwxyz]"
_IE = ",".join(f"'{w}'" for w in IE_WORDS if len(w) > 4)


def suffix_sql() -> str:
    cut = lambda n: f"left(w, length(w) - {n})"
    last = lambda n: f"substr(w, length(w) - {n}, 1)"
    return f"""CASE
      WHEN w LIKE '%ing' AND length(w) > 5 THEN CASE
        WHEN {_doubled(3)} THEN CASE WHEN {last(3)} IN ('s','l','f','z') THEN {cut(3)} ELSE {cut(4)} END
        WHEN regexp_matches({cut(3)}, '{_C}{_C}$') OR {last(3)} IN ('y','n','r','w','l') THEN {cut(3)}
        WHEN regexp_matches({cut(3)}, '[aeiou]{_C}$') THEN {cut(3)} || 'e' ELSE {cut(3)} END
      WHEN w LIKE '%ied' AND length(w) > 5 THEN {cut(3)} || 'y'
      WHEN w LIKE '%ed' AND length(w) > 4 THEN CASE
        WHEN {_doubled(2)} THEN CASE WHEN {last(2)} IN ('s','l','f','z') THEN {cut(2)} ELSE {cut(3)} END
        WHEN regexp_matches({cut(2)}, '{_C}[cg]$|[nrl]s$') THEN {cut(2)} || 'e'
        WHEN regexp_matches({cut(2)}, '{_C}{_C}$') OR regexp_matches({cut(2)}, '[aeiou][nrlwyx]$') THEN {cut(2)}
        WHEN regexp_matches({cut(2)}, '[aeiou]{_C}$') THEN {cut(2)} || 'e' ELSE {cut(2)} END
      WHEN w LIKE '%ies' AND length(w) > 5 THEN CASE WHEN {cut(1)} IN ({_IE}) THEN {cut(1)} ELSE {cut(3)} || 'y' END
      WHEN w LIKE '%ves' AND length(w) > 5 THEN {cut(3)} || 'fe'
      WHEN regexp_matches(w, '(sh|ch|x|z|ss)es$') AND length(w) > 4 THEN {cut(2)}
      WHEN w LIKE '%oes' AND length(w) > 5 THEN {cut(2)}
      WHEN w LIKE '%es' AND length(w) > 4 THEN {cut(1)}
      WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN {cut(1)}
      WHEN w LIKE '%ier' AND length(w) > 5 THEN {cut(3)} || 'y'
      WHEN w LIKE '%er' AND {_doubled(2)} THEN {cut(3)}
      WHEN w LIKE '%iest' AND length(w) > 6 THEN {cut(4)} || 'y'
      WHEN w LIKE '%est' AND {_doubled(3)} THEN {cut(4)} ELSE w END"""


def lemma_sql(source: str) -> str:
    """CTEs ending in ``lem(word, lemma)`` for the distinct words of ``source``."""
    pick = lambda cond, col: f"(SELECT min({col}) FROM rules WHERE {cond})"
    single = "category = 'abbreviations' AND NOT contains(value, ' ') AND value = {x}"
    chain = [
        pick("category = 'abbreviations' AND key = w", "key"),
        pick(single.format(x="w"), "key"),
        *[pick(f"category = '{c}' AND key = w", "value") for c in ("spelling_variants", "irregular_verbs", "irregular_nouns", "irregular_adjectives")],
        pick("category = 'no_strip' AND key = w", "key"),
    ]
    return f"""dw AS (SELECT DISTINCT word, lower(regexp_replace(word, '[^a-zA-Z]', '', 'g')) AS w FROM ({source})),
      di AS (SELECT word, w, coalesce({', '.join(chain)}) AS d FROM dw), su AS (SELECT word, w, d, {suffix_sql()} AS s FROM di),
      lem AS (SELECT word, CASE WHEN length(w) <= 2 THEN w ELSE coalesce(d, {pick(single.format(x='s'), 'key')},
        {pick("category = 'spelling_variants' AND key = s", 'value')}, s) END AS lemma FROM su)"""


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


@query("paragraphs", "S8", f"WITH {PARAS_SQL} SELECT doc_id, paragraph_id, text, CAST(len(regexp_extract_all(text, '[a-zA-Z]+')) AS INT) AS word_count FROM paras")
def paragraphs(spark, sf):
    return w.paragraph_table(_docs(spark, sf))


@query("word_tokens", "T1", f"WITH {TOKENS_SQL} SELECT doc_id, paragraph_id, position, word FROM toks")
def word_tokens(spark, sf):
    return w.token_table(w.paragraph_table(_docs(spark, sf)))


# phrases that occur in this corpus: pairs and triples of its frequent words, as user rules
_USER_PHRASES = [("compound_nouns", p, p.replace(" ", "")) for p in ("of the", "of the and", "the of", "and the", "la de", "in the", "for of")]


def _phrase_rules(spark):
    return w.effective_rules(rules_frame(spark), rules_frame(spark, _USER_PHRASES))


@query(
    "phrase_heads",
    "T2",
    f"""WITH RECURSIVE {TOKENS_SQL}, ph(phrase, words, lemma) AS (VALUES {', '.join(f"('{p}', {len(p.split())}, '{lemma}')" for _, p, lemma in _USER_PHRASES)}),
      seq AS (SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM toks WINDOW o AS (PARTITION BY doc_id, paragraph_id ORDER BY position)),
      cand AS (SELECT doc_id, paragraph_id, position, max(words) AS len, arg_max(lemma, words) AS lemma FROM seq JOIN ph
               ON phrase = CASE words WHEN 2 THEN word || ' ' || w2 ELSE word || ' ' || w2 || ' ' || w3 END GROUP BY 1, 2, 3),
      num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph_id ORDER BY position) AS k FROM cand),
      walk AS (SELECT doc_id, paragraph_id, position, lemma, k, true AS taken, position + len AS free FROM num WHERE k = 1
        UNION ALL SELECT n.doc_id, n.paragraph_id, n.position, n.lemma, n.k, n.position >= walk.free, CASE WHEN n.position >= walk.free THEN n.position + n.len ELSE walk.free END
        FROM walk JOIN num n ON n.doc_id = walk.doc_id AND n.paragraph_id = walk.paragraph_id AND n.k = walk.k + 1)
      SELECT walk.doc_id, walk.paragraph_id, walk.position, free - walk.position AS words, walk.lemma FROM walk WHERE taken""",
)
def phrase_heads(spark, sf):
    tokens = w.tokens_with_phrases(w.paragraph_table(_docs(spark, sf)), w.phrase_table(_phrase_rules(spark)))
    heads = tokens.where(F.col("phrase").isNotNull())
    return heads.select("doc_id", "paragraph_id", "position", F.size(F.split("phrase", " ")).alias("words"), F.col("p_lemma").alias("lemma"))


@query("word_lemmas", "T3 T4", f"WITH {RULES_SQL}, {TOKENS_SQL}, {lemma_sql('SELECT word FROM toks')} SELECT word, lemma FROM lem")
def word_lemmas(spark, sf):
    return w.word_lemmas(w.token_table(w.paragraph_table(_docs(spark, sf))), "word", rules_frame(spark))


@query(
    "corpus_word_table",
    "T6 S8",
    f"""WITH {RULES_SQL}, {TOKENS_SQL}, {lemma_sql('SELECT word FROM toks')}
        SELECT doc_id, paragraph_id, position, toks.word, lemma, row_number() OVER (ORDER BY doc_id, paragraph_id, position) - 1 AS word_id
        FROM toks JOIN lem ON toks.word = lem.word""",
)
def corpus_word_table(spark, sf):
    """The built-in phrases do not occur in this invented prose; ``phrase_heads`` covers them."""
    return w.word_table(_docs(spark, sf), rules_frame(spark))


def _part_rules(spark, sf):
    parts = table(spark, sf, "part").select(F.lit("compound_nouns").alias("category"), F.upper("p_name").alias("key"), F.col("p_name").alias("value"))
    types = table(spark, sf, "part").select(F.lit("spelling_variants").alias("category"), F.lower("p_type").alias("key"), F.lit("kind").alias("value"))
    return parts.unionByName(types).distinct()


_OVERLAY = f"""WITH {RULES_SQL}, own AS (SELECT DISTINCT 'compound_nouns' AS category, lower(p_name) AS key, p_name AS value FROM part
        UNION SELECT 'spelling_variants', lower(p_type), 'kind' FROM part),
      eff AS (SELECT * FROM own UNION ALL SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.category = r.category AND own.key = r.key))"""


@query("rule_overlay", "T5", f"{_OVERLAY} SELECT category, key, value FROM eff")
def rule_overlay(spark, sf):
    return w.effective_rules(rules_frame(spark), _part_rules(spark, sf))


@query("rule_summary", "T5", f"{_OVERLAY} SELECT category, count(*) AS n FROM eff GROUP BY category")
def rule_summary(spark, sf):
    return w.rules_summary(rule_overlay(spark, sf))


@query("rule_removal", "T5", f"{_OVERLAY} SELECT category, count(*) AS n FROM eff WHERE NOT (category = 'compound_nouns' AND key IN (SELECT lower(p_name) FROM part WHERE p_size > 25)) GROUP BY category")
def rule_removal(spark, sf):
    gone = table(spark, sf, "part").where(F.col("p_size") > 25).select(F.lit("compound_nouns").alias("category"), F.col("p_name").alias("key"))
    return w.rules_summary(w.without_rules(rule_overlay(spark, sf), gone))


# vocabulary entries in all formats, written from the part names
_ENTRY_SQL = """vocab AS (SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN p_name || '**' WHEN 1 THEN replace(p_name, ' ', '/')
    WHEN 2 THEN upper(left(p_type, 3)) || ' (=' || p_name || ')' WHEN 3 THEN split_part(p_name, ' ', 1) || ' (' || split_part(p_name, ' ', 2) || ', ' || lower(p_type) || ')*'
    WHEN 4 THEN split_part(p_name, ' ', 2) || 's' ELSE p_name || ' (' || split_part(p_name, ' ', 1) || ')' END AS entry FROM part)"""


def _entries(spark, sf):
    one, two = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    kind = F.col("p_size") % 6
    entry = (
        F.when(kind == 0, F.concat("p_name", F.lit("**")))
        .when(kind == 1, F.replace("p_name", F.lit(" "), F.lit("/")))
        .when(kind == 2, F.concat(F.upper(F.left("p_type", F.lit(3))), F.lit(" (="), "p_name", F.lit(")")))
        .when(kind == 3, F.concat(one, F.lit(" ("), two, F.lit(", "), F.lower("p_type"), F.lit(")*")))
        .when(kind == 4, F.concat(two, F.lit("s")))
        .otherwise(F.concat("p_name", F.lit(" ("), one, F.lit(")")))
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), entry.alias("entry"))


_CLEAN = "lower(regexp_replace({0}, '[^a-zA-Z]', '', 'g'))"
_ABBR, _VAR = f"'{w.ABBREVIATION_ENTRY}'", f"'{w.VARIANT_ENTRY}'"
_PARSE = f"""{_ENTRY_SQL}, pe AS (SELECT id, entry, CASE WHEN regexp_matches(entry, {_ABBR}) THEN lower(regexp_extract(entry, {_ABBR}, 1)) END AS abbreviation,
      {_CLEAN.format(f'regexp_extract(entry, {_VAR}, 1)')} AS prim,
      CASE WHEN regexp_matches(entry, {_VAR}) THEN list_filter(list_transform(string_split_regex(regexp_extract(entry, {_VAR}, 2), '[,，]\\s*'),
        lambda v: {_CLEAN.format('v')}), lambda v: v <> '' AND v <> {_CLEAN.format(f'regexp_extract(entry, {_VAR}, 1)')}) ELSE [] END AS variants,
      trim(regexp_replace(regexp_replace(entry, '\\s*\\(.*?\\)\\s*', '', 'g'), '\\*+', '', 'g')) AS bare FROM vocab),
    pf AS (SELECT *, CASE WHEN abbreviation IS NOT NULL THEN [abbreviation] WHEN len(variants) > 0 THEN [prim]
      WHEN EXISTS (SELECT 1 FROM rules WHERE category = 'compound_nouns' AND key = lower(bare)) THEN [lower(bare)]
      ELSE list_filter(list_transform(string_split(bare, '/'), lambda a: {_CLEAN.format('a')}), lambda a: a <> '') END AS forms FROM pe)"""


@query(
    "vocabulary_entries",
    "T7",
    f"""WITH {RULES_SQL}, {_PARSE} SELECT id, entry, abbreviation, array_to_string(variants, ',') AS variants, array_to_string(forms, ',') AS forms FROM pf""",
)
def vocabulary_entries(spark, sf):
    parsed = w.parse_entries(_entries(spark, sf), "entry", rules_frame(spark))
    return parsed.select("id", "entry", "abbreviation", F.array_join("variants", ",").alias("variants"), F.array_join("forms", ",").alias("forms"))


_REFRESH = f"""WITH {RULES_SQL}, {_PARSE}, {lemma_sql('SELECT coalesce(forms[1], entry) AS word FROM pf')},
    rf AS (SELECT id, entry, coalesce(abbreviation, CASE WHEN contains(coalesce(forms[1], entry), ' ') THEN forms[1] ELSE lem.lemma END) AS lemma,
      abbreviation IS NOT NULL AS is_abbreviation FROM pf JOIN lem ON lem.word = coalesce(forms[1], entry))"""


@query("vocabulary_refresh", "T8", f"{_REFRESH} SELECT id, entry, lemma, is_abbreviation, NOT is_abbreviation AND (contains(lemma, ' ') OR lemma <> lower(entry)) AS changed FROM rf")
def vocabulary_refresh(spark, sf):
    return w.refresh_lemmas(_entries(spark, sf), "entry", rules_frame(spark))


@query(
    "vocabulary_refresh_counts",
    "T8",
    f"""{_REFRESH} SELECT count(*) AS entries, count(*) FILTER (WHERE is_abbreviation) AS abbreviations,
        count(*) FILTER (WHERE NOT is_abbreviation AND (contains(lemma, ' ') OR lemma <> lower(entry))) AS changed FROM rf""",
)
def vocabulary_refresh_counts(spark, sf):
    return w.refresh_counts(vocabulary_refresh(spark, sf))


@query(
    "normal_forms",
    "T9",
    f"""WITH {RULES_SQL}, {TOKENS_SQL}, {lemma_sql('SELECT word FROM toks')}, ab AS (SELECT key, value FROM rules WHERE category = 'abbreviations')
        SELECT word, value AS full_form, CASE WHEN value IS NULL OR value = lemma THEN lemma ELSE lemma || ',' || value END AS forms
        FROM lem LEFT JOIN ab ON ab.key = lem.word""",
)
def normal_forms(spark, sf):
    tokens = w.token_table(w.paragraph_table(_docs(spark, sf)))
    return w.normal_forms(tokens, "word", rules_frame(spark)).select("word", "full_form", F.array_join("forms", ",").alias("forms"))


_BENCH_WORDS = "SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]+'))) AS word FROM benchmark"


@query(
    "vocabulary_counts",
    "J1 T10",
    f"""WITH {RULES_SQL}, {TOKENS_SQL}, bw AS ({_BENCH_WORDS}), {lemma_sql('SELECT word FROM toks UNION SELECT word FROM bw')}
        SELECT bw.word, count(o.position) AS n FROM bw JOIN lem ON lem.word = bw.word
        LEFT JOIN (SELECT lemma, position FROM toks JOIN lem ON toks.word = lem.word) o ON o.lemma = lem.lemma GROUP BY bw.word""",
)
def vocabulary_counts(spark, sf):
    rules = rules_frame(spark)
    vocab = table(spark, sf, "benchmark").select(F.explode(F.transform(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)), F.lower)).alias("word")).distinct()
    return w.vocabulary_counts(w.with_lemma(vocab, "word", rules), w.word_table(_docs(spark, sf), rules, with_ids=False))


@query(
    "word_occurrences",
    "J2 T10",
    f"""WITH {RULES_SQL}, {TOKENS_SQL}, {lemma_sql('SELECT word FROM toks')}
        SELECT toks.doc_id, toks.paragraph_id, position, toks.word, text FROM toks JOIN lem ON toks.word = lem.word
        JOIN paras ON paras.doc_id = toks.doc_id AND paras.paragraph_id = toks.paragraph_id WHERE lemma = 'be'""",
)
def word_occurrences(spark, sf):
    docs = _docs(spark, sf)
    words = w.word_table(docs, rules_frame(spark), with_ids=False)
    return w.occurrences(words, w.paragraph_table(docs), "be")
