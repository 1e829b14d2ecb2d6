"""Exact top-k search as joins: queries, postings and candidates are tables.

* Text: postings per token with their weights, and the largest weight per token. A few documents from the heads of a
  query's best lists give its k-th best score so far. Lists that together cannot reach it are set aside (keywords and
  the longest lists first); only documents of the other lists are candidates. Those that lead give a closer bound, and
  only candidates whose sum and bound reach it are scored in full.
* Keywords occur as substrings. Those that are not set aside are resolved to the corpus words around them by an index
  of letter groups; from there on a keyword is a list like that of a token.
* Dense vectors: documents in cells around pivots, with the widest angle of each cell. Cells and documents whose angle
  to the query cannot come below the k-th best one are not compared (triangle inequality).

The corpus is read once whatever the number of queries, and no query passes through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.functions.text import search_tokens
from tablelens.operators.joins import FEW_ROWS, equi_join, if_few, join_frequent, join_stats, top_k
from tablelens.operators.retrieval import KEYWORD_WEIGHT, TOP_K, VECTOR_WEIGHT, cosine, term_counts
from tablelens.session import materialize

SEED_LISTS = 4  # lists of a query whose heads give the first bound
SEED_DOCS = 16  # documents of each
ASIDE = 0.7  # share of the first bound that lists set aside may add up to; less means longer lists and fewer candidates
AHEAD = 6  # times k documents that lead by the main lists are scored in full before the others
DIGITS = 9  # scores are equal if they agree to so many digits
SLACK = 1e-8  # above rounding, below any difference that counts
ANGLE_SLACK = 1e-7
PAIRS = 500_000  # pairs of query and document that one task sums up, at most
PARTS = 4000  # unless that takes more tasks
PIVOTS = 32
GRAM = 3


# ---- index ---------------------------------------------------------------------------------

def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", use_idf: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(doc_id, token, tf, n_tokens)``, ``(token, df, idf)`` and the lengths of the vectors, ``(doc_id, norm)``.

    The text is tokenised once. Weights are made where they are needed: a search needs those of its own tokens only.
    """
    counts = materialize(term_counts(docs.where(F.col(doc_id).isNotNull()), doc_id, text))
    n_docs = docs.count()
    idf = F.log(F.lit(float(max(n_docs, 1))) / F.col("df")) if use_idf else F.lit(1.0)
    known = materialize(counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf))
    raw = join_frequent(counts, known, "token", "df") if use_idf else counts.withColumn("idf", F.lit(1.0))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(_weight() * _weight())).alias("norm"))
    return counts, known, materialize(norms.where("norm > 0"))


def _weight() -> Column:
    return F.col("tf") / F.col("n_tokens") * F.col("idf")


def lists_of(counts: DataFrame, tokens: DataFrame, norms: DataFrame) -> DataFrame:
    """``(doc_id, token, w)`` of the tokens in ``(token, idf)``, with vectors of length 1; zeros left out."""
    raw = counts.join(if_few(tokens), "token").select("doc_id", "token", _weight().alias("w")).where("w > 0")
    return materialize(raw.join(norms, "doc_id").select("doc_id", "token", (F.col("w") / F.col("norm")).alias("w")))


def query_terms(queries: DataFrame, stats: DataFrame, use_idf: bool = True) -> DataFrame:
    """``(query_id, token, share, qw)``: share of the query's tokens, and the weight in its vector of length 1.

    With idf, tokens that the corpus lacks have no part in the vector.
    """
    tokens = queries.select("query_id", search_tokens(F.col("text")).alias("t"))
    rows = tokens.select("query_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    terms = rows.groupBy("query_id", "token").agg((F.count(F.lit(1)) / F.max("n")).alias("share"))
    unknown = F.lit(0.0 if use_idf else 1.0)
    weighed = equi_join(terms, stats.select("token", "idf"), ["token"], "left").withColumn("w", F.col("share") * F.coalesce("idf", unknown))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    return materialize(weighed.select("query_id", "token", "share", F.when(norm > 0, F.col("w") / norm).otherwise(F.lit(0.0)).alias("qw")))


def grams(word: Column, size: int) -> Column:
    """Different letter groups of a word; none where it is shorter."""
    at = F.sequence(F.lit(1), F.length(word) - (size - 1))
    return F.when(F.length(word) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(word, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def words_around(parts: DataFrame, words: DataFrame, part: str = "part") -> DataFrame:
    """``(part, word)`` for every word of ``words(word)`` that holds ``part`` somewhere.

    An index of letter groups: a part is looked up under its rarest group of three letters (or under the one or two
    letters that it has), and what is found there is checked.
    """
    wanted = parts.select(F.col(part).alias("part")).where(F.length(part) > 0).distinct()
    size = F.least(F.length("part"), F.lit(GRAM))
    keys = lambda c, n: F.explode(grams(c, n)).alias("gram")
    asked = None
    held = None
    for n in range(1, GRAM + 1):
        one = wanted.where(size == n).select("part", keys(F.col("part"), n))
        other = words.select("word", keys(F.col("word"), n))
        asked, held = (one, other) if asked is None else (asked.unionByName(one), held.unionByName(other))
    asked = materialize(asked)
    # only groups that some part has
    index = materialize(held.join(asked.select("gram").distinct(), "gram", "left_semi"))
    rarity = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = asked.join(rarity, "gram").groupBy("part").agg(F.min(F.struct("n", "gram")).alias("g"))
    return chosen.select("part", F.col("g.gram").alias("gram")).join(index, "gram").where(F.expr("contains(word, part)")).select("part", "word")


# ---- text ----------------------------------------------------------------------------------

def _lists_of(terms: DataFrame, lists: DataFrame, stats: DataFrame, vector_weight: float, keyword_weight: float) -> DataFrame:
    """``(query_id, key, kind, part, bound, cost)``: the lists of every query and the most that each can add.

    Kind 0 is a token with its weights, kind 1 a keyword with the same part for every document. ``cost`` orders lists
    for setting them aside: keywords before tokens and short ones, which occur nearly everywhere, first.
    """
    used = lists.groupBy("token").agg(F.max("w").alias("top"))
    part, bound = F.col("qw") * vector_weight, F.col("qw") * F.col("top") * vector_weight
    out = terms.join(used, "token").join(stats, "token").select("query_id", F.col("token").alias("key"), F.lit(0).alias("kind"), part.alias("part"), bound.alias("bound"), (bound / F.col("df")).alias("cost"))
    if keyword_weight:
        each = F.col("share") * keyword_weight
        out = out.unionByName(terms.select("query_id", F.col("token").alias("key"), F.lit(1).alias("kind"), each.alias("part"), each.alias("bound"), (F.length("token") - F.lit(1e6)).alias("cost")))
    return materialize(out.where("bound > 0"))


def _exact(pairs: DataFrame, terms: DataFrame, lists: DataFrame, texts: DataFrame, vector_weight: float, keyword_weight: float) -> DataFrame:
    """``(query_id, doc_id, score)`` of given pairs, a written table."""
    pairs = if_few(pairs)
    hits = lists.join(pairs, "doc_id").join(terms.where("qw > 0").select("query_id", "token", "qw"), ["query_id", "token"])
    out = hits.groupBy("query_id", "doc_id").agg((F.sum(F.col("w") * F.col("qw")) * vector_weight).alias("score"))
    if not keyword_weight:
        return out.select("query_id", "doc_id", F.round("score", DIGITS).alias("score"))
    words = terms.groupBy("query_id").agg(F.collect_list(F.struct("token", "share")).alias("words"))  # one query's tokens
    low = texts.join(pairs, "doc_id").join(words, "query_id")
    there = F.aggregate(F.filter("words", lambda w: F.contains(F.col("low"), w["token"])), F.lit(0.0), lambda s, w: s + w["share"])
    out = out.unionByName(low.select("query_id", "doc_id", (there * keyword_weight).alias("score")))
    return out.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))


def _fill(found: DataFrame, queries: DataFrame, docs: DataFrame, doc_id: str, k: int) -> DataFrame:
    """``found`` and, with score 0, the k smallest ids for every query, so that no query has too few rows."""
    first = [r[0] for r in docs.select(F.col(doc_id).cast("long")).where(F.col(doc_id).isNotNull()).orderBy(doc_id).limit(k).collect()]
    none = queries.select("query_id", F.explode(F.array(*[F.lit(i) for i in first]).cast("array<bigint>")).alias("doc_id"), F.lit(0.0).alias("score"))
    return found.unionByName(none).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def text_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = TOP_K,
    doc_id: str = "doc_id",
    text: str = "text",
    vector_weight: float = VECTOR_WEIGHT,
    keyword_weight: float = KEYWORD_WEIGHT,
    use_idf: bool = True,
) -> DataFrame:
    """Exact top-k of ``vector_weight * cosine + keyword_weight * keyword share``, ties by the smaller id.

    ``queries`` holds ``(query_id, text)``. Vectors are TF-IDF over the corpus, or plain token frequencies without
    ``use_idf``; a keyword counts where it occurs in the text, also inside a word.
    """
    counts, stats, norms = postings(docs, doc_id, text, use_idf)
    asked = materialize(queries.select("query_id", "text").where(F.col("query_id").isNotNull()))
    terms = query_terms(asked, stats, use_idf)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.lower(text).alias("low"))
    # only the lists of tokens that some query has
    mine = materialize(stats.select("token", "idf").join(terms.select("token").distinct(), "token", "left_semi"))
    used = lists_of(counts, mine, norms)
    wanted = _lists_of(terms, used, stats, vector_weight, keyword_weight)
    exact = lambda pairs: _exact(pairs, terms, used, texts, vector_weight, keyword_weight)
    order = [F.desc("score"), F.asc("doc_id")]
    # a first bound from the heads of the best lists
    best = top_k(wanted.where("kind = 0"), ["query_id"], [F.desc("bound"), F.asc("key")], SEED_LISTS).select("query_id", F.col("key").alias("token"))
    best = materialize(best)
    heads = used.join(if_few(materialize(best.select("token").distinct())), "token", "left_semi")
    heads = top_k(heads, ["token"], [F.desc("w"), F.asc("doc_id")], max(SEED_DOCS, k)).select("token", "doc_id")
    seeds = materialize(best.join(heads, "token").select("query_id", "doc_id").distinct())
    reached = top_k(exact(seeds), ["query_id"], order, k, "_rank").where(F.col("_rank") == k).select("query_id", F.col("score").alias("reached"))
    # set aside what stays below the bound altogether
    upto = F.sum("bound").over(Window.partitionBy("query_id").orderBy("cost", "kind", "key"))
    split = join_stats(wanted, reached, ["query_id"]).withColumn("aside", upto < ASIDE * F.coalesce("reached", F.lit(0.0)) - SLACK)
    split = materialize(split.select("query_id", "key", "kind", "part", "bound", "reached", "aside"))
    main = materialize(split.where("not aside").select("query_id", "key", "kind", "part"))
    held = used.select("doc_id", F.col("token").alias("key"), F.lit(0).alias("kind"), "w")
    words = main.where("kind = 1").select(F.col("key").alias("token")).distinct()
    if keyword_weight and not words.isEmpty():
        around = materialize(words_around(words, stats.select(F.col("token").alias("word")), "token"))
        holders = counts.select("doc_id", F.col("token").alias("word")).join(if_few(around), "word").select("doc_id", F.col("part").alias("key")).distinct()
        held = held.unionByName(holders.select("doc_id", "key", F.lit(1).alias("kind"), F.lit(1.0).alias("w")))
    # all of a document in one task, so that its sums and what they miss of the bound need no further shuffle
    limits = if_few(materialize(split.groupBy("query_id").agg(F.max("reached").alias("reached"), F.sum(F.when(F.col("aside"), F.col("bound")).otherwise(0.0)).alias("rest"))))
    n_parts = max(min(norms.count() * limits.count() // PAIRS, PARTS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked_for = if_few(materialize(main.select("key", "kind").distinct()))
    dealt = held.join(asked_for, ["key", "kind"], "left_semi").repartition(n_parts, "doc_id")
    sums = dealt.join(if_few(main), ["key", "kind"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("part") * F.col("w")).alias("sum"))
    hopeful = sums.join(limits, "query_id").where(F.col("sum") + F.col("rest") >= F.coalesce("reached", F.lit(0.0)) - SLACK)
    partial = materialize(hopeful.select("query_id", "doc_id", "sum", "reached", "rest"))
    # the best of these give a closer bound
    ahead = top_k(partial, ["query_id"], [F.desc("sum"), F.asc("doc_id")], AHEAD * k, "_rank").select("query_id", "doc_id")
    closer = top_k(exact(materialize(ahead)), ["query_id"], order, k, "_rank").where(F.col("_rank") == k).select("query_id", F.col("score").alias("closer"))
    bounded = join_stats(partial, closer, ["query_id"])
    bar = F.greatest(F.coalesce("reached", F.lit(0.0)), F.coalesce("closer", F.lit(0.0)))
    left = bounded.where(F.col("sum") + F.col("rest") >= bar - SLACK).select("query_id", "doc_id")
    left = materialize(left)
    if not keyword_weight and left.count() > FEW_ROWS:  # the bounds leave too much: sum up everything, document by document
        weights = materialize(terms.where("qw > 0").select("query_id", "token", "qw"))
        every = used.repartition(n_parts, "doc_id").join(if_few(weights), "token").groupBy("query_id", "doc_id")
        found = every.agg(F.round(F.sum(F.col("w") * F.col("qw")) * vector_weight, DIGITS).alias("score"))
    else:
        found = exact(left)
    found = top_k(found, ["query_id"], order, k, "_rank").drop("_rank")  # before rows of score 0 are added
    return top_k(_fill(found, asked.select("query_id").distinct(), docs, doc_id, k), ["query_id"], order, k)


# ---- vectors -------------------------------------------------------------------------------

def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _angles(rows: DataFrame, pivots: np.ndarray, id_col: str, every: bool) -> DataFrame:
    """Rows with the nearest pivot as ``cell`` and the ``angle`` to it, or with the angles to all pivots."""
    kind = rows.schema[id_col].dataType.simpleString()
    tail = "angles array<double>" if every else "cell int, angle double"

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            x = _unit(np.array(pdf["vector"].tolist(), dtype=np.float64))
            angle = np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))
            if every:
                yield pdf.assign(angles=list(angle))
            else:
                cell = angle.argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), angle=angle[np.arange(len(cell)), cell])

    return rows.select(id_col, F.col("vector").cast("array<double>").alias("vector")).mapInPandas(run, f"{id_col} {kind}, vector array<double>, {tail}")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, pivots: int = PIVOTS) -> DataFrame:
    """Exact cosine top-k: ``queries (query_id, vector)`` against ``vectors (doc_id, vector)``, ties by the smaller id.

    A vector without length has cosine 0 with everything. ``pivots`` vectors of the corpus, chosen by hash, make the
    cells; how well they are chosen changes the work and not the result.
    """
    corpus = materialize(vectors.select("doc_id", "vector").where("doc_id is not null and vector is not null"))
    rows = corpus.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pivots).collect()
    if not rows:
        raise ValueError("no vectors")
    centre = _unit(np.array([r["vector"] for r in rows], dtype=np.float64))
    placed = materialize(_angles(corpus, centre, "doc_id", False))
    cells = materialize(placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")))
    asked = materialize(_angles(queries.where("query_id is not null and vector is not null"), centre, "query_id", True))
    toward = asked.select("query_id", F.posexplode("angles").alias("cell", "away"))
    toward = join_stats(toward, cells, ["cell"]).where("n is not null")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("away", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    toward = materialize(toward.withColumn("first", before < k))

    def compared(visits: DataFrame, limit: Column | None) -> DataFrame:
        pairs = placed.join(visits, "cell")
        if limit is not None:
            pairs = pairs.where(F.abs(F.col("away") - F.col("angle")) <= limit)
        pairs = pairs.join(asked.select("query_id", F.col("vector").alias("_q")), "query_id")
        return pairs.select("query_id", "doc_id", F.round(cosine(F.col("vector"), F.col("_q")), DIGITS).alias("score"))

    order = [F.desc("score"), F.asc("doc_id")]
    near = materialize(top_k(compared(toward.where("first"), None), ["query_id"], order, k, "_rank"))
    reached = near.where(F.col("_rank") == k).select("query_id", F.acos(F.greatest(F.least(F.col("score") - SLACK, F.lit(1.0)), F.lit(-1.0))).alias("limit"))
    # a vector without length is at no angle, but its pivot says a right one; it is never nearer than that
    rest = join_stats(toward.where("not first"), reached, ["query_id"]).withColumn("limit", F.coalesce("limit", F.lit(np.pi)) + ANGLE_SLACK)
    open_cells = rest.where(F.col("away") - F.col("radius") <= F.col("limit")).select("query_id", "cell", "away", "limit")
    both = near.select("query_id", "doc_id", "score").unionByName(compared(open_cells, F.col("limit")))
    return top_k(both, ["query_id"], order, k)


# ---- mentions ------------------------------------------------------------------------------

def mentions(questions: DataFrame, items: DataFrame) -> DataFrame:
    """``(question_id, item_id)`` where the item's name occurs in the question, ignoring case.

    A name is looked for under one word of it. Words with a sign on both sides of them in the name are whole words of
    the question too and are joined directly; the first or last word can be a part of a longer one and is resolved by
    the letter groups; a name without letters goes by its signs. What is found is checked as a whole. Empty names and
    NULLs are found nowhere.
    """
    signs = r"[^\w一-龥]"
    named = materialize(items.select("item_id", F.lower("name").alias("name")).where("item_id is not null and name <> ''"))
    texts = materialize(questions.select("question_id", F.lower("text").alias("text")).where("question_id is not null and text is not null"))
    runs = F.array_distinct(F.filter(F.split("text", signs + "+"), lambda w: w != ""))
    held = materialize(texts.select("question_id", F.explode(runs).alias("word")))
    rarity = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    names = named.select("name").distinct()
    whole = F.regexp_extract_all("name", F.lit(rf"(?<={signs})[\w一-龥]+(?={signs})"), F.lit(0))
    inner = names.select("name", F.explode(F.array_distinct(whole)).alias("word"))
    # a whole word that no question has rules its name out
    by_word = join_stats(inner, rarity, ["word"]).groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("w")).select("name", "w.word")
    others = names.join(by_word, "name", "left_anti")
    longest = F.transform(F.split("name", signs + "+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    edge = materialize(others.select("name", F.array_max(longest)["w"].alias("part")))
    near = words_around(edge.where("part <> ''"), rarity.select("word")).join(edge, "part").select("name", "word")
    pairs = by_word.unionByName(near).join(held, "word").select("name", "question_id").distinct()
    # names of signs only
    bare = edge.where("part = ''").select("name", F.substring("name", 1, 1).alias("sign"))
    found_signs = texts.select("question_id", F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[\w一-龥]", ""), ""))).alias("sign"))
    pairs = pairs.unionByName(bare.join(found_signs, "sign").select("name", "question_id"))
    hits = pairs.join(texts, "question_id").where(F.expr("contains(text, name)")).select("name", "question_id")
    return hits.join(named, "name").select("question_id", "item_id")
