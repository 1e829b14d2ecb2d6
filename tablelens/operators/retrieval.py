"""Vectors over a corpus, what is made of search results, and the document store. The searches are in ``search.py``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.functions.text import bind, search_tokens
from tablelens.operators.joins import join_frequent
from tablelens.session import materialize

# fixed values: result sizes, score weights, confidence limits
TOP_K, VECTOR_WEIGHT, KEYWORD_WEIGHT, SIMILAR = 5, 0.7, 0.3, 0.7


# ---- corpus statistics ---------------------------------------------------------------------

def term_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, token, tf, n_tokens)``: one row per document and different token, without a shuffle."""
    # counted inside the row: sorted tokens, the first of each run of equal ones, distance to the next
    def counted(s: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
        new = F.filter(F.transform(F.zip_with(s, before, lambda t, b: F.when(t != b, t)), lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda m: m["t"].isNotNull())
        return bind(new, lambda starts: lengths(starts, F.size(s)))

    def lengths(starts: Column, n: Column) -> Column:
        ends = F.concat(F.transform(F.slice(starts, 2, F.size(starts)), lambda m: m["i"]), F.array(n))
        return F.zip_with(starts, ends, lambda m, e: F.struct(m["t"].alias("token"), (e - m["i"]).cast("long").alias("tf"), n.alias("n_tokens")))

    runs = bind(F.sort_array(search_tokens(F.col(text))), lambda s: F.when(F.size(s) > 0, counted(s)))
    return docs.select(F.col(doc_id).alias("doc_id"), F.inline(runs))


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """``(token, df)``: documents that hold each token."""
    tokens = docs.select(F.explode(F.array_distinct(search_tokens(F.col(text)))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def merge_document_frequency(known: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics of a grown corpus from those of its parts."""
    return known.unionByName(new).groupBy("token").agg(F.sum("df").alias("df"))


def tfidf(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sparse L2-normalised vectors ``(doc_id, token, weight)`` with tf / length * ln(N / df); zeros left out."""
    counts = materialize(term_counts(docs, doc_id, text))
    known = materialize(counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log(F.lit(float(docs.count())) / F.col("df"))
    weights = join_frequent(counts, known, "token", "df").select("doc_id", "token", (F.col("tf") / F.col("n_tokens") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return weights.withColumn("norm", norm).where(F.col("w") > 0).select("doc_id", "token", (F.col("w") / F.col("norm")).alias("weight"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def keyword_score(content: Column, keywords: Column) -> Column:
    """Share of keywords that occur in the text as substrings."""
    low = F.lower(content)
    hits = F.size(F.filter(keywords, lambda k: F.contains(low, k)))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(F.lit(0.0))


# ---- results -------------------------------------------------------------------------------

def confidence(found: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Confidence of each query from its mean score."""
    mean = F.avg("score")
    label = F.when(F.col("mean_score") >= similar, "high").when(F.col("mean_score") >= 0.7 * similar, "medium").otherwise("low")
    return found.groupBy("query_id").agg(mean.alias("mean_score"), F.count(F.lit(1)).alias("results")).withColumn("confidence", label)


def contexts(found: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Numbered result texts per query, with the confidence; a query has at most k results."""
    texts = found.join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("content")), "doc_id")
    ranked = F.array_sort(F.collect_list(F.struct("rank", "content")))
    joined = F.array_join(F.transform(ranked, lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["content"])), "\n\n---\n\n")
    return texts.groupBy("query_id").agg(joined.alias("context")).join(confidence(found, similar), "query_id")


# ---- document store ------------------------------------------------------------------------

def upsert_documents(existing: DataFrame, incoming: DataFrame, payload: list[str]) -> DataFrame:
    """One row per url: the oldest id and creation time, the newest payload."""
    both = existing.unionByName(incoming)
    order = F.struct("updated_at", "id")
    newest = F.max_by(F.struct(*payload), order)
    return both.groupBy("url").agg(
        F.min_by("id", F.struct("created_at", "id")).alias("id"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        newest.alias("_p"),
    ).select("id", "url", *[F.col(f"_p.{c}").alias(c) for c in payload], "created_at", "updated_at")


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after an upsert: those of re-indexed documents are replaced as a whole."""
    again = fresh.select("doc_id").distinct()
    return chunks.join(again, "doc_id", "left_anti").unionByName(fresh)


def delete_documents(docs: DataFrame, chunks: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those named in ``gone``."""
    ids = gone.select(F.col(doc_id)).distinct()
    return docs.join(ids, doc_id, "left_anti"), chunks.join(ids, doc_id, "left_anti")


def list_documents(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.desc("created_at"), "id")


def chunks_of_document(chunks: DataFrame, doc_id) -> DataFrame:
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index")
