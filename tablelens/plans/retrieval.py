"""Vectors, search and document-store jobs. Questions are the benchmark texts, the corpus the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions.text import search_tokens
from tablelens.operators import retrieval as ret, search
from tablelens.plans.registry import query, table
from tablelens.session import spread

_TOK = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\w\\x{{4e00}}-\\x{{9fa5}}\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1)"


def tokens_sql(col: str) -> str:
    return _TOK.format(col)


_COUNTS = f"""dt AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS n_tokens, unnest(t) AS token FROM dt),
    c AS (SELECT doc_id, token, count(*) AS tf, any_value(n_tokens) AS n_tokens FROM dl GROUP BY 1, 2),
    df AS (SELECT token, count(*) AS df FROM c GROUP BY 1), nd AS (SELECT count(*) AS n FROM documents)"""
_TFIDF = f"""{_COUNTS}, wt AS (SELECT doc_id, token, tf / n_tokens * ln(n / df) AS w FROM c JOIN df USING (token), nd),
    nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY 1)"""
_QUERIES = f"""qt AS (SELECT item_id AS query_id, {tokens_sql('text')} AS t FROM benchmark), ql AS (SELECT query_id, len(t) AS qn, unnest(t) AS token FROM qt),
    qc AS (SELECT query_id, token, count(*) / any_value(qn) AS tf FROM ql GROUP BY 1, 2)"""


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("search_tokens", "M7", f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def search_token_lists(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(search_tokens(F.col("text")), " ").alias("tokens"))


@query("document_frequency", "M8", f"WITH {_COUNTS} SELECT token, df FROM df")
def document_frequency(spark, sf):
    return ret.document_frequency(_docs(spark, sf), "text")


@query("document_frequency_update", "M9", f"WITH {_COUNTS} SELECT token, CAST(df AS BIGINT) AS df FROM df")
def document_frequency_update(spark, sf):
    docs = _docs(spark, sf)
    known = ret.document_frequency(docs.where(F.col("lang") == "en"), "text")
    new = ret.document_frequency(docs.where(F.col("lang") != "en"), "text")
    return ret.merge_document_frequency(known, new)


@query("tfidf_vectors", "M10", f"WITH {_TFIDF} SELECT doc_id, token, round(w / norm, 6) AS weight FROM wt JOIN nm USING (doc_id) WHERE w > 0")
def tfidf_vectors(spark, sf):
    return ret.tfidf(_docs(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("tfidf_norms", "M10", f"WITH {_TFIDF} SELECT doc_id, 1.0::DOUBLE AS norm FROM nm WHERE norm > 0")
def tfidf_norms(spark, sf):
    return ret.tfidf(_docs(spark, sf)).groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))


_CENTRES = """ex AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    ce AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM ex GROUP BY 1, 2) GROUP BY 1)"""


def _centres(spark, sf):
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda z: z["m"]).alias("centre"))


@query(
    "cosine_to_label_centre",
    "M11",
    f"WITH {_CENTRES} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cosine FROM embeddings JOIN ce USING (label)",
)
def cosine_to_label_centre(spark, sf):
    joined = table(spark, sf, "embeddings").join(_centres(spark, sf), "label")
    return joined.select("vec_id", F.round(ret.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"


@query(
    "nearest_vectors",
    "M12 J4",
    f"""WITH {_CENTRES}, sc AS (SELECT ce.label AS query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score FROM ce, embeddings)
        SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, {_TOP} AS rank FROM sc) WHERE rank <= 5""",
)
def nearest_vectors(spark, sf):
    queries = _centres(spark, sf).select(F.col("label").cast("long").alias("query_id"), F.col("centre").alias("vector"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return search.vector_search(queries, vectors).withColumn("score", F.round("score", 6))


@query(
    "keyword_scores",
    "M13",
    f"""SELECT a.conv_id, a.turn, round(CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda x: contains(lower(b.text), x))) / len(k) ELSE 0 END, 6) AS score
        FROM (SELECT *, {tokens_sql('text')} AS k FROM conversations) a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def keyword_scores(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = turns.join(nxt, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(ret.keyword_score(F.col("answer"), search_tokens(F.col("text"))), 6).alias("score"))


_COS = f"""{_TFIDF}, {_QUERIES}, qw AS (SELECT query_id, token, tf * ln(n / df) AS w FROM qc JOIN df USING (token), nd),
    qm AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
    dots AS (SELECT query_id, doc_id, sum(qw.w * wt.w) AS dot FROM qw JOIN wt USING (token) GROUP BY 1, 2),
    vs AS (SELECT query_id, doc_id, CASE WHEN qm.norm > 0 AND nm.norm > 0 THEN dot / (qm.norm * nm.norm) ELSE 0 END AS v FROM dots JOIN qm USING (query_id) JOIN nm USING (doc_id))"""
_HYBRID = f"""{_COS}, kw AS (SELECT query_id, doc_id, len(list_filter(t, lambda k: contains(low, k))) / len(t) AS k
      FROM qt, (SELECT doc_id, lower(text) AS low FROM documents)),
    hy AS (SELECT kw.query_id, kw.doc_id, round(0.7::DOUBLE * coalesce(v, 0) + 0.3::DOUBLE * k, 9) AS score FROM kw LEFT JOIN vs ON vs.query_id = kw.query_id AND vs.doc_id = kw.doc_id),
    top AS (SELECT * FROM (SELECT *, CAST({_TOP} AS INT) AS rank FROM hy) WHERE rank <= 5)"""


@query(
    "text_search_by_vector",
    "M12 J4",
    f"""WITH {_COS}, al AS (SELECT query_id, doc_id, round(coalesce(v, 0), 9) AS score FROM (SELECT query_id, doc_id FROM qt, documents) LEFT JOIN vs USING (query_id, doc_id))
        SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, {_TOP} AS rank FROM al) WHERE rank <= 5""",
)
def text_search_by_vector(spark, sf):
    found = search.text_search(_questions(spark, sf), _docs(spark, sf), vector_weight=1.0, keyword_weight=0.0)
    return found.withColumn("score", F.round("score", 6))


def _hybrid(spark, sf):
    return search.text_search(_questions(spark, sf), _docs(spark, sf))


@query("hybrid_search", "M14", f"WITH {_HYBRID} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top")
def hybrid_search(spark, sf):
    return _hybrid(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "search_context",
    "M18",
    f"""WITH {_HYBRID} SELECT query_id, round(avg(score), 6) AS mean_score, count(*) AS results,
          CASE WHEN avg(score) >= 0.7 THEN 'high' WHEN avg(score) >= 0.7 * 0.7 THEN 'medium' ELSE 'low' END AS confidence,
          string_agg('[' || rank || '] ' || text, e'\\n\\n---\\n\\n' ORDER BY rank) AS context
        FROM top JOIN documents USING (doc_id) GROUP BY query_id""",
)
def search_context(spark, sf):
    return ret.contexts(_hybrid(spark, sf), _docs(spark, sf)).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "similar_documents_by_frequency",
    "M19",
    f"""WITH {_COUNTS}, {_QUERIES}, dn AS (SELECT doc_id, sqrt(sum((tf / n_tokens) ** 2)) AS norm FROM c GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS norm FROM qc GROUP BY 1),
        sc AS (SELECT query_id, doc_id, round(sum(qc.tf * c.tf / c.n_tokens) / (any_value(qn.norm) * any_value(dn.norm)), 9) AS score
          FROM qc JOIN c USING (token) JOIN qn USING (query_id) JOIN dn USING (doc_id) GROUP BY 1, 2)
        SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, {_TOP} AS rank FROM sc) WHERE rank <= 3""",
)
def similar_documents_by_frequency(spark, sf):
    found = search.text_search(_questions(spark, sf), _docs(spark, sf), k=3, vector_weight=1.0, keyword_weight=0.0, use_idf=False)
    return found.withColumn("score", F.round("score", 6))


@query("explicit_mentions", "M20", "SELECT doc_id AS question_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def explicit_mentions(spark, sf):
    questions = _docs(spark, sf).select(F.col("doc_id").alias("question_id"), "text")
    return search.mentions(questions, table(spark, sf, "benchmark").select("item_id", F.col("text").alias("name")))


# the store: all pages; the incoming batch: the same pages under their address without query and anchor
_STORE = """st AS (SELECT page_id AS id, url, html AS content, page_id * 10 AS created_at, page_id * 10 AS updated_at FROM pages),
    inc AS (SELECT 1000000 + page_id AS id, regexp_replace(url, '[?#].*$', '') AS url, 'new ' || page_id AS content, 1000000 + page_id AS created_at, 1000000 + page_id AS updated_at FROM pages)"""


def _store(spark, sf):
    pages = table(spark, sf, "pages")
    at = F.col("page_id") * 10
    later = F.col("page_id") + 1000000
    old = pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("content"), at.alias("created_at"), at.alias("updated_at"))
    new = pages.select(
        later.alias("id"), F.regexp_replace("url", r"[?#].*$", "").alias("url"), F.concat(F.lit("new "), "page_id").alias("content"),
        later.alias("created_at"), later.alias("updated_at"),
    )
    return old, new


@query(
    "document_upsert",
    "M15",
    f"""WITH {_STORE}, al AS (SELECT * FROM st UNION ALL SELECT * FROM inc)
        SELECT arg_min(id, created_at) AS id, url, arg_max(content, updated_at) AS content, min(created_at) AS created_at, max(updated_at) AS updated_at FROM al GROUP BY url""",
)
def document_upsert(spark, sf):
    return ret.upsert_documents(*_store(spark, sf), ["content"])


_CHUNKS = "ch AS (SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, ps[i] AS content FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(text, '. ') AS ps FROM documents)))"


def _chunks(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("chunk_index", "content"))


@query(
    "chunk_replacement",
    "M15",
    f"""WITH {_CHUNKS} SELECT doc_id, chunk_index, content FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
        UNION ALL SELECT doc_id, 0, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""",
)
def chunk_replacement(spark, sf):
    docs = _docs(spark, sf)
    redone = table(spark, sf, "labels").where(F.col("quality") == 0).select("doc_id").distinct()
    fresh = docs.join(redone, "doc_id", "left_semi").select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    return ret.replace_chunks(_chunks(docs), fresh)


@query(
    "document_delete",
    "M16 J7",
    f"""WITH {_CHUNKS}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
        SELECT 'documents' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
        UNION ALL SELECT 'chunks', count(*) FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM gone)""",
)
def document_delete(spark, sf):
    docs = _docs(spark, sf)
    kept, chunks = ret.delete_documents(docs, _chunks(docs), table(spark, sf, "labels").where(F.col("toxic") == 1))
    count = F.count(F.lit(1)).alias("n")
    return kept.agg(count).select(F.lit("documents").alias("kind"), "n").unionByName(chunks.agg(count).select(F.lit("chunks").alias("kind"), "n"))


@query("document_listing", "M17", f"WITH {_STORE} SELECT id, url, created_at FROM st ORDER BY created_at DESC, id")
def document_listing(spark, sf):
    return ret.list_documents(_store(spark, sf)[0]).select("id", "url", "created_at")


@query("chunk_listing", "M17", f"WITH {_CHUNKS} SELECT doc_id, chunk_index, content FROM ch WHERE doc_id = (SELECT max(doc_id) FROM documents) ORDER BY chunk_index")
def chunk_listing(spark, sf):
    docs = _docs(spark, sf)
    return ret.chunks_of_document(_chunks(docs), docs.agg(F.max("doc_id")).first()[0])


@query("chunk_listing_all", "M17", f"WITH {_CHUNKS} SELECT doc_id, chunk_index, content FROM ch ORDER BY doc_id, chunk_index")
def chunk_listing_all(spark, sf):
    return _chunks(_docs(spark, sf)).orderBy("doc_id", "chunk_index")
