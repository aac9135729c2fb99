"""Retrieval on ``embeddings`` and ``documents``; every twentieth row is a stated query against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quill.functions.text import tokens
from quill.operators import context as X
from quill.operators import retrieval as R
from quill.plans.base import Plans, table
from quill.session import stored

PLANS = Plans()
_VEC = """v AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl,
 round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * c.embedding[i]::DOUBLE)), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)"""
_TERMS = """regexp_extract_all(lower(text), '([^\\s\\x0b,;!?()\\[\\]{}"''<>]+)', 1)"""
_BM = f"""d AS (SELECT doc_id AS chunk_id, {_TERMS} AS terms FROM documents), q AS (SELECT item_id AS query_id, {_TERMS} AS terms FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), r AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM df, s), m AS (SELECT avg(raw) AS mean FROM r),
w AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY ALL),
b AS (SELECT query_id, chunk_id, round(sum(qtf * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN r USING (term) JOIN w USING (term), m GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b WHERE score > 0)"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _bm25(spark, d, k):
    q = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("terms"))
    return R.bm25_top(q, table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), tokens(F.col("text")).alias("terms")), k)


@PLANS.add(f"WITH {_VEC}, r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v WHERE score >= 0.25) SELECT * FROM r WHERE rank <= 30")
def ret_vector_topk(spark, d):
    q, c = _vectors(spark, d)
    return R.vector_top(q, c, 30, 0.25).withColumn("rank", F.col("rank").cast("long"))


@PLANS.add(f"WITH {_VEC}, r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v WHERE cl IN (1, 3, 5)) SELECT * FROM r WHERE rank <= 10 AND score >= 0.1")
def ret_vector_filtered_topk(spark, d):
    q, c = _vectors(spark, d)
    return R.vector_top(q, c.where(F.col("label").isin(1, 3, 5)), 10, 0.1, filter_first=False).withColumn("rank", F.col("rank").cast("long"))


@PLANS.add(f"WITH {_BM} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 30")
def ret_bm25_topk(spark, d):
    return _bm25(spark, d, 30).withColumn("rank", F.col("rank").cast("long"))


@PLANS.add(f"""WITH {_VEC}, {_BM}, l AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v),
u AS (SELECT query_id, chunk_id, rank FROM l WHERE rank <= 30 UNION ALL SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 30),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f""")
def ret_rrf_fusion(spark, d):
    q, c = _vectors(spark, d)
    return R.fused(R.vector_top(q, c, 30), _bm25(spark, d, 30)).withColumn("rank", F.col("rank").cast("long"))


@PLANS.add(f"""WITH {_VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v),
n AS (SELECT query_id, chunk_id, rank, ql, cl, score, count(*) OVER (PARTITION BY query_id) AS n FROM r WHERE rank <= 30)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 20 AND n >= 3 THEN chunk_id % 7 END DESC NULLS LAST, rank, chunk_id) AS new_rank FROM n""")
def ret_rerank(spark, d):
    q, c = _vectors(spark, d)
    return R.reranked(R.vector_top(q, c, 30), F.col("chunk_id") % 7).select("query_id", "chunk_id", F.col("new_rank").cast("long").alias("new_rank"))


@PLANS.add(f"""WITH {_VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v),
e AS (SELECT query_id, min(CASE WHEN ql = cl AND rank <= 10 THEN rank END) AS first, count(*) FILTER (WHERE ql = cl AND rank <= 10) AS found, count(*) FILTER (WHERE ql = cl) AS rel FROM r GROUP BY query_id)
SELECT round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 9) AS hit_rate, round(avg(found / rel), 9) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr,
 round(quantile_cont(coalesce(1.0::DOUBLE / first, 0), 0.5), 9) AS p50, round(quantile_cont(coalesce(1.0::DOUBLE / first, 0), 0.95), 9) AS p95 FROM e""")
def ret_metrics(spark, d):
    q, c = _vectors(spark, d)
    e = table(spark, d, "embeddings")
    mine = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    totals = mine.join(e.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant")), "label").select("query_id", "n_relevant")
    hits = R.vector_top(q, c, 10).join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("found")), "chunk_id").join(mine, "query_id").where("found = label").select("query_id", "rank")
    return R.evaluated(hits, totals, mine)


@PLANS.add()
def ret_chunk_documents(spark, d):
    return R.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "start", "stop", F.sha2("chunk", 256).alias("chunk_sha256"))


@PLANS.add()
def ret_citation_windows(spark, d):
    return R.citation_windows(R.chunks(table(spark, d, "documents"), "doc_id", "text"), ["doc_id", "chunk_index"], "chunk")


@PLANS.add("""WITH s AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)
SELECT conv_id, turn, length(text) AS n, length(prev) AS n_prev, length(next) AS n_next FROM s""")
def join_neighbours(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return c.withColumns({"n_prev": F.lag("n").over(w), "n_next": F.lead("n").over(w)})


def _chunked(spark, d):
    c = R.chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").alias("document"), F.floor(F.col("chunk_index") / 4).alias("location"), F.col("chunk_index").alias("index"), F.col("chunk").alias("text"))


def _hybrid(spark, d, k=12):
    """Lists by words and by vectors, fused, the first ones in the order of another score."""
    # every search and context reads the chunks: they are cut once
    chunks = _chunked(spark, d)
    chunks = stored(chunks.withColumn("terms", tokens(F.col("text"))), "chunks")
    q = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("terms"))
    by_words = R.bm25_top(q, chunks.select("chunk_id", "terms"), 30)
    vectors, corpus = _vectors(spark, d)
    corpus = corpus.select(F.concat(F.col("chunk_id").cast("string"), F.lit("-0")).alias("chunk_id"), "vector")
    by_vectors = R.vector_top(vectors, corpus, 30, 0.25)
    ranked = R.reranked(R.fused(by_words, by_vectors), F.pmod(F.xxhash64("chunk_id"), F.lit(97)))
    return ranked.select("query_id", "chunk_id", F.col("new_rank").alias("rank")).where(F.col("rank") <= k), chunks.drop("terms")


@PLANS.add()
def ret_hybrid_search(spark, d):
    return _hybrid(spark, d)[0]


@PLANS.add()
def ret_contexts(spark, d):
    ranked, chunks = _hybrid(spark, d)
    return X.contexts(ranked, chunks, 6, 12_000).select("query_id", "source", "chunk_id", F.sha2("body", 256).alias("body_sha256"))


@PLANS.add()
def ret_context_selection(spark, d):
    asked = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("request_id"), tokens(F.col("text")).alias("terms"), F.explode(F.sequence(F.col("item_id"), F.col("item_id") + 4)).alias("document"))
    chunks = _chunked(spark, d).withColumn("terms", tokens(F.col("text")))
    return X.selected(asked, chunks, 8, 16_000).select("request_id", "place", "chunk_id", F.round("score", 9).alias("score"))


def _quoted(spark, d):
    docs = table(spark, d, "documents")
    said = F.substring("text", 40, 160)
    quotes = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 40 == 0, F.upper(said)).otherwise(F.regexp_replace(said, r" (\w+) (\w+) ", " $2 ")).alias("quote"))
    asked = docs.join(quotes.select("source_id").distinct(), F.col("doc_id") == F.col("source_id"), "left_semi")
    windows = R.citation_windows(asked, ["doc_id"], "text", most=1 << 30).select(F.col("doc_id").alias("source_id"), "start", "stop", "window")
    return X.resolved(quotes, asked.select(F.col("doc_id").alias("source_id"), "text"), windows)


@PLANS.add()
def ret_citation_cascade(spark, d):
    return _quoted(spark, d).select("key", "method", "score", F.sha2("canonical", 256).alias("canonical_sha256"))


@PLANS.add()
def ret_citation_summary(spark, d):
    n = F.count(F.lit(1))
    return _quoted(spark, d).groupBy("method").agg(n.alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
