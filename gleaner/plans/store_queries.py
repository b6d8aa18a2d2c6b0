"""Queries through stored tables: what is written under a schema or published is read back, and SQL says what must come."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import count_tokens
from ..operators import lexical, logs, vector
from ..sources import tables as src
from .queries import BM25, _asked, _chunks, _t, query
from .session import once, shared_folder


@query("WITH " + BM25 + " SELECT c AS config_id, CASE WHEN query_id % 2 = 0 THEN 'dev' ELSE 'golden' END AS split, query_id, CAST(rank AS INT) AS rank, CAST(chunk_id AS VARCHAR) AS chunk_id, round(score, 5) AS score FROM bm, (VALUES ('a'), ('b')) t(c) WHERE rank <= 5 AND (c = 'b' OR rank = 1)")
def stored_runs(spark, d):
    """Runs of two configurations and splits; one is written twice, the second time whole; the locked split is read on purpose."""
    found = lexical.search(_chunks(spark, d), _asked(spark, d), k=5).withColumn("split", F.when(F.col("query_id") % 2 == 0, "dev").otherwise("golden"))
    runs = once(found.select("split", "query_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "score"), "found")
    path = shared_folder(spark, "runs")
    src.write_runs(runs.limit(3).withColumn("config_id", F.lit("b")), path)
    src.write_runs(runs.withColumn("config_id", F.lit("b")), path)
    src.write_runs(runs.where("rank = 1").withColumn("config_id", F.lit("a")), path)
    both = src.read_runs(spark, path, "dev").unionByName(src.read_runs(spark, path, "golden", unlock=True))
    return both.select("config_id", "split", "query_id", "rank", "chunk_id", F.round("score", 5).alias("score"))


@query("""WITH q AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 + item_id % 2 END AS n FROM benchmark)
SELECT CAST(item_id AS VARCHAR) AS query_id, 'd' || i AS document_id, 'Section ' || (item_id % 5) AS section_path, CAST(item_id % 7 AS INT) AS page_start, CAST(item_id % 7 + i AS INT) AS page_end FROM q, range(1, 3) t(i) WHERE i <= n""")
def eval_set_labels(spark, d):
    """Questions written as a JSON eval set, some without labels or notes, read under its schema and cut into labels."""
    i = F.col("item_id")
    label = lambda k: F.struct(F.lit(f"d{k}").alias("document_id"), F.concat(F.lit("Section "), (i % 5).cast("string")).alias("section_path"), (i % 7).cast("int").alias("page_start"), (i % 7 + k).cast("int").alias("page_end"))
    labels = F.when(i % 3 == 0, F.lit(None)).when(i % 2 == 0, F.array(label(1))).otherwise(F.array(label(1), label(2)))
    rows = _t(spark, d, "benchmark").select(i.cast("string").alias("query_id"), F.col("text").alias("query"), F.lit("dev").alias("split"), labels.alias("relevant_sections"))
    path = shared_folder(spark, "eval")
    rows.write.json(path)
    queries, found = src.queries_and_labels(src.unique(src.read_json(spark, path, src.QUERIES), "query_id"))
    return found.join(queries.where("notes = '' and size(domains) = 0").select("query_id"), "query_id", "left_semi")


TOKENS = r"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(round_even(len(regexp_extract_all(text, '[^\s\x0b\x0c\x1c-\x1f]+')) * 1.3::DOUBLE, 0) AS INT)) END"


@query(f"SELECT lang, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(CASE WHEN t > 512 THEN 1 ELSE 0 END) AS BIGINT) AS over, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT lang, {TOKENS} AS t FROM documents) GROUP BY lang")
def published_chunks(spark, d):
    """Chunks published twice with their vectors, the second time under refusal: what is read is the first version."""
    docs = _t(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "lang", count_tokens(F.col("text")).alias("token_count"))
    vectors = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), vector.hashed_embedding(F.col("text"), 8).alias("embedding"))
    path = shared_folder(spark, "chunks")
    src.publish_chunks(chunks, vectors, path, "S1", "hashed-8")
    try:
        src.publish_chunks(chunks, vectors.where("embedding[0] > 0"), path, "S1", "hashed-8")
    except src.published.Refused:
        pass
    stored, points = src.read_published_chunks(spark, path, "S1")
    both = stored.join(points.select("chunk_id"), "chunk_id")
    return both.groupBy("lang").agg(F.count("*").alias("chunks"), F.count_if(F.col("token_count") > 512).alias("over"), F.sum("token_count").alias("tokens"))


def _counts(texts: list[str]) -> list[list[float]]:
    """A model that counts characters, spaces and line breaks; of its batch too, so that a batch over the budget shows."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


@query("SELECT doc_id, [length('passage: ' || text)::DOUBLE, length(regexp_replace('passage: ' || text, '[^ ]', '', 'g'))::DOUBLE, length(regexp_replace(text, '[^\\n]', '', 'g'))::DOUBLE] AS embedding FROM documents")
def embedded_passages(spark, d):
    return vector.embed(spark, _t(spark, d, "documents"), _counts, "doc_id", "text", "passage: ", 3)


def _requests(spark, d):
    """Pages as requests: what a page's url asks for, in as many seconds as its html has 65,536 characters; some without an answer."""
    pages = _t(spark, d, "pages")
    status = F.when(F.length("html") % 10 == 0, F.lit(None)).when(F.contains("url", F.lit("utm_source")), 404).otherwise(200)
    return pages.select(F.col("page_id").alias("request_id"), F.lit("GET").alias("method"), F.col("url").alias("target"), status.alias("status"), (F.length("html") / 65_536).alias("seconds"), F.col("html").alias("body"))


LOG = """lg AS (SELECT CAST(page_id AS VARCHAR) AS request_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path,
CAST(CASE WHEN length(html) % 10 = 0 THEN 500 WHEN contains(url, 'utm_source') THEN 404 ELSE 200 END AS INT) AS status, round_even(length(html) / 65536.0::DOUBLE * 1000, 1) AS duration_ms, '<' || length(html) || ' chars>' AS body FROM pages)"""


@query("WITH " + LOG + " SELECT request_id, CASE WHEN status >= 500 THEN 'ERROR' ELSE 'INFO' END AS level, 'request completed' AS message, 'GET' AS method, path, status, duration_ms, body FROM lg")
def request_log(spark, d):
    return logs.request_rows(_requests(spark, d))


@query("WITH " + LOG + " SELECT CASE WHEN length(path) > 64 THEN '<omitted: ' || length(path) || ' chars>' ELSE path END AS path, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE status >= 500) AS BIGINT) AS errors, max(duration_ms) AS slowest_ms FROM lg GROUP BY 1")
def request_metrics(spark, d):
    return logs.stage_metrics(logs.metric_rows(logs.request_rows(_requests(spark, d))))
