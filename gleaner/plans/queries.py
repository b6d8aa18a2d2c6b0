"""Queries over the test tables for the operators outside the training-data subpackage, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import chunking, contracts, evaluate, fusion, inverted_index, layout, lexical, rerank, rules, vector
from ..operators import evidence as ev
from ..sources import tables as src
from ..streaming import limiter
from .session import once, shared_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


#: Tables of texts.
TEXTS = ("documents", "conversations")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: SQL of the lexical ranking: documents by benchmark item.
BM25 = r"""
toks AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM toks),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(ws) AS dl, unnest(ws) AS term FROM toks) GROUP BY 1, 2),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, st GROUP BY term, n),
w AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN post USING (term) JOIN w USING (term), st GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc) WHERE rank <= 25 AND score > 0)
"""


@query("WITH " + BM25 + " SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, round(score, 5) AS score FROM bm")
def bm25_search(spark, d):
    return lexical.search(_chunks(spark, d), _asked(spark, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 5).alias("score"))


@query(SQL["bm25_search"])
def bm25_search_stored(spark, d):
    path = shared_folder(spark, "index")
    inverted_index.build(spark, _chunks(spark, d), path)
    found = inverted_index.Index(spark, path).search(_asked(spark, d))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 5).alias("score"))


@query("WITH " + BM25 + " SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(any_value(idf), 6) AS idf FROM post JOIN w USING (term) GROUP BY term")
def term_statistics(spark, d):
    index = lexical.postings(_chunks(spark, d))
    weights = lexical.term_weights(index, lexical.statistics(_chunks(spark, d)))
    return index.groupBy("term").agg(F.sum("tf").alias("cf")).join(weights, "term").select("term", "df", "cf", F.round("idf", 6).alias("idf"))


#: A second ranking of documents: the newest copies of the benchmark's passages, by position.
FUSED = BM25 + r""",
other AS (SELECT query_id, chunk_id, rank AS orank FROM (SELECT item_id AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)) WHERE rank <= 25),
fu AS (SELECT coalesce(o.query_id, b.query_id) AS query_id, coalesce(o.chunk_id, b.chunk_id) AS chunk_id, orank AS dense_rank, rank AS bm25_rank,
       coalesce(1.0::DOUBLE / (60 + orank), 0) + coalesce(1.0::DOUBLE / (60 + rank), 0) AS rrf FROM other o FULL OUTER JOIN bm b ON o.query_id = b.query_id AND o.chunk_id = b.chunk_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS rank FROM fu)
"""


def _second(spark, d):
    return _newest(lexical.holding(_chunks(spark, d), _asked(spark, d)))


def _newest(hits):
    by = Window.partitionBy("query_id").orderBy(F.col("chunk_id").desc())
    return hits.withColumn("rank", F.row_number().over(by)).where("rank <= 25").withColumn("score", F.lit(1.0))


def _fused(spark, d):
    return fusion.fuse(_second(spark, d), lexical.search(_chunks(spark, d), _asked(spark, d)))


@query("WITH " + FUSED + " SELECT query_id, chunk_id, CAST(dense_rank AS BIGINT) AS dense_rank, CAST(bm25_rank AS BIGINT) AS bm25_rank, round(rrf, 9) AS rrf_score FROM fu")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("rrf_score", 9).alias("rrf_score"))


@query("WITH " + FUSED + " SELECT r.query_id, CAST(r.rank AS BIGINT) AS rank, r.chunk_id, round(rrf, 9) AS score, CAST(max(CASE WHEN contains(d.text, b.text) THEN 1 ELSE 0 END) OVER (PARTITION BY r.query_id) AS INT) AS hit FROM rk r JOIN documents d ON d.doc_id = r.chunk_id JOIN benchmark b ON b.item_id = r.query_id WHERE r.rank <= 5")
def evidence_top5(spark, d):
    ranked = fusion.rank(_fused(spark, d), score="rrf_score", k=5)
    known = ranked.join(_chunks(spark, d), "chunk_id").join(_asked(spark, d), "query_id")
    hit = F.max(F.expr("contains(text, query)").cast("int")).over(Window.partitionBy("query_id"))
    return known.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("rrf_score", 9).alias("score"), hit.alias("hit"))


@query("WITH " + FUSED + ", bo AS (SELECT f.*, rrf + CASE WHEN d.lang = 'en' THEN 0.02 ELSE 0 END AS s FROM fu f JOIN documents d ON d.doc_id = f.chunk_id) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS BIGINT) AS rank, chunk_id, round(s, 9) AS boosted_score FROM bo")
def domain_boost(spark, d):
    langs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.array("lang").alias("domains"))
    boosted = fusion.boost(_fused(spark, d).join(langs, "chunk_id"), F.col("domains"), F.array(F.lit("en")))
    return fusion.rank(boosted).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("boosted_score", 9).alias("boosted_score"))


@query("WITH " + FUSED + " SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank FROM (SELECT r.*, row_number() OVER (PARTITION BY query_id, sha256(d.text) ORDER BY rank) AS n FROM rk r JOIN documents d ON d.doc_id = r.chunk_id) WHERE n = 1")
def exact_copies_dropped(spark, d):
    hashes = _chunks(spark, d).select("chunk_id", X.content_hash(F.col("text")).alias("content_hash"))
    ranked = fusion.rank(_fused(spark, d), score="rrf_score").join(hashes, "chunk_id")
    return fusion.drop_exact_copies(ranked).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("WITH " + FUSED + ", runs AS (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, orank FROM other) SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM runs GROUP BY 1, 2")
def multi_query_fusion(spark, d):
    one = lexical.search(_chunks(spark, d), _asked(spark, d)).withColumn("variant", F.lit(0))
    two = _second(spark, d).withColumn("variant", F.lit(1))
    runs = one.unionByName(two).withColumnRenamed("score", "boosted_score")
    return fusion.merge_variants(runs).select("query_id", "chunk_id", F.round("boosted_score", 9).alias("score"))


VEC = "v AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 50 = 0), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM v)"


def _near(spark, d, k=25):
    e = _t(spark, d, "embeddings")
    return vector.search(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query("WITH " + VEC + " SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(s, 6) AS score FROM vr WHERE rank <= 25")
def vector_search(spark, d):
    return _near(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


METRICS = VEC + """, j AS (SELECT r.query_id, r.rank, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS rel, a.label + 1 AS tokens FROM vr r JOIN embeddings a ON a.vec_id = r.vec_id JOIN embeddings b ON b.vec_id = r.query_id WHERE rank <= 10),
z AS (SELECT q.vec_id AS query_id, count(*) AS n_rel FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 50 = 0 GROUP BY 1),
m AS (SELECT z.query_id, k, sum(CASE WHEN rank <= k THEN rel ELSE 0 END) / k::DOUBLE AS precision, sum(CASE WHEN rank <= k THEN rel ELSE 0 END) / n_rel::DOUBLE AS recall,
 CAST(max(CASE WHEN rank <= k THEN rel ELSE 0 END) AS INT) AS hit, sum(CASE WHEN rank <= k THEN rel / log2(rank + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, k) + 1) t(i)) AS ndcg,
 coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr, sum(CASE WHEN rank <= k AND rel = 0 THEN tokens ELSE 0 END) / sum(CASE WHEN rank <= k THEN tokens END)::DOUBLE AS wasted
 FROM z JOIN j USING (query_id), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY z.query_id, k, n_rel)"""


def _scores(spark, d):
    e = _t(spark, d, "embeddings")
    own = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = own.join(e, "label").select("query_id", "vec_id")
    runs = _near(spark, d, 10).join(e.select("vec_id", (F.col("label") + 1).alias("tokens")), "vec_id")
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return evaluate.metrics_at(evaluate.judged(runs, relevant, "vec_id"), sizes, [1, 3, 5, 10], "tokens")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("WITH " + METRICS + " SELECT query_id, k, round(precision, 6) AS precision, round(recall, 6) AS recall, hit, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(wasted, 6) AS wasted FROM m")
def metrics_by_query(spark, d):
    return _rounded(_scores(spark, d), "precision", "recall", "ndcg", "mrr", "wasted")


@query("WITH " + METRICS + " SELECT k, CAST(count(*) AS BIGINT) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(wasted), 6) AS wasted FROM m GROUP BY k")
def metrics_report(spark, d):
    return _rounded(evaluate.report(_scores(spark, d)), "precision", "recall", "hit", "ndcg", "mrr", "wasted")


@query("WITH " + METRICS + f""", dr AS (SELECT k, recall, len(list_filter({evaluate.POISSON}::DOUBLE[], lambda c: c <= CAST('0x' || substr(md5('42:' || query_id || ':' || i), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)) AS w, i FROM m, range(2000) t(i)),
me AS (SELECT k, i, sum(w * recall) / sum(w) AS x FROM dr GROUP BY 1, 2 HAVING sum(w) > 0)
SELECT k, round(any_value(a), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM me JOIN (SELECT k, avg(recall) AS a FROM m GROUP BY 1) USING (k) GROUP BY k""")
def bootstrap_interval(spark, d):
    return _rounded(evaluate.bootstrap(_scores(spark, d), "recall", "k"), "mean", "low", "high")


@query("WITH " + BM25 + ", rl AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT query_id, CAST(count(*) AS BIGINT) AS relevant, CAST(count(bm.chunk_id) AS BIGINT) AS found, count(*) = count(bm.chunk_id) AS complete FROM rl LEFT JOIN (SELECT * FROM bm WHERE rank <= 5) bm USING (query_id, chunk_id) GROUP BY query_id HAVING count(*) > 1")
def fully_retrieved(spark, d):
    relevant = lexical.holding(_chunks(spark, d), _asked(spark, d)).select("query_id", "chunk_id")
    return evaluate.fully_retrieved(lexical.search(_chunks(spark, d), _asked(spark, d)), relevant)


@query("WITH " + FUSED + """, rl AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), z AS (SELECT query_id, count(*) AS n FROM rl GROUP BY 1),
u AS (SELECT 'bm25' AS stage, query_id, chunk_id, rank FROM bm UNION ALL SELECT 'fused', query_id, chunk_id, rank FROM rk),
m AS (SELECT stage, z.query_id, coalesce(sum(CASE WHEN rl.chunk_id IS NOT NULL THEN 1 ELSE 0 END) FILTER (WHERE u.rank <= 5), 0) / n::DOUBLE AS recall FROM z JOIN u USING (query_id) LEFT JOIN rl ON rl.query_id = u.query_id AND rl.chunk_id = u.chunk_id GROUP BY stage, z.query_id, n)
SELECT stage, CAST(count(*) AS BIGINT) AS queries, round(avg(recall), 6) AS recall FROM m GROUP BY stage""")
def ablation(spark, d):
    relevant = once(lexical.holding(_chunks(spark, d), _asked(spark, d)), "relevant")
    found = once(lexical.search(_chunks(spark, d), _asked(spark, d)), "found")
    stages = {"bm25": found, "fused": fusion.rank(fusion.fuse(_newest(relevant), found), score="rrf_score")}
    return evaluate.ablation(stages, relevant, relevant.groupBy("query_id").agg(F.count("*").alias("n_rel")), [5]).select("stage", "queries", F.round("recall", 6).alias("recall"))


def _spans(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.concat("lang", (F.col("doc_id") % 7).cast("string")).alias("section_path"), (F.col("doc_id") % 50).cast("int").alias("page_start"), (F.col("doc_id") % 50 + F.col("n_chars") % 3).cast("int").alias("page_end"))


@query("""WITH c AS (SELECT doc_id AS chunk_id, source AS document_id, lang || (doc_id % 7) AS section_path, doc_id % 50 AS page_start, doc_id % 50 + n_chars % 3 AS page_end FROM documents),
l AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS document_id, 'en' || (item_id % 7) AS section_path, item_id % 45 AS page_start, item_id % 45 + item_id % 4 - 1 AS page_end FROM benchmark)
SELECT DISTINCT query_id, chunk_id FROM c JOIN l ON c.document_id = l.document_id AND (c.section_path = l.section_path OR (l.page_start <= l.page_end AND c.page_start <= l.page_end AND l.page_start <= c.page_end))""")
def relevance_join(spark, d):
    i = F.col("item_id")
    labels = _t(spark, d, "benchmark").select(i.alias("query_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("document_id"), F.concat(F.lit("en"), (i % 7).cast("string")).alias("section_path"), (i % 45).cast("int").alias("page_start"), (i % 45 + i % 4 - 1).cast("int").alias("page_end"))
    return evaluate.relevant_chunks(_spans(spark, d), labels)


def _scored(spark, d):
    return _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select(F.try_divide(F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+")).cast("double"), F.col("n_chars")).alias("score"), (F.col("quality") == 1).alias("in_domain")).where("score is not null")


@query("""WITH s AS (SELECT len(regexp_extract_all(lower(text), '[a-z0-9]+')) / n_chars::DOUBLE AS score, quality = 1 AS ok FROM labels JOIN documents USING (doc_id) WHERE n_chars > 0),
u AS (SELECT DISTINCT score FROM s), c AS (SELECT coalesce((score + lead(score) OVER (ORDER BY score)) / 2, score + 1e-6) AS tau FROM u UNION ALL SELECT min(score) - 1e-6 FROM u),
r AS (SELECT tau, count(*) FILTER (WHERE NOT ok AND score < tau) / count(*) FILTER (WHERE NOT ok)::DOUBLE AS cr, count(*) FILTER (WHERE ok AND score < tau) / count(*) FILTER (WHERE ok)::DOUBLE AS fr FROM c JOIN s ON true GROUP BY tau)
SELECT round(tau, 9) AS tau, round(cr, 9) AS correct_refusal, round(fr, 9) AS false_refusal FROM r WHERE fr <= 0.1 ORDER BY cr DESC, tau LIMIT 1""")
def threshold_fit(spark, d):
    return evaluate.fit_threshold(_scored(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("tau", "correct_refusal", "false_refusal")])


@query("SELECT round(quantile_cont(value, 0.025), 6) AS p2_5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.6), 6) AS p60, round(quantile_cont(value, 0.975), 6) AS p97_5 FROM (SELECT CAST(n_chars AS DOUBLE) AS value FROM documents)")
def percentile_report(spark, d):
    found = evaluate.percentiles(_t(spark, d, "documents").select(F.col("n_chars").cast("double").alias("value")), "value", [2.5, 50, 60, 97.5])
    return _rounded(found, *found.columns)


@query("WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM (SELECT p_retailprice AS value FROM part)) SELECT max(CASE WHEN i = n // 2 THEN value END) AS median, max(CASE WHEN i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN value END) AS p95 FROM s")
def latency_summary(spark, d):
    return evaluate.latency_summary(_t(spark, d, "part").select(F.col("p_retailprice").alias("value")), "value")


@query("SELECT chunks_in_section, CAST(count(*) AS BIGINT) AS sections FROM (SELECT count(*) AS chunks_in_section FROM documents GROUP BY source, lang || (doc_id % 7)) GROUP BY 1")
def section_histogram(spark, d):
    return evaluate.section_histogram(_spans(spark, d))


@query("SELECT 'sha256:' || sha256(text) AS content_hash, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_hashes(spark, d):
    return evaluate.duplicate_hashes(_t(spark, d, "documents").select(X.content_hash(F.col("text")).alias("content_hash")))


@query(r"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(round_even(len(regexp_extract_all(text, '[^\s\x0b\x0c\x1c-\x1f]+')) * 1.3::DOUBLE, 0) AS INT)) END AS tokens FROM documents")
def token_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("tokens"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum(CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) < 0.9 * len(regexp_extract_all(text, '\\p{L}')) THEN 1 ELSE 0 END) AS BIGINT) AS accented FROM documents GROUP BY lang")
def latin_share(spark, d):
    few = F.coalesce(X.latin_share(F.col("text")) < 0.9, F.lit(False))
    return _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(few).alias("accented"))


ASK = ["my chest hurts with crushing pressure", "sudden weakness on my left side and slurred speech today", "what dose of ibuprofen should I take", "my baby is floppy and will not feed", "take 500 mg every 8 hours daily for 7 days", "she fainted and is confused, heavy bleeding", "a mild cough since last week", "initiate immediately, Grade B"]
ASKED = "a AS (SELECT conv_id, turn, text || ' ' || list_extract([" + ", ".join("'" + x + "'" for x in ASK) + "], CAST((conv_id + turn) % 8 + 1 AS INT)) AS text FROM conversations)"


def _talk(spark, d):
    phrase = F.element_at(F.array(*map(F.lit, ASK)), ((F.col("conv_id") + F.col("turn")) % len(ASK) + 1).cast("int"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", phrase).alias("text"))


def _rule_sql() -> str:
    parts = []
    for name, (_, floor, groups) in K.RULES.items():
        test = " AND ".join("(" + " OR ".join("regexp_matches(t, '" + p.replace("'", "''") + "')" for p in g) + ")" for g in groups)
        parts.append(f"SELECT conv_id, turn, '{name}' AS rule_id, {K.URGENCIES.index(floor)} AS floor_rank FROM n WHERE {test}")
    return "WITH " + ASKED + ", n AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM a), r AS (" + " UNION ALL ".join(parts) + ")"


@query(_rule_sql() + " SELECT conv_id, turn, rule_id, CAST(floor_rank AS INT) AS floor_rank FROM r")
def red_flags(spark, d):
    found = rules.match_rules(_talk(spark, d).withColumn("plain", F.lower(X.squeeze(F.col("text")))), "plain")
    return found.select("conv_id", "turn", F.inline("matches")).select("conv_id", "turn", "rule_id", "floor_rank")


@query(_rule_sql() + " SELECT conv_id * 1000 + turn AS id, rule_id FROM r")
def red_flags_by_join(spark, d):
    rows = _talk(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lower(X.squeeze(F.col("text"))).alias("text"))
    return rules.match_rules_by_join(rows, rules.rule_table(spark), "id")


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{x}')" for x in terms) + ")"


@query(_rule_sql() + f""", f AS (SELECT conv_id, turn, max(floor_rank) AS fl, count(*) AS flags FROM r GROUP BY 1, 2),
z AS (SELECT n.conv_id, n.turn, coalesce(fl, 0) AS fl, coalesce(flags, 0) AS flags, {_any(K.SEVERITY_TERMS)} AS sv, {_any(K.ACUTE_TERMS)} AS ac, {_any(K.VULNERABLE_TERMS)} AS vu FROM n LEFT JOIN f USING (conv_id, turn)),
y AS (SELECT *, CASE WHEN sv THEN 2 WHEN ac OR vu THEN 1 ELSE 0 END AS ar FROM z)
SELECT conv_id, turn, CAST(ar AS INT) AS assessed_rank, list_extract(['LOW', 'MODERATE', 'HIGH', 'CRITICAL'], CAST(greatest(ar, fl) AS INT) + 1) AS urgency, greatest(ar, fl) > ar AS floor_applied,
CAST(greatest(1, sv::INT + ac::INT + vu::INT + flags) AS INT) AS factors, round_even(least(0.95::DOUBLE, 0.55::DOUBLE + 3 * 0.02::DOUBLE + CASE WHEN flags > 0 THEN 0.10::DOUBLE ELSE 0 END), 2) AS confidence FROM y""")
def risk_assessment(spark, d):
    rows = rules.match_rules(_talk(spark, d).withColumn("plain", F.lower(X.squeeze(F.col("text")))), "plain")
    rows = rows.withColumns({"domains": F.array().cast("array<string>"), "sufficiency": F.lit("PARTIAL"), "support_count": F.lit(3)})
    return rules.assess_risk(rows, "plain").select("conv_id", "turn", "assessed_rank", "urgency", "floor_applied", F.size("factors").alias("factors"), "confidence")


@query("WITH " + ASKED + " SELECT conv_id, turn, kind, phrase FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS phrase FROM a" for k, p in K.DOSES.items()) + ")")
def dose_phrases(spark, d):
    rows = _talk(spark, d).withColumn("key", F.struct("conv_id", "turn"))
    return rules.dose_phrases(rows, "key").select("key.*", "kind", "phrase")


@query("WITH " + ASKED + " SELECT conv_id, turn, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in K.PRESCRIPTION_REQUESTS) + " AS asks FROM a")
def prescription_requests(spark, d):
    return _talk(spark, d).select("conv_id", "turn", rules.asks_for_prescription(F.col("text")).alias("asks"))


@query("WITH " + ASKED + f" SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{K.RECOMMENDATION}') THEN 'recommendation' ELSE 'guidance' END AS chunk_type, upper(nullif(concat(regexp_extract(text, '{K.GRADE}', 1), regexp_extract(text, '{K.GRADE}', 2)), '')) AS grade FROM a")
def chunk_types_and_grades(spark, d):
    return _talk(spark, d).select("conv_id", "turn", X.chunk_type(F.col("text"), F.lit(False)).alias("chunk_type"), X.evidence_grade(F.col("text")).alias("grade"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 64 THEN '<omitted: ' || length(text) || ' chars>' ELSE text END AS text FROM conversations")
def log_guard(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", X.guarded(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN s < 0.2 AND conv_id % 2 = 0 THEN 'OUT_OF_SCOPE' WHEN s < 0.2 THEN 'INSUFFICIENT' WHEN s >= 0.7 AND turn >= 2 THEN 'SUFFICIENT' ELSE 'PARTIAL' END AS state FROM (SELECT *, (conv_id % 10) / 10.0::DOUBLE AS s FROM conversations)")
def sufficiency_gate(spark, d):
    rows = _t(spark, d, "conversations").withColumn("s", (F.col("conv_id") % 10) / 10.0)
    state = ev.sufficiency(F.col("s"), F.lit(0.0), F.col("turn"), F.col("conv_id") % 2 != 0, {"rerank": (0.7, 0.2), "rrf": ev.TAU["rrf"]})
    return rows.select("conv_id", "turn", state.alias("state"))


@query("""WITH x AS (SELECT conv_id, turn, CAST(conv_id % 4 AS INT) AS r, CASE turn % 4 WHEN 0 THEN 'SUFFICIENT' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'INSUFFICIENT' ELSE 'OUT_OF_SCOPE' END AS st, turn AS sup, conv_id % 3 = 0 AS ref FROM conversations),
y AS (SELECT *, st IN ('PARTIAL', 'INSUFFICIENT') OR sup < 2 AS weak FROM x)
SELECT conv_id, turn, r >= 2 AS banner, r = 3 AS emergency, r = 0 AND NOT weak AND NOT ref AS self_care, (r = 0 AND weak) OR ref AS followup, CASE r WHEN 3 THEN 'emergency' WHEN 2 THEN 'urgent_care' WHEN 1 THEN 'evaluation' ELSE 'guidance' END AS action FROM y""")
def decisions(spark, d):
    rows = _t(spark, d, "conversations").withColumn("u", rules.urgency_name((F.col("conv_id") % 4).cast("int")))
    state = F.element_at(F.array(*map(F.lit, ["SUFFICIENT", "PARTIAL", "INSUFFICIENT", "OUT_OF_SCOPE"])), (F.col("turn") % 4 + 1).cast("int"))
    act = rules.decide_actions(F.col("u"), state, F.col("turn"), F.col("conv_id") % 3 == 0)
    return rows.withColumn("a", act).select("conv_id", "turn", F.col("a.show_emergency_banner").alias("banner"), F.col("a.recommend_emergency_care").alias("emergency"), F.col("a.recommend_self_care").alias("self_care"), F.col("a.show_followup_question").alias("followup"), rules.action_type(F.col("u")).alias("action"))


def _pack(spark, d):
    hits = lexical.holding(_chunks(spark, d), _asked(spark, d)).select("query_id", "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where("rank <= 5")
    return once(ev.pack(ranked.withColumns({"rrf_score": 1.0 / (60 + F.col("rank")), "rerank_score": F.lit(None).cast("double")}), _chunks(spark, d)), "pack")


PACK = "p AS (SELECT * FROM (SELECT item_id AS query_id, doc_id AS chunk_id, d.text, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)) WHERE rank <= 5)"


@query("WITH " + PACK + " SELECT query_id, round(max(1.0::DOUBLE / (60 + rank)), 9) AS top_rrf_score, CAST(count(*) AS BIGINT) AS support_count FROM p GROUP BY query_id")
def evidence_packs(spark, d):
    return ev.pack_summary(_pack(spark, d)).select("query_id", F.round("top_rrf_score", 9).alias("top_rrf_score"), "support_count")


@query("WITH " + PACK + ", s AS (SELECT item_id AS query_id, k AS statement_no, CASE k WHEN 1 THEN ['E1'] WHEN 2 THEN ['E1', 'E9'] ELSE [] END AS ids FROM benchmark, (SELECT unnest([1, 2, 3]) AS k)), kn AS (SELECT query_id, list('E' || rank) AS known FROM p GROUP BY 1), o AS (SELECT s.*, len(ids) > 0 AND list_has_all(coalesce(known, []), ids) AS valid FROM s LEFT JOIN kn USING (query_id)) SELECT query_id, CAST(statement_no AS INT) AS statement_no, valid, CASE WHEN valid THEN NULL WHEN len(ids) = 0 THEN 'no citation' ELSE 'unresolved citation' END AS reason FROM o")
def citation_check(spark, d):
    ids = F.array(F.array(F.lit("E1")), F.array(F.lit("E1"), F.lit("E9")), F.array().cast("array<string>"))
    said = _asked(spark, d).select("query_id", F.posexplode(ids).alias("at", "evidence_ids")).select("query_id", (F.col("at") + 1).alias("statement_no"), F.lit("x").alias("text"), "evidence_ids")
    return ev.resolve_statements(said, _pack(spark, d)).select("query_id", "statement_no", "valid", "reason")


@query("WITH " + PACK + ", x AS (SELECT item_id AS query_id, 'E' || (1 + item_id % 2) AS evidence_id, CASE WHEN item_id % 3 = 0 THEN upper(text) ELSE text END AS quote FROM benchmark) SELECT x.query_id, x.evidence_id, CASE WHEN p.chunk_id IS NULL THEN 'unknown evidence' WHEN NOT contains(p.text, quote) THEN 'not verbatim' END AS reason FROM x LEFT JOIN p ON p.query_id = x.query_id AND 'E' || p.rank = x.evidence_id")
def excerpt_check(spark, d):
    i = F.col("query_id")
    quotes = _asked(spark, d).select("query_id", F.concat(F.lit("E"), (1 + i % 2).cast("string")).alias("evidence_id"), F.when(i % 3 == 0, F.upper("query")).otherwise(F.col("query")).alias("quote"))
    return ev.resolve_excerpts(quotes, _pack(spark, d)).select("query_id", "evidence_id", "reason")


#: Lines of documents on pages of a source, a page each.
LINES = "ln AS (SELECT source AS document_id, doc_id AS page_number, i - 1 AS line_no, 40.0::DOUBLE + 12 * (i - 1) AS y0, x AS text FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), pg AS (SELECT document_id, count(DISTINCT page_number) AS pages FROM ln GROUP BY 1)"


def _lines(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    n = F.length("text")
    return rows.withColumns({"y0": F.lit(40.0) + 12 * F.col("line_no"), "x0": F.lit(50.0), "page_height": F.lit(800.0), "page_width": F.lit(600.0), "font_sizes": F.array(F.when(n < 40, 16.0).otherwise(11.0)), "bold": n % 2 == 0})


@query("WITH " + LINES + r", b AS (SELECT *, CASE WHEN y0 < 50 THEN 'top' WHEN y0 > 750 THEN 'bottom' END AS zone, trim(regexp_replace(text, '[\s\x0b\x0c\x1c-\x1f\x85\xa0]+', ' ', 'g')) AS norm FROM ln) SELECT b.document_id, zone, norm, CAST(count(DISTINCT page_number) AS BIGINT) AS n FROM b JOIN pg USING (document_id) WHERE zone IS NOT NULL GROUP BY b.document_id, zone, norm, pages HAVING count(DISTINCT page_number) >= greatest(1, CAST(floor(pages * 0.05::DOUBLE) AS BIGINT))")
def repeated_headers(spark, d):
    return layout.repeated_texts(_lines(spark, d), 0.05)


@query("WITH " + LINES + ", b AS (SELECT *, CASE WHEN y0 < 50 THEN 'top' WHEN y0 > 750 THEN 'bottom' END AS zone, round_even(y0, 0) AS slot FROM ln) SELECT b.document_id, zone, slot, CAST(count(*) AS BIGINT) AS n FROM b JOIN pg USING (document_id) WHERE zone IS NOT NULL GROUP BY b.document_id, zone, slot, pages HAVING count(*) >= greatest(1, CAST(floor(pages * 0.001::DOUBLE) AS BIGINT)) AND max(length(trim(text))) <= 60")
def header_slots(spark, d):
    return layout.recurring_slots(_lines(spark, d), 0.001)


@query("WITH " + LINES + ", s AS (SELECT document_id, CASE WHEN length(text) < 40 THEN 16.0::DOUBLE ELSE 11.0::DOUBLE END AS size, page_number, line_no FROM ln), v AS (SELECT document_id, size, count(*) AS n, min(page_number * 100000 + line_no) AS first_at FROM s GROUP BY 1, 2) SELECT document_id, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first_at) AS r FROM v) WHERE r = 1")
def body_text_size(spark, d):
    return layout.body_size(_lines(spark, d))


def _headings(spark, d):
    return layout.generic_headings(_lines(spark, d), bold_below=3.0)


HEAD = LINES + ", bd AS (SELECT document_id, CASE WHEN count(*) FILTER (WHERE length(text) < 40) > count(*) FILTER (WHERE length(text) >= 40) THEN 16 ELSE 11 END AS body FROM ln GROUP BY 1), hd AS (SELECT document_id, page_number, y0, trim(text) AS text FROM ln JOIN bd USING (document_id) WHERE y0 >= 50 AND y0 <= 750 AND length(text) < 40 AND body = 11 AND length(trim(text)) BETWEEN 3 AND 120)"


@query("WITH " + HEAD + " SELECT document_id, page_number, y0, text FROM hd")
def headings(spark, d):
    return _headings(spark, d).select("document_id", "page_number", "y0", "text")


@query("WITH " + HEAD + """, l AS (SELECT document_id, page_number, arg_max(text, y0) AS text FROM hd GROUP BY 1, 2), p AS (SELECT DISTINCT document_id, page_number FROM ln),
c AS (SELECT p.*, l.text, last_value(l.text IGNORE NULLS) OVER (PARTITION BY p.document_id ORDER BY p.page_number) AS section FROM p LEFT JOIN l USING (document_id, page_number))
SELECT document_id, page_number, section, coalesce(section, '(no section detected)') AS section_path, CASE WHEN text IS NOT NULL THEN 'detected' ELSE 'inherited' END AS confidence FROM c""")
def page_sections(spark, d):
    lines = _lines(spark, d)
    return layout.assign_sections(lines.select("document_id", "page_number"), _headings(spark, d)).select("document_id", "page_number", "section", "section_path", "confidence")


@query("WITH " + LINES + ", m AS (SELECT document_id, page_number, line_no, length(text) >= 5 AND (length(regexp_replace(trim(text), '[^.]', '', 'g')) / greatest(length(trim(text)), 1) > 0.8 OR length(regexp_replace(trim(text), '[^_-]', '', 'g')) / greatest(length(trim(text)), 1) > 0.8) AS rule, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM ln) SELECT document_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(rule::INT) AS BIGINT) AS rules, CAST(sum(CASE WHEN regexp_matches(t, '^[ivxlcdm]+$|^[0-9]{1,4}$') THEN 1 ELSE 0 END) AS BIGINT) AS page_numbers FROM m GROUP BY 1")
def line_kinds(spark, d):
    return _lines(spark, d).groupBy("document_id").agg(F.count("*").alias("lines"), F.count_if(X.is_worksheet_rule(F.col("text"))).alias("rules"), F.count_if(X.is_page_number(F.col("text"))).alias("page_numbers"))


def _nested(text: str, *tables: dict[str, str]) -> str:
    for table in tables:
        for a, b in table.items():
            text = "replace(" + text + ", '" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')"
    return text


#: SQL of a cleaned line. DuckDB has no NFKC: the tables hold no character for which NFC isn't the same.
CLEANED = "trim(regexp_replace(nfc_normalize(regexp_replace(" + _nested("{0}", K.LIGATURES, K.QUOTES, K.DASHES) + r", '[\x{{80}}-\x{{9f}}]', '', 'g')), '[ \t]+', ' ', 'g'))"


@query("WITH " + LINES + ", typeset AS (SELECT *, translate(replace(text, 'fi', 'ﬁ'), '''-', '’–') AS t FROM ln) SELECT document_id, page_number, CAST(line_no AS BIGINT) AS line_no, " + CLEANED.format("t") + " AS text FROM typeset")
def cleaned_lines(spark, d):
    typeset = F.translate(F.replace("text", F.lit("fi"), F.lit("ﬁ")), "'-", "’–")
    return _lines(spark, d).select("document_id", "page_number", F.col("line_no").cast("long").alias("line_no"), X.clean_line(typeset).alias("text"))


#: SQL of words joined over breaks, from hyphenated(document_id, page_number, n from 1, line).
JOINED = r"""g AS (SELECT document_id, page_number, n, CAST([] AS VARCHAR[]) AS done, line AS held FROM hyphenated WHERE n = 1 UNION ALL
 SELECT document_id, page_number, n, CASE WHEN held IS NULL THEN done WHEN joins THEN list_append(done, regexp_replace(held, '-[^-]*$', '') || regexp_extract(line, '^([a-z]+)', 1)) ELSE list_append(done, held) END,
  CASE WHEN joins THEN nullif(ltrim(regexp_replace(line, '^[a-z]+', '')), '') ELSE line END FROM
 (SELECT s.*, done, held, coalesce(regexp_matches(held, '\w-\s*$') AND regexp_matches(line, '^[a-z]'), false) AS joins FROM g JOIN hyphenated s ON s.document_id = g.document_id AND s.page_number = g.page_number AND s.n = g.n + 1)),
joined AS (SELECT document_id, page_number, CASE WHEN held IS NULL THEN done ELSE list_append(done, held) END AS lines FROM g QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY n DESC) = 1)"""


@query("WITH RECURSIVE " + LINES + ", hyphenated AS (SELECT document_id, page_number, line_no + 1 AS n, text || CASE WHEN line_no % 3 = 0 THEN '-' ELSE '' END AS line FROM ln), " + JOINED + " SELECT * FROM joined")
def dehyphenated_pages(spark, d):
    pages = _lines(spark, d).groupBy("document_id", "page_number").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: F.concat(x["text"], F.when(x["line_no"] % 3 == 0, "-").otherwise(""))).alias("lines"))
    return pages.select("document_id", "page_number", layout.dehyphenate(F.col("lines")).alias("lines"))


@query("WITH " + LINES + ", t AS (SELECT document_id, page_number, 40.0::DOUBLE + 12 AS a, 40.0::DOUBLE + 36 AS b FROM (SELECT DISTINCT document_id, page_number FROM ln) WHERE page_number % 5 = 0) SELECT document_id, page_number, line_no FROM ln l WHERE NOT EXISTS (SELECT 1 FROM ln m JOIN t USING (document_id, page_number) WHERE m.document_id = l.document_id AND m.page_number = l.page_number AND m.text = l.text AND abs(m.y0 - l.y0) < 0.5 AND m.y0 >= a - 2 AND m.y0 + 10 <= b + 2)")
def lines_outside_tables(spark, d):
    lines = _lines(spark, d).withColumns({"x1": F.lit(500.0), "y1": F.col("y0") + 10})
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(52.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(76.0).alias("y1"))
    grids = lines.select("document_id", "page_number").distinct().where("page_number % 5 = 0").withColumn("bbox", box)
    return layout.outside_tables(lines, grids).select("document_id", "page_number", F.col("line_no").cast("long").alias("line_no"))


@query()
def section_chunks(spark, d):
    docs = _t(spark, d, "documents")
    known = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("organization"), F.lit("2024").alias("publication_year"), F.lit("TBD").alias("source_url"), F.lit("none").alias("license"), F.array("lang").alias("domains"), F.lit(True).alias("has_evidence_grades"))
    return chunking.chunk_documents(chunking.text_blocks(docs), known, "S1")


@query()
def recursive_chunks(spark, d):
    return chunking.split_units(chunking.units(chunking.text_blocks(_t(spark, d, "documents"))), "recursive", 140, 0.15).select("document_id", "unit_no", "piece_no", "text")


@query()
def fixed_chunks(spark, d):
    return chunking.split_units(chunking.units(chunking.text_blocks(_t(spark, d, "documents")), sections=False), "fixed_size", 140, 0.15).select("document_id", "unit_no", "piece_no", "text")


@query("WITH RECURSIVE " + VEC + """, c AS (SELECT query_id, CAST(rank AS BIGINT) AS rank, vr.vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM vr JOIN embeddings USING (vec_id) WHERE rank <= 25),
g AS (SELECT query_id, rank, vec_id, true AS stays, [e] AS kept FROM c WHERE rank = 1 UNION ALL
 SELECT query_id, rank, vec_id, NOT near, CASE WHEN near THEN kept ELSE list_append(kept, e) END FROM
 (SELECT c.*, g.kept, len(list_filter(g.kept, lambda y: list_dot_product(y, c.e) > 0.3)) > 0 AS near FROM g JOIN c ON c.query_id = g.query_id AND c.rank = g.rank + 1))
SELECT query_id, vec_id, rank FROM g WHERE stays""")
def near_copies_dropped(spark, d):
    ranked = _near(spark, d).join(_t(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return fusion.drop_near_copies(ranked, "vec_id", 0.3).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("WITH " + BM25 + r""", ws AS (SELECT query_id, chunk_id, rank AS pre_rank, list_distinct(list_filter(string_split_regex(lower(b.text), '\s+'), lambda x: x <> '')) AS q, list_distinct(list_filter(string_split_regex(lower(d.text), '\s+'), lambda x: x <> '')) AS t FROM bm JOIN documents d ON d.doc_id = bm.chunk_id JOIN benchmark b ON b.item_id = bm.query_id),
z AS (SELECT query_id, chunk_id, pre_rank, len(list_intersect(q, t)) / greatest(1, len(q))::DOUBLE AS score FROM ws), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pre_rank) AS rank FROM z)
SELECT query_id, chunk_id, CAST(pre_rank AS INT) AS pre_rank, CAST(rank AS INT) AS rank, score, true AS rerank_used, CAST(NULL AS VARCHAR) AS fallback_reason FROM r WHERE rank <= 5""")
def reranked(spark, d):
    found = lexical.search(_chunks(spark, d), _asked(spark, d)).join(_chunks(spark, d), "chunk_id").join(_asked(spark, d), "query_id")
    return rerank.rerank(found.select("query_id", "query", "rank", "chunk_id", "text"), seconds=3600.0)


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6::DOUBLE AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT key, event_id, "at", n, true AS accepted, CAST(NULL AS INT) AS retry_after, ["at"] AS held FROM e WHERE n = 1 UNION ALL
 SELECT key, event_id, "at", n, len(h) < 2, CASE WHEN len(h) >= 2 THEN greatest(1, CAST(trunc(h[1] + 86400 - "at") AS INT) + 1) END, CASE WHEN len(h) < 2 THEN list_append(h, "at") ELSE h END FROM
 (SELECT e.*, list_filter(g.held, lambda t: t >= e."at" - 86400) AS h FROM g JOIN e ON e.key = g.key AND e.n = g.n + 1))
SELECT key, event_id, "at", accepted, retry_after FROM g""")
def rate_limited(spark, d):
    events = _t(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").__truediv__(1e6).alias("at"))
    return limiter.limit_batch(events, 2, 86400.0)


@query(SQL["rate_limited"])
def rate_limited_stream(spark, d):
    events = _t(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").__truediv__(1e6).alias("at"))
    return limiter.replay(spark, events, 2, 86400.0, shared_folder(spark, "limiter"))


@query("SELECT s_suppkey, CASE WHEN n_name IS NOT NULL THEN n_name ELSE 'old' END AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def restamped(spark, d):
    chunks = _t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("document_id"), F.lit("old").alias("label"), F.lit("same").alias("title"))
    known = _t(spark, d, "nation").select(F.col("n_nationkey").alias("document_id"), F.col("n_name").alias("label"), F.lit("same").alias("title"))
    return src.restamp(chunks, known, ["label"], ["title"]).select("s_suppkey", "label")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def orphan_orders(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return contracts.orphans(orders, _t(spark, d, "customer"), "c_custkey", "c_custkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_line_keys(spark, d):
    return contracts.repeated_keys(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^https://')")
def insecure_urls(spark, d):
    return contracts.bad_urls(_t(spark, d, "pages").withColumn("source_url", F.regexp_replace("url", "^http://", "ftp://"))).select("page_id")


@query("SELECT item_id, CASE WHEN item_id <= 5 THEN [CAST(i AS INT) FOR i IN range(0, greatest(item_id, 0))] ELSE list_sort([CAST(floor(i * item_id / 5) AS INT) FOR i IN range(0, 5)]) END AS sample FROM benchmark")
def page_samples(spark, d):
    return _t(spark, d, "benchmark").select("item_id", src.page_sample(F.col("item_id"), 5).alias("sample"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def content_digests(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{v}'" for w, v in K.SEVERITIES.items()) + " ELSE 'unknown' END AS severity FROM conversations")
def severity_levels(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", X.severity(F.col("text")).alias("severity"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.70 THEN 'strong' WHEN l_discount * 10 >= 0.45 THEN 'moderate' ELSE 'weak' END AS band FROM lineitem")
def confidence_bands(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.confidence_band(F.col("l_discount") * 10).alias("band"))


@query("SELECT doc_id, coalesce(nullif(trim(split_part(f, ',', 1)), ''), source, 'unknown') AS client FROM (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN ' ' || lang || ' , proxy' WHEN 1 THEN ' ,proxy' END AS f FROM documents)")
def client_keys(spark, d):
    forwarded = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "lang", F.lit(" , proxy"))).when(F.col("doc_id") % 3 == 1, " ,proxy")
    return _t(spark, d, "documents").select("doc_id", X.client_key(forwarded, F.col("source")).alias("client"))


@query("""SELECT r_regionkey, '| key | name |\n| --- | --- |\n' || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', '\n' ORDER BY n_nationkey) AS markdown,
(2 + count(*) + count(n_name)) / (2 + 2 * count(*))::DOUBLE AS filled FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""".replace("'\\n'", "chr(10)"))
def region_tables(spark, d):
    row = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]))
    tables = _t(spark, d, "region").join(_t(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(cells.alias("cells"))
    return tables.select("r_regionkey", X.table_markdown(F.col("cells")).alias("markdown"), X.filled_share(F.col("cells")).alias("filled"))


@query("WITH l AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x{0400}-\\x{04FF}]')) AS ru, len(regexp_extract_all(text, '\\p{L}')) AS n FROM documents) SELECT doc_id, CASE WHEN ru > 0 AND ru >= n * 0.5 THEN 'Russian' END AS language FROM l")
def script_languages(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.script_language(F.col("text")).alias("language"))
