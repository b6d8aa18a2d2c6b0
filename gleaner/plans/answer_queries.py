"""Queries over search and answers, and SQL for them: hybrid and multi-query search, shown evidence, risk, actions, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import completion, contracts, evaluate, fusion, lexical, rerank, respond, rules
from ..operators import evidence as ev
from .answer import answer_batch, read_run
from .queries import FUSED, METRICS, PACK, _any, _asked, _chunks, _newest, _pack, _rule_sql, _scores, _second, _t, _talk, query
from .session import once, shared_folder

BEST = "row_number() OVER (PARTITION BY {0} ORDER BY round({1}, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id)"


def _payload(spark, d):
    """What the dense side knows of a chunk; no vectors, so no near copies."""
    return _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.array("lang").alias("domains"), X.content_hash(F.col("text")).alias("content_hash"), F.lit(None).cast("array<double>").alias("embedding"))


def _predicted(spark, d):
    return _asked(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>")).alias("predicted"))


#: SQL of fused hits with the payload of dense hits, where the even questions have a domain.
PAID = """, pay AS (SELECT f.*, rrf + CASE WHEN f.dense_rank IS NOT NULL AND d.lang = 'en' AND f.query_id % 2 = 0 THEN 0.02 ELSE 0 END AS s, CASE WHEN f.dense_rank IS NOT NULL AND f.query_id % 2 = 0 THEN sha256(d.text) END AS h FROM {0} f JOIN documents d ON d.doc_id = f.chunk_id)"""


@query("WITH " + FUSED + PAID.format("fu") + f""", o AS (SELECT *, {BEST.format('query_id', 's')} AS r FROM pay),
k AS (SELECT * FROM o QUALIFY h IS NULL OR row_number() OVER (PARTITION BY query_id, h ORDER BY r) = 1)
SELECT query_id, chunk_id, round(s, 9) AS boosted_score, CAST({BEST.format('query_id', 's')} AS BIGINT) AS rank FROM k QUALIFY rank <= 10""")
def hybrid_top10(spark, d):
    found = fusion.hybrid_search(once(_second(spark, d), "second"), lexical.search(_chunks(spark, d), _asked(spark, d)), _payload(spark, d), _predicted(spark, d))
    return found.select("query_id", "chunk_id", F.round("boosted_score", 9).alias("boosted_score"), F.col("rank").cast("long").alias("rank"))


#: Every third question has one variant; the others have a second one, that finds by position only.
VARIANTS = FUSED + """, vf AS (SELECT 0 AS variant, * FROM fu UNION ALL SELECT 1, query_id, chunk_id, orank, NULL, 1.0::DOUBLE / (60 + orank) FROM other WHERE query_id % 3 <> 0)""" + PAID.format("vf") + f""",
one AS (SELECT *, {BEST.format('query_id', 's')} AS r FROM pay WHERE query_id % 3 = 0), one2 AS (SELECT * FROM one QUALIFY h IS NULL OR row_number() OVER (PARTITION BY query_id, h ORDER BY r) = 1),
o AS (SELECT *, {BEST.format('query_id, variant', 's')} AS r FROM pay WHERE query_id % 3 <> 0 QUALIFY r <= 25),
m AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS s, arg_max(struct_pack(dr := dense_rank, br := bm25_rank, h := h), struct_pack(s := s, v := -variant)) AS best FROM o GROUP BY 1, 2),
m2 AS (SELECT query_id, chunk_id, s, best.dr AS dense_rank, best.br AS bm25_rank, best.h AS h FROM m), m3 AS (SELECT *, {BEST.format('query_id', 's')} AS r FROM m2),
m4 AS (SELECT * FROM m3 QUALIFY h IS NULL OR row_number() OVER (PARTITION BY query_id, h ORDER BY r) = 1)
SELECT query_id, chunk_id, round(s, 9) AS boosted_score, CAST(rank AS BIGINT) AS rank FROM (SELECT query_id, chunk_id, s, {BEST.format('query_id', 's')} AS rank FROM one2 UNION ALL SELECT query_id, chunk_id, s, {BEST.format('query_id', 's')} FROM m4) WHERE rank <= 10"""


@query("WITH " + VARIANTS)
def multi_query_top10(spark, d):
    asked = _asked(spark, d).select("query_id", F.explode(F.when(F.col("query_id") % 3 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("variant"))
    second = once(_second(spark, d), "second")
    dense = second.withColumn("variant", F.lit(0)).unionByName(second.where("query_id % 3 != 0").withColumn("variant", F.lit(1)))
    found = once(lexical.search(_chunks(spark, d), _asked(spark, d)), "found").withColumn("variant", F.lit(0))
    top = fusion.multi_query_search(asked, dense, found, _payload(spark, d), _predicted(spark, d))
    return top.select("query_id", "chunk_id", F.round("boosted_score", 9).alias("boosted_score"), F.col("rank").cast("long").alias("rank"))


#: SQL of a ranking {0}(query_id, chunk_id, r) by the words it shares with its question, five deep.
BY_WORDS = r"(SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q, t)) DESC, r) AS rank FROM (SELECT x.*, list_distinct(list_filter(string_split_regex(lower(b.text), '\s+'), lambda x: x <> '')) AS q, list_distinct(list_filter(string_split_regex(lower(d.text), '\s+'), lambda x: x <> '')) AS t FROM {0} x JOIN documents d ON d.doc_id = x.chunk_id JOIN benchmark b ON b.item_id = x.query_id) QUALIFY rank <= 5)"


@query("WITH " + VARIANTS[: VARIANTS.index("\nSELECT query_id, chunk_id, round(s, 9)")] + f""", merged AS (SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, {BEST.format('query_id', 's')} AS rank FROM one2 UNION ALL SELECT query_id, chunk_id, {BEST.format('query_id', 's')} FROM m4)),
top AS (SELECT query_id, chunk_id, rank AS r FROM rk WHERE rank <= 25), wide AS (SELECT query_id, chunk_id, rank AS r FROM merged WHERE rank <= 25),
ua AS (SELECT '1 dense' AS stage, query_id, chunk_id, orank AS rank FROM other UNION ALL SELECT '2 fused', query_id, chunk_id, rank FROM rk UNION ALL SELECT '3 reranked', * FROM {BY_WORDS.format('top')} UNION ALL SELECT '4 rewritten', * FROM {BY_WORDS.format('wide')}),
rl AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), z AS (SELECT item_id AS query_id, (SELECT count(*) FROM rl WHERE rl.query_id = item_id) AS n FROM benchmark),
mm AS (SELECT st.stage, z.query_id, count(rl.chunk_id) AS found, count(u.chunk_id) AS seen, max(n) AS n FROM z CROSS JOIN (SELECT DISTINCT stage FROM ua) st LEFT JOIN ua u ON u.query_id = z.query_id AND u.stage = st.stage AND rank <= 5 LEFT JOIN rl ON rl.query_id = u.query_id AND rl.chunk_id = u.chunk_id GROUP BY 1, 2)
SELECT stage, CAST(count(*) AS BIGINT) AS queries, round(avg(found / greatest(n, 1)::DOUBLE), 6) AS recall, round(avg(CASE WHEN seen > 0 THEN found / seen::DOUBLE ELSE 0 END), 6) AS precision FROM mm GROUP BY stage""")
def ablation_stages(spark, d):
    """Dense alone, fused, reranked, and with a rewritten question: every question counts, also one without a relevant chunk."""
    relevant = once(lexical.holding(_chunks(spark, d), _asked(spark, d)), "relevant")
    second, found = once(_newest(relevant), "second"), once(lexical.search(_chunks(spark, d), _asked(spark, d)), "found")
    fused = fusion.rank(fusion.fuse(second, found), score="rrf_score")
    asked = _asked(spark, d).select("query_id", F.explode(F.when(F.col("query_id") % 3 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("variant"))
    dense = second.withColumn("variant", F.lit(0)).unionByName(second.where("query_id % 3 != 0").withColumn("variant", F.lit(1)))
    wide = once(fusion.multi_query_search(asked, dense, found.withColumn("variant", F.lit(0)), _payload(spark, d), _predicted(spark, d), k=25), "wide")
    texts = lambda run: run.where("rank <= 25").select("query_id", "rank", "chunk_id").join(_chunks(spark, d), "chunk_id").join(_asked(spark, d), "query_id")
    best = lambda run: rerank.rerank(texts(run), seconds=3600.0)
    stages = {"1 dense": second, "2 fused": fused, "3 reranked": best(fused), "4 rewritten": best(wide)}
    sizes = _asked(spark, d).select("query_id").join(relevant.groupBy("query_id").agg(F.count("*").alias("n_rel")), "query_id", "left")
    shown = evaluate.ablation(stages, relevant, sizes, [5])
    return shown.select("stage", "queries", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


#: Four statements of each question, and a quote of the second, then the first piece.
SAID = PACK + """, s AS (SELECT item_id AS query_id, k AS statement_no, CASE k WHEN 1 THEN ['E1'] WHEN 2 THEN ['E1', 'E9'] WHEN 3 THEN [] ELSE ['E2', 'E1'] END AS ids FROM benchmark, (SELECT unnest([1, 2, 3, 4]) AS k)),
kn AS (SELECT query_id, list('E' || rank) AS known FROM p GROUP BY 1), o AS (SELECT s.*, len(ids) > 0 AND list_has_all(coalesce(known, []), ids) AS valid FROM s LEFT JOIN kn USING (query_id)),
ci AS (SELECT DISTINCT query_id, statement_no, unnest(ids) AS evidence_id FROM o WHERE valid), pi AS (SELECT *, 'E' || rank AS evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS idx FROM p),
ex AS (SELECT x.query_id, x.evidence_id, quote, no FROM (SELECT item_id AS query_id, 'E' || (3 - k) AS evidence_id, k AS no, CASE WHEN (item_id + k) % 3 = 0 THEN upper(text) ELSE text END AS quote FROM benchmark, (SELECT unnest([1, 2]) AS k)) x JOIN pi ON pi.query_id = x.query_id AND pi.evidence_id = x.evidence_id AND contains(pi.text, quote))"""


def _said(spark, d, pack):
    none = F.array().cast("array<string>")
    ids = F.array(F.array(F.lit("E1")), F.array(F.lit("E1"), F.lit("E9")), none, F.array(F.lit("E2"), F.lit("E1")))
    said = _asked(spark, d).select("query_id", F.posexplode(ids).alias("at", "evidence_ids")).select("query_id", (F.col("at") + 1).alias("statement_no"), F.lit("x").alias("text"), "evidence_ids")
    return ev.resolve_statements(said, pack)


def _quotes(spark, d):
    rows = _asked(spark, d).withColumn("excerpt_no", F.explode(F.array(F.lit(1), F.lit(2))))
    quote = F.when((F.col("query_id") + F.col("excerpt_no")) % 3 == 0, F.upper("query")).otherwise(F.col("query"))
    return rows.select("query_id", "excerpt_no", F.concat(F.lit("E"), (3 - F.col("excerpt_no")).cast("string")).alias("evidence_id"), quote.alias("quote"))


@query("WITH " + SAID + " SELECT pi.query_id, pi.idx AS index, pi.evidence_id, pi.chunk_id, e.excerpt, EXISTS (SELECT 1 FROM ci JOIN pi c ON c.query_id = ci.query_id AND c.evidence_id = ci.evidence_id WHERE c.query_id = pi.query_id AND c.chunk_id = pi.chunk_id) AS selected FROM pi LEFT JOIN (SELECT query_id, evidence_id, arg_min(quote, no) AS excerpt FROM ex GROUP BY 1, 2) e USING (query_id, evidence_id)")
def evidence_shown(spark, d):
    pack = _pack(spark, d)
    shown = respond.shown_evidence(pack, _said(spark, d, pack), ev.resolve_excerpts(_quotes(spark, d), pack))
    return shown.withColumn("index", F.col("index").cast("long"))


@query("WITH " + SAID + " SELECT query_id, CAST(statement_no AS INT) AS statement_no, row_number() OVER (PARTITION BY query_id ORDER BY statement_no) AS statement_id, citations FROM (SELECT ci.query_id, statement_no, list_sort(list(DISTINCT idx)) AS citations FROM ci JOIN pi USING (query_id, evidence_id) GROUP BY 1, 2)")
def statement_citations(spark, d):
    pack = _pack(spark, d)
    found = respond.statement_indexes(_said(spark, d, pack), pack)
    return found.select("query_id", "statement_no", F.col("statement_id").cast("long").alias("statement_id"), F.col("citations").cast("array<long>").alias("citations"))


@query("WITH " + SAID + " SELECT x.query_id, x.evidence_id, d.doc_id AS chunk_id, d.lang, d.source FROM (SELECT DISTINCT query_id, unnest(ids) AS evidence_id FROM s) x LEFT JOIN pi USING (query_id, evidence_id) LEFT JOIN documents d ON d.doc_id = pi.chunk_id")
def cited_sources(spark, d):
    pack = _pack(spark, d)
    cited = _said(spark, d, pack).select("query_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    store = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source", F.lit(True).alias("__known"))
    found = respond.cited_metadata(cited, pack, store)
    return found.select("query_id", "evidence_id", F.when(F.col("__known"), F.col("chunk_id")).alias("chunk_id"), "lang", "source")


@query("WITH " + SAID + " SELECT coalesce(reason, 'none') AS reason, CAST(count(*) AS BIGINT) AS dropped FROM (SELECT CASE WHEN len(ids) = 0 THEN 'no citation' ELSE 'unresolved citation' END AS reason FROM o WHERE NOT valid) GROUP BY 1")
def drop_histogram(spark, d):
    return respond.drop_reasons(_said(spark, d, _pack(spark, d)))


@query("WITH " + SAID + r""", x AS (SELECT item_id AS query_id, 'E' || (3 - k) AS evidence_id, k AS no, '  ' || replace(CASE WHEN (item_id + k) % 3 = 0 THEN upper(text) ELSE text END, ' ', '  ') AS quote FROM benchmark, (SELECT unnest([1, 2]) AS k)), sq AS (SELECT query_id, evidence_id, trim(regexp_replace(text, '[\s\x0b\x0c\x1c-\x1f\x85\xa0]+', ' ', 'g')) AS t FROM pi)
SELECT x.query_id, x.evidence_id, CAST(no AS INT) AS excerpt_no, coalesce(contains(t, trim(regexp_replace(quote, '[\s\x0b\x0c\x1c-\x1f\x85\xa0]+', ' ', 'g'))), false) AS verbatim FROM x LEFT JOIN sq USING (query_id, evidence_id)""")
def loose_excerpts(spark, d):
    spaced = _quotes(spark, d).withColumn("quote", F.concat(F.lit("  "), F.replace("quote", F.lit(" "), F.lit("  "))))
    return respond.loose_quotes(spaced, _pack(spark, d)).select("query_id", "evidence_id", "excerpt_no", "verbatim")


@query("WITH " + PACK + ", kn AS (SELECT query_id, list('E' || rank) AS known FROM p GROUP BY 1), x AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN ['E1', 'E1'] WHEN 1 THEN ['E1', 'E9'] ELSE ['E1', 'E2'] END AS ids FROM benchmark) SELECT query_id, ids AS evidence_ids FROM x LEFT JOIN kn USING (query_id) WHERE len(list_filter(ids, lambda i: list_contains(coalesce(known, []), i))) >= 2")
def stated_conflicts(spark, d):
    i, e = F.col("query_id"), lambda *names: F.array(*map(F.lit, names))
    said = _asked(spark, d).select("query_id", F.lit("differ").alias("description"), F.when(i % 3 == 0, e("E1", "E1")).when(i % 3 == 1, e("E1", "E9")).otherwise(e("E1", "E2")).alias("evidence_ids"))
    return ev.resolve_conflicts(said, _pack(spark, d)).select("query_id", "evidence_ids")


@query("WITH " + PACK + " SELECT query_id, string_agg('[E' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS block FROM p GROUP BY query_id")
def prompt_blocks(spark, d):
    return ev.prompt_block(_pack(spark, d))


@query("WITH " + PACK + " SELECT query_id, round(CASE WHEN query_id % 2 = 0 THEN query_id / 7.0::DOUBLE ELSE max(1.0::DOUBLE / (60 + rank)) END, 9) AS score FROM p GROUP BY query_id")
def gate_signals(spark, d):
    pack = _pack(spark, d).withColumn("rerank_score", F.when(F.col("query_id") % 2 == 0, F.col("query_id") / 7.0))
    return evaluate.gate_scores(ev.pack_summary(pack)).select("query_id", F.round("score", 9).alias("score"))


@query(_rule_sql() + f""", f AS (SELECT conv_id, turn, max(floor_rank) AS fl, list(rule_id ORDER BY rule_id) AS rules FROM r GROUP BY 1, 2),
z AS (SELECT n.conv_id, n.turn, coalesce(fl, 0) AS fl, coalesce(rules, []) AS rules, {_any(K.SEVERITY_TERMS)} AS sv, {_any(K.ACUTE_TERMS)} AS ac, {_any(K.VULNERABLE_TERMS)} AS vu FROM n LEFT JOIN f USING (conv_id, turn)),
y AS (SELECT *, greatest(CASE WHEN sv THEN 2 WHEN ac OR vu THEN 1 ELSE 0 END, fl) AS u, [CAST(i AS BIGINT) FOR i IN [1, 2, 3] IF (conv_id + i) % 3 = 0] AS ids FROM z),
x AS (SELECT *, round_even(0.55::DOUBLE + 3 * 0.02::DOUBLE + CASE WHEN len(rules) > 0 THEN 0.10::DOUBLE ELSE 0 END, 2) AS c FROM y)
SELECT conv_id * 1000 + turn AS query_id, list_extract(['LOW', 'MODERATE', 'HIGH', 'CRITICAL'], CAST(u AS INT) + 1) AS level, CASE WHEN c >= 0.70 THEN 'strong' WHEN c >= 0.45 THEN 'moderate' ELSE 'weak' END AS band, c AS confidence, rules, ids AS evidence_ids FROM x WHERE len(ids) > 0""")
def risk_reports(spark, d):
    rows = rules.match_rules(_talk(spark, d).withColumn("plain", F.lower(X.squeeze(F.col("text")))), "plain")
    rows = rows.withColumns({"query_id": F.col("conv_id") * 1000 + F.col("turn"), "domains": F.array().cast("array<string>"), "sufficiency": F.lit("PARTIAL"), "support_count": F.lit(3)})
    shown = rows.select("query_id", "conv_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("index")).withColumn("selected", (F.col("conv_id") + F.col("index")) % 3 == 0)
    found = respond.risk_blocks(rules.assess_risk(rows, "plain"), shown)
    return found.select("query_id", "level", "band", "confidence", F.array_sort("rules").alias("rules"), F.col("evidence_ids").cast("array<long>").alias("evidence_ids"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STEPS = "x AS (SELECT conv_id, turn, list_extract(['LOW', 'MODERATE', 'HIGH', 'CRITICAL'], CAST(conv_id % 4 + 1 AS INT)) AS u, turn % 2 = 0 AS follow FROM conversations), y AS (SELECT *, CASE u WHEN 'CRITICAL' THEN " + _text(K.EMERGENCY["critical_lead"] + " " + K.EMERGENCY["instruction"]) + " WHEN 'HIGH' THEN " + _text(K.EMERGENCY["high_lead"] + " " + K.EMERGENCY["instruction"]) + " END AS help FROM x)"


@query("WITH " + STEPS + f" SELECT conv_id, turn, coalesce(help, CASE WHEN u = 'LOW' THEN {_text(K.ACTION_LOW)} || CASE WHEN follow THEN {_text(K.ACTION_LIMITED)} ELSE '' END ELSE {_text(K.ACTION_ASSESS)} END) AS message, coalesce(help || chr(10) || chr(10), '') || 'refused' AS refusal, u = 'CRITICAL' AS call_emergency, u IN ('CRITICAL', 'HIGH') AS find_facility, u NOT IN ('CRITICAL', 'HIGH') AS wellness FROM y")
def action_messages(spark, d):
    rows = _t(spark, d, "conversations").withColumn("u", rules.urgency_name((F.col("conv_id") % 4).cast("int")))
    shown = respond.shown_controls(rules.decide_actions(F.col("u"), F.lit("SUFFICIENT"), F.lit(3), F.lit(False)))
    return rows.withColumn("c", shown).select("conv_id", "turn", respond.action_message(F.col("u"), F.col("turn") % 2 == 0).alias("message"), respond.escalated(F.lit("refused"), F.col("u")).alias("refusal"), "c.call_emergency", "c.find_facility", "c.wellness")


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND turn % 3 <> 0 THEN ['This assessment is based on limited supporting evidence (' || turn || CASE WHEN turn = 1 THEN ' source' ELSE ' sources' END || ' found).'] WHEN turn % 3 = 0 THEN ['own'] ELSE [] END AS limitations FROM conversations")
def limitations_stated(spark, d):
    own = F.when(F.col("turn") % 3 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>"))
    state = F.when(F.col("conv_id") % 2 == 0, "PARTIAL").otherwise("SUFFICIENT")
    return _t(spark, d, "conversations").select("conv_id", "turn", respond.stated_limitations(state, own, F.col("turn")).alias("limitations"))


REASONS = ["PRESCRIPTION_REQUEST", "OUT_OF_SCOPE", "INSUFFICIENT_EVIDENCE", "NO_VALID_STATEMENTS", "DOSE_IN_ANSWER"]


@query("SELECT conv_id, turn, list_transform(['red_flag_check', 'prescribing_check', 'domain_predict', 'retrieval', 'rerank', 'sufficiency', 'generation', 'validation', 'dose_scan'][:CASE conv_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 8 ELSE 9 END], lambda s: s) || ['risk', 'decision'] AS stages FROM conversations")
def traces(spark, d):
    reason = F.get(F.array(*map(F.lit, REASONS)), (F.col("conv_id") % 6).cast("int"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.transform(respond.trace(reason), lambda s: s["stage"]).alias("stages"))


@query("""WITH t AS (SELECT conv_id AS query_id, turn AS position, role AS stage, (conv_id + turn * turn) % 4 AS g FROM conversations), w AS (SELECT *, coalesce(max(g) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > g AS behind, count(*) OVER (PARTITION BY query_id, stage ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS again FROM t) SELECT query_id, position, behind, again FROM w WHERE behind OR again""")
def trace_breaches(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.col("role").alias("stage"), ((F.col("conv_id") + F.col("turn") * F.col("turn")) % 4).alias("group_rank"))
    return contracts.stages_out_of_order(rows).select("query_id", "position", "behind", "again")


@query("SELECT item_id FROM benchmark WHERE item_id % 45 - 1 < 0 OR item_id % 45 + item_id % 4 - 2 < item_id % 45 - 1")
def page_range_breaches(spark, d):
    i = F.col("item_id")
    return contracts.page_ranges(_t(spark, d, "benchmark").select("item_id", (i % 45 - 1).alias("page_start"), (i % 45 + i % 4 - 2).alias("page_end"))).select("item_id")


@query("""WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN [1, 2] ELSE [1] END AS cited, CASE WHEN turn % 2 = 0 THEN [1, 2] WHEN turn % 3 = 0 THEN [] ELSE [1] END AS selected, CASE WHEN conv_id % 4 = 0 THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS st, turn % 4 AS lim, CASE WHEN conv_id % 5 = 0 THEN [2] ELSE [1] END AS risk, conv_id % 7 = 0 AS refused, conv_id % 11 = 0 AS nodomain FROM conversations)
SELECT conv_id, turn, broken FROM (SELECT *, CASE WHEN NOT list_has_all(selected, cited) THEN 'citations are selected' WHEN st = 'PARTIAL' AND lim = 0 THEN 'partial support names a limitation' WHEN NOT list_has_all(selected, risk) THEN 'risk cites selected evidence' WHEN refused AND len(selected) > 0 THEN 'a refusal selects nothing' WHEN NOT refused AND nodomain THEN 'success names its domain' END AS broken FROM a) WHERE broken IS NOT NULL""")
def answer_breaches(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    ids = lambda *n: F.array(*map(F.lit, n)).cast("array<int>")
    rows = _t(spark, d, "conversations").select(
        "conv_id", "turn", F.when(c % 3 == 0, ids(1, 2)).otherwise(ids(1)).alias("cited"), F.when(t % 2 == 0, ids(1, 2)).when(t % 3 == 0, ids()).otherwise(ids(1)).alias("selected"),
        F.when(c % 4 == 0, "PARTIAL").otherwise("SUFFICIENT").alias("sufficiency"), F.array_repeat(F.lit("x"), (t % 4).cast("int")).alias("limitations"), F.when(c % 5 == 0, ids(2)).otherwise(ids(1)).alias("risk_ids"),
        F.when(c % 7 == 0, "refused").otherwise("success").alias("status"), F.when(c % 11 != 0, "x").alias("supported_domain"),
    )
    return contracts.broken_answers(rows).select("conv_id", "turn", "broken")


@query("""WITH r AS (SELECT CASE WHEN conv_id % 20 = 0 THEN 'failed' ELSE 'done' END AS outcome, conv_id % 3 = 0 AS refused, CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN 'INSUFFICIENT' WHEN 2 THEN 'OUT_OF_SCOPE' WHEN 3 THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS st, turn, conv_id % 2 AS dropped FROM conversations)
SELECT CAST(count(*) AS BIGINT) AS runs, round(avg((outcome <> 'failed')::INT), 9) AS completion, avg((outcome <> 'failed')::INT) >= 0.95 AS complete_enough, CAST(count(*) FILTER (WHERE refused AND st IS NULL) AS BIGINT) AS refused_before_retrieval, CAST(count(*) FILTER (WHERE refused AND st IN ('INSUFFICIENT', 'OUT_OF_SCOPE')) AS BIGINT) AS refused_by_gate,
CAST(count(*) FILTER (WHERE refused AND st IN ('SUFFICIENT', 'PARTIAL')) AS BIGINT) AS refused_after_generation, CAST(sum(turn) AS BIGINT) AS statements, CAST(sum(dropped) AS BIGINT) AS dropped FROM r""")
def generation_report(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    state = F.get(F.array(F.lit(None), *map(F.lit, ["INSUFFICIENT", "OUT_OF_SCOPE", "PARTIAL", "SUFFICIENT"])), (t % 5).cast("int"))
    runs = _t(spark, d, "conversations").select(F.when(c % 20 == 0, "failed").otherwise("done").alias("outcome"), F.when(c % 3 == 0, "refused").otherwise("success").alias("status"), state.alias("sufficiency"), t.alias("statements"), (c % 2).alias("dropped"))
    return evaluate.generation_metrics(runs).withColumn("completion", F.round("completion", 9))


@query("WITH i AS (SELECT lang, avg(n_chars) - stddev_samp(n_chars) / 10 AS low, avg(n_chars) + stddev_samp(n_chars) / 10 AS high FROM documents GROUP BY 1) SELECT a.lang AS \"left\", b.lang AS \"right\", a.low <= b.high AND b.low <= a.high AS overlap FROM i a JOIN i b ON a.lang < b.lang")
def overlapping_configurations(spark, d):
    spread = F.stddev_samp("n_chars") / 10
    intervals = _t(spark, d, "documents").groupBy("lang").agg((F.avg("n_chars") - spread).alias("low"), (F.avg("n_chars") + spread).alias("high"))
    return evaluate.overlapping_intervals(intervals, "lang")


@query("WITH " + METRICS + " SELECT k, round(avg(recall), 6) AS mean FROM m GROUP BY k ORDER BY round(avg(recall), 12) DESC, k LIMIT 1")
def best_depth(spark, d):
    return evaluate.best_configuration(_scores(spark, d), "k", "recall").withColumn("mean", F.round("mean", 6))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) < 0.5 * len(regexp_extract_all(text, '\\p{L}')) AND doc_id % 4 <> 0 THEN 'variant ' || doc_id ELSE md5(text) END AS query FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') ELSE text END AS text FROM documents)")
def rerank_texts(spark, d):
    written = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")).otherwise(F.col("text"))
    variants = F.when(F.col("doc_id") % 4 != 0, F.array(F.concat(F.lit("variant "), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = _t(spark, d, "documents").select("doc_id", written.alias("text"), variants.alias("variants"))
    chosen = rerank.rerank_query(F.col("text"), F.col("variants"))
    return rows.select("doc_id", F.when(chosen == F.col("text"), F.md5(F.col("text").cast("binary"))).otherwise(chosen).alias("query"))


@query("WITH " + FUSED + " SELECT query_id, chunk_id, CAST(rank AS INT) AS pre_rank, CAST(rank AS INT) AS rank, CAST(NULL AS DOUBLE) AS score, false AS rerank_used, 'not loaded' AS fallback_reason FROM bm WHERE rank <= 5")
def passed_through(spark, d):
    found = lexical.search(_chunks(spark, d), _asked(spark, d))
    return rerank.rerank_or_pass(found.select("query_id", "rank", "chunk_id"), None, "not loaded")


@query("WITH t AS (SELECT user_id AS query_id, event_id % 3 AS variant, event_id AS chunk_id, value AS score FROM events), m AS (SELECT query_id, variant, max(score) AS top FROM t GROUP BY 1, 2), b AS (SELECT query_id, variant FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY top DESC, variant) = 1) SELECT t.query_id, t.variant, t.chunk_id FROM t JOIN b USING (query_id, variant)")
def best_variants(spark, d):
    runs = _t(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 3).alias("variant"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    return rerank.best_variant(runs).select("query_id", "variant", "chunk_id")


@query("SELECT conv_id, turn, CASE WHEN s = 'INSUFFICIENT' THEN 'INSUFFICIENT_EVIDENCE' WHEN s = 'OUT_OF_SCOPE' THEN s END AS reason FROM (SELECT *, list_extract(['SUFFICIENT', 'PARTIAL', 'INSUFFICIENT', 'OUT_OF_SCOPE'], CAST(turn % 4 + 1 AS INT)) AS s FROM conversations)")
def refusal_reasons(spark, d):
    state = F.element_at(F.array(*map(F.lit, ["SUFFICIENT", "PARTIAL", "INSUFFICIENT", "OUT_OF_SCOPE"])), (F.col("turn") % 4 + 1).cast("int"))
    return _t(spark, d, "conversations").select("conv_id", "turn", ev.refusal_reason(state).alias("reason"))


#: CRC-32 of a word, bit by bit, over its bytes.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(y) AS BIGINT) FOR y IN string_split({0}, '')]), lambda c, y: list_reduce(list_prepend(xor(c, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT)"
WORDS_OF = r"list_distinct(list_filter(string_split_regex(lower({0}), '[\s\x0b\x0c\x1c-\x1f\x85\xa0]+'), lambda x: x <> ''))"

#: SQL of the whole answer plan with its stand-ins, from questions a(conv_id, turn, text).
ANSWERS = _rule_sql().replace("lower(trim(regexp_replace(text, '\\\\s+', ' ', 'g')))", "lower(trim(regexp_replace(strip_accents(text), '\\\\s+', ' ', 'g')))").replace("WITH a AS", "WITH RECURSIVE a AS", 1) + ", " + f"""
qs AS (SELECT conv_id * 1000 + turn AS query_id, text AS query, list_filter([CASE WHEN regexp_matches(lower(text), 'chest|bleeding|speech') THEN 'emergency' END, CASE WHEN regexp_matches(lower(text), 'cough|mild') THEN 'primary-care' END], lambda x: x IS NOT NULL) AS domains,
 {" OR ".join(f"regexp_matches(text, '{p}')" for p in K.PRESCRIPTION_REQUESTS)} AS asks FROM a),
fl AS (SELECT conv_id * 1000 + turn AS query_id, max(floor_rank) AS fl, count(*) AS flags FROM r GROUP BY 1),
so AS (SELECT * FROM qs WHERE NOT asks),
tx AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents UNION ALL SELECT 'q', query_id, regexp_extract_all(lower(query), '[a-z0-9]+') FROM so),
po AS (SELECT side, id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT side, id, len(ws) AS dl, unnest(ws) AS term FROM tx) GROUP BY 1, 2, 3),
hh AS (SELECT term, {CRC.format("term")} AS h FROM (SELECT DISTINCT term FROM po)),
co AS (SELECT side, id, h % 64 AS dim, sum(tf * (1 - 2 * ((h // 65536) % 2)))::DOUBLE AS v FROM po JOIN hh USING (term) GROUP BY 1, 2, 3),
nm AS (SELECT side, id, sqrt(sum(v * v)) AS nm FROM co GROUP BY 1, 2),
un AS (SELECT side, id, dim, v / CASE WHEN nm > 0 THEN nm ELSE 1 END AS v FROM co JOIN nm USING (side, id)),
ds AS (SELECT q.query_id, d.doc_id AS chunk_id, coalesce(s, 0) AS s FROM so q CROSS JOIN documents d LEFT JOIN (SELECT x.id AS query_id, y.id AS chunk_id, sum(x.v * y.v) AS s FROM un x JOIN un y ON x.dim = y.dim AND x.side = 'q' AND y.side = 'd' GROUP BY 1, 2) p ON p.query_id = q.query_id AND p.chunk_id = d.doc_id),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS dense_rank FROM ds QUALIFY dense_rank <= 25),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM tx WHERE side = 'd'),
rw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM po, st WHERE side = 'd' GROUP BY term, n),
wt AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM rw) ELSE r END AS idf FROM rw),
sc AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.tf * idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * d.dl / avgdl))) AS score FROM po q JOIN po d ON q.term = d.term AND q.side = 'q' AND d.side = 'd' JOIN wt ON wt.term = d.term, st GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS bm25_rank FROM sc) WHERE bm25_rank <= 25 AND score > 0),
fu AS (SELECT coalesce(o.query_id, b.query_id) AS query_id, coalesce(o.chunk_id, b.chunk_id) AS chunk_id, dense_rank, bm25_rank, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS rrf FROM de o FULL OUTER JOIN bm b ON o.query_id = b.query_id AND o.chunk_id = b.chunk_id),
pay AS (SELECT f.*, rrf + CASE WHEN dense_rank IS NOT NULL AND list_contains(domains, 'emergency') THEN 0.02 ELSE 0 END AS s, CASE WHEN dense_rank IS NOT NULL AND len(domains) > 0 THEN sha256(d.text) END AS h FROM fu f JOIN documents d ON d.doc_id = f.chunk_id JOIN so USING (query_id)),
o1 AS (SELECT *, {BEST.format('query_id', 's')} AS r FROM pay),
o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS i FROM (SELECT * FROM o1 QUALIFY h IS NULL OR row_number() OVER (PARTITION BY query_id, h ORDER BY r) = 1)),
vv AS (SELECT id AS chunk_id, list(struct_pack(k := dim, v := v) ORDER BY dim) AS e FROM un WHERE side = 'd' GROUP BY 1),
o3 AS (SELECT o2.*, CASE WHEN dense_rank IS NOT NULL THEN map_from_entries([(x.k, x.v) FOR x IN e]) END AS e FROM o2 LEFT JOIN vv USING (chunk_id)),
gr AS (SELECT query_id, i, true AS stays, CASE WHEN e IS NOT NULL THEN [e] ELSE [] END AS kept FROM o3 WHERE i = 1 UNION ALL
 SELECT query_id, i, NOT near, CASE WHEN near OR e IS NULL THEN kept ELSE list_append(kept, e) END FROM
 (SELECT o3.query_id, o3.i, o3.e, g.kept, coalesce(len(list_filter(g.kept, lambda y: list_sum([coalesce(y[k], 0) * o3.e[k] FOR k IN map_keys(o3.e)]) > 0.95)) > 0, false) AS near FROM gr g JOIN o3 ON o3.query_id = g.query_id AND o3.i = g.i + 1)),
ra AS (SELECT query_id, chunk_id, rrf, {BEST.format('query_id', 's')} AS pre FROM o3 JOIN gr USING (query_id, i) WHERE stays QUALIFY pre <= 25),
wo AS (SELECT ra.*, {WORDS_OF.format("q.query")} AS q, {WORDS_OF.format("d.text")} AS t, d.text FROM ra JOIN so q USING (query_id) JOIN documents d ON d.doc_id = chunk_id),
re AS (SELECT query_id, chunk_id, rrf, text, len(list_intersect(q, t)) / greatest(1, len(q))::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q, t)) DESC, pre) AS rank FROM wo QUALIFY rank <= 5),
ga AS (SELECT so.*, coalesce(n, 0) AS support, CASE WHEN coalesce(top, 0) < 0.05 AND len(domains) = 0 THEN 'OUT_OF_SCOPE' WHEN coalesce(top, 0) < 0.05 THEN 'INSUFFICIENT' WHEN top >= 0.5 AND n >= 2 THEN 'SUFFICIENT' ELSE 'PARTIAL' END AS state, evidence
 FROM so LEFT JOIN (SELECT query_id, count(*) AS n, max(score) AS top, list(chunk_id ORDER BY rank) AS evidence FROM re GROUP BY 1) USING (query_id)),
sa AS (SELECT re.query_id, trim(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1]) AS said FROM re JOIN ga USING (query_id) WHERE rank <= 2 AND state IN ('SUFFICIENT', 'PARTIAL')),
cn AS (SELECT query_id, count(*) AS statements, sum({" + ".join(f"len(regexp_extract_all(said, '{p}'))" for p in K.DOSES.values())}) AS doses FROM sa WHERE length(said) > 0 GROUP BY 1),
ex AS (SELECT query_id, query, CAST([] AS VARCHAR[]) AS domains, 0 AS support, 'OUT_OF_SCOPE' AS state, CAST(NULL AS BIGINT[]) AS evidence, 0 AS statements, 'PRESCRIPTION_REQUEST' AS refusal FROM qs WHERE asks UNION ALL
 SELECT query_id, query, domains, support, state, evidence, coalesce(statements, 0), CASE state WHEN 'OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' WHEN 'INSUFFICIENT' THEN 'INSUFFICIENT_EVIDENCE' ELSE CASE WHEN statements IS NULL THEN 'NO_VALID_STATEMENTS' WHEN doses > 0 THEN 'DOSE_IN_ANSWER' END END FROM ga LEFT JOIN cn USING (query_id)),
ri AS (SELECT ex.*, coalesce(fl, 0) AS fl, coalesce(flags, 0) AS flags, CASE WHEN {_any(K.SEVERITY_TERMS).replace("contains(t,", "contains(lower(query),")} THEN 2 WHEN {_any(K.ACUTE_TERMS).replace("contains(t,", "contains(lower(query),")} OR {_any(K.VULNERABLE_TERMS).replace("contains(t,", "contains(lower(query),")} OR len(list_intersect(domains, {K.EMERGENCY_DOMAINS!r})) > 0 THEN 1 ELSE 0 END AS ar FROM ex LEFT JOIN fl USING (query_id))
SELECT query_id, CASE WHEN refusal IS NULL THEN 'success' ELSE 'refused' END AS status, refusal AS refusal_reason, state AS sufficiency, CAST(support AS BIGINT) AS support_count, CAST(statements AS BIGINT) AS statements, evidence,
 list_extract(['LOW', 'MODERATE', 'HIGH', 'CRITICAL'], CAST(greatest(ar, fl) AS INT) + 1) AS urgency, greatest(ar, fl) > ar AS floor_applied,
 round_even(least(0.95::DOUBLE, CASE state {" ".join(f"WHEN '{s}' THEN {v}::DOUBLE" for s, v in K.CONFIDENCE_BASE.items())} ELSE 0.30::DOUBLE END + least(support, 5) * 0.02::DOUBLE + CASE WHEN flags > 0 THEN 0.10::DOUBLE ELSE 0 END), 2) AS confidence,
 CASE greatest(ar, fl) WHEN 3 THEN 'emergency' WHEN 2 THEN 'urgent_care' WHEN 1 THEN 'evaluation' ELSE 'guidance' END AS action_type, CAST(NULL AS VARCHAR) AS fallback_reason FROM ri"""


def _answered(spark, d, scratch):
    asked = _talk(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    chunks = _chunks(spark, d).withColumn("domains", F.array(F.lit("emergency")))
    vocabulary = {"emergency": ["chest", "bleeding", "speech"], "primary-care": ["cough", "mild"]}
    return answer_batch(asked, chunks, vocabulary, scratch, seconds=3600.0)


@query(ANSWERS)
def answers(spark, d):
    found = _answered(spark, d, shared_folder(spark, "answers"))
    return found.select("query_id", "status", "refusal_reason", "sufficiency", "support_count", "statements", "evidence", "urgency", "floor_applied", "confidence", "action_type", "fallback_reason")


@query(ANSWERS[: ANSWERS.index("\nSELECT query_id, CASE WHEN refusal")] + """
SELECT stage, rows FROM (SELECT 'asked' AS stage, count(*) AS rows FROM qs UNION ALL SELECT 'store', count(*) FROM documents UNION ALL SELECT 'ranked', count(*) FROM ra UNION ALL SELECT 'packed', count(*) FROM re
UNION ALL SELECT 'gated', count(*) FROM ga UNION ALL SELECT 'said', count(*) FROM sa WHERE length(said) > 0)""")
def answer_log(spark, d):
    scratch = shared_folder(spark, "answers")
    _answered(spark, d, scratch)
    return read_run(spark, scratch).select("stage", "rows")


@query(ANSWERS[: ANSWERS.index("\nSELECT query_id, CASE WHEN refusal")] + """
SELECT CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE refusal = 'PRESCRIPTION_REQUEST') AS BIGINT) AS refused_before_retrieval, CAST(count(*) FILTER (WHERE refusal IN ('OUT_OF_SCOPE', 'INSUFFICIENT_EVIDENCE')) AS BIGINT) AS refused_by_gate,
CAST(count(*) FILTER (WHERE refusal IN ('NO_VALID_STATEMENTS', 'DOSE_IN_ANSWER')) AS BIGINT) AS refused_after_generation, CAST(sum(statements) AS BIGINT) AS statements FROM ex""")
def answer_report(spark, d):
    found = _answered(spark, d, shared_folder(spark, "answers")).withColumn("outcome", F.lit("done"))
    found = found.withColumn("sufficiency", F.when(F.col("refusal_reason") == "PRESCRIPTION_REQUEST", F.lit(None)).otherwise(F.col("sufficiency")))
    return evaluate.generation_metrics(found).select("runs", "refused_before_retrieval", "refused_by_gate", "refused_after_generation", "statements")


@query("WITH " + SAID + """, q AS (SELECT item_id AS query_id, 'E' || (3 - k) AS evidence_id, CASE WHEN (item_id + k) % 3 = 0 THEN upper(text) ELSE text END AS quote FROM benchmark, (SELECT unnest([1, 2]) AS k)),
v AS (SELECT coalesce(contains(pi.text, quote), false) AS ok FROM q LEFT JOIN pi USING (query_id, evidence_id)), c AS (SELECT list_contains(coalesce(known, []), i) AS ok FROM (SELECT query_id, unnest(ids) AS i FROM s) LEFT JOIN kn USING (query_id))
SELECT (SELECT CAST(count(*) AS BIGINT) FROM o) AS statements, (SELECT round(avg(valid::INT), 9) FROM o) AS statements_kept, (SELECT CAST(count(*) AS BIGINT) FROM c) AS citations, (SELECT round(avg(ok::INT), 9) FROM c) AS citations_valid,
(SELECT CAST(count(*) AS BIGINT) FROM v) AS excerpts, (SELECT round(avg(ok::INT), 9) FROM v) AS excerpts_verbatim""")
def validity_rates(spark, d):
    pack = _pack(spark, d)
    found = evaluate.validity_rates(_said(spark, d, pack), ev.resolve_excerpts(_quotes(spark, d), pack), pack)
    return found.withColumns({c: F.round(c, 9) for c in ("statements_kept", "citations_valid", "excerpts_verbatim")})


def _stand_in():
    """A model that answers by the length of the first line: well, in a fence, well at the second time, or never with all fields."""

    def complete(prompt: str) -> str:
        n = len(prompt.split("\n")[0]) % 4
        good = '{"label": "' + "abcd"[n] + '", "confidence": ' + str(n / 4) + "}"
        return (good, f"```json\n{good}\n```", good if "failed validation" in prompt else "I think: " + good, '{"label": "d"}')[n]

    return complete


@query("""SELECT conv_id, turn, CASE WHEN n < 3 THEN list_extract(['a', 'b', 'c'], CAST(n + 1 AS INT)) END AS label, CASE WHEN n < 3 THEN n / 4.0::DOUBLE END AS confidence,
CASE WHEN n = 3 THEN 'schema' END AS error_kind, CASE WHEN n >= 2 THEN 2 ELSE 1 END AS passes FROM (SELECT conv_id, turn, length(string_split(text, chr(10))[1]) % 4 AS n FROM conversations)""")
def structured_completions(spark, d):
    rows = _t(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("prompt"))
    rows = rows.withColumn("query_id", F.to_json("query_id"))
    found = completion.complete_structured(rows, _stand_in, "label string, confidence double", shared_folder(spark, "completions"))
    key = F.from_json("query_id", "conv_id long, turn long")
    return found.select(key.alias("key"), "parsed", "error_kind", "passes").select("key.conv_id", "key.turn", "parsed.label", "parsed.confidence", "error_kind", "passes")
