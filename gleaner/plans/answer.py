"""A batch of questions to answers: one plan over all of them; an exit is a status, not control flow."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalized_question, script_language, sentences
from ..operators import evidence as ev
from ..operators import fusion, lexical, rerank, respond, rules, vector
from .session import once as written


def keyword_domains(text, vocabulary: dict[str, list[str]]):
    """Domains of which a keyword stands in the text: the stand-in for a classifier."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike("|".join(words)), F.lit(d)) for d, words in vocabulary.items()]).cast("array<string>"))


def retrieve(questions: DataFrame, store: DataFrame, k: int = 25) -> DataFrame:
    """Hybrid search of questions(query_id, query, domains) in store(chunk_id, text, domains, content_hash, embedding)."""
    dense = written(vector.search(store.select("chunk_id", "embedding"), questions.select("query_id", vector.hashed_embedding(F.col("query")).alias("embedding")), k, key="chunk_id"), "dense")
    found = lexical.search(store.select("chunk_id", "text"), questions.select("query_id", "query"), k)
    predicted = questions.select("query_id", F.col("domains").alias("predicted"))
    return fusion.hybrid_search(dense, found, store.select("chunk_id", "domains", "content_hash", "embedding"), predicted, k=k)


def extractive(evidence: DataFrame) -> DataFrame:
    """The stand-in for a generator: the first sentence of each of the two best pieces, cited and quoted."""
    first = F.get(sentences(F.col("text")), 0)
    rows = evidence.where(F.col("rank") <= 2).select("query_id", F.col("rank").alias("statement_no"), F.coalesce(first, F.lit("")).alias("text"), F.array("evidence_id").alias("evidence_ids"))
    return rows.where(F.length("text") > 0)


def answer_batch(
    questions: DataFrame, chunks: DataFrame, vocabulary: dict[str, list[str]], scratch: str, generate: Callable[[DataFrame], DataFrame] = extractive,
    scorer: Callable[[str, list[str]], list[float]] = rerank.overlap_scores, k: int = 5, seconds: float = 3.0,
) -> DataFrame:
    """One row per question: status, refusal, sufficiency, urgency, confidence, statements kept and dropped, evidence, actions.

    Exits in order: a request for a prescription (it is never searched for), the evidence gate (nothing is generated), no valid
    statement, a dose in a statement; the rest is success. A question leaves at its exit, before the next costly step, and the exits
    are put together at the end, where red flags and risk are there for every row. What several steps read is written once to
    scratch, a shared folder: the chunks with their vectors, the questions, and what search, reranking, gate and validation gave. Reranking falls back
    to the incoming order where the scorer fails or takes more than so many seconds a question; fallback_reason says so.
    """
    spark = questions.sparkSession

    seen: list[tuple[str, int, float]] = []

    def once(rows: DataFrame, name: str) -> DataFrame:
        began = time.monotonic()
        rows.write.parquet(f"{scratch}/{name}")
        written = spark.read.schema(rows.schema).parquet(f"{scratch}/{name}")
        seen.append((name, written.count(), time.monotonic() - began))  # counted from the files' footers
        return written

    asked = rules.match_rules(questions.withColumn("plain", normalized_question(F.col("query"))), "plain")
    asked = once(asked.withColumns({"domains": keyword_domains(F.col("query"), vocabulary), "asks": rules.asks_for_prescription(F.col("query"))}), "asked")
    searched = asked.where("not asks")
    payload = chunks.select("chunk_id", "text", "domains", content_hash(F.col("text")).alias("content_hash"), vector.hashed_embedding(F.col("text")).alias("embedding"))
    store = once(payload, "store")
    ranked = once(retrieve(searched.select("query_id", "query", "domains"), store), "ranked")
    texts = store.select("chunk_id", "text")
    candidates = ranked.join(texts, "chunk_id").join(searched.select("query_id", "query"), "query_id").select("query_id", "query", "rank", "chunk_id", "text")
    best = rerank.rerank(candidates, scorer, k, seconds).select("query_id", "rank", "chunk_id", F.col("score").alias("rerank_score"), "fallback_reason")
    packed = once(ev.pack(best.join(ranked.select("query_id", "chunk_id", "rrf_score"), ["query_id", "chunk_id"]), texts), "packed")
    listed = packed.groupBy("query_id").agg(F.max("fallback_reason").alias("fallback_reason"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("evidence"))
    gated = searched.join(ev.pack_summary(packed), "query_id", "left").join(listed, "query_id", "left").fillna(0, ["support_count", "top_rrf_score"])
    state = ev.sufficiency(F.col("top_rerank_score"), F.col("top_rrf_score"), F.col("support_count"), F.size("domains") > 0, tau={"rerank": (0.5, 0.05), "rrf": ev.TAU["rrf"]})
    gated = once(gated.withColumn("sufficiency", state), "gated")
    weak = F.col("sufficiency").isin("INSUFFICIENT", "OUT_OF_SCOPE")
    passed = gated.where(~weak)
    shown = packed.join(passed.select("query_id"), "query_id", "left_semi")
    said = once(ev.resolve_statements(generate(shown), shown), "said")
    doses = rules.dose_phrases(said.where("valid").select("query_id", "text"), "query_id").groupBy("query_id").agg(F.count("*").alias("doses"))
    counts = said.groupBy("query_id").agg(F.count_if("valid").alias("statements"), F.count_if(~F.col("valid")).alias("dropped"))
    answered = passed.join(counts, "query_id", "left").join(doses, "query_id", "left").fillna(0, ["statements", "dropped", "doses"])
    answered = answered.withColumn("refusal_reason", F.when(F.col("statements") == 0, "NO_VALID_STATEMENTS").when(F.col("doses") > 0, "DOSE_IN_ANSWER"))
    gone = {c: F.lit(0).cast("long") for c in ("statements", "dropped", "doses")}
    refused = gated.where(weak).withColumns(gone | {"refusal_reason": ev.refusal_reason(F.col("sufficiency"))})
    none = F.array().cast("array<string>")
    referred = asked.where("asks").withColumns(gone | {"domains": none, "support_count": F.lit(0).cast("long"), "sufficiency": F.lit("OUT_OF_SCOPE"), "refusal_reason": F.lit("PRESCRIPTION_REQUEST")})
    log_run(spark, seen, f"{scratch}/log")
    return finished(referred.unionByName(refused, allowMissingColumns=True).unionByName(answered, allowMissingColumns=True))


RUN = "stage string, rows long, seconds double"


def log_run(spark: SparkSession, seen: list[tuple[str, int, float]], path: str) -> None:
    """The log of a run: a row for each stage with the rows that it wrote and its seconds; no text of a question."""
    spark.createDataFrame(seen, RUN).coalesce(1).write.json(path)


def read_run(spark: SparkSession, scratch: str) -> DataFrame:
    """stage, rows, seconds of the run that used scratch."""
    return spark.read.schema(RUN).json(f"{scratch}/log")


def finished(rows: DataFrame) -> DataFrame:
    """What every exit ends with: risk, actions, limitations, message and trace."""
    rows = rules.assess_risk(rows, "query").withColumn("status", F.when(F.col("refusal_reason").isNull(), "success").otherwise("refused"))
    actions = rules.decide_actions(F.col("urgency"), F.col("sufficiency"), F.col("support_count"), F.col("status") == "refused")
    limits = respond.stated_limitations(F.col("sufficiency"), F.lit(None).cast("array<string>"), F.col("support_count"))
    steps = respond.trace(
        F.col("refusal_reason"), red_flag_check=F.size("matches"), domain_predict=F.array_join("domains", ", "), rerank=F.col("top_rerank_score"), sufficiency=F.col("sufficiency"),
        generation=F.col("statements"), validation=F.col("dropped"), dose_scan=F.col("doses"), risk=F.col("urgency"), decision=rules.action_type(F.col("urgency")),
    )
    rows = rows.withColumns({"actions": actions, "limitations": limits})
    success = F.col("status") == "success"
    return rows.select(
        "query_id", "status", "refusal_reason", "sufficiency", "support_count", "statements", "dropped", "urgency", "floor_applied", "confidence", script_language(F.col("query")).alias("language"),
        "evidence", "fallback_reason", "actions", rules.action_type(F.col("urgency")).alias("action_type"), F.when(success, respond.action_message(F.col("urgency"), F.col("actions.show_followup_question"))).alias("message"),
        F.when(success, F.col("limitations")).alias("limitations"), steps.alias("trace"),
    )
