"""From validated statements to what is shown: cited sources, risk, actions, limitations and the trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import confidence_band, squeeze


def guidance(urgency: Column, config: dict = K.EMERGENCY) -> Column:
    """lead, label, number and instruction from the configuration for HIGH and CRITICAL; null below, never generated."""
    lead = F.when(urgency == "CRITICAL", config["critical_lead"]).when(urgency == "HIGH", config["high_lead"])
    rest = [F.lit(config[c]).cast("string").alias(c) for c in ("label", "number", "instruction")]
    return F.when(lead.isNotNull(), F.struct(lead.alias("lead"), *rest))


def action_message(urgency: Column, followup: Column, config: dict = K.EMERGENCY) -> Column:
    """What to do: the emergency text first; fixed copy for LOW, with a caveat where a question should follow."""
    help_ = guidance(urgency, config)
    low = F.concat(F.lit(K.ACTION_LOW), F.when(followup, K.ACTION_LIMITED).otherwise(""))
    return F.when(help_.isNotNull(), F.concat(help_["lead"], F.lit(" "), help_["instruction"])).when(urgency == "LOW", low).otherwise(K.ACTION_ASSESS)


def escalated(message: Column, urgency: Column, config: dict = K.EMERGENCY) -> Column:
    """A refusal's message behind the emergency text: an urgency outlives a refusal."""
    help_ = guidance(urgency, config)
    return F.when(help_.isNull(), F.coalesce(message, F.lit(""))).otherwise(F.concat(help_["lead"], F.lit(" "), help_["instruction"], F.lit("\n\n"), F.coalesce(message, F.lit(""))))


def shown_controls(actions: Column) -> Column:
    """Controls to show, of decide_actions' struct; showing one does nothing by itself."""
    return F.struct(
        actions["recommend_emergency_care"].alias("call_emergency"), (actions["recommend_emergency_care"] | actions["recommend_urgent_care"]).alias("find_facility"),
        actions["show_emergency_banner"].alias("alert_contacts"), (~actions["suppress_wellness_content"]).alias("wellness"),
    )


def indexed(evidence: DataFrame) -> DataFrame:
    """evidence with its index in the pack, from 1: places of missing records aren't counted."""
    return evidence.withColumn("index", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def citations(statements: DataFrame) -> DataFrame:
    """query_id, statement_no, evidence_id of valid statements, each once."""
    return statements.where("valid").select("query_id", "statement_no", F.explode("evidence_ids").alias("evidence_id")).distinct()


def cited_metadata(cited: DataFrame, evidence: DataFrame, store: DataFrame) -> DataFrame:
    """cited(query_id, evidence_id) with what store(chunk_id, ...) says of its chunk; null where either step finds nothing."""
    hop = evidence.select("query_id", "evidence_id", "chunk_id")
    return cited.join(hop, ["query_id", "evidence_id"], "left").join(store, "chunk_id", "left")


def shown_evidence(evidence: DataFrame, statements: DataFrame, excerpts: DataFrame) -> DataFrame:
    """query_id, index, evidence_id, chunk_id, excerpt, selected: the first valid excerpt (by excerpt_no), and whether a valid statement cites the chunk."""
    first = excerpts.where("valid").groupBy("query_id", "evidence_id").agg(F.min_by("quote", "excerpt_no").alias("excerpt"))
    rows = indexed(evidence)
    chunks = citations(statements).join(rows.select("query_id", "evidence_id", "chunk_id"), ["query_id", "evidence_id"]).select("query_id", "chunk_id", F.lit(True).alias("selected")).distinct()
    out = rows.join(first, ["query_id", "evidence_id"], "left").join(chunks, ["query_id", "chunk_id"], "left")
    return out.select("query_id", "index", "evidence_id", "chunk_id", "excerpt", F.coalesce("selected", F.lit(False)).alias("selected"))


def statement_indexes(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, statement_id (from 1, of valid statements in order), statement_no, citations: sorted indexes in the pack."""
    found = citations(statements).join(indexed(evidence).select("query_id", "evidence_id", "index"), ["query_id", "evidence_id"])
    per = found.groupBy("query_id", "statement_no").agg(F.array_sort(F.collect_set("index")).alias("citations"))
    return per.withColumn("statement_id", F.row_number().over(Window.partitionBy("query_id").orderBy("statement_no")))


def risk_blocks(assessed: DataFrame, shown: DataFrame) -> DataFrame:
    """query_id, level, band, confidence, factors, rules, evidence_ids of assessed rows with selected evidence; no row without any.

    assessed comes from assess_risk; shown from shown_evidence.
    """
    ids = shown.where("selected").groupBy("query_id").agg(F.array_sort(F.collect_list("index")).alias("evidence_ids"))
    return assessed.join(ids, "query_id").select(
        "query_id", F.col("urgency").alias("level"), confidence_band(F.col("confidence")).alias("band"), "confidence", F.transform("factors", lambda f: f["code"]).alias("factors"),
        F.transform("matches", lambda m: m["rule_id"]).alias("rules"), "evidence_ids",
    )


def stated_limitations(state: Column, limitations: Column, support: Column) -> Column:
    """limitations, or one from the support count where partial support names none."""
    own = F.concat(F.lit(K.LIMITED_SUPPORT[0]), support.cast("string"), F.when(support == 1, " source").otherwise(" sources"), F.lit(K.LIMITED_SUPPORT[1]))
    said = F.coalesce(limitations, F.array().cast("array<string>"))
    return F.when((state == "PARTIAL") & (F.size(said) == 0), F.array(own)).otherwise(said)


def trace(refusal: Column, **outputs: Column) -> Column:
    """The stages that ran, in order, as (stage, group_rank, output): a refusal ends them where it is decided.

    outputs gives the output of a stage by name; a stage without one has null.
    """
    flow = ["red_flag_check", "prescribing_check", "domain_predict", "retrieval", "rerank", "sufficiency", "generation", "validation", "dose_scan", "risk", "decision"]
    ends = {"PRESCRIPTION_REQUEST": "prescribing_check", "OUT_OF_SCOPE": "sufficiency", "INSUFFICIENT_EVIDENCE": "sufficiency", "NO_VALID_STATEMENTS": "validation", "DOSE_IN_ANSWER": "dose_scan"}
    group = {name: i for i, names in enumerate(K.STAGE_GROUPS) for name in names}
    last = F.lit(len(flow))
    for reason, stage in ends.items():
        last = F.when(refusal == reason, flow.index(stage)).otherwise(last)
    always = ("risk", "decision")  # safety is assessed on every exit
    rows = [F.when((last >= i) | F.lit(name in always), F.struct(F.lit(name).alias("stage"), F.lit(group[name]).alias("group_rank"), outputs.get(name, F.lit(None)).cast("string").alias("output"))) for i, name in enumerate(flow)]
    return F.array_compact(F.array(*rows))


def trace_rows(rows: DataFrame, column: str = "trace") -> DataFrame:
    """query_id, position, stage, group_rank, output: a row for each stage."""
    return rows.select("query_id", F.posexplode(column).alias("position", "s")).select("query_id", "position", "s.*")


def loose_quotes(excerpts: DataFrame, evidence: DataFrame) -> DataFrame:
    """excerpts(query_id, evidence_id, quote) with verbatim: the quote stands in the text when white space is squeezed in both."""
    text = evidence.select("query_id", "evidence_id", squeeze(F.col("text")).alias("__text"))
    joined = excerpts.join(text, ["query_id", "evidence_id"], "left")
    return joined.withColumn("verbatim", F.coalesce(F.contains("__text", squeeze(F.col("quote"))), F.lit(False))).drop("__text")


def drop_reasons(resolved: DataFrame) -> DataFrame:
    """reason, dropped: how often each reason dropped a statement or an excerpt."""
    return resolved.where(~F.col("valid")).groupBy("reason").agg(F.count("*").alias("dropped"))
