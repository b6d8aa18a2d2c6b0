"""Evidence packs, the sufficiency gate and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper and lower thresholds of either signal, and the support that counts as enough.
TAU = {"rerank": (0.7285, -3.9325), "rrf": (0.045, 0.015)}
SUPPORT = 2


def pack(ranked: DataFrame, store: DataFrame) -> DataFrame:
    """evidence rows: ranked(query_id, rank, chunk_id, rrf_score, rerank_score) with store(chunk_id, ...); labels E<rank> may skip."""
    return ranked.join(store, "chunk_id").withColumn("evidence_id", F.concat(F.lit("E"), F.col("rank").cast("string")))


def pack_summary(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("query_id").agg(
        F.max(F.coalesce("rrf_score", F.lit(0.0))).alias("top_rrf_score"), F.max("rerank_score").alias("top_rerank_score"), F.count("*").alias("support_count")
    )


def prompt_block(evidence: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.coalesce(F.col("text"), F.lit("")))
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("block"))


def sufficiency(top_rerank: Column, top_rrf: Column, support: Column, has_domain: Column, tau: dict = TAU) -> Column:
    """SUFFICIENT, PARTIAL, INSUFFICIENT or OUT_OF_SCOPE; the rerank score decides where there is one."""
    signal = F.coalesce(top_rerank, top_rrf)
    high = F.when(top_rerank.isNotNull(), tau["rerank"][0]).otherwise(tau["rrf"][0])
    low = F.when(top_rerank.isNotNull(), tau["rerank"][1]).otherwise(tau["rrf"][1])
    return (
        F.when((signal < low) & ~has_domain, "OUT_OF_SCOPE").when(signal < low, "INSUFFICIENT").when((signal >= high) & (support >= SUPPORT), "SUFFICIENT").otherwise("PARTIAL")
    )


def refusal_reason(state: Column) -> Column:
    return F.when(state == "OUT_OF_SCOPE", "OUT_OF_SCOPE").when(state == "INSUFFICIENT", "INSUFFICIENT_EVIDENCE")


def resolve_statements(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """statements(query_id, statement_no, text, evidence_ids) with valid and reason; every id must resolve, and there must be one."""
    cited = statements.select("query_id", "statement_no", F.explode("evidence_ids").alias("evidence_id"))
    known = evidence.select("query_id", "evidence_id").distinct().withColumn("known", F.lit(1))
    ok = cited.join(known, ["query_id", "evidence_id"], "left").groupBy("query_id", "statement_no").agg((F.count("*") == F.count("known")).alias("all_known"))
    joined = statements.join(ok, ["query_id", "statement_no"], "left")
    valid = F.coalesce(F.col("all_known"), F.lit(False))
    reason = F.when(valid, F.lit(None)).when(F.size("evidence_ids") == 0, "no citation").otherwise("unresolved citation")
    return joined.withColumn("valid", valid).withColumn("reason", reason).drop("all_known")


def resolve_excerpts(excerpts: DataFrame, evidence: DataFrame) -> DataFrame:
    """excerpts(query_id, evidence_id, quote) with valid and reason; a quote must stand literally in its evidence's text."""
    joined = excerpts.join(evidence.select("query_id", "evidence_id", F.col("chunk_id"), F.col("text").alias("__text")), ["query_id", "evidence_id"], "left")
    reason = F.when(F.col("chunk_id").isNull(), "unknown evidence").when(F.col("__text").isNull(), "no record").when(~F.contains("__text", "quote"), "not verbatim")
    return joined.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("__text")


def resolve_conflicts(conflicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """conflicts(query_id, description, evidence_ids) that name two known ids or more; repeats count."""
    known = evidence.groupBy("query_id").agg(F.collect_set("evidence_id").alias("__known"))
    joined = conflicts.join(known, "query_id", "left")
    return joined.where(F.size(F.filter("evidence_ids", lambda i: F.coalesce(F.array_contains(F.col("__known"), i), F.lit(False)))) >= 2).drop("__known")


def mark_selected(evidence: DataFrame, statements: DataFrame) -> DataFrame:
    """evidence with selected: cited by a valid statement."""
    cited = statements.where("valid").select("query_id", F.explode("evidence_ids").alias("evidence_id")).distinct().withColumn("selected", F.lit(True))
    return evidence.join(cited, ["query_id", "evidence_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
