"""Explainable rules: red flags, risk, dose phrases, prescription requests and actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K

#: Rows of a rule table that every text is compared with.
RULES_MOST = 10_000


def rule_table(spark: SparkSession, rules: dict = K.RULES) -> DataFrame:
    """rule_id, label, floor_rank, groups, group_no, alt_no, pattern: a row for each alternative."""
    rows = [(name, label, K.URGENCIES.index(floor), len(groups), g, a, p) for name, (label, floor, groups) in rules.items() for g, group in enumerate(groups) for a, p in enumerate(group)]
    return spark.createDataFrame(rows, "rule_id string, label string, floor_rank int, groups int, group_no int, alt_no int, pattern string")


def match_rules(texts: DataFrame, text: str = "text", rules: dict = K.RULES) -> DataFrame:
    """texts with matches (rule_id, label, floor, found phrases) in the rules' order, and urgency_floor.

    Patterns are literals, so each is compiled once and no join is needed; the rules are a fixed list.
    """
    found = []
    for name, (label, floor, groups) in rules.items():
        hits = [F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in group]) for group in groups]
        all_hit = reduce(lambda a, b: a & b, [h.isNotNull() for h in hits])
        found.append(F.when(all_hit, F.struct(F.lit(name).alias("rule_id"), F.lit(label).alias("label"), F.lit(K.URGENCIES.index(floor)).alias("floor_rank"), F.array(*hits).alias("found"))))
    out = texts.withColumn("matches", F.array_compact(F.array(*found)))
    floor = F.coalesce(F.array_max(F.transform("matches", lambda m: m["floor_rank"])), F.lit(0))
    return out.withColumn("floor_rank", floor).withColumn("urgency_floor", urgency_name(floor))


def match_rules_by_join(texts: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, rule_id of each rule that fires: the same over a rule table of RULES_MOST rows at most, which is checked, so it is broadcast."""
    if rules.limit(RULES_MOST + 1).count() > RULES_MOST:
        raise ValueError(f"more than {RULES_MOST} alternatives of rules")
    hits = texts.select(key, text).join(F.broadcast(rules), F.expr(f"regexp_like({text}, pattern)"))
    groups = hits.groupBy(key, "rule_id", "groups").agg(F.countDistinct("group_no").alias("n"))
    return groups.where("n = groups").select(key, "rule_id")


def urgency_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, K.URGENCIES)), rank + 1)


def urgency_rank(name: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, K.URGENCIES)), name) - 1).cast("int")


def apply_floor(rank: Column, floor: Column) -> Column:
    return F.greatest(rank, floor)


def _first_term(text: Column, terms: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms])


def assess_risk(rows: DataFrame, text: str = "text", domains: str = "domains", state: str = "sufficiency", support: str = "support_count") -> DataFrame:
    """rows (with matches and floor_rank) with factors, assessed_rank, urgency, floor_applied and confidence."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    factor = lambda code, why, rank: F.struct(F.lit(code).alias("code"), why.alias("description"), F.lit(K.URGENCIES[rank]).alias("contributed"))
    parts = []
    for code, said, terms, rank in (("SEVERITY_LANGUAGE", K.FACTOR_SEVERITY, K.SEVERITY_TERMS, 2), ("ACUTE_ONSET", K.FACTOR_ONSET, K.ACUTE_TERMS, 1), ("VULNERABLE_GROUP", K.FACTOR_GROUP, K.VULNERABLE_TERMS, 1)):
        hit = _first_term(low, terms)
        parts.append((hit.isNotNull(), factor(code, F.concat(F.lit(f"{said} ('"), hit, F.lit("')")), rank), rank))
    met = F.array_sort(F.array_intersect(F.coalesce(F.col(domains), F.array().cast("array<string>")), F.array(*map(F.lit, K.EMERGENCY_DOMAINS))))
    parts.append((F.size(met) > 0, factor("EMERGENCY_DOMAIN", F.concat(F.lit(K.FACTOR_DOMAIN), F.array_join(met, ", ")), 1), 1))
    own = F.array_compact(F.array(*[F.when(c, f) for c, f, _ in parts]))
    flags = F.transform("matches", lambda m: F.struct(F.concat(F.lit("RED_FLAG:"), m["rule_id"]).alias("code"), F.concat(F.lit(K.FACTOR_FLAG), m["label"]).alias("description"), urgency_name(m["floor_rank"]).alias("contributed")))
    every = F.concat(own, flags)
    none = F.array(factor("NO_ESCALATING_FEATURES", F.lit(K.FACTOR_NONE), 0))
    assessed = F.greatest(*[F.when(c, F.lit(r)).otherwise(0) for c, _, r in parts])
    base = reduce(lambda w, kv: w.when(F.col(state) == kv[0], kv[1]), list(K.CONFIDENCE_BASE.items())[1:], F.when(F.col(state) == "SUFFICIENT", K.CONFIDENCE_BASE["SUFFICIENT"])).otherwise(0.30)
    confidence = F.bround(F.least(F.lit(0.95), base + F.least(F.col(support), F.lit(5)) * 0.02 + F.when(F.size("matches") > 0, 0.10).otherwise(0.0)), 2)
    out = rows.withColumn("factors", F.when(F.size(every) > 0, every).otherwise(none)).withColumn("assessed_rank", assessed)
    return out.withColumn("urgency_rank", apply_floor(F.col("assessed_rank"), F.col("floor_rank"))).withColumn("urgency", urgency_name(F.col("urgency_rank"))).withColumn("floor_applied", F.col("urgency_rank") > F.col("assessed_rank")).withColumn("confidence", confidence)


def decide_actions(urgency: Column, state: Column, support: Column, refusal: Column) -> Column:
    """A struct of what to show. Out of scope isn't in the list of weak states."""
    rank = urgency_rank(urgency)
    weak, low, high = state.isin("PARTIAL", "INSUFFICIENT") | (support < 2), rank == 0, rank >= 2
    return F.struct(
        high.alias("show_emergency_banner"), (rank == 3).alias("lead_with_emergency"), (rank == 3).alias("recommend_emergency_care"), (rank == 2).alias("recommend_urgent_care"),
        (rank == 1).alias("recommend_routine_care"), (low & ~weak & ~refusal).alias("recommend_self_care"), high.alias("suppress_wellness_content"),
        F.lit(True).alias("require_user_confirmation_for_external_actions"), ((low & weak) | refusal).alias("show_followup_question"), low.alias("show_fixed_low_risk_copy"),
        F.when(rank == 3, "critical_lead").when(rank == 2, "high_lead").alias("emergency_lead"),
    )


def action_type(urgency: Column) -> Column:
    return F.when(urgency == "CRITICAL", "emergency").when(urgency == "HIGH", "urgent_care").when(urgency == "MODERATE", "evaluation").otherwise("guidance")


def asks_for_prescription(text: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [text.rlike(p) for p in K.PRESCRIPTION_REQUESTS]), F.lit(False))


def dose_phrases(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, kind, phrase: every match of every pattern."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("phrase")))

    each = F.array(*[of(k, p) for k, p in K.DOSES.items()])
    return texts.select(key, F.explode(F.flatten(each)).alias("m")).select(key, "m.kind", "m.phrase")
