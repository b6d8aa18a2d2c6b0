"""Expectation queries: rows that break a contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_ranges(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("page_start") < 0) | (F.col("page_end") < F.col("page_start")))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def stages_out_of_order(trace: DataFrame) -> DataFrame:
    """trace(query_id, position, stage, group_rank) rows that repeat a stage or fall behind an earlier group."""
    before = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    again = F.count("*").over(Window.partitionBy("query_id", "stage").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return trace.withColumn("behind", F.coalesce(F.max("group_rank").over(before), F.lit(0)) > F.col("group_rank")).withColumn("again", again > 0).where("behind or again")


def bad_urls(rows: DataFrame, column: str = "source_url") -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).rlike(r"^(?:https?://[^\s]+|TBD.*)$"), F.lit(False)))


def broken_answers(answers: DataFrame) -> DataFrame:
    """answers(query_id, status, sufficiency, limitations, cited, selected, risk_ids, supported_domain) with the rule they break."""
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    rule = (
        F.when(~inside("cited", "selected"), "citations are selected")
        .when((F.col("sufficiency") == "PARTIAL") & (F.size("limitations") == 0), "partial support names a limitation")
        .when(~inside("risk_ids", "selected"), "risk cites selected evidence")
        .when((F.col("status") == "refused") & (F.size("selected") > 0), "a refusal selects nothing")
        .when((F.col("status") == "success") & F.col("supported_domain").isNull(), "success names its domain")
    )
    return answers.withColumn("broken", rule).where("broken is not null")
