"""Log rows of requests: one for people, one of scalars for the metrics; no free text of a request reaches either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import guarded


def redacted(text: Column) -> Column:
    """How long a text is, never the text; null is told from empty."""
    return F.when(text.isNull(), F.lit("<none>")).otherwise(F.concat(F.lit("<"), F.length(text).cast("string"), F.lit(" chars>")))


def path_of(target: Column) -> Column:
    """The path of a request's target without its query and fragment, which can carry what a user wrote."""
    return F.regexp_extract(F.coalesce(target, F.lit("")), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def request_rows(requests: DataFrame, body: str = "body") -> DataFrame:
    """request_id, level, message, method, path, status, duration_ms, body of requests(request_id, method, target, status, seconds, body).

    A request without an id gets one made of its place; one without a status has failed before it had any: 500, an error. The body is
    redacted.
    """
    made = F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string"))
    status = F.coalesce(F.col("status"), F.lit(500)).cast("int")
    return requests.select(
        F.coalesce(F.col("request_id").cast("string"), made).alias("request_id"), F.when(status >= 500, "ERROR").otherwise("INFO").alias("level"), F.lit("request completed").alias("message"), "method",
        path_of(F.col("target")).alias("path"), status.alias("status"), F.bround(F.col("seconds") * 1000, 1).alias("duration_ms"), redacted(F.col(body)).alias("body"),
    )


def metric_rows(rows: DataFrame) -> DataFrame:
    """The metrics stream of log rows: request_id, path, status and duration; a text that is too long to be a scalar is replaced."""
    return rows.select(guarded(F.col("request_id")).alias("request_id"), guarded(F.col("path")).alias("path"), "status", "duration_ms")


def stage_metrics(rows: DataFrame) -> DataFrame:
    """path, requests, errors, slowest_ms: what a dashboard reads of the metrics stream."""
    return rows.groupBy("path").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.max("duration_ms").alias("slowest_ms"))
