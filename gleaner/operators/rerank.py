"""Reranking with a fallback to the incoming order."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_id long, chunk_id long, pre_rank int, rank int, score double, rerank_used boolean, fallback_reason string"


def passthrough(candidates: DataFrame, k: int = 5, reason: str | None = None) -> DataFrame:
    """The first k of candidates(query_id, rank, chunk_id) in their order, without a score."""
    return candidates.where(F.col("rank") <= k).select(
        "query_id", "chunk_id", F.col("rank").cast("int").alias("pre_rank"), F.col("rank").cast("int").alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("rerank_used"), F.lit(reason).alias("fallback_reason")
    )


def overlap_scores(query: str, texts: list[str]) -> list[float]:
    """A scorer without a model: the share of the query's terms in each text."""
    wanted = set(query.lower().split())
    return [len(wanted & set(t.lower().split())) / max(1, len(wanted)) for t in texts]


def rerank(candidates: DataFrame, scorer: Callable[[str, list[str]], list[float]] = overlap_scores, k: int = 5, seconds: float = 3.0) -> DataFrame:
    """The k best of candidates(query_id, query, rank, chunk_id, text) by scorer; incoming order where it fails or is too slow."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        began, reason, scores = time.monotonic(), None, None
        try:
            scores = [float(x) for x in scorer(pdf["query"].iloc[0], pdf["text"].fillna("").tolist())]
            if time.monotonic() - began > seconds:
                reason = "over budget"
        except Exception as error:  # a scorer may fail in any way; the incoming order is the answer then
            reason = type(error).__name__
        out = pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "pre_rank": pdf["rank"], "score": scores if reason is None else None})
        if reason is None:
            out = out.sort_values("score", ascending=False, kind="stable")
        out = out.head(k).assign(rerank_used=reason is None, fallback_reason=reason)
        out["rank"] = range(1, len(out) + 1)
        return out[["query_id", "chunk_id", "pre_rank", "rank", "score", "rerank_used", "fallback_reason"]]

    return candidates.groupBy("query_id").applyInPandas(run, OUT)


def best_variant(runs: DataFrame) -> DataFrame:
    """Of rerank runs under several variants (column variant) the one with the largest top score, the first on a tie."""
    tops = runs.groupBy("query_id", "variant").agg(F.max(F.coalesce("score", F.lit(float("-inf")))).alias("top"))
    first = tops.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("top").desc(), "variant"))).where("n = 1")
    return runs.join(first.select("query_id", "variant"), ["query_id", "variant"], "left_semi")


def rerank_query(question, variants):
    """The text to rerank by: the first variant where under half of the question's letters are ASCII, else the question."""
    from ..functions.text import latin_share

    return F.when((F.coalesce(latin_share(question), F.lit(1.0)) < 0.5) & (F.size(variants) > 0), F.get(variants, 0)).otherwise(question)


def loaded(factory: Callable[[], Callable[[str, list[str]], list[float]]], probe: tuple[str, list[str]] = ("warm", ["warm up"])) -> tuple[Callable | None, str | None]:
    """A scorer and null, or null and why there is none: a scorer that can't be loaded or fails its first call isn't used."""
    try:
        scorer = factory()
        scorer(*probe)
    except Exception as error:  # whatever fails, the answer is to go without
        return None, type(error).__name__
    return scorer, None


def rerank_or_pass(candidates: DataFrame, scorer: Callable | None, reason: str | None = None, k: int = 5) -> DataFrame:
    """rerank with a scorer, the incoming order without one."""
    return rerank(candidates, scorer, k) if scorer else passthrough(candidates, k, reason)
