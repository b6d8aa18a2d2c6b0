"""Reciprocal-rank fusion, domain boost, duplicate suppression and multi-query search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF, BOOST, NEAR = 60, 0.02, 0.95


def fuse(dense: DataFrame, lexical: DataFrame, key: str = "chunk_id", k: int = RRF) -> DataFrame:
    """query_id, key, dense_rank, dense_score, bm25_rank, bm25_score, rrf_score of two rankings (query_id, rank, key, score)."""
    d = dense.select("query_id", key, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    b = lexical.select("query_id", key, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return d.join(b, ["query_id", key], "full_outer").withColumn("rrf_score", part("dense_rank") + part("bm25_rank"))


def boost(fused: DataFrame, domains: Column, predicted: Column, amount: float = BOOST) -> DataFrame:
    """Adds amount to the score where the chunk's and the query's domains meet; never drops a row."""
    meets = F.coalesce(F.arrays_overlap(domains, predicted), F.lit(False))
    return fused.withColumn("boosted_score", F.col("rrf_score") + F.when(meets, amount).otherwise(0.0))


def rank(fused: DataFrame, key: str = "chunk_id", score: str = "boosted_score", k: int | None = None) -> DataFrame:
    """rank by score; ties by dense rank, then lexical rank, nulls last, then key."""
    by = Window.partitionBy("query_id").orderBy(F.round(score, 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), key)
    ranked = fused.withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= k) if k else ranked


def drop_exact_copies(ranked: DataFrame, hash_column: str = "content_hash") -> DataFrame:
    """The best ranked row of each content hash in a query; rows without a hash stay."""
    first = F.row_number().over(Window.partitionBy("query_id", hash_column).orderBy("rank"))
    return ranked.withColumn("__n", first).where((F.col("__n") == 1) | F.col(hash_column).isNull()).drop("__n")


def drop_near_copies(ranked: DataFrame, key: str = "chunk_id", threshold: float = NEAR) -> DataFrame:
    """Greedy by rank: a row stays if its dot product with every row kept before it is at most threshold; no vector, no test.

    Rows pass by in order of query and rank; of a query a task holds the vectors that stayed, and rows are computed once.
    """
    query, vector, kinds = ranked.columns.index("query_id"), ranked.columns.index("embedding"), ranked.schema

    def run(batches) -> Iterator:
        import pyarrow as pa

        last, kept = (), {}
        for b in batches:
            stays = []
            for q, v in zip(b.column(query).to_pylist(), b.column(vector), strict=True):
                if (q,) != last:
                    last, kept = (q,), {}
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), float) if v.is_valid else None
                same = kept.setdefault(len(x), []) if x is not None else []
                stays.append(not same or not (np.stack(same) @ x > threshold).any())
                if stays[-1] and x is not None:
                    same.append(x)
            yield b.filter(pa.array(stays, pa.bool_()))

    return ranked.repartition("query_id").sortWithinPartitions("query_id", "rank", key).mapInArrow(run, kinds)


def merge_variants(runs: DataFrame, key: str = "chunk_id", k: int = RRF) -> DataFrame:
    """One ranking from several of runs(query_id, variant, rank, key, boosted_score, ...): summed 1 / (k + rank).

    Other columns come from the row of largest boosted_score, of the first variant on a tie; the sum becomes boosted_score.
    """
    rest = [c for c in runs.columns if c not in ("query_id", key)]
    best = F.max_by(F.struct(*rest), F.struct(F.col("boosted_score"), -F.col("variant")))
    merged = runs.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"), best.alias("best"))
    return merged.select("query_id", key, *[F.col(f"best.{c}").alias(c) for c in rest if c not in ("rank", "variant", "boosted_score")], F.col("fused").alias("boosted_score"))


def hybrid_search(dense: DataFrame, lexical: DataFrame, payload: DataFrame, predicted: DataFrame, key: str = "chunk_id", k: int = 10, near: bool = True, distinct: bool = True) -> DataFrame:
    """Fused, boosted, de-duplicated top k (with distinct false no copy is dropped). payload(key, domains, content_hash, embedding) reaches dense hits only.

    predicted(query_id, predicted array<string>); without domains nothing is boosted and no hash is compared.
    """
    known = dense.select("query_id", key).join(payload, key)
    fused = fuse(dense, lexical, key).join(known, ["query_id", key], "left").join(predicted, "query_id", "left")
    fused = fused.withColumn("content_hash", F.when(F.size("predicted") > 0, F.col("content_hash")))
    ranked = rank(boost(fused, F.col("domains"), F.col("predicted")), key)
    if not distinct:
        return ranked.where(F.col("rank") <= k)
    kept = drop_exact_copies(ranked)
    kept = drop_near_copies(kept, key) if near else kept
    return rank(kept.drop("rank"), key, k=k)


def multi_query_search(asked: DataFrame, dense: DataFrame, lexical: DataFrame, payload: DataFrame, predicted: DataFrame, key: str = "chunk_id", k: int = 10, depth: int = 25, near: bool = True) -> DataFrame:
    """Hybrid search of questions with variants: asked(query_id, variant), dense and lexical with a column variant.

    A question with one variant is searched as by hybrid_search. The variants of another are each searched to depth without
    dropping copies, merged by merge_variants and rid of equal hashes (near copies stay).
    """
    several = asked.groupBy("query_id").agg((F.countDistinct("variant") > 1).alias("__several"))
    split = lambda rows, many: rows.join(several.where("__several" if many else "not __several").select("query_id"), "query_id", "left_semi")
    one = hybrid_search(split(dense, False).drop("variant"), split(lexical, False).drop("variant"), payload, predicted, key, k, near)
    pair = F.struct("query_id", "variant")
    keyed = lambda rows: split(rows, True).withColumn("query_id", pair)
    expected = asked.join(predicted, "query_id").select(pair.alias("query_id"), "predicted").distinct()
    each = hybrid_search(keyed(dense), keyed(lexical), payload, expected, key, depth, distinct=False)
    runs = each.select(F.col("query_id.variant").alias("variant"), F.col("query_id.query_id").alias("query_id"), *[c for c in each.columns if c != "query_id"])
    merged = rank(merge_variants(runs, key), key)
    return one.unionByName(rank(drop_exact_copies(merged).drop("rank"), key, k=k).select(*one.columns))
