"""Exact top-k by inner product over integer vectors.

Rows fall into ranges of length, and a query doesn't meet the ranges whose longest row times its own length can't reach
its k-th score over the longest rows of all. Within a block rows are taken by descending length, and a query leaves it
once its length times the longest left can't reach its k-th score so far; for the others the vectors are rotated by the block's singular vectors, inner products
are summed over the first rotated components, and what is left is bounded by Cauchy-Schwarz. Only pairs that the
bounds can't exclude get their exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .vectors import best, few_copies, matrix, met, place, sound, upto

#: Rows whose scores give every query its first threshold: the longest ones.
SEEDS = 1024
#: Rows that are looked at together, and ranges of length.
STEP, RANGES = 512, 64


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x).astype(np.int64)


def floors(qids: np.ndarray, q: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """A query's k-th score over the seeds that aren't the query itself: a lower bound of its k-th score."""
    if len(seeds[0]) <= k:
        return np.full(len(qids), -np.inf)
    s = np.where(seeds[0][None, :] == qids[:, None], np.iinfo(np.int64).min, q @ seeds[1].T)
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].astype(float)


def highest(queries, rows, width: int, k: int, scale: int):
    ids, x = matrix(rows, width)
    qids, q = matrix(queries, width)
    x, q = whole(x, scale), whole(q, scale)
    norm, qnorm = np.sqrt((x.astype(float) ** 2).sum(1)), np.sqrt((q.astype(float) ** 2).sum(1))
    down = np.lexsort((ids, -norm))
    ids, x, norm = ids[down], x[down], norm[down]
    turn = np.linalg.eigh(x.T.astype(float) @ x.astype(float))[1][:, ::-1]
    rx, rq = x @ turn, q @ turn
    cuts = sorted({max(1, width // 4), max(1, width // 2), max(1, 3 * width // 4)})
    rest = {c: (np.sqrt((rx[:, c:] ** 2).sum(1)), np.sqrt((rq[:, c:] ** 2).sum(1))) for c in cuts}
    floor = queries.column("floor").to_numpy().copy()
    slack = 1e-9 * (1 + qnorm * (norm[0] if len(norm) else 0))
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qids]
    for at in range(0, len(ids), STEP):
        to = min(at + STEP, len(ids))
        live = np.flatnonzero(qnorm * norm[at] + slack >= floor)
        if not len(live):
            break
        first = cuts[0]
        part = rq[live, :first] @ rx[at:to, :first].T
        keep = part + np.outer(rest[first][1][live], rest[first][0][at:to]) + slack[live, None] >= floor[live, None]
        a, b = np.nonzero(keep)
        part, a, b = part[a, b], live[a], b + at
        for c, d in zip(cuts, cuts[1:], strict=False):
            part = part + (rq[a, c:d] * rx[b, c:d]).sum(1)
            keep = part + rest[d][1][a] * rest[d][0][b] + slack[a] >= floor[a]
            a, b, part = a[keep], b[keep], part[keep]
        other = ids[b] != qids[a]
        a, b = a[other], b[other]
        scores = (q[a] * x[b]).sum(1)
        for i, lo, hi in zip(*np.unique(a, return_index=True), np.append(np.unique(a, return_index=True)[1][1:], len(a)), strict=True):
            held[i].append((ids[b[lo:hi]], scores[lo:hi]))
            found = [np.concatenate(z) for z in zip(*held[i], strict=True)]
            top = best(found[1], found[0], k)
            held[i] = [(found[0][top], found[1][top])]
            if len(top) == k:
                floor[i] = max(floor[i], float(found[1][top[-1]]))
    for i, found in enumerate(held):
        for near, scores in found:
            yield np.full(len(near), qids[i]), near, scores


def _with_floor(width: int, seeds: tuple[np.ndarray, np.ndarray], k: int, scale: int):
    """Queries with floor, and reach: the length below which no row can matter to them."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids, q = matrix(pa.Table.from_batches([b]), width)
            q = whole(q, scale)
            floor, norm = floors(ids, q, seeds, k), np.sqrt((q.astype(float) ** 2).sum(1))
            reach = np.where(norm > 0, floor / np.maximum(norm, 1) * (1 - 1e-9 * np.sign(floor)), -np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor), pa.array(reach)], names=[*b.schema.names, "floor", "reach"])

    return run


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) for each of queries.

    Null vectors and vectors with a null or non-finite component take no part; a query isn't its own neighbour; ties
    go to the smaller vec_id; shorter vectors end in zeros; empty tables give an empty result. Rows that repeat a vec_id
    are candidates each; queries that repeat one share a ranking. Scores must fit a long.
    """
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + F.floor(v * scale).cast("double") * F.floor(v * scale).cast("double"))
    rows = staged(spark, few_copies(sound(vectors, True), k + 1).withColumn("norm", F.sqrt(square)))
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n, width = seen["n"], seen["width"] or 1
    across = max(1, -(-n // block))
    ranges = min(RANGES, across)
    shares = [i / ranges for i in range(ranges - 1, 0, -1)]
    marks = rows.agg(F.percentile_approx("norm", F.array(*map(F.lit, [*shares, max(0.0, 1 - 2 * SEEDS / max(n, 1))])), 100_000)).first()[0] or [0.0] * (len(shares) + 1)
    bounds = marks[:-1]  # descending
    # Only rows about as long as the SEEDS longest are sorted; at most SEEDS come here.
    ids, x = matrix(rows.where(F.col("norm") >= F.lit(marks[-1])).orderBy(F.col("norm").desc(), "vec_id").limit(SEEDS).toArrow(), width)
    seeds = (ids, whole(x, scale))
    range_of = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("norm"))) if bounds else F.lit(0)
    placed = rows.withColumn("range", range_of)
    longest = {r["range"]: r["longest"] for r in placed.groupBy("range").agg(F.max("norm").alias("longest")).collect()}  # at most RANGES rows
    tops = [max((v for r, v in longest.items() if r >= i), default=-1.0) for i in range(ranges)]
    subs = -(-across // ranges)
    asked = sound(queries, True)
    down = max(1, -(-asked.count() // 2048))
    reached = F.size(F.filter(F.array(*map(F.lit, tops)), lambda t: t >= F.col("reach")))
    left = (
        asked.mapInArrow(_with_floor(width, seeds, k, scale), "vec_id long, embedding array<double>, floor double, reach double")
        .withColumn("q", place(down, 1))
        .withColumn("m", reached * subs)
        .where("m > 0")
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .drop("m", "reach")
    )
    right = placed.withColumn("r", F.col("range") * subs + place(subs, 2)).withColumn("q", upto(down)).drop("range", "norm")
    return met(left, right, lambda a, b: highest(a, b, width, k, scale), "long", k)
