"""What both vector searches share: sound rows, and the meetings of query blocks with row blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sound(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows whose components are all finite; the zero vector only if zero_too."""
    x = F.col("embedding")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    return kept if zero_too else kept.where(F.exists(x, lambda v: v != 0))


def few_copies(rows: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors the keep rows of smallest vec_id: copies beyond them can't be among a query's keep - 1 nearest.

    Each map task passes on at most keep rows of a vector, so a vector that many rows share stays small.
    """
    by = Window.partitionBy("embedding").orderBy("vec_id")
    return rows.withColumn("copy", F.row_number().over(by)).where(F.col("copy") <= keep).drop("copy")


def matrix(table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_id and the vectors of an Arrow table; shorter ones end in zeros."""
    lists = table.column("embedding").combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return table.column("vec_id").to_numpy(), out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= least)
    else:
        few = np.arange(len(scores))
    return few[np.lexsort((ids[few], -scores[few]))][:k]


def met(queries: DataFrame, blocks: DataFrame, search: Callable, score: str, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the best k of what search(query table, block table) yields for each (q, r).

    Each block of queries meets each block of rows in a task of its own: the k best of a query in a block are all that
    leaves it. The work is queries times rows, as asked; the memory of a task doesn't grow, and neither side is broadcast.
    """
    import pyarrow as pa

    kind, kept = (pa.int64(), "i8") if score == "long" else (pa.float64(), "f8")

    def run(a, b):
        found = list(search(a, b)) if a.num_rows and b.num_rows else []
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
        return pa.table([pa.array(c.astype(t), ty) for c, t, ty in zip(cols, ("i8", "i8", kept), (pa.int64(), pa.int64(), kind), strict=True)], names=["query_id", "vec_id", "score"])

    found = queries.groupBy("q", "r").cogroup(blocks.groupBy("q", "r")).applyInArrow(run, f"query_id long, vec_id long, score {score}")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def place(parts: int, salt: int) -> Column:
    """One of parts blocks, by a hash of the row."""
    return F.pmod(F.xxhash64("vec_id", "embedding", F.lit(salt)), F.lit(parts)).cast("int")


def upto(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
