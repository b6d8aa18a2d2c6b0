"""Exact vector search, a deterministic embedder, and batching by a token budget."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


#: Rows of a block.
ROWS = 4096


def search(vectors: DataFrame, queries: DataFrame, k: int = 25, key: str = "vec_id", block: int = 1024) -> DataFrame:
    """query_id, rank, key, score: the k largest dot products with each of queries(query_id, embedding), in blocks.

    Queries and rows meet in blocks of bounded size; a task keeps k rows of a query, never all scores.
    """
    n = queries.count()
    parts = max(1, -(-n // block))
    blocks = queries.select("query_id", F.col("embedding").alias("wanted")).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    across = max(1, -(-vectors.count() // ROWS))
    left = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = vectors.select(key, "embedding").withColumn("at", F.pmod(F.xxhash64(key), F.lit(across)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(a, b):
        import pyarrow as pa

        out = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        q, x = (np.stack(t.column(c).to_numpy()).astype(float) for t, c in ((a, "wanted"), (b, "embedding")))
        scores, ids, qids = q @ x.T, b.column(key).to_numpy(), a.column("query_id").to_numpy()
        # Window and task round alike: a row that is dropped here can't be among the first k there. Only what reaches the k-th score is sorted.
        least = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)] - 1e-9
        near = [np.flatnonzero(s >= low) for s, low in zip(scores, least, strict=True)]
        top = [at[np.lexsort((ids[at], -np.round(s[at], 9)))[:k]] for s, at in zip(scores, near, strict=True)]
        return pa.table([np.repeat(qids, [len(t) for t in top]), np.concatenate([ids[t] for t in top]), np.concatenate([s[t] for s, t in zip(scores, top, strict=True)])], schema=out)

    found = left.groupBy("part", "at").cogroup(right.groupBy("part", "at")).applyInArrow(run, f"query_id long, {key} long, score double")
    by = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def hashed_embedding(text: Column, dim: int = 64, prefix: str = "") -> Column:
    """A deterministic stand-in for a model: signed hashed term counts of unit length, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def one(t: str | None) -> np.ndarray:
            hashes = np.fromiter((known.setdefault(w, zlib.crc32(w.encode())) for w in re.findall("[a-z0-9]+", (prefix + (t or "")).lower())), np.int64)
            v = np.bincount(hashes % dim, weights=1.0 - 2.0 * ((hashes >> 16) & 1), minlength=dim)
            return v / (np.sqrt((v * v).sum()) or 1.0)

        return texts.map(one)

    return run(F.coalesce(text, F.lit("")))


def budget_batches(lengths: Iterable[int], budget: int = 8192, cap: int | None = None) -> Iterator[list[int]]:
    """Places of the texts in batches, longest first, each of at most budget padded tokens unless one text alone exceeds it."""
    sizes = [min(n, cap) if cap else n for n in lengths]
    batch: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if batch and sizes[batch[0]] * (len(batch) + 1) > budget:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def embed(spark: SparkSession, rows: DataFrame, encode, key: str, text: str, prefix: str, dim: int, budget: int = 8192) -> DataFrame:
    """key, embedding: encode(list of texts) called with batches of a token budget; a vector of another length is an error.

    A task sorts its rows by length, longest first, and batches run on from one Arrow batch to the next: as budget_batches over the whole
    task, with one batch of texts in memory. Spark sorts and may spill. A null text is an empty one.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []
        longest = 0

        def out():
            found = encode([t for _, t in held])
            for v in found:
                if len(v) != dim:
                    raise ValueError(f"the model gave {len(v)} components, not {dim}")
            vectors = [[float(x) for x in v] for _, v in zip(held, found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], types[0]), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "embedding"])

        for b in batches:
            types = [b.schema.field(0).type]
            for k, t, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and longest * (len(held) + 1) > budget:
                    yield out()
                    held = []
                longest = n if not held else longest
                held.append((k, prefix + (t or "")))
        if held:
            yield out()

    sized = rows.select(key, text, F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).alias("__tokens"))
    return sized.sortWithinPartitions(F.col("__tokens").desc(), key).mapInArrow(run, f"{key} {kind}, embedding array<double>")
