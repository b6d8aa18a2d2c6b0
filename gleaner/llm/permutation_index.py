"""Approximate nearest neighbours by a permutation index.

Each vector is represented by the order of its nearest pivots. Pivot inverted files hold, for a pivot, the rows that
have it among their first ones and at which place. A query reads the files of its own first pivots only and adds up the
footrule distance between its order and each row's; the few rows nearest by footrule are ranked again by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .vectors import best, matrix, met, place, sound, upto

#: Sampled pivots (a fixed number, of the smallest hashes; the opposite of each is a pivot too), pivots of a row that are posted, and pivots of a query whose files are read.
PIVOTS, POSTED, READ = 512, 192, 96
#: Of a block's rows the share that is ranked again, and how many at least.
SHARE, LEAST = 0.048, 20
#: Rows of an index block (its row numbers fit two bytes), and queries that meet it at a time.
BLOCK, QUERIES = 4096, 2048


def orders(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix]


def inverted_files(order: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, rows, places: the file of pivot p is rows[starts[p]:starts[p + 1]] with the place of p in each row's order."""
    n, prefix = order.shape
    at = np.argsort(order.ravel(), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(order.ravel(), minlength=pivots))])
    return starts, at // max(prefix, 1), at % max(prefix, 1)


def footrule(starts: np.ndarray, rows: np.ndarray, places: np.ndarray, order: np.ndarray, posted: int, n: int) -> np.ndarray:
    """For each of n rows the footrule distance to a query's order, less what it is for a row that shares no pivot.

    A pivot that a row doesn't post counts as at place posted.
    """
    sizes = starts[order + 1] - starts[order]
    mine = np.repeat(np.arange(len(order)), sizes)
    files = [slice(starts[p], starts[p + 1]) for p in order]
    theirs = np.concatenate([places[f] for f in files])
    return np.bincount(np.concatenate([rows[f] for f in files]), np.abs(theirs - mine) - (posted - mine), n)


def few_of_a_vector(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the keep of smallest id: copies beyond them can't be among a query's keep - 1 nearest."""
    order = np.argsort(ids, kind="stable")
    same = np.unique(x[order], axis=0, return_inverse=True)[1].ravel()
    by = np.argsort(same, kind="stable")
    first = np.searchsorted(same[by], same[by])
    kept = np.sort(order[by[np.arange(len(by)) - first < keep]])
    return ids[kept], x[kept]


def _blocks(width: int, pivots: np.ndarray, posted: int, block: int, keep: int):
    """Index blocks of rows (vec_id, embedding) as they come: ids, vectors, and the files (row numbers as differences)."""

    def pack(pa, ids: np.ndarray, x: np.ndarray):
        ids, x = few_of_a_vector(ids, x, keep)
        starts, rows, places = inverted_files(orders(x / np.sqrt((x * x).sum(1))[:, None], pivots, posted), len(pivots))
        small = x.astype("f4")
        parts = [ids, small if (small == x).all() else x, starts.astype("i4"), np.diff(rows.astype("u2"), prepend=np.uint16(0)), places.astype("u1")]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["ids", "vectors", "starts", "rows", "places"])

    def run(batches) -> Iterator:
        import pyarrow as pa

        ids, x = np.zeros(0, np.int64), np.zeros((0, width))
        for b in batches:
            more = matrix(pa.Table.from_batches([b]), width)
            ids, x = np.concatenate([ids, more[0]]), np.concatenate([x, more[1]])
            while len(ids) >= 2 * block:  # what is left at the end makes one or two blocks of half the size at least
                yield pack(pa, ids[:block], x[:block])
                ids, x = ids[block:], x[block:]
        for part in np.array_split(np.arange(len(ids)), -(-len(ids) // block)) if len(ids) else ():
            yield pack(pa, ids[part], x[part])

    return run


def nearest(queries, blocks, width: int, pivots: np.ndarray, k: int, posted: int, read: int, share: float, least: int):
    """For each query of a block, the k best of index blocks."""
    qids, q = matrix(queries, width)
    qnorm = np.sqrt((q * q).sum(1))
    order = orders(q / qnorm[:, None], pivots, read)
    for row in blocks.to_pylist():
        ids, starts = np.frombuffer(row["ids"], "i8"), np.frombuffer(row["starts"], "i4")
        x = np.frombuffer(row["vectors"], "f4" if len(row["vectors"]) == 4 * width * len(ids) else "f8").reshape(len(ids), width)
        rows = np.cumsum(np.frombuffer(row["rows"], "u2"), dtype="u2").astype(np.intp)
        places = np.frombuffer(row["places"], "u1").astype(np.int16)
        take = max(least, int(np.ceil(share * len(ids))))
        for i in range(len(qids)):
            near = np.arange(len(ids))
            if take < len(ids):
                near = np.argpartition(footrule(starts, rows, places, order[i], posted, len(ids)), take)[:take]
            near = near[ids[near] != qids[i]]
            y = x[near].astype(float)
            scores = (y * q[i]).sum(1) / (np.sqrt((y * y).sum(1)) * qnorm[i])
            top = best(scores, ids[near], k)
            yield np.full(len(top), qids[i]), ids[near][top], scores[top]


def search(
    spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, posted: int = POSTED, read: int = READ, share: float = SHARE, least: int = LEAST, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors(vec_id, embedding) found for each of queries.

    Null vectors, zero vectors and vectors with a null or non-finite component take no part; a query isn't its own
    neighbour; ties go to the smaller vec_id; shorter vectors end in zeros; empty tables give an empty result. Rows that
    repeat a vec_id are candidates each; queries that repeat one share a ranking. All rows are indexed, block by block
    where they are read and once for all queries; the pivots alone are a sample. posted must be below 256.
    """
    rows = sound(vectors, False)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n, width = seen["n"], seen["width"] or 1
    sample = rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots)
    picked = [r["embedding"] for r in sample.collect()] or [[1.0]]  # at most pivots rows
    centres = np.zeros((len(picked), width))
    for i, x in enumerate(picked):
        centres[i, : len(x)] = np.array(x) / np.sqrt(np.dot(x, x))
    centres = np.concatenate([centres, -centres])
    length = min(posted, len(centres))
    across = max(1, -(-n // block))
    shape = "ids binary, vectors binary, starts binary, rows binary, places binary"
    index = staged(spark, rows.coalesce(across).mapInArrow(_blocks(width, centres, length, block, k + 1), shape))
    asked = sound(queries, False)
    down = max(1, -(-asked.count() // QUERIES))
    left = asked.withColumn("q", place(down, 1)).withColumn("r", upto(across))
    right = index.withColumn("r", F.pmod(F.xxhash64("ids"), F.lit(across)).cast("int")).withColumn("q", upto(down))
    return met(left, right, lambda a, b: nearest(a, b, width, centres, k, length, min(read, length), share, least), "double", k)
