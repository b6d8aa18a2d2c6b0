"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Positions of the ring (a power of 2) and virtual nodes of a shard.
POSITIONS, NODES = 4096, 128


def ring(shards: int, nodes: int = NODES, positions: int = POSITIONS) -> list[list[int]]:
    """For each position the shards in the order in which a key at it meets them clockwise, each once."""
    marks: list[list[tuple[int, int]]] = [[] for _ in range(positions)]
    for shard in range(shards):
        for node in range(nodes):
            h = int.from_bytes(hashlib.sha256(f"{shard}/{node}".encode()).digest()[:8], "big")
            marks[h % positions].append((h, shard))
    seen: list[int] = []  # clockwise from the position after the current one
    for at in range(2 * positions - 1, -1, -1):
        for _, shard in sorted(marks[at % positions], reverse=True):
            seen = [shard, *(x for x in seen if x != shard)]
        if at < positions:
            marks[at] = seen  # type: ignore[assignment]
    return marks  # type: ignore[return-value]


def bounded_loads(counts: dict[int, int], shards: int, slack: float, nodes: int = NODES, positions: int = POSITIONS) -> Iterable[tuple[int, int, int, int, int]]:
    """(position, first rank, ranks, shard, first slot): where the keys of each position go.

    counts: keys at each position. With slack 0 the capacities add up to the keys and differ by one at most, so
    counts do too; otherwise each shard holds at most ceil((1 + slack) * keys / shards). Keys first fill their own
    shard; those beyond its capacity go on to the next shard clockwise, and so on. At most positions * shards rows.
    """
    total = sum(counts.values())
    if slack > 0:
        room = [math.ceil((1 + slack) * total / shards)] * shards
    else:
        room = [total // shards + (i < total % shards) for i in range(shards)]
    used, done, paths = [0] * shards, dict.fromkeys(counts, 0), ring(shards, nodes, positions)
    for step in range(shards):
        for at in sorted(counts):
            shard, left = paths[at][step], counts[at] - done[at]
            if n := min(left, room[shard] - used[shard]):
                yield at, done[at], n, shard, used[shard]
                done[at] += n
                used[shard] += n


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24, slack: float = 0.0, nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in a shard) of every row of docs(doc_id, text).

    A row's place on the ring is a hash of doc_id, size and checksum. Keys are counted by ring position (4096 counts,
    whatever the input), the ring is filled from these counts, and a row finds its shard by its rank at its position.
    Equal rows are counted before the shuffle and dealt out again after it, so no copy makes a position hot.
    Null text has size 8 and a null checksum; null ids are keys too; an empty table gives an empty result.
    """
    keys = staged(
        spark,
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
        .withColumn("hash", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "size", F.coalesce("text_crc32", F.lit(-1))))
        .withColumn("position", F.call_function("shiftrightunsigned", F.col("hash"), F.lit(52)).cast("int")),
    )
    counts = {r["position"]: r["n"] for r in keys.groupBy("position").agg(F.sum("copies").alias("n")).collect()}  # at most POSITIONS rows
    quotas = spark.createDataFrame(list(bounded_loads(counts, shards, slack, nodes)), "position int, first long, n long, shard int, base long")
    upto = Window.partitionBy("position").orderBy("hash", "doc_id", "size", "text_crc32")
    ranked = keys.withColumn("rank", F.sum("copies").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies"))
    each = ranked.select("doc_id", "size", "text_crc32", "position", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("copies") - 1)).alias("rank"))
    return (
        each.join(F.broadcast(quotas), "position")  # bounded by the ring: positions * shards rows
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
    )
