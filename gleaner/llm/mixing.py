"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, unit_interval

#: A size bucket of a source has 2**SPLIT_BITS cells, twice as many with each doubling of the table beyond ROWS rows. Cells are ranges of one order, so their number doesn't change what is drawn.
SPLIT_BITS, ROWS, HASH_BITS = 6, 6_400_000, 60


def size_bucket(size: Column) -> Column:
    """Grows with size; its leading three bits."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0)).cast("int"))).cast("int")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sources(source, source_size) with target: share of all sizes divided by weight, none above cap times its own size.

    Weights go to the sources in code-point order (null last) and repeat. The excess of full sources goes to
    the others by weight: source i is full if its cap/weight is at most the level that the sources with a
    larger cap/weight would reach. One row per source, so the windows hold statistics only.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (order % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("open", F.col("level") < F.col("limit") / F.col("weight"))
    )
    reached = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    return level.select("source", "source_size", F.least("limit", F.coalesce(reached * F.col("weight"), F.col("limit"))).alias("target"))


def mix_sources(
    spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", whole: bool = False
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of docs(doc_id, text, source).

    A document's expected copies are its source's target / source_size. Their prefix sum runs over the source's
    documents by size bucket and then by a hash of id and text, so each stretch of sizes is drawn alike; one offset per
    source is added, and a document is emitted once for each integer that its stretch of the sum crosses. The sum is the
    rank times a constant. The order is the same for every number of rows; the rank in it is a count over cells plus a
    rank within a cell, and the count has two levels (groups of cells, cells of a group): no task holds a source.
    Null text has size 0; a null source is a source of its own; repeated rows each count; an empty table
    gives an empty result; sources without words have target 0 and nothing is taken. With whole, the result has the
    columns of docs and copies instead; names that start with two underscores are used inside.
    """
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    bits = SPLIT_BITS + max(0, math.ceil(math.log2(max(1, docs.count()) / ROWS)))
    sized = docs.select(
        "doc_id",
        "source",
        (F.struct(*docs.columns) if whole else F.lit(0)).alias("__row"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(told.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
    ).withColumns(
        {
            "bucket": size_bucket(F.col("size")),
            "part": F.shiftright("hash", HASH_BITS - bits),
            "key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),  # never null, so that the window and the join share a shuffle
        }
    )
    if not whole:
        sized = staged(spark, sized)
    cell, group = ["key", "bucket", "part"], ["key", "bucket", "high"]
    cells = staged(spark, sized.groupBy("source", *cell).agg(F.count("*").alias("n"), F.sum("size").alias("words")).withColumn("high", F.shiftright("part", bits - SPLIT_BITS)))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    preceding = lambda by, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = cells.groupBy(*group).agg(F.sum("n").alias("n")).withColumn("first", preceding(["key"], "bucket", "high")).drop("n")
    starts = (
        cells.withColumn("inner", preceding(group, "part"))
        .join(groups, group)
        .withColumn("start", F.col("first") + F.col("inner"))
        .alias("c")
        .join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select(*(f"c.{x}" for x in cell), "start", "source_size", "target")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit_interval(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00"))))
    inside = Window.partitionBy(*cell).orderBy("hash", "size", F.col("doc_id").asc_nulls_last())
    drawn = (
        sized.withColumn("rank", F.row_number().over(inside))
        .join(starts, cell)
        .select("doc_id", "source", "__row", "size", "source_size", "target", (F.col("start") + F.col("rank")).alias("rank"))
        .withColumn("rate", rate)
        .withColumn("offset", offset)
        .withColumn("copies", F.least(F.floor(F.col("offset") + F.col("rate") * F.col("rank")) - F.floor(F.col("offset") + F.col("rate") * (F.col("rank") - 1)), F.ceil("rate")))
    )
    if whole:
        return drawn.select("__row.*", F.col("copies").alias("__copies"))
    return drawn.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; its columns stay."""
    drawn = mix_sources(spark, docs, whole=True, **options).where("__copies > 0")
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
