"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = tempfile.mkdtemp(prefix="gleaner-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged_at(spark: SparkSession, df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """As staged(), in folders by the columns by, and the folder of all."""
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: The folders of staged() since the innermost scratch() began; null outside of one.
_since: ContextVar[list[str] | None] = ContextVar("since", default=None)


def staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: cuts lineage, and every later use sees the same rows."""
    rows, path = staged_at(spark, df)
    if (paths := _since.get()) is not None:
        paths.append(path)
    return rows


def staged_parts(spark: SparkSession, df: DataFrame, by: str) -> Callable[[int], tuple[DataFrame, str]]:
    """As staged(), in a folder for each value of by: a function from such a value to its rows (none if it has no folder), without the column by, and the folder."""
    _, path = staged_at(spark, df, by)
    if (paths := _since.get()) is not None:
        paths.append(path)
    schema = df.drop(by).schema

    def part(value: int) -> tuple[DataFrame, str]:
        at = spark._jvm.org.apache.hadoop.fs.Path(found := f"{path}/{by}={value}")
        known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(schema).parquet(found) if known else spark.createDataFrame([], schema), found

    return part


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At its end, the folders of all staged() calls inside are deleted: what was made of them must have been written by then."""
    token = _since.set([])
    try:
        yield
    finally:
        for path in _since.get():
            discard(spark, path)
        _since.reset(token)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of staged_at() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_memory() -> None:
    """Gives what this process has freed back to the system (glibc keeps it otherwise): a Python worker that waits stays small."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches, at: int, rows: int, size: int) -> Iterator:
    """Parts of Arrow batches of so many rows, and so many bytes in the text column at, at most, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        ends, start = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < b.num_rows:
            to = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
            to = min(start + rows, max(start + 1, to))
            yield b.slice(start, to - start)
            start = to
        release_memory()


def unit_interval(text: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the MD5 of text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


#: Bits of a mask, whatever the input.
MASK_BITS = 1 << 24


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MASK_BITS))


def split_among(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among those of wanted(key), and the rows whose key surely isn't.

    A mask of MASK_BITS bits is broadcast (2 MB at most), so the second part goes nowhere; the first holds all
    wanted rows and, while wanted is well below MASK_BITS, few others.
    """
    mask = wanted.select(_slot(F.col(key)).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__mask"))
    place = F.bitmap_bit_position(_slot(F.col(key)))
    byte = F.conv(F.hex(F.substring(F.col("__mask"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    marked = rows.join(F.broadcast(mask), F.bitmap_bucket_number(_slot(F.col(key))) == F.col("__bucket"), "left")
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)
