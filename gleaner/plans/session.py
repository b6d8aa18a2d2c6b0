"""Session set-up: executors get the package without a shared code folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors reach: in spark.checkpoint.dir, or in one of our own where that is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = tempfile.mkdtemp(prefix="gleaner-shared-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def once(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read again: what a plan uses more than once is computed once."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """A table that comes in fewer parts than there are cores is dealt out to them; a larger one stays as it is, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once in a context; a no-op afterwards."""
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="gleaner-"), "gleaner-code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(top, "gleaner")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    context.addPyFile(path)
    context._gleaner_shipped = True
