"""Publishing by a commit record: tables are written to a fresh folder, counted, and only then named by a manifest.

Readers follow the newest whole manifest and nothing else, so a refused, failed or half-done publish changes nothing for them. A manifest
is one small JSON file whose name is its number; it is written beside and renamed, which fails where another writer was first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

RECORDS, DATA = "_manifests", "data"


class Refused(ValueError):
    """A publish whose tables didn't pass their check; nothing has changed."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _text(spark: SparkSession, path: str) -> str:
    fs, at = _files(spark, path)
    with_stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(with_stream)).decode()
    finally:
        with_stream.close()


def _commit(spark: SparkSession, path: str, number: int, record: dict) -> None:
    """Writes the manifest beside its place and renames it there; fails if the number is taken."""
    jvm = spark.sparkContext._jvm
    name = f"{number:012d}.json"
    fs, beside = _files(spark, f"{path}/{RECORDS}/_{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(json.dumps(record).encode())
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{RECORDS}/{name}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(beside), context.makeQualified(target), none)
    except Exception as e:
        fs.delete(beside, False)
        raise FileExistsError(f"{path}: version {number} was published by another writer meanwhile") from e


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """The whole manifests of path, oldest first; what isn't a whole one counts for nothing."""
    found = []
    for name in _names(spark, f"{path}/{RECORDS}"):
        if name[:-5].isdigit() and name.endswith(".json"):
            try:
                found.append(json.loads(_text(spark, f"{path}/{RECORDS}/{name}")) | {"number": int(name[:-5])})
            except ValueError:
                continue
    return found


def _next(spark: SparkSession, path: str) -> int:
    return max([int(n[:-5]) for n in _names(spark, f"{path}/{RECORDS}") if n[:-5].isdigit()], default=0) + 1


def current(spark: SparkSession, path: str) -> dict | None:
    found = manifests(spark, path)
    return found[-1] if found else None


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], check: Callable[[dict[str, int]], str | None] = lambda counts: None, note: dict | None = None) -> dict[str, int]:
    """Writes tables to a fresh folder, counts what was written, and makes it the current version; returns the counts.

    check may name a reason to refuse; an empty table is one in any case. All tables change together. Partitioning: a table's
    DataFrame is written as it is dealt; pass partition columns by naming the table "name by column,...".
    """
    number, folder = _next(spark, path), f"{DATA}/{uuid.uuid4().hex}"
    try:
        written, counts = {}, {}
        for spec, df in tables.items():
            name, _, by = spec.partition(" by ")
            at = f"{path}/{folder}/{name}"
            df.write.partitionBy(*[c for c in by.split(",") if c]).parquet(at)
            stored = spark.read.schema(df.schema).parquet(at)
            counts[name] = stored.count()
            within = f"/{folder}/{name}/"
            files = sorted(f[f.index(within) + len(within) :] for f in stored.inputFiles())
            written[name] = {"schema": df.schema.jsonValue(), "rows": counts[name], "files": files}
        reason = next((f"{n} has no row" for n, c in counts.items() if not c), None) or check(counts)
        if reason:
            raise Refused(f"{path} isn't published: {reason}")
        _commit(spark, path, number, {"folder": folder, "tables": written, "note": note or {}})
    except Exception:
        delete(spark, f"{path}/{folder}")
        raise
    return counts


def read(spark: SparkSession, path: str, table: str, manifest: dict | None = None, wanted: Callable[[str], bool] = lambda name: True) -> DataFrame:
    """A table of the current version, or of a given manifest: the files that it names, those wanted by name, under its schema."""
    record = manifest or current(spark, path)
    if record is None or table not in record["tables"]:
        raise FileNotFoundError(f"{path} has no published {table}")
    held = record["tables"][table]
    base = f"{path}/{record['folder']}/{table}"
    schema, files = StructType.fromJson(held["schema"]), [f for f in held["files"] if wanted(f)]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in files])


def discard_unnamed(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes the manifests before the newest keep of them, and folders that no manifest names any more; returns the folders.

    Not to be run beside a publish: a folder that isn't committed yet is named nowhere.
    """
    found = manifests(spark, path)
    for old in found[:-keep]:
        delete(spark, f"{path}/{RECORDS}/{old['number']:012d}.json")
    named = {m["folder"].rpartition("/")[2] for m in found[-keep:]}
    gone = [n for n in _names(spark, f"{path}/{DATA}") if n not in named]
    for name in gone:
        delete(spark, f"{path}/{DATA}/{name}")
    return gone
