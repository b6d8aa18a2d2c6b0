"""A refused or failed publish leaves the version before it as it was."""

import os

import pytest
from pyspark.sql import functions as F

from gleaner.sources import published, tables


def points(spark, n, at=0):
    return spark.range(at, at + n).select(F.col("id").cast("int").alias("k"), F.array(F.col("id").cast("double")).alias("embedding"))


def test_refused_publish_keeps_the_good_version(spark, tmp_path):
    path = str(tmp_path)
    never = lambda: pytest.fail("rebuilt")
    assert tables.publish_vectors(points(spark, 5), path, "v", expected=5) == 5
    with pytest.raises(published.Refused, match="2 points were written, 5 were expected"):
        tables.publish_vectors(points(spark, 2), path, "v", expected=5)
    with pytest.raises(published.Refused, match="no row"):
        tables.publish_vectors(points(spark, 0), path, "v")
    assert tables.restore_vectors(spark, path, "v", never).count() == 5
    assert len(os.listdir(f"{path}/embedding_version=v/data")) == 1  # what was refused is gone
    assert tables.publish_vectors(points(spark, 7), path, "v") == 7
    assert tables.restore_vectors(spark, path, "v", never).count() == 7
    old = published.manifests(spark, f"{path}/embedding_version=v")[0]
    assert published.read(spark, f"{path}/embedding_version=v", "points", old).count() == 5
    assert len(published.discard_unnamed(spark, f"{path}/embedding_version=v")) == 1
    assert tables.restore_vectors(spark, path, "v", never).count() == 7 and len(published.manifests(spark, f"{path}/embedding_version=v")) == 1


def test_only_committed_versions_are_restored(spark, tmp_path):
    at = tmp_path / "embedding_version=v"
    points(spark, 3).write.parquet(str(at / "data" / "half"))  # a crash before the commit
    (at / "_manifests").mkdir()
    (at / "_manifests" / "000000000001.json").write_text('{"folder": "data/ha')  # and one within it
    assert tables.restore_vectors(spark, str(tmp_path), "v", lambda: points(spark, 4)).count() == 4
    points(spark, 9).write.mode("append").parquet(str(at / published.current(spark, str(at))["folder"] / "points"))
    assert tables.restore_vectors(spark, str(tmp_path), "v", None).count() == 4  # files that the manifest doesn't name


def test_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    tables.publish_vectors(points(spark, 5), path, "v")
    broken = points(spark, 5).withColumn("k", F.when(F.col("k") < 4, F.col("k")).otherwise(F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(Exception, match="lost"):
        tables.publish_vectors(broken, path, "v")
    assert tables.restore_vectors(spark, path, "v", None).count() == 5


def test_two_writers(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    published.publish(spark, path, {"a": points(spark, 1)})
    published.publish(spark, path, {"a": points(spark, 2)})
    monkeypatch.setattr(published, "_next", lambda *_: 2)  # as a writer that began before the second publish
    with pytest.raises(FileExistsError, match="another writer"):
        published.publish(spark, path, {"a": points(spark, 3)})
    monkeypatch.undo()
    assert published.read(spark, path, "a").count() == 2


def test_chunks_and_vectors_change_together(spark, tmp_path):
    path, chunks = str(tmp_path), points(spark, 4).select(F.col("k").cast("string").alias("chunk_id"), (F.col("k") * 200).alias("token_count"))
    assert tables.publish_chunks(chunks, points(spark, 4), path, "S1", "v") == {"chunks": 4, "over": 1}
    with pytest.raises(published.Refused, match="3 vectors for 5 chunks"):
        tables.publish_chunks(chunks.unionAll(chunks.limit(1)), points(spark, 3), path, "S1", "v")
    assert [t.count() for t in tables.read_published_chunks(spark, path, "S1")] == [4, 4]
    with pytest.raises(FileNotFoundError):
        tables.read_published_chunks(spark, path, "S2")


def test_partitioned_tables(spark, tmp_path):
    path = f"{tmp_path}/p"
    published.publish(spark, path, {"a by k": points(spark, 3)}, note={"by": "test"})
    got = published.read(spark, path, "a")
    assert got.columns == ["k", "embedding"] or set(got.columns) == {"k", "embedding"}
    assert sorted(r.k for r in got.collect()) == [0, 1, 2] and published.current(spark, path)["note"] == {"by": "test"}
    assert len(got.where("k = 1").inputFiles()) >= 1
