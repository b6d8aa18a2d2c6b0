"""Fields of documents stamped onto rows that were built before: every known document's, and no other row changes."""

import pytest

from gleaner.plans import queries
from gleaner.sources import tables


def test_every_nation_is_known_and_other_rows_stay(spark, tmp_path):
    suppliers = [(1, 0), (2, 1), (3, 2), (4, 3), (5, 99), (6, None), (7, -1), (8, 4), (9, 5), (9, 5), (None, 3)]
    nations = [(0, "A"), (1, "B"), (2, None), (3, "C"), (3, "D"), (-1, "E"), (4, ""), (5, "F"), (None, "G"), (50, "H")]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(nations, "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    got = sorted((r.s_suppkey or 0, r.label) for r in queries.restamped(spark, str(tmp_path)).collect())
    named = [(1, "A"), (2, "B"), (4, "C"), (4, "D"), (7, "E"), (8, ""), (9, "F"), (9, "F"), (0, "C"), (0, "D")]
    assert got == sorted([*named, (3, "old"), (5, "old"), (6, "old")])  # a name that isn't set, a nation that isn't there, none


def test_only_set_fields_are_stamped_and_drift_is_an_error(spark):
    chunks = spark.createDataFrame([("a", 1, "u", None, "t"), ("b", 2, "u", "l", "t"), ("c", 3, "u", "l", "t")], "chunk string, document_id int, url string, license string, title string")
    known = "document_id int, url string, license string, title string"
    found = tables.restamp(chunks, spark.createDataFrame([(1, "v", "m", "t"), (2, None, "m", None)], known), ["url", "license"], ["title"])
    assert found.columns == chunks.columns
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, "v", "m", "t"), ("b", 2, "u", "m", "t"), ("c", 3, "u", "l", "t")]
    with pytest.raises(ValueError, match="title"):
        tables.restamp(chunks, spark.createDataFrame([(3, "v", "m", "another")], known), ["url"], ["title"])
    assert tables.restamp(chunks, spark.createDataFrame([(4, "v", "m", "another")], known), ["url"], ["title"]).count() == 3  # no row's document
