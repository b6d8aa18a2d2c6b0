"""stored_runs searches once, however often it writes what was found."""

from gleaner.operators import lexical
from gleaner.plans import store_queries


def counted(rows, seen):
    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema)


def test_stored_runs_search_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"w{i} w{i % 3} both", "s", "en", 9) for i in range(20)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"w{i}") for i in range(6)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, search = spark.sparkContext.accumulator(0), lexical.search
    monkeypatch.setattr(store_queries.lexical, "search", lambda *a, **b: counted(search(*a, **b), seen))
    assert store_queries.stored_runs(spark, str(tmp_path)).count() > 6
    assert seen.value == search(store_queries._chunks(spark, str(tmp_path)), store_queries._asked(spark, str(tmp_path)), k=5).count()
