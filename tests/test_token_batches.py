"""token_batches on odd rows against its SQL."""

import duckdb

import __spark_entry__ as entry


def test_empty_texts_and_missing_ids_like_the_sql(spark, tmp_path):
    rows = [(i, " ".join(["w"] * n) if n is not None else None, s) for i, (n, s) in enumerate([(3, "a"), (0, "a"), (1, "a"), (None, "a"), (0, "b"), (0, "b"), (9000, "b")])]
    rows += [(i, " ".join(["w"] * 3000), "c") for i in (7, 8, None, 9)]  # two a batch: which of them share one shows the order
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.part, r.id, r.batch, r.tokens) for r in entry.queries()["token_batches"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(duck.execute(entry.oracle_sql()["token_batches"]).fetchall())
    assert len(got) == len(rows)
