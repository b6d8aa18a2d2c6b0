"""Every turn of a conversation is answered."""

from gleaner.plans import answer_queries, queries  # noqa: F401


def test_answers_every_turn(spark, tmp_path):
    talk = [(1, 0, "user", "mild cough since monday"), (1, 1, "assistant", "how long"), (1, 2, "user", "now chest pain"), (2, 0, "user", "bleeding")]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "Chest pain needs care. Call now."), (2, "A cough is mild. Rest.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.query_id for r in queries.QUERIES["answers"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [1000, 1001, 1002, 2000]
