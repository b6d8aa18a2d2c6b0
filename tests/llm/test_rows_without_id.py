"""Rows without an id stay, whatever slot of the mask the dropped ids fall into."""

from gleaner.llm import common, ngram_join


def test_rows_without_id_stay(spark, monkeypatch):
    monkeypatch.setattr(common, "MASK_BITS", 1)
    rows = [(None, "one two three"), (None, "one two three"), (None, None), (None, None), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")]
    kept = ngram_join.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [*rows[:5], rows[6]]))
