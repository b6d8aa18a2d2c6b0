"""Page objects to lines, and batches by a token budget in SQL."""

import random

import pytest

from gleaner.functions import batches
from gleaner.operators.vector import budget_batches
from gleaner.sources import spans


def page(blocks, number=0, width=600.0):
    return ("d", number, width, 800.0, blocks)


def span(text, size=11.0, font="Serif"):
    return (text, size, font)


def test_lines_of_pages(spark):
    blocks = [
        ([([400.0, 10.0, 500.0, 20.0], [span("right column")]), ([50.0, 90.0, 90.0, 99.0], [span("  "), span(" ")])],),
        (None,),
        ([([50.0, 30.0, 90.0, 40.0], [span("lower "), span(" "), span("left", 12.26, "Sans-Black")]), ([60.0, 10.0, 90.0, 20.0], [span("second", 9.949)]), ([50.0, 10.0, 55.0, 20.0], [span("first", font="X-BOLD")])],),
    ]
    rows = spark.createDataFrame([page(blocks), page([], 1), page(None, 2)], spans.PAGE_DICT)
    got = spans.lines_of_pages(rows).orderBy("page_number", "line_no").collect()
    assert [(r.line_no, r.text, r.bold, list(r.font_sizes)) for r in got] == [(0, "first", True, [11.0]), (1, "second", False, [9.9]), (2, "lower left", True, [11.0, 12.3]), (3, "right column", False, [11.0])]
    assert (got[0].x0, got[0].y1, got[0].page_height) == (50.0, 20.0, 800.0)


def test_pages_are_read_under_the_schema(spark, tmp_path):
    rows = spark.createDataFrame([page([([([1.0, 2.0, 3.0, 4.0], [span("x")])],)], n) for n in range(5)], spans.PAGE_DICT)
    rows.write.json(str(tmp_path / "pages"))
    assert spans.read_page_dicts(spark, str(tmp_path / "pages")).count() == 5
    assert sorted(r.number for r in spans.read_page_dicts(spark, str(tmp_path / "pages"), (1, 3)).collect()) == [1, 2]
    (tmp_path / "bad.json").write_text('{"document_id": "d", "number": "two"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        spans.read_page_dicts(spark, str(tmp_path / "bad.json")).collect()


def test_batches_like_a_loop(spark):
    rng = random.Random(4)
    rows = [(str(p), i, rng.choice([1, 5, 10, 40, 5000, 90000]), 8192) for p in range(3) for i in range(400)]
    batches.register(spark)
    spark.createDataFrame(rows, "part string, id long, tokens int, budget int").createOrReplaceTempView("texts_to_batch")
    got = spark.sql("SELECT * FROM token_batches(TABLE(texts_to_batch) PARTITION BY part ORDER BY (tokens DESC, id))").collect()
    for p in range(3):
        sizes = [r[2] for r in rows if r[0] == str(p)]
        want = {i: n for n, batch in enumerate(budget_batches(sizes)) for i in batch}
        assert {r.id: r.batch for r in got if r.part == str(p)} == want


@pytest.mark.parametrize("rows_a_batch", ["10000", "7"])
def test_embedder_batches_run_over_arrow_batches(spark, rows_a_batch):
    """The batches that the model sees are those of a plain loop over the task's texts, whatever Arrow cuts."""
    from gleaner.operators import vector

    rng = random.Random(6)
    sizes = [rng.choice([0, 1, 3, 9, 30, 700]) for _ in range(120)]
    rows = spark.createDataFrame([(i, " ".join(["w"] * n) or None) for i, n in enumerate(sizes)], "id long, text string").coalesce(1)

    def encode(texts):
        tag = float(hash(tuple(sorted(len(t.split()) for t in texts))) % 10**6)
        return [[float(len(texts)), tag] for _ in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = {r.id: r.embedding[0] for r in vector.embed(spark, rows, encode, "id", "text", "", 2, budget=60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {i: len(batch) for batch in budget_batches(sizes, 60) for i in batch}
    assert got == want
    with pytest.raises(Exception, match="2 components, not 3"):
        vector.embed(spark, rows, encode, "id", "text", "", 3).collect()
