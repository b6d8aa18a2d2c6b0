"""Pages as rows with nested blocks: from lines and tables to chunks, written and read under a schema."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import chunking, documents, layout
from gleaner.sources import tables as src

LINE = src.LINES
BOX = (50.0, 500.0)


def line(doc, page, no, y, text, size=11.0, bold=False):
    return (doc, page, no, 600.0, 800.0, BOX[0], y, BOX[1], y + 10, text, [size], ["f"], bold)


@pytest.fixture(scope="module")
def parsed(spark):
    rows = []
    for page in range(6):
        rows += [line("d", page, 0, 20.0, "Running header"), line("d", page, 9, 780.0, str(page + 1))]
    rows += [line("d", 0, 1, 100.0, "Introduction", 16.0, True), line("d", 0, 2, 120.0, "A broken exam-"), line("d", 0, 3, 140.0, "ple goes on. And ﬁne ‘quotes’."), line("d", 0, 4, 160.0, "........")]
    rows += [line("d", 1, 1, 100.0, "in the same section, lower case"), line("d", 1, 2, 300.0, "cell a"), line("d", 1, 3, 400.0, "After the table.")]
    rows += [line("d", 2, 1, 100.0, "Methods", 16.0, True), line("d", 2, 2, 120.0, "We recommend rest.")]
    rows += [line("d", 3, 1, 100.0, "References", 16.0, True), line("d", 3, 2, 120.0, "Someone 2020.")]
    rows += [line("d", 4, 1, 120.0, "Someone else 2021.")]
    lines = spark.createDataFrame(rows, LINE)
    grid = [("d", 2, (40.0, 295.0, 510.0, 320.0), [["h", "i"], ["cell a", "x"]]), ("d", 2, (0.0, 0.0, 5.0, 5.0), [["small", "one"], ["a", "b"]])]
    return documents.ingest(lines, layout.usable_tables(spark.createDataFrame(grid, src.TABLES)))


def test_parsed_pages(parsed):
    pages = {r.page_number: r for r in parsed[0].collect()}
    assert sorted(pages) == list(range(6))
    kinds = [(b.block_type, b.text or b.table_markdown.split("\n")[0]) for b in pages[1].blocks]
    assert kinds == [("text", "Running header"), ("text", "in the same section, lower case"), ("table", "| h | i |"), ("text", "After the table."), ("text", "2")]
    assert (pages[1].blocks[2].table_n_rows, pages[1].blocks[2].table_n_cols, pages[1].height) == (2, 2, 800.0)


def test_cleaned_pages(parsed):
    kept = {r.page_number: r for r in documents.written_pages(parsed[1]).collect()}
    assert sorted(kept) == [0, 1, 2]  # pages 3 and 4 are references, page 5 holds header and number only, and inherits
    assert [b.text for b in kept[0].blocks] == ["Introduction", "A broken example", "goes on. And fine 'quotes'."]
    assert [b.block_type for b in kept[1].blocks] == ["table", "text", "text"]  # tables stand before the text
    assert [(kept[p].section_path, kept[p].section_confidence) for p in range(3)] == [("Introduction", "detected"), ("Introduction", "inherited"), ("Methods", "detected")]
    found = documents.page_counters(parsed[1]).first()
    assert (found.page_count, found.lines_dropped_as_boilerplate, found.lines_dropped_as_header_footer, found.lines_dropped_as_worksheet_artifact) == (6, 9, 6, 1)


def test_units_of_pages(parsed):
    units = chunking.units(documents.page_blocks(documents.written_pages(parsed[1]))).orderBy("unit_no").collect()
    assert [(u.kind, u.section_path, u.page_start, u.page_end) for u in units] == [
        ("text", "Introduction", 0, 0), ("table", "Introduction", 1, 1), ("text", "Introduction", 1, 1), ("text", "Methods", 2, 2),
    ]
    assert units[0].text == "Introduction\n\nA broken example goes on. And fine 'quotes'."


def test_pages_under_a_schema(spark, parsed, tmp_path):
    kept = documents.written_pages(parsed[1])
    path = str(tmp_path / "pages")
    src.write_pages(kept, path)
    src.write_pages(kept.withColumn("document_id", F.lit("e")), path)
    src.write_pages(kept.where("page_number = 0"), path)  # d is replaced, e stays
    got = src.read_pages(spark, path)
    assert [f"{n} {t}" for n, t in got.dtypes] == [f"{n} {t}" for n, t in spark.createDataFrame([], src.CLEANED_PAGES).dtypes]
    assert {(r.document_id, r.page_number) for r in got.collect()} == {("d", 0), ("e", 0), ("e", 1), ("e", 2)}
    assert {r.blocks[0].text for r in got.where("document_id = 'd'").collect()} == {"Introduction"}
    with pytest.raises(ValueError, match="lacks"):
        src.read_pages(spark, path, src.PARSED_PAGES)


def test_cleaned_documents_in_json(spark, parsed, tmp_path):
    names = [f"{n} {t}" for n, t in spark.createDataFrame([], src.CLEANED_DOCUMENT).drop("pages").dtypes]
    row = ("d", "Title", "Org", "2020", "https://x", "CC", ["primary-care"], 1, False, True, "ab", 6, 9, 6, 1)
    docs = spark.createDataFrame([row], ", ".join(names))
    src.write_cleaned_documents(docs, documents.written_pages(parsed[1]), str(tmp_path / "docs"))
    back, pages = src.read_cleaned_documents(spark, str(tmp_path / "docs" / "file=d"))
    assert tuple(back.first()) == row
    want = documents.written_pages(parsed[1]).orderBy("page_number").collect()
    assert [(r.page_number, r.section_path, [b.text for b in r.blocks]) for r in pages.orderBy("page_number").collect()] == [(r.page_number, r.section_path, [b.text for b in r.blocks]) for r in want]
    (tmp_path / "bad.json").write_text(json.dumps({"document_id": "x", "page_count": "many"}))
    with pytest.raises(Exception, match="(?i)malformed"):
        src.read_cleaned_documents(spark, str(tmp_path / "bad.json"))[0].collect()


def test_no_lines(spark):
    empty = spark.createDataFrame([], LINE)
    pages, cleaned = documents.ingest(empty, layout.usable_tables(spark.createDataFrame([], src.TABLES)))
    assert pages.count() == 0 == cleaned.count()
