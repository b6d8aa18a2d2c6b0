"""Copies of a page say nothing about what a site repeats."""

import pytest

from gleaner.llm import html_text


@pytest.mark.parametrize("others", [0, 3, 8])
def test_copies_without_article_elements_keep_their_text(spark, others):
    page = lambda i: f"<div class='box'>Same on every page</div><div class='body'><p>Text {i}</p></div>"
    rows = [(i, f"http://h.example/{i % 7}", page("copy")) for i in range(60)] + [(i, "http://h.example/0", page("copy")) for i in [99] * 40]
    rows += [(1000 + i, f"http://h.example/o{i}", page(i)) for i in range(others)] + [(2000, "http://other.example/", page("copy")), (2001, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [(r.page_id, r.text) for r in html_text.extract_text(spark, pages).collect()]
    box = "Same on every page\n" if 1 + others < html_text.PAGES else ""
    alone = {2000: "Same on every page\nText copy", 2001: ""}
    assert sorted(got) == sorted((i, alone[i] if i in alone else box + (f"Text {i - 1000}" if i >= 1000 else "Text copy")) for i, *_ in rows)
    assert {(r.host, r.pages) for r in html_text.style_tree(pages).collect()} == {("h.example", 1.0 + others), ("other.example", 1.0)}
