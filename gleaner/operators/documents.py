"""Ingest as one plan: pages as rows with nested blocks, from lines and tables to cleaned pages, units and chunks.

A page is the unit that is shuffled and written, never a whole document: a document may have any number of pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_line, is_page_number, is_worksheet_rule, squeeze
from ..plans.session import once
from ..sources.tables import CLEANED_BLOCKS
from . import chunking, layout

PAGE = ["document_id", "page_number"]
#: A table sorts behind a line of the same height.
LAST = 1 << 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: Catalyst would put the expression wherever the body names it, in inner loops too."""
    return F.get(F.transform(F.array(value), body), 0)


def parsed_pages(lines: DataFrame, tables: DataFrame, slack: float = 2.0) -> DataFrame:
    """document_id, page_number, width, height, blocks: a row per page, its text lines outside tables and its tables by y.

    lines(document_id, page_number, line_no, page_width, page_height, x0, y0, x1, y1, text, font_sizes, bold) and tables as
    usable_tables gives them. Lines and tables meet in one grouping by page; whether a line lies in a table's box (it or one of
    equal text within half a point of it) is said within the page.
    """
    none = lambda t: F.lit(None).cast(t)
    item = F.struct(
        "y0", F.col("line_no").cast("int").alias("at"), "text", F.lit("text").alias("block_type"), "x0", "x1", "y1", "font_sizes", "bold",
        none("string").alias("table_markdown"), none("int").alias("table_n_rows"), none("int").alias("table_n_cols"), none("boolean").alias("table_oversized"),
    )
    of_lines = lines.select(*PAGE, F.col("page_width").alias("width"), F.col("page_height").alias("height"), item.alias("item"))
    box = F.col("bbox")
    wide = F.coalesce(F.array_max(F.transform("cells", lambda r: F.size(r))), F.lit(0))
    grid = F.struct(
        box["y0"].alias("y0"), F.lit(LAST).alias("at"), none("string").alias("text"), F.lit("table").alias("block_type"), box["x0"].alias("x0"), box["x1"].alias("x1"), box["y1"].alias("y1"),
        none("array<double>").alias("font_sizes"), none("boolean").alias("bold"), F.col("markdown").alias("table_markdown"), F.size("cells").alias("table_n_rows"), wide.alias("table_n_cols"), F.col("oversized").alias("table_oversized"),
    )
    of_tables = tables.select(*PAGE, none("double").alias("width"), none("double").alias("height"), grid.alias("item"))
    listed = lambda kind: F.collect_list(F.when(F.col("item.block_type") == kind, F.col("item")))
    grouped = of_lines.unionByName(of_tables).groupBy(*PAGE)
    pages = grouped.agg(F.max("width").alias("width"), F.max("height").alias("height"), listed("text").alias("lines"), listed("table").alias("grids"))
    within = lambda x, g: (x["x0"] >= g["x0"] - slack) & (x["y0"] >= g["y0"] - slack) & (x["x1"] <= g["x1"] + slack) & (x["y1"] <= g["y1"] + slack)
    twin = lambda x, y: (x["text"] == y["text"]) & (F.abs(x["y0"] - y["y0"]) < 0.5)
    inside = F.filter("lines", lambda x: F.exists("grids", lambda g: within(x, g)))
    kept = F.when(F.size("grids") == 0, F.col("lines")).otherwise(let(inside, lambda i: F.filter("lines", lambda x: ~F.exists(i, lambda y: twin(x, y)))))
    order = F.array_sort(F.concat(kept, "grids"), lambda a, b: _compared(a, b, "y0", "at", "text"))
    block = lambda x: F.struct(*[x[c].alias(c) for c in ("block_type", "y0", "text", "font_sizes", "bold", "table_markdown", "table_n_rows", "table_n_cols", "table_oversized")])
    return pages.select(*PAGE, "width", "height", F.transform(order, block).alias("blocks"))


def _compared(a: Column, b: Column, *fields: str) -> Column:
    out = F.lit(0)
    for c in reversed(fields):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def text_lines(pages: DataFrame) -> DataFrame:
    """The text blocks of parsed pages as lines: line_no is the place of the block."""
    each = pages.select(*PAGE, F.col("height").alias("page_height"), F.posexplode("blocks").alias("line_no", "b")).where("b.block_type = 'text'")
    return each.select(*PAGE, "page_height", "line_no", "b.y0", "b.text", "b.font_sizes", "b.bold", F.lit(0.0).alias("x0"))


def document_profiles(pages: DataFrame, share: float = layout.SHARE, band: float = layout.BAND) -> DataFrame:
    """document_id, top_height, texts, slots: what marks a line at the edge of a page as a header or footer.

    A text stands on the share of the document's pages at least, and a slot has as many lines, so the two lists are no longer than
    the lines at the edges of a page, divided by the share. All is summed up before it is shuffled.
    """
    heads = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.min_by("height", "page_number").alias("top_height"))
    zone = F.when(F.col("y0") < band, "top").when(F.col("y0") > F.col("top_height") - band, "bottom")
    edge = text_lines(pages).join(heads, "document_id").withColumns({"zone": zone, "norm": squeeze(F.col("text"))}).where("zone is not null")
    enough = F.greatest(F.lit(1), F.floor(F.col("pages") * share))
    texts = edge.groupBy("document_id", "pages", "zone", "norm").agg(F.countDistinct("page_number").alias("n")).where(F.col("n") >= enough)
    slots = edge.groupBy("document_id", "pages", "zone", F.bround("y0").alias("slot")).agg(F.count("*").alias("n"), F.max(F.length("norm")).alias("longest"))
    slots = slots.where((F.col("n") >= enough) & (F.col("longest") <= layout.SLOT_LENGTH))
    texts = texts.groupBy("document_id").agg(F.collect_set(F.struct("zone", "norm")).alias("texts"))
    slots = slots.groupBy("document_id").agg(F.collect_set(F.struct("zone", "slot")).alias("slots"))
    return heads.join(texts, "document_id", "left").join(slots, "document_id", "left").select("document_id", "top_height", "texts", "slots")


def marked_lines(pages: DataFrame, sections: DataFrame, share: float = layout.SHARE, band: float = layout.BAND) -> DataFrame:
    """The text lines of parsed pages with matter (their page is front or back matter), edge (header or footer) and rule."""
    profiles = once(document_profiles(pages, share, band), "profiles")  # of known size: few documents are broadcast, and pages aren't shuffled for them
    known = pages.join(profiles, "document_id", "left").join(sections.select(*PAGE, "is_boilerplate"), PAGE, "left")
    each = known.select(*PAGE, "top_height", "texts", "slots", F.coalesce("is_boilerplate", F.lit(False)).alias("matter"), F.posexplode("blocks").alias("at", "b"))
    zone = F.when(F.col("y0") < band, "top").when(F.col("y0") > F.col("top_height") - band, "bottom")
    each = each.where("b.block_type = 'text'").select("*", "b.y0", "b.text").withColumns({"zone": zone, "norm": squeeze(F.col("text"))})
    listed = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    repeated = listed("texts", F.struct("zone", "norm"))
    slotted = listed("slots", F.struct("zone", F.bround("y0").alias("slot"))) & (F.length("norm") <= layout.SLOT_LENGTH)
    edge = F.col("zone").isNotNull() & (repeated | is_page_number(F.col("text")) | slotted)
    return each.select(*PAGE, "at", "text", "matter", edge.alias("edge"), is_worksheet_rule(F.col("text")).alias("rule"))


def cleaned_pages(pages: DataFrame, sections: DataFrame, share: float = layout.SHARE, band: float = layout.BAND) -> DataFrame:
    """document_id, page_number, section, subsection, section_path, section_confidence, blocks and counters of each parsed page.

    sections as assign_sections gives them. Headers, footers and rules go, words are joined over line breaks, then lines are
    cleaned; tables stand before the text. A page of front or back matter, or without a block left, has an empty list of
    blocks: written_pages() drops it, page_counters() counts what was dropped.
    """
    marked = marked_lines(pages, sections, share, band)
    body = ~F.col("matter")
    prose = F.sort_array(F.collect_list(F.when(body & ~F.col("edge") & ~F.col("rule"), F.struct("at", "text"))))
    by_page = marked.groupBy(*PAGE).agg(
        F.transform(prose, lambda x: x["text"]).alias("raw"), F.count_if("matter").alias("dropped_matter"),
        F.count_if(body & F.col("edge")).alias("dropped_edge"), F.count_if(body & F.col("rule") & ~F.col("edge")).alias("dropped_rules"),
    )
    lines = by_page.select(*PAGE, F.posexplode(layout.dehyphenate(F.col("raw"))).alias("at", "text"))
    lines = lines.withColumn("text", clean_line(F.col("text"))).where(F.length("text") > 0)
    none = lambda t: F.lit(None).cast(t)
    block = F.struct(F.lit("text").alias("block_type"), "text", none("string").alias("table_markdown"), none("int").alias("table_n_rows"), none("int").alias("table_n_cols"), none("boolean").alias("table_oversized"))
    texts = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("at", block.alias("b")))).alias("texts"))
    grid = lambda b: F.struct(b["block_type"].alias("block_type"), none("string").alias("text"), *[b[c].alias(c) for c in ("table_markdown", "table_n_rows", "table_n_cols", "table_oversized")])
    grids = F.transform(F.filter("blocks", lambda b: b["block_type"] == "table"), grid)
    known = pages.select(*PAGE, grids.alias("grids")).join(sections, PAGE, "left").join(by_page.drop("raw"), PAGE, "left").join(texts, PAGE, "left")
    empty = F.array().cast(CLEANED_BLOCKS)
    blocks = F.when(F.coalesce("is_boilerplate", F.lit(False)), empty).otherwise(F.concat("grids", F.coalesce(F.transform("texts", lambda x: x["b"]), empty)))
    counters = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dropped_matter", "dropped_edge", "dropped_rules")]
    path, sure = F.coalesce("section_path", F.lit(layout.NO_SECTION)).alias("section_path"), F.coalesce("confidence", F.lit("inherited")).alias("section_confidence")
    return known.select(*PAGE, "section", "subsection", path, sure, blocks.alias("blocks"), *counters)


def page_counters(pages: DataFrame) -> DataFrame:
    """document_id, page_count and the lines dropped as front or back matter, headers or footers, and rules; of cleaned pages."""
    sums = {"dropped_matter": "lines_dropped_as_boilerplate", "dropped_edge": "lines_dropped_as_header_footer", "dropped_rules": "lines_dropped_as_worksheet_artifact"}
    return pages.groupBy("document_id").agg(F.count("*").alias("page_count"), *[F.sum(a).alias(b) for a, b in sums.items()])


def written_pages(pages: DataFrame) -> DataFrame:
    """Cleaned pages that hold a block, without counters: what is stored and chunked."""
    return pages.where(F.size("blocks") > 0).drop("dropped_matter", "dropped_edge", "dropped_rules")


def ingest(lines: DataFrame, tables: DataFrame, headings: Callable[[DataFrame], DataFrame] = layout.generic_headings, share: float = layout.SHARE) -> tuple[DataFrame, DataFrame]:
    """Parsed and cleaned pages of lines and usable tables; headings finds the headings of lines.

    Parsed pages, sections and profiles are written once: each of the passes over them would shuffle the lines anew.
    """
    pages = once(parsed_pages(lines, tables), "pages")
    sections = once(layout.assign_sections(pages, headings(text_lines(pages))), "sections")
    return pages, cleaned_pages(pages, sections, share)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Cleaned pages as the blocks that chunking.units takes."""
    each = pages.select(*PAGE, "section", "subsection", "section_path", F.col("section_confidence").alias("confidence"), F.posexplode("blocks").alias("block_no", "b"))
    text = F.when(F.col("b.block_type") == "table", F.coalesce("b.table_markdown", F.lit(""))).otherwise(F.col("b.text"))
    return each.select(*PAGE, "block_no", "b.block_type", text.alias("text"), F.coalesce("b.table_oversized", F.lit(False)).alias("oversized"), "section", "subsection", "section_path", "confidence")


def chunk_pages(pages: DataFrame, documents: DataFrame, config: str) -> DataFrame:
    """Chunks of cleaned pages; documents as chunking.assemble takes them."""
    return chunking.chunk_documents(page_blocks(pages), documents, config)
