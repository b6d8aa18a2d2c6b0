"""Pages: reading order, table attachment, headers and footers, hyphens, headings and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line, filled_share, is_boilerplate_heading, is_page_number, is_worksheet_rule, squeeze, table_markdown

BAND, SHARE, SLOT_LENGTH = 50.0, 0.30, 60
NO_SECTION = "(no section detected)"


def reading_order(lines: DataFrame, band: float = 0.5) -> DataFrame:
    """lines with line_no: those that start in the left band first, then by y and x; blank lines dropped."""
    by = Window.partitionBy("document_id", "page_number").orderBy(F.when(F.col("x0") < F.col("page_width") * band, 0).otherwise(1), "y0", "x0", "text")
    return lines.where(F.length(squeeze(F.col("text"))) > 0).withColumn("line_no", F.row_number().over(by) - 1)


def usable_tables(tables: DataFrame, rows: int = 2, columns: int = 2, filled: float = 0.5, area: float = 8000.0) -> DataFrame:
    """tables(cells, bbox, page_number from 1) that are large and full enough, with markdown, oversized and page_number from 0."""
    box = F.col("bbox")
    size = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
    wide = F.coalesce(F.array_max(F.transform("cells", lambda r: F.size(r))), F.lit(0))
    kept = tables.where((F.size("cells") >= rows) & (wide >= columns) & (filled_share(F.col("cells")) >= filled) & (size >= area))
    return kept.withColumns({"markdown": table_markdown(F.col("cells")), "oversized": F.size("cells") > 40, "page_number": F.col("page_number") - 1})


def outside_tables(lines: DataFrame, tables: DataFrame, slack: float = 2.0) -> DataFrame:
    """lines without those of which a line of equal text within half a point lies in a table's box: an equi-join with a box condition."""
    box, keys = F.col("bbox"), ["document_id", "page_number"]
    within = (F.col("x0") >= box["x0"] - slack) & (F.col("y0") >= box["y0"] - slack) & (F.col("x1") <= box["x1"] + slack) & (F.col("y1") <= box["y1"] + slack)
    inside = lines.join(tables.select(*keys, "bbox"), keys).where(within).select(*[F.col(c).alias(f"__{c}") for c in [*keys, "text", "y0"]])
    same = [F.col(c) == F.col(f"__{c}") for c in [*keys, "text"]]
    return lines.join(inside, [*same, F.abs(F.col("y0") - F.col("__y0")) < 0.5], "left_anti")


def page_blocks(lines: DataFrame, tables: DataFrame, column_aware: bool = False) -> DataFrame:
    """document_id, page_number, block_no, block_type, y0, text, ...: text outside tables and the tables, by y."""
    text = outside_tables(lines, tables).select("document_id", "page_number", "y0", F.lit("text").alias("block_type"), "text", F.lit(None).cast("boolean").alias("oversized"), F.col("line_no").alias("__at"))
    grid = tables.select("document_id", "page_number", F.col("bbox.y0").alias("y0"), F.lit("table").alias("block_type"), F.col("markdown").alias("text"), "oversized", F.lit(1 << 30).alias("__at"))
    order = ["__at", "y0"] if column_aware else ["y0", "__at"]
    by = Window.partitionBy("document_id", "page_number").orderBy(*order, "text")
    return text.unionByName(grid).withColumn("block_no", F.row_number().over(by) - 1).drop("__at")


def parse_quality(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """document_id, parse_quality_pct: the share of pages that hold a block."""
    full = blocks.select("document_id", "page_number").distinct().withColumn("full", F.lit(1))
    return pages.select("document_id", "page_number").distinct().join(full, ["document_id", "page_number"], "left").groupBy("document_id").agg(F.bround(100.0 * F.count("full") / F.count("*"), 2).alias("parse_quality_pct"))


def banded(lines: DataFrame, band: float = BAND) -> DataFrame:
    """lines with zone top or bottom, by the height of the document's first page, and norm."""
    height = F.first("page_height").over(Window.partitionBy("document_id").orderBy("page_number", "line_no"))
    zone = F.when(F.col("y0") < band, "top").when(F.col("y0") > height - band, "bottom")
    return lines.withColumn("zone", zone).withColumn("norm", squeeze(F.col("text")))


def repeated_texts(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """document_id, zone, norm that stand on enough of the document's pages."""
    pages = lines.groupBy("document_id").agg(F.countDistinct("page_number").alias("pages"))
    seen = banded(lines).where("zone is not null").groupBy("document_id", "zone", "norm").agg(F.countDistinct("page_number").alias("n"))
    return seen.join(pages, "document_id").where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("pages") * share))).select("document_id", "zone", "norm", "n")


def recurring_slots(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """document_id, zone, slot (y rounded half to even) with enough lines, all short. Lines count, not pages."""
    pages = lines.groupBy("document_id").agg(F.countDistinct("page_number").alias("pages"))
    seen = banded(lines).where("zone is not null").groupBy("document_id", "zone", F.bround("y0").alias("slot")).agg(F.count("*").alias("n"), F.max(F.length("norm")).alias("longest"))
    return seen.join(pages, "document_id").where((F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("pages") * share))) & (F.col("longest") <= SLOT_LENGTH)).select("document_id", "zone", "slot", "n")


def mark_headers_footers(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """lines with is_header_footer: in a band, and repeated, a page number, or short in a recurring slot."""
    texts = repeated_texts(lines, share).select("document_id", "zone", "norm", F.lit(True).alias("__text"))
    slots = recurring_slots(lines, share).select("document_id", "zone", "slot", F.lit(True).alias("__slot"))
    rows = banded(lines).withColumn("slot", F.bround("y0")).join(texts, ["document_id", "zone", "norm"], "left").join(slots, ["document_id", "zone", "slot"], "left")
    hit = F.col("__text").isNotNull() | is_page_number(F.col("text")) | (F.col("__slot").isNotNull() & (F.length("norm") <= SLOT_LENGTH))
    return rows.withColumn("is_header_footer", F.col("zone").isNotNull() & hit).select(*lines.columns, "is_header_footer")


def dehyphenate(lines: Column) -> Column:
    """Lines with words joined over a break: a fold, since what is left of a line may join onward.

    A line that ends in a hyphen after a word character takes the next line's leading run of a-z; the rest of that
    line, if any, is the next one.
    """
    start = F.struct(F.slice(lines, 1, 0).alias("out"), F.lit(None).cast("string").alias("held"))

    def step(state: Column, line: Column) -> Column:
        held = state["held"]
        joins = held.isNotNull() & held.rlike(r"\w-\s*$") & line.rlike("^[a-z]")
        head, rest = F.regexp_extract(line, "^([a-z]+)", 1), F.ltrim(F.regexp_replace(line, "^[a-z]+", ""))
        whole = F.concat(F.regexp_replace(held, r"-[^-]*$", ""), head)
        closed = F.when(held.isNull(), state["out"]).when(joins, F.array_append(state["out"], whole)).otherwise(F.array_append(state["out"], held))
        return F.struct(closed.alias("out"), F.when(joins, F.nullif(rest, F.lit(""))).otherwise(line).alias("held"))

    return F.aggregate(lines, start, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["held"])))


def body_size(lines: DataFrame, default: float = 11.0) -> DataFrame:
    """document_id, body: the most frequent first-span size, the first met on a tie."""
    first = lines.select("document_id", "page_number", "line_no", F.get("font_sizes", 0).alias("size"))
    votes = first.where("size is not null").groupBy("document_id", "size").agg(F.count("*").alias("n"), F.min(F.struct("page_number", "line_no")).alias("at"))
    top = votes.withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("n").desc(), "at"))).where("r = 1")
    return lines.select("document_id").distinct().join(top.select("document_id", "size"), "document_id", "left").select("document_id", F.coalesce("size", F.lit(default)).alias("body"))


def generic_headings(lines: DataFrame, delta: float = 1.5, bold_below: float = 6.0, shortest: int = 3, longest: int = 120, band: float = BAND) -> DataFrame:
    """document_id, page_number, y0, level, text, is_boilerplate of lines larger than the body text, and bold or much larger."""
    over = F.get("font_sizes", 0) - F.col("body")
    text = F.trim("text")
    inside = (F.col("y0") >= band) & (F.col("y0") <= F.col("page_height") - band)
    big = (over >= delta) & ((over >= bold_below) | F.coalesce(F.col("bold"), F.lit(False)))
    return lines.join(body_size(lines), "document_id").where(inside & big & F.length(text).between(shortest, longest)).select("document_id", "page_number", "y0", F.lit("section").alias("level"), text.alias("text"), is_boilerplate_heading(text).alias("is_boilerplate"))


def tuned_headings(lines: DataFrame, levels: list[dict], numbering: str = "", band: float = BAND, factor: float = 1.5) -> DataFrame:
    """Headings by levels(name, min, max, bold): near lines of a level are one heading (gaps and islands by y).

    The first level whose range holds the size wins; a new heading starts where the gap exceeds factor times the level's least size.
    """
    size = F.get("font_sizes", 0)
    fits = [(size >= x["min"]) & (size <= x["max"]) & (F.col("bold") if x.get("bold") else F.lit(True)) for x in levels]
    level, least = F.lit(None).cast("string"), F.lit(None).cast("double")
    for x, ok in reversed(list(zip(levels, fits, strict=True))):
        level, least = F.when(ok, x["name"]).otherwise(level), F.when(ok, float(x["min"])).otherwise(least)
    found = lines.where((F.col("y0") >= band) & (F.col("y0") <= F.col("page_height") - band)).withColumn("level", level).withColumn("least", least).where("level is not null")
    w = Window.partitionBy("document_id", "page_number", "level").orderBy("y0", "x0")
    island = F.sum(F.when(F.col("y0") - F.lag("y0").over(w) > factor * F.col("least"), 1).otherwise(0)).over(w)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", F.trim("text").alias("t")))), lambda s: s["t"]), " ")
    grouped = found.withColumn("island", island).groupBy("document_id", "page_number", "level", "island").agg(F.min("y0").alias("y0"), joined.alias("text"))
    text = F.trim(F.regexp_replace("text", numbering, "")) if numbering else F.col("text")
    return grouped.select("document_id", "page_number", "y0", "level", text.alias("text"), is_boilerplate_heading(text).alias("is_boilerplate")).where(F.length("text") > 0)


def assign_sections(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """document_id, page_number, section, subsection, section_path, confidence, is_boilerplate of each page.

    A page has the state after its last heading; pages without one inherit. A chapter or section resets the
    subsection, so subsections are carried within the running chapter.
    """
    flow = Window.partitionBy("document_id").orderBy("page_number", "y0")
    top = F.col("level").isin("chapter", "section")
    marks = (
        pages.select("document_id", "page_number").distinct().withColumn("y0", F.lit(float("inf"))).withColumn("__page", F.lit(True))
        .unionByName(headings, allowMissingColumns=True)
        .withColumn("__chapter", F.sum(F.when(top, 1).otherwise(0)).over(flow))
    )
    inner = Window.partitionBy("document_id", "__chapter").orderBy("page_number", "y0")
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    own = F.count(F.when(F.col("level").isNotNull(), 1)).over(Window.partitionBy("document_id", "page_number"))
    state = marks.withColumns(
        {
            "section": last(F.when(top, F.col("text")), flow), "subsection": last(F.when(F.col("level") == "subsection", F.col("text")), inner),
            "boiler": F.coalesce(last(F.when(top, F.col("is_boilerplate")), flow), F.lit(False)), "own": own,
        }
    ).where("__page")
    path = F.concat_ws(" > ", "section", "subsection")
    return state.select(
        "document_id", "page_number", "section", "subsection", F.when(path == "", NO_SECTION).otherwise(path).alias("section_path"),
        F.when((F.col("own") > 0) & (path != ""), "detected").otherwise("inherited").alias("confidence"), F.col("boiler").alias("is_boilerplate"),
    )


def clean_lines(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Lines without headers, footers, rules and the pages of boilerplate sections."""
    kept = mark_headers_footers(lines).where(~F.col("is_header_footer") & ~is_worksheet_rule(F.col("text")))
    return kept.join(sections.where("is_boilerplate").select("document_id", "page_number"), ["document_id", "page_number"], "left_anti")


def clean_pages(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """document_id, page_number, lines: what clean_lines keeps, each line cleaned, words joined over breaks; a page without a line is dropped."""
    kept = clean_lines(lines, sections).withColumn("text", clean_line(F.col("text"))).where(F.length("text") > 0)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return kept.groupBy("document_id", "page_number").agg(ordered.alias("lines")).withColumn("lines", dehyphenate(F.col("lines")))


def drop_counters(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """document_id with the lines dropped as header or footer, as rules, and with boilerplate pages."""
    marked = mark_headers_footers(lines).join(sections.select("document_id", "page_number", "is_boilerplate"), ["document_id", "page_number"], "left")
    return marked.groupBy("document_id").agg(
        F.count_if(F.col("is_header_footer") & ~F.coalesce("is_boilerplate", F.lit(False))).alias("header_footer"),
        F.count_if(is_worksheet_rule(F.col("text")) & ~F.col("is_header_footer") & ~F.coalesce("is_boilerplate", F.lit(False))).alias("worksheet"),
        F.count_if(F.coalesce("is_boilerplate", F.lit(False))).alias("boilerplate"),
    )
