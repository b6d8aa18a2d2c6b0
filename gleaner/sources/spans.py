"""Pages as nested spans, a JSON object a page (blocks of lines of spans), read under a schema and flattened to lines within the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import looks_bold, squeeze
from .tables import read_json

PAGE_DICT = (
    "document_id string, number int, width double, height double, blocks array<struct<lines: array<struct<bbox: array<double>, "
    "spans: array<struct<text: string, size: double, font: string>>>>>>"
)


def read_page_dicts(spark: SparkSession, path: str, pages: tuple[int, int] | None = None) -> DataFrame:
    """Page objects from JSON lines, those numbered from pages[0] to before pages[1] if given (other objects leave in the scan)."""
    found = read_json(spark, path, PAGE_DICT)
    return found.where((F.col("number") >= pages[0]) & (F.col("number") < pages[1])) if pages else found


def lines_of_pages(pages: DataFrame, band: float = 0.5) -> DataFrame:
    """LINES of tables.py from page objects: left band first, then by y and x, then as they came; nothing is shuffled.

    Spans of white space only are dropped, and lines without another span; blocks without lines (images) hold none. Sizes are rounded
    to a tenth, a line is bold if any of its spans is.
    """
    lines = F.flatten(F.transform("blocks", lambda b: F.coalesce(b["lines"], F.array().cast("array<struct<bbox: array<double>, spans: array<struct<text: string, size: double, font: string>>>>"))))
    solid = lambda s: F.length(squeeze(F.coalesce(s["text"], F.lit("")))) > 0
    kept = F.transform(lines, lambda x, i: F.struct(x["bbox"].alias("box"), F.filter(x["spans"], solid).alias("spans"), i.alias("i")))
    left = lambda x: F.when(x["box"][0] < F.col("width") * band, 0).otherwise(1)
    keyed = F.transform(F.filter(kept, lambda x: F.size(x["spans"]) > 0), lambda x: F.struct(left(x).alias("side"), x["box"][1].alias("y"), x["box"][0].alias("x"), x["i"].alias("i"), x["box"].alias("box"), x["spans"].alias("spans")))
    each = pages.select("document_id", F.col("number").alias("page_number"), F.col("width").alias("page_width"), F.col("height").alias("page_height"), F.posexplode(F.sort_array(keyed)).alias("line_no", "l"))
    spans, box = F.col("l.spans"), F.col("l.box")
    return each.select(
        "document_id", "page_number", "line_no", "page_width", "page_height", *[box[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.array_join(F.transform(spans, lambda s: s["text"]), "").alias("text"),
        F.transform(spans, lambda s: F.bround(s["size"], 1)).alias("font_sizes"), F.transform(spans, lambda s: s["font"]).alias("fonts"), F.exists(spans, lambda s: looks_bold(s["font"])).alias("bold"),
    )
