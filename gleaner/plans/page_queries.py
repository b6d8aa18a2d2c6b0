"""Queries over pages, and SQL for them: reading order, tables, headers and footers, headings and whole cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import layout
from ..sources import tables as src
from .queries import CLEANED, JOINED, LINES, _lines, _t, query

NORM = r"trim(regexp_replace(text, '[\s\x0b\x0c\x1c-\x1f\x85\xa0]+', ' ', 'g'))"
RULE = "(length(trim(text)) >= 5 AND (length(regexp_replace(trim(text), '[^.]', '', 'g')) / greatest(length(trim(text)), 1) > 0.8 OR length(regexp_replace(trim(text), '[^_-]', '', 'g')) / greatest(length(trim(text)), 1) > 0.8))"

#: SQL of lines with hf (header or footer) and boiler (their page lies in front or back matter: here each seventh page).
MARKED = LINES + f""", b AS (SELECT *, CASE WHEN y0 < 50 THEN 'top' WHEN y0 > 750 THEN 'bottom' END AS zone, {NORM} AS norm, round_even(y0, 0) AS slot FROM ln),
tx AS (SELECT b.document_id, zone, norm FROM b JOIN pg USING (document_id) WHERE zone IS NOT NULL GROUP BY b.document_id, zone, norm, pages HAVING count(DISTINCT page_number) >= greatest(1, CAST(floor(pages * 0.05::DOUBLE) AS BIGINT))),
sl AS (SELECT b.document_id, zone, slot FROM b JOIN pg USING (document_id) WHERE zone IS NOT NULL GROUP BY b.document_id, zone, slot, pages HAVING count(*) >= greatest(1, CAST(floor(pages * 0.05::DOUBLE) AS BIGINT)) AND max(length(norm)) <= 60),
mk AS (SELECT b.*, zone IS NOT NULL AND (tx.norm IS NOT NULL OR regexp_matches(lower(b.norm), '^[ivxlcdm]+$|^[0-9]{{1,4}}$') OR (sl.slot IS NOT NULL AND length(b.norm) <= 60)) AS hf, b.page_number % 7 = 0 AS boiler, {RULE} AS rule
 FROM b LEFT JOIN tx USING (document_id, zone, norm) LEFT JOIN sl USING (document_id, zone, slot))"""


def _matter(lines):
    return lines.select("document_id", "page_number").distinct().withColumn("is_boilerplate", F.col("page_number") % 7 == 0)


@query("WITH " + MARKED + " SELECT document_id, page_number, CAST(line_no AS BIGINT) AS line_no FROM mk WHERE hf")
def header_footer_lines(spark, d):
    return layout.mark_headers_footers(_lines(spark, d), 0.05).where("is_header_footer").select("document_id", "page_number", F.col("line_no").cast("long").alias("line_no"))


@query("WITH " + MARKED.replace("pages * 0.05", "pages * 0.3") + " SELECT document_id, CAST(count(*) FILTER (WHERE hf AND NOT boiler) AS BIGINT) AS header_footer, CAST(count(*) FILTER (WHERE rule AND NOT hf AND NOT boiler) AS BIGINT) AS worksheet, CAST(count(*) FILTER (WHERE boiler) AS BIGINT) AS boilerplate FROM mk GROUP BY document_id")
def cleaning_counters(spark, d):
    lines = _lines(spark, d)
    return layout.drop_counters(lines, _matter(lines))


@query("WITH RECURSIVE " + MARKED.replace("pages * 0.05", "pages * 0.3") + ", cl AS (SELECT document_id, page_number, line_no, " + CLEANED.format("text") + " AS line FROM mk WHERE NOT hf AND NOT rule AND NOT boiler), hyphenated AS (SELECT document_id, page_number, line, row_number() OVER (PARTITION BY document_id, page_number ORDER BY line_no) AS n FROM cl WHERE length(line) > 0), " + JOINED + " SELECT * FROM joined")
def cleaned_documents(spark, d):
    lines = _lines(spark, d)
    return layout.clean_pages(lines, _matter(lines))


@query("WITH " + LINES + f", x AS (SELECT *, 50.0::DOUBLE + 400 * (line_no % 2) AS x0 FROM ln WHERE length({NORM}) > 0) SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY CASE WHEN x0 < 300 THEN 0 ELSE 1 END, y0, x0, text) - 1 AS line_no, text FROM x")
def reading_orders(spark, d):
    lines = _lines(spark, d).withColumn("x0", F.lit(50.0) + 400 * (F.col("line_no") % 2))
    return layout.reading_order(lines).select("document_id", "page_number", F.col("line_no").cast("long").alias("line_no"), "text")


def _grids(lines):
    """A table on each fifth page, numbered from 1; every other one is mostly empty."""
    full = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c|d"), F.lit(" e  f ")))
    bare = F.array(F.array(F.lit("a"), F.lit("")), F.array(F.lit(" "), F.lit(None).cast("string")))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(52.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(76.0).alias("y1"))
    pages = lines.select("document_id", "page_number").distinct().where("page_number % 5 = 0")
    return pages.select("document_id", (F.col("page_number") + 1).alias("page_number"), box.alias("bbox"), F.when(F.col("page_number") % 10 == 0, full).otherwise(bare).alias("cells"))


BLOCKS = LINES + r""", gr AS (SELECT DISTINCT document_id, page_number, 52.0::DOUBLE AS y0, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| c\|d | e f |' AS text FROM ln WHERE page_number % 10 = 0),
inside AS (SELECT l.document_id, l.page_number, l.text, l.y0 FROM ln l JOIN gr ON gr.document_id = l.document_id AND gr.page_number = l.page_number WHERE l.y0 >= 50 AND l.y0 + 10 <= 78),
al AS (SELECT document_id, page_number, y0, 'text' AS block_type, text, line_no AS at_ FROM ln l WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.document_id = l.document_id AND i.page_number = l.page_number AND i.text = l.text AND abs(i.y0 - l.y0) < 0.5)
 UNION ALL SELECT document_id, page_number, y0, 'table', text, 1073741824 FROM gr)"""


@query("WITH " + BLOCKS + " SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y0, at_, text) - 1 AS block_no, block_type, y0, text FROM al")
def blocks_of_pages(spark, d):
    lines = _lines(spark, d).withColumns({"x1": F.lit(500.0), "y1": F.col("y0") + 10})
    found = layout.page_blocks(lines, layout.usable_tables(_grids(lines)))
    return found.select("document_id", "page_number", F.col("block_no").cast("long").alias("block_no"), "block_type", "y0", "text")


@query("WITH " + LINES + ", p AS (SELECT document_id, page_number, max(length(text)) > 120 AS holds FROM ln GROUP BY 1, 2) SELECT document_id, round_even(100.0::DOUBLE * count(*) FILTER (WHERE holds) / count(*), 2) AS parse_quality_pct FROM p GROUP BY 1")
def parse_qualities(spark, d):
    lines = _lines(spark, d)
    return layout.parse_quality(lines, lines.where(F.length("text") > 120))


HEADINGS = "[" + ", ".join(f"'{h}'" for h in K.BOILERPLATE_HEADINGS) + "]"


@query("WITH " + LINES + rf""", h AS (SELECT *, CASE WHEN y0 - lag(y0) OVER w > 22.5 THEN 1 ELSE 0 END AS gap FROM ln WHERE y0 >= 50 AND y0 <= 750 AND length(text) < 40 WINDOW w AS (PARTITION BY document_id, page_number ORDER BY y0)),
i AS (SELECT *, sum(gap) OVER (PARTITION BY document_id, page_number ORDER BY y0) AS island FROM h),
j AS (SELECT document_id, page_number, min(y0) AS y0, trim(regexp_replace(string_agg(trim(text), ' ' ORDER BY y0), '^[A-Z]+[0-9]*\s*', '')) AS text FROM i GROUP BY document_id, page_number, island)
SELECT document_id, page_number, y0, 'section' AS level, text, list_contains({HEADINGS}, lower({NORM})) OR regexp_matches(lower({NORM}), '^(?:annex\s+\w+|appendix\s+\w+|table of contents\s*:)') AS is_boilerplate FROM j WHERE length(text) > 0""")
def profile_headings(spark, d):
    return layout.tuned_headings(_lines(spark, d), [{"name": "chapter", "min": 20.0, "max": 26.0}, {"name": "section", "min": 15.0, "max": 17.0}], r"^[A-Z]+[0-9]*\s*")


@query("SELECT source AS document_id, CAST(count(DISTINCT doc_id) AS BIGINT) AS pages FROM documents GROUP BY source")
def usable_documents(spark, d):
    pages = _t(spark, d, "documents").select(F.col("source").alias("document_id"), (F.row_number().over(layout.Window.partitionBy("source").orderBy("doc_id")) - 1).alias("page_number"), F.concat(F.lit("page "), F.coalesce("text", F.lit(""))).alias("text"))
    return src.usable_files(src.validated(pages)).select("document_id", "pages")


@query("SELECT doc_id, lower(trim(regexp_replace(strip_accents(text), '[\\s\\x0b\\x0c]+', ' ', 'g'))) AS question FROM documents")
def normalized_questions(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.normalized_question(F.col("text")).alias("question"))
