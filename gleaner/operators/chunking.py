"""Units, sentence packing with overlap, and chunk rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chunk_type, content_hash, count_tokens, evidence_grade

MIN_TOKENS = 40
STREAM = "(fixed-size stream — no section boundary applied)"
#: Strategy, largest tokens and overlap of the known configurations.
CONFIGS = {
    "A": ("section_pages", 600, 0.15), "B": ("section_pages", 350, 0.20), "S1": ("section_aware", 140, 0.15), "S2": ("section_aware", 210, 0.15), "S3": ("section_aware", 280, 0.15),
    "S4": ("section_aware", 420, 0.15), "S5": ("fixed_size", 140, 0.15), "S6": ("recursive", 140, 0.15), "S7": ("section_aware", 210, 0.0),
}
# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def units(blocks: DataFrame, sections: bool = True) -> DataFrame:
    """document_id, unit_no, kind, text, page_start, page_end, section..., oversized of blocks in order.

    blocks(document_id, page_number, block_no, block_type, text, oversized, section, subsection, section_path, confidence).
    A unit is a run of text (gaps and islands): a table is one of its own; with sections, so is each section, and a
    page whose section isn't detected starts anew. Lines of a unit join into a paragraph where one doesn't end a
    sentence and the next starts in lower case.
    """
    w = Window.partitionBy("document_id").orderBy("page_number", "block_no")
    table, was_table = F.col("block_type") == "table", F.coalesce(F.lag("block_type").over(w) == "table", F.lit(True))
    starts = table | was_table
    if sections:
        meta = F.struct("section", "subsection", "section_path", "confidence")
        starts = starts | ~F.lag(meta).over(w).eqNullSafe(meta) | ((F.col("page_number") != F.lag("page_number").over(w)) & (F.col("confidence") != "detected"))
    numbered = blocks.withColumn("unit_no", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    inner = Window.partitionBy("document_id", "unit_no").orderBy("page_number", "block_no")
    breaks = F.coalesce(F.lag("text").over(inner).rlike(r"[.!?][\"')\]]?\s*$") | ~F.col("text").rlike("^[a-z]"), F.lit(False))
    paragraph = numbered.withColumn("paragraph", F.sum(F.when(breaks, 1).otherwise(0)).over(inner))
    ordered = lambda c: F.sort_array(F.collect_list(F.struct("page_number", "block_no", F.col(c).alias("x"))))
    lines = paragraph.groupBy("document_id", "unit_no", "paragraph").agg(
        F.array_join(F.transform(ordered("text"), lambda s: s["x"]), " ").alias("line"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"),
        F.min(F.struct("page_number", "block_no", "block_type", "section", "subsection", "section_path", "confidence", "oversized")).alias("first"),
    )
    whole = lines.groupBy("document_id", "unit_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "line"))), lambda s: s["line"]), "\n\n").alias("text"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min("first").alias("first")
    )
    is_text = F.col("first.block_type") != "table"
    path = F.col("first.section_path") if sections else F.when(is_text, STREAM).otherwise(F.col("first.section_path"))
    return whole.select(
        "document_id", "unit_no", F.col("first.block_type").alias("kind"), "text", "page_start", "page_end", "first.section", "first.subsection", path.alias("section_path"), "first.confidence", F.coalesce("first.oversized", F.lit(False)).alias("oversized")
    )


def words(text: str) -> int:
    return len(text.split())


def tokens(text: str) -> int:
    """Same rule as the column expression count_tokens."""
    return max(1, round(words(text) * 1.3)) if text else 0


def pack(parts: list[str], limit: int, overlap: float, size: Callable[[str], int] = tokens) -> Iterator[str]:
    """Parts in runs of at most limit tokens; a run starts with the end of the one before, up to its share overlap.

    A part above the limit stands alone and passes nothing on. What is carried must leave room: if the next part
    doesn't fit behind it, that run is closed too, with a carry of its own.
    """
    sized = [(p, size(p)) for p in parts]
    run: list[tuple[str, int]] = []

    def total() -> int:
        return sum(n for _, n in run)

    for part, n in sized:
        if n > limit:
            if run:
                yield " ".join(p for p, _ in run)
            run = []
            yield part
            continue
        while run and total() + n > limit:
            yield " ".join(p for p, _ in run)
            room, keep = round(total() * overlap), len(run)
            while keep and room > 0 and run[keep - 1][1] <= room:
                keep -= 1
                room -= run[keep][1]
            run = run[keep:]
        run.append((part, n))
    if run:
        yield " ".join(p for p, _ in run)


def cascade(text: str, limit: int, separators: tuple[str, ...] = SEPARATORS, size: Callable[[str], int] = tokens) -> list[str]:
    """Pieces of at most limit tokens by the coarsest separator that splits; separators are dropped."""
    if not text.strip():
        return []
    if size(text) <= limit or not separators:
        return [text]
    pieces = [p for p in text.split(separators[0]) if p.strip()]
    if len(pieces) < 2:
        return cascade(text, limit, separators[1:], size)
    return [x for p in pieces for x in ([p] if size(p) <= limit else cascade(p, limit, separators[1:], size))]


def split_unit(text: str, strategy: str, limit: int, overlap: float, size: Callable[[str], int] = tokens) -> list[str]:
    import re

    if not text.strip():
        return []
    if strategy in ("section_pages", "recursive") and size(text) <= limit:
        return [text]
    if strategy == "recursive":
        parts = cascade(text, limit, size=size)
    else:
        parts = [s.strip() for p in text.split("\n\n") for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", p) if s.strip()]
    if strategy != "section_pages" and sum(map(size, parts)) <= limit:
        return [" ".join(parts)] if parts else []
    return list(pack(parts, limit, overlap, size))


def split_units(found: DataFrame, strategy: str, limit: int, overlap: float, size: Callable[[str], int] = tokens) -> DataFrame:
    """A row for each piece of each unit, with piece_no; packing is an order-dependent fold, done per unit in Arrow batches.

    size counts a text's tokens: by the rule, or with a tokenizer that is given.
    """
    at, kind = found.columns.index("text"), found.columns.index("kind")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            pieces = [[t] if k == "table" else split_unit(t or "", strategy, limit, overlap, size) for t, k in zip(b.column(at).to_pylist(), b.column(kind).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.list_(pa.string()))], names=[*b.schema.names, "pieces"])

    schema = T.StructType([*found.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType()))])
    return found.mapInArrow(run, schema).select(*found.columns, F.posexplode("pieces").alias("piece_no", "piece")).drop("text").withColumnRenamed("piece", "text")


def assemble(pieces: DataFrame, documents: DataFrame, config: str, benchmark: bool = False, versions: dict | None = None) -> DataFrame:
    """Chunk rows: short ones that recommend nothing dropped, then ids by section, page and count, hashes and stamps.

    documents(document_id, title, organization, publication_year, source_url, license, domains, has_evidence_grades).
    """
    sized = pieces.where(F.length(F.trim("text")) > 0).withColumn("token_count", count_tokens(F.col("text"))).withColumn("chunk_type", chunk_type(F.col("text"), F.col("kind") == "table"))
    kept = sized.where((F.col("token_count") >= MIN_TOKENS) | (F.col("chunk_type") == "recommendation")).repartition("document_id")  # once for all windows
    doc = Window.partitionBy("document_id")
    at = F.struct("unit_no", "piece_no")
    first = kept.withColumn("__first", F.min(at).over(Window.partitionBy("document_id", "section_path")))
    numbered = first.withColumn("section_idx", F.dense_rank().over(doc.orderBy("__first"))).withColumn("n", F.row_number().over(Window.partitionBy("document_id", "page_start", "section_path").orderBy("unit_no", "piece_no")))
    known = numbered.join(documents, "document_id", "left")
    part = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ids = [F.col("document_id").cast("string"), *([F.lit(config)] if benchmark else []), part("p", "page_start"), part("s", "section_idx"), part("c", "n")]
    stamp = versions or {"kb_version": "1.0", "chunking_version": "multi-v2" if benchmark else "section-v1", "embedding_version": "hashed-64"}
    return known.select(
        F.concat_ws("_", *ids).alias("chunk_id"), "document_id", F.col("title").alias("document_title"), "organization", F.col("publication_year").cast("string").alias("publication_year"), "source_url", "license", "section", "subsection", "section_path",
        F.col("confidence").alias("section_confidence"), "page_start", "page_end", "domains", "chunk_type", F.when(F.col("has_evidence_grades"), evidence_grade(F.col("text"))).alias("evidence_grade"), F.lit(None).cast("string").alias("recommendation_class"), "text",
        F.concat(F.coalesce("title", F.lit("")), F.lit(" > "), "section_path", F.lit("\n\n"), "text").alias("embedded_text"), "token_count", content_hash(F.col("text")).alias("content_hash"),
        *[F.lit(v).alias(k) for k, v in stamp.items()], F.lit(config).alias("chunking_config"), ((F.col("kind") == "table") & F.col("oversized")).alias("oversized"),
    )


def chunk_documents(blocks: DataFrame, documents: DataFrame, config: str) -> DataFrame:
    strategy, limit, overlap = CONFIGS[config]
    found = units(blocks, sections=strategy != "fixed_size")
    return assemble(split_units(found, strategy, limit, overlap), documents, config, benchmark=config.startswith("S"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """document_id with chunks by type, mean tokens and the share of inherited sections."""
    kinds = [F.count_if(F.col("chunk_type") == k).alias(k) for k in ("recommendation", "guidance", "table")]
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), *kinds, F.avg("token_count").alias("mean_tokens"), F.avg((F.col("section_confidence") == "inherited").cast("double")).alias("inherited_share"))


def text_blocks(documents: DataFrame, key: str = "doc_id", lines_per_page: int = 8) -> DataFrame:
    """documents(key, text) as blocks: a line each, pages of a fixed number of lines; for text that has no layout."""
    lines = documents.select(F.col(key).alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "text")).where(F.length(F.trim("text")) > 0)
    none = F.lit(None).cast("string")
    return lines.select("document_id", (F.col("at") / lines_per_page).cast("int").alias("page_number"), F.col("at").alias("block_no"), F.lit("text").alias("block_type"), "text", F.lit(False).alias("oversized"), none.alias("section"), none.alias("subsection"), F.lit("(no section detected)").alias("section_path"), F.lit("inherited").alias("confidence"))
