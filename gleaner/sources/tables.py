"""Readers with explicit schemas, checks on what was read, and versioned Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import published

LINES = (
    "document_id string, page_number int, line_no int, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string, font_sizes array<double>, fonts array<string>, bold boolean"
)
TABLES = "document_id string, page_number int, bbox struct<x0: double, y0: double, x1: double, y1: double>, cells array<array<string>>"
CHUNKS = (
    "chunk_id string, document_id string, document_title string, organization string, publication_year string, source_url string, license string, section string, subsection string, section_path string, section_confidence string, page_start int, page_end int, domains array<string>, chunk_type string, evidence_grade string, recommendation_class string, text string, embedded_text string, token_count int, content_hash string, kb_version string, chunking_version string, embedding_version string, chunking_config string, oversized boolean"
)
QUERIES = (
    "query_id string, query string, split string, relevant_sections array<struct<document_id: string, section_path: string, page_start: int, page_end: int>>, domains array<string>, notes string"
)
CATALOGUE = (
    "document_id string, title string, organization string, tier int, enabled boolean, file string, domains array<string>, heading_profile string, license string, source_url string, publication_year string, prescribing_restricted boolean, has_evidence_grades boolean"
)
GENERATION = (
    "statements array<struct<text: string, evidence_ids: array<string>>>, excerpts array<struct<evidence_id: string, quote: string>>, limitations array<string>, conflicts array<struct<description: string, evidence_ids: array<string>>>, insufficient_evidence boolean"
)

#: A row per page; blocks in order.
PARSED_PAGES = (
    "document_id string, page_number int, width double, height double, blocks array<struct<block_type: string, y0: double, text: string, "
    "font_sizes: array<double>, bold: boolean, table_markdown: string, table_n_rows: int, table_n_cols: int, table_oversized: boolean>>"
)
CLEANED_BLOCKS = "array<struct<block_type: string, text: string, table_markdown: string, table_n_rows: int, table_n_cols: int, table_oversized: boolean>>"
CLEANED_PAGES = f"document_id string, page_number int, section string, subsection string, section_path string, section_confidence string, blocks {CLEANED_BLOCKS}"
#: A cleaned document as one JSON object.
CLEANED_DOCUMENT = (
    "document_id string, document_title string, organization string, publication_year string, source_url string, license string, domain_tags array<string>, tier int, "
    "prescribing_restricted boolean, has_evidence_grades boolean, sha256 string, page_count int, lines_dropped_as_boilerplate long, lines_dropped_as_header_footer long, "
    f"lines_dropped_as_worksheet_artifact long, pages array<struct<page_number: int, section: string, subsection: string, section_path: string, section_confidence: string, blocks: {CLEANED_BLOCKS}>>"
)

RUNS = "config_id string, split string, query_id long, rank int, chunk_id string, score double"
PROVENANCE = "rule_id string, chunk_id string, document_id string, page int, section_path string, rationale string, version string"


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON or JSON lines; a row that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multiline).json(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of documents from YAML; optional flags are false, lists empty, a year is text."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)["documents"]
    default = {"domains": [], "enabled": True, "prescribing_restricted": False, "has_evidence_grades": False}
    names = [c.split(" ")[0] for c in CATALOGUE.split(", ")]
    rows = [tuple(str(d[c]) if c == "publication_year" and d.get(c) is not None else d.get(c, default.get(c)) for c in names) for d in found]
    return spark.createDataFrame(rows, CATALOGUE)


def enabled(catalogue: DataFrame) -> DataFrame:
    return catalogue.where("enabled")


def one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key; an unknown key is an error when the result is read."""
    return rows.where(F.col(key) == value).agg(F.first(F.struct("*"), ignorenulls=True).alias("r")).select(F.when(F.col("r").isNull(), F.raise_error(F.lit(f"no {key} {value}"))).otherwise(F.col("r")).alias("r")).select("r.*")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """rows; a repeated key is an error."""
    twice = rows.groupBy(key).count().where("count > 1").select(F.first(key).alias("k")).first()
    if twice and twice["k"] is not None:
        raise ValueError(f"{key} {twice['k']} stands more than once")
    return rows


def queries_and_labels(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled queries with defaults, and a row for each of their labels."""
    filled = queries.withColumns({"relevant_sections": F.coalesce("relevant_sections", F.array().cast("array<struct<document_id: string, section_path: string, page_start: int, page_end: int>>")), "domains": F.coalesce("domains", F.array().cast("array<string>")), "notes": F.coalesce("notes", F.lit(""))})
    return filled.drop("relevant_sections"), filled.select("query_id", F.inline("relevant_sections"))


def page_sample(pages, size: int):
    """Numbers of the pages to look at: all, or size of them spread evenly."""
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(i * pages / size).cast("int")))
    return F.when(pages <= 0, F.array().cast("array<int>")).when(pages <= size, F.sequence(F.lit(0), F.greatest(pages - 1, F.lit(0)).cast("int"))).otherwise(spread)


def validated(pages: DataFrame, size: int = 5) -> DataFrame:
    """document_id, pages, usable of pages(document_id, page_number, text): usable if any sampled page holds text."""
    counts = pages.groupBy("document_id").agg(F.countDistinct("page_number").alias("pages"))
    picked = counts.select("document_id", "pages", F.explode(page_sample(F.col("pages"), size)).alias("page_number"))
    text = pages.groupBy("document_id", "page_number").agg(F.max(F.length(F.trim("text"))).alias("n"))
    return picked.join(text, ["document_id", "page_number"], "left").groupBy("document_id", "pages").agg((F.coalesce(F.max("n"), F.lit(0)) > 0).alias("usable"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that rows holds."""
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").parquet(path)


def publish_vectors(vectors: DataFrame, path: str, version: str, expected: int | None = None) -> int:
    """Publishes a version of a vector index; refuses an empty one and one with another count than expected, and then the one before stays."""
    wrong = lambda c: f"{c['points']} points were written, {expected} were expected" if expected not in (None, c["points"]) else None
    return published.publish(vectors.sparkSession, f"{path}/embedding_version={version}", {"points": vectors}, wrong)["points"]


def restore_vectors(spark: SparkSession, path: str, version: str, rebuild) -> DataFrame:
    """The published version, or what rebuild() gives where none was published."""
    at = f"{path}/embedding_version={version}"
    if published.current(spark, at) is None:
        publish_vectors(rebuild(), path, version)
    return published.read(spark, at, "points")


def restamp(chunks: DataFrame, documents: DataFrame, fields: list[str], fixed: list[str]) -> DataFrame:
    """chunks with fields from documents where those are set and differ; a change of a fixed field is an error.

    Rows of unknown documents stay as they are.
    """
    renamed = documents.select("document_id", *[F.col(c).alias(f"__{c}") for c in [*fields, *fixed]])
    joined = chunks.join(renamed, "document_id", "left")
    drift = [F.col(f"__{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in fixed]
    for c in drift:
        if not joined.where(c).isEmpty():
            raise ValueError(f"{fixed} must not change")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields}).select(*chunks.columns)


def usable_files(checked: DataFrame) -> DataFrame:
    """What validated() gave; a document without text on any sampled page is an error when the result is read."""
    said = F.concat(F.lit("no text on the sampled pages of "), F.col("document_id").cast("string"))
    return checked.where(F.when(F.col("usable"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def read_rules(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Rules of urgency from YAML, as match_rules takes them, and where each comes from; a rule without its source is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    rules, sources = {}, []
    for rule in found.get("rules", []):
        name, source = rule["id"], rule.get("source") or {}
        missing = [c for c in ("chunk_id", "document_id", "page", "section_path") if c not in source]
        if missing:
            raise ValueError(f"rule {name} lacks {missing} of its source")
        if "any_of" not in rule and "all_of" not in rule:
            raise ValueError(f"rule {name} has neither any_of nor all_of")
        every = [{"any_of": rule["any_of"]}] if "any_of" in rule else rule["all_of"]
        groups = [[f"(?i){p}" for p in (g["any_of"] if isinstance(g, dict) else [str(g)])] for g in every]
        rules[name] = (rule["label"], rule["urgency_floor"], groups)
        sources.append((name, source["chunk_id"], source["document_id"], int(source["page"]), source["section_path"], rule.get("rationale", "").strip(), str(found.get("version", "unknown"))))
    return rules, spark.createDataFrame(sources, PROVENANCE)


def read_emergency(path: str, locale: str | None = None) -> dict:
    """The texts of an urgent answer from YAML, of locale or the default one."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    own = found["locales"][locale or found.get("default_locale", "generic")]
    return {"critical_lead": found["critical_lead"].strip(), "high_lead": found["high_lead"].strip(), "label": own["label"], "number": own.get("number"), "instruction": own["instruction"].strip()}


def read_heading_profile(path: str) -> dict:
    """levels (name, min, max, bold), numbering pattern, excluded headings and body size of a document, as tuned_headings takes them."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    levels = [{"name": x["level"], "min": float(x["font_size_min"]), "max": float(x["font_size_max"]), "bold": bool(x.get("bold_required"))} for x in found.get("heading_levels") or []]
    numbering = "|".join(f"(?:{x['numbering_pattern']})" for x in found.get("heading_levels") or [] if x.get("numbering_pattern"))
    return {"levels": levels, "numbering": numbering, "excluded": found.get("exclude_headings") or [], "body": found.get("body_text_size")}


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines with pos, their order in the files: by file name, then by place in it."""
    rows = read_json(spark, path, CHUNKS)
    return rows.withColumn("pos", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))


def write_runs(runs: DataFrame, path: str) -> None:
    """runs as RUNS, by config_id and split; other configurations stay."""
    names = [c.split(" ")[0] for c in RUNS.split(", ")]
    write_partitioned(runs.select(*names), path, "config_id", "split")


def read_runs(spark: SparkSession, path: str, split: str, locked: tuple[str, ...] = ("golden",), unlock: bool = False) -> DataFrame:
    """The runs of a split; a locked split is read only on purpose."""
    if split in locked and not unlock:
        raise ValueError(f"split {split} is kept for the last measurement")
    return spark.read.schema(RUNS).parquet(path).where(F.col("split") == split)


def artifact_path(base: str, name: str, limit: int | None = None) -> str:
    """Where an artifact goes; that of a limited run never takes the place of the whole one."""
    return f"{base}/{name}" + (f"_limit{limit}" if limit else "")


def publish_chunks(chunks: DataFrame, vectors: DataFrame, path: str, config: str, version: str, ceiling: int = 512) -> dict[str, int]:
    """Publishes the chunks of a configuration with their vectors, both or neither; returns how many there are and how many exceed ceiling tokens."""
    spark, at = chunks.sparkSession, f"{path}/config_id={config}"
    wrong = lambda c: f"{c['vectors']} vectors for {c['chunks']} chunks" if c["vectors"] != c["chunks"] else None
    counted = published.publish(spark, at, {"chunks": chunks, "vectors": vectors}, wrong, {"embedding_version": version})
    over = published.read(spark, at, "chunks").agg(F.count_if(F.col("token_count") > ceiling).alias("over")).first()["over"]
    return {"chunks": counted["chunks"], "over": over}


def read_published_chunks(spark: SparkSession, path: str, config: str) -> tuple[DataFrame, DataFrame]:
    """The chunks and the vectors of a configuration, of one and the same version."""
    at = f"{path}/config_id={config}"
    record = published.current(spark, at)
    return published.read(spark, at, "chunks", record), published.read(spark, at, "vectors", record)


def write_thresholds(spark: SparkSession, path: str, signal: str, high: float, low: float) -> None:
    """The fitted thresholds of a signal, to four places, as a row of a table; other signals stay."""
    write_partitioned(spark.createDataFrame([(signal, round(high, 4), round(low, 4))], "signal string, high double, low double"), path, "signal")


def read_thresholds(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    """signal: (high, low), as sufficiency takes it; a row per signal."""
    return {r["signal"]: (r["high"], r["low"]) for r in spark.read.parquet(path).collect()}


def write_pages(pages: DataFrame, path: str, schema: str = CLEANED_PAGES) -> None:
    """Pages under their schema, a folder per document that is replaced as a whole; other documents stay."""
    from pyspark.sql.types import StructType

    kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    write_partitioned(pages.select(*kept), path, "document_id")


def read_pages(spark: SparkSession, path: str, schema: str = CLEANED_PAGES) -> DataFrame:
    """Pages of write_pages; a file that lacks a column of the schema is an error, not a column of nulls."""
    from pyspark.sql.types import StructType

    want, stored = StructType.fromDDL(schema), spark.read.parquet(path)
    if missing := [f.name for f in want if f.name not in stored.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return spark.read.schema(want).parquet(path).select(*want.names)


def read_cleaned_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and their pages from cleaned documents in JSON, an object per file; a file that doesn't fit is an error."""
    found = read_json(spark, path, CLEANED_DOCUMENT, multiline=True)
    return found.drop("pages"), found.select("document_id", F.inline("pages"))


def write_cleaned_documents(documents: DataFrame, pages: DataFrame, path: str) -> None:
    """The same written: an object per document with its pages in order. A document's pages meet in a row here, for exchange only."""
    order = ["page_number", "section", "subsection", "section_path", "section_confidence", "blocks"]
    nested = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*order)), lambda a, b: a["page_number"] - b["page_number"]).alias("pages"))
    documents.join(nested, "document_id", "left").withColumn("file", F.col("document_id")).write.partitionBy("file").mode("overwrite").json(path)
