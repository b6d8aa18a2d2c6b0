"""Ranked lexical search: term-bucketed postings, joined with the items' terms, scored in whole numbers.

Defined results. Every row is a document of its own, so a repeated row is ranked twice; its doc_id may be null (last among
equal scores). A null or termless text is no document: it counts nowhere. Repeated items of one item_id count as one item
whose terms add up; an item without a term finds nothing. Empty tables give an empty result. Only the named columns are
read, so further columns may bear any name.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, slices, staged_at

#: Parts of the postings by term; each is dealt by document to SALTS tasks, since one term may stand in every document.
BUCKETS, SALTS = 64, 16
#: Up to so many asked terms, and terms of items, are broadcast; beyond that both sides are shuffled by term.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 1 << 25
#: Terms are runs of ASCII letters, digits and whatever isn't ASCII: bytes of other kinds end one, A-Z become a-z.
TERM_BYTES = bytes((b + 32 if 65 <= b < 91 else b) if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(TERM_BYTES).split()


def item_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """item, term, times of items(key, text)."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 1, 10_000, 1 << 22):
            for item, text in zip(b.column(0), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for part in _parts(Counter(terms(text or b""))):
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(part), b.schema.field(0).type), pa.array([t for t, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part], pa.int64())], ["item", "term", "times"])

    each = items.select(F.col(key).alias("item"), "text")
    found = each.mapInArrow(run, f"item {dict(each.dtypes)['item']}, term string, times long")
    return found.groupBy("item", "term").agg(F.sum("times").alias("times"))


def _parts(counts: Counter, size: int = 50_000) -> list[list[tuple[bytes, int]]]:
    pairs = list(counts.items())
    return [pairs[i : i + size] for i in range(0, len(pairs), size)]


def postings(spark: SparkSession, docs: DataFrame, asked: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, str]:
    """bucket, row, doc_id, n, term, tf of docs(key, text), written by bucket of the term; and the folder.

    A document also has one row without a term, in bucket -1, for the counts over all documents. asked(term), where given and
    small enough to broadcast, leaves other terms out before anything is shuffled.
    """
    import pyarrow as pa

    wanted = None
    if asked is not None and _small(asked):
        wanted = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in asked.collect()))

    def run(batches):
        for b in slices(batches, 2, 2_000, 1 << 22):
            row, doc, n, term, tf = [], [], [], [], []
            for r, d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = terms(text or b"")
                if not words:
                    continue
                counts = Counter(words if wanted is None else [w for w in words if w in wanted.value])
                row += [r] * (len(counts) + 1)
                doc += [d] * (len(counts) + 1)
                n += [len(words)] * (len(counts) + 1)
                term += [None, *counts]
                tf += [0, *counts.values()]
            arrays = [pa.array(row, pa.int64()), pa.array(doc, b.schema.field(1).type), pa.array(n, pa.int64()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n", "term", "tf"])

    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), "text")
    found = each.mapInArrow(run, f"row long, doc_id {dict(each.dtypes)['doc_id']}, n long, term string, tf long")
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
    found = found.withColumn("bucket", bucket)
    return staged_at(spark, found.repartition("bucket", F.pmod("row", F.lit(SALTS))), "bucket")


def _small(rows: DataFrame) -> bool:
    """Whether rows(term) are few and short enough to be broadcast."""
    found = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("size")).first()
    return found["n"] <= BROADCAST_ROWS and (found["size"] or 0) <= BROADCAST_BYTES


def scored_postings(posted: DataFrame, asked: DataFrame, hint) -> DataFrame:
    """row, doc_id, term, part: what each posting of an asked term adds to an item's score; all whole numbers but the logarithm."""
    stats = posted.where("bucket = -1").agg(F.count("*").alias("docs"), F.sum("n").alias("all_terms"))
    df = posted.where("bucket >= 0").groupBy("term").agg(F.count("*").alias("df")).join(asked, "term", "left_semi").crossJoin(F.broadcast(stats))
    weight = F.floor(1000 * F.log((2 * F.col("docs") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weights = df.select("term", weight.cast("long").alias("w"), "docs", "all_terms")
    m = "(25 + (75 * n * docs) div all_terms)"
    part = F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 8 * {m}))")
    return posted.where("bucket >= 0").join(hint(weights), "term").select("row", "doc_id", "term", part.alias("part"))


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", doc_key: str = "doc_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of docs(doc_key, text) for each of items(key, text), of scores above 0.

    What a document's postings add is dealt by document, so that its sum for an item needs no second shuffle, and only k
    rows an item and task meet in the window. The postings stay in the shared folder until the result has been read.
    """
    wanted, at = staged_at(spark, item_terms(items, key))
    asked = wanted.select("term").distinct()
    few = _small(asked)
    hint = F.broadcast if few and _small(wanted) else (lambda x: x)
    posted, _ = postings(spark, docs, asked, doc_key)
    parts = scored_postings(posted, asked, F.broadcast if few else (lambda x: x)).repartition("row")
    met = parts.join(hint(wanted), "term")
    scores = met.groupBy("item", "row", "doc_id").agg(F.sum(F.col("part") * F.col("times")).alias("score")).where("score > 0")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    ranked = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
