"""A stored inverted index for BM25: built once, searched many times, exact.

Postings lie in folders by bucket of the term and carry what they add to a score but for the term's weight (their impact), in
bands of impact. The largest impact of each band of a term is stored apart, so a search knows which bands can hold one of the k best
documents before it reads any posting.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources import published
from .lexical import BROADCAST_ROWS, idf_weights

#: Parts by term; a bucket is dealt by document to SALTS tasks, since one term may stand in every document.
BUCKETS, SALTS = 64, 8
#: Bands of impact of a term, the strongest first.
BANDS = 32
#: So many times k postings give the first bound on a query's k-th score.
SEEDS = 40
#: Scores are compared with this slack: sums of doubles depend on their order a little.
SLACK = 1e-6


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(spark: SparkSession, chunks: DataFrame, path: str, key: str = "chunk_id", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> dict[str, int]:
    """Publishes the index of chunks(key, text) at path; returns the rows of its tables.

    The tables: postings(bucket, term, band, key, impact), bands(bucket, term, band, top, n), terms(bucket, term, df, idf), and stats(n,
    avgdl) over all chunks, empty ones too. A null text is an empty one; keys are taken as they come, each should stand once.
    """
    each = chunks.select(F.col(key).alias("key"), terms(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))
    counted = each.select("key", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    totals = each.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl")).first()  # one row
    stats = spark.createDataFrame([(totals["n"], totals["avgdl"])], "n long, avgdl double")
    dl, tf = F.col("dl"), F.col("tf")
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(totals["avgdl"] or 1.0)))
    band = F.least(F.lit(BANDS - 1), F.floor((k1 + 1 - F.col("impact")) / (k1 + 1) * BANDS)).cast("int")
    postings = counted.select(bucket_of(F.col("term")).alias("bucket"), "term", "key", impact.alias("impact")).withColumn("band", band)
    dealt = postings.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SALTS))).sortWithinPartitions("bucket", "term", "band")
    names = ["bucket", "term", "band", "key", "impact"]
    note = {"k1": k1, "b": b, "buckets": BUCKETS, "key": dict(chunks.dtypes)[key]}
    work = f"{path}/_building"
    kept = published.publish(spark, work, {"postings by bucket": dealt.select(*names)}, note=note) if totals["avgdl"] else {"postings": 0}
    if not kept["postings"]:
        raise published.Refused(f"{path} isn't published: no chunk has a term")
    postings = published.read(spark, work, "postings")
    bands = postings.groupBy("bucket", "term", "band").agg(F.max("impact").alias("top"), F.count("*").alias("n"))
    df = bands.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    weights = idf_weights(df.select("term", "df"), stats, epsilon).select(bucket_of(F.col("term")).alias("bucket"), "term", "df", "idf")
    tables = {"bands by bucket": bands.repartition("bucket"), "terms by bucket": weights.repartition("bucket"), "stats": stats}
    counts = published.publish(spark, path, tables, note=note | {"postings": published.current(spark, work)})
    return counts | kept


class Index:
    """The current version of an index, or of a given manifest."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.manifest = published.current(spark, path)
        if self.manifest is None:
            raise FileNotFoundError(f"{path} has no published index")
        self.note = self.manifest["note"]

    def table(self, name: str, buckets: list[int]) -> DataFrame:
        """postings, bands or terms of the buckets: no other file is read."""
        at, record = (f"{self.path}/_building", self.note["postings"]) if name == "postings" else (self.path, self.manifest)
        wanted = tuple(f"bucket={i}/" for i in buckets)
        return published.read(self.spark, at, name, record, lambda f: f.startswith(wanted))

    def search(self, queries: DataFrame, k: int = 25, positive: bool = True) -> DataFrame:
        """query_id, rank, chunk_id, score: the k best chunks for each of queries(query_id, query), as lexical.search ranks them."""
        chosen, buckets = self.chosen(queries, k)
        at = f"{self.path}/_searches/{uuid.uuid4().hex}"
        chosen.write.parquet(at)  # small, and read twice below; clean() deletes it
        chosen = self.spark.read.schema(chosen.schema).parquet(at)
        hint = self._hint(chosen)
        read = self.table("postings", buckets).select("term", "band", "key", "impact").join(hint(chosen.select("term", "band").distinct()), ["term", "band"], "left_semi")
        # dealt by key once: all that a chunk has for a query is in one task then
        met = read.repartition("key").join(hint(chosen), ["term", "band"])
        scores = met.groupBy("query_id", "key").agg(F.sum(F.col("w") * F.col("impact")).alias("score"), F.max("strong").alias("strong"), F.first("kth").alias("kth"))
        scores = scores.where(F.col("strong") & (F.col("kth").isNull() | (F.col("score") >= F.col("kth"))))
        by = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "key")
        best = scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        return (best.where("score > 0") if positive else best).select("query_id", "rank", F.col("key").alias("chunk_id"), "score")

    def clean(self) -> None:
        """Deletes what searches have left beside the index; not to be run before their results are read."""
        published.delete(self.spark, f"{self.path}/_searches")

    def _hint(self, rows: DataFrame):
        return F.broadcast if rows.count() <= BROADCAST_ROWS else (lambda x: x.hint("merge"))

    def chosen(self, queries: DataFrame, k: int) -> tuple[DataFrame, list[int]]:
        """query_id, term, band, w, strong, kth of the bands to read, and the buckets in which they lie.

        kth bounds a query's k-th score from below: it comes from the bands that add most, as few as hold SEEDS times k postings. A band is left
        out if its top and the most that the query's other terms can add stay below it. Terms whose sum of tops stays below it (the weakest
        ones) aren't strong: a chunk that has no strong term is none of the k best. Without k seeds, or with a negative weight, all is read.
        """
        spark = self.spark
        words = queries.select("query_id", F.explode(terms(F.coalesce(F.col("query"), F.lit("")))).alias("term"))
        wanted = words.groupBy("query_id", "term").agg(F.count("*").alias("qtf")).withColumn("bucket", bucket_of(F.col("term")))
        buckets = sorted(r["bucket"] for r in wanted.select("bucket").distinct().collect())  # BUCKETS at most
        if not buckets:
            return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, term string, band int, w double, strong boolean, kth double"), []
        hint = self._hint(wanted)
        weighed = self.table("terms", buckets).join(hint(wanted), ["bucket", "term"]).select("query_id", "bucket", "term", (F.col("qtf") * F.col("idf")).alias("w"))
        asked = self.table("bands", buckets).join(hint(weighed), ["bucket", "term"]).withColumn("add", F.col("w") * F.col("top"))
        most = F.greatest(F.max("add").over(Window.partitionBy("query_id", "term")), F.lit(0.0))
        asked = asked.withColumn("most", most).select("query_id", "term", "band", "w", "n", "add", "most")
        before = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("add").desc(), "term", "band").rowsBetween(Window.unboundedPreceding, -1))
        seeds = asked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SEEDS * k).select("query_id", "term", "band", "w")
        seeded = self.table("postings", buckets).select("term", "band", "key", "impact").join(hint(seeds), ["term", "band"])
        sums = seeded.groupBy("query_id", "key").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
        bound = sums.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("found"))
        negative = asked.groupBy("query_id").agg(F.min("w").alias("least")).where("least < 0")
        bound = bound.where(F.col("found") == k).join(negative, "query_id", "left_anti").select("query_id", (F.col("kth") - SLACK).alias("kth"))
        by_term = asked.select("query_id", "term", "most").distinct()
        upto = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        by_term = by_term.withColumns({"upto": upto, "total": F.sum("most").over(Window.partitionBy("query_id"))}).drop("most")
        known = asked.join(by_term, ["query_id", "term"]).join(bound, "query_id", "left")
        strong = F.col("kth").isNull() | (F.col("upto") >= F.col("kth"))
        can = F.col("kth").isNull() | (F.col("total") - F.col("most") + F.col("add") >= F.col("kth"))
        return known.where(~strong | can).select("query_id", "term", "band", "w", strong.alias("strong"), "kth"), buckets
