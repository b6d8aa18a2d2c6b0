"""Relevance, ranking metrics, intervals, threshold fitting and failure analysis."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def relevant_chunks(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, chunk_id of chunks that a label of labels(query_id, document_id, section_path, page_start, page_end) names.

    A chunk is relevant if it is of the document and either of the section or of a page in the range, ends
    included; a range that runs backwards is empty. An equi-join on the document with the rest as its condition.
    """
    c, l = chunks.alias("c"), labels.alias("l")
    meets = (F.col("c.page_start") <= F.col("l.page_end")) & (F.col("l.page_start") <= F.col("c.page_end")) & (F.col("l.page_start") <= F.col("l.page_end")) & (F.col("c.page_start") <= F.col("c.page_end"))
    same = F.coalesce(F.col("c.section_path") == F.col("l.section_path"), F.lit(False))
    return c.join(l, (F.col("c.document_id") == F.col("l.document_id")) & (same | meets)).select("query_id", "chunk_id").distinct()


def judged(runs: DataFrame, relevant: DataFrame, key: str = "chunk_id") -> DataFrame:
    """runs(query_id, rank, key, ...) with rel, 1 or 0."""
    return runs.join(relevant.select("query_id", key).distinct().withColumn("rel", F.lit(1)), ["query_id", key], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def metrics_at(judgements: DataFrame, sizes: DataFrame, ks: list[int], tokens: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, by, k, precision, recall, hit, ndcg, mrr and wasted for each k; sizes(query_id, by, n_rel) names the queries that count.

    Precision divides by the rows there are; recall and nDCG are 0 without relevant rows; wasted is the share of
    tokens in rows that aren't relevant, 0 without tokens; mrr is over the whole list.
    """
    grid = sizes.select("query_id", *by, F.coalesce("n_rel", F.lit(0)).alias("n_rel"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    rows = grid.join(judgements, ["query_id", *by], "left")
    inside = F.col("rank") <= F.col("k")
    size = F.col(tokens) if tokens else F.lit(1)
    sums = rows.groupBy("query_id", *by, "k", "n_rel").agg(
        F.sum(F.when(inside, F.col("rel")).otherwise(0)).alias("found"), F.count_if(inside).alias("seen"),
        F.sum(F.when(inside, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(inside, size).otherwise(0)).alias("size"), F.sum(F.when(inside & (F.col("rel") == 0), size).otherwise(0)).alias("lost"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_rel", "k").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    return sums.select(
        "query_id", *by, "k", ratio("found", F.col("seen")).alias("precision"), ratio("found", F.col("n_rel")).alias("recall"), (F.col("found") > 0).cast("int").alias("hit"),
        F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), ratio("lost", F.col("size")).alias("wasted"),
    )


def report(scores: DataFrame, *by: str) -> DataFrame:
    """Macro means over queries for each k (and by)."""
    names = ["precision", "recall", "hit", "ndcg", "mrr", "wasted"]
    return scores.groupBy(*by, "k").agg(F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in names])


def ablation(stages: dict[str, DataFrame], relevant: DataFrame, sizes: DataFrame, ks: list[int], key: str = "chunk_id") -> DataFrame:
    """The report of each stage's runs, by one pass over all of them; a query of sizes that a stage finds nothing for counts with 0."""
    runs = None
    for name, run in stages.items():
        one = run.select("query_id", "rank", key).withColumn("stage", F.lit(name))
        runs = one if runs is None else runs.unionByName(one)
    staged = sizes.withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return report(metrics_at(judged(runs, relevant, key), staged, ks, by=("stage",)), "stage")


#: Cumulative probabilities of a Poisson number of mean 1, up to 16.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(17)]


#: Sums that a task of the bootstrap keeps before it passes them on.
SUMS = 1 << 20


def bootstrap(values: DataFrame, value: str, group: str, resamples: int = 2000, seed: int = 42, key: str = "query_id") -> DataFrame:
    """group, mean, low, high: the mean of values(key, group, value) and the 2.5 and 97.5 percentiles of its resampled means.

    A row stands in a resample as often as a Poisson number of mean 1 says that is drawn from the digest of seed, key and resample: so a
    resample is the same wherever its rows lie, weighted sums are summed up before they are shuffled, and no task holds the values. A key's
    numbers are drawn once for all its groups, and values are read once. Rows without a value don't count; a resample without a row gives no mean.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("x"))
    dealt = rows.repartition(values.sparkSession.sparkContext.defaultParallelism, "key").sortWithinPartitions("key")
    summed = dealt.mapInArrow(_resampled(resamples, seed), f"g {dict(rows.dtypes)['g']}, resample int, w double, wx double").groupBy("g", "resample").agg((F.sum("wx") / F.sum("w")).alias("m"))
    drawn = F.when(F.col("resample") < resamples, F.col("m"))
    ends = summed.groupBy("g").agg(F.max(F.when(F.col("resample") == resamples, F.col("m"))).alias("mean"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"))
    return ends.where("low is not null").select(F.col("g").alias(group), "mean", "low", "high")


def _resampled(resamples: int, seed: int):
    """Weights and weighted sums by group and resample of a task's rows (g, key, x), sorted by key; the last resample holds every row once."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        ends, cuts = [f":{i}".encode() for i in range(resamples)], np.array(POISSON)
        last, weights, sums, kind = (), None, {}, None

        def out():
            for g, both in sums.items():
                at = np.flatnonzero(both[0])
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), kind), pa.array(at, pa.int32()), pa.array(both[0][at]), pa.array(both[1][at])], ["g", "resample", "w", "wx"])
            sums.clear()

        for b in batches:
            kind = b.schema.field(0).type
            for g, k, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (k,) != last:
                    start, last = (f"{seed}" if k is None else f"{seed}:{k}").encode(), (k,)
                    drawn = np.frombuffer(b"".join([hashlib.md5(start + e).digest() for e in ends]), ">u8")[::2] >> 12  # thirteen hexadecimal digits
                    weights = np.append(np.searchsorted(cuts, drawn / 16.0**13, side="right"), 1).astype(float)
                if g not in sums:
                    if len(sums) * (resamples + 1) >= SUMS:
                        yield from out()
                    sums[g] = np.zeros((2, resamples + 1))
                sums[g][0] += weights
                sums[g][1] += weights * x
        yield from out()

    return run


def overlapping_intervals(intervals: DataFrame, group: str) -> DataFrame:
    """Pairs of groups and whether their intervals overlap; the table has a row per configuration."""
    a, b = intervals.alias("a"), intervals.alias("b")
    return a.join(b, F.col(f"a.{group}") < F.col(f"b.{group}")).select(F.col(f"a.{group}").alias("left"), F.col(f"b.{group}").alias("right"), ((F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high"))).alias("overlap"))


#: Values of a range that one task orders.
RANGE = 1_000_000


def running(rows: DataFrame, value: str, sums: list[str], parts: int | None = None) -> DataFrame:
    """rows, one for each value, with next (the next larger value) and, of each of sums, upto_<c> and total_<c>.

    Values are cut into ranges at approximate quantiles, as many as keep a range near RANGE values, so no task orders them all; only
    the sums of the ranges, parts rows at most, are ordered in one task and broadcast.
    """
    parts = parts or max(1, -(-rows.count() // RANGE))
    cuts = [] if parts == 1 else sorted(set(rows.approxQuantile(value, [i / parts for i in range(1, parts)], 0.25 / parts)))
    cell = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    cells = rows.withColumn("__cell", cell)
    inner, outer = Window.partitionBy("__cell").orderBy(value), Window.orderBy("__cell")
    upto, whole = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("__cell").agg(F.min(value).alias("__first"), *[F.sum(c).alias(c) for c in sums])
    before = totals.select("__cell", F.lead("__first").over(outer).alias("__later"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__before_{c}") for c in sums], *[F.sum(c).over(whole).alias(f"total_{c}") for c in sums])
    own = cells.withColumns({"__next": F.lead(value).over(inner), **{f"__upto_{c}": F.sum(c).over(upto) for c in sums}})
    joined = own.join(F.broadcast(before), "__cell")
    return joined.select(*rows.columns, F.coalesce("__next", "__later").alias("next"), *[(F.col(f"__upto_{c}") + F.col(f"__before_{c}")).alias(f"upto_{c}") for c in sums], *[f"total_{c}" for c in sums])


def fit_threshold(scores: DataFrame, cap: float = 0.1, edge: float = 1e-6) -> DataFrame:
    """tau, correct_refusal, false_refusal: the threshold that refuses most rows of in_domain false, at most cap of the others.

    scores(score, in_domain). Candidates lie between neighbouring distinct scores and beyond both ends; counts below
    each come from running sums over the distinct scores, not from a join. The lowest threshold wins a tie; none
    feasible gives no row.
    """
    per = scores.groupBy("score").agg(F.count_if("in_domain").alias("i"), F.count_if(~F.col("in_domain")).alias("o"))
    run = running(per, "score", ["i", "o"]).select("score", "next", F.col("upto_i").alias("i"), F.col("upto_o").alias("o"), F.col("total_i").alias("ti"), F.col("total_o").alias("to"))
    after = run.select(F.coalesce((F.col("score") + F.col("next")) / 2, F.col("score") + edge).alias("tau"), "i", "o", "ti", "to")
    before = per.agg((F.min("score") - edge).alias("tau"), F.lit(0).alias("i"), F.lit(0).alias("o"), F.sum("i").alias("ti"), F.sum("o").alias("to")).where("tau is not null")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    each = before.unionByName(after).select("tau", share("o", "to").alias("correct_refusal"), share("i", "ti").alias("false_refusal"))
    return each.where(F.col("false_refusal") <= cap).orderBy(F.col("correct_refusal").desc(), "tau").limit(1)


def _nth(i: Column, value: str) -> Column:
    """The value at place i from 0 in sorted order, of running() over a count n."""
    return F.min(F.when(F.col("upto_n") > i, F.col(value)))


def percentiles(scores: DataFrame, value: str, ps: list[float]) -> DataFrame:
    """p<p> of each of ps, interpolated between neighbours; nulls without a value. Nulls of value don't count."""
    run = running(scores.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), value, ["n"])
    at = {p: (F.col("total_n") - 1) * (p / 100) for p in ps}
    ends = run.agg(F.max("total_n").alias("total_n"), *[_nth(f(h), value).alias(f"{e}{i}") for i, h in enumerate(at.values()) for e, f in (("low", F.floor), ("high", F.ceil))])
    return ends.select(*[(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (h - F.floor(h))).alias(f"p{p:g}".replace(".", "_")) for i, (p, h) in enumerate(at.items())])


def latency_summary(runs: DataFrame, value: str) -> DataFrame:
    """median: the upper one; p95: by nearest rank; nulls of value don't count."""
    run = running(runs.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), value, ["n"])
    n = F.col("total_n")
    return run.agg(_nth(F.floor(n / 2), value).alias("median"), _nth(F.least(F.floor(n * 0.95), n - 1), value).alias("p95"))


def section_histogram(chunks: DataFrame) -> DataFrame:
    """chunks_in_section, sections: a histogram of group sizes by two aggregations."""
    return chunks.groupBy("document_id", "section_path").agg(F.count("*").alias("chunks_in_section")).groupBy("chunks_in_section").agg(F.count("*").alias("sections"))


def duplicate_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("content_hash").agg(F.count("*").alias("copies")).where("copies > 1")


def fully_retrieved(runs: DataFrame, relevant: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """query_id, relevant, found, complete for queries with several relevant rows: containment in the first k."""
    top = runs.where(F.col("rank") <= k).select("query_id", key).distinct().withColumn("in_top", F.lit(1))
    return relevant.join(top, ["query_id", key], "left").groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("in_top").alias("found")).where("relevant > 1").withColumn("complete", F.col("relevant") == F.col("found"))


def generation_metrics(runs: DataFrame) -> DataFrame:
    """Outcomes, statement and refusal rates of runs(outcome, status, sufficiency, statements, dropped)."""
    refused = F.col("status") == "refused"
    return runs.agg(
        F.count("*").alias("runs"), F.avg((F.col("outcome") != "failed").cast("double")).alias("completion"), (F.avg((F.col("outcome") != "failed").cast("double")) >= 0.95).alias("complete_enough"),
        F.count_if(refused & F.col("sufficiency").isNull()).alias("refused_before_retrieval"), F.count_if(refused & F.col("sufficiency").isin("INSUFFICIENT", "OUT_OF_SCOPE")).alias("refused_by_gate"),
        F.count_if(refused & F.col("sufficiency").isin("SUFFICIENT", "PARTIAL")).alias("refused_after_generation"), F.sum("statements").alias("statements"), F.sum("dropped").alias("dropped"),
    )


def validity_rates(statements: DataFrame, excerpts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: how many statements, citations and excerpts were checked, and the shares that were kept, resolve, and stand verbatim.

    statements and excerpts as the resolvers give them; without any of a kind its share is null.
    """
    known = evidence.select("query_id", "evidence_id").distinct().withColumn("known", F.lit(1))
    cited = statements.select("query_id", F.explode("evidence_ids").alias("evidence_id")).join(known, ["query_id", "evidence_id"], "left")
    share = lambda c: F.avg(c.cast("double"))
    one = statements.agg(F.count("*").alias("statements"), share(F.col("valid")).alias("statements_kept"))
    two = cited.agg(F.count("*").alias("citations"), share(F.col("known").isNotNull()).alias("citations_valid"))
    three = excerpts.agg(F.count("*").alias("excerpts"), share(F.col("valid")).alias("excerpts_verbatim"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))  # a row each


def gate_scores(packed: DataFrame) -> DataFrame:
    """query_id, score of pack_summary's rows: the signal that the sufficiency gate would look at."""
    return packed.select("query_id", F.coalesce("top_rerank_score", "top_rrf_score").alias("score"))


def best_configuration(values: DataFrame, group: str, value: str) -> DataFrame:
    """The group of largest mean, the first by name on a tie."""
    return values.groupBy(group).agg(F.avg(value).alias("mean")).orderBy(F.round("mean", 12).desc(), group).limit(1)
