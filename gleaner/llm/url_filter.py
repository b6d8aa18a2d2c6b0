"""URL filter: rules on host and path decide where one fits; elsewhere two character language models do.

Both models are Markov models of variable order over the bytes of lower-cased URLs, one of those that the rules allow and
one of those that they block. A URL's score is the difference of its two log-likelihoods for each byte, and the least
score that is allowed is calibrated on URLs that no model has seen.

Defined results. A null URL has no host, path or bytes: no rule fits it and its score is 0. Repeated rows count as often
as they stand and are judged alike. Without allowed or without blocked URLs to learn from, that model gives each byte the
same probability; without either among the held-out ones the threshold is 0. An empty table gives an empty result. Only the key
and the URL are read of the table, so further columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, staged_at

#: Rules of the contract: the verdict, and host and path in one.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Contexts have up to so many bytes; a gram (a context and the byte after it) fits a long.
ORDER = 5
#: A gram stays in a model if it has this share of the model's grams of its length, so a model has at most as many of each.
SHARE = 1 << 16
#: Weight of what the next shorter context says, in counts.
MASS = 4.0
#: One URL in FOLDS, by its checksum, is kept from the models for the threshold.
FOLDS = 5
#: Scores are counted for the threshold in steps of 1/STEPS, up to LIMIT on either side.
STEPS, LIMIT = 64, 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = np.arange(256, dtype=np.int64)
LOWERED[65:91] += 32


def host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, the one of the longer host among equally long ones; else null."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        on, _, rest = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def grams(values: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the gram at each of values (the bytes of URLs that end at ends), or -1 where the URL begins too late."""
    begins = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0))
    at, gram = np.arange(len(values)) - begins, values
    for k in range(ORDER + 1):
        if k:
            gram = gram.copy()
            gram[k:] |= values[:-k] << (8 * k)
        yield np.where(at >= k, gram | ((k + 1) << 56), -1)


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of all URLs of an Arrow column, and where each URL ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    return LOWERED[np.frombuffer(b"".join(texts.to_pylist()), np.uint8)], ends


def _counted(batches):
    """(accepted, url) to (accepted, gram, n), counted within a part of a batch."""
    import pyarrow as pa

    for b in slices(batches, 1, 10_000, 1 << 22):
        kept = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for accepted in (True, False):
            values, ends = _bytes_of(b.column(1).filter(pa.array(kept == accepted)))
            for each in grams(values, ends) if len(values) else ():
                keys, n = np.unique(each[each >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([accepted] * len(keys)), pa.array(keys), pa.array(n)], ["accepted", "gram", "n"])


def _table(rows) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(2))
    by = np.argsort(keys)
    return keys[by], n[by]


def fit(labelled: DataFrame) -> dict[bool, tuple]:
    """The models of labelled(accepted, url): for each, its grams and their counts, its contexts and theirs.

    Every URL is counted. A model's size is bounded: grams rarer than 1 in SHARE are left to the shorter contexts, so
    at most (ORDER + 1) * SHARE grams of a model come to the driver, whatever the input.
    """
    counts = labelled.select("accepted", "url").mapInArrow(_counted, "accepted boolean, gram long, n long")
    counts, at = staged_at(labelled.sparkSession, counts.groupBy("accepted", "gram").agg(F.sum("n").alias("n")))
    counts = counts.withColumn("size", F.shiftright("gram", 56))
    totals = F.broadcast(counts.groupBy("accepted", "size").agg(F.sum("n").alias("total")))
    kept = counts.join(totals, ["accepted", "size"]).where(F.col("n") * SHARE >= F.col("total")).select("accepted", "gram", "n").collect()
    discard(labelled.sparkSession, at)
    models = {}
    for accepted in (True, False):
        keys, n = _table([(r["gram"], r["n"]) for r in kept if r["accepted"] == accepted])
        contexts, of = np.unique((keys >> 56 << 56) | ((keys & ((1 << 56) - 1)) >> 8), return_inverse=True)
        models[accepted] = keys, n, contexts, np.bincount(of, n, len(contexts)).astype(np.int64)
    return models


def _count_of(keys: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, n[at], 0).astype(np.float64)


def differences(models: dict[bool, tuple], values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each URL the accepted model's log-likelihood less the rejected one's, by its length; 0 for an empty one."""
    size = np.diff(ends, prepend=0)
    logs = {True: 0.0, False: 0.0}
    for accepted, (keys, n, contexts, total) in models.items():
        p = np.full(len(values), 1 / 256)
        for gram in grams(values, ends):
            context = (gram >> 56 << 56) | ((gram & ((1 << 56) - 1)) >> 8)
            p = (_count_of(keys, n, gram) + MASS * p) / (_count_of(contexts, total, context) + MASS)
        logs[accepted] = np.log(p)
    sums = np.bincount(np.repeat(np.arange(len(ends)), size), logs[True] - logs[False], len(ends)) if len(values) else np.zeros(len(ends))
    return np.round(sums / np.maximum(size, 1), 9)


def score_urls(spark: SparkSession, urls: DataFrame, models: dict[bool, tuple]) -> DataFrame:
    """urls(..., url) with difference; the models are broadcast, their size is bounded (see fit)."""
    import pyarrow as pa

    sent, names = spark.sparkContext.broadcast(models), urls.columns
    at = names.index("url")

    def run(batches):
        for b in slices(batches, at, 10_000, 1 << 22):
            found = differences(sent.value, *_bytes_of(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*names, "difference"])

    return urls.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in urls.dtypes), "difference double"]))


def threshold(scored: DataFrame) -> float:
    """The difference from which on scored(accepted, difference) is best allowed: the share of accepted ones at or above it
    and that of rejected ones below it have the largest sum; ties go to the one nearest 0, then to the smaller."""
    step = F.greatest(F.lit(-LIMIT * STEPS), F.least(F.lit(LIMIT * STEPS), F.floor(F.col("difference") * STEPS))).cast("int")
    n = {True: np.zeros(2 * LIMIT * STEPS + 2), False: np.zeros(2 * LIMIT * STEPS + 2)}
    for r in scored.groupBy("accepted", step.alias("step")).count().collect():  # two classes, 2 * LIMIT * STEPS + 1 steps at most
        n[r["accepted"]][r["step"] + LIMIT * STEPS] = r["count"]
    if not n[True].sum() or not n[False].sum():
        return 0.0
    below = {k: np.concatenate([[0], np.cumsum(v)])[:-1] for k, v in n.items()}
    right = (n[True].sum() - below[True]) * n[False].sum() + below[False] * n[True].sum()  # whole numbers: no tie by rounding
    steps = np.flatnonzero(right == right.max()) - LIMIT * STEPS
    return min(steps.tolist(), key=lambda s: (abs(s), s)) / STEPS


def judge(spark: SparkSession, urls: DataFrame, rules: Iterable[tuple[str, str]] = RULES, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, difference of urls(key, url): a rule's verdict, else the models'."""
    rules = list(rules)
    known = urls.select(F.col(key).alias("key"), "url")
    ruled = known.select("url", longest_rule(host(F.col("url")), path(F.col("url")), rules)["verdict"].alias("verdict"))
    ruled = ruled.where("verdict is not null").select((F.col("verdict") == "allow").alias("accepted"), "url")
    held_out = F.crc32(F.col("url").cast("binary")) % FOLDS == 0
    models = fit(ruled.where(~held_out))
    least = threshold(score_urls(spark, ruled.where(held_out), models))
    found = score_urls(spark, known, models).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    found = found.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("difference") >= least, "allow").otherwise("block")
    return found.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "difference")
