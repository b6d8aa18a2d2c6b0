"""Quality by Bradley-Terry pairwise ranking: document scores from preference pairs, a threshold at a score quantile."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows of each class that are learnt from at most (by the order of a hash), and preference pairs.
SAMPLE, PAIRS = 4000, 60_000
#: Bytes of a text that are counted and compressed at a time; all of it is.
PART = 1 << 20

_CLASS = np.full(256, 0, np.uint8)
for _names, _k in ((range(ord("a"), ord("z") + 1), 1), (range(ord("A"), ord("Z") + 1), 2), (b"0123456789", 3), (b" \t\r\v\f", 4), (b"\n", 5), (b".,;:", 6), (b"'\"-()", 7), (b"!?", 8), (b"|/\\<>[]{}=_~^`+@", 9), (b"#$%&*", 10), (range(128, 256), 11)):
    for _b in _names:
        _CLASS[_b] = _k
FEATURES = 24


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes and words; all zero for a text without words."""
    out = np.zeros(FEATURES)
    words = (text or "").split()
    if not words:
        return out
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kinds = np.zeros(256, np.int64)
    packer, packed = zlib.compressobj(1), 0
    for at in range(0, len(data), PART):
        part = data[at : at + PART]
        kinds += np.bincount(part, minlength=256)
        packed += len(packer.compress(part))
    packed = (packed + len(packer.flush())) / len(data)
    share = np.bincount(_CLASS, weights=kinds, minlength=12) / len(data)
    n, distinct = len(words), len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    letters = max(share[1] + share[2] + share[11], 1e-9)
    out[:12] = np.sqrt(share)
    out[12] = np.log1p(n) / 10
    out[13] = distinct / n
    out[14] = np.sqrt(again / n)
    out[15] = len(data) / n / 10
    out[16] = packed
    out[17] = share[2] / letters
    out[18:23] = np.minimum(1, 30 * np.array([share[8], share[9], share[10], again / n, share[3]]))
    out[23] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7, stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Weights and threshold. Pairs (better, worse) are drawn at random; Newton steps on the logistic loss of the differences.

    The threshold is the quantile of the scores at the share of worse documents, between the two scores around it; a row
    of class k counts stands_for[k] times in it.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w, 0.0
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    d = x[rng.choice(good, n)] - x[rng.choice(bad, n)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w)), d.T @ (1 - p) / n - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    order = np.argsort(x @ w, kind="stable")
    s, below = (x @ w)[order], np.cumsum(np.where(y == 1, stands_for[1], stands_for[0])[order])
    cut = int(np.searchsorted(below, len(bad) * stands_for[0] * (1 + 1e-9), side="right"))
    cut = min(max(cut, 1), len(s) - 1)
    return w, float((s[cut - 1] + s[cut]) / 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and threshold from labels(doc_id, quality) outside the held-out third.

    The weights come from at most sample rows of each class; for the threshold these rows stand for all of their class.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {int(r["quality"]): r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    order = F.xxhash64("doc_id")
    picked = one.where("quality = 1").orderBy(order, "doc_id").limit(sample).unionByName(one.where("quality = 0").orderBy(order, "doc_id").limit(sample))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [features(t).tolist() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")  # at most 2 * sample rows
    found = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id long, quality int, x array<double>")
    rows = found.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("x").alias("x")).orderBy("doc_id").collect()  # at most 2 * sample rows
    if not rows:
        return np.zeros(FEATURES), 0.0
    bad, good = (max(1.0, counts.get(k, 0) / sample) for k in (0, 1))
    return fit(np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows]), stands_for=(bad, good))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, name: str = "score") -> DataFrame:
    """docs(doc_id, text, ...) with a column name: the score (0 to 1; 0.5 at the threshold).

    A score depends on the text alone. Null, empty and blank texts get the score of no features; equal texts get
    equal scores; without labels of both classes every score is 0.5; an empty table gives an empty result. Other
    columns stay, but for one of that name.
    """
    w, threshold = learn(spark, docs, labels, sample)
    kept = docs.drop(name)
    at = kept.columns.index("text")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            raw = np.array([features(t) @ w for t in b.column(at).to_pylist()]) - threshold
            score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, name])

    from pyspark.sql import types as T

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))
