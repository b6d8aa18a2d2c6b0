"""The threshold is the quantile of all labels, not of the bounded sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality


def test_sampled_rows_stand_for_their_class():
    rng = np.random.default_rng(3)
    y = (np.arange(20_000) % 10 > 0).astype(int)
    x = rng.normal(size=(20_000, 2)) + y[:, None] * [1.0, 0.0]
    some = np.concatenate([np.flatnonzero(y == k)[:1000] for k in (0, 1)])
    w, t = quality.fit(x[some], y[some], stands_for=(2.0, 18.0))
    assert (x @ w < t).mean() == pytest.approx(0.1, abs=0.02)
    assert (x @ w < quality.fit(x[some], y[some])[1]).mean() > 0.25


def test_threshold_does_not_follow_the_sample_size(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10 + 9 * (i % 5))).cast("string")) for i in range(30)]).alias("text"))
    labels = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(10)) > 0).cast("int").alias("quality"))
    low = [quality.score_quality(spark, docs, labels, sample).where("score < 0.5").count() / 3000 for sample in (4000, 150)]
    assert low[0] == pytest.approx(0.1, abs=0.04) and low[1] == pytest.approx(low[0], abs=0.08)
