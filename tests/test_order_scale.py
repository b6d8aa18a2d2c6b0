"""Order statistics over ranges of values, and the limiter over sorted batches, against plain Python."""

import random
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from gleaner.operators import evaluate
from gleaner.streaming import limiter


def test_running_sums_over_ranges(spark):
    rng = random.Random(3)
    values = sorted({rng.choice([rng.gauss(0, 1), rng.randint(0, 9) / 2]) for _ in range(700)})
    counts = [rng.randint(0, 5) for _ in values]
    rows = spark.createDataFrame(list(zip(values, counts, strict=True)), "v double, n long")
    got = evaluate.running(rows, "v", ["n"], parts=16).orderBy("v").collect()
    assert [r.v for r in got] == values and [r.next for r in got] == [*values[1:], None]
    assert [r.upto_n for r in got] == list(np.cumsum(counts)) and {r.total_n for r in got} == {sum(counts)}


def test_percentiles_and_latencies(spark):
    rng = random.Random(4)
    for values in ([1.0], [2.0] * 50, [rng.choice([0.5, 7.0, rng.random()]) for _ in range(401)]):
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = evaluate.percentiles(rows, "v", [0, 2.5, 50, 95, 100]).first()
        assert np.allclose(list(got), np.percentile(values, [0, 2.5, 50, 95, 100]))
        order = sorted(values)
        assert tuple(evaluate.latency_summary(rows, "v").first()) == (order[len(order) // 2], order[min(int(0.95 * len(order)), len(order) - 1)])
    none = rows.where("v > 100")
    assert list(evaluate.percentiles(none, "v", [50]).first()) == [None] and list(evaluate.latency_summary(none, "v").first()) == [None, None]
    scores = none.select(F.col("v").alias("score"), F.lit(True).alias("in_domain"))
    assert evaluate.fit_threshold(scores).collect() == []


def test_limiter_over_batches(spark):
    rng = random.Random(5)
    events = [(rng.choice([None, 1, 1, 1, 2]), i, rng.choice([None, *range(0, 400)])) for i in range(900)]
    rows = spark.createDataFrame([(k, i, None if t is None else float(t)) for k, i, t in events], "key long, event_id long, at double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r.event_id: (r.accepted, r.retry_after) for r in limiter.limit_batch(rows, 3, 20.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {i: (None, None) for _, i, t in events if t is None}
    for key in (None, 1, 2):
        mine = sorted((t, i) for k, i, t in events if k == key and t is not None)
        want |= {i: said for (_, i), said in zip(mine, limiter.decide([float(t) for t, _ in mine], deque(), 3, 20.0), strict=True)}
    assert got == want
