"""The bootstrap against plain Python: draws once a key, values once, any kind of group."""

import hashlib

import numpy as np

from gleaner.operators import evaluate


def plain(rows, group, resamples):
    mine = [(k, x) for k, g, x in rows if g == group and x is not None]
    means = []
    for i in range(resamples):
        w = [sum(c <= int(hashlib.md5(f"42:{k}:{i}".encode()).hexdigest()[:13], 16) / 16**13 for c in evaluate.POISSON) for k, _ in mine]
        if sum(w):
            means.append(sum(a * x for a, (_, x) in zip(w, mine, strict=True)) / sum(w))
    return np.mean([x for _, x in mine]), np.percentile(means, 2.5), np.percentile(means, 97.5)


def test_like_plain_python(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SUMS", 100)  # a task passes its sums on between groups too
    rows = [(q, g, None if (q + g) % 9 == 0 else float((q * 7 + g) % 11)) for q in range(40) for g in (1, 3, 5)]
    got = evaluate.bootstrap(spark.createDataFrame(rows, "query_id long, k int, x double"), "x", "k", resamples=60).collect()
    assert sorted(r.k for r in got) == [1, 3, 5]
    for r in got:
        assert np.allclose((r["mean"], r.low, r.high), plain(rows, r.k, 60))


def test_groups_without_a_mean(spark):
    rows = [("a", "x", 1.0), ("a", "y", None), ("b", None, 4.0)]
    got = evaluate.bootstrap(spark.createDataFrame(rows, "query_id string, k string, x double"), "x", "k", resamples=50).collect()
    assert {(r.k, r["mean"], r.low, r.high) for r in got} == {("x", 1.0, 1.0, 1.0), (None, 4.0, 4.0, 4.0)}


def test_values_are_read_once_and_drawn_once_a_key(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(q, g, 1.0) for q in range(10) for g in range(4)], "query_id long, k int, x double").mapInArrow(counted, "query_id long, k int, x double")
    assert evaluate.bootstrap(rows, "x", "k", resamples=20).count() == 4
    assert seen.value == 40
