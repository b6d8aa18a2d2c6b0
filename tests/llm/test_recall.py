"""Recall of the permutation index against brute force on the test tables, and the exact search on vectors of many lengths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import inner_products, permutation_index


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_few_rows(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in permutation_index.search(spark, df, df.where("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -9
        hits, total = hits + len(found[ids[i]] & set(ids[np.argsort(-s, kind="stable")[:5]].tolist())), total + 5
    assert hits >= 0.95 * total
    assert permutation_index.SHARE < 0.05 and permutation_index.LEAST < 0.05 * len(ids)


def test_footrule_is_that_of_the_orders():
    rng = np.random.default_rng(3)
    order = np.argsort(rng.normal(size=(60, 30)), axis=1)[:, :12]
    files = permutation_index.inverted_files(order, 30)
    got = permutation_index.footrule(*files, order[7][:6], 12, 60)
    want = [sum(abs((list(o).index(p) if p in o else 12) - j) - (12 - j) for j, p in enumerate(order[7][:6])) for o in order]
    assert got.tolist() == want


def test_inner_products_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(inner_products, "SEEDS", 32)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(950, 16)) * rng.lognormal(0, 1.5, size=(950, 1))).astype("f4")
    x[50] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(950, [1.0, 2.0]), (1000, [math.inf] * 16)], "vec_id long, embedding array<float>")
    rows = {i: np.floor(256 * v.astype(float)).astype(int) for i, v in enumerate(x)} | {950: np.array([256, 512] + [0] * 14)}
    got = inner_products.search(spark, df.withColumn("rank", F.lit(1)), df.where("vec_id % 50 = 0"), block=64).collect()
    want = []
    for q in range(0, 951, 50):
        best = sorted(((-int(rows[q] @ v), i) for i, v in rows.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
