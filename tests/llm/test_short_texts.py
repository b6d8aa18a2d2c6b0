"""Short texts meet their copies only, odd sets lose no link, and many one-word texts take time in proportion to their number."""

import random
import time

import numpy as np
import pytest

from gleaner.llm import ngram_join


def linked(a, b, num, den):
    both = len(np.intersect1d(a, b))
    return den * both >= num * (len(a) + len(b) - both)


def test_equal_is_all_that_links_short_sets():
    words, lists = ngram_join.Words(), []
    for i in range(300):
        h = ngram_join.shingles(" ".join(f"w{i}-{k}" for k in range(1 + i % 6)), 3, words)
        lists.append(ngram_join.signatures(h, 9, 10).tolist())
    assert all(len(x) == 1 for x in lists) and len({x[0] for x in lists}) == 300


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10)])
def test_linked_sets_share_a_list(num, den):
    """Also sets whose shingles crowd into few blocks, and sets of frequent shingles only."""
    rng = np.random.default_rng(num)
    for case in range(1500):
        n = int(rng.integers(2, 120))
        low = rng.integers(0, 1 << 20, n).astype(np.uint64)
        high = (rng.integers(0, 1 << 40, n) if case % 3 else np.full(n, 7 * (case + 1))).astype(np.uint64)
        a = np.unique(high << np.uint64(20) | low)
        b = a[rng.random(len(a)) > rng.choice([0.02, 0.05, 0.1])]
        if case % 2:
            b = np.union1d(b, rng.integers(0, 1 << 62, rng.integers(0, 3)).astype(np.uint64))
        often = {0: None, 1: np.sort(a), 2: np.sort(a[: len(a) // 2]), 3: np.sort(rng.choice(a, max(1, len(a) - 2), replace=False))}[case % 4]
        if len(b) and linked(a, b, num, den) and not np.array_equal(a, b):
            assert set(ngram_join.signatures(a, num, den, often)) & set(ngram_join.signatures(b, num, den, often)), (case, len(a), len(b))


def test_one_word_texts_are_linear(spark):
    took = {}
    for n in (20_000, 100_000):
        docs = spark.range(n).selectExpr("id as doc_id", f"concat('w', id % {n // 2}) as text")
        began = time.time()
        got = ngram_join.jaccard_classes(spark, docs, 3, 9, 10)
        assert got.where(f"n_shingles = 1 and n_links = 1 and component_id = doc_id % {n // 2}").count() == n
        took[n] = time.time() - began
    assert took[100_000] < 5 * took[20_000] + 5


def test_long_texts_are_held_one_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "BYTES", 100)
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "x" * rng.randrange(0, 300) for _ in range(200)]
    parts = list(ngram_join._slices([pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["a", "b"])]))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 100 for p in parts)
