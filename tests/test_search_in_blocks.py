"""Lexical and vector search and the test for near copies: blocks of any size against plain Python, and nothing computed twice."""

import math
import random
import re
from collections import Counter

import pytest

from gleaner.operators import fusion, lexical, vector


def plain(texts, queries, k):
    words = {c: re.findall("[a-z0-9]+", (t or "").lower()) for c, t in texts}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    idf = {t: 0.25 * sum(raw.values()) / len(raw) if r < 0 else r for t, r in raw.items()}
    out = []
    for q, text in queries:
        asked, scores = re.findall("[a-z0-9]+", (text or "").lower()), {}
        for c, w in words.items():
            tf = Counter(w)
            scores[c] = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in asked if t in tf)
        best = sorted((c for c in scores if round(scores[c], 9) > 0), key=lambda c: (-round(scores[c], 9), c))[:k]
        out += [(q, i + 1, c, round(scores[c], 6)) for i, c in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"QUERIES": 7, "TERMS": 40, "CELLS": 60, "MATRIX": 20, "COUNTED": 5}, {"COMMON": 2.0}, {"COMMON": 0.0}])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_ranks_like_plain_python(spark, monkeypatch, sizes, kind):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(n))
    key = (lambda i: i) if kind == "long" else str
    texts = [(key(i), text(rng.randint(1, 30))) for i in range(150)]
    texts += [(key(i + 150), texts[i][1]) for i in range(40)] + [(key(190), None), (key(191), ""), (key(192), "W1 É w2")]
    queries = [(q, text(rng.randint(1, 6))) for q in range(30)] + [(30, None), (31, "zzz"), (32, "w3 w3 w4")]
    got = lexical.search(spark.createDataFrame(texts, f"chunk_id {kind}, text string").repartition(3), spark.createDataFrame(queries, "query_id long, query string"), 4)
    assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in got.collect()) == plain(texts, queries, 4)


def test_rows_of_one_key_are_one_chunk(spark):
    chunks = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "c d e"), (3, "f"), (4, "g"), (5, "h")], "chunk_id long, text string")
    got = lexical.search(chunks, spark.createDataFrame([(1, "a f")], "query_id long, query string")).collect()
    assert sorted(r.chunk_id for r in got) == [1, 3]


def test_vectors_tie_at_nine_digits_in_a_task_too(spark):
    rows = spark.createDataFrame([(2, [1.0]), (1, [1.0 - 1e-10]), (3, [0.5])], "vec_id long, embedding array<double>").coalesce(1)
    got = vector.search(rows, spark.createDataFrame([(9, [1.0])], "query_id long, embedding array<double>"), k=1).collect()
    assert [r.vec_id for r in got] == [1]


def counted(rows, seen):
    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema)


def test_near_copies_are_computed_once(spark):
    rows = [(q, r, 10 * q + r, v) for q in (1, 2, 3) for r, v in enumerate([[1.0, 0.0], [0.99, 0.01], None, [0.0, 1.0], [0.0, 0.97], [1.0], [None, 1.0]], 1)]
    seen = spark.sparkContext.accumulator(0)
    ranked = counted(spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, embedding array<double>"), seen)
    got = fusion.drop_near_copies(ranked).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, r) for q in (1, 2, 3) for r in (1, 3, 4, 6, 7)]
    assert seen.value == len(rows)
