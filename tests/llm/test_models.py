"""The pairwise fit and the ring, each against a plain walk; the columns that a mix keeps."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import mixing, quality, sharding


def test_pairwise_fit_minimises_the_logistic_loss_of_differences():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0.4, 1, (30, 3)), rng.normal(-0.4, 1, (20, 3))])
    y = np.array([1] * 30 + [0] * 20)
    w, threshold = quality.fit(x, y, pairs=40_000, ridge=0.05)
    differences = np.array([a - b for a in x[:30] for b in x[30:]])  # all pairs, where fit draws some

    def loss(v):
        return np.log1p(np.exp(-differences @ v)).mean() + 0.025 * (v @ v)

    plain = np.zeros(3)
    for _ in range(4000):  # plain gradient descent
        p = 1 / (1 + np.exp(differences @ plain))
        plain += 0.5 * ((differences * p[:, None]).mean(0) - 0.05 * plain)
    assert np.abs(w - plain).max() < 0.25 * np.abs(plain).max() and loss(w) < loss(plain) + 0.005
    scores = np.sort(x @ w)
    assert scores[19] <= threshold <= scores[20]  # the quantile at the share of worse rows, 20 of 50


def walk(keys, shards, slack):
    """Shard of each key (position, order), a key at a time in rounds: those that a full shard turns away go on clockwise."""
    nodes = sorted((int.from_bytes(hashlib.sha256(f"{s}/{n}".encode()).digest()[:8], "big"), s) for s in range(shards) for n in range(sharding.NODES))
    nodes = sorted((h % sharding.POSITIONS, h, s) for h, s in nodes)
    total = len(keys)
    room = [total // shards + (s < total % shards) for s in range(shards)] if not slack else [-(-round((1 + slack) * total * 1000) // (1000 * shards))] * shards
    paths = {}
    for at in {p for p, _ in keys}:
        i = bisect.bisect_left(nodes, (at,))
        paths[at] = list(dict.fromkeys(s for *_, s in nodes[i:] + nodes[:i]))
    out, left = {}, sorted(keys)
    for step in range(shards):
        turned = []
        for key in left:
            s = paths[key[0]][step]
            if room[s]:
                room[s] -= 1
                out[key] = s
            else:
                turned.append(key)
        left = turned
    return out


def test_ring_is_that_of_a_walk_key_by_key():
    rng = random.Random(3)
    where = [int(rng.random() ** 3 * sharding.POSITIONS) for _ in range(6000)]  # crowded positions
    counts, keys, seen = Counter(where), [], Counter()
    for at in where:
        keys.append((at, seen[at]))
        seen[at] += 1
    for shards, slack in ((24, 0.0), (25, 0.0), (24, 0.25)):
        rows = list(sharding.bounded_loads(counts, shards, slack))
        got = {(at, first + i): s for at, first, n, s, _ in rows for i in range(n)}
        assert got == walk(keys, shards, slack)


def test_one_more_shard_moves_few_keys():
    rng = random.Random(4)
    counts = Counter(rng.randrange(sharding.POSITIONS) for _ in range(100_000))
    at = lambda shards: {(p, first + i): s for p, first, n, s, _ in sharding.bounded_loads(counts, shards, 0.0) for i in range(n)}
    a, b = at(24), at(25)
    assert sum(a[k] != b[k] for k in a) < 0.08 * len(a)  # 0.04 is the least; a plain remainder moves 0.96


def test_mix_with_more_cells_is_as_close(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 100)
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", None])) for i in range(2000)] + [(5, "w w", "a")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("key", "sub", "rank", "size", "n")})
    got = mixing.mix_sources(spark, docs).collect()
    assert len(got) == 2300
    for s in ("a", "b", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.02 * own[0].target and all(r.taken <= 2 * r.size for r in own)
    kept = mixing.mixed_documents(spark, docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in got)
