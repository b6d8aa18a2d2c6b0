"""Repeated passages against brute force: each shared chunk stays in the document of smallest id, and nothing else goes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import chunk_dedup


def say(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmné", k=rng.randrange(2, 9))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [say(rng, 400).split() for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [say(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            p, a = rng.choice(passages), rng.randrange(0, 300)
            parts += [" ".join(p[a : a + rng.randrange(20, 300)]), say(rng, rng.randrange(0, 40))]
        rows.append((rng.choice([i, i, i // 3]), " ".join(parts)))  # some ids clash
    rows += rows[5:8] + [(None, rows[0][1]), (70, None), (71, ""), (72, "one word " * 2000)]
    rng.shuffle(rows)
    return rows


def chunks(text):
    raw = (text or "").encode()
    ends = chunk_dedup.cuts(np.frombuffer(raw, np.uint8))
    return [(a, e, raw[a:e]) for a, e in zip([0, *ends], ends, strict=False)]


def spans_of(rows, min_words):
    """(start, end, first_doc) by row, straight from the definition."""
    holders = {}
    for i, t in rows:
        for *_, c in chunks(t) if i is not None else ():
            holders.setdefault(c, set()).add(i)
    out = []
    for i, t in rows:
        found, run = [], []
        text = (t or "").encode()

        def close(run, i=i, text=text, found=found):
            begins = lambda a, e: sum(not text[k : k + 1].isspace() and (k == 0 or text[k - 1 : k].isspace()) for k in range(a, e))
            if run and begins(run[0][0], run[-1][1]) >= min_words:
                part = []
                for c in [*run, None]:
                    if part and (c is None or (min(holders[c[2]]) < i) != (min(holders[part[-1][2]]) < i)):
                        found.append((part[0][0], part[-1][1], min(min(holders[x[2]]) for x in part)))
                        part = []
                    part.append(c)

        for c in chunks(t) if i is not None else ():
            if len(holders[c[2]]) > 1:
                run.append(c)
            else:
                close(run)
                run = []
        close(run)
        out.append(found)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nothing_is_lost(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"t1": F.lit(1), "__cut": F.lit("x"), "row": F.lit(2)})
    want = spans_of(rows, chunk_dedup.MIN_WORDS)
    got = sorted((r.doc_id, [tuple(s) for s in r.spans], r.removed_bytes) for r in chunk_dedup.repeated_documents(spark, docs).collect())
    assert got == sorted((i, s, sum(e - a for a, e, f in s if f < i)) for (i, _), s in zip(rows, want, strict=True) if s)
    kept = chunk_dedup.remove_repeats(spark, docs)
    assert kept.columns == ["doc_id", "text", "t1", "row"]
    cut = [chunk_dedup.without(t, [(a, e) for a, e, f in s if f < i]) for (i, t), s in zip(rows, want, strict=True)]
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, zip([i for i, _ in rows], cut, strict=True)))
    for (i, t), s in zip(rows, want, strict=True):  # what goes from a row stands, whole, in the first document that holds it
        for a, e, f in s:
            for x, y, c in chunks(t):
                if a <= x and y <= e and f < i:
                    first = min(d for d, u in rows if d is not None and any(z == c for *_, z in chunks(u)))
                    assert any(c in (k or "").encode() for (d, _), k in zip(rows, cut, strict=True) if d == first)


def test_overlapping_passages_of_three_documents(spark):
    rng = random.Random(4)
    p = say(rng, 400).split()
    rows = [(3, " ".join(p[:240])), (8, " ".join(p)), (20, " ".join(p[160:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in chunk_dedup.remove_repeats(spark, docs).collect()}
    missing = [w for w in p if all(w not in t.split() for t in texts.values())]
    assert len(missing) <= 2 and sum(len(t.split()) for t in texts.values()) < 480  # a word at a cut may be split


def test_rows_of_one_id(spark):
    rng = random.Random(6)
    shared, own = say(rng, 100), say(rng, 100)
    rows = [(1, shared), (2, f"{say(rng, 30)} {shared}"), (2, own), (2, own)]
    got = sorted(r.text for r in chunk_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got.count(own) == 2 and shared in got and len(got) == 4 and rows[1][1] not in got
