"""Postings in groups of buckets: the same classes as in one group, also where groups are empty, and no group's folder is left."""

import os
import random

import pytest

from gleaner.llm import common, ngram_join


def classes(spark, docs):
    return sorted(tuple(r) for r in ngram_join.jaccard_classes(spark, docs).collect())


@pytest.mark.parametrize("texts", ["near copies", "one text", "no words", "none"])
def test_groups_lose_no_link(spark, monkeypatch, texts):
    rng = random.Random(8)
    plain = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(25)]
    rows = {"near copies": plain + [t + " tail" for t in plain] + ["", None], "one text": ["a b c"] * 4, "no words": ["", None, " "], "none": []}[texts]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want, seen, parts = classes(spark, docs), [], common.staged_parts

    def kept(*args):
        found = parts(*args)
        return lambda value: seen.append((value, found(value)[1])) or found(value)

    monkeypatch.setattr(ngram_join, "GROUP", 100)
    monkeypatch.setattr(ngram_join, "staged_parts", kept)
    assert classes(spark, docs) == want
    assert len({r[2] for r in want}) < len(rows) or texts != "near copies"
    assert not any(os.path.exists(path.removeprefix("file:")) for value, path in seen if value >= 0)
    assert len(seen) == 9 or texts != "near copies"
