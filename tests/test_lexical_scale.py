"""Passages met by a word, and the counts of one pass, against plain Python."""

import random

import pytest

from gleaner.operators import lexical, rules


@pytest.mark.parametrize("block", [1 << 24, 500])
def test_passages_are_found_word_for_word(spark, monkeypatch, block):
    """Of one to five words, at word and within-word borders, with odd white space; in one block of passages and in several."""
    monkeypatch.setattr(lexical, "BLOCK_CHARS", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["a", "red", "fox", "été"]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)] + [None, "", " ", "w1  w2\tw3", "bored foxes", "x\u00a0y\u2003z", "the " * 5000]
    passages = [" ".join(t.split(" ")[a : a + n]) for t in texts[:20] for a, n in ((0, 4), (7, 1), (9, 2), (11, 3), (3, 5))]
    passages += ["red fox", "w1  w2\tw3", "w1 w2", "", None, " ", "\u2003", "x y z", "\u00a0y\u2003", " w1 ", "the the the", "the"]
    passages += [t[7:19] for t in texts[:10]]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id long, query string")
    got = sorted((r.query_id, r.chunk_id) for r in lexical.holding(chunks, asked).collect())
    assert got == sorted((q, c) for q, p in enumerate(passages) if p and p.strip() for c, t in enumerate(texts) if t and p in t)
    assert lexical.holding(chunks, asked.limit(0)).count() == 0 == lexical.holding(chunks.limit(0), asked).count()


def test_counts_of_one_pass(spark):
    chunks = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "chunk_id long, text string")
    df, stats = lexical.document_frequencies(chunks)
    assert {r.term: r.df for r in df.collect()} == {"a": 1, "b": 2, "c": 1} and tuple(stats.first()) == (4, 1.25)
    one, two = lexical.statistics(chunks).first(), stats.first()
    assert (one.n, one.avgdl) == (two.n, two.avgdl)
    assert lexical.search(chunks, spark.createDataFrame([(1, "zzz"), (2, "")], "query_id long, query string")).count() == 0


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULES_MOST", 3)
    texts = spark.createDataFrame([(1, "x")], "id long, text string")
    try:
        rules.match_rules_by_join(texts, rules.rule_table(spark), "id")
    except ValueError as said:
        assert "more than 3" in str(said)
    else:
        raise AssertionError
