"""The stored index against the search that builds none: the same rows, and only the files of the asked terms are read."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import terms
from gleaner.operators import inverted_index, lexical
from gleaner.sources import published


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(9)
    rare = [f"rare{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(rare) if rng.random() < 0.1 else rng.choice(["the", "of", "and", f"w{int(rng.paretovariate(1)) % 300}"]) for _ in range(rng.randrange(0, 80)))) for i in range(400)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "the the The")], "chunk_id long, text string").cache()


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    inverted_index.build(spark, chunks, path)
    return inverted_index.Index(spark, path)


def rounded(found):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 7)) for r in found.collect())


QUERIES = [(1, "the rare3"), (2, "rare5 rare5 w1 of"), (3, "nothing known"), (4, ""), (5, None), (6, "the of and w1 w2 w3 rare1 rare2 rare9"), (7, "The"), (8, "rare7")]


@pytest.mark.parametrize("k", [1, 5, 25])
def test_index_equals_the_search_without(spark, chunks, index, k):
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert rounded(index.search(asked, k)) == rounded(lexical.search(chunks, asked.fillna(""), k))
    index.clean()


def test_bands_that_cannot_matter_are_left_out(spark, index):
    """A rare term decides: most bands of a very common one can't bring a chunk among the best."""
    asked = spark.createDataFrame([(1, "rare3 the")], "query_id long, query string")
    chosen, buckets = index.chosen(asked, 1)
    assert {r.term for r in chosen.where("strong").collect()} == {"rare3"}
    assert chosen.where("term = 'rare3'").count() < index.table("bands", buckets).where("term = 'rare3'").count()


def test_only_asked_buckets_are_read(spark, index):
    asked = spark.createDataFrame([(1, "rare3 of")], "query_id long, query string")
    want = {r[0] for r in asked.select(F.explode(F.transform(terms(F.col("query")), inverted_index.bucket_of))).collect()}
    _, buckets = index.chosen(asked, 5)
    assert set(buckets) == want
    for name in ("postings", "bands", "terms"):
        files = index.table(name, buckets).inputFiles()
        assert files and {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= want
    assert all(any(f"bucket={b}/" in f for b in want) or "_searches" in f for f in index.search(asked, 5).inputFiles())


def test_a_new_version_does_not_disturb_readers(spark, chunks, tmp_path):
    path = str(tmp_path)
    inverted_index.build(spark, chunks, path)
    old = inverted_index.Index(spark, path)
    asked = spark.createDataFrame([(1, "the")], "query_id long, query string")
    before = rounded(old.search(asked, 3))
    inverted_index.build(spark, chunks.where("chunk_id < 50"), path)
    assert rounded(old.search(asked, 3)) == before != rounded(inverted_index.Index(spark, path).search(asked, 3))
    with pytest.raises(published.Refused):
        inverted_index.build(spark, chunks.where("chunk_id > 899 and chunk_id < 902"), path)
    with pytest.raises(FileNotFoundError):
        inverted_index.Index(spark, path + "/none")
