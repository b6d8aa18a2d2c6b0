"""The training-data operators over small tables, with nulls, empty texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import bpe, chunk_dedup, components, html_text, inner_products, mixing, ngram_join, permutation_index, quality, secrets, sharding
from gleaner.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.withColumns({"label": F.lit(1), "rank": F.lit("x"), "score": F.lit(0), "ids": F.lit(2)}) if extra else df


ODD = [(1, None, None), (2, "", "a"), (3, "one two", "a"), (4, "one two", "a"), (4, "one two", "a"), (5, "word " * 3000, "b"), (None, "x y z", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD, extra=True).cache()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.label for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(rows, width, num, den):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root, n = list(range(len(rows))), [0] * len(rows)

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((rows[i][0], len(sets[i]), least[top(i)], n[i]) for i in range(len(rows)))


@pytest.mark.parametrize("limit", [512, 5])
def test_jaccard_classes(spark, odd, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "SETS", limit)
    rng, rows = random.Random(limit), [(0, None, "s"), (1, "", "s"), (2, "A b", "s"), (3, "a  B", "s")]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(2, 70))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.random())
            rows.append((len(rows), " ".join(copy), "s"))
    for width, num, den in ((3, 9, 10), (5, 8, 10)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_classes(spark, docs_of(spark, rows), width, num, den).collect())
        assert got == brute_classes(rows, width, num, den)
    assert ngram_join.jaccard_classes(spark, odd).count() == len(ODD)
    assert ngram_join.jaccard_classes(spark, odd.limit(0)).count() == 0
    kept = ngram_join.drop_near_copies(spark, odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "None"]


def test_encoding(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    encoded = bpe.encode_documents(spark, odd, tokenizer_path()).collect()
    assert sorted(map(str, (r.ids for r in encoded))) == sorted(str(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in ODD)
    plain = bpe.decode_documents(spark, bpe.encode_documents(spark, odd, tokenizer_path()), tokenizer_path()).collect()
    assert sorted(r.decoded for r in plain) == sorted(t or "" for _, t, _ in ODD)
    got = bpe.encoding_digests(spark, odd.where("doc_id = 1"), tokenizer_path()).first()
    assert (got.n_tokens, got.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.encoding_digests(spark, odd.limit(0), tokenizer_path()).count() == 0


def test_quality(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score_quality(spark, docs, labels).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in held) >= 0.95 * len(held)
    got = quality.score_quality(spark, odd, labels)
    assert got.count() == len(ODD) and all(0 <= r.score <= 1 for r in got.collect())
    assert {r.score for r in quality.score_quality(spark, odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(spark, odd.limit(0), labels).count() == 0


def test_mixing(spark, odd):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "c", None])) for i in range(3000)]
    got = mixing.mix_sources(spark, docs_of(spark, rows)).collect()
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert own[0].target <= 2 * own[0].source_size + 1e-6
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)
    assert all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(spark, docs_of(spark, rows[::-1]).repartition(3)).collect()))
    assert mixing.mix_sources(spark, odd).count() == len(ODD) and mixing.mix_sources(spark, odd.limit(0)).count() == 0
    assert mixing.mixed_documents(spark, odd).columns == odd.columns


def test_sharding(spark, odd):
    rows = [(i, "same" if i % 3 else f"t{i}", "s") for i in range(500)] + [(7, "same", "s")] * 300
    got = sharding.shard_documents(spark, docs_of(spark, rows)).collect()
    assert len(got) == 800 and sorted((r.doc_id, r.text_crc32) for r in got) == sorted((i, zlib.crc32(t.encode())) for i, t, _ in rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_documents(spark, odd).count() == len(ODD) and sharding.shard_documents(spark, odd.limit(0)).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).withColumn("rank", F.lit(0))


def test_vector_searches(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype("f4")
    x[200:800] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    odd = [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] * 24), (2150, [None] * 24), (2200, [])]
    df = vectors_of(spark, [(i, v.tolist()) for i, v in enumerate(x)] + odd)
    queries = df.where("vec_id % 50 = 0")
    near = permutation_index.search(spark, df, queries, block=512).collect()
    y = x.astype(float)
    hits = total = 0
    for q in range(0, 1500, 50):
        s = (y @ y[q]) / np.sqrt((y * y).sum(1)) / np.sqrt((y[q] ** 2).sum())
        s[q] = -9
        best = set(sorted(range(1500), key=lambda i: (-round(s[i], 9), i))[:5])
        own = sorted((r for r in near if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in own)
        hits, total = hits + len(best & {r.vec_id for r in own}), total + 5
    assert hits >= 0.9 * total and {r.query_id for r in near} == set(range(0, 1500, 50))
    w = np.floor(256 * y).astype(int)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in inner_products.search(spark, df, queries, block=256).collect()}
    for q in range(0, 1500, 50):
        s = w @ w[q]
        best = [i for i in sorted(range(1500), key=lambda i: (-s[i], i)) if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, s[i]) if s[i] > 0 else got[q, k + 1] for k, i in enumerate(best)]
    assert permutation_index.search(spark, df.limit(0), queries.limit(0)).count() == 0 == inner_products.search(spark, df.limit(0), queries.limit(0)).count()


def test_passages(spark, odd):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(n))
    shared = say(80)
    rows = [(i, f"{say(40)} {shared} {say(40)}" if i in (3, 8, 20) else say(120), "s") for i in range(40)]
    got = {r.doc_id: r for r in chunk_dedup.repeated_documents(spark, docs_of(spark, rows)).collect()}
    assert set(got) == {3, 8, 20} and got[3].removed_bytes == 0 < got[8].removed_bytes
    cut = {r.doc_id: r.text for r in chunk_dedup.remove_repeats(spark, docs_of(spark, rows)).collect()}
    assert all(cut[i] == t for i, t, _ in rows if i not in (8, 20)) and len(cut[8]) < len(rows[8][1]) - len(shared) / 2
    assert {r.doc_id for r in chunk_dedup.repeated_documents(spark, odd).collect()} == set()
    assert chunk_dedup.repeated_documents(spark, odd.limit(0)).count() == 0


def test_site_style_tree(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class='box'>Same on every page</div><article><p>Text {i}</p></article><p>tail {i}</p>") for i in range(8)]
    pages = spark.createDataFrame([*rows, (90, None, None), (91, "http://h.example/x", "")], "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(spark, pages).collect()}
    assert got[3] == ("Text 3\ntail 3", 13) and got[90] == ("", 0) == got[91] and len(got) == 10
    assert html_text.extract_text(spark, pages.limit(0)).count() == 0


def test_secrets_and_pipeline(spark, odd):
    key = hashlib.sha1(b"x").hexdigest()
    rows = [(1, f'see token = "{key}" here', "s"), (2, f"commit {key} is fine", "s"), (3, "call 4981021525375367 now", "s"), (4, None, "s"), (5, "plain words", "s")]
    model = secrets.train(spark, 600)
    found = secrets.find_secrets(spark, docs_of(spark, rows, extra=True), model).collect()
    assert [(r.doc_id, r.value) for r in found] == [(1, key)]
    clean = {r.doc_id: r.text for r in secrets.redact(spark, docs_of(spark, rows), model).collect()}
    assert clean[1] == 'see token = "[SECRET]" here' and clean[2] == rows[1][1] and clean[4] is None
    assert secrets.find_secrets(spark, odd.limit(0), model).count() == 0
    out = corpus_pipeline.run(spark, SF).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out and all(r.n_tokens == len(r.ids) for r in out)
    same = [r for r in out if "token" not in texts[r.doc_id].lower()]
    assert same and all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in same)
