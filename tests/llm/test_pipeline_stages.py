"""corpus_pipeline against plain Python over sf0.001 with planted copies and secrets, and each stage alone on odd input."""

import hashlib
import math
import re

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import common, quality, secrets
from gleaner.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies_gone(rows):
    """doc_id: text without all but the smallest id of each group of near copies."""
    sets = {}
    for i, t in rows.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    kin = {i: {j for j in sets if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} for i in sets}
    kept, seen = {}, set()
    for i in sorted(rows):
        if i not in seen:
            kept[i] = rows[i]
            todo = [i]
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += kin[x]
    return kept


def redacted(text, judged):
    out, at = [], 0
    for n, m in enumerate(regex.finditer(secrets.CANDIDATE, text or ""), 1):
        if judged.get((text, n)):
            out += [text[at : m.start() + len(regex.match(secrets.HEAD, m[0])[0])], "[SECRET]"]
            at = m.end()
    return "".join([*out, text[at:]]) if out else text


def copies(rows):
    """doc_id: copies, of {doc_id: (source, text)} without null sources."""
    size = {i: len(WORD.findall(t or "")) for i, (_, t) in rows.items()}
    own = {}
    for i, (s, _) in rows.items():
        own[s] = own.get(s, 0) + size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(own))}
    target, open_, left = {}, set(own), 1.5 * sum(own.values())
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 2 * own[s]}
        for s in full or open_:
            target[s] = 2.0 * own[s] if full else left * weight[s] / sum(weight[x] for x in open_)
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    found = {}
    for s in own:
        bucket = lambda n: n.bit_length() * 8 + (n >> max(n.bit_length() - 3, 0))
        order = sorted((bucket(size[i]), hashlib.md5(f"{i}:{t or ''}".encode()).hexdigest()[:15], i) for i, (x, t) in rows.items() if x == s)
        rate, u = target[s] / own[s] if own[s] else 0.0, int(hashlib.md5(f"mix:{s}".encode()).hexdigest()[:13], 16) / 16**13
        for k, (*_, i) in enumerate(order, 1):
            found[i] = min(math.floor(u + rate * k) - math.floor(u + rate * (k - 1)), math.ceil(rate))
    return found


def test_the_whole_pipeline(spark, tmp_path, monkeypatch):
    given = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    key = hashlib.sha256(b"planted").hexdigest()
    more = [(9000 + i, r.text + f" last word {i}", r.lang, r.source, r.n_chars) for i, r in enumerate(given[:12])]
    more += [(-100 - i, f"{r.text} api_key={key[i:]} and postgres://me:{key[:12]}@db.example.org/x", r.lang, r.source, r.n_chars) for i, r in enumerate(given[20:26])]
    docs = spark.createDataFrame([tuple(r) for r in given] + more, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    shared = tmp_path / "shared"
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(shared))
    got = sorted((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert len(list(shared.iterdir())) <= 2  # what the last stage reads and wrote; nothing of the others stays

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in quality.score_quality(spark, docs, common.table(spark, str(tmp_path), "labels")).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = near_copies_gone({r.doc_id: r.text for r in docs.collect() if score[r.doc_id] >= 0.5})
    at = spark.createDataFrame([(t,) for t in set(rows.values()) if t], "text string")
    judged = {(r.text, r.number): r.score >= 0.5 for r in secrets.scored(secrets.candidates(at.select(F.col("text").alias("key"), "text"), "key").withColumnRenamed("key", "text"), secrets.train(spark)).collect()}
    rows = {i: (source[i], redacted(t, judged)) for i, t in rows.items()}
    assert sum("[SECRET]" in (t or "") for _, t in rows.values()) > 0 and len(rows) < len(given) + len(more) - 12
    from tokenizers import Tokenizer

    library, times = Tokenizer.from_file(tokenizer_path()), copies(rows)
    library.no_truncation()
    library.no_padding()
    want = []
    for i, (s, t) in rows.items():
        ids = tuple(library.encode(t or "", add_special_tokens=False).ids)
        want += [(i, s, len(ids), ids)] * times[i]
    assert got == sorted(want)


ODD = [(None, "a b c", None), (None, "a b c", None), (1, None, "s"), (2, "", "s"), (3, "x " * 40_000, "s"), (4, "w v u t s r", None), (4, "w v u t s r", None), (5, "\x00 ﷐ token='abc'", "z"), (6, "one", "s")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_alone(spark, name, stage):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and no rows."""
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("score", "key", "part", "n", "size", "ids", "component_id", "number", "value", "left", "hash", "rank")})
    got = stage(spark, docs, SF)
    kept = [r.doc_id for r in got.collect()]
    last = name == corpus_pipeline.STAGES[-1][0]
    assert got.columns == (["doc_id", "source", "n_tokens", "ids"] if last else docs.columns) and set(kept) <= {i for i, *_ in ODD}
    if name.startswith(("n-gram", "secret", "BPE")):
        assert sorted(map(str, kept)) == sorted(str(i) for n, (i, *_) in enumerate(ODD) if not (name.startswith("n-gram") and n == 6))
    assert stage(spark, docs.limit(0), SF).count() == 0
