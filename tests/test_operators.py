"""Hand-computed values and properties of the operators outside the training-data subpackage."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import chunking, contracts, evaluate, evidence, fusion, layout, lexical, rerank, rules, vector
from gleaner.sources import tables
from gleaner.streaming import limiter


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first().x


def test_metrics_by_hand(spark):
    runs = spark.createDataFrame([(1, i + 1, c, t) for i, (c, t) in enumerate(zip("abcde", (100, 50, 10, 10, 10)))], "query_id long, rank int, chunk_id string, tokens int")
    relevant = spark.createDataFrame([(1, "b"), (1, "d")], "query_id long, chunk_id string")
    sizes = spark.createDataFrame([(1, 2), (2, 0)], "query_id long, n_rel int")
    got = {(r.query_id, r.k): r for r in evaluate.metrics_at(evaluate.judged(runs, relevant), sizes, [1, 2, 4, 5, 10], "tokens").collect()}
    assert (got[1, 1].precision, got[1, 2].precision, got[1, 5].precision) == (0, 0.5, 0.4)
    assert (got[1, 1].recall, got[1, 2].recall, got[1, 4].recall, got[1, 10].recall) == (0, 0.5, 1, 1)
    assert (got[1, 1].hit, got[1, 2].hit, got[1, 2].mrr) == (0, 1, 0.5)
    assert got[1, 2].wasted == pytest.approx(100 / 150)
    assert got[1, 5].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert (got[2, 5].recall, got[2, 5].ndcg, got[2, 5].wasted, got[2, 5].mrr) == (0, 0, 0, 0)


def test_relevance_by_section_or_pages(spark):
    chunks = spark.createDataFrame([("c1", "docA", "Intro", 1, 1), ("c2", "docA", "Intro", 2, 2), ("c3", "docA", "Methods", 3, 4), ("c4", "docB", "Intro", 1, 1)], "chunk_id string, document_id string, section_path string, page_start int, page_end int")
    labels = spark.createDataFrame([(1, "docA", "Intro", 9, 9), (2, "docA", "x", 4, 5), (3, "docA", "x", 5, 4), (4, "docC", "Intro", 1, 1)], "query_id long, document_id string, section_path string, page_start int, page_end int")
    got = {(r.query_id, r.chunk_id) for r in evaluate.relevant_chunks(chunks, labels).collect()}
    assert got == {(1, "c1"), (1, "c2"), (2, "c3")}


def ranking(spark, ids, query=1):
    return spark.createDataFrame([(query, i + 1, c, 1.0) for i, c in enumerate(ids)], "query_id long, rank int, chunk_id string, score double")


def test_fusion_and_duplicates(spark):
    fused = {r.chunk_id: r.rrf_score for r in fusion.fuse(ranking(spark, "abc"), ranking(spark, "bcd")).collect()}
    assert fused["b"] == pytest.approx(1 / 62 + 1 / 61) and fused["a"] == pytest.approx(1 / 61) and fused["d"] == pytest.approx(1 / 63)
    rows = ranking(spark, "abc").join(spark.createDataFrame([("a", "h"), ("b", "h"), ("c", None)], "chunk_id string, content_hash string"), "chunk_id")
    assert {r.chunk_id for r in fusion.drop_exact_copies(rows).collect()} == {"a", "c"}


def test_greedy_near_copies_like_a_loop(spark):
    rng, rows, expected = random.Random(3), [], set()
    for q in range(20):
        kept = []
        for i in range(12):
            v = [rng.gauss(0, 1) for _ in range(3)]
            n = math.sqrt(sum(x * x for x in v))
            v = None if i % 5 == 4 else [x / n for x in v]
            rows.append((q, i + 1, f"{q}-{i}", v))
            if v is None or not any(k and sum(a * b for a, b in zip(v, k)) > 0.6 for k in kept):
                kept.append(v)
                expected.add(f"{q}-{i}")
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, embedding array<double>")
    assert {r.chunk_id for r in fusion.drop_near_copies(df, threshold=0.6).collect()} == expected


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, "green"), (4, "")], "chunk_id long, text string")
    got = [(r.chunk_id, r.score) for r in lexical.search(docs, spark.createDataFrame([(1, "Fox red!")], "query_id long, query string")).orderBy("rank").collect()]
    idf = lambda df: math.log(4 - df + 0.5) - math.log(df + 0.5)
    mean = (idf(2) + 3 * idf(1)) / 4
    w = lambda i, tf, dl: i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 1.5))
    assert idf(2) == 0 and mean > 0
    assert got == [(1, pytest.approx(w(0, 1, 2) + w(idf(1), 1, 2)))]


def test_batches_keep_a_budget():
    lengths = [5, 900, 12, 4000, 7, 250, 3, 60]
    got = list(vector.budget_batches(lengths, 4096))
    assert sorted(i for b in got for i in b) == list(range(8))
    assert all(len(b) == 1 or max(lengths[i] for i in b) * len(b) <= 4096 for b in got)
    assert list(vector.budget_batches([], 10)) == [] and len(list(vector.budget_batches([10000] * 4, 8192, 128))) == 1


def test_rerank_and_fallbacks(spark):
    rows = spark.createDataFrame([(1, "q", i + 1, c, f"text {c}") for i, c in enumerate("abc")], "query_id long, query string, rank int, chunk_id string, text string").withColumn("chunk_id", F.ascii("chunk_id").cast("long"))
    order = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert order(rerank.rerank(rows, lambda q, t: [0.1, 0.9, 0.5])) == [98, 99, 97]

    def fails(q, t):
        raise RuntimeError

    got = rerank.rerank(rows, fails)
    assert order(got) == [97, 98, 99] and {r.fallback_reason for r in got.collect()} == {"RuntimeError"}
    assert {r.fallback_reason for r in rerank.rerank(rows, lambda q, t: [1, 2, 3], seconds=-1).collect()} == {"over budget"}


def test_gate_states(spark):
    def state(rerank_score, rrf, support, domain):
        return one(spark, evidence.sufficiency(F.lit(rerank_score).cast("double"), F.lit(rrf), F.lit(support), F.lit(domain)))

    assert state(1.0, 0.0, 2, True) == "SUFFICIENT" and state(1.0, 0.0, 1, True) == "PARTIAL"
    assert state(-5.0, 0.9, 5, True) == "INSUFFICIENT" and state(-5.0, 0.9, 5, False) == "OUT_OF_SCOPE"
    assert state(None, 0.05, 3, False) == "SUFFICIENT" and state(None, 0.01, 3, False) == "OUT_OF_SCOPE" and state(None, 0.02, 3, False) == "PARTIAL"


@pytest.mark.parametrize("text,rule", [("crushing pressure in my chest", "RF-CARDIAC-001"), ("my chest itches", None), ("slurred speech", "RF-STROKE-001"), ("I am gasping", "RF-BREATHING-001"), ("the bleeding won't stop", "RF-BLEEDING-001"), ("my baby is floppy", "RF-PAEDS-001"), ("a runny nose", None)])
def test_red_flags(spark, text, rule):
    got = [m.rule_id for m in rules.match_rules(spark.createDataFrame([(text,)], "text string")).first().matches]
    assert got == ([rule] if rule else [])


def test_floor_never_lowers(spark):
    grid = spark.range(4).select(F.col("id").alias("a")).join(spark.range(4).select(F.col("id").alias("f")), F.lit(True))
    assert all(r.x == max(r.a, r.f) for r in grid.select("a", "f", rules.apply_floor(F.col("a"), F.col("f")).alias("x")).collect())


def test_doses_and_requests(spark):
    rows = spark.createDataFrame([(1, "Take 500 mg twice daily for 7 days"), (2, "drink water, every 8 hours")], "k long, text string")
    got = {(r.k, r.kind) for r in rules.dose_phrases(rows, "k").collect()}
    assert (1, "dose_amount") in got and (1, "frequency") in got and (1, "duration") in got and (2, "frequency") not in got
    assert one(spark, rules.asks_for_prescription(F.lit("How much physical activity should I be getting each week?"))) is False
    assert one(spark, rules.asks_for_prescription(F.lit("what dose of aspirin?"))) is True


def test_text_functions(spark):
    assert one(spark, X.clean_line(F.lit("ﬁrst “quoted” a–b  c\u0085"))) == 'first "quoted" a-b c'
    assert one(spark, X.clean_line(F.lit("De\x1fnition of the in\x1fuenzae."))) == "Definition of the influenzae."
    assert one(spark, X.clean_line(F.lit("\x9fy"))) == ""
    assert one(spark, X.count_tokens(F.lit("a b c"))) == 4 and one(spark, X.count_tokens(F.lit(""))) == 0
    assert one(spark, X.evidence_grade(F.lit("(b recommendation)"))) == "B" and one(spark, X.evidence_grade(F.lit("none"))) is None
    assert one(spark, X.script_language(F.lit("ما هو"))) == "Arabic" and one(spark, X.script_language(F.lit("what"))) is None
    assert one(spark, X.table_markdown(F.expr("array(array('a','b'), array('1|2'))"))) == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    assert one(spark, X.normalized_question(F.lit("  Café ’s  "))) == "cafe 's"


def dehyphenated(lines):
    import re

    lines, out = list(lines), []
    while lines:
        line = lines.pop(0)
        m = re.match("([a-z]+)(.*)", lines[0], re.S) if lines else None
        if m and re.search(r"\w-\s*$", line):
            out.append(line[: line.rfind("-")] + m[1])
            lines[:1] = [m[2].lstrip()] if m[2].lstrip() else []
        else:
            out.append(line)
    return out


def test_dehyphenation_like_a_loop(spark):
    rng = random.Random(5)
    pages = [[rng.choice(["hyper-", "tension is", "a-", "b-", "c", "HIV-", "• x", "Up-", "low high-", ""]) for _ in range(rng.randrange(0, 7))] for _ in range(200)]
    df = spark.createDataFrame([(p,) for p in pages], "lines array<string>").select("lines", layout.dehyphenate(F.col("lines")).alias("x"))
    assert all(r.x == dehyphenated(r.lines) for r in df.collect())


def test_sections_carry_forward(spark):
    pages = spark.createDataFrame([("d", i) for i in range(5)], "document_id string, page_number int")
    heads = spark.createDataFrame([("d", 1, 10.0, "chapter", "One", False), ("d", 1, 20.0, "subsection", "Sub", False), ("d", 3, 5.0, "chapter", "References", True)], "document_id string, page_number int, y0 double, level string, text string, is_boilerplate boolean")
    got = [(r.section_path, r.confidence, r.is_boilerplate) for r in layout.assign_sections(pages, heads).orderBy("page_number").collect()]
    assert got == [("(no section detected)", "inherited", False), ("One > Sub", "detected", False), ("One > Sub", "inherited", False), ("References", "detected", True), ("References", "inherited", True)]


def test_packing_keeps_limits():
    rng = random.Random(7)
    for _ in range(200):
        parts = [" ".join(["w"] * rng.randrange(1, 30)) for _ in range(rng.randrange(1, 20))]
        got = list(chunking.pack(parts, 30, 0.2))
        assert all(chunking.tokens(g) <= 32 or g in parts for g in got)
        assert [p for p in parts if not any(p in g for g in got)] == []
    assert chunking.cascade("a. b. c", 1) == ["a", "b", "c"]


def test_chunk_ids_are_unique(spark):
    docs = spark.createDataFrame([(1, "\n".join("Some words that make a sentence here. " * 9 for _ in range(12)))], "doc_id long, text string")
    known = spark.createDataFrame([(1, "T", "o", "2024", "TBD", "none", ["x"], False)], "document_id long, title string, organization string, publication_year string, source_url string, license string, domains array<string>, has_evidence_grades boolean")
    chunks = chunking.chunk_documents(chunking.text_blocks(docs), known, "S1")
    rows = chunks.collect()
    assert len(rows) == len({r.chunk_id for r in rows}) > 5 and all(r.token_count >= 40 or r.chunk_type == "recommendation" for r in rows)
    assert contracts.repeated_keys(chunks, "chunk_id").isEmpty()


def test_limiter_in_batch_and_stream(spark, tmp_path):
    assert [a for a, _ in limiter.decide([0, 1, 2, 61], deque(), 2, 60.0)] == [True, True, False, True]
    assert list(limiter.decide([0, 10], deque(), 1, 60.0))[1] == (False, 51)
    rows = [("a" if i % 3 else "b", i, float(7 * i % 50 + i)) for i in range(60)]
    events = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "key string, event_id long, at double")
    batch = {(r.key, r.event_id): r.accepted for r in limiter.limit_batch(events, 3, 20.0).collect()}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.limit_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 3, 20.0)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.event_id): r.accepted for r in spark.table("limited").collect()} == batch


def test_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")
    v = spark.createDataFrame([(1, [1.0])], "k int, embedding array<double>")
    assert tables.publish_vectors(v, str(tmp_path), "a", 1) == 1
    assert tables.restore_vectors(spark, str(tmp_path), "b", lambda: v).count() == 1
    with pytest.raises(ValueError):
        tables.publish_vectors(v.limit(0), str(tmp_path), "c")
    assert one(spark, tables.page_sample(F.lit(11), 5)) == [0, 2, 4, 6, 8]
