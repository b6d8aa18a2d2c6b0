"""Readers, sinks and search variants that have no SQL: small files and hand-made rows."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import chunking, fusion, rerank, rules
from gleaner.sources import tables

RULES = """
version: "2"
rules:
  - id: R1
    label: Two signs
    urgency_floor: HIGH
    rationale: " why "
    source: {chunk_id: c1, document_id: d1, page: 3, section_path: A}
    all_of:
      - any_of: ['\\bpain\\b', '\\bache\\b']
      - 'chest'
  - id: R2
    label: One sign
    urgency_floor: CRITICAL
    source: {chunk_id: c2, document_id: d1, page: "4", section_path: B}
    any_of: ['\\bblue lips\\b']
"""


def test_rules_from_yaml(spark, tmp_path):
    at = tmp_path / "rules.yaml"
    at.write_text(RULES)
    found, sources = tables.read_rules(spark, str(at))
    texts = spark.createDataFrame([(1, "an ACHE in the chest"), (2, "pain"), (3, "Blue lips")], "id long, text string")
    got = {r.id: ([m.rule_id for m in r.matches], r.urgency_floor) for r in rules.match_rules(texts, rules=found).collect()}
    assert got == {1: (["R1"], "HIGH"), 2: ([], "LOW"), 3: (["R2"], "CRITICAL")}
    assert [(r.rule_id, r.page, r.rationale, r.version) for r in sources.orderBy("rule_id").collect()] == [("R1", 3, "why", "2"), ("R2", 4, "", "2")]


@pytest.mark.parametrize("text", [RULES.replace("page: 3, ", ""), RULES.replace("    any_of: ['\\bblue lips\\b']\n", "")])
def test_rules_without_source_or_pattern_are_an_error(spark, tmp_path, text):
    at = tmp_path / "rules.yaml"
    at.write_text(text)
    with pytest.raises(ValueError, match="R1|R2"):
        tables.read_rules(spark, str(at))


def test_emergency_and_heading_profile(tmp_path):
    at = tmp_path / "e.yaml"
    at.write_text("default_locale: a\ncritical_lead: >\n  now\nhigh_lead: soon\nlocales:\n  a: {label: x, number: null, instruction: ' call '}\n  b: {label: y, number: '1', instruction: go}\n")
    assert tables.read_emergency(str(at)) == {"critical_lead": "now", "high_lead": "soon", "label": "x", "number": None, "instruction": "call"}
    assert tables.read_emergency(str(at), "b")["number"] == "1"
    at.write_text("body_text_size: 10\nheading_levels:\n  - {level: chapter, font_size_min: 20, font_size_max: 26, numbering_pattern: '^Part \\d+:'}\n  - {level: section, font_size_min: 15, font_size_max: 17, bold_required: true}\nexclude_headings: [Contents]\n")
    profile = tables.read_heading_profile(str(at))
    assert [x["name"] for x in profile["levels"]] == ["chapter", "section"] and profile["levels"][1]["bold"]
    assert profile["numbering"] == r"(?:^Part \d+:)" and profile["excluded"] == ["Contents"]


def test_runs_and_thresholds_are_tables(spark, tmp_path):
    runs = spark.createDataFrame([("S1", "dev", 1, 1, "c", 0.5), ("S1", "golden", 2, 1, "c", 0.5)], tables.RUNS)
    tables.write_runs(runs, f"{tmp_path}/runs")
    tables.write_runs(spark.createDataFrame([("S2", "dev", 1, 1, "d", 0.25)], tables.RUNS), f"{tmp_path}/runs")
    assert {(r.config_id, r.chunk_id) for r in tables.read_runs(spark, f"{tmp_path}/runs", "dev").collect()} == {("S1", "c"), ("S2", "d")}
    with pytest.raises(ValueError, match="golden"):
        tables.read_runs(spark, f"{tmp_path}/runs", "golden")
    assert tables.read_runs(spark, f"{tmp_path}/runs", "golden", unlock=True).count() == 1
    tables.write_thresholds(spark, f"{tmp_path}/tau", "rerank", 0.72849, -3.93246)
    tables.write_thresholds(spark, f"{tmp_path}/tau", "rrf", 0.05, 0.01)
    tables.write_thresholds(spark, f"{tmp_path}/tau", "rrf", 0.045, 0.015)
    assert tables.read_thresholds(spark, f"{tmp_path}/tau") == {"rerank": (0.7285, -3.9325), "rrf": (0.045, 0.015)}
    assert tables.artifact_path("a", "report", 5) == "a/report_limit5" != tables.artifact_path("a", "report")


def test_chunks_of_a_configuration(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 10), ("b", 900)], "chunk_id string, token_count int")
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0)).alias("embedding"))
    assert tables.publish_chunks(chunks, vectors, str(tmp_path), "S1", "v1") == {"chunks": 2, "over": 1}
    assert tables.publish_chunks(chunks.limit(1), vectors.limit(1), str(tmp_path), "S2", "v1")["chunks"] == 1
    assert [tables.read_published_chunks(spark, str(tmp_path), c)[0].count() for c in ("S1", "S2")] == [2, 1]
    with pytest.raises(ValueError, match="1 vectors for 2 chunks"):
        tables.publish_chunks(chunks, vectors.limit(1), str(tmp_path), "S1", "v2")
    assert tables.read_published_chunks(spark, str(tmp_path), "S1")[0].count() == 2


def test_chunks_keep_their_place_in_the_file(spark, tmp_path):
    at = tmp_path / "chunks.jsonl"
    at.write_text("".join(f'{{"chunk_id": "c{i:04}", "text": "x"}}\n' for i in (5, 3, 4, 1)))
    assert [r.chunk_id for r in tables.read_chunks(spark, str(at)).orderBy("pos").collect()] == ["c0005", "c0003", "c0004", "c0001"]


def test_a_document_without_text_is_an_error(spark):
    pages = spark.createDataFrame([("a", 0, "x"), ("b", 0, " ")], "document_id string, page_number int, text string")
    checked = tables.validated(pages)
    assert [r.document_id for r in tables.usable_files(checked.where("document_id = 'a'")).collect()] == ["a"]
    with pytest.raises(Exception, match="no text on the sampled pages of b"):
        tables.usable_files(checked).collect()


def test_a_scorer_that_does_not_load(spark):
    def broken():
        raise OSError("no model")

    assert rerank.loaded(lambda: rerank.overlap_scores) == (rerank.overlap_scores, None)
    assert rerank.loaded(broken) == (None, "OSError")
    assert rerank.loaded(lambda: None) == (None, "TypeError")
    rows = spark.createDataFrame([(1, "a", 1, 7, "b"), (1, "a", 2, 8, "a")], "query_id long, query string, rank int, chunk_id long, text string")
    got = {(r.chunk_id, r.rank, r.rerank_used, r.fallback_reason) for r in rerank.rerank_or_pass(rows, *rerank.loaded(broken)).collect()}
    assert got == {(7, 1, False, "OSError"), (8, 2, False, "OSError")}
    assert [r.chunk_id for r in rerank.rerank_or_pass(rows, rerank.overlap_scores).orderBy("rank").collect()] == [8, 7]


def test_token_counts_by_a_given_tokenizer():
    text = "One two three. Four five six. Seven eight nine."
    assert chunking.split_unit(text, "section_aware", 12, 0.0) == [text]
    assert chunking.split_unit(text, "section_aware", 15, 0.0, size=len) == ["One two three.", "Four five six.", "Seven eight nine."]
    assert chunking.split_unit(text, "recursive", 16, 0.0, size=len) == ["One two three", "Four five six", "Seven eight nine."]


def test_one_variant_is_searched_as_by_itself(spark):
    rank = "query_id long, variant int, rank int, chunk_id string, score double"
    dense = spark.createDataFrame([(1, 0, 1, "a", 0.9), (1, 0, 2, "b", 0.8), (1, 0, 3, "c", 0.7), (2, 0, 1, "a", 0.9), (2, 1, 1, "b", 0.8), (2, 1, 2, "a", 0.7)], rank)
    found = spark.createDataFrame([(1, 0, 1, "b", 5.0), (1, 0, 2, "d", 4.0), (2, 0, 1, "d", 5.0)], rank)
    payload = spark.createDataFrame([("a", ["x"], "h1", [1.0, 0.0]), ("b", ["x"], "h2", [0.0, 1.0]), ("c", ["y"], "h1", [1.0, 0.0]), ("d", ["y"], "h3", [1.0, 0.0])], "chunk_id string, domains array<string>, content_hash string, embedding array<double>")
    predicted = spark.createDataFrame([(1, ["x"]), (2, [])], "query_id long, predicted array<string>")
    asked = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "query_id long, variant int")
    got = fusion.multi_query_search(asked, dense, found, payload, predicted)
    one = fusion.hybrid_search(dense.where("query_id = 1").drop("variant"), found.where("query_id = 1").drop("variant"), payload, predicted)
    of = lambda df, q: [(r.rank, r.chunk_id, round(r.boosted_score, 12)) for r in df.where(F.col("query_id") == q).orderBy("rank").collect()]
    assert of(got, 1) == of(one, 1) and [c for _, c, _ in of(one, 1)] == ["b", "a", "d"]
    # variant 0 ranks a, d (a tie: the dense rank decides), variant 1 ranks b, a
    assert of(got, 2) == [(1, "a", round(1 / 61 + 1 / 62, 12)), (2, "b", round(1 / 61, 12)), (3, "d", round(1 / 62, 12))]
