"""The answer plan: exits before the next costly step, fallbacks that are shown, a small final plan."""

import re

from pyspark.sql import functions as F

from gleaner.plans.answer import answer_batch

VOCABULARY = {"emergency": ["chest", "bleeding"], "primary-care": ["cough"]}


def tables(spark):
    asked = [(1, "prescribe me something for my cough"), (2, "mild cough since monday"), (3, "chest pain and bleeding"), (4, "zzz qqq"), (5, "")]
    texts = [(1, "Chest pain needs care. Call now."), (2, "A mild cough since monday. Rest."), (3, "Bleeding stops with pressure. Take 500 mg daily."), (4, None), (5, "")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").withColumn("domains", F.array(F.lit("emergency")))
    return spark.createDataFrame(asked, "query_id long, query string"), chunks


def test_exits(spark, tmp_path):
    asked, chunks = tables(spark)
    found = answer_batch(asked, chunks, VOCABULARY, str(tmp_path), seconds=3600.0)
    got = {r.query_id: r for r in found.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].refusal_reason, got[1].sufficiency, got[1].support_count, got[1].evidence) == ("PRESCRIPTION_REQUEST", "OUT_OF_SCOPE", 0, None)
    assert got[2].status == "success" and got[2].evidence[0] == 2 and got[2].statements > 0
    assert got[4].refusal_reason == "OUT_OF_SCOPE" and got[4].statements == 0 and all(r.urgency for r in got.values())
    searched = {r.query_id for r in spark.read.parquet(f"{tmp_path}/ranked").collect()}
    assert 1 not in searched and {2, 3} <= searched  # a request for a prescription isn't searched for
    assert {4, 5}.isdisjoint({r.query_id for r in spark.read.parquet(f"{tmp_path}/said").collect()})  # behind the gate nothing is generated
    plan = found._jdf.queryExecution().simpleString()
    assert len(re.findall(r"FileScan", plan)) < 20


def test_fallback_is_shown(spark, tmp_path):
    def fails(query, texts):
        raise RuntimeError("no model")

    asked, chunks = tables(spark)
    got = {r.query_id: r for r in answer_batch(asked, chunks, VOCABULARY, str(tmp_path), scorer=fails).collect()}
    assert got[2].fallback_reason == "RuntimeError" and got[1].fallback_reason is None and got[2].evidence
