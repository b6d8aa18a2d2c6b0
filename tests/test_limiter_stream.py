"""The limiter over a stream: runs that go on from stored state, null and late times, state that is cleared."""

import random
from collections import deque

from gleaner.streaming import limiter

SCHEMA = "key string, event_id long, at double"


def rows_of(found):
    return sorted((str(r.key), r.event_id, r["at"], r.accepted, r.retry_after) for r in found.collect())


def test_replay_equals_the_batch(spark, tmp_path):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None, "c"]), i, round(rng.random() * 400, 3)) for i in range(300)]
    rows += [("a", 900, None), ("b", 901, None), ("d", 902, 10.0), ("d", 903, 10.0), ("d", 904, 10.0)]
    events = spark.createDataFrame(rows, SCHEMA)
    got = limiter.replay(spark, events, 2, 20.0, str(tmp_path / "replay"))
    assert [tuple(str(x) for x in r) for r in sorted(rows_of(got), key=str)] == [tuple(str(x) for x in r) for r in sorted(rows_of(limiter.limit_batch(events, 2, 20.0)), key=str)]


def run_once(spark, tmp_path, rows, limit=1, window=10.0, delay="1 hour"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = limiter.limit_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), limit, window, delay)
    out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    q = out.outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_null_times_do_not_stop_the_stream(spark, tmp_path):
    run_once(spark, tmp_path, [("a", 1, 5.0), ("a", 2, None), ("a", 3, 6.0)], limit=1)
    run_once(spark, tmp_path, [("a", 4, 30.0), ("a", 5, 31.0), ("a", 6, None)], limit=1)
    got = {r.event_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: None, 3: False, 4: True, 5: False, 6: None}


def test_a_late_event_is_decided_at_the_last_time(spark, tmp_path):
    run_once(spark, tmp_path, [("a", 1, 100.0)])
    run_once(spark, tmp_path, [("a", 2, 50.0)])  # within the delay: decided as if at 100
    run_once(spark, tmp_path, [("a", 3, 110.5)])
    got = {r.event_id: (r["at"], r.accepted, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (100.0, True, None), 2: (50.0, False, 11), 3: (110.5, True, None)}


def test_state_of_stale_keys_is_cleared(spark, tmp_path):
    run_once(spark, tmp_path, [("old", 1, 100.0), ("old", 2, 101.0)], delay="1 second")
    run_once(spark, tmp_path, [("new", 3, 5000.0)], delay="1 second")
    run_once(spark, tmp_path, [("new", 4, 9000.0), ("old", 5, 9000.0)], delay="1 second")
    state = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "state"))
    held = {r.key["key"] for r in state.select("key").collect()}
    assert "old" in held and "new" in held
    run_once(spark, tmp_path, [("new", 6, 20000.0)], delay="1 second")
    run_once(spark, tmp_path, [("new", 7, 20001.0)], delay="1 second")
    state = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "state"))
    assert {r.key["key"] for r in state.select("key").collect()} == {"new"}


def test_held_times_never_exceed_the_limit():
    held = deque()
    list(limiter.decide([i / 10 for i in range(1000)], held, 3, 7.0))
    assert len(held) <= 3
