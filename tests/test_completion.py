"""Structured replies: what is accepted, one corrective pass, bounded retries, typed failures."""

import threading

import pytest

from gleaner.operators import completion

SCHEMA = "label string, confidence double"
GOOD = '{"label": "a", "confidence": 0.5}'


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        (GOOD, None), ("```json\n" + GOOD + "\n```", None), ("```\n" + GOOD + "\n```", None), ("  " + GOOD + "\n", None), ('{"label": "a", "confidence": 1, "more": [1]}', None),
        ("not json at all", "not a JSON object"), ("", "not a JSON object"), (None, "no reply"), ("[1, 2]", "not a JSON object"), ('"text"', "not a JSON object"), ('{"label": "a", "confidence": 0.5', "not a JSON object"),
        ('{"label": "x"}', "missing or of another type: confidence"), ('{"label": "x", "confidence": "high"}', "missing or of another type: confidence"), ('{"label": null, "confidence": 1.0}', "missing or of another type: label"), ("{}", "missing or of another type: label, confidence"),
    ],
)
def test_what_fits_the_schema(spark, reply, want):
    got = completion.checked(spark.createDataFrame([(1, reply)], "query_id long, reply string"), SCHEMA).first()
    assert (got.problem is None) if want is None else (want in (got.problem or "") and got.parsed is None)
    if want is None:
        assert got.parsed.label == "a"


def fake():
    def complete(prompt):
        kind = prompt.split("\n")[0]
        again = "failed validation" in prompt
        if kind == "down":
            raise completion.Transient("no route")
        if kind == "key":
            raise completion.Fatal("refused")
        return {"good": GOOD, "mends": GOOD if again else "oops", "never": "oops"}[kind]

    return complete


def test_one_corrective_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, "good"), (2, "mends"), (3, "never"), (4, "down"), (5, "key"), (6, "good\nmore")], "query_id long, prompt string")
    found = completion.complete_structured(rows, fake, SCHEMA, str(tmp_path), attempts=2, base=0.001)
    got = {r.query_id: (r.parsed and r.parsed.label, r.error_kind, r.passes) for r in found.collect()}
    assert got == {1: ("a", None, 1), 2: ("a", None, 2), 3: (None, "schema", 2), 4: (None, "transient", 1), 5: (None, "fatal", 1), 6: ("a", None, 1)}
    assert sorted(r.query_id for r in spark.read.parquet(f"{tmp_path}/second").collect()) == [2, 3]


def test_retries_are_bounded():
    waits, calls = [], []

    def flaky(n):
        def complete(prompt):
            calls.append(prompt)
            if len(calls) <= n:
                raise completion.Transient("later")
            return "done"

        return complete

    assert completion.call_once(flaky(2), "p", 5, waits.append) == ("done", None, None, 3) and waits == [0, 1]
    calls.clear()
    waits.clear()
    assert completion.call_once(flaky(9), "p", 3, waits.append) == (None, "transient", "Transient: later", 3) and waits == [0, 1]

    class Odd(completion.Transient, completion.Fatal):
        pass

    def odd(_):
        raise Odd("both")

    assert completion.call_once(odd, "p", 3, waits.append)[1:] == ("fatal", "Odd: both", 1)
    with pytest.raises(ZeroDivisionError):
        completion.call_once(lambda _: 1 / 0, "p", 3, waits.append)
    assert [completion.delay(a, draw=lambda: 1.0) for a in range(7)] == [2, 4, 8, 16, 32, 60, 60] and completion.delay(3, draw=lambda: 0.0) == 8


def test_calls_in_flight_are_bounded(spark):
    def factory():
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def complete(prompt):
            import time

            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.01)
            with lock:
                state["now"] -= 1
                return str(state["most"])

        return complete

    rows = spark.range(60).selectExpr("id as query_id", "'p' as prompt").coalesce(1)
    got = completion.call_rows(rows, factory, in_flight=3).collect()
    assert [r.query_id for r in got] == list(range(60)) and max(int(r.reply) for r in got) in (2, 3)
