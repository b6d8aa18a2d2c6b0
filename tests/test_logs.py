"""Log rows carry no free text."""

from gleaner.operators import logs


def test_request_rows(spark):
    rows = [(1, "GET", "https://h/a/b?q=my chest hurts#x", 200, 0.0123, "private words"), (2, "POST", "/query", None, 1.0, None), (None, "GET", "/x" * 60 + "?y", 503, 0.5, "")]
    found = logs.request_rows(spark.createDataFrame(rows, "request_id long, method string, target string, status int, seconds double, body string"))
    got = {r.method + r.path[:8]: r for r in found.collect()}
    one, two, three = got["GET/a/b"], got["POST/query"], got["GET/x/x/x/x"]
    assert (one.path, one.status, one.level, one.duration_ms, one.body) == ("/a/b", 200, "INFO", 12.3, "<13 chars>")
    assert (two.status, two.level, two.body) == (500, "ERROR", "<none>") and three.request_id.startswith("row-") and three.body == "<0 chars>"
    assert "chest" not in str(found.collect()) and "private" not in str(found.collect())
    metrics = {r.status: r for r in logs.metric_rows(found).collect()}
    assert metrics[503].path == "<omitted: 120 chars>" and metrics[200].path == "/a/b"
    assert {(r.path, r.requests, r.errors) for r in logs.stage_metrics(logs.metric_rows(found)).collect()} == {("/a/b", 1, 0), ("/query", 1, 1), ("<omitted: 120 chars>", 1, 1)}
