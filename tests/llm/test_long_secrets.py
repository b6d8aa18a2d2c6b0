"""A secret that is assigned to a name is found and replaced in full, whatever its length."""

import base64
import hashlib

from gleaner.llm import secrets


def test_long_named_secrets(spark):
    raw = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(200))
    long, longer = base64.b64encode(raw[:1200]).decode(), base64.b64encode(raw).decode().rstrip("=")
    rows = [(1, f"see private_key={long} here"), (2, f'set token = "{longer}" and more'), (3, "nothing")]
    docs, model = spark.createDataFrame(rows, "doc_id long, text string"), secrets.train(spark, 600)
    assert (len(long), len(longer)) == (1600, 8534)
    assert {(r.doc_id, r.value) for r in secrets.find_secrets(spark, docs, model).collect()} == {(1, long), (2, longer)}
    clean = {r.doc_id: r.text for r in secrets.redact(spark, docs, model).collect()}
    assert clean == {1: "see private_key=[SECRET] here", 2: 'set token = "[SECRET]" and more', 3: "nothing"}
