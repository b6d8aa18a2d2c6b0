"""Calls of a text model over rows: bounded retries of a failing transport, replies checked against a schema, one corrective pass.

The two failures are kept apart. A call that fails in transport is made again as it was, after a delay; a reply that doesn't fit the
schema is asked for once more, and the prompt says why. Neither stops the batch: what fails for good is a row with its kind of error.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import fenced_json

#: Attempts of a call, and the seconds between them: the first delay, which doubles, and the longest.
ATTEMPTS, BASE_DELAY, MOST_DELAY = 5, 2.0, 60.0
#: Fixed value: what is added to the prompt of a rejected reply.
CORRECTION = "\n\nYour previous response failed validation: {0}. Return ONLY valid JSON."
REPLY = "prompt string, reply string, error_kind string, error string, attempts int"


class Transient(Exception):
    """A transport failure that may pass."""


class Fatal(Exception):
    """A failure that no repetition mends, such as a refused key; checked first, also where it is a kind of the other."""


def delay(attempt: int, base: float = BASE_DELAY, most: float = MOST_DELAY, draw: Callable[[], float] = random.random) -> float:
    """Seconds to wait after an attempt (from 0): doubled each time, capped, the upper half of it by chance."""
    return min(base * 2.0**attempt, most) * (0.5 + 0.5 * draw())


def call_once(complete: Callable[[str], str], prompt: str, attempts: int, wait: Callable[[int], None], retryable: tuple = (Transient,), fatal: tuple = (Fatal,)) -> tuple:
    """reply, error_kind, error, attempts of one prompt."""
    for attempt in range(attempts):
        try:
            return complete(prompt), None, None, attempt + 1
        except fatal as e:
            return None, "fatal", f"{type(e).__name__}: {e}", attempt + 1
        except retryable as e:
            last = f"{type(e).__name__}: {e}"
            if attempt < attempts - 1:
                wait(attempt)
    return None, "transient", last, attempts


def call_rows(
    rows: DataFrame, factory: Callable[[], Callable[[str], str]], key: str = "query_id", attempts: int = ATTEMPTS, in_flight: int = 4, base: float = BASE_DELAY, most: float = MOST_DELAY,
    retryable: tuple = (Transient,), fatal: tuple = (Fatal,),
) -> DataFrame:
    """key, prompt, reply, error_kind (transient, fatal or null), error, attempts of rows(key, prompt).

    factory makes a task's caller. A task has at most in_flight calls open at once, so partitions times in_flight bound the load on the
    service; replies come in the order of the rows. An exception of another kind is a fault of the program and fails the task.
    """

    def run(batches):
        import pyarrow as pa

        complete = factory()
        wait = lambda attempt: time.sleep(delay(attempt, base, most))
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                prompts = b.column(1).to_pylist()
                said = list(pool.map(lambda p: call_once(complete, p or "", attempts, wait, retryable, fatal), prompts))
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([x[i] for x in said], t) for i, t in enumerate(kinds)]], [key, "prompt", "reply", "error_kind", "error", "attempts"])

    return rows.select(key, "prompt").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {REPLY}")


def checked(replies: DataFrame, schema: str, reply: str = "reply") -> DataFrame:
    """replies with parsed and problem: a fence is taken off, then the reply must be one JSON object that has each field of schema in its type.

    Fields that schema doesn't name are ignored; all that it names are required. Types are taken strictly: a number in quotes is none.
    """
    from pyspark.sql.types import StringType

    names = [f.name for f in StructType.fromDDL(schema)]
    kept = StructType.fromDDL(schema).add("__corrupt", StringType())
    text = fenced_json(F.col(reply))
    found = F.from_json(text, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    rows = replies.withColumn("__found", found)
    missing = F.array_compact(F.array(*[F.when(F.col(f"__found.{n}").isNull(), F.lit(n)) for n in names]))
    shape: Column = ~F.coalesce(text.rlike(r"(?s)^\{.*\}$"), F.lit(False)) | F.col("__found").isNull()
    broken = F.col("__found.__corrupt").isNotNull()
    problem = (
        F.when(F.col(reply).isNull(), F.lit("no reply")).when(shape | (broken & (F.size(missing) == len(names))), "not a JSON object of the schema")
        .when(F.size(missing) > 0, F.concat(F.lit("missing or of another type: "), F.array_join(missing, ", "))).when(broken, "not a JSON object of the schema")
    )
    fields = F.struct(*[F.col(f"__found.{n}").alias(n) for n in names])
    return rows.withColumn("problem", problem).withColumn("parsed", F.when(F.col("problem").isNull(), fields)).drop("__found")


def complete_structured(rows: DataFrame, factory: Callable[[], Callable[[str], str]], schema: str, scratch: str, key: str = "query_id", **calls) -> DataFrame:
    """key, parsed, error_kind (null, schema, transient or fatal), error, passes of rows(key, prompt).

    Replies are written to scratch, a shared folder, so no call is made twice because a result is read twice or an executor is lost later.
    Rows whose reply is rejected, and only those, are asked for once more with the reason in their prompt. A null prompt is an empty one.
    """
    spark = rows.sparkSession

    def asked(part: DataFrame, name: str) -> DataFrame:
        found = call_rows(part, factory, key, **calls)
        found.write.parquet(f"{scratch}/{name}")
        return checked(spark.read.schema(found.schema).parquet(f"{scratch}/{name}"), schema)

    prompts = rows.select(key, F.coalesce("prompt", F.lit("")).alias("prompt"))
    first = asked(prompts, "first")
    rejected = F.col("error_kind").isNull() & F.col("problem").isNotNull()
    fix = F.concat(F.col("prompt"), F.replace(F.lit(CORRECTION), F.lit("{0}"), F.col("problem")))
    second = asked(first.where(rejected).select(key, fix.alias("prompt")), "second")
    ends = lambda part, n: part.select(
        key, "parsed", F.when(F.col("error_kind").isNotNull(), F.col("error_kind")).when(F.col("problem").isNotNull(), "schema").alias("error_kind"), F.coalesce("error", "problem").alias("error"), F.lit(n).alias("passes")
    )
    return ends(first.where(~rejected), 1).unionByName(ends(second, 2))
