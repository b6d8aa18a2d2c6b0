"""A sliding-window rate limiter per key, whose window holds accepted events only; in batch and as a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Answers are handed out so many at a time.
SLICE = 10_000
#: A stream's watermark starts at 1970-01-01 00:00 and takes what isn't later for late: event times are shifted by a day, so that time 0 counts.
SHIFT = 86_400.0
OUT = "key {key}, event_id long, at double, accepted boolean, retry_after int"


def decide(times: list[float], held: deque, limit: int, window: float) -> Iterator[tuple[bool, int | None]]:
    """Whether each time, in order, is accepted; held keeps the accepted ones of the window. A rejected event isn't held."""
    for t in times:
        while held and held[0] < t - window:
            held.popleft()
        if len(held) >= limit:
            yield False, max(1, int(held[0] + window - t) + 1)
        else:
            held.append(t)
            yield True, None


def limit_batch(events: DataFrame, limit: int, window: float) -> DataFrame:
    """events(key, event_id, at seconds) with accepted and retry_after. Acceptance feeds back, so no window frame says it.

    Spark sorts the events of a key and may spill; a task reads them in batches and holds the accepted times of the window
    of one key, at most limit of them. An event without a time is neither accepted nor rejected: both are null.
    """
    schema = OUT.format(key=dict(events.dtypes)["key"])

    def run(batches):
        import pyarrow as pa

        held, last = deque(), object()
        for b in batches:
            said = []
            for key, t in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), strict=True):
                if key != last:
                    held, last = deque(), key
                said.extend([(None, None)] if t is None else decide([t], held, limit, window))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([a for a, _ in said], pa.bool_()), pa.array([r for _, r in said], pa.int32())], names=["key", "event_id", "at", "accepted", "retry_after"])

    return events.select("key", "event_id", "at").repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, schema)


class Limiter(StatefulProcessor):
    """The same over a stream: a key's accepted times are its state, at most limit of them, and the time it was decided for last.

    A key's clock doesn't run backwards: an event that is older than the last one is decided for at the last one's time. A timer clears
    the state once the watermark says that no event can come that what is held would still bear on.
    """

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")
        self.last = handle.getValueState("last", "at double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(p["at"].to_numpy(float), p["event_id"].to_numpy("int64")) for p in rows]  # 16 bytes an event; the frames go
        at, event_id = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.lexsort((event_id, at))
        at, event_id = at[order], event_id[order]
        held = deque(x[0] for x in self.times.get())
        was = self.last.get()
        decided = np.maximum(at, was[0]) if was else at
        for i in range(0, len(at), SLICE):
            said = list(decide(decided[i : i + SLICE].tolist(), held, self.limit, self.window))
            answers = {"accepted": [a for a, _ in said], "retry_after": pd.array([r for _, r in said], dtype="Int32")}
            yield pd.DataFrame({"key": [key[0]] * len(said), "event_id": event_id[i : i + SLICE], "at": at[i : i + SLICE], **answers})
        self.times.put([(t,) for t in held])
        expires = int((decided[-1] + self.window + SHIFT) * 1000) + 1
        if was:
            self.handle.deleteTimer(was[1])
        self.handle.registerTimer(expires)
        self.last.update((float(decided[-1]), expires))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.times.clear()
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, limit: int, window: float, delay: str = "1 hour") -> DataFrame:
    """limit_batch over a stream of events(key, event_id, at seconds); answers come with the micro-batch that brings the event.

    Events that come later than delay behind the newest one are dropped by the watermark, and the query's progress counts them. An event
    without a time is neither accepted nor rejected: both are null. Needs the RocksDB state store.
    """
    schema = OUT.format(key=dict(events.dtypes)["key"])
    each = events.select("key", "event_id", "at")
    timed = each.where("at is not null").withColumn("time", F.timestamp_micros(((F.col("at") + SHIFT) * 1e6).cast("long"))).withWatermark("time", delay)
    decided = timed.groupBy("key").transformWithStateInPandas(Limiter(limit, window), outputStructType=schema, outputMode="append", timeMode="eventTime")
    untimed = each.where("at is null").select("*", F.lit(None).cast("boolean").alias("accepted"), F.lit(None).cast("int").alias("retry_after"))
    return decided.unionByName(untimed)


def replay(spark: SparkSession, events: DataFrame, limit: int, window: float, folder: str, parts: int = 5, delay: str = "1 hour") -> DataFrame:
    """limit_stream over a table in so many runs, by time, each of which goes on from the state that the one before has stored.

    The events arrive in folder/in, the answers are in folder/out; both and the state must lie where all executors reach them.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # timers of a run fire in the next one: no batch for them alone
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        cuts = events.approxQuantile("at", [i / parts for i in range(1, parts)], 0.001)
        schema = events.select("key", "event_id", "at").schema
        edges = [None, *cuts, None]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            some = events.where((F.lit(low is None) if low is None else F.col("at") >= low) & (F.lit(True) if high is None else F.col("at") < high))
            if low is None:
                some = some.unionByName(events.where("at is null"))
            some.select(*schema.names).write.mode("append").parquet(f"{folder}/in")
            stream = limit_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), limit, window, delay)
            run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
            run.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUT.format(key=dict(events.dtypes)["key"])).parquet(f"{folder}/out")
