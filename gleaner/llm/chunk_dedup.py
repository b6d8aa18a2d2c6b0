"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 32 bytes has its top bits clear, so an insertion moves
only the cuts around it. Chunks are compared by digest; consecutive chunks that other documents hold too make a
repeated passage, which stays in the document of smallest id and goes elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import split_among, staged

#: Least and most bytes of a chunk; a cut has BITS clear bits, so a chunk holds about LEAST + 2 ** BITS bytes.
LEAST, MOST, BITS = 16, 192, 5
#: Words of the shortest passage that counts, as seen in whole chunks: up to about 25 more lie in the chunks at its ends.
MIN_WORDS = 24

GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), "<u4")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of GEAR[byte] << age over the last 32 bytes, by doubling the window."""
    h = GEAR[data]
    step = 1
    while step < 32:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    h = gear(data)
    marks = (np.flatnonzero(h < np.uint32(1 << (32 - BITS))) + 1).tolist()
    out, last, n = [], 0, len(data)
    for p in [*marks, n]:
        while p - last > MOST:  # the least hash in reach: content decides here too, and text that repeats itself is cut at its period
            last += LEAST + int(h[last + LEAST - 1 : last + MOST].argmin())
            out.append(last)
        if p - last >= LEAST:
            out.append(p)
            last = p
    if n and (not out or out[-1] < n):
        out.append(n)
    return out


def digest(raw: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(raw)


def _pairs(digests: list[bytes]) -> np.ndarray:
    """Digests of 128 bits as rows of two longs."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _chunks(batches) -> Iterator:
    import pyarrow as pa

    for b in batches:
        at, ends, digests, words, whole = [0], [], [], [np.zeros(0, np.int64)], []
        for text in b.column(1).to_pylist():
            raw = (text or "").encode("utf-8", "replace")
            data = np.frombuffer(raw, np.uint8)
            found = cuts(data)
            whole.append(digest(raw))
            if found:
                blank = _SPACE[data]
                begins = ~blank
                begins[1:] &= blank[:-1]
                words.append(np.diff(np.cumsum(begins)[np.array(found) - 1], prepend=0))
                digests += [digest(raw[a:e]) for a, e in zip([0, *found], found, strict=False)]
                ends += found
            at.append(len(ends))
        offsets, two, key = pa.array(at, pa.int32()), _pairs(digests), _pairs(whole)
        lists = [pa.array(ends, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(np.concatenate(words), pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(key[:, 0]), pa.array(key[:, 1]), *(pa.ListArray.from_arrays(offsets, x) for x in lists)], names=["doc_id", "t1", "t2", "ends", "d1", "d2", "words"]
        )


def repeated_passages(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row, doc_id, t1, t2, start, end (bytes of the text's UTF-8), words and first_doc of the passages that other documents hold too.

    A passage is a run of chunks whose digests (128 bits) occur in two documents at least, with min_words words or more.
    It falls into parts: those whose chunks all have this document as the smallest doc_id that holds them (first_doc is
    doc_id), and those whose chunks all have a smaller one (first_doc is the smallest of them). So a chunk is never cut
    from the first document that holds it. t1 and t2 are a digest of the text: rows of equal doc_id and text have
    equal passages. Null and empty texts have no chunks; rows of equal doc_id count as one document, but each row has its
    passages; null ids take no part; an empty table gives an empty result.
    """
    each = staged(
        spark,
        docs.where("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_chunks, "doc_id long, t1 long, t2 long, ends array<int>, d1 array<long>, d2 array<long>, words array<int>")
        .withColumn("row", F.monotonically_increasing_id()),
    )
    chunk = F.explode(F.arrays_zip("d1", "d2")).alias("c")
    seen = each.select("doc_id", chunk).groupBy("c.d1", "c.d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = staged(spark, seen.where("first <> last").select("d1", "d2", "first"))
    one = each.select("row", "doc_id", F.posexplode(F.arrays_zip("d1", "d2", "ends", "words")).alias("k", "c")).select("row", "doc_id", "k", "c.d1", "c.d2", F.col("c.ends").alias("end"), F.col("c.words").alias("words"))
    hit = split_among(one, "d1", shared.select("d1"))[0].join(shared, ["d1", "d2"]).withColumn("elsewhere", F.col("first") < F.col("doc_id"))
    in_row = Window.partitionBy("row").orderBy("k")
    runs = hit.withColumn("island", F.col("k") - F.row_number().over(in_row)).withColumn("part", F.sum(F.coalesce((F.col("elsewhere") != F.lag("elsewhere").over(in_row)).cast("int"), F.lit(0))).over(in_row))
    parts = (
        runs.groupBy("row", "doc_id", "island", "part")
        .agg(F.min("k").alias("k"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("first").alias("first_doc"))
        .withColumn("in_all", F.sum("words").over(Window.partitionBy("row", "island")))
        .where(F.col("in_all") >= min_words)
    )
    begin = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.get("ends", F.col("k") - 1))
    return parts.join(each.select("row", "t1", "t2", "ends"), "row").select("row", "doc_id", "t1", "t2", begin.alias("start"), "end", "words", "first_doc")


def repeated_documents(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_spans, repeated_bytes, removed_bytes and spans (start, end, first_doc, by start) of each row that holds a repeated passage."""
    found = repeated_passages(spark, docs, min_words)
    length = F.col("end") - F.col("start")
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.count("*").alias("n_spans"),
            F.sum(length).cast("long").alias("repeated_bytes"),
            F.sum(F.when(F.col("first_doc") < F.col("doc_id"), length).otherwise(0)).cast("long").alias("removed_bytes"),
            F.sort_array(F.collect_list(F.struct("start", "end", "first_doc"))).alias("spans"),
        )
        .drop("row")
    )


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the bytes of spans; a character that a span's end would split stays."""
    if text is None or not spans:
        return text
    raw, out, at = text.encode("utf-8", "replace"), [], 0
    for start, end in sorted(spans):
        while start < end and start < len(raw) and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:start])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode()


def _text_digests(at: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            two = _pairs([digest((t or "").encode("utf-8", "replace")) for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(two[:, 0]), pa.array(two[:, 1])], names=[*b.schema.names, "__t1", "__t2"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every repeated passage cut from text but in the document of smallest id; all rows and columns stay,
    but for columns __id, __t1, __t2, __g1, __g2 and __cut, which are used inside.

    Cuts are found by doc_id and text, so a row that shares its doc_id with another is cut by its own passages only.
    """
    spans = F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cut")
    gone = repeated_passages(spark, docs, min_words).where("first_doc < doc_id").groupBy("row", "doc_id", "t1", "t2").agg(spans)
    gone = staged(spark, gone.dropDuplicates(["doc_id", "t1", "t2"]).select(F.col("doc_id").alias("__id"), F.col("t1").alias("__g1"), F.col("t2").alias("__g2"), "__cut"))
    keyed = docs.drop("__cut", "__id", "__t1", "__t2", "__g1", "__g2")
    at = keyed.columns.index("text")
    fields = keyed.schema.fields
    keyed = keyed.mapInArrow(_text_digests(at), T.StructType([*fields, T.StructField("__t1", T.LongType()), T.StructField("__t2", T.LongType())])).withColumn("__id", F.col("doc_id").cast("long"))
    touched, rest = split_among(keyed, "__id", gone.select("__id"))
    same = (touched["__id"] == gone["__id"]) & (F.col("__t1") == F.col("__g1")) & (F.col("__t2") == F.col("__g2"))
    joined = touched.join(gone, same, "left").select(*(f.name for f in fields), "__cut")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cut = b.column(b.num_columns - 1).to_pylist()
            texts = [without(t, [(s["start"], s["end"]) for s in c or ()]) for t, c in zip(b.column(at).to_pylist(), cut, strict=True)]
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return joined.mapInArrow(run, T.StructType(fields)).unionByName(rest.select(*(f.name for f in fields)))
