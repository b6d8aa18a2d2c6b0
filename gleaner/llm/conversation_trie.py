"""Prefix trie of conversations: digests name the nodes, pointer jumping sums up subtrees in logarithmically many rounds.

Defined results. Rows without a conv_id take no part. Turns of one number are ordered by role, then by text; repeated rows
are turns of their own. An empty table gives an empty result, not even a root. Only conv_id, turn, role and text are read,
so further columns may bear any name.

A node's digest is the sum of 128-bit hashes of its turns, each taken with its depth, so prefixes add up in any order and
no task must hold a conversation, however long.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, staged_at

#: A rebuilt conversation begins with fewer than HEADS turns of the first of its GROUP.
GROUP, HEADS = 100, 6
#: Prefix digests are summed up within stretches of so many turns, then over stretches.
STRETCH = 4096
#: So many ids are joined to one text before a node's ids meet in order.
PACKED = 500
#: The digest of no turn at all.
ROOT = "0" * 32

WORDS = ("d0", "d1", "d2", "d3")
MASK = (1 << 32) - 1


def _words_of(text: Column) -> list[Column]:
    """The four 32-bit words of the MD5 of text, as longs."""
    digest = F.md5(text.cast("binary"))
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(WORDS)]


def _name(sums: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(MASK)))), 8, "0") for x in sums])


def numbered_turns(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, str]:
    """conv_id, pos (from 1, in the order of turns), content (a digest of role and text), chars; and the folder of what was sorted.

    All turns are sorted together by ranges, so a long conversation lies in several tasks; a turn's place is its place in its
    task plus what earlier tasks hold of the conversation, and only conversations that cross tasks, two a task, need that.
    """
    given = turns.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ranges = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32)]
    order = given.repartitionByRange(*ranges).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    content = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    kept, at = staged_at(spark, order.select(F.monotonically_increasing_id().alias("at"), "conv_id", content.alias("content"), F.length("text").cast("long").alias("chars")))
    kept = kept.withColumn("task", F.shiftright("at", 33))
    within = kept.withColumn("local", F.row_number().over(Window.partitionBy("conv_id", "task").orderBy("at")))
    pieces = kept.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("conv_id", "task", F.sum("n").over(earlier).alias("before")).where("before is not null")
    numbered = within.join(F.broadcast(carried), ["conv_id", "task"], "left")
    return numbered.select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "content", "chars"), at


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, size, content, chars of each rebuilt turn, and conv_id, size of each conversation; from numbered turns."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": h, "first": F.col("conv_id") - F.col("conv_id") % GROUP})
    lengths = convs.select(F.col("conv_id").alias("first"), F.col("own").alias("first_own"))
    convs = convs.join(lengths, "first", "left").withColumn("head", F.least("h", F.coalesce("first_own", F.lit(0))))
    convs = convs.withColumn("size", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "first", "h", "head", "size")
    heads = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("first"), "pos", "content", "chars").join(convs, "first").where("pos <= h")
    heads = heads.select("conv_id", F.col("pos").alias("depth"), "size", "content", "chars")
    rest = turns.where(F.col("pos") > h).join(convs, "conv_id").select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "size", "content", "chars")
    return heads.unionAll(rest), convs.select("conv_id", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """node, parent, depth, conv_id, chars, ends (whether the conversation ends here) of each turn of a rebuilt conversation."""
    each = turns.select("conv_id", "depth", "size", "chars", F.floor((F.col("depth") - 1) / STRETCH).alias("stretch"), *_words_of(F.concat_ws(":", F.col("depth").cast("string"), "content")))
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = each.withColumns({f"s{w}": F.sum(w).over(within) for w in WORDS})
    over = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = each.where(F.col("size") > STRETCH).groupBy("conv_id", "stretch").agg(*[F.sum(w).alias(w) for w in WORDS])
    carried = whole.select("conv_id", "stretch", *[F.sum(w).over(over).alias(f"c{w}") for w in WORDS])
    all_sums = sums.join(carried, ["conv_id", "stretch"], "left")
    here = [F.col(f"s{w}") + F.coalesce(F.col(f"c{w}"), F.lit(0)) for w in WORDS]
    return all_sums.select(_name(here).alias("node"), _name([s - F.col(w) for s, w in zip(here, WORDS, strict=True)]).alias("parent"), "depth", "conv_id", "chars", (F.col("depth") == F.col("size")).alias("ends"))


def _packed(batches):
    """Sorted (node, conv_id) to (node, first, ids): PACKED ids of a node in one text."""
    import pyarrow as pa

    node, held = None, []

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["node", "first", "ids"])

    for b in batches:
        done = []
        for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and (n != node or len(held) == PACKED):
                done.append((node, held[0], ",".join(map(str, held))))
                held = []
            node = n
            held.append(c)
        yield out(done)
    if held:
        yield out([(node, held[0], ",".join(map(str, held)))])


def _digested(batches):
    """Sorted (node, first, ids) to (node, ends_sha256): a running digest, never a node's ids at once."""
    import pyarrow as pa

    node, running = None, None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["node", "ends_sha256"])

    for b in batches:
        done = []
        for n, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if n != node:
                if running:
                    done.append((node, running.hexdigest()))
                node, running = n, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield out(done)
    if running:
        yield out([(node, running.hexdigest())])


def ending_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of ends(node, conv_id): of the ids in order, joined by commas.

    Ranges of (node, conv_id) are packed to texts first, so what meets in the one task that must read a node's ids in order
    is a row for PACKED of them.
    """
    ranges = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    packs = ranges.mapInArrow(_packed, "node string, first long, ids string")
    return packs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node string, ends_sha256 string")


def subtree_sums(spark: SparkSession, nodes: DataFrame, *values: str) -> tuple[DataFrame, str]:
    """nodes(node, parent, depth, ...) with values summed over each subtree, in node and the values' names; and their folder.

    Before round k a node's sums cover what lies less than 2^k below it, and its pointer names the node 2^k above it. Each
    round adds what the nodes that point here have, summed up before it is shuffled, and doubles the pointers.
    """
    now, at = staged_at(spark, nodes.select("node", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), "depth", *values))
    deepest, reach = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        below = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        summed = now.join(below, "node", "left").select("node", "up", "depth", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        far, near = summed.where(F.col("depth") >= 2 * reach), summed.where(F.col("depth") < 2 * reach).withColumn("up", F.lit(None).cast("string"))
        jump = now.where(F.col("depth") >= reach).select(F.col("node").alias("via"), F.col("up").alias("further"))
        far = far.join(jump, F.col("up") == F.col("via"), "left").select("node", F.col("further").alias("up"), "depth", *values)
        after, to = staged_at(spark, far.unionAll(near))
        discard(spark, at)
        now, at, reach = after, to, 2 * reach
    return now.select("node", *values), at


def trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and node, its digest."""
    turns, sorted_at = numbered_turns(spark, conversations)
    turns, turns_at = staged_at(spark, turns)
    discard(spark, sorted_at)
    each, convs = rebuilt(turns)
    each, each_at = staged_at(spark, prefixes(each))
    below = each.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = top.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = below.select("node", "parent", F.col("depth").cast("long").alias("depth"), "conv_id", "n_convs", "chars").unionAll(root)
    nodes, nodes_at = staged_at(spark, nodes)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes_and = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    valued, valued_at = staged_at(spark, nodes_and.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}))
    discard(spark, nodes_at)
    sums, _ = subtree_sums(spark, valued, "n_leaves", "saved_tokens")
    ends = each.where("ends").select("node", "conv_id").unionAll(convs.where("size = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    digests, _ = staged_at(spark, ending_digests(ends))
    discard(spark, each_at)
    discard(spark, turns_at)
    # a child of the root needs no join for its parent's id: the root may have most of the nodes as children
    over = valued.where("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top_id = F.broadcast(valued.where("depth = 0").select(F.col("conv_id").alias("root_conv_id")))
    deep = valued.where("depth > 1").join(over, "parent", "left").select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children")
    flat = valued.where("depth <= 1").crossJoin(top_id).select("node", "conv_id", "depth", F.when(F.col("depth") == 1, F.col("root_conv_id")).alias("parent_conv_id"), "n_convs", "n_children")
    found = deep.unionAll(flat).join(sums, "node").join(digests, "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "node")
