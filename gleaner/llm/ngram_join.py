"""N-gram Jaccard join with set-relation skipping.

Index level: the shingles of a set fall into blocks by position (a hash of the shingle, as many blocks as two linked
sets of that size can differ in, and some more), and an index list holds the sets that agree on a whole block at one
position; everything else in that block's lists is skipped without being read. Two linked sets agree on at least one
block, so nothing is lost. Sets so small that linked ones are equal are one block. Blocks that
hold hardly any shingle select badly and are left out where the spare blocks allow that; where blocks are small,
frequent shingles are too. Answer level: candidate sets meet in bounded blocks; the answer of a set is derived from the computed
distances of a similar set, since Jaccard distance is a metric, and only pairs that the triangle inequality leaves
open are intersected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, release_memory, slices, split_among, staged, staged_parts
from .components import components

#: Word hashes that a worker remembers, and bytes of such a word; sets and shingles that meet in a task; sets whose distances are kept for others.
REMEMBERED, SHORT, SETS, SHINGLES, HUBS = 100_000, 64, 512, 1_500_000, 24
#: From this similarity on blocks are large: those of fewer than WEAK shingles are left out, and frequent shingles don't
#: matter. Below it blocks are small: only empty ones are left out, and frequent shingles are, see frequent().
LARGE, WEAK = (9, 10), 3
#: Documents of a batch and of all that hold a frequent shingle at least, and how many such shingles are sent to the tasks at most.
OFTEN_HERE, OFTEN, FREQUENT = 3, 32, 100_000
#: Documents, and bytes of their texts, whose shingles a task holds at a time; bytes of all texts whose postings make one bucket (they have about 0.6 bytes for one of text).
TOGETHER, BYTES, BUCKET = 2500, 16 << 20, 64 << 20
#: Groups of buckets at most, and bytes of all texts for one.
GROUPS, GROUP = 8, 16 << 20


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of width words; fewer words are one shingle, none are none."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = mixed(out + h[i : i + n] * np.uint64(2 * i + 3))
    return np.unique(out)


def _large(num: int, den: int) -> bool:
    return num * LARGE[1] >= LARGE[0] * den


@lru_cache(maxsize=8)
def schemes(num: int, den: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Bounds of the size classes, and for each class the number of position blocks and of spare ones.

    Linked sets lie in the same class or in neighbouring ones; the blocks of class b serve pairs of which the larger
    set is in b, so every set is posted under its own class and the next.
    """
    bounds, plans = [1], []
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * den // num + 1))
    for b in range(len(bounds) - 1):
        differ = 2 * (bounds[b + 1] - 1) * (den - num) // (den + num)
        spare = 1 + differ // 16 if _large(num, den) else 2 + differ // 6
        plans.append((differ + 1 + spare, spare))
    return bounds, plans


def signatures(h: np.ndarray, num: int, den: int, often: np.ndarray | None = None) -> np.ndarray:
    """The index lists of a set: one number for each block that it is posted under.

    Under a scheme whose linked sets are equal the whole set is one block. Two other linked sets
    agree on more blocks than are spare. If one of these holds a shingle, both post it; else both hold shingles in so few
    blocks that they post the empty ones too. Shingles in often (sorted) fill no block: without them linked sets differ in
    no more shingles than before. A set that is left with so few blocks is posted by all its shingles as well.
    """
    bounds, plans = schemes(num, den)
    own = int(np.searchsorted(bounds, len(h), side="right")) - 1
    if often is not None and not len(often):
        often = None
    if often is not None:
        rare = h[often[np.minimum(np.searchsorted(often, h), len(often) - 1)] != h]
    out = [np.zeros(0, np.uint64)]
    for scheme in (own, own + 1):
        blocks, spare = plans[scheme]
        differ = blocks - 1 - spare
        if not differ:
            if scheme == own:
                out.append(mixed(np.array([mixed(h).sum()], np.uint64) ^ mixed(np.array([scheme << 40], np.uint64))))
            continue
        for kind, x in enumerate((h,) if often is None else (rare, h)):
            at = ((x >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
            held = np.bincount(at, minlength=blocks)
            sums = np.zeros(blocks, np.uint64)
            np.add.at(sums, at, mixed(x))
            few = (held > 0).sum() <= differ
            keep = held >= (1 if not _large(num, den) else WEAK if len(x) >= WEAK * blocks else 2)
            if (~keep).sum() > spare:
                keep = held > 0
            if few and x is h:
                keep[:] = True
            named = np.flatnonzero(keep)
            out.append(mixed(sums[named] ^ mixed(named.astype(np.uint64) + np.uint64(scheme << 40 | kind << 60))))
            if not few:
                break
    return np.concatenate(out).astype(np.int64)


def links(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None, num: int, den: int) -> tuple[list[int], np.ndarray]:
    """For sets that meet in a task: a root for each, and the documents that it is linked to among them.

    With side only pairs across the two sides count. Distances of a hub decide most pairs of the sets near it.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(int(flat.max()) + 1, np.int64)
    root, count = list(range(len(sets))), np.zeros(len(sets), np.int64)
    hubs: list[np.ndarray] = []
    far = 1 - num / den

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def shared(x: int, others: np.ndarray) -> np.ndarray:
        marked[flat[start[x] : start[x + 1]]] = 1
        if len(others) == others[-1] - others[0] + 1:
            lo = start[others[0]]
            out = np.add.reduceat(marked[flat[lo : start[others[-1] + 1]]], start[others] - lo)
        else:
            parts = np.concatenate([flat[start[o] : start[o + 1]] for o in others])
            out = np.add.reduceat(marked[parts], np.concatenate([[0], np.cumsum(size[others])[:-1]]))
        marked[flat[start[x] : start[x + 1]]] = 0
        return out

    sides = None if side is None else side[order]
    for x in range(len(sets)):
        to = int(np.searchsorted(size, size[x] * den // num, side="right"))
        others = np.arange(x + 1, to)
        across = np.ones(len(others), bool) if sides is None else sides[others] != sides[x]
        if not across.any():
            continue
        linked = np.zeros(len(others), bool)
        near = min(hubs, key=lambda d: d[x], default=None)
        if near is not None and near[x] < far / 2:
            d = near[others]
            linked = across & (d + near[x] <= far - 1e-9)
            open_ = across & ~linked & ~(np.isfinite(d) & (np.abs(d - near[x]) > far + 1e-9))  # a hub's distances end with its size range
        else:
            open_ = np.ones(len(others), bool)
        if open_.any():
            which = others[open_]
            both = shared(x, which)
            union = size[x] + size[which] - both
            linked[open_] = across[open_] & (den * both >= num * union)
            if open_.all() and len(others) > 8:
                d = np.full(len(sets), np.inf)
                d[which], d[x] = 1 - both / union, 0
                hubs = [*hubs[-HUBS + 1 :], d]
        hit = others[linked]
        count[x] += copies[order[hit]].sum()
        count[hit] += copies[order[x]]
        for y in hit:
            a, b = top(x), top(int(y))
            if a != b:
                root[max(a, b)] = min(a, b)
    out, counted = [0] * len(sets), np.zeros(len(sets), np.int64)
    for x in range(len(sets)):
        out[order[x]] = int(order[top(x)])
        counted[order[x]] = count[x]
    return out, counted


def _slices(batches) -> Iterator:
    """Parts of TOGETHER rows and BYTES of text (the last column) at most, or one row."""
    for b in batches:
        yield from slices([b], b.num_columns - 1, TOGETHER, BYTES)


def _digests(width: int, num: int, den: int, buckets: int, often: np.ndarray | None):
    """Rows of documents (doc_id, n_shingles, digest), and rows of postings (bucket, posted, met) of each batch.

    Within a batch an index list is reduced to its smallest document; the others meet it here. So a list that many
    documents share leaves a batch as one posting. Postings are packed by byte plane.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        words = Words()
        for b in _slices(batches):
            ids = b.column(0).to_pylist()
            n, digest, lists, nodes, seen = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
            for i, text in zip(ids, b.column(1), strict=True):
                h = shingles(text.as_py(), width, words)
                n.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                if i is not None and len(h) and digest[-1] not in seen:
                    seen.add(digest[-1])
                    lists.append(signatures(h, num, den, often))
                    nodes.append(np.full(len(lists[-1]), i, np.int64))
            least, node, edges = _meet(np.concatenate(lists).view(np.uint64), np.concatenate(nodes))
            yield _rows(pa, ids, n, digest, None, None, None)
            at = least[0] % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            cut = np.searchsorted(at[order], np.arange(buckets + 1))
            sig, node = least[0][order] // np.uint64(buckets), node[order]
            bucket = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            posted = [_planes(sig[cut[k] : cut[k + 1]], node[cut[k] : cut[k + 1]]) for k in bucket]
            met = [edges.tobytes() if j == 0 else None for j in range(len(bucket))]
            if bucket:
                yield _rows(pa, None, None, None, bucket, posted, met)

    return run


def frequent(texts: DataFrame, width: int) -> np.ndarray:
    """Sorted shingles that many documents share: the FREQUENT most frequent of those in OFTEN documents or more.

    Batches pass on what OFTEN_HERE of their documents hold. All documents are counted; what is missed costs time only.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        words = Words()
        for b in _slices(batches):
            sets = {hashlib.blake2b(h.tobytes(), digest_size=16).digest(): h for h in (shingles(t.as_py(), width, words) for t in b.column(0))}
            found = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
            del sets
            found.sort()
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(found)), bool), found[1:] != found[:-1]]))
            which, n = found[start], np.diff(np.append(start, len(found)))
            often = n >= OFTEN_HERE
            yield pa.RecordBatch.from_arrays([pa.array(which[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["shingle", "n"])

    counts = texts.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).select("shingle").toArrow()  # at most FREQUENT numbers
    return np.sort(rows.column("shingle").to_numpy().astype(np.int64).view(np.uint64))


def _rows(pa, ids, n, digest, bucket, posted, met):
    size = len(ids if bucket is None else bucket)
    given = [(ids, pa.int64()), (n, pa.int64()), (digest, pa.binary()), (bucket, pa.int32()), (posted, pa.binary()), (met, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in given], names=["doc_id", "n_shingles", "digest", "bucket", "posted", "met"])


def _meet(sig: np.ndarray, node: np.ndarray) -> tuple[tuple[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct lists, the smallest node of each, and the distinct pairs (node, smallest) of the others."""
    if not len(sig):
        return (sig,), node, np.zeros((0, 2), np.int64)
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    low = np.minimum.reduceat(node, start)
    hub = np.repeat(low, np.diff(np.append(start, len(sig))))
    other = node != hub
    return (sig[start],), low, np.unique(np.stack([node[other], hub[other]], axis=1), axis=0)


def _planes(sig: np.ndarray, node: np.ndarray) -> bytes:
    """Seven bytes of each list and eight of each node, byte by byte, so that equal high bytes lie together."""
    return np.concatenate([np.ascontiguousarray(sig).view(np.uint8).reshape(-1, 8)[:, :7].T, np.ascontiguousarray(node).view(np.uint8).reshape(-1, 8).T]).tobytes()


def _candidates(table):
    """(a, b) pairs of documents of one bucket that meet in a list, a star around the smallest."""
    import pyarrow as pa

    sigs, nodes, out = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for blob in table.column("posted").to_pylist():
        x = np.frombuffer(blob, np.uint8).reshape(15, -1)
        sig = np.zeros((x.shape[1], 8), np.uint8)
        sig[:, :7] = x[:7].T
        sigs.append(sig.reshape(-1).view(np.uint64))
        nodes.append(np.ascontiguousarray(x[7:].T).reshape(-1).view(np.int64))
    for blob in table.column("met").to_pylist():
        if blob:
            out.append(np.frombuffer(blob, np.int64).reshape(-1, 2))
    out.append(_meet(np.concatenate(sigs), np.concatenate(nodes))[2])
    pairs = np.unique(np.concatenate(out), axis=0)
    del sigs, nodes, out
    release_memory()
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _sets(width: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        words = Words()
        for b in batches:
            found = [shingles(t.as_py(), width, words).astype(np.int64) for t in b.column(1)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            del found
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["node", "set"])
            release_memory()

    return run


def jaccard_classes(spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of docs(doc_id, text).

    Documents link when their sets of shingles of width words have a Jaccard similarity of num/den or more; a
    component's id is the smallest doc_id in it, and n_links counts the other documents that a document links to.
    Words are lower-cased (A-Z) runs outside white space. Null texts and texts without words have no shingles and no
    links; fewer words than width are one shingle; equal sets are one candidate, whatever their number; repeated rows
    are documents of their own; an empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(256, -(-size // BUCKET))
    shape = "doc_id long, n_shingles long, digest binary, bucket int, posted binary, met binary"
    often = None if _large(num, den) else frequent(texts, width)
    # Postings are half of all that is staged: they are shuffled a group of buckets at a time, and a group's are deleted when its pairs are written.
    groups = min(GROUPS, max(1, size // GROUP))
    group = F.when(F.col("bucket").isNull(), -1).otherwise(F.col("bucket") % groups)
    found = staged_parts(spark, texts.mapInArrow(_digests(width, num, den, buckets, often), shape).withColumn("group", group), "group")
    each = found(-1)[0].select("doc_id", "n_shingles", "digest")
    equal = staged(spark, each.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("n_shingles").alias("n")).where("node is not null"))

    met = spark.createDataFrame([], "a long, b long")
    for i in range(groups):
        posted, folder = found(i)
        met = met.union(staged(spark, posted.select("bucket", "posted", "met").groupBy("bucket").applyInArrow(_candidates, "a long, b long").distinct()))
        discard(spark, folder)
    # A batch knows its own copies only; here every document stands for its set's first one.
    ends = met.select(F.col("a").alias("doc_id")).union(met.select("b")).distinct()
    first = staged(spark, split_among(each.where("digest is not null"), "doc_id", ends)[0].join(ends, "doc_id").join(equal.select("digest", "node"), "digest").groupBy("doc_id").agg(F.min("node").alias("node")))
    a, b = (first.select(F.col("doc_id").alias(x), F.col("node").alias(f"{x}_node")) for x in "ab")
    met = met.join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    clusters = components(spark, met)

    members = staged(spark, clusters.join(equal.select("node", "copies", "n"), "node"))
    # A cluster that is small enough meets as a whole. Others fall into size classes, and a set meets the blocks of its own and
    # the neighbouring classes only: sets of classes further apart can't be linked.
    weights = members.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    total = weights.agg(F.sum("shingles")).first()[0] or 0
    bins = max(32, -(-total // (SHINGLES // 4)))
    large = (F.col("sets") > SETS) | (F.col("shingles") > SHINGLES)
    size_class = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in schemes(num, den)[0]]), lambda b: b <= F.col("n")))
    classed = members.join(weights, "label").select("node", "label", "copies", "n", F.when(large, size_class).otherwise(0).cast("long").alias("class"))
    parts = classed.groupBy("label", "class").agg(F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / SHINGLES)).cast("long").alias("blocks"))
    parts = staged(spark, parts)
    theirs = parts.select(F.col("label").alias("l"), F.col("class").alias("c"), F.col("blocks").alias("b"))
    near = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda k: F.col("c") * (1 << 32) + k)
    meets = parts.join(theirs, (F.col("label") == F.col("l")) & (F.abs(F.col("class") - F.col("c")) <= 1)).groupBy("label", "class", "blocks").agg(F.flatten(F.collect_list(near)).alias("others"))
    placed = classed.join(meets, ["label", "class"]).withColumn("block", F.col("class") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("blocks")))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    placed = placed.withColumn("alone", F.size("others") == 1).withColumn("other", F.explode("others"))
    placed = placed.select("node", "label", "copies", "block", low.alias("low"), high.alias("high"), F.when(F.col("alone"), F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.pmod(F.xxhash64("label", low, high), F.lit(1 << 40))).alias("bin"))

    wanted = members.select(F.col("node").alias("doc_id"))
    kept = split_among(texts, "doc_id", wanted)[0].join(wanted.distinct(), "doc_id")
    sets = kept.select("doc_id", "text").mapInArrow(_sets(width), "node long, set array<long>")

    def meet(table):
        import pyarrow as pa

        label, lo, hi = (table.column(c).to_numpy() for c in ("label", "low", "high"))
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        lists = table.column("set").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        out: list[tuple] = []
        order = np.lexsort((hi, lo, label))
        cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)) + 1
        for rows in np.split(order, cuts):
            rows = rows[np.unique(node[rows], return_index=True)[1]]  # a node once, if its document's id is repeated
            if len(rows) < 2:
                continue
            side = block[rows] if lo[rows[0]] != hi[rows[0]] else None
            root, count = links([flat[at[i] : at[i + 1]] for i in rows], copies[rows], side, num, den)
            least: dict[int, int] = {}
            for i, r in zip(rows, root, strict=True):
                least[r] = min(least.get(r, node[i]), node[i])
            out += [(node[i], least[r], c) for i, r, c in zip(rows, root, count, strict=True) if c]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        release_memory()
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

    found = staged(spark, placed.join(sets, "node").groupBy("bin").applyInArrow(meet, "a long, b long, links long"))
    reached = components(spark, found.select("a", "b"))
    linked = found.groupBy("a").agg(F.sum("links").alias("links"))
    answer = (
        equal.join(linked, equal["node"] == linked["a"], "left")
        .join(reached.select(F.col("node").alias("r"), "label"), F.col("node") == F.col("r"), "left")
        .select("digest", F.coalesce("label", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    answer = staged(spark, answer)
    return each.select("doc_id", "n_shingles", "digest").join(answer, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links")
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one document of each component: the one of smallest doc_id; all columns stay.

    Rows without an id or without words are kept; of rows of equal id and text one is.
    """
    found = staged(spark, jaccard_classes(spark, docs, width, num, den).where("doc_id is not null"))
    gone = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id")).where("doc_id <> component_id or rows > 1")
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long"))
    touched, rest = split_among(keyed.where("__id is not null"), "__id", gone.select(F.col("doc_id").alias("__id")))
    kept = touched.join(gone.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")), "__id", "left_anti").dropDuplicates(["__id", "text"])
    return rest.unionByName(kept).unionByName(keyed.where("__id is null")).select(*docs.columns)
