"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

Each set gets a signature of 16-bit MinHash symbols (b-bit minwise hashing).
The signature is cut into chunks; by the pigeonhole principle two signatures
that differ in fewer symbols than twice the chunks agree on some chunk but for
one symbol at most. Every chunk is therefore indexed once for each symbol it
may get wrong, with that symbol left out: two signatures under the distance
threshold always share a key (Norouzi et al., "Fast Search in Hamming Space
with Multi-Index Hashing"). The number of chunks is chosen so that a pair at
the similarity threshold exceeds the distance with a probability of at most
``MISS``.

Equal sets are one node from the start, so copies never meet pairwise. A
bucket does not emit its pairs either: its members are compared with one
centre, verified links are joined to components, and only members that are
still in different components are compared further: as pairs where they are
few, else in blocks of sets of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, join_hot, row_count_at_most
from loomspan.llm.components import connected_components

CHUNK = 5
MISS = 1e-5
#: Ids that may be broadcast to filter a scan: 16 MB at most.
BROADCAST_IDS = 1_000_000
#: A bucket may emit this many pairs a member; beyond it its nodes are compared in blocks of sets.
PAIRS_A_MEMBER = 32
#: Members of a bucket one task may hold; a larger bucket goes to the blocks of sets at once.
BUCKET_ROWS = 20_000
#: Shingles of one block of crowded nodes.
BLOCK_SHINGLES = 100_000
#: Shingles and nodes of a block that are turned into bits at once.
TILE_SHINGLES = 25_000
TILE_ROWS = 2_048


@lru_cache(maxsize=16)
def chunks_for(threshold: float) -> int:
    """Chunks needed so that a pair at ``threshold`` differs in 2 * chunks symbols or more with probability <= MISS."""
    for m in range(4, 64):
        n, p = m * CHUNK, 1 - threshold
        if sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(2 * m, n + 1)) <= MISS:
            return m
    raise ValueError("the threshold is too low for this index")


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are parted by ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out = out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k + width)
    return np.unique(out ^ (out >> np.uint64(32)))


@lru_cache(maxsize=16)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 64, (n, 1), np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, (n, 1), np.uint64)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash symbols of 16 bits; ``hashes`` must not be empty."""
    a, b = _permutations(n)
    least = np.full((n, 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[None, at : at + 4096] * a + b
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        least = np.minimum(least, mixed.min(axis=1, keepdims=True))
    return (least[:, 0] >> np.uint64(48)).astype(np.uint16)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """For each chunk and each symbol left out of it, a 64-bit key over the other symbols and their place."""
    m = len(sig) // CHUNK
    rows = sig.reshape(m, CHUNK).astype(np.uint64)
    out = np.empty((m, CHUNK), np.uint64)
    for drop in range(CHUNK):
        key = (np.arange(m, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(drop + 1)) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(CHUNK):
            if k != drop:
                key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
        out[:, drop] = key
    return out.reshape(-1).view(np.int64)


def _fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _describe(width: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                docs = batch.column(0)[at : at + 1024]
                sizes, marks, sigs = [], [], []
                for text in batch.column(1)[at : at + 1024]:
                    hashes = shingle_set(text.as_py() or "", width)
                    sizes.append(len(hashes))
                    marks.append(_fingerprint(hashes) if len(hashes) else None)
                    sigs.append(signature(hashes, n).tobytes() if len(hashes) else None)
                yield pa.record_batch(
                    [docs, pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "mark", "sig"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            ids = batch.column(0)[at : at + 2048]
            keys = [index_keys(np.frombuffer(s.as_py(), np.uint16)) for s in batch.column(1)[at : at + 2048]]
            if keys:
                node = np.repeat(ids.to_numpy(), len(keys[0]))
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(node, pa.int64())], names=["key", "node"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(1)[at : at + 512]
                sets = [shingle_set(t.as_py() or "", width).tobytes() for t in texts]
                yield pa.record_batch([batch.column(0)[at : at + 512], pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (one, two))
                both = 0
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    short, long = (x, y) if len(x) < len(y) else (y, x)
                    at = np.searchsorted(long, short)
                    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return run


def _bucket_pairs(distance: int):
    """Per bucket, pairs of nodes in different components within ``distance``.

    A bucket in which they are many gives its nodes instead, as (node, null,
    least node of the bucket); those are compared in blocks of sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, 1):
            node, comp = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
            sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), -1)
            budget, found = PAIRS_A_MEMBER * len(node), []
            for at in range(len(node) - 1):
                far = (sig[at + 1 :] != sig[at]).sum(axis=1)
                hit = np.flatnonzero((far <= distance) & (comp[at + 1 :] != comp[at])) + at + 1
                budget -= len(hit)
                if budget < 0:
                    break
                found.append((np.minimum(node[at], node[hit]), np.maximum(node[at], node[hit])))
            if budget < 0:
                least = pa.array(np.full(len(node), node.min()))
                yield pa.record_batch([pa.array(node), pa.nulls(len(node), pa.int64()), least], names=["a", "b", "hub"])
            else:
                for a, b in found:
                    if len(a):
                        yield pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "hub"])

    return run


def _block_links(percent: int):
    """Per pair of blocks (cluster, i, j), links between nodes of different components, by exact counts.

    Blocks are compared tile by tile, so that bits stay small however many
    short texts a block holds. A link that only repeats what earlier links of
    the task join is not sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, 3):
            i, j = rows[0][1], rows[0][2]
            node, joined, block = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
            sets = [np.frombuffer(r[6], np.uint64) for r in rows]
            size = np.array([len(x) for x in sets])
            us, vs = [], []
            for left, right in _tile_pairs(np.flatnonzero(block == i), np.flatnonzero(block == j), size):
                own = np.union1d(left, right)
                if (joined[own] == joined[own[0]]).all():
                    continue
                bits = _shared_bits([sets[x] for x in own])
                for x in left:
                    others = right[joined[right] != joined[x]]
                    if i == j:
                        others = others[others > x]
                    shared = bits[np.searchsorted(own, others)] & bits[np.searchsorted(own, x)]
                    both = np.bitwise_count(shared).sum(axis=1, dtype=np.int64)
                    for y in others[100 * both >= percent * (size[others] + size[x] - both)]:
                        if joined[x] != joined[y]:
                            us.append(node[x])
                            vs.append(node[y])
                            joined[joined == joined[y]] = joined[x]
            if us:
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _tile_pairs(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of tiles of two blocks; of a block with itself each pair once."""

    def tiles(of: np.ndarray) -> list[np.ndarray]:
        mark = np.stack([np.cumsum(size[of]) // TILE_SHINGLES, np.arange(len(of)) // TILE_ROWS])
        return np.split(of, np.flatnonzero(np.diff(mark).any(axis=0)) + 1) if len(of) else []

    same = np.array_equal(left, right)
    ours = tiles(left)
    theirs = ours if same else tiles(right)
    for at, one in enumerate(ours):
        for two in theirs[at:] if same else theirs:
            yield one, two


def _shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set, over the shingles that more than one of the sets hold."""
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]
    packed = np.zeros((len(sets), int((times > 1).sum()) // 64 + 1), np.uint64)
    owner, shared = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), place >= 0
    np.bitwise_or.at(packed, (owner[shared], place[shared] >> 6), np.uint64(1) << (place[shared] & 63).astype(np.uint64))
    return packed


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Groups rows that come sorted by their first ``width`` columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != now:
                if rows:
                    yield rows
                now, rows = row[:width], []
            rows.append(row)
    if rows:
        yield rows


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    sets of ``width``-word shingles; fewer words make one shingle. Documents
    without words or text have an empty set and link with nothing. component_id
    is the smallest doc_id reachable; of a component the row with that id is
    kept. A doc_id identifies a document: rows that repeat it share its
    component. A null doc_id takes no part: its component_id is null and kept
    true. An empty table gives an empty result; other columns are ignored; a long
    text is one set in one task.
    """
    n = chunks_for(percent / 100) * CHUNK
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = scratch.save(
        rows.mapInArrow(_describe(width, n), "doc_id long, n_shingles long, mark binary, sig binary"), "described"
    )
    nodes = scratch.save(
        base.where("mark is not null and doc_id is not null")
        .groupBy("mark")
        .agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")),
        "nodes",
    )
    component = _components(base, rows, nodes, scratch, width, percent, n)
    labelled = nodes.select("mark", "node").join(component, "node", "left").select(
        "mark", F.coalesce("component", "node").alias("component_id"), F.col("component").isNotNull().alias("joined")
    )
    many = base.where("mark is not null").groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    # Only sets that are shared or linked need a look-up; every other document is its own component.
    shared = labelled.join(many.withColumn("copied", F.lit(True)), "mark", "left").where("joined or copied")
    out = base.select("doc_id", "n_shingles", "mark").join(shared.select("mark", "component_id"), "mark", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _components(base: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch, width: int, percent: int, n: int) -> DataFrame:
    distance = 2 * (n // CHUNK) - 1
    # Counted by partial aggregation and joined by the key: a hot key is split by adaptive execution.
    keyed = nodes.select("node", "sig").mapInArrow(_keys, "key long, node long")
    busy = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    bucket = scratch.save(keyed.join(busy.select("key", "centre"), "key"), "buckets")
    # A node is first held against the one centre it shares most buckets with: no more pairs than nodes.
    shared = bucket.where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
    pairs = shared.groupBy("node").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("a")).select("a", F.col("node").alias("b"))
    sigs = nodes.select("node", "sig")
    tested = scratch.save(_within(pairs, sigs, distance), "pairs-0")
    links = scratch.save(_verified(tested, rows, width, percent), "links-0")
    component = connected_components(links, scratch)
    placed = bucket.join(component, "node", "left").select("key", "centre", "node", F.coalesce("component", "node").alias("comp"))
    open_ = (
        placed.groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.min("node").alias("hub"))
        .where("lo <> hi")
    )
    small, large = open_.where(F.col("n") <= BUCKET_ROWS), open_.where(F.col("n") > BUCKET_ROWS)
    members = placed.join(small.select("key"), "key", "left_semi").join(sigs, "node").select("key", "node", "comp", "sig")
    grouped = members.repartition("key").sortWithinPartitions("key")
    found = scratch.save(grouped.mapInArrow(_bucket_pairs(distance), "a long, b long, hub long").distinct(), "pairs-1")
    fresh = scratch.save(found.where("b is not null").select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs-2")
    whole = placed.join(large.select("key", "hub"), "key").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "hub")
    crowd = scratch.save(found.where("b is null").unionByName(whole).distinct(), "crowd")
    more = scratch.save(_verified(fresh, rows, width, percent), "links-1")
    if not crowd.isEmpty():
        clusters = connected_components(crowd.select(F.col("a").alias("u"), F.col("hub").alias("v")), scratch)
        crowd = crowd.select(F.col("a").alias("node")).distinct()
        more = more.unionByName(scratch.save(_compared(crowd, clusters, component, base, rows, width, percent), "links-2"))
    return component if more.isEmpty() else connected_components(links.unionByName(more), scratch)


def _compared(
    crowd: DataFrame, clusters: DataFrame, component: DataFrame, base: DataFrame, rows: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links among crowded nodes. Nodes of a cluster are dealt to blocks, and pairs of blocks are compared.

    Clusters are components of nodes that share crowded buckets, so no candidate
    pair is in two of them. A block holds about ``BLOCK_SHINGLES``, so
    a hot cluster becomes many tasks of bounded size, and sets travel once per
    block, never once per pair. A component that fills a block has blocks of its
    own, which are not held against each other: a large group already joined
    costs as many blocks as it has, times those of the rest.
    """
    ids = crowd.select(F.col("node").alias("doc_id"))
    wanted = F.broadcast(ids) if row_count_at_most(ids, BROADCAST_IDS) else ids
    sets = rows.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "node long, shingles binary").dropDuplicates(["node"])
    sizes = base.join(wanted, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("size"))
    named = crowd.join(clusters.withColumnRenamed("component", "cluster"), "node").join(component, "node", "left").join(sizes, "node")
    named = named.select("node", "cluster", F.coalesce("component", "node").alias("comp"), "size")
    # One row per component that fills a block, and one (own null) for all smaller ones of a cluster.
    own = F.when(F.col("size") > BLOCK_SHINGLES, F.col("comp")).alias("own")
    # A hot cluster or component may hold most of the nodes: counted beforehand, its row is broadcast.
    parts = named.groupBy("cluster", "comp").agg(F.sum("size").alias("size"), F.count("*").alias("nodes")).groupBy("cluster", own)
    parts = parts.agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("n"), F.sum("nodes").alias("nodes"))
    whole = Window.partitionBy("cluster")
    parts = parts.withColumn("first", (F.sum("n").over(whole.orderBy("own")) - F.col("n")).cast("int"))
    parts = parts.withColumn("blocks", F.sum("n").over(whole).cast("int"))
    parts = parts.select("cluster", "own", F.struct("n", "first", "blocks").alias("part"), F.col("nodes").alias("n"), F.sum("nodes").over(whole).alias("all"))
    large = parts.where("own is not null").select("cluster", F.col("own").alias("comp"), "part", "n")
    rest = parts.where("own is null").select("cluster", F.col("part").alias("others"), F.col("all").alias("n"))
    nodes = crowd.count()
    placed = join_hot(join_hot(named, large, ["cluster", "comp"], nodes, "left"), rest, ["cluster"], nodes, "left")
    placed = placed.select("node", "cluster", "comp", F.col("part").isNotNull().alias("own"), F.coalesce("part", "others").alias("p"))
    block = (F.col("p.first") + F.pmod(F.xxhash64("node"), F.col("p.n"))).cast("int")
    beside = F.filter(
        F.sequence(F.lit(0), F.col("p.blocks") - 1),
        lambda x: ~F.col("own") | (x < F.col("p.first")) | (x >= F.col("p.first") + F.col("p.n")),
    )
    sent = placed.select("node", "cluster", "comp", block.alias("block"), beside.alias("beside")).join(sets, "node")
    sent = sent.select("*", F.explode("beside").alias("other")).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp", "block", "shingles"
    )
    grouped = sent.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return grouped.mapInArrow(_block_links(percent), "u long, v long")


def _within(pairs: DataFrame, sigs: DataFrame, distance: int) -> DataFrame:
    """Pairs whose signatures differ in at most ``distance`` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3)
                )
                mask = pa.array((x != y).sum(axis=1) <= distance)
                yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    one = sigs.select(F.col("node").alias("a"), F.col("sig").alias("one"))
    two = sigs.select(F.col("node").alias("b"), F.col("sig").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, as (u, v)."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    wanted = F.broadcast(ids) if row_count_at_most(ids, BROADCAST_IDS) else ids
    sets = rows.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "node long, shingles binary")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return both.mapInArrow(_confirm(percent), "u long, v long")
