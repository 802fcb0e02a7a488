"""SimHash near-dedup with a Gray-order hierarchical index.

Equal fingerprints are one entry. Two entries within 3 bits agree on all bits of
at least m - 3 of m blocks, so entries are grouped by every such choice of blocks
(the top nodes of the hierarchy: a mask and the bits under it). Inside every group,
whatever its size, they are sorted by Gray rank and packed into upper nodes that
carry the bits all entries below share; pairs of nodes go down from the roots, and
those whose shared bits already differ in more than 3 places are pruned. Groups above GROUP entries are cut into tiles,
each pair of parts a task of its own. Only spanning links leave a task.

Defined results: a null or wordless text has fingerprint 0 and links like any
other; repeated rows give repeated rows; a null doc_id never names a component
(null where a component has no other); an empty table gives no rows; extra
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

from .common import binary, free_name, whole_hash

WIDTH = 3
SEED = 42
BITS = 3
GROUP = 2048
#: Children of a node of the hierarchy, and pairs of leaves compared at a time.
FAN, PAIRS = 8, 16_384


def fingerprint(text: bytes | None) -> int:
    """Bits set in over half the XXH64 of the text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    w = min(WIDTH, len(words))
    if w == WIDTH:
        hashes = [digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words), SEED)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(x.as_py()) for x in b.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", binary()).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; root[x] <= x names x's set throughout."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        ra, rb = ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root[:] = up


@dataclass
class Level:
    """Nodes of one level: bits set in all and in any of the entries below, and where each one's children start."""

    both: np.ndarray
    any_: np.ndarray
    group: np.ndarray
    starts: np.ndarray

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which every entry below a differs from every entry below b."""
        shared = ~(self.both ^ self.any_)
        return np.bitwise_count((self.both[a] ^ self.both[b]) & shared[a] & shared[b])


def hierarchy(group: np.ndarray, fps: np.ndarray) -> list[Level]:
    """Levels over entries sorted by group and Gray rank: the entries first, one root per group last."""
    levels = [Level(fps, fps, group, np.arange(len(fps)))]
    while True:
        at = levels[-1]
        n = len(at.group)
        edge = np.r_[True, at.group[1:] != at.group[:-1]]
        place = np.arange(n) - np.flatnonzero(edge)[np.cumsum(edge) - 1]
        starts = np.flatnonzero(place % FAN == 0)
        levels.append(Level(np.bitwise_and.reduceat(at.both, starts), np.bitwise_or.reduceat(at.any_, starts), at.group[starts], starts))
        if len(starts) == edge.sum():
            return levels


def _below(node: Level, n_children: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a[i] and a child of b[i], the earlier one first."""
    ends = np.r_[node.starts[1:], n_children]
    wide = ends[b] - node.starts[b]
    sizes = (ends[a] - node.starts[a]) * wide
    k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = np.repeat(wide, sizes)
    return np.repeat(node.starts[a], sizes) + k // wide, np.repeat(node.starts[b], sizes) + k % wide


def near_roots(group: np.ndarray, fps: np.ndarray, limit: int = BITS) -> np.ndarray:
    """For each entry the index of its component's first entry; links are pairs of a group within limit bits.

    Pairs of nodes go down the Gray-ordered hierarchies of all groups together; a
    pair whose shared bits differ in more than limit places goes with all below it.
    """
    n = len(fps)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((gray_rank(fps), group))
    levels = hierarchy(group[order], fps[order])
    root = np.arange(n)
    a = b = np.arange(len(levels[-1].group))
    for depth in range(len(levels) - 1, 1, -1):
        near = levels[depth].differ(a, b) <= limit
        a, b = _below(levels[depth], len(levels[depth - 1].group), a[near], b[near])
        a, b = a[a <= b], b[a <= b]
    leaves, entries = levels[1], levels[0]
    near = leaves.differ(a, b) <= limit
    a, b = a[near], b[near]
    first = np.argsort(b - a, kind="stable")  # near leaves settle most sets
    a, b = a[first], b[first]
    for at in range(0, len(a), PAIRS):
        low, high = np.minimum.reduceat(root, leaves.starts), np.maximum.reduceat(root, leaves.starts)
        la, lb = a[at : at + PAIRS], b[at : at + PAIRS]
        open_ = np.minimum(low[la], low[lb]) != np.maximum(high[la], high[lb])
        x, y = _below(leaves, n, la[open_], lb[open_])
        x, y = x[x < y], y[x < y]
        near = entries.differ(x, y) <= limit
        unite(root, x[near], y[near])
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, tile); emits links from each entry to its component's first, per group."""

    def solve(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        root = near_roots(np.cumsum(np.r_[True, key[1:] != key[:-1]]), fps)
        linked = np.flatnonzero(root != np.arange(len(fps)))
        pair = np.stack([fps[root[linked]].view(np.int64), fps[linked].view(np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(pair.min(0)), pa.array(pair.max(0))], names=["a", "b"])

    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        key = np.r_[held_k, b.column(0).to_numpy()]
        fps = np.r_[held_f, b.column(1).to_numpy().view(np.uint64)]
        cut = len(key) - int(np.argmax(np.r_[(key[::-1] != key[-1]), True]))
        if cut:
            yield solve(key[:cut], fps[:cut])
        held_k, held_f = key[cut:], fps[cut:]
    if len(held_k):
        yield solve(held_k, held_f)


def block_masks(n_distinct: int) -> list[int]:
    """Masks of m - 3 of m blocks of the 64 bits: more of them, so narrower groups, for more entries."""
    m = 4 if n_distinct <= 1 << 22 else 5 if n_distinct <= 1 << 31 else 6
    edge = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
    masks = [sum(c) for c in combinations(blocks, m - BITS)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of entries within 3 bits."""
    masks = block_masks(distinct.count())
    keyed = distinct.select(
        "fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(x))) for i, x in enumerate(masks)])).alias("key")
    )
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = keyed.join(sizes, "key").withColumn("_c", F.ceil(F.col("n") / GROUP).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("_c")).cast("int")
    tiled = grouped.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    tile = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    tiled = tiled.select(F.when(F.col("_c") == 1, F.col("key")).otherwise(tile).alias("key"), "fp")
    return tiled.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a < b), root the smallest: alternating large and small stars."""
    edges = kept(edges, "star")
    state = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = kept(small.union(low.select(F.col("m").alias("a"), "b")).distinct(), "star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now


def clustered(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    rows = kept(fingerprints(docs), "simhash")
    distinct = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp")))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = kept(named, "simhash-roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    entry = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(entry, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs."""
    return clustered(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id, nulls last, and then of the smallest hash of its columns."""
    h, k, d = (free_name(docs, n) for n in ("_hash", "_key", "_doc"))
    rows = docs.withColumn(h, whole_hash(docs))
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(h).alias("hash")).alias("doc_id"), "text")
    keep = clustered(named).select(F.col("component_id.id").alias(d), F.col("component_id.hash").alias(k)).distinct()
    own = rows.join(keep, (F.col(h) == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(d)), "left_semi")
    return own.dropDuplicates(["doc_id", h]).drop(h)
