"""Containment search of short texts inside long ones by size-partitioned MinHash.

The short texts (items) are partitioned by their number of word shingles, a class
for each power of two. For a class of at most u shingles a document is cut into
windows of 2u shingles that start every u, so any passage of an item's length
lies whole in one window, and the Jaccard similarity of item and window cannot
fall below a bound known for the class. Bands of one row each, as many as that
bound needs for a miss probability of MISS, retrieve the item; the exact shingle
sets of item and document then decide. Items are broadcast in blocks of at most
BLOCK_ITEMS; a larger table takes one pass over the documents per block.

A text's shingles are its runs of five words (ASCII case and punctuation
ignored), an empty one has none. An item of one to four words is one shingle of its
own width and is looked up among the documents' runs of that width. Where an item's
shingles stand scattered over a document, not within one window, the bands may
miss it; the README has the measured share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary, multipliers, plain_words, shingle_hashes, shingle_strings

WIDTH = 5
SIMILARITY = 0.8
MISS = 1e-3
BLOCK_ITEMS = 20_000
FLAT_WORDS = 100_000
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def bands_for(unit: int, similarity: float = SIMILARITY, miss: float = MISS) -> int:
    """Bands of one row that find an item of unit/2+1..unit shingles in a window of 2*unit."""
    least = unit // 2 + 1 if unit > 1 else 1
    shared = similarity * least
    jaccard = shared / (2 * unit + least - shared)
    return max(1, math.ceil(math.log(miss) / math.log(1 - jaccard)))


class Items:
    """The signatures and shingle sets of one block of items."""

    def __init__(self, rows: list[tuple[int, bytes]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.ids, self.sets = [], []
        #: width -> hash of a run -> items of that very run
        self.short: dict[int, dict[int, list[int]]] = {}
        hashes, by_unit = WordHashes(), {}
        for key, text in rows:
            words = plain_words(text)
            if not words:
                continue
            sh = np.unique(shingle_hashes(hashes.of(words), WIDTH))
            if len(words) < WIDTH:
                self.short.setdefault(len(words), {}).setdefault(int(sh[0]), []).append(len(self.ids))
            else:
                unit = 1 << (len(sh) - 1).bit_length()
                by_unit.setdefault(unit, []).append((len(self.ids), sh))
            self.ids.append(key)
            self.sets.append(frozenset(shingle_strings(words, WIDTH)))
        self.factors = multipliers(max([bands_for(u, similarity) for u in by_unit], default=0), 11)
        self.classes = []
        for unit, items in sorted(by_unit.items()):
            index = []
            for a in self.factors[: bands_for(unit, similarity)]:
                mins = np.array([(sh * a).min() for _, sh in items], np.uint64)
                order = np.argsort(mins, kind="stable")
                marks = np.zeros(1 << 16, bool)
                marks[(mins >> np.uint64(48)).astype(np.int64)] = True
                index.append((mins[order], np.array([i for i, _ in items], np.int64)[order], marks))
            self.classes.append((unit, index))

    def candidates(self, shingles: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) numbers whose signatures meet in a band."""
        lens = np.array([len(s) for s in shingles], np.int64)
        found: set[tuple[int, int]] = set()
        if not lens.sum():
            return found
        flat = np.concatenate(shingles)
        offs = np.cumsum(lens) - lens
        cuts = []
        for unit, index in self.classes:
            n = -(-lens // unit)
            doc = np.repeat(np.arange(len(lens)), n)
            starts = np.repeat(offs, n) + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * unit
            cuts.append((index, doc, starts, unit, np.flatnonzero(doc[1:] == doc[:-1])))
        for k, a in enumerate(self.factors):
            h = flat * a
            for index, doc, starts, unit, follow in cuts:
                if k >= len(index):
                    continue
                values, owners, marks = index[k]
                m = np.minimum.reduceat(h, starts) if unit > 1 else h
                w = m.copy()
                w[follow] = np.minimum(m[follow], m[follow + 1])
                hit = np.flatnonzero(marks[(w >> np.uint64(48)).astype(np.int64)])
                if not len(hit):
                    continue
                lo, hi = np.searchsorted(values, w[hit], "left"), np.searchsorted(values, w[hit], "right")
                for d, i, j in zip(doc[hit[lo < hi]], lo[lo < hi], hi[lo < hi]):
                    found.update((int(d), int(o)) for o in owners[i:j])
        return found

    def short_matches(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first word) of the items below WIDTH words that stand in a text."""
        for width, index in self.short.items():
            if len(words) >= width:
                runs, first = np.unique(shingle_hashes(hashes, width), return_index=True)
                for h, at in zip(runs.tolist(), first.tolist()):
                    for item in index.get(h, ()):
                        if b" ".join(words[at : at + width]) in self.sets[item]:
                            yield item, at

    def matches(self, texts: list[bytes | None], hashes: WordHashes) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shared shingles, first matching word) of every verified match."""
        rows, size = [], 0
        for row, text in enumerate([*texts, None]):
            if row < len(texts):
                words = plain_words(text)
                rows.append((row, words))
                size += len(words)
            if rows and (size >= FLAT_WORDS or row == len(texts)):
                words_of = [hashes.of(w) for _, w in rows]
                shingles = [shingle_hashes(w, WIDTH) for w in words_of]
                for (number, words), w in zip(rows, words_of) if self.short else ():
                    for item, at in self.short_matches(words, w):
                        yield number, item, 1, at
                last, have = -1, {}
                for d, item in sorted(self.candidates(shingles)):
                    if d != last:
                        have = {}
                        for at, s in enumerate(shingle_strings(rows[d][1], WIDTH)):
                            have.setdefault(s, at)
                        last = d
                    both = [have[s] for s in self.sets[item] if s in have]
                    if len(both) >= self.similarity * len(self.sets[item]) - 1e-9:
                        yield rows[d][0], item, len(both), min(both)
                rows, size = [], 0


def item_blocks(items: DataFrame, key: str, text: str = "text") -> Iterator[Broadcast]:
    """Broadcast Items, at most about BLOCK_ITEMS of the table's rows in each."""
    items = items.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")).where("_text is not null").distinct()
    n = -(-items.count() // BLOCK_ITEMS)
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("_key", "_text"), F.lit(n)) == b)
        rows = [tuple(r) for r in block.collect()]
        yield items.sparkSession.sparkContext.broadcast(Items([(k, bytes(t)) for k, t in sorted(rows, key=str)]))


def found_in(docs: DataFrame, items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(doc_id, key, shingles, shared, first_word) of every item contained in a row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = items.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, `{key}` {own}, shingles int, shared int, first_word int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, key, text):

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index, hashes = block.value, WordHashes()
            for b in batches:
                ids = b.column(0).to_pylist()
                got = list(index.matches(b.column(1).to_pylist(), hashes))
                cols = [[ids[r] for r, *_ in got], [index.ids[i] for _, i, *_ in got], [len(index.sets[i]) for _, i, *_ in got], [n for *_, n, _ in got], [at for *_, at in got]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], b.schema.types[0]), pa.array(cols[1], KINDS[own]), *[pa.array(c, pa.int32()) for c in cols[2:]]],
                    names=["doc_id", key, "shingles", "shared", "first_word"],
                )

        out = out.union(docs.select("doc_id", binary()).mapInArrow(scan, schema))
    return out


def without(docs: DataFrame, items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows of docs that contain none of the items, columns unchanged."""
    at = docs.columns.index("text")
    for block in item_blocks(items, key, text):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index, hashes = block.value, WordHashes()
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[r for r, *_ in index.matches(b.column(at).cast(pa.binary()).to_pylist(), hashes)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
