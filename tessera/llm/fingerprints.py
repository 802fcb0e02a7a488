"""Document fingerprints by one-permutation MinHash, and their likeness.

Each shingle of five words (ASCII case and punctuation ignored) is hashed once; the
hash's high bits name one of BINS bins, which keeps its least hash. An empty bin
takes the value of a filled one by optimal densification: every bin has a random
order of the bins of its own, the same for all texts (the universal hash of the
method, without its repeats), and copies the first filled bin of that order. What a
bin holds is hashed with the bin's number, so that copies of one value do not agree
by one accident, and its lowest BITS bits are kept. Two unlike values agree in those
bits with probability C = 2**-BITS, so that a share M of equal bins stands for a
likeness of (M - C) / (1 - C), at least 0.

The texts next to each other in the order of doc_id are brought together by ranges:
a bounded sample sets the ranges, the first row of each range is also sent to the end
of the range before, and each task streams through its own.

Defined results: a null text counts as empty; texts without a word have a
fingerprint of zeros, are like each other (1) and like no other text (0); a text of
fewer words than five is one shingle; null doc_ids come last, rows of equal doc_id by
the hash of their text; the only row of a table is its own next; an empty table gives
no rows; extra columns play no part. docs must give the same rows each time it is
read, as a table does.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

from .common import PLAIN, mixed, shingle_hashes, word_hashes

BINS = 512
BITS = 4
WIDTH = 5
SEED = 97
#: Bytes of text hashed at a time; longer texts go piece by piece.
PIECE = 1 << 20
#: Texts whose bins are held at a time.
TEXTS = 1024
#: Steps of the densification taken for all texts at once, before each text's rest is looked up.
STEPS = 8
#: Sampled rows for each range.
SAMPLED = 20

_EMPTY = np.uint64(2**64 - 1)


class Scheme:
    """One-permutation MinHash with so many bins and bits."""

    def __init__(self, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or not 1 < bins <= 1 << 15 or bits not in (1, 2, 4, 8) or bins * bits % 8:
            raise ValueError("bins must be a power of two up to 32768, bits 1, 2, 4 or 8")
        self.bins, self.bits = bins, bits
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.order = np.argsort(np.random.default_rng(SEED).random((bins, bins)), axis=1)
        self.rank = np.argsort(self.order, axis=1).astype(np.int16)
        self.salt = mixed(np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def minima(self, texts: list[bytes]) -> np.ndarray:
        """The least hash of each bin, for every text."""
        out = np.full((len(texts), self.bins), _EMPTY)
        flat, at, size = out.reshape(-1), [], 0
        for i, t in enumerate([*texts, None]):
            if at and (t is None or size + len(t) > PIECE):
                self._several(flat, at, [texts[k] for k in at])
                at, size = [], 0
            if t is None:
                break
            if len(t) > PIECE:
                self._long(flat, i, t)
            else:
                at.append(i)
                size += len(t)
        return out

    def _add(self, flat: np.ndarray, rows: np.ndarray | int, h: np.ndarray) -> None:
        np.minimum.at(flat, rows * self.bins + (h >> self.shift).astype(np.int64), h)

    def _several(self, flat: np.ndarray, at: list[int], texts: list[bytes]) -> None:
        words, n = word_hashes(texts)
        rows = np.repeat(np.array(at), n)
        if len(words) >= WIDTH:
            within = rows[WIDTH - 1 :] == rows[: len(rows) - WIDTH + 1]
            self._add(flat, rows[: len(within)][within], shingle_hashes(words, WIDTH)[within])
        ends = np.cumsum(n)
        for k in np.flatnonzero((n > 0) & (n < WIDTH)):
            self._add(flat, at[k], shingle_hashes(words[ends[k] - n[k] : ends[k]], WIDTH))

    def _long(self, flat: np.ndarray, row: int, text: bytes) -> None:
        """A text in pieces cut between words; the last words of each piece go before the next."""
        text, start, before, seen = text.translate(PLAIN), 0, np.zeros(0, np.uint64), 0
        while start < len(text):
            cut = text.find(b" ", start + PIECE)
            cut = len(text) if cut < 0 else cut
            own, _ = word_hashes([text[start:cut]])
            words = np.concatenate([before, own])
            seen += len(own)
            if len(words) >= WIDTH:
                self._add(flat, row, shingle_hashes(words, WIDTH))
            before, start = words[-(WIDTH - 1) :], cut
        if 0 < seen < WIDTH:
            self._add(flat, row, shingle_hashes(before, WIDTH))

    def densified(self, least: np.ndarray) -> np.ndarray:
        """Every bin filled, in the rows that have a filled one."""
        out, empty = least.copy(), least == _EMPTY
        rows, bins = np.nonzero(empty & ~empty.all(1)[:, None])
        for step in range(min(STEPS, self.bins)):
            found = least[rows, self.order[bins, step]]
            ok = found != _EMPTY
            out[rows[ok], bins[ok]] = found[ok]
            rows, bins = rows[~ok], bins[~ok]
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for i, lacking in zip(rows[np.concatenate([[0], cuts]).astype(int)] if len(rows) else (), np.split(bins, cuts)):
            filled = np.flatnonzero(~empty[i])
            out[i, lacking] = least[i, filled[self.rank[lacking[:, None], filled].argmin(1)]]
        return out

    def digits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The kept bits of every bin, and whether a text has any word."""
        least = self.minima(texts)
        some = (least != _EMPTY).any(1)
        low = mixed(self.densified(least) ^ self.salt) & np.uint64((1 << self.bits) - 1)
        return np.where(some[:, None], low, 0).astype(np.uint8), some

    def packed(self, digits: np.ndarray) -> list[str]:
        """Hexadecimal strings of bins * bits bits, the first bin first."""
        bits = digits[:, :, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint8) & 1
        return [row.tobytes().hex() for row in np.packbits(bits.reshape(len(digits), -1), axis=1)]

    def unpacked(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(bytes.fromhex("".join(strings)), np.uint8).reshape(len(strings), self.bins * self.bits // 8)
        bits = np.unpackbits(raw, axis=1).reshape(len(strings), self.bins, self.bits)
        return (bits << np.arange(self.bits - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.uint8), raw.any(1)

    def likeness(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Estimated Jaccard similarity of the shingle sets, row by row."""
        chance = 2.0**-self.bits
        found = np.clip(((a[0] == b[0]).mean(1) - chance) / (1 - chance), 0, 1)
        return np.where(a[1] & b[1], found, (a[1] == b[1]).astype(float))


@cache
def scheme_of(bins: int, bits: int) -> Scheme:
    """Made once in each worker, so that no task is sent its tables."""
    return Scheme(bins, bits)


def likeness(bins: int = BINS, bits: int = BITS):
    """A column function: the likeness of two columns of fingerprints; null where one of them is."""

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        scheme = scheme_of(bins, bits)
        out, both = pd.Series(np.nan, a.index, dtype="Float64").astype(object), a.notna() & b.notna()
        if both.any():
            out[both] = scheme.likeness(scheme.unpacked(list(a[both])), scheme.unpacked(list(b[both])))
        return out.where(both, None)

    return compare


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(key, fingerprint) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = scheme_of(bins, bits)
        for b in (piece.slice(at, TEXTS) for piece in batches for at in range(0, piece.num_rows, TEXTS)):
            digits, _ = scheme.digits([t or b"" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scheme.packed(digits))], names=[key, "fingerprint"])

    return docs.select(key, F.col(text).cast("binary").alias(text)).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


# ── texts next to each other ───────────────────────────────────────────────

_KEYS = ["nameless", "down", "hash", "row"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the order's keys: null ids last, larger ids first, then the text's hash and the row's place."""
    keys = [F.col("doc_id").isNull().cast("int").alias("nameless"), F.coalesce(-F.col("doc_id").cast("long"), F.lit(0)).alias("down"), F.xxhash64("text").alias("hash")]
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")).select("*", *keys)


def neighboured(docs: DataFrame) -> DataFrame | None:
    """Rows in ranges of descending doc_id, each range's last row (guard) being the next range's first; None without rows.

    As many ranges as shuffle partitions; the driver sees SAMPLED keys for each.
    """
    spark = docs.sparkSession
    rows = _keyed(docs)
    keys = kept(rows.select(*_KEYS), "fingerprint-keys")
    n, first = keys.agg(F.count(F.lit(1)), F.min(F.struct(*_KEYS))).first()
    if not n:
        return None
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sampled = sorted(map(tuple, keys.where(F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(n)) < SAMPLED * ranges).collect()))
    every = max(1, -(-len(sampled) // ranges))
    starts = sorted({tuple(first), *sampled[every::every]})

    @F.pandas_udf("range int, before int")
    def dealt(nameless: pd.Series, down: pd.Series, hash: pd.Series, row: pd.Series) -> pd.DataFrame:
        own = [(bisect_right(starts, k) - 1, k) for k in zip(nameless.tolist(), down.tolist(), hash.tolist(), row.tolist())]
        return pd.DataFrame({"range": [i for i, _ in own], "before": [(i - 1) % len(starts) if starts[i] == k else -1 for i, k in own]}, dtype="int32")

    at = F.struct(F.col("dealt.range").alias("range"), F.lit(False).alias("guard"))
    before = F.when(F.col("dealt.before") >= 0, F.struct(F.col("dealt.before").alias("range"), F.lit(True).alias("guard")))
    sent = rows.withColumn("dealt", dealt(*_KEYS)).withColumn("at", F.explode(F.array_compact(F.array(at, before))))
    sent = sent.select("at.range", "at.guard", *_KEYS, "doc_id", F.col("text").cast("binary").alias("text"))
    return sent.repartitionById(len(starts), F.col("range")).sortWithinPartitions("range", "guard", *_KEYS)


def op12_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [part.split(" ")[0] for part in schema.split(", ")]
    placed = neighboured(docs)
    if placed is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, held = scheme_of(BINS, BITS), []
        size, ready = 0, None

        def flush() -> pa.RecordBatch:
            """All rows held but the last, which is what the one before it needs."""
            nonlocal held, size, ready
            texts = [t for _, t in held]
            fresh = scheme.digits(texts if ready is None else texts[1:])
            own = fresh if ready is None else tuple(np.concatenate(pair) for pair in zip(ready, fresh))
            plain, edited, n = [t.decode("utf-8", "replace") for t in texts], [], []
            for a, b in zip(plain, plain[1:]):
                n.append(len(a))
                edited.append((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode())
            changed, mine, following = scheme.digits(edited), tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
            cols = [[i for i, _ in held[:-1]], n, [hashlib.sha256(t).hexdigest() for t in edited], scheme.packed(mine[0]), scheme.packed(changed[0]), scheme.likeness(mine, changed), scheme.likeness(mine, following)]
            held, size, ready = held[-1:], 0, tuple(x[-1:] for x in own)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            kinds = [b.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            for guard, key, text in zip(b.column("guard").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                held.append((key, text.as_py()))
                size += len(held[-1][1])
                if len(held) > 1 and (guard or size >= PIECE or len(held) > TEXTS):
                    yield flush()
                if guard:
                    held, size, ready = [], 0, None

    return placed.select("guard", "doc_id", "text").mapInArrow(run, schema)
