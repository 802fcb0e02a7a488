"""What the training-data operators share: row numbers, running sums, words."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tessera.sources.scratch import BROADCAST_ROWS, kept, small_or_shuffled  # noqa: F401

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows meant for one task of a running sum or a permutation.
BUCKET_ROWS = 1024

def running_start(rows: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Exclusive running sum of value within keys, by order.

    bucket must rise with order; sums run inside (keys, bucket) and are offset by
    the totals of earlier buckets, so no task holds all rows of one key.
    rows is read twice: give a kept table.
    """
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select(*keys, bucket, (F.sum("_total").over(before) - F.col("_total")).alias("_offset"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(value).over(inside) - F.col(value))
    return (
        local.join(offsets, [*keys, bucket])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset")
    )


def in_order(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows numbered from 0 in a total order. Each range is sorted and numbered by its own task and written; ranges are offset by the sizes of those before."""
    at = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "in-order")
    at = at.withColumn("_range", F.shiftright("_place", 33))
    # a row for each range, as many as there are shuffle partitions
    sizes = at.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = sizes.select("_range", before.alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + inside).drop("_range", "_place", "_before")


def held_out(doc_id: Column, remainder: int) -> Column:
    """crc32 of the id as text, modulo 5, is remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def free_name(df: DataFrame, name: str) -> str:
    """name, or a variant of it that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for every row, written so that it stays the row's, and the number's name."""
    row = free_name(docs, "_row")
    return kept(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def copy_numbers(rows: DataFrame, key: str, row: str, out: str) -> DataFrame:
    """Rows equal in key, numbered from 0. A task numbers the rows of a key from one task of their own writing.

    rows is read twice, and row is its number from numbered(): give a kept table.
    """
    cut = rows.withColumn("_lot", F.shiftright(row, 33)).withColumn("_one", F.lit(1).cast("long"))
    return running_start(cut, [key], "_lot", [row], "_one", out).drop("_lot", "_one")


def whole_hash(docs: DataFrame, *without: str) -> Column:
    """Hash of all columns that can be hashed; nulls leave xxhash64 as it is, so where they stand goes in too."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in without and not isinstance(f.dataType, (MapType, VariantType))]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def row_hash(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


# ── words in Python tasks: UTF-8 bytes throughout ──────────────────────────

_PUNCTUATION = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: ASCII letters to lower case, every other ASCII character but digits to a space.
PLAIN = bytes.maketrans(_PUNCTUATION + bytes(range(65, 91)), b" " * len(_PUNCTUATION) + bytes(range(97, 123)))


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation, so that layout does not hide a copy."""
    return (text or b"").translate(PLAIN).split()


class WordHashes(dict):
    """64-bit hash of each word, remembered while it is small."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _Q
    return x ^ (x >> _S)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width word hashes; a shorter sequence is one shingle, none gives none."""
    n = len(words)
    if n == 0:
        return words
    w = min(width, n)
    acc = words[: n - w + 1].copy()
    for i in range(1, w):
        acc *= _P
        acc += words[i : n - w + 1 + i]
    return mixed(acc + np.uint64(w))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(29).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of running sums, and of its inverse."""
    if len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(2 * n, x)]) for x in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


class Runs:
    """Hashes of any runs of h, from running sums of a polynomial."""

    def __init__(self, h: np.ndarray):
        power, self.back = powers(len(h) + 1)
        self.total = np.r_[np.uint64(0), np.cumsum(h.astype(np.uint64) * power[:-1])]

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.total[hi] - self.total[lo]) * self.back[lo])


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain_words of texts, one after the other, and how many each text has; no word becomes an object."""
    joined = b" ".join([(t or b"").translate(PLAIN) for t in texts])
    b = np.frombuffer(joined, np.uint8)
    inside = np.concatenate([[False], b != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return Runs(_BYTES[b])(first, last), np.bincount(np.searchsorted(ends, first, "right"), minlength=len(texts))


def shingle_strings(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    w = min(width, len(words))
    return [b" ".join(words[i : i + w]) for i in range(len(words) - w + 1)]


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit factors: h * a (mod 2**64) permutes hashes."""
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def binary(text: str = "text") -> Column:
    return F.col(text).cast("binary").alias(text)


def chunks(items: Iterable, size: int) -> Iterable[list]:
    part: list = []
    for x in items:
        part.append(x)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part
