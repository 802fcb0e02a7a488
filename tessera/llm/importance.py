"""Target-distribution importance resampling over hashed n-grams.

Texts are lower-cased (A-Z only), their separators collapsed to single spaces, and
an overlapped regular expression whose lookarounds stand on word boundaries emits
every run of 1 to n words as a span; the span's CRC-32 names its bucket. A first
pass writes each document's bucket counts once; the corpus totals, the weights and
the draw come from that table, so texts are scanned a single time. The draw adds
Gumbel noise of a hash of the id, sorts by ranges and numbers each range by itself.

Defined results: null and empty texts have no features, weight 0, and are never
drawn while the least number of words is above 0; a null doc_id is hashed as empty
text and ranks after every other id of the same score; rows equal in all of it are
numbered one after the other; an empty benchmark leaves T and t at 0; an empty table
gives no rows; extra columns play no part. docs must give the same rows each time
it is read, as a table does.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

from .common import binary, in_order

GRAMS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, every other ASCII character but digits and letters to a space.
_PLAIN = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def collapsed(text: bytes | None) -> bytes:
    """Lower-case words, one space between two."""
    return b" ".join((text or b"").translate(_PLAIN).split())


def patterns(grams: int) -> list[regex.Pattern]:
    """For each length, whole words alone: no character but a space stands before or behind a match."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % k) for k in range(grams)]


class Buckets(dict):
    """Bucket of each span, remembered while they are few."""

    LIMIT = 200_000

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, span: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[span] = b = zlib.crc32(span) % self.size
        return b


def counted(texts: DataFrame, keys: list[str], grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """The key columns, n_words, n_features and the filled buckets with their counts, for every row."""
    kinds = [f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "n_words long, n_features long, bucket array<int>, filled array<int>"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, forms = Buckets(buckets), patterns(grams)
        for b in batches:
            words, features, ends, at, n = [], [], [0], [], []
            for text in b.column(len(keys)):
                plain = collapsed(text.as_py())
                found: Counter[int] = Counter()
                for k, form in enumerate(forms):
                    found.update(bucket[m[0]] for m in form.finditer(plain, overlapped=True))
                    if not k:
                        words.append(found.total())
                features.append(found.total())
                at += found.keys()
                n += found.values()
                ends.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (at, n)]
            counts = [pa.array(words, pa.int64()), pa.array(features, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *counts, *lists], names=[*keys, "n_words", "n_features", "bucket", "filled"])

    return texts.select(*keys, binary()).mapInArrow(count, schema)


def totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of counted()."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (c.flatten().to_numpy(zero_copy_only=False) for c in b.columns)
            np.add.at(own, at, n)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    # one row per bucket at most
    for r in counts.select("bucket", "filled").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat that a feature of each bucket speaks for the target."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """counted() rows with their weight in place of their buckets."""
    keys = [c for c in counts.columns if c not in ("bucket", "filled")]
    schema = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys) + ", weight long"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column(len(keys)), b.column(len(keys) + 1)
            ends = np.concatenate([[0], np.cumsum(np.diff(at.offsets.to_numpy()))])
            each = gain[at.flatten().to_numpy(zero_copy_only=False)] * n.flatten().to_numpy(zero_copy_only=False)
            up_to = np.concatenate([[0], np.cumsum(each)])[ends]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(np.diff(up_to))], names=[*keys, "weight"])

    return counts.select(*keys, "bucket", "filled").mapInArrow(weigh, schema)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, grams: int = GRAMS, buckets: int = BUCKETS, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where it is not drawn."""
    named = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    counts = kept(counted(named, ["doc_id", "_row"], grams, buckets), "importance-counts")
    gain = gains(totals(counts, buckets), totals(counted(target.select("text"), [], grams, buckets), buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weighed(counts, gain).withColumn("score", F.col("weight") + noise).withColumn("_enough", F.col("n_words") >= least)
    drawn = counts.where(F.col("n_words") >= least).count() * percent // 100
    order = [F.desc("_enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row")]
    placed = in_order(rows, order, "_at")
    rank = F.when(F.col("_enough") & (F.col("_at") < drawn), F.col("_at") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs, drawn towards the benchmark's texts."""
    return resampled(docs, benchmark)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT id, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
x AS (
  SELECT word, xor(list_reduce(
      list_transform(range(len(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM v, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN x USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN x USING (word) GROUP BY 1),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + {BUCKETS}.0::DOUBLE)
      / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + {BUCKETS}.0::DOUBLE))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT id, sum(gain)::BIGINT AS weight FROM dw JOIN x USING (word) JOIN g USING (bucket) GROUP BY 1),
scored AS (
  SELECT id, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) // 100 THEN place END AS rank
FROM r
"""
