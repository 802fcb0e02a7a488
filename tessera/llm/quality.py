"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text becomes a few statistics of its words, characters and lines (never its
id, source, language or label). Random Fourier features approximate a Gaussian
kernel over them; every partition sums its part of the normal equations, the
driver adds the few partial matrices and solves. Another share of the labelled
rows calibrates the ridge score by isotonic regression over score bins.

Labels: rows whose crc32(doc_id) mod 5 is not 0, at most MAX_LABELS of them
(a hash picks, the bound makes the broadcast safe). Defined results: null text
scores as the empty text; without any label every score is 0.5; a doc_id labelled
twice counts with its mean label; repeated rows score alike; extra columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, held_out, kept

MAX_LABELS = 60_000
THRESHOLD = 0.3
N_FOURIER = 256
RIDGE = 1e-3
BINS = 2000
PARTS = 16
SEED = 5

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_STOPS = b".,;:'\"()-"
_MARKS = b"!?"
_ASCII = bytes(range(128))
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOPS + _MARKS)
N_STATS = 16


def statistics(text: bytes | None) -> list[float]:
    t = text or b""
    words = t.split()
    n, size = len(words), max(1, len(t))
    share = lambda chars: (len(t) - len(t.translate(None, chars))) / size
    if not n:
        return [0.0] * N_STATS
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in t.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        len(seen) / n,
        max(seen.values()) / n,
        share(_UPPER) * 4,
        share(_DIGIT) * 4,
        share(_STOPS) * 4,
        share(_MARKS) * 4,
        share(_SYMBOL) * 4,
        1 - share(_ASCII),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(size / len(lines))),
        ends / len(lines),
        t.count(b". ") / n * 4,
    ]


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array([statistics(x) for x in col.cast(pa.binary()).to_pylist()], np.float64).reshape(-1, N_STATS)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value) if len(x) else np.zeros(0)


def fourier(x: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, N_FOURIER))
    b = rng.uniform(0, 2 * np.pi, N_FOURIER)
    z = np.cos(np.clip(x, -8, 8) @ w + b) * np.sqrt(2 / N_FOURIER)
    return np.hstack([z, np.ones((len(x), 1))])


def isotonic(score: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in score order: block centres and their values."""
    blocks: list[list[float]] = []
    for s, m, w in zip(score, mean, weight):
        blocks.append([s * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _training(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    picked = labels.where(~held_out(F.col("doc_id"), 0)).groupBy("doc_id").agg(F.avg(target).alias("y")).where("doc_id is not null and y is not null")
    n = picked.count()
    if n > MAX_LABELS:
        picked = picked.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * MAX_LABELS / n))
    picked = picked.withColumnRenamed("doc_id", "_id")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2))
            rows = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], names=["fold", "y", "x"])

    rows = docs.select("doc_id", binary()).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).cast("int")
    return kept(rows.select(fold.alias("fold"), "y", "text").mapInArrow(stats, "fold int, y double, x array<double>"), "quality-train")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    train = _training(docs, labels, target)
    mids = train.agg(
        F.count(F.lit(1)),
        F.array(*[F.avg(F.col("x")[i]) for i in range(N_STATS)]),
        F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(N_STATS)]),
    ).first()
    if not mids[0]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(N_FOURIER + 1), np.zeros(1), np.full(1, 0.5))
    mean, scale = np.array(mids[1]), np.maximum(np.array(mids[2]), 1e-6)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = np.zeros((N_FOURIER + 1,) * 2), np.zeros(N_FOURIER + 1)
        for b in batches:
            z = fourier((np.array(b.column(1).to_pylist(), np.float64).reshape(-1, N_STATS) - mean) / scale)
            a += z.T @ z
            c += z.T @ b.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([a, c]).tobytes()])], names=["part"])

    fits = train.where("fold != 1") if train.where("fold != 1").limit(1).count() else train
    parts = fits.select("y", "x").repartition(PARTS).mapInArrow(sums, "part binary").collect()
    total = sum(np.frombuffer(p[0]).reshape(-1, N_FOURIER + 1) for p in parts)
    gram = total[:-1] + RIDGE * max(1.0, total[-2, -1]) * np.eye(N_FOURIER + 1)
    weights = np.linalg.solve(gram, total[-1])
    ridge = Model(mean, scale, weights, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = ridge.raw(np.array(b.column(1).to_pylist(), np.float64).reshape(-1, N_STATS))
            at = np.clip(np.round(raw * BINS / 2), -BINS // 2, BINS * 3 // 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0)], names=["at", "y"])

    cal = train.where("fold = 1") if train.where("fold = 1").limit(1).count() else train
    bins = cal.select("y", "x").mapInArrow(binned, "at long, y double").groupBy("at").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    rows = sorted(bins.collect())
    at, value = isotonic(*[np.array(c, float) for c in zip(*[(r["at"] * 2 / BINS, r["y"], r["n"]) for r in rows])])
    return Model(mean, scale, weights, at, np.clip(value, 0, 1))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", binary()).mapInArrow(score, f"doc_id {kind}, score double")


def op5_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, columns unchanged."""
    model, text = fit(docs, labels), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(_matrix(b.column(text))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
