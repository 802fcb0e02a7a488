"""Whitening of embeddings with components found by FEAST.

Vectors become integers; exact sums and the centred covariance V are added up over
the partitions. Sylvester's law tells how many eigenvalues lie above a shift: it
brackets the wanted ones in intervals of a few each. For every interval a contour is
drawn around it, and each quadrature node's complex shifted solve (zI - V)^-1 Y is a
row of a Spark job; the weighted solves, summed per interval, project Y onto the
interval's eigenspace, Rayleigh-Ritz extracts the pairs, and rounds go on until the
pairs in an interval are as many as its inertia count and their residuals vanish. A
last Rayleigh-Ritz over all intervals makes the components orthonormal.

Held on the driver and sent to the tasks: V, as large as the square of the vectors'
width and not of their number.

Defined results: rows whose vector is null or holds a null or non-finite entry are
dropped, rows with a null vec_id are not; entries that a vector shorter than the
longest lacks count as 0; entries beyond 2**60 / 1024 count as that bound; a deviation
beyond a long is the largest long; components whose eigenvalue is below TINY of the
trace do not exist, so that vectors all alike, a single row and empty tables give no
rows; equal eigenvalues get any orthonormal vectors of their space, the same for all
rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
MOST = 1 << 60
LONG = (1 << 63) - 1
#: Share of the trace below which an eigenvalue counts as 0.
TINY = 1e-12
#: Nodes on the upper half of a contour, eigenvalues meant for an interval, most rounds.
NODES = 8
PER_INTERVAL = 4
ROUNDS = 30
SEED = 5


def integers(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows whose vector is whole, entries as integers."""
    x = F.col(vec).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    bound = F.lit(float(MOST))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * SCALE, bound), -bound)) + SHIFT)
    return vectors.where(F.col(vec).isNotNull()).where(finite).select("vec_id", whole.alias("x"))


def _matrix(col: pa.ListArray, width: int) -> np.ndarray:
    values, lengths = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.full((len(lengths), width), SHIFT, np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


@dataclass(frozen=True)
class Fit:
    """What all rows share: their number and exact sums."""

    n: int
    sums: list[int]

    def off(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: Python's integers where longs would not do."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, off: np.ndarray) -> list[int]:
        """The squares' sum of each row of off()."""
        most = int(max(np.abs(off).max(initial=0), 1))
        if off.dtype == object or most * most * off.shape[1] > LONG:
            off = off.astype(object)
        return [min(int(s), LONG) for s in (off * off).sum(1)]

    def centred(self, off: np.ndarray) -> np.ndarray:
        return (off / self.n).astype(np.float64)


def fit_of(rows: DataFrame, width: int) -> Fit:
    """Number and sums, added up in two halves of 32 bits so that no task's share overflows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(width, np.int64), np.zeros(width, np.int64), 0
        for b in batches:
            x = _matrix(b.column(0), width)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(width, n))], names=["dim", "high", "low", "n"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = rows.select("x").mapInArrow(add, "dim int, high long, low long, n long").groupBy("dim").agg(whole("high"), whole("low"), whole("n")).collect()
    got = sorted(got, key=lambda r: r["dim"])
    return Fit(int(got[0]["n"]) if got else 0, [(int(r["high"]) << 32) + int(r["low"]) for r in got])


def covariance(rows: DataFrame, fit: Fit) -> np.ndarray:
    """Centred before multiplying, divisor n; each task adds up its rows' products, the sums meet by entry."""
    width = len(fit.sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((width, width))
        for b in batches:
            y = fit.centred(fit.off(_matrix(b.column(0), width)))
            own += y.T @ y
        for i in range(width):
            j = np.arange(i, width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int32)), pa.array(j), pa.array(own[i, i:])], names=["i", "j", "v"])

    found = rows.select("x").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    i, j, v = (found.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v / fit.n
    return out


# ── eigenvalues in an interval ─────────────────────────────────────────────


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v exceed shift: the positive pivots of v - shift, by Sylvester's law of inertia.

    Pivots are single entries of the diagonal or, where an entry beside it is far
    larger, pairs, which have one pivot of either sign.
    """
    a, found = v - shift * np.eye(len(v)), 0
    while len(a):
        diag, rest = np.abs(np.diag(a)), np.abs(a - np.diag(np.diag(a)))
        if rest.max(initial=0) == 0:
            return found + int((np.diag(a) > 0).sum())
        p, (q, r) = int(diag.argmax()), np.unravel_index(rest.argmax(), rest.shape)
        chosen = [p] if diag[p] >= 0.64 * rest[q, r] else [int(q), int(r)]
        others = np.setdiff1d(np.arange(len(a)), chosen)
        block, side = a[np.ix_(chosen, chosen)], a[np.ix_(others, chosen)]
        found += int(block[0, 0] > 0) if len(chosen) == 1 else 1
        a = a[np.ix_(others, others)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return found


def _clear(count: Callable[[float], int], shift: float, width: float) -> float:
    """A shift near the given one without an eigenvalue close by, if there is one."""
    for step in range(12):
        at = shift + (step + 1) // 2 * (-1) ** step * width / 40
        if count(at - width / 400) == count(at + width / 400):
            return at
    return shift


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of intervals that together hold the k largest eigenvalues, and none between."""
    seen: dict[float, int] = {}

    def count(x: float) -> int:
        if x not in seen:
            seen[x] = above(v, x)
        return seen[x]

    trace = float(np.trace(v))
    low, high = TINY * trace, float(np.abs(v).sum(1).max()) * (1 + 1e-9)
    k = min(k, count(low))
    if not k:
        return []
    bottom, top = low, high
    while count(bottom) > k and top - bottom > 1e-9 * high:
        middle = (bottom + top) / 2
        bottom, top = (middle, top) if count(middle) >= k else (bottom, middle)
    if bottom > low:
        moved = _clear(count, bottom - 1e-3 * (top - bottom), top - bottom)
        bottom = moved if count(moved) >= k else bottom
    done, open_ = [], [(bottom, high)]
    while open_:
        a, b = open_.pop()
        inside = count(a) - count(b)
        if inside <= PER_INTERVAL or b - a <= 1e-6 * high:
            done += [(a, b, inside)] if inside else []
        else:
            middle = _clear(count, (a + b) / 2, (b - a) / 2)
            open_ += [(a, middle), (middle, b)]
    return sorted(done)


def projected(spark: SparkSession, v: np.ndarray, parts: list[tuple[float, float, int]], start: list[np.ndarray]) -> list[np.ndarray]:
    """Each start block projected onto its interval's eigenspace; a node's solve is one task's row."""
    at, weight = np.polynomial.legendre.leggauss(NODES)
    shared, width = spark.sparkContext.broadcast((v, start)), len(v)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, blocks = shared.value
        for b in batches:
            for part, node in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low, high, _ = parts[part]
                turn = (high - low) / 2 * np.exp(0.5j * np.pi * (1 - at[node]))
                y = np.linalg.solve(((low + high) / 2 + turn) * np.eye(width) - matrix, blocks[part].astype(complex))
                q = (weight[node] / 2 * turn * y).real
                i = np.arange(q.size, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(q.size, part, np.int32)), pa.array(i), pa.array(q.ravel())], names=["part", "i", "v"])

    nodes = spark.createDataFrame([(p, j) for p in range(len(parts)) for j in range(NODES)], "part int, node int")
    rows = nodes.repartition(min(len(parts) * NODES, spark.sparkContext.defaultParallelism)).mapInArrow(solve, "part int, i int, v double")
    found = rows.groupBy("part", "i").agg(F.sum("v").alias("v")).toArrow()
    part, i, value = (found.column(c).to_numpy() for c in ("part", "i", "v"))
    out = [np.zeros(b.size) for b in start]
    for p, block in enumerate(out):
        block[i[part == p]] = value[part == p]
    return [x.reshape(b.shape) for x, b in zip(out, start)]


def ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and vectors of v on the block's span."""
    q, _ = np.linalg.qr(block)
    q, _ = np.linalg.qr(q)
    values, vectors = np.linalg.eigh((m := q.T @ v @ q, (m + m.T) / 2)[1])
    return values, q @ vectors


def feast(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as columns, largest entry positive."""
    parts = intervals(v, k)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    rng, norm = np.random.default_rng(SEED), float(np.abs(v).sum(1).max())
    blocks = [rng.normal(size=(len(v), min(len(v), 2 * inside + 4))) for *_, inside in parts]
    found: dict[int, np.ndarray] = {}
    for _ in range(ROUNDS):
        waiting = [p for p in range(len(parts)) if p not in found]
        for p, block in zip(waiting, projected(spark, v, [parts[p] for p in waiting], [blocks[p] for p in waiting])):
            low, high, inside = parts[p]
            values, vectors = ritz(v, block)
            own = (values > low) & (values < high)
            residual = np.abs(v @ vectors - vectors * values).max(0)
            if own.sum() == inside and residual[own].max() <= 4e-15 * len(v) ** 0.5 * norm:
                found[p] = vectors[:, own]
            elif own.sum() > inside:
                # a stray direction: begin anew beside what is there
                blocks[p] = vectors + 1e-8 * rng.normal(size=vectors.shape)
            else:
                blocks[p] = vectors
        if len(found) == len(parts):
            break
    else:
        raise ArithmeticError(f"no {[parts[p] for p in range(len(parts)) if p not in found]} pairs after {ROUNDS} rounds")
    values, vectors = ritz(v, np.hstack([found[p] for p in sorted(found)]))
    if len(values) != above(v, parts[0][0]):
        raise ArithmeticError("eigenvalues missed")
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


# ── whitening ──────────────────────────────────────────────────────────────


def whitened(rows: DataFrame, fit: Fit, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): each row's centred vector on the components, over the roots of their eigenvalues."""
    width, kind, to = len(fit.sums), rows.schema["vec_id"].dataType.simpleString(), vectors / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = fit.off(_matrix(b.column(1), width))
            w = fit.centred(off) @ to
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * len(values)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fit.deviation(off), pa.int64()), w], names=["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of w's covariance, as measured over all rows, minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs))


def op11_whitening(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for every vector and component."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    rows = kept(integers(vectors), "whitening-rows")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    fit = fit_of(rows, width) if width else Fit(0, [])
    values, basis = np.zeros(0), np.zeros((width, 0))
    if fit.n:
        v = covariance(rows, fit)
        values, basis = feast(spark, v, components)
    if not len(values):
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    wide = kept(whitened(rows, fit, values, basis), "whitening-wide")
    error, share = identity_error(wide, len(values)), [float(e) for e in values / np.trace(v)]
    out = wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(F.array(*map(F.lit, share)), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
