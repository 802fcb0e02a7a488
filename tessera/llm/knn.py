"""Exact top-k by inner product as a Voronoi join.

Vectors are quantised to integers and assigned to the nearest of a sample of
pivots, as many as the square root of the rows up to PIVOTS. Each cell is summed up
by its radius, its size and its k+1 smallest distances. By Cauchy-Schwarz q.x lies
within |q| d(x, p) of q.p: the pooled lower bounds give each query a score that k
others reach for certain, and the query is sent only to cells whose upper bound
reaches it. A cell's data are cut into chunks and the queries that came to it into
blocks, so data are copied once per block of their own cell's queries; each chunk
and block is solved on its own and the results are merged by a ranked window.

Defined results: vectors that are null, hold a null or non-finite component, or
have a null vec_id take no part; rows are queries and candidates each on its own,
also where a vec_id repeats (a query leaves out its own row alone, and equal ids
rank side by side); vectors of unequal length meet on their common components;
scores beyond a long become the largest or smallest one; ties go to the smaller
vec_id; fewer than k candidates are all returned; an empty
table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

from .common import small_or_shuffled

TOP = 10
EVERY = 100
SCALE = 1024
#: Most pivots; their summaries (k + 2 numbers each) are all that the driver sees of the vectors.
PIVOTS = 16_384
CHUNK = 4096
#: Queries routed at a time in a task.
ROUTED = 64


def quantised(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, vec): integer components as doubles, which hold them exactly."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    vec = F.transform(x, lambda c: F.floor(c * SCALE).cast("double"))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


def _stack(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; Python integers where doubles would not do."""
    most = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = lambda m: np.array([[int(c) for c in row] for row in m], dtype=object)
    return np.clip(exact(q) @ exact(x).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best(q: pd.DataFrame, x: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """The k best of x for each row of q but the row itself, ties to the smaller vec_id."""
    x = x.sort_values(["vec_id", "row"])
    rows, ids = x["row"].to_numpy(), x["vec_id"].to_numpy()
    score = products(_stack(list(q["vec"]), width), _stack(list(x["vec"]), width))
    out = []
    for query, own, s in zip(q["vec_id"], q["row"], score):
        most = min(k + 1, len(s))
        # every place that may be among the k + 1 best, then those in order
        at = np.flatnonzero(s >= np.partition(s, len(s) - most)[len(s) - most])
        at = at[np.argsort(-s[at], kind="stable")][:most]
        at = at[rows[at] != own][:k]
        out.append((np.full(len(at), query), np.full(len(at), own), ids[at], s[at]))
    cols = [np.concatenate(c) for c in zip(*out)]
    return pd.DataFrame(dict(zip(("query_id", "query_row", "vec_id", "score"), cols)))


def assigned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_stack(b.column(1).to_pylist(), pivots.shape[1]), pivots)
            at = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            far = d[np.arange(len(d)), at]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at), pa.array(far), b.column(1)], names=["row", "vec_id", "cell", "dist", "vec"])

    return vectors.select("row", "vec", "vec_id").mapInArrow(nearest, "row long, vec_id long, cell long, dist double, vec array<double>")


def _nearest_dists(k: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = pd.DataFrame({"cell": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        for pdf in batches:
            least = pd.concat([least, pdf]).sort_values("dist").groupby("cell").head(k + 1)
        yield least

    return scan


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query."""
    clean = kept(quantised(vectors), "knn-vectors")
    width = clean.agg(F.max(F.size("vec"))).first()[0] or 1
    n = clean.count()
    n_pivots = int(min(PIVOTS, max(1, n**0.5)))
    sample = clean.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(n_pivots).collect()
    pivots = np.unique(_stack([r["vec"] for r in sample] or [[0.0]], width), axis=0)
    rows = kept(assigned(clean, pivots), "knn-cells")

    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()
    place = Window.partitionBy("cell").orderBy("dist")
    near = rows.select("cell", "dist").mapInPandas(_nearest_dists(k), "cell long, dist double")
    near = near.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1).collect()
    count, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in sizes:
        count[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    near_cell = np.array([r["cell"] for r in near], np.int64)
    near_dist = np.array([r["dist"] for r in near])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece.slice(at, ROUTED) for piece in batches for at in range(0, piece.num_rows, ROUTED)):
            q = _stack(b.column(2).to_pylist(), width)
            size = np.sqrt((q * q).sum(1))[:, None]
            slack = 1e-9 * (size * (np.abs(pivots).max() + radius.max() + 1) * width) + 1e-6
            middle = q @ pivots.T
            low = middle[:, near_cell] - size * near_dist
            floor = np.partition(low, -(k + 1), axis=1)[:, -(k + 1)] if low.shape[1] > k else np.full(len(q), -np.inf)
            i, cell = np.nonzero((middle + size * radius >= floor[:, None] - slack) & (count > 0))
            yield pa.RecordBatch.from_arrays([pa.array(cell), *[c.take(pa.array(i)) for c in b.columns]], names=["cell", "row", "vec_id", "vec"])

    queries = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "vec")
    sent = kept(queries.mapInArrow(route, "cell long, row long, vec_id long, vec array<double>"), "knn-sent")
    cells = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("blocks"))
    # one row per cell, so within the bound of a broadcast
    cells = kept(cells.join(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "cell"), "knn-sizes")
    own = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["cell", "chunk", "block"]
    asked = sent.join(small_or_shuffled(cells), "cell").withColumn("block", own("blocks", 1)).withColumn("chunk", every_one("chunks"))
    data = rows.join(small_or_shuffled(cells), "cell").withColumn("chunk", own("chunks", 2)).withColumn("block", every_one("blocks"))

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}).astype("int64")
        return best(q, x, width, k)

    found = asked.select(*keys, "row", "vec_id", "vec").groupBy(*keys).cogroup(data.select(*keys, "row", "vec_id", "vec").groupBy(*keys))
    found = found.applyInPandas(solve, "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for every query of embeddings."""
    return top_k(vectors)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
