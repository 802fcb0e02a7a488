"""Dense retrieval: exact and approximate cosine top-k, filters, and the semantic cache's lookups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cosine_col
from tessera.sources.scratch import kept, small_or_shuffled

#: Queries scored against each partition at a time; more are taken in blocks.
QUERY_BLOCK = 4096
#: Scores that a task holds at a time, and candidates it holds for each row asked for before it drops those out of reach.
SCORES, HELD = 1_000_000, 4


@dataclass(frozen=True)
class Filters:
    document_ids: tuple[str, ...] | None = None
    element_types: tuple[str, ...] | None = None
    date_from: str | None = None
    date_to: str | None = None
    min_score: float | None = None
    min_tokens: int | None = None
    max_tokens: int | None = None


def prefilter(chunks: DataFrame, f: Filters) -> DataFrame:
    """DN2: metadata predicates that reach the scan; dates inclusive."""
    if f.document_ids is not None:
        chunks = chunks.where(F.col("document_id").isin(list(f.document_ids)))
    if f.element_types is not None:
        chunks = chunks.where(F.col("element_type").isin(list(f.element_types)))
    if f.date_from is not None:
        chunks = chunks.where(F.col("created_at") >= F.lit(f.date_from).cast("timestamp"))
    if f.date_to is not None:
        chunks = chunks.where(F.col("created_at") <= F.lit(f.date_to).cast("timestamp"))
    return chunks


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v[:width]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


class _Best:
    """A task's candidates of each query: all that can be among its k best once scores are rounded, in bounded memory.

    floor is the score that a query's next candidate has to reach. Of equal scores the
    k smallest ids stay, so copies of one vector take no more room than k rows.
    """

    def __init__(self, queries: int, k: int, slack: float):
        self.k, self.slack, self.floor = k, slack, np.full(queries, -np.inf)
        self.who, self.which, self.score = np.zeros(0, np.int64), None, np.zeros(0)
        self.room = HELD * k * queries

    def add(self, who: np.ndarray, which: np.ndarray, score: np.ndarray) -> None:
        self.which = which if self.which is None else np.concatenate([self.which, which])
        self.who, self.score = np.concatenate([self.who, who]), np.concatenate([self.score, score])
        if len(self.who) > self.room:
            self.trim()
            self.room = max(self.room, 2 * len(self.who))

    def trim(self) -> None:
        if not len(self.who):
            return
        by_id = np.argsort(self.which, kind="stable")
        order = by_id[np.lexsort((-self.score[by_id], self.who[by_id]))]
        who, score = self.who[order], self.score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        at = np.flatnonzero(place == self.k - 1)
        self.floor[who[at]] = score[at] - self.slack
        new = np.append(True, (np.diff(who) != 0) | (np.diff(score) != 0))
        equal = np.arange(len(who)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        order = order[(score >= self.floor[who]) & (equal < self.k)]
        self.who, self.which, self.score = self.who[order], self.which[order], self.score[order]


def knn(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """DN1: exact cosine top-k of every (query_id, embedding) over (chunk_id, embedding).

    Queries are broadcast in blocks; each task multiplies its chunks with them and
    passes on k rows per query, which one ranked window merges. Vectors and queries of
    another length than most of the vectors take no part.
    """
    queries = queries.where("embedding is not null").select("query_id", "embedding")
    widths = chunks.where("embedding is not null").groupBy(F.size("embedding").alias("width")).count()
    most = widths.orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = (most[0]["width"] if most else 0) or 1
    queries = queries.where(F.size("embedding") == width)
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    kinds = queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    kind = chunks.select("chunk_id").limit(0).toArrow().schema.field("chunk_id").type
    found = None
    for b in range(blocks):
        rows = queries.where(part == b).collect()
        ids = [r[0] for r in rows]
        shared = queries.sparkSession.sparkContext.broadcast((ids, _matrix([r[1] for r in rows], width)))

        def local(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            if not len(ids):
                return
            best = _Best(len(ids), k, 10.0**-digits)
            for batch in batches:
                for at in range(0, batch.num_rows, step := max(1, SCORES // len(ids))):
                    part = batch.slice(at, step)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width).astype(np.float64)
                    size = np.linalg.norm(x, axis=1, keepdims=True)
                    score = q @ np.divide(x, size, out=np.zeros_like(x), where=size > 0).T
                    i, j = np.nonzero(score >= best.floor[:, None])
                    best.add(i, part.column(0).to_numpy(zero_copy_only=False)[j], score[i, j])
            best.trim()
            for at in range(0, len(best.who), 100_000):
                i, which, score = (c[at : at + 100_000] for c in (best.who, best.which, best.score))
                yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t in i]), pa.array(which, kind), pa.array(score)], names=["query_id", "chunk_id", "score"])

        vectors = chunks.where(F.size("embedding") == width).select("chunk_id", "embedding")
        new = vectors.mapInArrow(local, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
        found = new if found is None else found.union(new)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    found = found.withColumn("score", F.round("score", digits)).withColumn("rank", place)
    return found.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def postfilter(ranked: DataFrame, f: Filters, k: int) -> DataFrame:
    """DN3: score and token bounds after a top-2k, trimmed to k; unknown token counts fail a bound."""
    if f.min_score is not None:
        ranked = ranked.where(F.col("score") >= f.min_score)
    if f.min_tokens is not None:
        ranked = ranked.where(F.col("token_count") >= f.min_tokens)
    if f.max_tokens is not None:
        ranked = ranked.where(F.col("token_count") <= f.max_tokens)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= k)


def fetch_depth(f: Filters, k: int) -> int:
    return 2 * k if f.min_score is not None else k


# ── approximate search: cells, codes, exact scores ─────────────────────────

#: Most cells of an index; as many as the square root of its rows up to there.
CELLS = 4096
#: Rows for each cell that the quantiser and the codes are trained on, at most; every row is indexed.
TRAINED = 64
#: Components of a code's part, and values of a part.
PART, VALUES = 2, 16
#: Rows of the index that set the number of probes, and the share of their neighbours that the probed cells must hold.
PROBED, REACH = 64, 0.97
#: Candidates scored in full, for each row asked for.
RERANK = 10


@dataclass(frozen=True)
class AnnIndex:
    """rows(row, chunk_id, cell, code, embedding) stored by cell, sizes(cell, n), and what was trained."""

    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def _means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k means of points of few components, from evenly placed starts along their main direction."""
    order = np.argsort(points @ np.linspace(1, 2, points.shape[1]), kind="stable")
    centres = points[order[np.linspace(0, len(points) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        at = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, points[:, j], k) for j in range(points.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _coded(x: np.ndarray, centres: np.ndarray, books: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest cell of each unit vector, and the code of what is left (or that itself, without books)."""
    cell = np.concatenate([(x[i : i + 1024] @ centres.T).argmax(1) for i in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])
    left = x - centres[cell]
    left = np.pad(left, ((0, 0), (0, -left.shape[1] % PART)))
    if books is None:
        return cell, left
    parts = left.reshape(len(x), -1, PART)
    return cell, np.stack([((parts[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(len(books))], 1).astype(np.uint8)


def build_ann(chunks: DataFrame, k: int = 10, cells: int | None = None, seed: int = 7) -> AnnIndex:
    """DN4: an index of (chunk_id, embedding): cells of a trained quantiser, and short codes of what the cell leaves.

    Quantiser and code books are trained on a hashed sample of at most TRAINED rows a
    cell; all rows are indexed, stored in the order of their cells so that a scan for
    some cells skips the others' row groups. The number of cells to probe is measured:
    it holds REACH of the true k nearest of PROBED rows of the table. Null vectors and
    those of another length than most take no part.
    """
    spark = chunks.sparkSession
    given = chunks.where("embedding is not null").select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    lengths = given.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    width, n = (lengths[0]["width"] or 1, lengths[0]["n"]) if lengths else (1, 0)
    cells = max(1, min(cells or int(n**0.5), CELLS, n or 1))
    given = given.where(F.size("embedding") == width).withColumn("row", F.monotonically_increasing_id())
    dealt = F.pmod(F.xxhash64("chunk_id", "embedding", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = kept(given.where(dealt < cells * TRAINED / max(n, 1)).select("embedding"), "ann-sample")
    centres = _cells(sample, cells, width, seed)

    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, left = _coded(_matrix(b.column(0).to_pylist(), width), centres, None)
            parts = left.reshape(-1, PART)
            at = np.tile(np.arange(left.shape[1] // PART), len(left))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(parts), pa.list_(pa.float64()))], names=["part", "left"])

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        means = _means(np.stack(pdf["left"].to_list()), VALUES)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "book": [means.ravel()]})

    # a part's group is the sample's rows, which TRAINED * CELLS bound
    books = sample.mapInArrow(left_over, "part int, left array<double>").groupBy("part").applyInPandas(book, "part int, book array<double>").collect()
    books = np.array([r["book"] for r in sorted(books)]).reshape(-1, VALUES, PART)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, codes = _coded(_matrix(b.column(2).to_pylist(), width), centres, books)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(2)], names=["row", "chunk_id", "cell", "code", "embedding"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = given.select("row", "chunk_id", "embedding").mapInArrow(code, f"row long, chunk_id {kind}, cell int, code binary, embedding array<float>")
    # the hash lets a cell that holds much of the table go to several tasks
    order = [F.col("cell"), F.xxhash64("row")]
    rows = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order), "ann-rows")
    sizes = kept(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "ann-cells")
    index = AnnIndex(rows, sizes, centres, books, cells)
    return replace(index, probes=_probes(index, k, n, seed)) if n else index


def _cells(sample: DataFrame, cells: int, width: int, seed: int) -> np.ndarray:
    """Unit centres by k-means on the angle between vectors; vectors of length 0 teach nothing."""
    points = sample.where(F.exists("embedding", lambda c: c != 0)).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if cells < 2 or points.limit(2).count() < 2:
        return np.zeros((1, width))
    model = KMeans(k=cells, seed=seed, maxIter=8, initSteps=1, distanceMeasure="cosine").fit(points)
    centres = _matrix([list(c) for c in model.clusterCenters()], width)
    return centres


def _probes(index: AnnIndex, k: int, n: int, seed: int) -> int:
    """How many of a query's nearest cells hold REACH of its true neighbours, measured on PROBED rows."""
    some = index.rows.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)) < 2 * PROBED).orderBy(F.xxhash64("row")).limit(PROBED)
    some = kept(some.select(F.col("row").alias("query_id"), "embedding"), "ann-probe")
    near = knn(some, index.rows.select(F.col("row").alias("chunk_id"), "embedding"), k + 1).where("query_id <> chunk_id")
    held = near.join(F.broadcast(some), "query_id").join(index.rows.select(F.col("row").alias("chunk_id"), "cell"), "chunk_id").select("embedding", "cell").collect()
    if not held:
        return len(index.centres)
    score = _matrix([r["embedding"] for r in held], index.width) @ index.centres.T
    own = score[np.arange(len(held)), [r["cell"] for r in held]]
    place = np.sort((score > own[:, None]).sum(1))
    return int(place[min(len(place) - 1, int(np.ceil(REACH * len(place))) - 1)]) + 1


def _nearest_cells(index: AnnIndex, q: np.ndarray) -> np.ndarray:
    """Whether a query probes a cell, (queries, cells)."""
    out = np.zeros((len(q), len(index.centres)), bool)
    if len(q):
        best = np.argpartition(-(q @ index.centres.T), min(index.probes, len(index.centres)) - 1, axis=1)[:, : index.probes]
        np.put_along_axis(out, best, True, 1)
    return out


def ann_candidates(queries: DataFrame, index: AnnIndex, most: int) -> DataFrame:
    """(query_id, row, near): the most rows whose codes come nearest, among the cells that each query probes.

    Queries are broadcast in blocks. A task reads codes alone, cell by cell, meets each
    cell with the queries that probe it, and passes on the best of its share.
    """
    queries = queries.where(F.size("embedding") == index.width).select("query_id", "embedding")
    n, kind = queries.count(), queries.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-n // QUERY_BLOCK))
    centres, books, found = index.centres, index.books, None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        q = _matrix([r[1] for r in rows], index.width)
        probed = _nearest_cells(index, q)
        shared = queries.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.pad(q, ((0, 0), (0, -index.width % PART))), q @ centres.T, probed))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, to_centre, probed = shared.value
            best = _Best(len(ids), most, 0.0)
            for batch in batches:
                cell = batch.column(1).to_numpy()
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cell), -1)
                row = batch.column(0).to_numpy()
                edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
                for lo, hi in zip(edges, edges[1:]):
                    asked = np.flatnonzero(probed[:, cell[lo]])
                    for at in range(lo, hi, step := max(1, SCORES // max(1, len(asked)))) if len(asked) else ():
                        end = min(hi, at + step)
                        left = books[np.arange(code.shape[1]), code[at:end]].reshape(end - at, -1)
                        near = q[asked] @ left.T + to_centre[asked, cell[lo], None]
                        i, j = np.nonzero(near >= best.floor[asked, None])
                        best.add(asked[i], row[at:end][j], near[i, j])
            best.trim()
            for at in range(0, len(best.who), 100_000):
                i, which, near = (c[at : at + 100_000] for c in (best.who, best.which, best.score))
                yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t in i], kinds[0]), pa.array(which), pa.array(near)], names=["query_id", "row", "near"])

        kinds = [queries.limit(0).toArrow().schema.field("query_id").type]
        used = np.flatnonzero(probed.any(0)).tolist()
        codes = index.rows if len(used) == len(centres) else index.rows.where(F.col("cell").isin(used))
        new = codes.select("row", "cell", "code").mapInArrow(scan, f"query_id {kind}, row long, near double")
        found = new if found is None else found.union(new)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "row"))
    return found.withColumn("_place", place).where(F.col("_place") <= most).select("query_id", "row", "near")


def ann_knn(queries: DataFrame, index: AnnIndex, k: int, rerank: int = RERANK) -> DataFrame:
    """DN4: approximate cosine top-k of (query_id, embedding); the rerank * k best by their codes are scored in full."""
    pairs = kept(ann_candidates(queries, index, rerank * k), "ann-pairs")
    wanted = pairs.select("row").distinct()
    vectors = index.rows.select("row", "chunk_id", "embedding").join(small_or_shuffled(wanted), "row", "left_semi")
    scored = pairs.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id").join(vectors, "row")
    scored = scored.select("query_id", "chunk_id", F.round(F.coalesce(cosine_col("_q", "embedding"), F.lit(0.0)), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def ann_effort(queries: DataFrame, index: AnnIndex, k: int, rerank: int = RERANK) -> DataFrame:
    """(looked_at, scored): the shares of all pairs of query and row whose codes were read, and that were scored in full."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            probed = _nearest_cells(light, _matrix(b.column(0).to_pylist(), width))
            yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(probed)[1].astype(np.int32))], names=["cell"])

    width, light = index.width, replace(index, rows=None, sizes=None)
    asked = queries.where(F.size("embedding") == width)
    met = asked.select("embedding").mapInArrow(probe, "cell int").join(index.sizes, "cell").agg(F.sum("n").alias("codes"))
    pairs = ann_candidates(queries, index, rerank * k).agg(F.count(F.lit(1)).alias("full"))
    sizes = asked.agg(F.count(F.lit(1)).alias("q")).crossJoin(F.broadcast(index.sizes.agg(F.sum("n").alias("n"))))  # one row each
    both = sizes.crossJoin(F.broadcast(met)).crossJoin(F.broadcast(pairs))
    every = F.nullif(F.col("q") * F.col("n"), F.lit(0))
    return both.select((F.col("codes") / every).alias("looked_at"), (F.col("full") / every).alias("scored"))


def ann_recall(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """DN5: mean share of the exact top k that the approximate one holds."""
    both = exact.select("query_id", "chunk_id").join(approx.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    per = both.groupBy("query_id").agg((F.count("hit") / F.lit(k)).alias("recall"))
    return per.agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("queries"))
