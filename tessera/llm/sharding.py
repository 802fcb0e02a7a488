"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to P logical partitions by a hash. How many rows partition p sends
to shard k is drawn from the multivariate hypergeometric distribution, level by
level: halves of the super-partitions, then the partitions of each. A partition
ranks its rows by a random key and cuts the ranking at its drawn counts; each
shard then ranks what it has got by a second key. Every step is a function of the
rows and the seed, so a lost task gives the same rows again. Equal rows are dealt
apart by their copy numbers.

Law: `rows` (shard sizes differ by one at most). Defined results: a null text has
size 16 and the CRC-32 of no bytes, 0; repeated rows get slots of their own; an
empty table gives no rows; extra columns are kept and enter the hash that deals a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

from .common import BUCKET_ROWS, copy_numbers, numbered, running_start, whole_hash

SHARDS = 40
SEED = 20_251
SUPER = 256
#: numpy draws hypergeometric numbers for populations below this.
NUMPY_MOST = 10**9


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Exact draw also where numpy refuses: two binomials, conditioned on their sum."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good < NUMPY_MOST and bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    p = n / (good + bad)
    while True:
        x = rng.binomial(good, p, 200_000)
        y = rng.binomial(bad, p, 200_000)
        hit = np.flatnonzero(x + y == n)
        if len(hit):
            return int(x[hit[0]])


def deal(shards: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n rows, drawn without replacement, belong to each shard."""
    out, left = np.zeros(len(shards), np.int64), int(shards.sum())
    for k, size in enumerate(shards):
        left -= int(size)
        out[k] = hypergeometric(int(size), left, n, rng)
        n -= int(out[k])
    return out


def communication_matrix(sizes: np.ndarray, shards: np.ndarray, seed: list[int]) -> np.ndarray:
    """Row i: how many rows part i sends to each shard. Parts are halved again and again.

    Seeds grow by 1 or 2, never by 0, which numpy takes for padding.
    """
    if len(sizes) == 1:
        return shards.reshape(1, -1)
    half = len(sizes) // 2
    left = deal(shards, int(sizes[:half].sum()), np.random.default_rng(seed))
    return np.vstack(
        [communication_matrix(sizes[:half], left, [*seed, 1]), communication_matrix(sizes[half:], shards - left, [*seed, 2])]
    )


def _draw(seed: int, id_col: str):
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        first = np.asarray(pdf["shards"].iloc[0], np.int64)
        matrix = communication_matrix(pdf["n"].to_numpy(), first, [seed, int(pdf["node"].iloc[0]) + 1])
        return pd.DataFrame({id_col: pdf[id_col].to_numpy(), "shards": list(matrix)})

    return draw


def assign(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, _row) for every row; row: the number that docs has from numbered()."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = kept(
        docs.select(
            "doc_id", number.alias("_row"), whole_hash(docs, row or "").alias("_hash"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
        ),
        "shard-rows",
    )
    n = rows.count()
    n_parts = max(1, -(-n // BUCKET_ROWS))
    # equal rows are told apart by their copy number alone, so any of them may bear any
    rows = copy_numbers(rows, "_hash", "_row", "_copy")
    rows = kept(rows.withColumn("_part", F.pmod(F.xxhash64("_hash", "_copy", F.lit(seed)), F.lit(n_parts))), "shard-parts")
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.floor(F.col("_part") / SUPER))
    sizes = [n // n_shards + (k < n % n_shards) for k in range(n_shards)]
    # one row per super-partition meets here: a 262,144th of the rows
    supers = parts.groupBy(F.col("node").alias("super")).agg(F.sum("n").alias("n"))
    supers = supers.withColumn("node", F.lit(-1).cast("long")).withColumn("shards", F.array(*[F.lit(x).cast("long") for x in sizes]))
    top = supers.groupBy("node").applyInPandas(_draw(seed + 1, "super"), "super long, shards array<long>")
    matrix = (
        parts.join(top.withColumnRenamed("super", "node"), "node")
        .groupBy("node")
        .applyInPandas(_draw(seed + 2, "_part"), "_part long, shards array<long>")
    )
    upto = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda i: F.aggregate(F.slice("shards", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    matrix = matrix.select("_part", upto.alias("_upto"))
    local = Window.partitionBy("_part").orderBy(F.xxhash64("_hash", "_copy", F.lit(seed + 3)), "doc_id")
    cut = rows.withColumn("_rank", F.row_number().over(local) - 1).join(matrix, "_part")
    cut = cut.withColumn("shard", F.size(F.filter("_upto", lambda c: c <= F.col("_rank"))))
    second = F.shiftrightunsigned(F.xxhash64("_hash", "_copy", F.lit(seed + 4)), 1)
    n_sub = max(1, -(-n // (n_shards * BUCKET_ROWS)))
    cut = cut.withColumn("_key", second).withColumn("_sub", F.floor(F.shiftrightunsigned("_key", 32) * F.lit(n_sub) / F.lit(2**31)))
    cut = kept(cut.select("doc_id", "_row", "size", "text_crc32", "shard", "_key", "_sub", F.lit(1).cast("long").alias("_one")), "shard-cut")
    return running_start(cut, ["shard"], "_sub", ["_key", "doc_id"], "_one", "slot").drop("_key", "_sub", "_one")


def op9_sharding(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """docs with the columns shard and slot; clashing columns of docs are replaced."""
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows, row = numbered(docs.select(*[f"`{c}`" for c in own]))
    placed = assign(rows, n_shards, row=row).select(F.col("_row").alias(row), "shard", "slot")
    return rows.join(placed, row).drop(row)
