"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source's documents are put in a random order (by the MD5 of their id) and
laid end to end as one stream of words, cut into blocks of equal size. Points of
the golden-ratio sequence fall into the sources' shares of the cumulative
targets; the k-th point of a source is the slot of its k-th block. A source
whose target exceeds its size goes round its stream again.

Defined results: null text has size 0; a null source is a source, ordered last;
sizes of 0 take nothing; an empty table gives an empty mix; repeated rows are
mixed each on its own; extra columns play no part. Targets and shares are windows over
the table of sources, a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

from .common import BUCKET_ROWS, WORD, free_name, numbered, running_start, small_or_shuffled, whole_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
SEGMENT = 4096
GRID = 1024
#: Odd multiplier of the 32-bit golden-ratio sequence: 2**32 / phi.
GOLDEN = 2654435769


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, _row, _hash, source, size, _key): one narrow row per document; row: the number that docs has from numbered()."""
    return docs.select(
        "doc_id",
        (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"),
        whole_hash(docs, row or "").alias("_hash"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"),
    )


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: (sid, source, source_size, n_rows, target, quota).

    Water filling in closed form: with sources ordered by cap / weight, the level
    is the largest of what is left after capping those before, per weight left.
    The table has a row per source, so its windows stay small.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    sid = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    per = per.withColumn("sid", sid).withColumn("_w", F.element_at(pattern, F.col("sid") % len(weights) + 1))
    per = per.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "sid")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(share)
    level = (budget - (F.sum("_cap").over(upto) - F.col("_cap"))) / (
        F.sum("_w").over(every) - (F.sum("_w").over(upto) - F.col("_w"))
    )
    per = per.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
    target = F.least("_cap", F.col("_w") * F.col("_level"))
    return per.select(
        "sid", "source", "source_size", "n_rows", target.alias("target"),
        F.floor(target + 0.5).cast("long").alias("quota"),
    )


def golden_point(i: Column) -> Column:
    """i * GOLDEN mod 2**32, in halves of i that no long overflows."""
    low, high = i % 2**16, F.shiftright(i, 16) % 2**16
    return (low * GOLDEN + high * GOLDEN % 2**16 * 2**16) % 2**32


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(sid, block, slot): each source's blocks up to its quota, spread evenly over the slots."""
    spark = sources.sparkSession
    need = F.ceil(F.col("quota") / block_words).cast("long")
    total, n_slots, n_sources = sources.agg(F.sum("quota"), F.sum(need), F.count(F.lit(1))).first()
    total, n_slots = total or 0, n_slots or 0
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.where("quota > 0").select(
        "sid", need.alias("_need"), (F.sum("quota").over(upto) / F.lit(max(total, 1))).alias("_hi"), "quota"
    )
    shares = shares.withColumn("_lo", F.col("_hi") - F.col("quota") / F.lit(max(total, 1)))
    cells = shares.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_lo") * GRID), F.least(F.floor(F.col("_hi") * GRID), F.lit(GRID - 1))))
    )
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), (golden_point(F.col("id")) / F.lit(float(2**32))).alias("_u")
    )
    points = points.withColumn("_cell", F.floor(F.col("_u") * GRID))
    hits = points.join(small_or_shuffled(cells, n_sources + GRID), "_cell").where("_u >= _lo and _u < _hi")
    hits = hits.select("sid", "_need", "slot", F.floor(F.col("slot") / SEGMENT).alias("_segment"), F.lit(1).alias("_one"))
    ranked = running_start(hits, ["sid"], "_segment", ["slot"], "_one", "block")
    got = hits.groupBy("sid").agg(F.count(F.lit(1)).alias("_got"))
    # the sequence may leave a source a few points short: those blocks come last
    short = shares.join(got, "sid", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).where("_got < _need")
    late = short.withColumn("block", F.explode(F.sequence(F.col("_got"), F.col("_need") - 1)))
    late = late.select("sid", "block", (F.lit(n_slots) + F.col("block") * n_sources + F.col("sid")).alias("slot"))
    return ranked.where("block < _need").select("sid", "block", "slot").unionByName(late)


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its source's figures and its place (start) in its source's stream.

    The streams are cut by the ids' MD5; the rows of an id that has more of them than a
    bucket holds (null ids count as one) are dealt to buckets of their own. rows: kept.
    """
    joined = rows.alias("r").join(small_or_shuffled(sources).alias("s"), F.expr("r.source <=> s.source")).drop(F.col("s.source"))
    n_buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS)
    bucket = F.expr("cast(conv(substr(_key, 1, 8), 16, 10) as bigint)")
    hot = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET_ROWS)
    hot = kept(hot.select("_key", F.ceil(F.col("_n") / BUCKET_ROWS).alias("_parts")), "mix-hot")
    joined = joined.join(small_or_shuffled(hot), "_key", "left")
    part = F.floor(F.pmod(F.xxhash64("_row"), F.lit(2**32)) * F.coalesce("_parts", F.lit(1)) / F.lit(2**32))
    joined = joined.withColumn("_bucket", F.floor(bucket * n_buckets / F.lit(2**32)).cast("long") * 2**31 + part.cast("long")).drop("_parts")
    joined = kept(joined, "mix-rows")
    return running_start(joined, ["sid"], "_bucket", ["_key", "doc_id", "_hash", "_row"], "size", "start").drop("_bucket")


def mix(rows: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(slices, rest) of sized rows.

    slices: one row per piece of a document in a block, with its slot, block, pass,
    first word and number of words; rest: documents of which nothing is taken.
    """
    rows = kept(rows, "mix-sized")
    sources = kept(targets(rows), "mix-sources")
    place = kept(placed(rows, sources), "mix-places")
    piece = F.expr(
        f"""flatten(transform(sequence(0, {MOST - 1}), p -> transform(
              if(start + p * source_size < least(start + size + p * source_size, quota),
                 sequence((start + p * source_size) div {block_words},
                          (least(start + size + p * source_size, quota) - 1) div {block_words}),
                 array()),
              b -> struct(p as pass, b as block))))"""
    )
    pieces = place.where("size > 0 and start < quota").withColumn("_piece", F.explode(piece))
    pieces = pieces.select("*", "_piece.pass", "_piece.block").drop("_piece")
    shift = F.col("start") + F.col("pass") * F.col("source_size")
    first = F.greatest(shift, F.col("block") * block_words)
    last = F.least(shift + F.col("size"), F.col("quota"), (F.col("block") + 1) * block_words)
    slices = pieces.join(schedule(sources, block_words), ["sid", "block"])
    slices = slices.withColumn("from_word", first - shift).withColumn("n_words", last - first)
    return slices, place.where("size = 0 or start >= quota")


def op1_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, blocks for every row of docs.

    first_slot: where the mix first takes the document; blocks: the slots that hold words of it.
    """
    slices, rest = mix(sized(docs))
    own = ["doc_id", "size", "source_size", "target"]
    taken = slices.groupBy("_row", *own).agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("blocks"))
    none = [F.lit(x).cast("long").alias(n) for x, n in ((0, "taken"), (None, "first_slot"), (0, "blocks"))]
    return taken.select(*own, "taken", "first_slot", "blocks").unionByName(rest.select(*own, *none))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, in the order of its slots: a row per document and pass, text cut to the words taken.

    Whole documents keep their text unchanged; n_chars, if there, follows the text.
    """
    rows, row = numbered(docs)
    slices, _ = mix(sized(rows, row))
    names = [free_name(rows, n) for n in ("_from", "_n", "_size", "_slot")]
    turns = slices.groupBy("_row", "pass", "size").agg(F.min("from_word").alias("_from"), F.sum("n_words").alias("_n"), F.min("slot").alias("_slot"))
    turns = turns.select(F.col("_row").alias(row), *[F.col(c).alias(n) for c, n in zip(("_from", "_n", "size", "_slot"), names)])
    first, n, size, slot = map(F.col, names)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(words, first.cast("int") + 1, n.cast("int")), " ")
    out = rows.join(turns, row).withColumn("text", F.when(n == size, F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.repartitionByRange(slot).sortWithinPartitions(slot, row).select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM per),
c AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][sid % 3 + 1] AS wt, (2 * source_size)::DOUBLE AS cap FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM c)::DOUBLE * 1.5 - (sum(cap) OVER o - cap))
               / ((SELECT sum(wt) FROM c) - (sum(wt) OVER o - wt)) AS lev
      FROM c WINDOW o AS (ORDER BY cap / wt, sid ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(cap, wt * (SELECT max(lev) FROM l)) AS target FROM l),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, ceil(quota / 1024)::BIGINT AS need,
             sum(quota) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT / greatest((SELECT sum(quota) FROM q), 1)::BIGINT AS hi,
             quota / greatest((SELECT sum(quota) FROM q), 1)::BIGINT AS width FROM q),
points AS (SELECT slot, (slot * 2654435769 % 4294967296) / 4294967296.0::DOUBLE AS u
           FROM (SELECT unnest(range((SELECT sum(need)::BIGINT FROM n))) AS slot)),
hits AS (SELECT sid, need, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block
         FROM points JOIN n ON u >= hi - width AND u < hi),
got AS (SELECT sid, count(*) AS m FROM hits GROUP BY sid),
slots AS (
  SELECT sid, block, slot FROM hits WHERE block < need
  UNION ALL
  SELECT sid, block, (SELECT sum(need)::BIGINT FROM n) + block * (SELECT count(*) FROM n) + sid
  FROM (SELECT n.sid, unnest(range(coalesce(m, 0), need)) AS block FROM n LEFT JOIN got USING (sid))),
p AS (SELECT s.doc_id, s.size, n.sid, n.source_size, n.target, n.quota, row_number() OVER () AS id,
             (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS a
      FROM s JOIN n ON s.source IS NOT DISTINCT FROM n.source),
turns AS (SELECT p.*, a + t * source_size AS lo, least(a + size + t * source_size, quota) AS up FROM p, (VALUES (0), (1)) AS v(t)),
pieces AS (SELECT *, unnest(range(lo // 1024, (up - 1) // 1024 + 1)) AS block FROM turns WHERE up > lo),
taken AS (SELECT id, sum(least(up, (block + 1) * 1024) - greatest(lo, block * 1024))::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(*)::BIGINT AS blocks
          FROM pieces JOIN slots USING (sid, block) GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(blocks, 0)::BIGINT AS blocks
FROM p LEFT JOIN taken USING (id)
"""
