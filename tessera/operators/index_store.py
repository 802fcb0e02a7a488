"""A lexical index that is kept up by batches instead of being built again.

Under the store's path every batch writes folders of its own, so a batch that is run
again replaces itself: forward rows and postings of its new texts, the ids of live
rows it took out, and what it changed in the terms' and the corpus's figures. A row counts while no
later batch took its chunk out. Figures are sums of the batches' changes, so nothing
is counted again. compact() writes one generation of live rows, in the order of their
terms, and the batches before it are no longer read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.lexical import Index, forward_of, gain_col, postings_of
from tessera.sources.scratch import discard, exists, kept, kept_at, written

WORDS = "array<struct<term: string, tf: int>>"
#: Ids taken out that are broadcast, some 50 MB; more are met by shuffle.
BROADCAST_ROWS = 1_000_000
#: Postings that are put in order at a time, in so many slices at most.
SLICE, SLICES = 4_000_000, 4


class LexicalStore:
    """Chunks (chunk_id, content) by batches; kind is the type of chunk_id."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {
            "forward": f"chunk_id {kind}, dl int, words {WORDS}, batch long",
            "postings": f"term string, chunk_id {kind}, tf int, dl int, batch long",
            "gone": f"chunk_id {kind}, batch long",
            "terms": "term string, df long, batch long",
            "stats": "n_chunks long, filled long, tokens long, batch long",
            "generations": "generation long, upto long",
        }

    def _generation(self) -> tuple[int, int]:
        """The generation to read, and the last batch that it holds."""
        if not exists(self.spark, f"{self.path}/generations"):
            return 0, -1
        rows = self.spark.read.schema(self.schemas["generations"]).parquet(f"{self.path}/generations")
        return max(map(tuple, rows.collect()), default=(0, -1))  # a row for each compaction

    def _table(self, name: str) -> DataFrame:
        folder = f"{self.path}/generation={self._generation()[0]}/{name}"
        if not exists(self.spark, folder):
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(folder)

    def _write(self, name: str, rows: DataFrame, batch: int, generation: int, mode: str = "overwrite") -> None:
        written(rows, f"{self.path}/generation={generation}/{name}/batch={batch}", mode, compression="zstd")

    def _write_forward(self, rows: DataFrame, batch: int, generation: int) -> DataFrame:
        """The rows as written: what is made of them need not count words again."""
        self._write("forward", rows, batch, generation)
        rows = self.spark.read.schema(self.schemas["forward"]).parquet(f"{self.path}/generation={generation}/forward")
        return rows.where(F.col("batch") == batch).drop("batch")

    def _write_postings(self, forward: DataFrame, batch: int, generation: int) -> None:
        """In the order of terms; many by slices of the terms, each in their order, so that one slice is shuffled at a time. forward: written."""
        n = forward.agg(F.sum(F.size("words"))).first()[0] or 0
        slices, order = max(1, min(SLICES, -(-n // SLICE))), ["term", "chunk_id"]
        for i in range(slices):
            rows = postings_of(forward)
            rows = rows.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == i) if slices > 1 else rows
            self._write("postings", rows.repartitionByRange(*order).sortWithinPartitions(*order), batch, generation, "append" if i else "overwrite")

    def _met(self, ids: DataFrame, n: int) -> DataFrame:
        # hashed where it is large, so that the long side needs no sort
        return F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("shuffle_hash")

    def _live(self, name: str, before: int | None = None) -> DataFrame:
        """Rows that no later batch took out; before leaves out that batch and those after it."""
        rows, gone = self._table(name), self._table("gone")
        if before is not None:
            rows, gone = rows.where(F.col("batch") < before), gone.where(F.col("batch") < before)
        last = kept(gone.groupBy("chunk_id").agg(F.max("batch").alias("_gone")), "gone")
        if not (n := last.count()):
            return rows
        rows = rows.join(self._met(last, n), "chunk_id", "left")
        return rows.where(F.col("_gone").isNull() | (F.col("batch") >= F.col("_gone"))).drop("_gone")

    def apply(self, batch: int, new: DataFrame | None = None, delete: DataFrame | None = None) -> None:
        """Take out the chunks of delete and of new, then put in new. Batches come in rising order; one that was compacted already is passed over."""
        generation, upto = self._generation()
        if batch <= upto:
            return
        kind = self.schemas["gone"].split(" ")[1].rstrip(",")
        nothing = self.spark.createDataFrame([], f"chunk_id {kind}, content string")
        fresh = self._write_forward(forward_of(new if new is not None else nothing), batch, generation)
        ids = fresh.select("chunk_id")
        ids, ids_at = kept_at((ids if delete is None else ids.unionByName(delete.select("chunk_id"))).distinct(), "batch-ids")
        old = self._live("forward", batch).join(self._met(ids, ids.count()), "chunk_id", "left_semi").select("chunk_id", "dl", "words")
        old, old_at = kept_at(old, "batch-old")
        signed = fresh.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
        terms = signed.select("sign", F.explode("words.term").alias("term")).groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
        count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        stats = signed.agg(count("sign").alias("n_chunks"), count(F.when(F.col("dl").isNotNull(), F.col("sign"))).alias("filled"), count(F.col("dl") * F.col("sign")).alias("tokens"))
        self._write_postings(fresh, batch, generation)
        for name, rows in (("terms", terms), ("stats", stats), ("gone", old.select("chunk_id"))):
            self._write(name, rows, batch, generation)
        discard(self.spark, ids_at)
        discard(self.spark, old_at)

    def postings(self) -> DataFrame:
        """The live postings alone: no figures are worked out for them."""
        return self._live("postings").select("term", "chunk_id", "tf", "dl")

    def index(self) -> Index:
        """The live index, its tables as a rebuild would give them."""
        forward, postings = self._live("forward").drop("batch"), self.postings()
        sums = self._table("stats").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_chunks", "filled", "tokens")])
        stats = kept(sums.select("n_chunks", (F.col("tokens") / F.nullif("filled", F.lit(0))).alias("avgdl")), "stats")
        df = self._table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        most = postings.crossJoin(F.broadcast(stats.select("avgdl"))).groupBy("term").agg(F.max(gain_col(F.col("avgdl"))).alias("most"))  # one row of figures
        return Index(forward.select("chunk_id"), forward, postings, kept(df.join(most, "term"), "terms"), stats)

    def compact(self) -> None:
        """Write the live rows as the next generation, which readers see once its marker is there; vacuum() drops the ones before."""
        generation, upto = self._generation()
        last = self._table("stats").agg(F.max("batch")).first()[0]
        if last is None:
            return
        # postings come from the rows just written: they need not meet what was taken out once more
        self._write_postings(self._write_forward(self._live("forward").drop("batch"), last, generation + 1), last, generation + 1)
        self._write("terms", self._table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), last, generation + 1)
        self._write("stats", self._table("stats").agg(*[F.sum(c).alias(c) for c in ("n_chunks", "filled", "tokens")]), last, generation + 1)
        self.spark.createDataFrame([(generation + 1, last)], self.schemas["generations"]).coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def vacuum(self) -> None:
        """Delete the folders of generations before the one in use. No reader of those may be left."""
        for old in range(self._generation()[0]):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generation={old}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def stream_index(source: DataFrame, store: LexicalStore, checkpoint: str) -> StreamingQuery:
    """Rows (chunk_id, content) put in or, where content is null and deleted is true, taken out, batch by batch."""

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        store.apply(n, df.where("NOT deleted").select("chunk_id", "content"), df.where("deleted").select("chunk_id"))
        df.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
