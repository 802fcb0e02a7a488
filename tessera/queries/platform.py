"""Queries: sources and sinks, ingestion, graph, pipelines, traces, analytics, cache, streams, SQL surface."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sql as U
from tessera.functions import text as T
from tessera.operators import answer, fusion, graph, ingest, lexical, stats, traces
from tessera.plans import retrieval as P
from tessera.sources import io
from tessera.sources.scratch import count_files, discard, kept, kept_at, shared_dir
from tessera.streaming import streams

from .answers import _QA, _SCORED, sql_f1, sql_norm, sql_redact
from .evaluation import _DIFFS, _P, _PARAS, _boot, paragraphs
from .retrieval import _SET, _index, _jaccard, _with
from .tables import BM25, INDEX, corpus, questions, table, vectors, vector_queries, sql_list


def _path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


# ── sources and sinks ──────────────────────────────────────────────────────


def _golden(s, d) -> DataFrame:
    """Benchmark passages written as JSONL lines, some of them broken, read back: good and bad lines counted."""
    q = questions(s, d)
    line = F.to_json(F.struct(F.col("text").alias("question"), F.substring("text", 1, 9).alias("gold_answer"), F.array("text").alias("gold_contexts")))
    broken = F.when(F.col("query_id") % 9 == 1, F.substring(line, 1, 20)).when(F.col("query_id") % 9 == 2, F.lit('{"gold_answer": "x"}')).when(F.col("query_id") % 9 == 3, F.lit("")).otherwise(line)
    path = _path(s, "golden")
    q.coalesce(1).select(broken.alias("value")).write.text(path)
    good, bad = io.read_golden(s, path)
    return good.groupBy(F.lit("good").alias("reason")).agg(F.count(F.lit(1)).alias("n")).unionByName(bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def _intake(s, d) -> DataFrame:
    """The texts as files, one per source, as plain text and as CSV; the larger of them over a limit of 0.05 MB."""
    path = _path(s, "intake")
    texts = corpus(s, d).select("content", F.coalesce("document_id", F.lit("none")).alias("source")).repartition("source")
    texts.select(F.coalesce("content", F.lit("")).alias("value"), "source").write.partitionBy("source").text(path + "/txt")
    texts.select("content", "source").write.partitionBy("source").csv(path + "/csv")
    got = io.intake(s, path + "/*/*/part-*", 0.05)
    name = F.regexp_extract("path", r"/source=([^/]*)/", 1)
    size = F.when(F.col("mime_type") == "text/plain", F.col("length"))
    return got.select(name.alias("source"), "mime_type", size.alias("length"), "accepted", "reason")


def _mime(s, d) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".TXT", ".md", ".html", ".docx", ".csv", ".bin", "")]), (F.col("chunk_id") % 8 + 1).cast("int"))
    return corpus(s, d).select("chunk_id", io.mime_col(F.concat(F.lit("/in/file"), F.col("chunk_id").cast("string"), ext)).alias("mime_type"))


_RESULTS = "arm string, metric string, pos long, value double"


def _result_rows(s, d) -> DataFrame:
    v = table(s, d, "embeddings").where("embedding is not null and label is not null")
    return v.select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("mode"), F.lit("first").alias("metric"), F.col("vec_id").alias("pos"), F.round(F.col("embedding")[0].cast("double"), 6).alias("value"))


def _results_file(s, d) -> DataFrame:
    path = _path(s, "results")
    io.write_result_files(_result_rows(s, d), path)
    return io.read_results(s, path)


def _write_chunks(s, d) -> DataFrame:
    path = _path(s, "chunks")
    rows = vectors(s, d).where("embedding is not null")
    io.write_chunks(rows, path, "label")
    return s.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _jsonl(s, d) -> DataFrame:
    path = _path(s, "jsonl")
    io.write_jsonl(questions(s, d), path)
    return s.read.schema("query_id long, text string").json(path)


def _csv(s, d) -> DataFrame:
    path = _path(s, "csv")
    io.write_csv(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return s.read.schema("n_nationkey int, n_name string, n_regionkey int").csv(path, header=True)


def _result_json(s, d) -> DataFrame:
    path = _path(s, "result-json")
    io.write_results(_result_rows(s, d), path)
    return s.read.schema("mode string, n long, metrics struct<first: array<double>>").json(path).select("mode", "n", F.posexplode("metrics.first").alias("pos", "value"))


# ── ingestion ──────────────────────────────────────────────────────────────


def _spans_of_layout(s, d) -> DataFrame:
    """lineitem as decoded layout spans: order = document, line number = block, quantity = font size."""
    t = F.concat("l_returnflag", "l_linestatus", F.lit(" "), F.col("l_partkey").cast("string"))
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_linenumber").alias("block"), F.col("l_partkey").alias("line"), F.col("l_suppkey").alias("span"),
        t.alias("text"), F.col("l_quantity").alias("size"), (F.col("l_returnflag") == "A").alias("bold"),
    )


_LAYOUT = """
sp AS (SELECT l_orderkey AS doc, l_linenumber AS block, l_partkey AS line, l_suppkey AS span, l_returnflag || l_linestatus || ' ' || l_partkey AS text, l_quantity AS size, l_returnflag = 'A' AS bold FROM lineitem),
m AS (SELECT doc, avg(size) AS ms FROM sp GROUP BY doc),
b AS (SELECT doc, block, string_agg(text, ' ' ORDER BY line, span, text) AS content, max(size) AS size, bool_or(bold) AS bold FROM sp GROUP BY ALL),
k AS (SELECT doc, 1 AS page, block, content, CASE WHEN size >= 1.4::DOUBLE * ms THEN 'title' WHEN size >= 1.15::DOUBLE * ms OR (bold AND length(content) < 200) THEN 'heading' ELSE 'paragraph' END AS element_type FROM b JOIN m USING (doc))
SELECT doc, page, block, content, element_type, last_value(CASE WHEN element_type <> 'paragraph' THEN content END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY block ROWS UNBOUNDED PRECEDING) AS section_path FROM k"""


def _elements(s, d) -> DataFrame:
    return corpus(s, d).select(F.col("chunk_id").alias("doc_id"), F.lit(0).alias("ordinal"), "content")


def _enriched(s, d) -> DataFrame:
    docs = _elements(s, d).select("doc_id", "content")
    call = lambda df, c: answer.complete(df, c, lambda prompts: [f"About {p[-12:]}" if len(p) % 3 else "" for p in prompts])
    return ingest.enrich(ingest.chunk_recursive(_elements(s, d)), docs, call).select("doc_id", "chunk_index", "contextual_summary", "token_count")


def _embedded(s, d) -> DataFrame:
    out = ingest.embed(questions(s, d), "text", ingest.hashing_embedder(32), 32)
    return out.select("query_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


def _documents(s, d) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("completed").alias("status"), F.col("o_orderdate").alias("created_at"))
    return docs, table(s, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_id"))


def _deleted(s, d) -> DataFrame:
    docs, chunks = _documents(s, d)
    _, _, counts = ingest.delete_documents(docs, chunks, docs.where("doc_id % 10 = 0").select("doc_id"))
    return counts


# ── graph and pipelines ────────────────────────────────────────────────────


def _lexeme_graph(s, d) -> DataFrame:
    """The graph over lexemes as entities, each of them proven."""
    chunks = corpus(s, d)
    return graph.build_graph(_index(s, d).postings.select("chunk_id", F.col("term").alias("entity"), F.lit(True).alias("proven")), chunks.count())


_GRAPH = """
n AS (SELECT count(*) AS n FROM documents),
e AS (SELECT term AS entity, chunk_id, ln(n::DOUBLE / df) AS idf FROM postings JOIN dfs USING (term), n WHERE df <= greatest(2, floor(0.05 * n))),
g AS (SELECT chunk_id, entity, idf, coalesce(idf / nullif(sum(idf) OVER (PARTITION BY entity), 0), 0) AS to_chunk, coalesce(idf / nullif(sum(idf) OVER (PARTITION BY chunk_id), 0), 0) AS to_entity FROM e)"""


def _name_graph(s, d) -> tuple[DataFrame, str]:
    """The graph over the names in the chunks as a table, and its path; texts are read for names once."""
    chunks = corpus(s, d)
    names, names_at = kept_at(graph.entities(chunks), "names")
    edges = kept_at(graph.build_graph(names, chunks.count()), "name-graph")
    discard(s, names_at)
    return edges


def _ppr(s, d) -> DataFrame:
    edges, at = _name_graph(s, d)
    found = graph.ppr(graph.seeds(questions(s, d), edges), edges, 10)
    discard(s, at)
    return found


def _both(s, d) -> tuple[DataFrame, P.Corpus]:
    """Questions and chunks that have a text and, by equal id, a vector."""
    v = vectors(s, d).select(F.col("chunk_id").alias("_v"), "embedding")
    q = questions(s, d).join(v, F.col("query_id") == F.col("_v")).select("query_id", "text", "embedding")
    c = corpus(s, d).join(v, F.col("chunk_id") == F.col("_v"), "left").drop("_v")
    return q, P.Corpus(c, lexical.stored(lexical.build_index(c)))


def _pl1(s, d) -> DataFrame:
    q, c = _both(s, d)
    return P.retrieve(q, c, P.RetrievalConfig(mode="hybrid"))


def _pl1_rerank(s, d) -> DataFrame:
    q, c = _both(s, d)
    return P.retrieve(q, c, P.RetrievalConfig(mode="hybrid_rerank"))


def _pl1_graph(s, d) -> DataFrame:
    """The graph arm beside the others, over the names in the chunks."""
    q, c = _both(s, d)
    edges, at = _name_graph(s, d)
    found = P.retrieve(q, P.Corpus(c.chunks, c.index, edges), P.RetrievalConfig(mode="hybrid", strategy="graph"))
    discard(s, at)
    return found


def _pl1_agentic(s, d) -> DataFrame:
    """Every question split in two searches and asked on once, each hop a hybrid retrieval over hashed embeddings."""
    hashed = lambda df, text: ingest.embed(df, text, ingest.hashing_embedder(32), 32)
    chunks = kept(hashed(corpus(s, d), "content"), "embedded")
    half = lambda n: F.array_join(F.slice(F.split("text", r"\s+"), n, 4), " ")
    split = F.concat(F.lit("1. "), half(1), F.lit("\n2. "), half(3))
    reply = lambda df, c: df.withColumn("reply", F.when(F.startswith(c, F.lit("Break")), split).when(F.col("query_id") % 3 == 0, "DONE").otherwise(half(2)))
    cfg = P.RetrievalConfig(mode="hybrid", strategy="agentic", complete=reply, embed=lambda df: hashed(df, "text"))
    return P.retrieve(hashed(questions(s, d), "text"), P.Corpus(chunks, lexical.stored(lexical.build_index(chunks))), cfg)


def _pl2(s, d) -> DataFrame:
    q, c = _both(s, d)
    cfg = P.RetrievalConfig(mode="hybrid")
    ranked = P.rankings(q, c, cfg)
    return P.inspect(ranked, fusion.rrf(ranked)).select("query_id", "chunk_id", "dense", "sparse", "rrf", "dense_share", "sparse_share", "rrf_share")


def _ab(s, d) -> DataFrame:
    q, c = _both(s, d)
    samples = q.withColumn("gold", F.array("text"))
    return P.retrieval_ab(samples, c, P.RetrievalConfig(mode="dense"), P.RetrievalConfig(mode="hybrid"))



def _sql_hybrid(depth: int, more: str = "") -> str:
    """The arms to a depth and their fusion."""
    return f"""
q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id WHERE embedding IS NOT NULL),
ds AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE embedding IS NOT NULL AND vec_id IN (SELECT doc_id FROM documents)),
dn AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank, chunk_id, score FROM ds QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {depth}),
arms AS (SELECT query_id, 'dense' AS arm, rank, chunk_id, score FROM dn UNION ALL SELECT query_id, 'sparse', rank, chunk_id, score FROM bm25 WHERE rank <= {depth}{more}),
fu AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 6) AS rrf, min(struct_pack(arm := arm, rank := rank)) AS f, max(CASE arm WHEN 'dense' THEN score END) AS dense, max(CASE arm WHEN 'sparse' THEN score END) AS sparse FROM arms GROUP BY ALL)"""


_HYBRID = _sql_hybrid(20)
_TOP10 = """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f)::INTEGER AS rank, chunk_id, rrf AS score FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f) <= 10"""

# ── traces ─────────────────────────────────────────────────────────────────


def raw_spans(s, d) -> DataFrame:
    """Orders as traces, their lines as spans: a binary tree by line, every eleventh an orphan."""
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    rows = table(s, d, "lineitem").withColumn("n", F.row_number().over(own)).join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    span = lambda n: F.substring(F.md5(F.concat_ws("/", F.col("l_orderkey").cast("string"), n.cast("string"))), 1, 16)
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + F.col("n") * 1_500_000
    model = F.when(F.col("l_linenumber") % 4 == 0, "gpt-4o-mini").when(F.col("l_linenumber") % 4 == 1, "gpt-4o-2024").when(F.col("l_linenumber") % 4 == 2, "llama3.1:8b")
    attributes = F.create_map(
        F.lit("llm.model_name"), model, F.lit("llm.token_count.prompt"), F.col("l_partkey").cast("string"),
        F.lit("llm.token_count.completion"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey").cast("string")), F.lit("openinference.span.kind"), F.when(F.col("n") % 2 == 0, "LLM"),
    )
    return rows.select(
        F.md5(F.col("l_orderkey").cast("string")).alias("trace_id"), span(F.col("n")).alias("span_id"),
        F.when(F.col("n") % 11 == 0, "ffffffffffffffff").when(F.col("n") > 1, span(F.floor(F.col("n") / 2))).alias("parent_span_id"),
        F.concat(F.lit("step"), F.col("l_linenumber").cast("string")).alias("name"), start.alias("start_ns"), (start + F.col("l_quantity").cast("long") * 1_000_000).alias("end_ns"),
        F.when((F.col("l_returnflag") == "R") & (F.col("n") % 3 == 0), "ERROR").otherwise("OK").alias("status"), attributes.alias("attributes"),
    )


def spans(s, d) -> DataFrame:
    return traces.normalize_spans(raw_spans(s, d))


def _in_micros(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in ("start_time", "end_time") if c in df.columns})


_SPANS = """
num AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS n FROM lineitem),
raw AS (SELECT l_orderkey, n, md5(l_orderkey::VARCHAR) AS trace_id, substr(md5(l_orderkey || '/' || n), 1, 16) AS span_id,
  CASE WHEN n % 11 = 0 THEN 'ffffffffffffffff' WHEN n > 1 THEN substr(md5(l_orderkey || '/' || (n // 2)), 1, 16) END AS parent_span_id, 'step' || l_linenumber AS name,
  epoch_us(o_orderdate) + n * 1500 AS st, epoch_us(o_orderdate) + n * 1500 + l_quantity::BIGINT * 1000 AS et,
  CASE WHEN l_returnflag = 'R' AND n % 3 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n % 2 = 0 THEN 'LLM' ELSE 'CHAIN' END AS kind,
  l_partkey + CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey ELSE 0 END AS tokens,
  CASE l_linenumber % 4 WHEN 0 THEN round(l_partkey / 1e6 * 2.5::DOUBLE + CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey ELSE 0 END / 1e6 * 10.0::DOUBLE, 8)
       WHEN 1 THEN round(l_partkey / 1e6 * 2.5::DOUBLE + CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey ELSE 0 END / 1e6 * 10.0::DOUBLE, 8) WHEN 2 THEN 0.0 END::DOUBLE AS cost0,
  CASE l_linenumber % 4 WHEN 0 THEN round(l_partkey / 1e6 * 0.15::DOUBLE + CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey ELSE 0 END / 1e6 * 0.6::DOUBLE, 8) ELSE NULL END AS mini
  FROM num JOIN orders ON o_orderkey = l_orderkey),
spn AS (SELECT *, CASE WHEN mini IS NOT NULL THEN mini ELSE cost0 END AS cost_usd FROM raw),
trc AS (SELECT trace_id, arg_min(name, struct_pack(a := parent_span_id IS NOT NULL, b := st, c := span_id)) AS name, CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'ok' END AS status,
  min(st) AS start_time, max(et) AS end_time, round((max(et) - min(st)) / 1000, 3) AS latency_ms, nullif(sum(tokens), 0)::BIGINT AS total_tokens, nullif(round(sum(cost_usd), 8), 0) AS total_cost_usd, count(*) AS span_count
  FROM spn GROUP BY trace_id)"""


def _costed(s, d) -> DataFrame:
    e = table(s, d, "events")
    model = F.element_at(F.array(*[F.lit(x) for x in ("gpt-4o", "gpt-4o-mini-x", "LLAMA3.1:70b", "unknown", "gemini-1.5-pro")]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = e.select("event_id", model.alias("model"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 1000).alias("output_tokens"))
    return traces.cost(rows).select("event_id", "model", "cost_usd", "free_model")


def _resolved(s, d) -> DataFrame:
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    hexed = F.md5(F.col("k").cast("string"))
    q = orders.select(F.concat(F.lit("q"), F.col("k").cast("string")).alias("query_id"), hexed.alias("trace_id"))
    t = orders.select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("id"), hexed.alias("trace_id"))
    e = table(s, d, "events")
    key = (F.col("event_id") % 1000).cast("string")
    ref = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("q"), key)).when(F.col("event_id") % 4 == 1, F.md5(key)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("t"), key)).otherwise("nobody")
    feedback = e.select(F.col("event_id").alias("feedback_id"), ref.alias("ref"), (F.col("user_id") % 3 - 1).alias("rating"), F.col("ts").alias("created_at"))
    good, bad = traces.resolve_feedback(feedback, t, q)
    return good.select("feedback_id", "query_id", "rating").unionByName(bad.select("feedback_id", F.lit(None).cast("string").alias("query_id"), "rating"))


# ── analytics and cache ────────────────────────────────────────────────────

NOW, DAYS = "2024-01-25 12:00:00", 20


def query_log(s, d) -> DataFrame:
    return table(s, d, "events").select(
        F.col("ts").cast("timestamp").alias("created_at"), (F.col("value") * 10).alias("latency_ms"), F.col("user_id").alias("total_tokens"), (F.col("value") / 1000).alias("total_cost_usd"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("model"), "event_type",
    )


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


_LOG = f"""
lg AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, value * 10 AS lat, value / 1000 AS cost, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'unknown') AS model FROM events
       WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL {DAYS} DAY AND ts <= TIMESTAMP '{NOW}')"""


def _entries(s, d) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("chunk_id") % 100).cast("int"))
    return vectors(s, d).where("chunk_id % 50 > 0").select(F.col("chunk_id").alias("key"), "embedding", at.alias("cached_at"))


def _looked_up(s, d) -> DataFrame:
    return traces.cache_lookup(vector_queries(s, d), _entries(s, d), "2024-01-01 01:30:00", 0.35)


def _put(s, d) -> DataFrame:
    q = questions(s, d)
    row = lambda df, minutes: df.select("text", (F.col("query_id") % 7).cast("string").alias("answer"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=minutes.cast("int"))).alias("cached_at"))
    old = row(q.where("query_id % 2 = 0"), F.col("query_id")).select(traces.cache_key_col(F.col("text")).alias("key"), F.col("text").alias("query"), "answer", "cached_at")
    new = row(q, F.lit(20) + F.col("query_id") % 3).withColumnRenamed("text", "query").withColumn("answer", F.lit("new"))
    return traces.cache_put(old, new).select("key", "answer", F.unix_micros("cached_at").alias("cached_us"))


# ── streams over files derived from the tables ─────────────────────────────


def _requests(s, d) -> DataFrame:
    method = F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET")
    return table(s, d, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("scope"), method.alias("method"))


#: Rows of a table that a stream's feed writes a slice of as one file; texts are long, so they are few.
ONE_PART = 10_000


def _as_stream(s, df: DataFrame, tag: str, order: str, slices: int = 4) -> DataFrame:
    """df written in a few slices in order and read as a stream, one slice per trigger.

    A slice is as many files as the table has parts, each with its share of the slice's rows.
    """
    path = _path(s, tag)
    df = kept(df, f"{tag}-rows")
    key = F.col(order).cast("double")
    parts = df.rdd.getNumPartitions() if df.count() >= ONE_PART else 1
    cuts = [float("-inf"), *df.select(key.alias("k")).approxQuantile("k", [i / slices for i in range(1, slices)], 0.01), float("inf")]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):  # files are read in the order they were written
        rows = df.where((key > low) & (key <= high))
        rows = rows.repartitionById(parts, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")) if parts > 1 else rows.coalesce(1)
        rows.write.mode("append").parquet(path)
        for _ in range(parts * (i + 1) - count_files(s, path, ".parquet")):  # a part without rows has no file, and triggers count files
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a commit writes what changed, not the whole state
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(path)


def _drained(s, stream: DataFrame, tag: str) -> DataFrame:
    """The stream's whole output, through a checkpointed file sink."""
    path = _path(s, tag)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{path}/out")


def _limit_stream(s, d) -> DataFrame:
    return _drained(s, streams.rate_limit_stream(_as_stream(s, _requests(s, d), "requests", "ts"), 2, 86_400), "limited").select("request_id", "allowed", "retry_after")


def tokens(s, d) -> DataFrame:
    """Conversation turns with personal data, as tokens of seven characters."""
    t = table(s, d, "conversations").where("text is not null")
    text = F.concat("text", F.lit(" Mail jane.doe@example.org, call +44 7700 900123."))
    seq = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 7).cast("int"))
    rows = t.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), text.alias("t"), F.posexplode(seq).alias("seq", "_i"))
    last = F.col("seq") == F.floor((F.length("t") - 1) / 7)
    return rows.select("answer_id", F.col("seq").cast("long").alias("seq"), F.substring(F.col("t"), F.col("seq") * 7 + 1, F.lit(7)).alias("token"), last.alias("done"))


def _redacted_stream(s, d) -> DataFrame:
    out = _drained(s, streams.redact_stream(_as_stream(s, tokens(s, d), "tokens", "seq"), 96), "redacted")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("upto_seq", "text"))), lambda x: x["text"]), "")
    return out.groupBy("answer_id").agg(F.md5(whole).alias("text_md5"), F.bool_or("finished").alias("finished"))


def _rollup_stream(s, d) -> DataFrame:
    rows = spans(s, d).drop("attributes")
    return _in_micros(_drained(s, streams.stream_rollup(_as_stream(s, rows, "spans", "start_time")), "rolled"))


def _latency_stream(s, d) -> DataFrame:
    return streams.latency_of_days(_drained(s, streams.stream_latency(_as_stream(s, query_log(s, d), "log", "created_at")), "latency"))


def _cache_stream(s, d) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("chunk_id").cast("int") % 50)
    q = vectors(s, d).where("embedding is not null").select(F.col("chunk_id").alias("query_id"), F.concat(F.lit("q"), (F.col("chunk_id") % 90).cast("string")).alias("query"), "embedding", at.alias("ts"))
    path = _path(s, "cache")
    streams.stream_cache(_as_stream(s, q, "lookups", "query_id"), f"{path}/entries", f"{path}/out", f"{path}/checkpoint", lambda df: df.withColumn("answer", F.upper("query")), 0.5).awaitTermination()
    return s.read.schema("query_id long, hit boolean, key string, similarity double, batch int").parquet(f"{path}/out")


def _ingest_stream(s, d) -> DataFrame:
    docs = corpus(s, d).select(F.col("chunk_id").alias("doc_id"), "content")
    path = _path(s, "ingest")
    streams.stream_ingest(_as_stream(s, docs, "new-docs", "doc_id"), f"{path}/chunks", f"{path}/status", f"{path}/checkpoint").awaitTermination()
    return s.read.parquet(f"{path}/status").select("doc_id", "status", "chunk_count")


def _sql_surface(s, d) -> DataFrame:
    U.register_sql(s)
    view = f"qa_{uuid.uuid4().hex}"
    from .answers import qa

    qa(s, d).createOrReplaceTempView(view)
    return s.sql(f"SELECT query_id, jaccard(question, answer) AS jaccard, token_f1(question, answer) AS f1, est_tokens(answer) AS n_tokens, pii_redact(answer) = answer AS clean, injection_confidence(answer) AS confidence FROM {view}")


def _udtf(s, d) -> DataFrame:
    U.register_sql(s)
    view = f"docs_{uuid.uuid4().hex}"
    corpus(s, d).select("chunk_id", "content").createOrReplaceTempView(view)
    return s.sql(f"SELECT d.chunk_id, c.chunk_index, length(c.content) AS n_chars FROM {view} d, LATERAL chunk_text(d.content, 512, 50) c")


def _registered(s, d) -> DataFrame:
    U.register_model("embedder", "hashing", ingest.hashing_embedder(16))
    out = ingest.embed(questions(s, d), "text", U.model("embedder", "hashing"), 16)
    return out.select("query_id", F.size("embedding").alias("dim"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sr1_read_corpus": lambda s, d: io.read_corpus(s, f"{d}/documents.parquet", ["doc_id", "lang", "source"]),
    "sr2_read_golden": _golden,
    "sr4_intake": _intake,
    "sr5_mime": _mime,
    "sr6_read_results": _results_file,
    "sk1_write_chunks": _write_chunks,
    "sk2_write_jsonl": _jsonl,
    "sk3_write_csv": _csv,
    "sk4_write_results": _result_json,
    "ig1_classify_blocks": lambda s, d: ingest.classify_blocks(_spans_of_layout(s, d)),
    "ig2_drop_short": lambda s, d: ingest.drop_short(paragraphs(s, d)).select("chunk_id", "content"),
    "ig3_chunk_recursive": lambda s, d: ingest.chunk_recursive(_elements(s, d)),
    "ig4_chunk_hierarchical": lambda s, d: ingest.chunk_hierarchical(_elements(s, d)).select("doc_id", "chunk_index", "level", F.length("content").alias("n_chars"), "parent_index"),
    "ig5_est_tokens": lambda s, d: corpus(s, d).select("chunk_id", T.est_tokens_col("content").alias("n"), T.est_tokens_col("content", True).alias("n_cost")),
    "ig6_sentence_windows": lambda s, d: ingest.sentence_windows(_elements(s, d)),
    "ig7_enrich": _enriched,
    "ig8_embed": _embedded,
    "ig9_list_documents": lambda s, d: ingest.list_documents(*_documents(s, d)),
    "ig10_delete_documents": _deleted,
    "ge1_entities": lambda s, d: graph.entities(corpus(s, d)),
    "ge2_build_graph": lambda s, d: _lexeme_graph(s, d).select("chunk_id", "entity", *[F.round(c, 6).alias(c) for c in ("idf", "to_chunk", "to_entity")]),
    "ge3_seeds": lambda s, d: graph.seeds(questions(s, d), _lexeme_graph(s, d)),
    "ge4_ppr": _ppr,
    "pl1_retrieve_hybrid": _pl1,
    "pl1_retrieve_rerank": _pl1_rerank,
    "pl1_retrieve_graph": _pl1_graph,
    "pl1_retrieve_agentic": _pl1_agentic,
    "pl2_inspect": _pl2,
    "ex8_retrieval_ab": _ab,
    "tr1_sample_traces": lambda s, d: traces.sample_traces(raw_spans(s, d), 0.25).select("trace_id", "span_id"),
    "tr2_normalize_spans": lambda s, d: _in_micros(spans(s, d).drop("attributes")),
    "tr3_cost": _costed,
    "tr4_rollup": lambda s, d: _in_micros(traces.rollup(spans(s, d))),
    "tr5_list_traces": lambda s, d: _in_micros(traces.list_traces(traces.rollup(spans(s, d)), 10, 40, "ok", 50)),
    "tr6_get_trace": lambda s, d: traces.get_trace(traces.rollup(spans(s, d)).select(F.concat(F.lit("t"), "trace_id").alias("id"), "trace_id"), spans(s, d), "8f14e45fceea167a5a36dedd4bea2543").select("span_id", "name"),
    "tr7_waterfall": lambda s, d: traces.waterfall(spans(s, d)),
    "tr9_resolve_feedback": _resolved,
    "tr10_list_feedback": lambda s, d: traces.list_feedback(table(s, d, "events").select(F.col("event_id").alias("feedback_id"), F.col("ts").alias("created_at"))).select("feedback_id"),
    "an1_latency": lambda s, d: _day(traces.latency(query_log(s, d), DAYS, NOW)),
    "an1_latency_sketch": lambda s, d: _day(traces.latency_sketch(query_log(s, d), DAYS, NOW)),
    "an2_cost_report": lambda s, d: _day(traces.cost_report(query_log(s, d), DAYS, NOW)),
    "an3_cache_report": lambda s, d: traces.cache_report(query_log(s, d).select((F.col("event_type") == "click").alias("hit")), query_log(s, d), DAYS, NOW),
    "an4_throughput": lambda s, d: _day(traces.throughput(query_log(s, d), DAYS, NOW)),
    "ca1_cache_lookup": _looked_up,
    "ca2_cache_put": _put,
    "ca3_live_entries": lambda s, d: traces.live_entries(_entries(s, d), "2024-01-01 01:30:00").select("key"),
    "st1_rate_limit": lambda s, d: streams.rate_limit(_requests(s, d), 2, 86_400).select("request_id", "allowed", "retry_after"),
    "st1_rate_limit_stream": _limit_stream,
    "st2_redact_stream": _redacted_stream,
    "st3_stream_rollup": _rollup_stream,
    "st4_stream_latency": _latency_stream,
    "st5_stream_cache": _cache_stream,
    "st6_stream_ingest": _ingest_stream,
    "ud1_sql_functions": _sql_surface,
    "ud2_registered_model": _registered,
    "ud3_chunk_udtf": _udtf,
}

#: White space beyond ASCII too.
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_SQL_NAMES = rf"""
WITH t AS (SELECT doc_id AS chunk_id, regexp_extract_all(coalesce(text, ''), '(?s)(.*?)({graph.TOKEN})', 1) AS gaps, regexp_extract_all(coalesce(text, ''), '(?s)(.*?)({graph.TOKEN})', 2) AS tokens FROM documents),
r AS (SELECT chunk_id, unnest(range(len(tokens))) AS n, unnest(gaps) AS gap, unnest(tokens) AS token FROM t),
m AS (SELECT chunk_id, n, lower(token) AS entity, regexp_matches(token, '[0-9]|.[A-Z]') AS coded, regexp_matches(token, '^[A-Z]') AS named,
        regexp_replace(gap, '[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '') AS gap
      FROM r WHERE regexp_matches(token, '[A-Za-z]') AND length(token) >= 2 AND NOT list_contains({sql_list(graph.NOT_NAMES)}, lower(token)))
SELECT chunk_id, entity, bool_or(coded OR CASE WHEN gap = '' THEN n > 0 ELSE NOT contains('{graph.SENTENCE_END.strip()}', right(gap, 1)) END) AS proven
FROM m WHERE coded OR named GROUP BY chunk_id, entity"""


def _ppr_steps(k: int) -> list[str]:
    """ppr: the walk over names, one step after the other, and its k best chunks."""
    steps = ["m0 AS MATERIALIZED (SELECT query_id, entity, r AS m FROM st)"]
    spread = "(SELECT query_id, chunk_id, sum(m * to_chunk) AS c FROM m{} JOIN g USING (entity) GROUP BY ALL)"
    for i in range(graph.ITERATIONS):
        steps.append(f"b{i} AS MATERIALIZED (SELECT query_id, entity, sum(c * to_entity) AS b FROM {spread.format(i)} JOIN g USING (chunk_id) GROUP BY ALL)")
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT query_id, entity, {graph.RESTART} * coalesce(r, 0) + (1 - {graph.RESTART})::DOUBLE * coalesce(b, 0) AS m FROM b{i} FULL JOIN st USING (query_id, entity))")
    return [
        f"nm AS MATERIALIZED ({_SQL_NAMES})",
        "n AS (SELECT count(*) AS n FROM documents)",
        f"gd AS (SELECT entity, count(*) AS df FROM nm, n GROUP BY entity, n HAVING bool_or(proven) AND count(*) <= greatest(2, floor({graph.MAX_DF} * n)))",
        "e AS (SELECT entity, chunk_id, ln(n::DOUBLE / df) AS idf FROM nm JOIN gd USING (entity), n)",
        "g AS MATERIALIZED (SELECT chunk_id, entity, idf, coalesce(idf / nullif(sum(idf) OVER (PARTITION BY entity), 0), 0) AS to_chunk, coalesce(idf / nullif(sum(idf) OVER (PARTITION BY chunk_id), 0), 0) AS to_entity FROM e)",
        r"qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]*[a-z0-9]|[a-z]')) AS entity FROM benchmark)",
        "st AS MATERIALIZED (SELECT query_id, entity, coalesce(idf / nullif(sum(idf) OVER (PARTITION BY query_id), 0), 0) AS r FROM qt JOIN (SELECT DISTINCT entity, idf FROM g) USING (entity))",
        *steps,
        f"sc AS (SELECT query_id, chunk_id, round(c, 6) AS score FROM {spread.format(graph.ITERATIONS)})",
        f"ppr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank, chunk_id, score FROM sc WHERE score > 0 QUALIFY rank <= {k})",
    ]


#: Two rankings of the same questions, judged by the question's own text.
_AB = (
    "runs AS (SELECT 'a' AS run, query_id, rank, chunk_id FROM dn WHERE rank <= 10 UNION ALL SELECT 'b', query_id, rank, chunk_id FROM (" + _TOP10 + "))",
    f"jw AS (SELECT run, query_id, rank, {_SET.format('d.text')} AS c, {_SET.format('b.text')} AS g FROM runs JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON item_id = query_id)",
    f"jl AS (SELECT run, query_id, rank, ({_jaccard('c', 'g')} >= 0.5)::INTEGER AS l FROM jw)",
    "jr AS (SELECT run, query_id, coalesce(list(l ORDER BY rank) FILTER (rank IS NOT NULL), []) AS labels FROM (SELECT item_id AS query_id, run FROM benchmark JOIN embeddings ON vec_id = item_id, (VALUES ('a'), ('b')) t(run)) LEFT JOIN jl USING (run, query_id) GROUP BY ALL)",
    "jm AS (SELECT run, query_id, coalesce(list_max(labels), 0) AS hit, CASE WHEN list_contains(labels, 1) THEN 1 / list_position(labels, 1) ELSE 0 END AS mrr,"
    " CASE WHEN list_contains(labels, 1) THEN list_sum(list_transform(range(1, len(labels) + 1), lambda i: labels[i] / log2(i + 1))) / list_sum(list_transform(range(1, list_sum(labels)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM jr)",
    "jv AS (SELECT run, query_id, unnest(['mrr', 'hit_rate', 'ndcg_at_10', 'recall_at_10', 'full_support_at_10']) AS metric, unnest([round_even(mrr::DOUBLE, 4), hit::DOUBLE, round_even(ndcg::DOUBLE, 4), hit::DOUBLE, hit::DOUBLE]) AS v FROM jm)",
    "prs AS (SELECT metric, x.query_id AS sample_index, x.v AS a, y.v AS b FROM jv x JOIN jv y USING (metric, query_id) WHERE x.run = 'a' AND y.run = 'b')",
)

ORACLES: dict[str, str] = {
    "ge1_entities": _SQL_NAMES,
    "sr1_read_corpus": "SELECT doc_id, lang, source FROM documents",
    "sr2_read_golden": "SELECT CASE item_id % 9 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'missing question' ELSE 'good' END AS reason, count(*) AS n FROM benchmark WHERE item_id % 9 <> 3 GROUP BY ALL",
    "sr4_intake": """
WITH t AS (SELECT coalesce(source, 'none') AS source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS length FROM documents GROUP BY ALL),
f AS (SELECT source, 'text/plain' AS mime_type, length, CASE WHEN length > 52428 THEN 'too large' END AS reason FROM t UNION ALL SELECT source, 'text/csv', NULL, 'unsupported type' FROM t)
SELECT source, mime_type, length, reason IS NULL AS accepted, reason FROM f""",
    "sr5_mime": "SELECT doc_id AS chunk_id, ['application/pdf', 'text/plain', 'text/markdown', 'text/html', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/csv', 'application/octet-stream', 'application/octet-stream'][doc_id % 8 + 1] AS mime_type FROM documents",
    "sr6_read_results": "SELECT 'm' || label AS mode, 'first' AS metric, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS pos, round(embedding[1]::DOUBLE, 6) AS value FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL",
    "sk1_write_chunks": "SELECT label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY label",
    "sk2_write_jsonl": "SELECT item_id AS query_id, text FROM benchmark",
    "sk3_write_csv": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "sk4_write_results": "SELECT 'm' || label AS mode, count(*) OVER (PARTITION BY label) AS n, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS pos, round(embedding[1]::DOUBLE, 6) AS value FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL",
    "ig1_classify_blocks": "WITH " + _LAYOUT,
    "ig2_drop_short": _with(_PARAS) + r"SELECT chunk_id, content FROM par WHERE length(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 10",
    "ig5_est_tokens": "SELECT doc_id AS chunk_id, greatest(1, length(text) // 4)::INTEGER AS n, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS n_cost FROM documents",
    "ig6_sentence_windows": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '([.!?]){_SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM documents),
n AS (SELECT doc_id, s, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '{_SPACE}+'), lambda w: w <> ''))) AS k FROM d WHERE len(s) > 0),
t AS (SELECT doc_id, s, list_transform(range(len(k) + 1), lambda i: coalesce(list_sum(k[1:i]), 0)::BIGINT) AS upto FROM n),
w AS (SELECT doc_id, s, upto, 0::BIGINT AS i, 0::BIGINT AS low, greatest(1, len(list_filter(upto, lambda u: u <= 190)) - 1)::BIGINT AS high FROM t
      UNION ALL
      SELECT doc_id, s, upto, i + 1, b, greatest(b + 1, len(list_filter(upto, lambda u: u <= upto[b + 1] + 190)) - 1) FROM (
        SELECT *, least(high, greatest(low + 1, len(list_filter(upto, lambda u: u < upto[high + 1] - 60))))::BIGINT AS b FROM w WHERE high < len(s)))
SELECT doc_id, i::INTEGER AS window_index, array_to_string(s[low + 1:high], ' ') AS content FROM w""",
    "ig9_list_documents": """
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS doc_id, CASE WHEN n IS NULL THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS created_at, coalesce(n, 0) AS chunk_count, CASE WHEN n IS NULL THEN 'No text chunks extracted' END AS error_message
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""",
    "ig10_delete_documents": "SELECT 'documents' AS \"table\", count(*) AS deleted FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0)",
    "ge2_build_graph": _with(INDEX, _GRAPH) + "SELECT chunk_id, entity, round(idf, 6) AS idf, round(to_chunk, 6) AS to_chunk, round(to_entity, 6) AS to_entity FROM g",
    "ge4_ppr": _with(*_ppr_steps(10)) + "SELECT * FROM ppr",
    "ge3_seeds": _with(INDEX, _GRAPH) + r"""
, t AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]*[a-z0-9]|[a-z]')) AS entity FROM benchmark)
SELECT query_id, entity FROM t WHERE entity IN (SELECT entity FROM g)""",
    "pl1_retrieve_hybrid": _with(INDEX, BM25, _HYBRID) + _TOP10,
    "pl1_retrieve_graph": _with(INDEX, BM25, *_ppr_steps(20), _sql_hybrid(20, " UNION ALL SELECT query_id, 'zgraph', rank, chunk_id, score FROM ppr")) + _TOP10,
    "pl1_retrieve_rerank": _with(INDEX, BM25, _sql_hybrid(40)) + f"""
, c AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f) AS place FROM fu QUALIFY place <= 40),
w AS (SELECT query_id, place, chunk_id, {_SET.format('b.text')} AS q, {_SET.format('d.text')} AS t FROM c JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id),
s AS (SELECT query_id, place, chunk_id, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t)) / len(q), 4) ELSE 0 END AS score FROM w)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place)::INTEGER AS rank, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) <= 10""",
    "ex8_retrieval_ab": _with(INDEX, BM25, _HYBRID, *_AB, _DIFFS, _boot("dif", stats.ITERATIONS), _P) + """
SELECT metric, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b - a), 6) AS delta, any_value(n) AS n, any_value(significant) AS significant, any_value(p_value) AS p_value FROM prs JOIN bst USING (metric) GROUP BY metric""",
    "pl2_inspect": _with(INDEX, BM25, _HYBRID) + """
SELECT query_id, chunk_id, dense, sparse, rrf, round(dense / nullif(max(dense) OVER w, 0), 6) AS dense_share, round(sparse / nullif(max(sparse) OVER w, 0), 6) AS sparse_share, round(rrf / nullif(max(rrf) OVER w, 0), 6) AS rrf_share
FROM fu WINDOW w AS (PARTITION BY query_id)""",
    "tr1_sample_traces": _with(_SPANS) + "SELECT trace_id, span_id FROM spn WHERE (((('0x' || substr(trace_id, 1, 16))::UBIGINT::HUGEINT % 10000) * 1616 + ('0x' || substr(trace_id, 17, 16))::UBIGINT::HUGEINT % 10000) % 10000)::DOUBLE / 10000 < 0.25",
    "tr2_normalize_spans": _with(_SPANS) + "SELECT trace_id, span_id, parent_span_id, name, kind, status, st AS start_time, et AS end_time, round((et - st) / 1000, 3) AS duration_ms, tokens, cost_usd FROM spn",
    "tr3_cost": """
WITH m AS (SELECT event_id, ['gpt-4o', 'gpt-4o-mini-x', 'LLAMA3.1:70b', 'unknown', 'gemini-1.5-pro'][event_id % 5 + 1] AS model, [2.5, 2.5, 0, 0, 1.25][event_id % 5 + 1]::DOUBLE AS i, [10, 10, 0, 0, 5][event_id % 5 + 1]::DOUBLE AS o, user_id, event_id % 1000 AS t FROM events)
SELECT event_id, model, round(user_id / 1e6 * i + t / 1e6 * o, 8) AS cost_usd, i = 0 AND o = 0 AS free_model FROM m""",
    "tr4_rollup": _with(_SPANS) + "SELECT * FROM trc",
    "tr5_list_traces": _with(_SPANS) + "SELECT * FROM trc WHERE latency_ms BETWEEN 10 AND 40 AND status = 'ok' ORDER BY start_time DESC, trace_id LIMIT 50",
    "tr6_get_trace": _with(_SPANS) + "SELECT span_id, name FROM spn WHERE trace_id = '8f14e45fceea167a5a36dedd4bea2543'",
    "tr7_waterfall": "WITH RECURSIVE " + _SPANS + """,
pr AS (SELECT a.*, b.span_id AS parent FROM spn a LEFT JOIN spn b ON b.trace_id = a.trace_id AND b.span_id = a.parent_span_id),
wf AS (SELECT trace_id, span_id, 0 AS depth, [struct_pack(s := st, i := span_id)] AS path FROM pr WHERE parent IS NULL
       UNION ALL SELECT p.trace_id, p.span_id, w.depth + 1, list_append(w.path, struct_pack(s := p.st, i := p.span_id)) FROM pr p JOIN wf w ON w.trace_id = p.trace_id AND w.span_id = p.parent)
SELECT w.trace_id, row_number() OVER (PARTITION BY w.trace_id ORDER BY path)::INTEGER AS ord, w.span_id, depth,
       round((s.st - t.start_time) / 1000 / greatest((t.end_time - t.start_time) / 1000, 1) * 100, 4) AS offset_pct, round(greatest((s.et - s.st) / 1000 / greatest((t.end_time - t.start_time) / 1000, 1) * 100, 0.5), 4) AS width_pct
FROM wf w JOIN spn s USING (trace_id, span_id) JOIN trc t USING (trace_id)""",
    "tr9_resolve_feedback": """
SELECT event_id AS feedback_id, CASE WHEN event_id % 4 < 3 AND event_id % 1000 IN (SELECT o_orderkey FROM orders) THEN 'q' || (event_id % 1000) END AS query_id, user_id % 3 - 1 AS rating FROM events""",
    "tr10_list_feedback": "SELECT event_id AS feedback_id FROM events ORDER BY ts DESC, event_id LIMIT 200",
    "an1_latency": _with(_LOG) + "SELECT day, round(quantile_cont(lat, 0.5), 4) AS p50, round(quantile_cont(lat, 0.95), 4) AS p95, round(quantile_cont(lat, 0.99), 4) AS p99, count(*) AS n FROM lg GROUP BY ROLLUP (day)",
    "an2_cost_report": _with(_LOG) + """
SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(day) = 0 THEN 'day' ELSE 'total' END AS part, model, day, round(sum(cost), 6) AS cost, sum(user_id)::BIGINT AS tokens, count(*) AS n, round(avg(cost), 8) AS average
FROM lg GROUP BY GROUPING SETS ((), (model), (day))""",
    "an3_cache_report": _with(_LOG) + """
, h AS (SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type <> 'click') AS misses FROM events)
SELECT hits, misses, round(hits / (hits + misses), 4) AS hit_rate, round(hits * (SELECT avg(cost) FROM lg WHERE cost > 0), 6) AS savings_usd FROM h""",
    "an4_throughput": _with(_LOG) + f"""
, p AS (SELECT day, count(*) AS n FROM lg GROUP BY day)
SELECT day, n, round(n / 86400, 6) AS qps, NULL::DOUBLE AS peak_qps FROM p UNION ALL SELECT NULL, sum(n)::BIGINT, round(sum(n) / ({DAYS} * 86400), 6), round(max(n) / 86400, 6) FROM p""",
    "ca1_cache_lookup": """
WITH e AS (SELECT vec_id AS key, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 > 0 AND vec_id % 100 > 30 AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, key, round(list_cosine_similarity(q.embedding::DOUBLE[], e), 6) AS sim FROM embeddings q, e WHERE q.vec_id % 50 = 0 AND q.embedding IS NOT NULL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, key) = 1)
SELECT vec_id AS query_id, coalesce(sim >= 0.35, false) AS hit, CASE WHEN sim >= 0.35 THEN key END AS key, CASE WHEN sim >= 0.35 THEN round(sim, 4) END AS similarity FROM embeddings LEFT JOIN b ON b.query_id = vec_id WHERE vec_id % 50 = 0""",
    "ca2_cache_put": """
WITH n AS (SELECT substr(sha256(text), 1, 16) AS key, 'new' AS answer, epoch_us(TIMESTAMP '2024-01-01') + (20 + item_id % 3) * 60000000 AS t, 1 AS w FROM benchmark
  UNION ALL SELECT substr(sha256(text), 1, 16), (item_id % 7)::VARCHAR, epoch_us(TIMESTAMP '2024-01-01') + item_id * 60000000, 0 FROM benchmark WHERE item_id % 2 = 0)
SELECT key, answer, t AS cached_us FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC, w DESC) = 1""",
    "ca3_live_entries": "SELECT vec_id AS key FROM embeddings WHERE vec_id % 50 > 0 AND vec_id % 100 > 30",
    "st3_stream_rollup": _with(_SPANS) + """
, l AS (SELECT trace_id, max(st) AS last FROM spn GROUP BY trace_id)
SELECT trace_id, name, status, start_time, end_time, total_tokens, total_cost_usd, span_count FROM trc JOIN l USING (trace_id)
WHERE last + 300000000 <= (SELECT max(st) FROM spn) - 60000000""",
    "st4_stream_latency": """
WITH q AS (SELECT ts::DATE AS day, value * 10 AS lat, ts FROM events)
SELECT day, count(*) AS n, round(sum(lat), 4) AS latency_sum, quantile_disc(lat, 0.5) AS p50, quantile_disc(lat, 0.95) AS p95, quantile_disc(lat, 0.99) AS p99
FROM q GROUP BY day HAVING day + INTERVAL 1 DAY <= (SELECT max(ts) FROM q) - INTERVAL 1 HOUR""",
    "ud1_sql_functions": _with(_QA, f"src AS (SELECT query_id AS conv_id, 0 AS turn, answer AS t FROM qa)", _SCORED, f"nt AS (SELECT query_id, {sql_norm('question')} AS x, {sql_norm('answer')} AS y, {_SET.format('question')} AS a, {_SET.format('answer')} AS b, answer FROM qa)") + f"""
SELECT query_id, {_jaccard('a', 'b')}::DOUBLE AS jaccard, {sql_f1('x', 'y')} AS f1, greatest(1, length(answer) // 4)::INTEGER AS n_tokens, {sql_redact('answer')} = answer AS clean, confidence FROM nt JOIN con ON conv_id = query_id""",
    "st1_rate_limit_stream": """
WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events WHERE event_type IN ('purchase', 'signup')),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, s // 86400 ORDER BY ts, event_id) AS k FROM e)
SELECT event_id AS request_id, k <= 2 AS allowed, CASE WHEN k > 2 THEN 86400 - s % 86400 END AS retry_after FROM n""",
    "st2_redact_stream": f"""
WITH t AS (SELECT conv_id || '/' || turn AS answer_id, text || ' Mail jane.doe@example.org, call +44 7700 900123.' AS text FROM conversations WHERE text IS NOT NULL)
SELECT answer_id, md5({sql_redact('text')}) AS text_md5, true AS finished FROM t""",
    "ud2_registered_model": "SELECT item_id AS query_id, 16 AS dim FROM benchmark",
    "ig8_embed": rf"SELECT item_id AS query_id, 32 AS dim, CASE WHEN regexp_matches(text, '\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM benchmark",
    "st1_rate_limit": """
WITH e AS (SELECT *, event_type IN ('purchase', 'signup') AS w, epoch(ts)::BIGINT AS s0, floor(epoch(ts))::BIGINT AS s FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, s // 86400 ORDER BY ts, event_id) AS k FROM e)
SELECT event_id AS request_id, NOT (w AND k > 2) AS allowed, CASE WHEN w AND k > 2 THEN 86400 - s % 86400 END AS retry_after FROM n""",
}
