"""Files in and out, and streams against their batch twins."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest, traces
from tessera.sources import io
from tessera.streaming import streams


def drained(df, path):
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def stream_of(df, path, parts):
    """df as a stream of files, one per trigger, in the order of parts."""
    for p in parts:
        df.where(p).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_golden_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q1", "answer_facts": [["x", "y"]]}\n\n{"question": \n{"gold_answer": "no question"}\n{"question": "q2", "metadata": {"hops": 2}}\n')
    (tmp_path / "b.jsonl").write_text("\n")
    good, bad = io.read_golden(spark, str(tmp_path))
    assert [(r.line, r.question) for r in good.orderBy("line").collect()] == [(1, "q1"), (5, "q2")]
    assert sorted((r.file[-7:], r.line, r.reason) for r in bad.collect()) == [("a.jsonl", 3, "invalid JSON"), ("a.jsonl", 4, "missing question"), ("b.jsonl", 0, "no samples")]


def test_intake(spark, tmp_path):
    for name, size in (("a.txt", 10), ("b.PDF", 3_000_000), ("c.exe", 5), ("d.md", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r.path[-5:]: r.reason for r in io.intake(spark, f"{tmp_path}/*", 2).collect()}
    assert got == {"a.txt": None, "b.PDF": "too large", "c.exe": "unsupported type", "/d.md": "empty file"}


def test_zero_vectors_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    with pytest.raises(ValueError):
        io.write_chunks(df, f"{tmp_path}/c")
    assert io.write_chunks(df.where("chunk_id = 1"), f"{tmp_path}/c") == 1


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", "ndcg", i, i / 4) for i in range(5)], "mode string, metric string, pos long, value double")
    io.write_results(df, f"{tmp_path}/r")
    got = spark.read.json(f"{tmp_path}/r").first()
    assert got.n == 5 and got.metrics.ndcg == [0, 0.25, 0.5, 0.75, 1.0]
    (tmp_path / "f.json").write_text('{"m": {"ndcg": [0.5, 1.0]}}')
    assert [tuple(r) for r in io.read_results(spark, f"{tmp_path}/f.json").orderBy("pos").collect()] == [("m", "ndcg", 0, 0.5), ("m", "ndcg", 1, 1.0)]


RESULTS = {
    "bm25, \"fast\" {a": {
        "n": 3, "latency_ms_p50": 1.5, "note": "x, [1, 2], {", "ndcg": {"mean": 0.5, "ci": [0.1, 0.9]},
        "per_query": {"ndcg": [0.5 + i / 8192 for i in range(700)], "none": [], "a,b:[7,8": [1, None, -2.5e-3], "one": [4]},
    },
    "empty": {},
    "plain": {"hits": [1.0, 0.0], "é\\\\,": [3]},
}


@pytest.mark.parametrize("split, indent", [("128m", None), ("97", None), ("61", 2)])
def test_result_files_are_read_in_parts(spark, tmp_path, split, indent):
    import json

    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps(RESULTS, indent=indent, ensure_ascii=name == "a"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = [tuple(r) for r in io.read_results(spark, f"{tmp_path}/*.json").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = []
    for mode, body in RESULTS.items():
        arrays = body.get("per_query", {k: v for k, v in body.items() if isinstance(v, list)})
        want += [(mode, m, i, v) for m, values in arrays.items() for i, v in enumerate(values)]
    assert sorted(got, key=repr) == sorted([(a, b, c, None if v is None else float(v)) for a, b, c, v in want] * 2, key=repr)


def test_written_result_files_are_json(spark, tmp_path):
    import json

    data = [(m, k, i, None if i == 1 else i / 4) for m in ('a "x", {', "b") for k in ("hit", "rr") for i in range(3)]
    df = spark.createDataFrame(data, "mode string, metric string, pos long, value double")
    io.write_result_files(df.repartition(3), f"{tmp_path}/r")
    files = [json.loads(f.read_text()) for f in (tmp_path / "r").glob("*/part-*.txt")]
    assert sorted(k for f in files for k in f) == ['a "x", {', "b"]
    assert all(body == {"n": 3, "per_query": {"hit": [0.0, None, 0.5], "rr": [0.0, None, 0.5]}} for f in files for body in f.values())
    assert sorted(map(tuple, io.read_results(spark, f"{tmp_path}/r/*").collect()), key=repr) == sorted(data, key=repr)


def test_rate_limit_stream_matches_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(seconds=7 * i), f"c{i % 3}", "s", "POST" if i % 5 else "GET") for i in range(90)]
    df = spark.createDataFrame(data, "request_id long, ts timestamp, client string, scope string, method string")
    batch = {(r.request_id, r.allowed, r.retry_after) for r in streams.rate_limit(df, 2, 60).where("method = 'POST'").collect()}
    out = drained(streams.rate_limit_stream(stream_of(df, tmp_path, ["request_id < 40", "request_id >= 40"]), 2, 60), tmp_path)
    assert {(r.request_id, r.allowed, r.retry_after) for r in out.collect()} == batch
    assert any(not a for _, a, _ in batch)


TEXT = "Hello there, write to john.smith@example.com or +44 7700 900123 today. " * 3 + "Bye."


@pytest.mark.parametrize("size", [1, 4, 50])
def test_redacted_stream_never_shows_a_part(spark, tmp_path, size):
    """Also one character per token, tokens out of order, and a match that crosses the release boundary."""
    tokens = [TEXT[i : i + size] for i in range(0, len(TEXT), size)]
    data = [("a", i, t, i == len(tokens) - 1, random.Random(i).randrange(3)) for i, t in enumerate(tokens)]
    df = spark.createDataFrame(data, "answer_id string, seq long, token string, done boolean, part int")
    out = drained(streams.redact_stream(stream_of(df, tmp_path, ["part = 1", "part = 0", "part = 2"]), 48), tmp_path).collect()
    assert "".join(r.text for r in sorted(out, key=lambda r: r.upto_seq)) == streams.redact(TEXT)


def test_cut_stays_before_a_crossing_match():
    raw = "x" * 30 + " bob@example.org " + "y" * 40
    for n in range(1, len(raw) + 1):
        cut = streams.safe_cut(raw[:n], 0, 10)
        assert not any(m.start() < cut < m.end() for p, _ in streams._PATTERNS for m in p.finditer(raw[:n]))


def test_stream_rollup_matches_batch_and_restarts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(f"t{i // 4}", f"s{i}", None if i % 4 == 0 else f"s{i - i % 4}", f"n{i}", "error" if i % 9 == 0 else "ok", t0 + dt.timedelta(minutes=30 * (i // 4), seconds=i % 4), t0 + dt.timedelta(minutes=30 * (i // 4), seconds=5), 3, 0.5) for i in range(48)]
    df = spark.createDataFrame(data, "trace_id string, span_id string, parent_span_id string, name string, status string, start_time timestamp, end_time timestamp, tokens long, cost_usd double")
    src = stream_of(df, tmp_path, ["trace_id in ('t0','t1','t2','t3','t4','t5')"])
    drained(streams.stream_rollup(src), tmp_path)
    df.where("trace_id not in ('t0','t1','t2','t3','t4','t5')").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late = df.limit(1).withColumn("span_id", F.lit("late"))
    late.write.mode("append").parquet(f"{tmp_path}/in")
    out = drained(streams.stream_rollup(src), tmp_path).collect()
    cols = ["trace_id", "name", "status", "total_tokens", "span_count"]
    batch = {tuple(r) for r in traces.rollup(df).select(*cols).collect()}
    got = {tuple(r[c] for c in cols) for r in out}
    assert got <= batch and len(got) >= 11  # the last trace is still open


def test_stream_cache_uses_earlier_batches_only(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, "a", [1.0, 0.0], t0), (2, "b", [0.0, 1.0], t0), (3, "a", [1.0, 0.0], t0 + dt.timedelta(minutes=1)), (4, "a", [1.0, 0.0], t0 + dt.timedelta(hours=3))]
    df = spark.createDataFrame(data, "query_id long, query string, embedding array<float>, ts timestamp")
    src = stream_of(df, tmp_path, ["query_id <= 2", "query_id = 3", "query_id = 4"])
    q = streams.stream_cache(src, f"{tmp_path}/entries", f"{tmp_path}/hits", f"{tmp_path}/cp", lambda d: d.withColumn("answer", F.lit("x")), 0.9)
    q.awaitTermination()
    got = {r.query_id: r.hit for r in spark.read.parquet(f"{tmp_path}/hits").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}
    slots = lambda: {r.slot for r in spark.read.parquet(f"{tmp_path}/entries").select("slot").distinct().collect()}
    assert len(slots()) == 2  # what the last batch reads does not grow with what expired before
    assert streams.vacuum_cache(spark, f"{tmp_path}/entries", "2024-01-01 03:00:00") == 1 and len(slots()) == 1


def test_stream_cache_with_late_and_empty_batches(spark, tmp_path):
    """A first batch without times, and one that comes late: entries of its own time still hit."""
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, "a", [1.0, 0.0], None), (2, "a", [1.0, 0.0], t0), (3, "a", [1.0, 0.0], t0 + dt.timedelta(hours=5)), (4, "a", [1.0, 0.0], t0 + dt.timedelta(minutes=9))]
    df = spark.createDataFrame(data, "query_id long, query string, embedding array<float>, ts timestamp")
    src = stream_of(df, tmp_path, ["query_id = 1", "query_id = 2", "query_id = 3", "query_id = 4"])
    streams.stream_cache(src, f"{tmp_path}/entries", f"{tmp_path}/hits", f"{tmp_path}/cp", lambda d: d.withColumn("answer", F.lit("x")), 0.9).awaitTermination()
    assert {r.query_id: r.hit for r in spark.read.parquet(f"{tmp_path}/hits").collect()} == {2: False, 3: False, 4: True}


def test_ingest_stream_is_exactly_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words in a text. " * 60), (2, "tiny"), (3, "another text with words. " * 30)], "doc_id long, content string")
    for ids in ("doc_id <= 2", "doc_id = 3"):
        src = stream_of(df, tmp_path, [ids])
        streams.stream_ingest(src, f"{tmp_path}/chunks", f"{tmp_path}/status", f"{tmp_path}/cp", ingest.hashing_embedder(8), 8).awaitTermination()
    status = {r.doc_id: (r.status, r.chunk_count) for r in spark.read.parquet(f"{tmp_path}/status").collect()}
    want = {r.doc_id: r["count"] for r in ingest.chunk_recursive(df.withColumn("ordinal", F.lit(0))).groupBy("doc_id").count().collect()}
    assert status == {1: ("completed", want[1]), 2: ("failed", 0), 3: ("completed", want[3])}


def test_latency_of_days_is_exact(spark, tmp_path):
    """More values a day than a sketch keeps, some of them null; the last day is still open."""
    t0 = dt.datetime(2024, 1, 1)
    day = (F.col("id") % 2).cast("int")
    df = spark.range(60_000).select((F.lit(t0) + F.make_dt_interval(day * 2)).alias("created_at"), F.when(F.col("id") % 1000 > 1, F.pmod(F.col("id") * 7919, F.lit(60_013)).cast("double")).alias("latency_ms"))
    (got,) = streams.latency_of_days(drained(streams.stream_latency(stream_of(df, tmp_path, ["true"])), tmp_path)).collect()
    values = sorted(float(i * 7919 % 60_013) for i in range(0, 60_000, 2) if i % 1000 > 1)
    assert (got.day, got.n, got.latency_sum) == (t0.date(), 30_000, sum(values))
    assert [got.p50, got.p95, got.p99] == [values[-(-len(values) * p // 100) - 1] for p in (50, 95, 99)]


def test_a_slice_of_a_feed_is_many_files(spark):
    import uuid
    from glob import glob

    from tessera.queries.platform import _as_stream
    from tessera.sources.scratch import shared_dir

    tag = f"feed{uuid.uuid4().hex}"  # the scratch folder may hold earlier feeds
    feed = _as_stream(spark, spark.range(0, 200_000, 1, 4).select("id", F.lit("x").alias("text")), tag, "id")
    seen = []
    q = feed.writeStream.foreachBatch(lambda b, n: seen.append((*b.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first(),))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 4 and sum(n for *_, n in seen) == 200_000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    assert len(glob(f"{shared_dir(spark)}/{tag}-[0-9a-f]*/*.parquet")) == 16


def test_rate_limit_stream_orders_a_large_window(spark, tmp_path):
    """More requests of one client in one window than an Arrow batch holds, latest first, beside a client without a name."""
    t0 = dt.datetime(2024, 1, 1)
    n = 25_000
    at = F.lit(t0) + F.make_dt_interval(secs=(F.lit(n) - F.col("id")).cast("decimal(18,6)"))
    df = spark.range(n).select(F.col("id").alias("request_id"), at.alias("ts"), F.when(F.col("id") % 2 == 0, "c").alias("client"), F.lit("s").alias("scope"), F.lit("POST").alias("method")).coalesce(1)
    batch = {(r.request_id, r.allowed, r.retry_after) for r in streams.rate_limit(df, 5, 86_400).select("request_id", "allowed", "retry_after").collect()}
    out = drained(streams.rate_limit_stream(stream_of(df, tmp_path, ["true"]), 5, 86_400, lanes=2), tmp_path)
    assert {(r.request_id, r.allowed, r.retry_after) for r in out.collect()} == batch


def test_redacted_stream_keeps_the_answers_of_a_lane_apart(spark, tmp_path):
    """Many answers share a lane's state, their tokens out of order over three batches; one of them never ends."""
    texts = {f"a{k}": f"Call +44 7700 90012{k} or write to p{k}@example.org. " * (k + 1) for k in range(9)}
    data = [(a, i // 5, t[i : i + 5], i + 5 >= len(t) and a != "a8", random.Random(f"{a}{i}").randrange(3)) for a, t in texts.items() for i in range(0, len(t), 5)]
    df = spark.createDataFrame(data, "answer_id string, seq long, token string, done boolean, part int")
    out = drained(streams.redact_stream(stream_of(df, tmp_path, ["part = 1", "part = 0", "part = 2"]), 48, lanes=2), tmp_path).collect()
    got = {a: "".join(r.text for r in sorted(out, key=lambda r: r.upto_seq) if r.answer_id == a) for a in texts}
    assert all(got[a] == streams.redact(t) for a, t in texts.items() if a != "a8") and streams.redact(texts["a8"]).startswith(got["a8"])
    assert {r.answer_id for r in out if r.finished} == set(texts) - {"a8"}


def test_scratch_tables_can_be_released(spark):
    from tessera.sources.scratch import kept, release

    df = kept(spark.range(3).toDF("x"), "t")
    path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert df.count() == 3 and __import__("os").path.exists(path)
    release(spark)
    assert not __import__("os").path.exists(path)


def test_a_feed_of_some_thousand_texts_is_no_single_task(spark):
    from tessera.queries.platform import ONE_PART, _as_stream
    from tessera.sources.scratch import shared_dir

    tag = f"few-{uuid.uuid4().hex}"
    feed = _as_stream(spark, spark.range(0, ONE_PART, 1, 4).select("id", F.lit("x").alias("text")), tag, "id")
    at = next(p for p in os.listdir(shared_dir(spark)) if p.startswith(tag) and not p.startswith(f"{tag}-rows"))
    files = [spark.read.parquet(f"{shared_dir(spark)}/{at}/{f}").count() for f in os.listdir(f"{shared_dir(spark)}/{at}") if f.endswith(".parquet")]
    assert feed.isStreaming and sum(files) == ONE_PART and len(files) >= 8 and max(files) < ONE_PART / 4
