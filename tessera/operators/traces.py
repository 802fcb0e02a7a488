"""Traces, cost, analytics and the semantic cache."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dense import knn
from tessera.operators.quantiles import quantiles
from tessera.sources.scratch import kept

# USD per million input and output tokens, in the order prefixes are tried.
PRICING = [
    ("llama3.1:8b", 0.0, 0.0),
    ("llama3.1", 0.0, 0.0),
    ("qwen3", 0.0, 0.0),
    ("nomic-embed-text", 0.0, 0.0),
    ("bge-m3", 0.0, 0.0),
    ("ollama", 0.0, 0.0),
    ("gemini-1.5-flash", 0.075, 0.30),
    ("gemini-1.5-pro", 1.25, 5.00),
    ("text-embedding-004", 0.0125, 0.0),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("text-embedding-3-small", 0.02, 0.0),
]


def sample_traces(spans: DataFrame, rate: float) -> DataFrame:
    """TR1: traces whose 128-bit id mod 10000 falls below rate; whole traces stay or go."""
    if rate >= 1:
        return spans
    if rate <= 0:
        return spans.limit(0)
    half = lambda at: F.conv(F.substring("trace_id", at, 16), 16, 10).cast("decimal(20,0)")
    # 2**64 mod 10000 = 1616
    bucket = ((half(1) % 10000) * 1616 + half(17) % 10000) % 10000
    return spans.where(bucket.cast("int") / 10000 < rate)


def rates_col(model, pricing=PRICING):
    """(input, output) rate: the exact model, else the first prefix in order, else 0."""
    key = F.lower(F.trim(model))
    rate = lambda i, o: F.struct(F.lit(float(i)).alias("input"), F.lit(float(o)).alias("output"))
    exact = reduce(lambda acc, p: acc.when(key == p[0], rate(*p[1:])), pricing, F.when(F.coalesce(key, F.lit("")) == "", rate(0, 0)))
    return reduce(lambda acc, p: acc.when(F.startswith(key, F.lit(p[0])), rate(*p[1:])), pricing, exact).otherwise(rate(0, 0))


def cost(df: DataFrame, pricing=PRICING) -> DataFrame:
    """TR3: df (model, input_tokens, output_tokens) with cost_usd, rounded to 8 places, and free_model."""
    r = rates_col(F.col("model"), pricing)
    usd = F.coalesce("input_tokens", F.lit(0)) / 1e6 * r["input"] + F.coalesce("output_tokens", F.lit(0)) / 1e6 * r["output"]
    return df.withColumn("cost_usd", F.round(usd, 8)).withColumn("free_model", (r["input"] == 0) & (r["output"] == 0))


def normalize_spans(raw: DataFrame) -> DataFrame:
    """TR2: raw spans (trace_id, span_id, parent_span_id, name, start_ns, end_ns, status, attributes) in the spans schema."""
    attr = lambda k: F.try_element_at("attributes", F.lit(k))
    number = lambda k: attr(k).try_cast("long")
    inp, out = number("llm.token_count.prompt"), number("llm.token_count.completion")
    both = F.when(inp.isNotNull() | out.isNotNull(), F.coalesce(inp, F.lit(0)) + F.coalesce(out, F.lit(0)))
    rows = raw.withColumn("attributes", F.map_filter("attributes", lambda k, v: v.isNotNull()))
    priced = cost(rows.withColumns({"model": attr("llm.model_name"), "input_tokens": inp, "output_tokens": out}))
    known = F.when(both.isNotNull() & attr("llm.model_name").isNotNull(), F.col("cost_usd"))
    return priced.select(
        "trace_id", "span_id", "parent_span_id", "name", F.coalesce(attr("openinference.span.kind"), F.lit("CHAIN")).alias("kind"),
        F.when(F.upper("status") == "ERROR", "error").otherwise("ok").alias("status"),
        F.timestamp_micros(F.expr("start_ns div 1000")).alias("start_time"), F.timestamp_micros(F.expr("end_ns div 1000")).alias("end_time"),
        F.round((F.col("end_ns") - F.col("start_ns")) / 1e6, 3).alias("duration_ms"),
        F.coalesce(number("llm.token_count.total"), both).alias("tokens"), F.coalesce(attr("llm.cost_usd").try_cast("double"), known).alias("cost_usd"), "attributes",
    )


def rollup(spans: DataFrame) -> DataFrame:
    """TR4: one row per trace; sums of 0 are null."""
    first = F.min_by("name", F.struct(F.col("parent_span_id").isNotNull(), "start_time", "span_id"))
    none = F.lit(0)
    return spans.groupBy("trace_id").agg(
        first.alias("name"), F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.round((F.unix_micros(F.max("end_time")) - F.unix_micros(F.min("start_time"))) / 1000, 3).alias("latency_ms"),
        F.nullif(F.sum("tokens"), none).alias("total_tokens"), F.nullif(F.round(F.sum("cost_usd"), 8), F.lit(0.0)).alias("total_cost_usd"), F.count(F.lit(1)).alias("span_count"),
    )


def list_traces(traces: DataFrame, min_ms: float | None = None, max_ms: float | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """TR5: newest first."""
    if min_ms is not None:
        traces = traces.where(F.col("latency_ms") >= min_ms)
    if max_ms is not None:
        traces = traces.where(F.col("latency_ms") <= max_ms)
    if status is not None:
        traces = traces.where(F.col("status") == status)
    return traces.orderBy(F.desc("start_time"), "trace_id").limit(limit)


def get_trace(traces: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """TR6: the trace's spans by start, found by row id or hex id. traces: (id, trace_id, ...)."""
    found = traces.where((F.col("id") == key) | (F.col("trace_id") == key)).select("trace_id")
    return spans.join(F.broadcast(found.limit(1)), "trace_id", "left_semi").orderBy("start_time", "span_id")


#: Spans of a trace that one row may hold; larger traces are walked as linked lists.
SMALL = 1000


def _walk(ids: list, parents: list, copies: list[int]) -> list[tuple[int, int]]:
    """(place, depth) of the spans of one trace, depth first; they come in the order of siblings."""
    first = {s: i for i, (s, c) in enumerate(zip(ids, copies)) if c == 1 and s is not None}
    ups = [None if p is None else first.get(p) for p in parents]
    below: dict[int | None, list[int]] = {}
    for i in range(len(ids) - 1, -1, -1):
        below.setdefault(ups[i], []).append(i)
    out, stack = [], [(i, 0) for i in below.get(None, ())]
    while stack:
        i, depth = stack.pop()
        up = ups[i] if copies[i] > 1 else None
        while up is not None and up != first.get(ids[i]):
            up = ups[up]
        if up is None:
            out.append((i, depth))
        stack += [(j, depth + 1) for j in below.get(i, ())]
    return out


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        edges, flat = b.column(1).offsets.to_numpy(), b.column(1).values
        ids, parents, copies = (flat.field(c).to_pylist() for c in ("span_id", "parent_span_id", "_copy"))
        rows, at, ords, depths = [], [], [], []
        for row, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
            found = _walk(ids[s:e], parents[s:e], copies[s:e])
            rows += [row] * len(found)
            at += [s + i for i, _ in found]
            ords += range(1, len(found) + 1)
            depths += [d for _, d in found]
        at = pa.array(at, pa.int32())
        cols = [b.column(0).take(pa.array(rows, pa.int32())), pa.array(ords, pa.int32()), flat.field("span_id").take(at), pa.array(depths, pa.int32())]
        yield pa.RecordBatch.from_arrays([*cols, *[flat.field(c).take(at) for c in _SHARES]], names=["trace_id", "ord", "span_id", "depth", *_SHARES])


_SHARES = ("offset_pct", "width_pct")


def waterfall(spans: DataFrame) -> DataFrame:
    """TR7: (trace_id, ord, span_id, depth, offset_pct, width_pct): depth first, siblings by start; orphans are roots.

    A trace of up to SMALL spans is walked in its own row. In larger ones, every span opens and closes once on a walk through its trace, which is a linked
    list: an opening leads to the first child's or to its own close, a close to the
    next sibling's opening or to the parent's close. Sums from each step to the end of
    the list, found by doubling pointers, give place (openings) and depth (openings
    less closes): as many rounds as the longest walk has binary digits, whatever the
    depth. Children hang on the first of spans with equal ids, a repeat below that one
    is left out, and spans that no root leads to (parents in a circle) have no place.
    """
    own = Window.partitionBy("trace_id")
    t0, t1 = F.min(F.unix_micros("start_time")).over(own), F.max(F.unix_micros("end_time")).over(own)
    total = F.greatest((t1 - t0) / 1000, F.lit(1.0))
    offset = (F.unix_micros("start_time") - t0) / 1000 / total * 100
    width = F.greatest((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000 / total * 100, F.lit(0.5))
    copy = F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy("start_time", "end_time", "parent_span_id"))
    flat = spans.select(
        "trace_id", "span_id", "parent_span_id", "start_time", F.round(offset, 4).alias("offset_pct"), F.round(width, 4).alias("width_pct"),
        copy.alias("_copy"), F.count(F.lit(1)).over(own).alias("_spans"), F.monotonically_increasing_id().alias("node"),
    )
    flat = kept(flat, "waterfall")
    kind = {f.name: f.dataType.simpleString() for f in flat.schema}
    # sorted like siblings: by start, id and node
    group = F.array_sort(F.collect_list(F.struct("start_time", "span_id", "node", "parent_span_id", "_copy", *_SHARES))).alias("spans")
    schema = f"trace_id {kind['trace_id']}, ord int, span_id {kind['span_id']}, depth int, offset_pct double, width_pct double"
    small = flat.where(F.col("_spans") <= SMALL).groupBy("trace_id").agg(group).mapInArrow(_walked, schema)
    flat = flat.where(F.col("_spans") > SMALL)
    if flat.isEmpty():
        return small
    first = flat.where("_copy = 1").select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("node").alias("up"))
    tree = flat.join(first, ["trace_id", "parent_span_id"], "left")
    # siblings in order, the roots of a trace among themselves; up stays null for roots
    order = Window.partitionBy("trace_id", "up").orderBy("start_time", "span_id", "node")
    tree = kept(tree.select("trace_id", "node", "up", "_spans", F.lead("node").over(order).alias("after"), (F.row_number().over(order) == 1).alias("eldest")), "waterfall-tree")
    child = tree.where("eldest and up is not null").select(F.col("up").alias("node"), F.col("node").alias("child"))
    opens, closes = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    opened = tree.join(child, "node", "left").select(opens("node").alias("step"), F.coalesce(opens("child"), closes("node")).alias("next"), F.lit(1).alias("n"), F.lit(1).alias("d"))
    closed = tree.select(closes("node").alias("step"), F.coalesce(opens("after"), closes("up")).alias("next"), F.lit(0).alias("n"), F.lit(-1).alias("d"))
    walk = kept(opened.unionByName(closed), "waterfall-walk")
    longest = tree.agg(F.max("_spans")).first()[0] or 0
    for _ in range((2 * longest).bit_length()):
        on = walk.select(F.col("step").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"), F.col("d").alias("_d"))
        # a pointer past the end stays null; steps that came to the end are not joined again
        going = walk.where("next is not null").join(on, "next").select("step", F.col("_next").alias("next"), (F.col("n") + F.col("_n")).alias("n"), (F.col("d") + F.col("_d")).alias("d"))
        walk = kept(walk.where("next is null").unionByName(going), "waterfall-walk")
    ended = walk.where("next is null").select(F.expr("step div 2").alias("node"), (F.col("step") % 2 == 0).alias("_open"), "n", (-F.col("d")).alias("depth"))
    opened = ended.where("_open").drop("_open")
    # a repeat of an id below the span of that id ends the walk there
    repeats = flat.where("_copy > 1").select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("node").alias("again")).join(first, ["trace_id", "parent_span_id"])
    at = lambda df, key, n: df.select(F.col("node").alias(key), F.col("n").alias(n))
    repeats = repeats.join(at(opened, "again", "_n"), "again").join(at(opened, "up", "_from"), "up").join(at(ended.where("NOT _open"), "up", "_to"), "up")
    placed = flat.join(opened, "node").join(repeats.where("_n < _from and _n > _to").select(F.col("again").alias("node")), "node", "left_anti")
    place = F.row_number().over(own.orderBy(F.desc("n")))
    return small.unionByName(placed.select("trace_id", place.alias("ord"), "span_id", "depth", "offset_pct", "width_pct"))


def resolve_feedback(feedback: DataFrame, traces: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TR9: (resolved, rejected). A reference names a query, else a trace's hex id, else a trace's row id.

    feedback: (feedback_id, ref, rating, correction, created_at); traces: (id, trace_id); queries: (query_id, trace_id).
    """
    q = queries.select(F.col("query_id").alias("ref"), F.col("query_id").alias("_q0"))
    by_trace = queries.select("trace_id", F.col("query_id").alias("_q")).groupBy("trace_id").agg(F.min("_q").alias("_q"))
    hexed = by_trace.select(F.col("trace_id").alias("ref"), F.col("_q").alias("_q1"))
    rowed = traces.join(by_trace, "trace_id").select(F.col("id").alias("ref"), F.col("_q").alias("_q2"))
    rows = feedback.join(q, "ref", "left").join(hexed, "ref", "left").join(rowed, "ref", "left")
    rows = rows.withColumn("query_id", F.coalesce("_q0", "_q1", "_q2")).drop("_q0", "_q1", "_q2")
    return rows.where("query_id is not null"), rows.where("query_id is null").drop("query_id")


def list_feedback(feedback: DataFrame, limit: int = 200) -> DataFrame:
    """TR10: newest first."""
    return feedback.orderBy(F.desc("created_at"), "feedback_id").limit(limit)


# ── analytics over (created_at, latency_ms, total_tokens, total_cost_usd, model) ──


def _since(queries: DataFrame, days: int, now: str) -> DataFrame:
    end = F.lit(now).cast("timestamp")
    return queries.where((F.col("created_at") >= end - F.make_dt_interval(F.lit(days))) & (F.col("created_at") <= end)).withColumn("day", F.to_date("created_at"))


def latency(queries: DataFrame, days: int, now: str) -> DataFrame:
    """AN1: linear p50, p95, p99 and count per UTC day and, with a null day, overall. Exact, and no group's values meet in one task."""
    rows = _since(queries, days, now).where("latency_ms is not null").select("latency_ms", F.explode(F.array(F.struct(F.lit(False).alias("whole"), "day"), F.struct(F.lit(True).alias("whole"), F.lit(None).cast("date").alias("day")))).alias("part"))
    out = quantiles(rows.select("part.whole", "part.day", "latency_ms"), ["whole", "day"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.select("day", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")], "n")


def latency_sketch(queries: DataFrame, days: int, now: str, accuracy: int = 10_000) -> DataFrame:
    """AN1 for tables too large for exact percentiles: bounded state per group."""
    p = F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], accuracy)
    out = _since(queries, days, now).where("latency_ms is not null").rollup("day").agg(p.alias("p"), F.count(F.lit(1)).alias("n"))
    return out.select("day", *[F.col("p")[i].alias(c) for i, c in enumerate(("p50", "p95", "p99"))], "n")


def cost_report(queries: DataFrame, days: int, now: str) -> DataFrame:
    """AN2: (part, model, day, cost, tokens, n, average): total, by model and by day in one pass."""
    rows = _since(queries, days, now).withColumn("model", F.coalesce("model", F.lit("unknown")))
    part = F.when(F.grouping("model") == 0, "model").when(F.grouping("day") == 0, "day").otherwise("total")
    out = rows.groupingSets([[], ["model"], ["day"]], "model", "day").agg(
        part.alias("part"), F.round(F.sum("total_cost_usd"), 6).alias("cost"), F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.round(F.avg("total_cost_usd"), 8).alias("average")
    )
    return out.select("part", "model", "day", "cost", "tokens", "n", "average")


def cache_report(lookups: DataFrame, queries: DataFrame, days: int, now: str) -> DataFrame:
    """AN3: hits, misses, rate, and savings as hits times the mean non-zero cost. lookups: (hit)."""
    mean = _since(queries, days, now).where("total_cost_usd > 0").agg(F.coalesce(F.avg("total_cost_usd"), F.lit(0.0)).alias("mean"))
    seen = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    out = seen.crossJoin(mean)  # one row each
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0)
    return out.select("hits", "misses", F.round(rate, 4).alias("hit_rate"), F.round(F.col("hits") * F.col("mean"), 6).alias("savings_usd"))


def throughput(queries: DataFrame, days: int, now: str) -> DataFrame:
    """AN4: (day, n, qps) and, with a null day, the peak day's qps and the window's average."""
    per = _since(queries, days, now).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.coalesce(F.max("n"), F.lit(0)) / 86400, 6).alias("peak_qps"))
    average = F.round(F.col("n") / F.greatest(F.lit(1), F.lit(days * 86400)), 6)
    days_ = per.select("day", "n", F.round(F.col("n") / 86400, 6).alias("qps"), F.lit(None).cast("double").alias("peak_qps"))
    return days_.unionByName(whole.select(F.lit(None).cast("date").alias("day"), "n", average.alias("qps"), "peak_qps"))


# ── semantic cache: entries (key, query, answer, embedding, cached_at) ──────

CACHE_THRESHOLD, CACHE_TTL = 0.92, 3600


def live_entries(entries: DataFrame, now: str, ttl: int = CACHE_TTL) -> DataFrame:
    """CA3: entries not older than ttl seconds. Filtering comes before search, so a live second best can hit."""
    return entries.where(F.col("cached_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(ttl))))


def cache_lookup(queries: DataFrame, entries: DataFrame, now: str, threshold: float = CACHE_THRESHOLD, ttl: int = CACHE_TTL) -> DataFrame:
    """CA1: (query_id, hit, key, similarity) of every query (query_id, embedding) against the live entries."""
    best = knn(queries, live_entries(entries, now, ttl).select(F.col("key").alias("chunk_id"), "embedding"), 1)
    out = queries.select("query_id").join(best, "query_id", "left")
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select("query_id", hit.alias("hit"), F.when(hit, F.col("chunk_id")).alias("key"), F.when(hit, F.round("score", 4)).alias("similarity"))


def cache_key_col(query):
    return F.substring(F.sha2(query, 256), 1, 16)


def cache_put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """CA2: entries with new ones (query, answer, embedding, cached_at) under their keys, the latest of each kept."""
    keyed = new.withColumn("key", cache_key_col(F.col("query"))).select(*entries.columns)
    own = Window.partitionBy("key").orderBy(F.desc("cached_at"), F.desc("_new"))
    both = entries.withColumn("_new", F.lit(0)).unionByName(keyed.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n", "_new")


def cache_clear(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CA2: the emptied table and the count of what it held."""
    return entries.limit(0), entries.agg(F.count(F.lit(1)).alias("cleared"))
