"""Eval runs, experiments, gates and reports. All randomness comes from MD5, so any SQL engine can repeat it."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantiles import quantiles

ITERATIONS, CONFIDENCE, SEED = 1000, 0.95, 42
CI_ITERATIONS = 2000
# Metrics for which less is better, and the default gate.
LOWER_IS_BETTER = ("hallucination_score", "hallucination_rate")
GATE = {"faithfulness": 0.80, "answer_relevance": 0.70, "context_precision": 0.60}


def aggregate_run(samples: DataFrame) -> DataFrame:
    """EX1: (run_id, metric, mean, n): over samples without error, over the union of their metrics."""
    rows = samples.where("error is null").select("run_id", F.explode("metrics").alias("metric", "value"))
    return rows.groupBy("run_id", "metric").agg(F.bround(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"))


def run_counts(samples: DataFrame) -> DataFrame:
    """EX1: (run_id, total, passed, failed)."""
    return samples.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("passed"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def pair(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """EX2: (metric, sample_index, a, b) of metrics both runs have for a sample. Runs: (sample_index, metrics)."""
    long = lambda df, name: df.select("sample_index", F.explode("metrics").alias("metric", name)).where(f"{name} is not null")
    return long(run_a, "a").join(long(run_b, "b"), ["metric", "sample_index"]).select("metric", "sample_index", "a", "b")


#: Poisson(1) from 16 hashed bits, in hex: one more for each bound that they reach.
POISSON = [f"{round(65536 * sum(exp(-1) / factorial(k) for k in range(m + 1))):04x}" for m in range(8)]


def _resamples(values: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(metric, iter, mean): means of resamples of (metric, value, ord).

    A row counts Poisson(1) times in each resample, eight resamples per MD5 of
    (seed, metric, ord, block): rows meet only in sums by (metric, iter), which are
    added up before the shuffle. A resample that draws no row has the plain mean.
    """
    rows = values.repartition(values.sparkSession.sparkContext.defaultParallelism, "metric", "ord")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-iterations // 8) - 1))))
    bits = F.md5(F.concat_ws("|", F.lit(seed), "metric", F.col("ord").cast("string"), "block"))
    rows = rows.select("metric", "value", "block", bits.alias("bits"))
    rows = rows.select("metric", "value", "block", F.posexplode(F.array(*[F.substring("bits", 4 * j + 1, 4) for j in range(8)])).alias("j", "u"))
    times = F.when(F.col("u") < POISSON[0], 0)
    for k, bound in enumerate(POISSON[1:], 1):
        times = times.when(F.col("u") < bound, k)
    times = times.otherwise(len(POISSON))
    rows = rows.select("metric", "value", (F.col("block") * 8 + F.col("j")).alias("iter"), times.alias("times")).where(F.col("iter") < iterations)
    sums = rows.groupBy("metric", "iter").agg((F.sum(F.col("value") * F.col("times")) / F.nullif(F.sum("times"), F.lit(0))).alias("mean"))
    plain = values.groupBy("metric").agg(F.avg("value").alias("plain"))
    return sums.join(plain, "metric").select("metric", "iter", F.round(F.coalesce("mean", "plain"), 12).alias("mean"))


def bootstrap(pairs: DataFrame, iterations: int = ITERATIONS, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """EX3: (metric, n, significant, p_value) of the paired differences b - a.

    p is twice the share of resampled means on the other side of 0 (ties count),
    at most 1; fewer than two pairs or no effect give (false, 1.0).
    """
    diffs = pairs.select("metric", (F.col("b") - F.col("a")).alias("value"), F.col("sample_index").alias("ord"))
    seen = diffs.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("observed"))
    means = _resamples(diffs, iterations, seed).join(seen, "metric")
    other = F.when(F.col("observed") > 0, F.col("mean") <= 0).otherwise(F.col("mean") >= 0)
    p = means.groupBy("metric").agg(F.least(F.lit(1.0), 2 * F.count_if(other) / F.lit(iterations)).alias("p"))
    out = seen.join(p, "metric")
    dull = (F.col("n") < 2) | (F.col("observed") == 0)
    p_value = F.when(dull, 1.0).otherwise(F.col("p"))
    return out.select("metric", "n", (p_value < 1 - confidence).alias("significant"), F.round(p_value, 6).alias("p_value"))


def diff_metrics(a: DataFrame, b: DataFrame, lower_is_better: tuple[str, ...] = LOWER_IS_BETTER) -> DataFrame:
    """EX4: (metric, a, b, delta, pct_change, winner) of metrics on both sides. Inputs: (metric, value)."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric")
    better = F.when(F.col("metric").isin(*lower_is_better), F.col("b") < F.col("a")).otherwise(F.col("b") > F.col("a"))
    winner = F.when(F.col("a") == F.col("b"), "tie").when(better, "B").otherwise("A")
    delta = F.col("b") - F.col("a")
    pct = F.when(F.col("a") != 0, F.round(delta / F.abs("a") * 100, 2))
    return both.select("metric", "a", "b", F.round(delta, 6).alias("delta"), pct.alias("pct_change"), winner.alias("winner"))


def experiment(run_a: DataFrame, run_b: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """EX5: the differences of two runs (sample_index, metrics) with their significance."""
    mean = lambda r: r.select(F.explode("metrics").alias("metric", "value")).groupBy("metric").agg(F.bround(F.avg("value"), 4).alias("value"))
    return diff_metrics(mean(run_a), mean(run_b)).join(bootstrap(pair(run_a, run_b), iterations), "metric", "left")


def _limits(spark, thresholds: dict[str, float]) -> DataFrame:
    if not thresholds:
        raise ValueError("no thresholds given")
    return spark.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate(thresholds.items())], "ord int, name string, threshold double")


def api_gate(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """EX6: (run_id, passed, failures); metrics: (run_id, metric, value). A missing metric counts as 0."""
    limits = _limits(metrics.sparkSession, thresholds or GATE)
    grid = metrics.select("run_id").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(limits.withColumn("_one", F.lit(1))), "_one")
    got = grid.join(metrics.select("run_id", F.col("metric").alias("name"), "value"), ["run_id", "name"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    bad = F.when(F.col("value") < F.col("threshold"), F.struct("ord", "name"))
    out = got.groupBy("run_id").agg(F.array_sort(F.collect_list(bad)).alias("bad"))
    return out.select("run_id", (F.size("bad") == 0).alias("passed"), F.array_join(F.transform("bad", lambda x: x["name"]), ",").alias("failures"))


def ci_gate(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """EX7: (name, metric, value, threshold, status); metrics: (ord, metric, value) of one run.

    A name resolves to the metric of that very name, else to the first that starts with it.
    """
    limits = F.broadcast(_limits(metrics.sparkSession, thresholds).withColumnRenamed("ord", "_ord"))
    hits = metrics.join(limits, F.startswith("metric", "name"), "right")
    best = F.min(F.when(F.col("metric").isNotNull(), F.struct((F.col("metric") != F.col("name")).alias("x"), "ord", "metric", "value"))).alias("b")
    per = hits.groupBy("name", "threshold").agg(best)
    status = F.when(F.col("b").isNull(), "NOT PRODUCED").when(F.col("b.value") >= F.col("threshold"), "PASS").otherwise("FAIL")
    return per.select("name", "b.metric", "b.value", "threshold", status.alias("status"))


def nearest_ranks(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, one column per share): sorted[int(share * n)] of each key's values, the last one beyond the end."""
    return quantiles(rows, [key], value, shares, nearest=True).drop("n")


def bootstrap_ci(values: DataFrame, iterations: int = CI_ITERATIONS, seed: int = SEED) -> DataFrame:
    """EX9: (metric, mean, low, high): 2.5 and 97.5 % order statistics of resampled means. values: (metric, value, ord)."""
    means = _resamples(values, iterations, seed)
    place = F.row_number().over(Window.partitionBy("metric").orderBy("mean"))
    ranked = means.withColumn("place", place)
    low, high = int(0.025 * iterations) + 1, int(0.975 * iterations)
    ends = ranked.groupBy("metric").agg(F.max(F.when(F.col("place") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("place") == high, F.col("mean"))).alias("high"))
    mean = values.groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return mean.join(ends, "metric").select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def summarize_answers(rows: DataFrame, quality: list[str], latency: list[str], iterations: int = CI_ITERATIONS) -> DataFrame:
    """EX10: (metric, n, mean, low, high, p50, p95, judge_errors) per column; quality columns only have the mean and its interval.

    rows: (ord, judge_error, one column per metric); nulls are left out.
    """
    names = [*quality, *latency]
    cells = ", ".join(f"'{c}', cast(`{c}` as double)" for c in names)
    long = rows.selectExpr("ord", f"stack({len(names)}, {cells}) as (metric, value)").where("value is not null")
    tails = nearest_ranks(long.where(F.col("metric").isin(*latency)), "metric", "value", {"p50": 0.5, "p95": 0.95}).select("metric", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")) if latency else None
    out = bootstrap_ci(long, iterations)
    errors = rows.agg(F.count_if(F.col("judge_error").isNotNull()).alias("judge_errors"))
    out = out.join(tails, "metric", "left") if tails is not None else out
    return out.crossJoin(F.broadcast(errors))  # one row


def compare_answers(a: DataFrame, b: DataFrame, metrics: list[str], iterations: int = ITERATIONS) -> DataFrame:
    """EX11: runs (question, metric columns) paired by question: (metric, n, mean_a, mean_b, delta, p_value)."""
    table = lambda df: df.select(F.col("question").alias("sample_index"), F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]).alias("metrics"))
    pairs = pair(table(a), table(b))
    means = pairs.groupBy("metric").agg(F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"))
    return means.join(bootstrap(pairs, iterations), "metric")


def summarize_bench(rows: DataFrame, iterations: int = CI_ITERATIONS) -> DataFrame:
    """EX12: (mode, metric, pos, value) -> (mode, metric, n, mean, low, high, p50)."""
    key = F.concat_ws("/", "mode", "metric")
    ci = bootstrap_ci(rows.select(key.alias("metric"), "value", F.col("pos").alias("ord")), iterations)
    mid = quantiles(rows, ["mode", "metric"], "value", {"p50": 0.5}).select("mode", "metric", F.round("p50", 6).alias("p50"))
    return mid.withColumn("_k", key).join(ci.withColumnRenamed("metric", "_k"), "_k").select("mode", "metric", "n", "mean", "low", "high", "p50")


def compare_bench(a: DataFrame, b: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """EX12: two modes' (metric, pos, value), paired by position."""
    pairs = a.select("metric", F.col("pos").alias("sample_index"), F.col("value").alias("a")).join(b.select("metric", F.col("pos").alias("sample_index"), F.col("value").alias("b")), ["metric", "sample_index"])
    means = pairs.groupBy("metric").agg(F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"))
    return means.join(bootstrap(pairs, iterations), "metric")


def protocol_candidates(qrels: DataFrame, ranked: DataFrame, n: int = 100) -> DataFrame:
    """EX13: (query_id, rank, chunk_id): the positives, then the ranking's top n without them."""
    pos = qrels.select("query_id", "chunk_id", F.lit(0).alias("part"), F.lit(0).alias("at")).distinct()
    rest = ranked.where(F.col("rank") <= n).join(qrels, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(1).alias("part"), F.col("rank").alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "at", "chunk_id"))
    return pos.unionByName(rest).select("query_id", place.alias("rank"), "chunk_id")


def sweep_report(requests: DataFrame) -> DataFrame:
    """EX14: per config, medians of time to first token, total and characters, ms per character, failures; fastest first."""
    ok = F.col("error").isNull()
    cells = ", ".join(f"'{c}', cast(`{c}` as double)" for c in ("ttft_ms", "total_ms", "chars"))
    mids = quantiles(requests.where(ok).selectExpr("config", f"stack(3, {cells}) as (what, value)"), ["config", "what"], "value", {"p50": 0.5})
    mids = mids.groupBy("config").agg(*[F.round(F.max(F.when(F.col("what") == c, F.col("p50"))), 4).alias(c) for c in ("ttft_ms", "total_ms", "chars")])
    counts = requests.groupBy("config").agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("failures"))
    out = counts.join(mids, "config", "left").select("config", "ttft_ms", "total_ms", "chars", "n", "failures")
    return out.withColumn("ms_per_char", F.round(F.col("total_ms") / F.nullif("chars", F.lit(0.0)), 4)).orderBy("ttft_ms", "config")


def latency_table(requests: DataFrame) -> DataFrame:
    """EX15: nearest-rank p50, p95, p99, mean, min, max and throughput of each mode. requests: (mode, latency_ms)."""
    ranks = nearest_ranks(requests, "mode", "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    out = requests.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean"), F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max"),
        F.round(F.count(F.lit(1)) / (F.sum("latency_ms") / 1000), 4).alias("qps"),
    )
    return out.join(ranks, "mode").select("mode", "n", "p50", "p95", "p99", "mean", "min", "max", "qps")


def cache_speedup(requests: DataFrame, hit: str = "hit", miss: str = "miss") -> DataFrame:
    """EX15: median miss over median hit."""
    mids = quantiles(requests.where(F.col("mode").isin(hit, miss)), ["mode"], "latency_ms", {"p50": 0.5})
    mid = lambda m: F.max(F.when(F.col("mode") == m, F.col("p50")))
    return mids.agg(F.round(mid(hit), 4).alias("hit_p50"), F.round(mid(miss), 4).alias("miss_p50"), F.round(mid(miss) / mid(hit), 4).alias("speedup"))


def catalogue(df: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """EX16: newest first; key breaks ties."""
    return df.orderBy(F.desc("created_at"), key).limit(limit)


def run_detail(runs: DataFrame, samples: DataFrame, run_id: str) -> DataFrame:
    """EX16: one run's samples in order, with the run's name and status."""
    return runs.where(F.col("run_id") == run_id).select("run_id", "name", "status").join(samples.where(F.col("run_id") == run_id), "run_id").orderBy("sample_index")
