"""Exact order statistics of large groups: histograms that narrow to the wanted ranks.

Each wanted rank of each group is a search of its own: an interval of values and the
number of rows below it. A round reads the rows once, counts every search's interval
in BINS bins, partial counts first, and leaves of it the bin that holds the rank, cut
to the least and largest value in there. A search ends when those are equal. No task
sees a group's values, only its bins.
"""

from __future__ import annotations

from functools import reduce


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import kept, small_or_shuffled

BINS = 256


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], F.lit(True))


def order_statistics(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, times: str | None = None) -> DataFrame:
    """(keys, rank, value) for wanted (keys, rank): the value at that place, from 0, among a group's values in rising order.

    rows hold no null values; NaN counts as the largest. A row stands for as many as its
    column times says, else for one. rows are read once a round: give a kept table.
    """
    x = F.col(value).cast("double")
    rows = rows.select(*keys, x.alias("_x"), (F.col(times) if times else F.lit(1)).cast("long").alias("_times"))
    nan = F.isnan("_x")
    ends = rows.groupBy(*keys).agg(F.min("_x").alias("low"), F.max(F.when(~nan, F.col("_x"))).alias("high"), F.sum(F.when(nan, 0).otherwise(F.col("_times"))).alias("_numbers"))
    open_ = wanted.alias("r").join(ends.alias("s"), _same(keys)).select(*[f"r.{k}" for k in keys], "r.rank", "s.low", "s.high", F.lit(0).cast("long").alias("below"), "s._numbers")
    found = open_.where("rank >= _numbers").select(*keys, "rank", F.lit(float("nan")).alias("value"))
    open_ = kept(open_.where("rank < _numbers").drop("_numbers"), "ranks")
    numbers = rows.where(~nan)
    while True:
        n = open_.where("low < high").count()
        found = found.unionByName(open_.where("low = high").select(*keys, "rank", F.col("low").alias("value")))
        if not n:
            return found
        searches = kept(open_.where("low < high"), "ranks-open")
        met = numbers.alias("r").join(small_or_shuffled(searches.alias("s"), n), _same(keys) & (F.col("_x") >= F.col("low")) & (F.col("_x") <= F.col("high")))
        # the ends have bins of their own, so that every round narrows; halves, so that no width overflows; ends without a finite width give one bin between
        width = F.nullif(F.col("high") / 2 - F.col("low") / 2, F.lit(0.0))
        share = F.nanvl(F.coalesce((F.col("_x") / 2 - F.col("low") / 2) / width, F.lit(0.0)), F.lit(0.0))
        inside = F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * (BINS - 1)) + 1
        at = F.when(F.col("_x") == F.col("low"), 0).when(F.col("_x") == F.col("high"), BINS + 1).otherwise(inside)
        search = [*[F.col(f"s.{k}").alias(k) for k in keys], "rank", "below"]
        bins = met.groupBy(*search, at.alias("bin")).agg(F.sum("_times").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.withColumn("_upto", F.col("below") + upto)
        hit = (F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("n") <= F.col("rank"))
        open_ = kept(bins.where(hit).select(*keys, "rank", "low", "high", (F.col("_upto") - F.col("n")).alias("below")), "ranks")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], nearest: bool = False) -> DataFrame:
    """(keys, one column per share, n): linear quantiles of each group, or sorted[int(share * n)] (nearest), the last one beyond the end."""
    rows = kept(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value)), "quantile-rows")
    sizes = kept(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "quantile-sizes")
    last = F.col("n") - 1
    place = lambda q: F.least(F.floor(F.col("n") * F.lit(q)), last).cast("double") if nearest else last * F.lit(q)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares.values()])))
    wanted = sizes.select(*keys, F.explode(ranks).alias("rank"))
    values = order_statistics(rows, keys, value, wanted).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    both = sizes.alias("r").join(values.alias("s"), _same(keys)).select(*[f"r.{k}" for k in keys], "r.n", "s._at")

    def linear(q: float) -> Column:
        low, high = F.floor(place(q)), F.ceil(place(q))
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when(low == high, a).otherwise((high - place(q)) * a + (place(q) - low) * b)

    return both.select(*keys, *[linear(q).alias(name) for name, q in shares.items()], "n")
