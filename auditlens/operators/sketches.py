"""Distinct counts and quantiles as sketches that are stored by day and merged, with their error.

A day's row of an operation has a HyperLogLog sketch for each counted column and a KLL sketch of elapsed times, all as
binary columns of bounded size, so any span of days is answered from them without the events.

* Distinct counts: the relative standard error of a sketch of ``2**LG`` buckets is at most 1.04 / sqrt(2**LG), 0.82 %;
  ``DISTINCT_ERROR`` is three of them.
* Quantiles: the rank of the answer is off by at most ``RANK_ERROR`` of all values; a KLL sketch of ``K`` = 1,000 is within
  0.35 % at odds of 99 in 100, and the bound is some three times that.

Null values are not counted, and a column that is null throughout has an estimate of zero, or no quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DAY_US

LG, K = 14, 1_000
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG / 2), 0.01
COUNTED = ("caller", "ip", "corr")
SHARES = (0.5, 0.9, 0.99)


def daily(events: DataFrame, value: str | None = None) -> DataFrame:
    """``op, day, events`` and sketches; ``value`` names the column whose quantiles are kept."""
    sketches = [F.hll_sketch_agg(c, LG).alias(f"{c}_hll") for c in COUNTED]
    if value:
        sketches += [F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("kll"), F.count(value).alias("values")]
    return events.groupBy("op", F.floor(F.col("t_us") / DAY_US).cast("long").alias("day")).agg(F.count("*").alias("events"), *sketches)


def merged(days: DataFrame, *keys: str) -> DataFrame:
    """Sketches of all rows of ``days`` with the same ``keys``."""
    out = [F.sum("events").alias("events")] + [F.hll_union_agg(f"{c}_hll").alias(f"{c}_hll") for c in COUNTED]
    if "kll" in days.columns:
        out += [F.kll_merge_agg_double("kll", K).alias("kll"), F.sum("values").alias("values")]
    return days.groupBy(*keys).agg(*out)


def distincts(sketches: DataFrame, *keys: str) -> DataFrame:
    """``keys, column, estimate, at_least, at_most``: the exact count lies between the two at three standard errors."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.hll_sketch_estimate(f"{c}_hll").alias("estimate")) for c in COUNTED]))
    rows = sketches.select(*keys, each.alias("x")).select(*keys, "x.*")
    return rows.select("*", F.floor(F.col("estimate") / (1 + DISTINCT_ERROR)).alias("at_least"), F.ceil(F.col("estimate") / (1 - DISTINCT_ERROR)).alias("at_most"))


def quantiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """``keys, share, estimate``: at least ``share - RANK_ERROR`` of the values are at or below the estimate, and at most
    ``share + RANK_ERROR`` below it."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("kll", F.lit(s)).alias("estimate")) for s in SHARES]))
    return sketches.where(F.col("values") > 0).select(*keys, each.alias("x")).select(*keys, "x.*")


def check_distincts(estimates: DataFrame, events: DataFrame) -> DataFrame:
    """``op, column, exact, within``: whether the exact count lies in the stated bounds."""
    melted = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in COUNTED]))
    exact = events.select("op", melted.alias("x")).select("op", "x.*").distinct().groupBy("op", "column").agg(F.count("value").alias("exact"))
    return exact.join(estimates, ["op", "column"]).select("op", "column", "exact", F.col("exact").between(F.col("at_least"), F.col("at_most")).alias("within"))


def check_quantiles(estimates: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """``op, share, values, within``: whether the estimate's rank lies within the stated error."""
    # counted by value first, so a hot operation meets each value once
    counts = rows.where(F.col(value).isNotNull()).groupBy("op", F.col(value).alias("value")).agg(F.count("*").alias("c"))
    below, upto = F.sum(F.when(F.col("value") < F.col("estimate"), F.col("c")).otherwise(0)), F.sum(F.when(F.col("value") <= F.col("estimate"), F.col("c")).otherwise(0))
    n = F.sum("c")
    within = (below / n <= F.col("share") + RANK_ERROR) & (upto / n >= F.col("share") - RANK_ERROR)
    return counts.join(estimates, "op").groupBy("op", "share", "estimate").agg(n.alias("values"), within.alias("within")).drop("estimate")
