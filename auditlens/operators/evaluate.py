"""Measures over scores and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .model import NGRAM

COMPONENTS = ("struct", "rarity", "dur_dev", "len_dev")
SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
#: Ranges into which values from 0 to 1 are counted first.
RANGES = 4096


def component_percentiles(lifecycles: DataFrame) -> DataFrame:
    """``component, p50, p90, p99`` (exact, linear).

    Values are counted, then ranges of values; only the ranges that hold a wanted rank
    are ordered value by value, so no task meets all values.
    """
    melted = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in COMPONENTS]))
    values = lifecycles.select(melted.alias("x")).select("x.*").groupBy("component", "value").agg(F.count("*").alias("c"))
    values = values.withColumn("range", F.floor(F.col("value") * RANGES))
    upto = Window.partitionBy("component").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = values.groupBy("component", "range").agg(F.sum("c").alias("c"))  # at most RANGES + 1 rows each
    ranges = ranges.withColumn("end", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("component")))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(share).alias("share")) for name, share in SHARES.items()]))
    place = ranges.select("component", "range", "c", "end", "n", wanted.alias("w"))
    exact = F.col("w.share") * (F.col("n") - 1)
    ranks = place.select("component", "range", (F.col("end") - F.col("c")).alias("before"), "end", "w.name", (exact - F.floor(exact)).alias("part"), F.explode(F.array(F.floor(exact), F.ceil(exact))).alias("rank"))
    ranks = ranks.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("end"))).distinct()
    inner = Window.partitionBy("component", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = values.join(ranks.select("component", "range").distinct(), ["component", "range"]).withColumn("last", F.sum("c").over(inner))
    hit = near.join(ranks, ["component", "range"]).where((F.col("rank") - F.col("before") < F.col("last")) & (F.col("rank") - F.col("before") >= F.col("last") - F.col("c")))
    found = hit.groupBy("component", "name").agg((F.min("value") + (F.max("value") - F.min("value")) * F.max("part")).alias("value"))
    return found.groupBy("component").agg(*[F.round(F.max(F.when(F.col("name") == n, F.col("value"))), 6).alias(n) for n in SHARES])


def manifest(lifecycles: DataFrame, sessions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Counts of what was scored; of ``sessions`` the keys are enough."""
    a = lifecycles.agg(F.count("*").alias("track_a_scored"), F.count_if(F.col("context") > 0).alias("context_nonzero"))
    b = sessions.agg(F.count("*").alias("track_b_scored"))
    p = patterns.agg(F.count("*").alias("track_a_deduplicated_patterns"))
    return a.crossJoin(b).crossJoin(p)


def verdict_effectiveness(verdicts: DataFrame) -> DataFrame:
    """Per track and bucket: confirmed, false positives, unreviewed, and precision of what was reviewed."""
    n = lambda d: F.count_if(F.col("decision") == d)
    confirmed, benign = n("CONFIRMED_ANOMALY"), n("BENIGN_FALSE_POSITIVE")
    return verdicts.groupBy("track", "bucket").agg(
        confirmed.alias("confirmed"), benign.alias("false_positives"), n("UNREVIEWED").alias("unreviewed"), F.round(F.try_divide(confirmed, confirmed + benign), 6).alias("precision")
    )


def next_op_accuracy(grams: DataFrame, test: DataFrame, top: int = 3) -> DataFrame:
    """Share of test events whose operation is among the most frequent next operations of its context.

    Contexts are summarised to their ``top`` operations before the join.
    """
    context = NGRAM[:-1]
    order = Window.partitionBy(*context).orderBy(F.desc("cnt"), "op")
    best = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    hit = test.join(best.select(*NGRAM, "rank"), NGRAM, "left")
    return hit.agg(
        F.count("*").alias("events"),
        F.round(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 6).alias("top1"),
        F.round(F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)), 6).alias("top3"),
    )
