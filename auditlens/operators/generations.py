"""What has changed between two generations of baselines.

Both sides are stacked and grouped by their keys: nulls are equal, rows meet in one shuffle, and a key that only one
side has needs no outer join.  Operations, a small table, are joined null-safe and fully outer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import NGRAM


def _told(old, new):
    return F.when(old == 0, "new").when(new == 0, "lost").otherwise("kept").alias("change")


def ngram_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``caller, h4..h1, op, old_cnt, new_cnt, change``: new, lost or kept."""
    none = F.lit(0).cast("long")
    both = old.select(*NGRAM, F.col("cnt").alias("old_cnt"), none.alias("new_cnt")).unionByName(new.select(*NGRAM, none.alias("old_cnt"), F.col("cnt").alias("new_cnt")))
    met = both.groupBy(*NGRAM).agg(F.sum("old_cnt").alias("old_cnt"), F.sum("new_cnt").alias("new_cnt"))
    return met.select("*", _told(F.col("old_cnt"), F.col("new_cnt")))


def caller_drift(changes: DataFrame) -> DataFrame:
    """Per caller the n-grams that are new, lost and kept, and the Jensen-Shannon divergence of both distributions in bits
    (0: the same, 1: nothing in common); null for a caller that only one generation has."""
    sizes = changes.groupBy("caller").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("new", "lost", "kept")], F.sum("old_cnt").alias("old_events"), F.sum("new_cnt").alias("new_events")
    )
    # events with the same pair of counts weigh the same, so a caller with most n-grams is a few rows in the join
    alike = changes.groupBy("caller", "old_cnt", "new_cnt").agg(F.count("*").alias("grams"))
    both = alike.withColumnRenamed("caller", "of").join(sizes, F.col("of").eqNullSafe(F.col("caller")))
    p, q = F.col("old_cnt") / F.col("old_events"), F.col("new_cnt") / F.col("new_events")
    part = lambda x: F.when(x > 0, x * F.log2(x / ((p + q) / 2))).otherwise(0.0)
    names = ["caller", "new", "lost", "kept", "old_events", "new_events"]
    known = (F.col("old_events") > 0) & (F.col("new_events") > 0)
    return both.groupBy(*names).agg(F.when(known, F.sum(F.when(known, F.col("grams") * (part(p) + part(q)) / 2))).alias("divergence"))


def seen_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``caller, dim, new, lost, kept``: how many values of each dimension a caller uses anew, no more, or still."""
    mark = lambda df, o, n: df.select("caller", "dim", "val", F.lit(o).alias("o"), F.lit(n).alias("n"))
    met = mark(old, 1, 0).unionByName(mark(new, 0, 1)).groupBy("caller", "dim", "val").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return met.groupBy("caller", "dim").agg(*[F.count_if(test).alias(c) for c, test in (("new", F.col("o") == 0), ("lost", F.col("n") == 0), ("kept", (F.col("o") + F.col("n")) == 2))])


def operation_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``op, change, dur_shift, idx_shift``: how far the means have moved, in the old deviation (null without one)."""
    a, b = old.alias("a"), new.alias("b")
    moved = lambda c: F.try_divide(F.col(f"b.{c}_mean") - F.col(f"a.{c}_mean"), F.col(f"a.{c}_std")).alias(f"{c}_shift")
    tell = F.when(F.col("a.dur_mean").isNull(), "new").when(F.col("b.dur_mean").isNull(), "lost").otherwise("kept").alias("change")
    return a.join(b, F.col("a.op").eqNullSafe(F.col("b.op")), "full_outer").select(F.coalesce("a.op", "b.op").alias("op"), tell, moved("dur"), moved("idx"))
