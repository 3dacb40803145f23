"""Track B: scores per caller and half hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import deviation, dominant_signal, session_explanation, session_signals
from ..functions.times import bucket, hour_of_day, iso_range
from ..schema import DIMENSIONS, TOP_SESSIONS
from .model import melted

KEY = ["caller", "bucket"]
#: Operations shown for a session.
SHOWN = 10


def with_bucket(test: DataFrame) -> DataFrame:
    return test.withColumn("bucket", bucket(F.col("t_us")))


def keys(test: DataFrame) -> DataFrame:
    """``caller, bucket`` of every session."""
    return with_bucket(test).select(*KEY).distinct()


def new_values(test: DataFrame, seen: DataFrame) -> DataFrame:
    """``caller, bucket, dim, val`` that the caller had not used in training.

    Values are made distinct before the one anti join that serves all dimensions.
    """
    return melted(with_bucket(test), *KEY).distinct().join(seen, ["caller", "dim", "val"], "left_anti")


def new_entities(test: DataFrame, seen: DataFrame) -> DataFrame:
    """``caller, bucket`` and a 0/1 flag for each dimension with a new value; sessions without any are absent."""
    flags = [F.max(F.when(F.col("dim") == d, 1.0).otherwise(0.0)).alias(f"new_{d}") for d in DIMENSIONS]
    return new_values(test, seen).groupBy(*KEY).agg(*flags)


def first_operations(test: DataFrame) -> DataFrame:
    """``session_context``: a session's different operations in order of appearance, the first ten."""
    ops = with_bucket(test).groupBy(*KEY, "op").agg(F.min(F.struct("t_us", "seq")).alias("at"))
    # only the first ten of a session are gathered, and the limit is applied before the shuffle too
    few = ops.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("at"))).where(F.col("k") <= SHOWN)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "op"))), lambda x: x["op"])
    return few.groupBy(*KEY).agg(F.array_join(ordered, ", ").alias("session_context"))


def score_sessions(test: DataFrame, seen: DataFrame, callers: DataFrame) -> DataFrame:
    base = with_bucket(test).groupBy(*KEY).agg(
        F.min("t_us").alias("first_t"),
        F.min(F.struct("t_us", "seq"))["seq"].alias("first_seq"),
        F.max("t_us").alias("last_t"),
        F.count("*").alias("events"),
    )
    out = base.join(new_entities(test, seen), KEY, "left").join(callers, "caller", "left")
    hour = hour_of_day(F.col("first_t"))
    away = F.abs(hour - F.coalesce("hour_mean", hour))
    return out.select(
        *base.columns,
        *[F.coalesce(f"new_{d}", F.lit(0.0)).alias(f"new_{'type' if d == 'rtype' else d}") for d in DIMENSIONS],
        deviation(F.col("events"), F.coalesce("rate_mean", F.lit(0.0)), F.coalesce("rate_std", F.lit(1.0))).alias("activity_dev"),
        (F.least(away, 24.0 - away) / 12.0).alias("hour_dev"),
    )


def with_signals(rows: DataFrame) -> DataFrame:
    op, ip, activity, hour = (F.col(c) for c in ("new_op", "new_ip", "activity_dev", "hour_dev"))
    scope = F.greatest("new_prov", "new_sub", "new_rg", "new_type")
    total = F.col("new_op") + F.col("new_prov") + F.col("new_sub") + F.col("new_rg") + F.col("new_type") + ip + activity + hour
    return (
        rows.withColumn("total_score", F.round(total, 3))
        .withColumn("effective_signal_count", session_signals(op, ip, activity, hour, scope))
        .withColumn("dominant_signal", dominant_signal(op, ip, activity, hour, scope))
        .withColumn("explanation", session_explanation(op, ip, activity, hour))
    )


def _order() -> list:
    return [F.desc("total_score"), F.desc("effective_signal_count"), "first_t", "first_seq"]


def best(sessions: DataFrame, most: int = TOP_SESSIONS) -> DataFrame:
    return with_signals(sessions).orderBy(*_order()).limit(most)


def alerts(best: DataFrame, test: DataFrame) -> DataFrame:
    """The best sessions (a small table) with ``csv_pos``; contexts are gathered for these only."""
    few = F.broadcast(best.select(*KEY))  # as many rows as ``best`` has been limited to
    shown = first_operations(with_bucket(test).join(few, KEY, "left_semi"))
    flags = [F.round(c, 3).alias(c) for c in ("new_op", "new_prov", "new_sub", "new_rg", "new_type", "new_ip", "activity_dev", "hour_dev")]
    return best.join(shown, KEY).select(
        iso_range(F.col("first_t"), F.col("last_t")).alias("timestamp_range"),
        "caller", "total_score", "effective_signal_count", "dominant_signal", *flags, "explanation", "session_context",
        F.row_number().over(Window.orderBy(*_order())).cast("long").alias("csv_pos"),
    )
