"""Track B on a stream: half-hour sessions scored against saved baselines.

The stream is joined with the static baselines (a stream-static join keeps no
state); the only state is one row per open caller and half hour, dropped once the
watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import deviation
from ..functions.times import hour_of_day
from ..operators.model import Model, melted
from ..schema import BUCKET_US, DIMENSIONS, MICROS


def score_stream(events: DataFrame, model: Model, late: str = "10 minutes") -> DataFrame:
    """``caller, bucket, first_t, last_t, events``, the flags and both deviations, once a half hour is complete.

    ``events``: a stream of canonical events.
    """
    timed = events.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", late)
    rows = melted(timed, "caller", "ts", "t_us").join(model.seen.withColumn("known", F.lit(1)), ["caller", "dim", "val"], "left")
    flag = lambda d: F.max(F.when((F.col("dim") == d) & F.col("known").isNull(), 1.0).otherwise(0.0))
    sessions = rows.groupBy("caller", F.window("ts", f"{BUCKET_US // MICROS} seconds").alias("span")).agg(
        F.min("t_us").alias("first_t"),
        F.max("t_us").alias("last_t"),
        (F.count("*") / len(DIMENSIONS)).cast("long").alias("events"),
        *[flag(d).alias(f"new_{'type' if d == 'rtype' else d}") for d in DIMENSIONS],
    )
    out = sessions.join(model.callers, "caller", "left")
    hour = hour_of_day(F.col("first_t"))
    away = F.abs(hour - F.coalesce("hour_mean", hour))
    return out.select(
        "caller",
        F.floor(F.unix_micros("span.start") / BUCKET_US).cast("long").alias("bucket"),
        "first_t", "last_t", "events",
        *[f"new_{'type' if d == 'rtype' else d}" for d in DIMENSIONS],
        deviation(F.col("events"), F.coalesce("rate_mean", F.lit(0.0)), F.coalesce("rate_std", F.lit(1.0))).alias("activity_dev"),
        (F.least(away, 24.0 - away) / 12.0).alias("hour_dev"),
    )
