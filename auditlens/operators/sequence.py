"""Position, elapsed time and operation history of every event in its lifecycle.

A window over the correlation id alone puts a lifecycle in one task, and rows
without an id form one giant lifecycle.  So the window runs over slices of a
lifecycle by time; each slice's size and last operations, a row per slice, are
carried over by a second, much smaller window and added back.  A slice is an hour,
or shorter where the fullest hour of any lifecycle has more than ``MOST`` events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HISTORY, MICROS, PAD
from .split import SLICE_US

#: Events that a slice is meant to have at most.
MOST = 1_000_000
KEY = ["part", "corr", "slice"]


def slice_length(fullest: int, slice_us: int = SLICE_US, most: int = MOST) -> int:
    """Microseconds of a slice: halved until the fullest hour is within ``most``."""
    halves = 0
    while fullest / most > 2**halves:
        halves += 1
    return max(1, slice_us >> halves)


def in_slices(parts: DataFrame, length: int, period_us: int | None = None) -> DataFrame:
    """Events of ``train`` and ``test`` with their place in a slice of their lifecycle and the operations before them there.

    With ``period_us`` no slice lies in two periods of that length.
    """
    at = F.floor(F.col("t_us") / length)
    if period_us is not None:
        at = F.floor(F.col("t_us") / period_us) * -(-period_us // length) + F.floor(F.pmod("t_us", F.lit(period_us)) / length)
    rows = parts.where("part <> 'val'").withColumn("slice", at)
    inner, whole = Window.partitionBy(*KEY).orderBy("t_us", "seq"), Window.partitionBy(*KEY)
    rows = rows.withColumn("at", F.row_number().over(inner)).withColumn("of", F.count("*").over(whole))
    for k in range(1, HISTORY + 1):
        rows = rows.withColumn(f"h{k}", F.lag("op", k).over(inner))
    return rows


def summaries(rows: DataFrame, past: DataFrame | None = None) -> DataFrame:
    """``size, first, tail`` of every slice, a row each; ``past`` has rows of the same columns for what lies before all slices."""
    # newest first: the last operations of a slice
    tail = F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("at") > F.col("of") - HISTORY, F.struct("at", "op"))))), lambda x: x["op"])
    slices = rows.groupBy(*KEY).agg(F.count("*").alias("size"), F.min("t_us").alias("first"), tail.alias("tail"))
    return slices if past is None else slices.unionByName(past)


def ends(slices: DataFrame) -> DataFrame:
    """``corr, size, first, tail`` of each lifecycle after all its slices: what later events of it need."""
    back = Window.partitionBy("part", "corr").orderBy(F.desc("slice"))
    near = F.array_sort(F.collect_list(F.when(F.col("back") <= HISTORY, F.struct("back", "tail"))))
    tail = F.slice(F.flatten(F.transform(near, lambda x: x["tail"])), 1, HISTORY)
    return slices.withColumn("back", F.row_number().over(back)).groupBy("part", "corr").agg(F.sum("size").alias("size"), F.min("first").alias("first"), tail.alias("tail")).drop("part")


def ends_of_periods(slices: DataFrame) -> DataFrame:
    """``period, corr, size, first, tail``: as ``ends``, after each period that a lifecycle touches; ``slices`` have their ``period``, what lies before all has none."""
    upto = carried(slices, "period", "size", "tail").where("period is not null")
    tail = F.slice(F.concat("tail", "past"), 1, HISTORY)
    state = F.struct((F.col("before") + F.col("size")).alias("size"), F.col("start").alias("first"), tail.alias("tail"))
    return upto.groupBy("period", "corr").agg(F.max_by(state, "slice").alias("x")).select("period", "corr", "x.*")


def carried(slices: DataFrame, *more: str) -> DataFrame:
    """Per slice what its lifecycle had before, and in all: a row per slice, with columns ``more`` of the slice."""
    order, every = Window.partitionBy("part", "corr").orderBy("slice"), Window.partitionBy("part", "corr")
    near = order.rowsBetween(-HISTORY, -1)  # each slice has an event, so four slices hold all that is needed
    return slices.select(
        *KEY,
        *more,
        F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("size").over(every).alias("n"),
        F.min("first").over(every).alias("start"),
        F.slice(F.flatten(F.reverse(F.collect_list("tail").over(near))), 1, HISTORY).alias("past"),
    )


def with_history(rows: DataFrame, slices: DataFrame | None = None) -> DataFrame:
    """Rows of ``in_slices`` with ``idx`` (from 1), ``n``, ``elapsed`` (seconds) and ``h1``..``h4``.

    History starts anew in each part; with ``slices``, summaries of the rows and of a past, it goes on from there.
    """
    out = rows.join(carried(summaries(rows) if slices is None else slices), KEY)
    for k in range(1, HISTORY + 1):
        # the k-th operation back lies k - at before the slice's start once the slice has none
        back = F.get("past", (F.lit(k) - F.col("at")).cast("int"))
        out = out.withColumn(f"h{k}", F.coalesce(F.col(f"h{k}"), F.when(F.col("at") <= k, back), F.lit(PAD)))
    return (
        out.withColumn("idx", F.col("before") + F.col("at"))
        .withColumn("elapsed", (F.col("t_us") - F.col("start")) / F.lit(float(MICROS)))
        .drop("slice", "at", "of", "before", "past", "start")
    )
