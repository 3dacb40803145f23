"""Last values carried along a key's time line, and what is built on them: as-of joins, runs, gap sessions.

A window over a key alone puts all of a key's rows in one task.  So the window runs over slices of
a key's time line; what a slice hands on, a row per slice, is carried by a second, much smaller
window and joined back.  A slice is an hour, halved until the fullest hour of any key has at most ``MOST`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MICROS
from .sequence import MOST, slice_length
from .split import SLICE_US

GAP_US = 1800 * MICROS


def length_for(rows: DataFrame, key: list[str], at: str, most: int = MOST) -> int:
    """Length of slices for these rows: one job, of which a number reaches the driver."""
    hours = rows.groupBy(*key, F.floor(F.col(at) / SLICE_US).alias("hour")).agg(F.count("*").alias("n"))
    return slice_length(hours.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], SLICE_US, most)


def last_value(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str, length: int, here: bool = False) -> DataFrame:
    """``rows`` with ``name``: the last value that is not null of the key's rows before this one (with ``here``: or of this one).

    ``order`` begins with the time that slices cut and has to be total within a key.
    """
    rows = rows.withColumn("__slice", F.floor(F.col(order[0]) / length)).withColumn("__value", value)
    line = Window.partitionBy(*key, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if here else -1)
    inner = rows.withColumn("__inner", F.last("__value", ignorenulls=True).over(line))
    place = F.struct(*[F.col(c) for c in order])
    tails = rows.where("__value is not null").groupBy(*key, "__slice").agg(F.max_by("__value", place).alias("__tail"))
    # slices that hand nothing on are looked up too: the last tail before them
    slices = rows.select(*key, "__slice").distinct().join(tails, [*key, "__slice"], "left")
    before = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("__before", F.last("__tail", ignorenulls=True).over(before)).drop("__tail")
    return inner.join(carried, [*key, "__slice"]).withColumn(name, F.coalesce("__inner", "__before")).drop("__slice", "__value", "__inner", "__before")


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, tie: str, name: str, length: int) -> DataFrame:
    """``left`` with ``name``: the key's last row of ``right``, as a struct, at or before the time of the left row.

    A union of both and a carried value, not a join of rows with rows.  Of right rows with one time the one with
    the greatest ``tie`` counts.
    """
    match = F.struct(*[F.col(c) for c in right.columns])
    shape = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.select(match.alias("m")).schema["m"].dataType).alias("__match"))
    other = right.select(*[F.col(c) if c in (*key, at, tie) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("__side"), match.alias("__match"))
    both = last_value(shape.unionByName(other), key, [at, "__side", tie], F.col("__match"), name, length)
    return both.where("__side = 1").drop("__side", "__match")


def last_from_other(events: DataFrame, column: str, key: list[str], at: str, tie: str, length: int) -> DataFrame:
    """``events`` with ``other``: the key's last event before, as (at, tie, column), that has another value of ``column``.

    The event before either differs, or it belongs to the same run, and then what preceded the run's first event is meant.
    """
    fields = F.struct(*[F.col(c) for c in (at, tie, column)])
    rows = last_value(events, key, [at, tie], fields, "__prev", length)
    changed = F.when(~F.col(f"__prev.{column}").eqNullSafe(F.col(column)) & F.col("__prev").isNotNull(), F.col("__prev"))
    return last_value(rows, key, [at, tie], changed, "other", length, here=True).drop("__prev")


def gap_sessions(events: DataFrame, key: list[str], at: str, tie: str, length: int, gap_us: int = GAP_US) -> DataFrame:
    """``key, session_start, session_end, events``: a session ends when over ``gap_us`` pass without an event."""
    rows = last_value(events.select(*key, at, tie), key, [at, tie], F.col(at), "__prev", length)
    start = F.when(F.col("__prev").isNull() | (F.col(at) - F.col("__prev") > gap_us), F.col(at))
    rows = last_value(rows, key, [at, tie], start, "session_start", length, here=True)
    return rows.groupBy(*key, "session_start").agg(F.max(at).alias("session_end"), F.count("*").alias("events"))


def within_before(events: DataFrame, key: list[str], at: str, tie: str, span_us: int, measures: dict[str, Column], partial: int) -> DataFrame:
    """``events`` with measures over the key's events in the ``span_us`` before each, itself included: a sliding RANGE frame.

    Slices are ``partial`` times as long as the span, and each gets the rows of the span before it (its halo) once
    more, so frames never reach over a slice and a hot key is many slices.
    """
    length = span_us * partial
    own = F.floor(F.col(at) / length)
    # a row belongs to its slice, and to the next one if that begins within the span behind it
    spread = events.withColumn("__slice", F.explode(F.array_distinct(F.array(own, F.floor((F.col(at) + span_us) / length)))))
    frame = Window.partitionBy(*key, "__slice").orderBy(at).rangeBetween(-span_us, Window.currentRow)
    out = spread.select("*", *[m.over(frame).alias(n) for n, m in measures.items()])
    return out.where(F.col("__slice") == own).drop("__slice")
