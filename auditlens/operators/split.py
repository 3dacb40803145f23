"""Chronological split by share of the time span."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MICROS, TEST_SHARE, TRAIN_SHARE

#: Length of a slice of a lifecycle, unless its hours are crowded.
SLICE_US = 3600 * MICROS


class Bounds(NamedTuple):
    """What a plan has to know of all events: the ends of the span and the fullest hour of a correlation id."""

    low: int | None
    high: int | None
    fullest: int


def bounds(events: DataFrame) -> Bounds:
    """One job over time and correlation id; three numbers reach the driver and become literals of later plans."""
    hours = events.groupBy("corr", F.floor(F.col("t_us") / SLICE_US).alias("hour")).agg(F.min("t_us").alias("low"), F.max("t_us").alias("high"), F.count("*").alias("n"))
    r = hours.agg(F.min("low"), F.max("high"), F.coalesce(F.max("n"), F.lit(0))).first()
    return Bounds(*r)


def part_of(known: Bounds) -> Column:
    """``train``, ``val`` or ``test``, by two literals."""
    if known.low is None:
        return F.lit("val")
    at = lambda share: math.ceil(float(known.low) + share * (known.high - known.low))
    return F.when(F.col("t_us") < at(TRAIN_SHARE), "train").when(F.col("t_us") >= at(TEST_SHARE), "test").otherwise("val")


def labelled(events: DataFrame, known: Bounds | None = None) -> DataFrame:
    """Events with ``part``."""
    return events.withColumn("part", part_of(known or bounds(events)))


def counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count("*").alias("events"))


def require_both(parts: DataFrame) -> tuple[int, int]:
    """Train and test sizes; neither may be empty."""
    found = {r["part"]: r["events"] for r in counts(parts).collect()}
    if not found.get("train"):
        raise ValueError("No event falls into the first 70 % of the time span, so there is nothing to learn from.")
    if not found.get("test"):
        raise ValueError("No event falls into the last 15 % of the time span, so there is nothing to score.")
    return found["train"], found["test"]
