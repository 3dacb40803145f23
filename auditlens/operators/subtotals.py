"""Counts with subtotals, by grouping sets: every level in one pass and one shuffle.

``level`` is the grouping id: a bit for each column, in the order of the result, set where the row is a total over it.  So a null
key and a total differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diagnosis


def diagnosed(patterns: DataFrame, sessions: DataFrame) -> DataFrame:
    """``track, category, uncertainty, caller, total_score`` of all scored patterns and sessions, not of the alerts alone.

    ``patterns``: columns of the lifecycle alerts; ``sessions``: those of ``session.with_signals``.
    """
    # deviations are judged as the reports show them; causes, which would name operations, are not asked for
    shown = [F.round(c, 3).alias(c) if c in ("activity_dev", "hour_dev") else F.col(c) for c in sessions.columns]
    named = sessions.select(*shown, F.lit("").alias("session_context"))
    keep = ["category", "uncertainty", "caller", "total_score"]
    a = patterns.select("*", *diagnosis.lifecycle()).select(F.lit("A").alias("track"), *keep)
    return a.unionByName(named.select("*", *diagnosis.session()).select(F.lit("B").alias("track"), *keep))


def _measures() -> list[Column]:
    return [F.count("*").alias("outcomes"), F.max("total_score").alias("highest"), F.round(F.avg("total_score"), 6).alias("mean_score")]


def by_cause(rows: DataFrame) -> DataFrame:
    """Outcomes by track, category and caller, with subtotals by category, by caller and by track, and the grand total."""
    columns = [F.col(c) for c in ("track", "category", "caller")]
    track, category, caller = columns
    sets = [[track, category, caller], [track, category], [track, caller], [caller], [track], []]
    return rows.groupingSets(sets, *columns).agg(F.grouping_id(*columns).alias("level"), *_measures())


def by_confidence(rows: DataFrame) -> DataFrame:
    """Outcomes rolled up from category to confidence to track."""
    columns = ["track", "uncertainty", "category"]
    return rows.rollup(*columns).agg(F.grouping_id(*columns).alias("level"), *_measures())


def verdict_cube(verdicts: DataFrame) -> DataFrame:
    """Verdicts by every combination of track, bucket and decision."""
    columns = ["track", "bucket", "decision"]
    return verdicts.cube(*columns).agg(F.grouping_id(*columns).alias("level"), F.count("*").alias("verdicts"))
