"""Track A: scores per correlation id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import deviation, lifecycle_explanation, lifecycle_signals
from ..functions.times import iso_range
from ..schema import TOP_CONTEXT, TOP_TOTAL
from .model import NGRAM

#: Operations kept from either end of a lifecycle.
ENDS = 10


def score_events(test: DataFrame, ngrams: DataFrame, ngram_max: DataFrame, operations: DataFrame) -> DataFrame:
    """Test events with ``struct, rarity, dur_dev, len_dev``."""
    out = test.join(ngrams, NGRAM, "left").crossJoin(F.broadcast(ngram_max)).join(operations, "op", "left")
    known = F.col("dur_mean").isNotNull()
    return out.select(
        *test.columns,
        F.when(F.col("cnt").isNull(), 1.0).otherwise(0.0).alias("struct"),
        (1.0 - F.coalesce("cnt", F.lit(0)) / F.col("max_cnt")).alias("rarity"),
        F.when(known, deviation(F.col("elapsed"), F.col("dur_mean"), F.col("dur_std"))).otherwise(1.0).alias("dur_dev"),
        F.when(known, deviation(F.col("idx"), F.col("idx_mean"), F.col("idx_std"))).otherwise(1.0).alias("len_dev"),
    )


def ops_text(condition: Column) -> Column:
    """Operations of the events that meet the condition, in order, as one text."""
    held = F.array_sort(F.collect_list(F.when(condition, F.struct("idx", "op"))))
    return F.array_join(F.transform(held, lambda x: x["op"]), " -> ")


def score_lifecycles(scored: DataFrame) -> DataFrame:
    """One row per correlation id.  At most ``ENDS`` operations from each end are gathered, whatever its length."""
    first = F.col("idx") == 1
    varied = lambda c: F.min(c) < F.max(c)
    return scored.groupBy(F.col("corr").alias("correlation_id")).agg(
        F.max(F.when(first, F.col("caller"))).alias("caller"),
        F.min("t_us").alias("first_t"),
        F.max(F.when(first, F.col("seq"))).alias("first_seq"),
        F.max("t_us").alias("last_t"),
        F.count("*").alias("events"),
        F.max("struct").alias("struct"),
        F.max("rarity").alias("rarity"),
        F.max("dur_dev").alias("dur_dev"),
        F.max("len_dev").alias("len_dev"),
        F.when(varied("prov") | varied("rg") | varied("sub"), 1.0).otherwise(0.0).alias("context"),
        ops_text(F.col("idx") <= ENDS).alias("first_ops"),
        ops_text(F.col("idx") > F.col("n") - ENDS).alias("last_ops"),
    )


def patterns(lifecycles: DataFrame) -> DataFrame:
    """One representative (first seen) per caller, last operations, structure and context, with ``pattern_count``.

    An aggregate, not a window: a pattern shared by most lifecycles is combined before the shuffle.
    """
    key = ["caller", "last_ops", "struct", "context"]
    rest = [c for c in lifecycles.columns if c not in key]
    kept = F.min_by(F.struct(*rest), F.struct("first_t", "first_seq"))
    return lifecycles.groupBy(*key).agg(kept.alias("kept"), F.count("*").alias("pattern_count")).select(*key, "pattern_count", "kept.*")


def with_signals(rows: DataFrame) -> DataFrame:
    struct, rarity, dur, length, context = (F.col(c) for c in ("struct", "rarity", "dur_dev", "len_dev", "context"))
    return (
        rows.withColumn("total_score", F.round(struct + rarity + dur + length + context, 3))
        .withColumn("effective_signal_count", lifecycle_signals(struct, rarity, dur, length, context))
        .withColumn("explanation", lifecycle_explanation(struct, dur, context))
    )


def alert_rows(signals: DataFrame) -> DataFrame:
    """Columns of the alert table, and ``first_t, first_seq`` that decide ties."""
    return signals.select(
        iso_range(F.col("first_t"), F.col("last_t")).alias("timestamp_range"),
        "caller", "correlation_id", "total_score", "effective_signal_count", "pattern_count",
        F.round("struct", 3).alias("structural_violation"),
        F.round("rarity", 3).alias("sequence_rarity"),
        F.round("dur_dev", 3).alias("duration_deviation"),
        F.round("len_dev", 3).alias("length_deviation"),
        F.round("context", 3).alias("context_inconsistency"),
        "explanation",
        F.col("first_ops").alias("sequence_context"),
        "first_t", "first_seq",
    )


_SEEN = ["first_t", "first_seq"]


def alerts(rows: DataFrame, total: int = TOP_TOTAL, context: int = TOP_CONTEXT) -> DataFrame:
    """The best rows by total, then the best of the others with context, in file order by ``csv_pos``.

    Two limits find all rows that can be in either list; both lists are made of these few.
    """
    by_total = [F.desc("total_score"), F.desc("effective_signal_count"), *_SEEN]
    by_context = [F.desc("context_inconsistency"), *by_total]
    best = rows.orderBy(*by_total).limit(total)
    shifted = rows.where("context_inconsistency > 0").orderBy(*by_context).limit(total + context)
    few = best.unionByName(shifted).dropDuplicates(["correlation_id"])
    few = few.withColumn("by_total", F.row_number().over(Window.orderBy(*by_total)))
    rest = Window.partitionBy(F.col("by_total") <= total, F.col("context_inconsistency") > 0).orderBy(*by_context)
    few = few.withColumn("by_context", F.row_number().over(rest))
    second = (F.col("context_inconsistency") > 0) & (F.col("by_context") <= context)
    place = F.when(F.col("by_total") <= total, F.col("by_total")).when(second, F.col("by_context") + total)
    return few.withColumn("csv_pos", place.cast("long")).where("csv_pos is not null").drop("by_total", "by_context")


def top_total(rows: DataFrame) -> DataFrame:
    return alerts(rows).where(F.col("csv_pos") <= TOP_TOTAL)


def top_context(rows: DataFrame) -> DataFrame:
    """The best of the rows with context that the total list has not taken."""
    return alerts(rows).where(F.col("csv_pos") > TOP_TOTAL)
