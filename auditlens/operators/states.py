"""Baselines as states of periods that merge, and can be taken out again.

Counts are added.  A mean and a deviation are kept as size, mean and sum of squares about it, merged about the merged
mean, which loses no digits to large values as sums of squares would.  Each state has a ``sign``: -1 takes out
what an earlier state with the same rows has put in.  Groups that hold nothing are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import NGRAM, Model, melted, ngram_max, ngrams, train_sessions

#: Key and what is counted or averaged, by table.
COUNTED = {"ngrams": NGRAM, "seen": ["caller", "dim", "val"]}
AVERAGED = {"operations": ("op", ["elapsed", "idx"]), "callers": ("caller", ["events", "hour"])}
TABLES = (*COUNTED, *AVERAGED)


def _moments(rows: DataFrame, key: str, names: list[str], by: list[str]) -> DataFrame:
    spread = [x for c in names for x in (F.avg(c).alias(f"{c}_mean"), (F.var_pop(F.col(c).cast("double")) * F.count(c)).alias(f"{c}_m2"))]
    return rows.groupBy(*by, key).agg(F.count("*").alias("cnt"), *spread)


def of_events(history: DataFrame, events: DataFrame, *by: str) -> dict[str, DataFrame]:
    """States of a period: ``history`` are its ``events`` with position, elapsed time and operations before them.

    With columns ``by``, the states of each of their values.
    """
    return {
        "ngrams": ngrams(history, *by),
        "seen": melted(events, *by, "caller").groupBy(*by, *COUNTED["seen"]).agg(F.count("*").alias("cnt")),
        "operations": _moments(history, *AVERAGED["operations"], by),
        "callers": _moments(train_sessions(events, *by), *AVERAGED["callers"], by),
    }


def _sum(held: Column, value) -> Column:
    return F.aggregate(held, F.lit(0.0), lambda total, s: total + s["sign"] * value(s))


def merged(name: str, rows: DataFrame) -> DataFrame:
    """States of one table with their ``sign`` as one state, a row per key.

    A group meets as many rows as there are states, never events.
    """
    total = F.sum(F.col("sign") * F.col("cnt")).alias("cnt")
    if name in COUNTED:
        return rows.groupBy(*COUNTED[name]).agg(total).where("cnt > 0")
    key, names = AVERAGED[name]
    held = rows.groupBy(key).agg(total, F.collect_list(F.struct("sign", "cnt", *[f"{c}_{part}" for c in names for part in ("mean", "m2")])).alias("held")).where("cnt > 0")
    for c in names:
        held = held.withColumn(f"{c}_mean", _sum(F.col("held"), lambda s, c=c: s["cnt"] * s[f"{c}_mean"]) / F.col("cnt"))
        about = _sum(F.col("held"), lambda s, c=c: s[f"{c}_m2"] + s["cnt"] * F.pow(s[f"{c}_mean"] - F.col(f"{c}_mean"), F.lit(2.0)))
        held = held.withColumn(f"{c}_m2", F.greatest(about, F.lit(0.0)))
    return held.drop("held")


def baselines(states: dict[str, DataFrame]) -> Model:
    """Merged states as the baselines that ``model.fit`` makes of the same events."""
    std = lambda c: F.sqrt(F.col(f"{c}_m2") / F.col("cnt"))
    grams = states["ngrams"]
    operations = states["operations"].select(
        "op", F.col("elapsed_mean").alias("dur_mean"), std("elapsed").alias("dur_std"), "idx_mean", std("idx").alias("idx_std")
    )
    callers = states["callers"].select("caller", F.col("events_mean").alias("rate_mean"), std("events").alias("rate_std"), "hour_mean")
    return Model(grams, ngram_max(grams), operations, states["seen"].drop("cnt"), callers)
