"""Baselines learnt from the training part, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import bucket, hour_of_day
from ..schema import DIMENSIONS

NGRAM = ["caller", "h4", "h3", "h2", "h1", "op"]


def ngrams(train: DataFrame, *by: str) -> DataFrame:
    """``by, caller, h4..h1, op, cnt``."""
    return train.groupBy(*by, *NGRAM).agg(F.count("*").alias("cnt"))


def ngram_max(grams: DataFrame) -> DataFrame:
    return grams.agg(F.coalesce(F.max("cnt"), F.lit(1)).alias("max_cnt"))


def operations(train: DataFrame) -> DataFrame:
    """``op`` with mean and population deviation of elapsed time and position."""
    return train.groupBy("op").agg(
        F.avg("elapsed").alias("dur_mean"),
        F.stddev_pop("elapsed").alias("dur_std"),
        F.avg("idx").alias("idx_mean"),
        F.stddev_pop(F.col("idx").cast("double")).alias("idx_std"),
    )


def melted(events: DataFrame, *keys: str) -> DataFrame:
    """``keys, dim, val``: one row per dimension of an event."""
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("val")) for d in DIMENSIONS])
    return events.select(*keys, F.explode(dims).alias("d")).select(*keys, "d.dim", "d.val")


def seen(train: DataFrame) -> DataFrame:
    """``caller, dim, val``: what each caller has used."""
    return melted(train, "caller").distinct()


def train_sessions(train: DataFrame, *by: str) -> DataFrame:
    """``by, caller, bucket, events, hour`` of non-empty half hours; the hour is that of the first event."""
    groups = train.groupBy(*by, "caller", bucket(F.col("t_us")).alias("bucket"))
    return groups.agg(F.count("*").alias("events"), hour_of_day(F.min("t_us")).alias("hour"))


def callers(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("caller").agg(
        F.avg("events").alias("rate_mean"), F.stddev_pop(F.col("events").cast("double")).alias("rate_std"), F.avg("hour").alias("hour_mean")
    )


@dataclass
class Model:
    ngrams: DataFrame
    ngram_max: DataFrame
    operations: DataFrame
    seen: DataFrame
    callers: DataFrame

    TABLES = ("ngrams", "ngram_max", "operations", "seen", "callers")

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Model:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in cls.TABLES])


def fit(train: DataFrame) -> Model:
    """``train``: events of the training part with history.  Plans only; whoever reads several tables writes ``train`` first."""
    grams = ngrams(train)
    return Model(grams, ngram_max(grams), operations(train), seen(train), callers(train_sessions(train)))
