"""The event table of the test data as canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import resource_type


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole = lambda c: F.floor(c).cast("int").cast("string")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    party = (F.col("user_id") % 12).cast("string")
    op = F.upper(F.concat(F.lit("app."), "event_type", F.lit("/tier"), whole(F.col("value") / 40), F.lit("/write")))
    return e.select(
        F.col("event_id").alias("seq"),
        t.alias("t_us"),
        op.alias("op"),
        F.upper(F.concat(F.lit("app."), "event_type")).alias("prov"),
        F.concat(F.lit("user-"), party).alias("caller"),
        F.concat(F.lit("10.0."), party, F.lit("."), whole(F.col("value") / 4)).alias("ip"),
        F.concat(F.lit("sub-"), whole(F.col("value") / 100)).alias("sub"),
        F.concat(F.lit("rg-"), whole(F.col("value") / 50)).alias("rg"),
        resource_type(op).alias("rtype"),
        F.concat(F.lit("c-"), whole(F.col("user_id") / 2), F.lit("-"), whole(t / F.lit(1e6) / 86400 / 3)).alias("corr"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst verdicts made from the labels of the test data."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    decision = (
        F.when(F.col("toxic") == 1, "CONFIRMED_ANOMALY")
        .when((F.col("quality") == 1) & (F.col("doc_id") % 5 == 0), "UNREVIEWED")
        .otherwise("BENIGN_FALSE_POSITIVE")
    )
    track = F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B")
    named = F.col("doc_id").cast("string").alias("alert_id")
    return labels.select(named, track.alias("track"), F.concat(F.lit("bucket-"), (F.col("doc_id") % 6).cast("string")).alias("bucket"), decision.alias("decision"))
