"""Sessions on a stream that late events correct.

Every batch leaves partial session aggregates in a folder named by its id, late rows included, so a batch that
runs again overwrites its own and nothing is counted twice.  A session is published once the mark (the latest time
of all batches so far, less the lateness) has passed its end, and again whenever a late row changed it; readers take
the last version of a session.  Rows behind the mark are kept apart too (``late``), to be looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import melted
from ..operators.session import KEY, with_bucket
from ..schema import BUCKET_US, DIMENSIONS, MICROS

FLAGS = [f"new_{'type' if d == 'rtype' else d}" for d in DIMENSIONS]
_PARTIAL = "caller string, bucket long, first_t long, first_seq long, last_t long, events long, " + ", ".join(f"{f} double" for f in FLAGS)


def partial(events: DataFrame, seen: DataFrame) -> DataFrame:
    """Aggregates of any subset of a session's events; ``merged`` adds them up in any order."""
    rows = with_bucket(events)
    base = rows.groupBy(*KEY).agg(F.min("t_us").alias("first_t"), F.min(F.struct("t_us", "seq"))["seq"].alias("first_seq"), F.max("t_us").alias("last_t"), F.count("*").alias("events"))
    new = melted(rows, *KEY).distinct().join(seen, ["caller", "dim", "val"], "left_anti")
    flags = new.groupBy(*KEY).agg(*[F.max(F.when(F.col("dim") == d, 1.0).otherwise(0.0)).alias(f) for d, f in zip(DIMENSIONS, FLAGS)])
    return base.join(flags, KEY, "left").na.fill(0.0, FLAGS)


def merged(partials: DataFrame) -> DataFrame:
    first: Column = F.min(F.struct("first_t", "first_seq"))
    return partials.groupBy(*KEY).agg(first["first_t"].alias("first_t"), first["first_seq"].alias("first_seq"), F.max("last_t").alias("last_t"), F.sum("events").alias("events"), *[F.max(f).alias(f) for f in FLAGS])


class SessionSink:
    """Keeps under ``path``, with a folder per batch: ``partials``, ``late``, ``marks`` and ``sessions`` (published versions)."""

    def __init__(self, path: str, seen: DataFrame, late_seconds: int = 600):
        self.path, self.seen, self.late_us = path, seen, late_seconds * MICROS

    def _read(self, spark: SparkSession, name: str, schema: str, before: int) -> DataFrame | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema(f"{schema}, batch long").parquet(path.toString()).where(F.col("batch") < before)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        marks = self._read(spark, "marks", "top long", batch_id)  # a row per batch
        before = marks.agg(F.max("top")).first()[0] if marks is not None else None
        top = max((t for t in (before, rows.agg(F.max("t_us")).first()[0]) if t is not None), default=None)
        if top is None:
            rows.unpersist()
            return
        end = (F.col("bucket") + 1) * BUCKET_US
        is_late = F.lit(False) if before is None else end <= before - self.late_us
        self._write(with_bucket(rows).where(is_late).drop("bucket"), "late", batch_id)
        self._write(partial(rows, self.seen), "partials", batch_id)
        partials = self._read(spark, "partials", _PARTIAL, batch_id + 1)
        changed = partials.where(F.col("batch") == batch_id).where(is_late).select(*KEY)
        complete = end <= top - self.late_us
        passed = partials.where(complete if before is None else complete & ~is_late).select(*KEY)
        due = partials.join(changed.union(passed).distinct(), KEY, "left_semi")
        self._write(merged(due), "sessions", batch_id)
        self._write(spark.range(1).select(F.lit(top).cast("long").alias("top")), "marks", batch_id)
        rows.unpersist()


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """The last version of every published session."""
    rows = spark.read.schema(f"{_PARTIAL}, batch long").parquet(f"{path}/sessions")
    rest = [c for c in rows.columns if c not in (*KEY, "batch")]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "batch").alias("last"), F.max("batch").alias("version")).select(*KEY, "last.*", "version")


def correct_sessions(events: DataFrame, seen: DataFrame, path: str, checkpoint: str, late_seconds: int = 600, **options) -> StreamingQuery:
    out = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(SessionSink(path, seen, late_seconds))
    return out.trigger(**(options or {"availableNow": True})).start()
