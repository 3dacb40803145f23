"""Small artefacts as single files, published by rename on any file system that Spark reaches."""

from __future__ import annotations

import csv
import io
import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def publish(spark: SparkSession, target: str, content: str) -> None:
    """Write beside the target, then rename over it, so that a reader sees the old text or the new one."""
    jvm = spark.sparkContext._jvm
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(str(target))
    beside = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}.tmp")
    files = path.getFileSystem(conf)
    files.mkdirs(path.getParent())
    out = files.create(beside, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()
    if not files.rename(beside, path):  # some file systems do not rename over a file
        files.delete(path, False)
        if not files.rename(beside, path):
            raise OSError(f"{target} cannot be written")


def fetch(spark: SparkSession, target: str) -> str:
    """The text of a published file."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(str(target))
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def csv_text(rows: list, columns: list[str]) -> str:
    out = io.StringIO(newline="")
    lines = csv.writer(out)
    lines.writerow(columns)
    lines.writerows(rows)
    return out.getvalue()


def write_csv(alerts: DataFrame, target: str, columns: list[str], most: int) -> None:
    """Header and rows, in file order, of an alert table that a limit already bounds to ``most`` rows."""
    publish(alerts.sparkSession, target, csv_text(alerts.orderBy("csv_pos").limit(most).select(*columns).collect(), columns))


def write_json(spark: SparkSession, data: dict, target: str) -> None:
    publish(spark, target, json.dumps(data, indent=2))
