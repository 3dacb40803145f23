"""Tables in the folder that driver and executors share, which cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the session names; a private one only in a local session that names none."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="auditlens-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a table of the shared folder, read back: lost executors recompute nothing, later steps plan from here.

    With ``by`` the table has a folder for each value of that column, so that a filter on it reads no others.
    """
    path, writer = shared_path(df.sparkSession, name), df.write
    (writer.partitionBy(by) if by else writer).parquet(path)
    # a column that names folders comes last
    columns = [c for c in df.columns if c != by] + ([by] if by else [])
    return df.sparkSession.read.schema(df.select(*columns).schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/part-", 1)[0] for name in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
