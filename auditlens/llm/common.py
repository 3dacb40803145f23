"""Helpers shared by the training-data operators: shared-folder tables, batch
shaping and connected components.

Tasks receive Arrow record batches (``mapInArrow``), so pass-through columns of
any type survive unchanged.  Tables that cut lineage are written to the folder
named by ``spark.checkpoint.dir``; a private folder is used only when a local
session names none (tests).
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one task works on at a time.
CHUNK_BYTES = 24 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; opened by Spark only."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="auditlens-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Cuts lineage, and freezes the row ids assigned so far: what is read back
    stays the same when a lost executor's tasks run again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later result reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_batches_of(spark: SparkSession, rows: int) -> SparkSession:
    """A session of its own, with the settings of this one, that passes rows to Python ``rows`` at a time, for rows that may be large."""
    name, out = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and out.conf.isModifiable(key):
            out.conf.set(key, value)
    out.conf.set(name, min(rows, int(spark.conf.get(name))))
    return out


def read_in(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table of ``written`` as a table of another session."""
    return spark.read.schema(df.schema).parquet(*{name.rsplit("/", 1)[0] for name in df.inputFiles()}) if df.inputFiles() else spark.createDataFrame([], df.schema)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more; it only learns of them when
    the driver collects garbage, which may be half an hour away."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` has (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        n = f"__{name}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup batches into tables of about ``limit`` bytes of ``text``.

    A single row is never cut, so a chunk exceeds the limit only by its last row.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            size += int(n) + 16
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                full, held, size, start = [pa.Table.from_batches(held)], [], 0, i + 1
                yield full.pop()  # whoever takes it is the only one to hold it
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def texts_of(tab: pa.Table, text: str) -> list[str]:
    """The text column as Python strings, null as empty."""
    return [x or "" for x in tab.column(text).to_pylist()]


def emit(columns: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns (lists or arrays, in any order) as record batches of ``schema``."""
    arrays = [pa.array(columns[f.name], type=f.type) for f in schema]
    yield from pa.Table.from_arrays(arrays, schema=schema).to_batches(max_chunksize=20_000)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    return df.mapInArrow(function, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``node, component`` (its least node).

    ``edges`` has long columns ``a, b``.  Alternating large-star and small-star
    steps until nothing changes; each step is a partial aggregation by node and a many-to-one
    join, so a node of very high degree is split by AQE and never gathered.  Links
    stay in Spark; only a changed-rows count reaches the driver.  Every round
    is cut by a table in the shared folder, which the next round's replaces.
    """
    pairs = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )

    def least_neighbour(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def state() -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen, now = None, state()
    while now != seen and now[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        before, pairs = pairs, written(small.where("u <> v").distinct(), "links")
        discard(before)
        seen, now = now, state()
    return pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
