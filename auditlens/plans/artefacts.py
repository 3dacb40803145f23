"""The analysis from an export to published files, read back; and what its guards say of exports that cannot be used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import split
from ..schema import LIFECYCLE_ALERT, MICROS, SESSION_ALERT
from ..sources.activity_csv import load_events
from ..sources.shared import discard, shared_path
from .analyze import analyze

#: Columns of the alert tables that are no scores.
TEXTS = {"timestamp_range", "caller", "correlation_id", "dominant_signal", "explanation", "sequence_context", "session_context"}
COUNTS = {"effective_signal_count", "pattern_count"}


def seconds(t_us: Column) -> Column:
    return (t_us / F.lit(MICROS).cast("decimal(7,0)")).cast("decimal(20,6)").cast("string")


def export(events: DataFrame, leave_out: tuple[str, ...] = (), **changed: Column) -> str:
    """Canonical events as CSV files of the generic layout, in order of ``seq`` over all files."""
    cells = {
        "timestamp_epoch": seconds(F.col("t_us")), "operation": F.col("op"), "provider": F.col("prov"), "caller": F.col("caller"), "caller_ip": F.col("ip"),
        "subscription": F.col("sub"), "resource_group": F.col("rg"), "resource_type": F.col("rtype"), "correlation_id": F.col("corr"),
    } | changed
    path = shared_path(events.sparkSession, "export")
    events.orderBy("seq").select(*[c.alias(n) for n, c in cells.items() if n not in leave_out]).write.options(header=True, escape='"').csv(path)
    return path


def alert_cells(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """``artefact, pos, field, value`` of a published alert table; its header must be ``columns``."""
    kind = lambda c: "string" if c in TEXTS else "bigint" if c in COUNTS else "double"
    told = lambda c: F.col(c).cast("string") if c in TEXTS | COUNTS else F.col(c).cast("decimal(18,3)").cast("string")
    options = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False, "mode": "FAILFAST"}
    rows = spark.read.options(**options).schema(", ".join(f"{c} {kind(c)}" for c in columns)).csv(f"{folder}/{name}")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), told(c).alias("value")) for c in columns]))
    # a file of a few rows is one partition
    return rows.withColumn("pos", F.monotonically_increasing_id() + 1).select(F.lit(name).alias("artefact"), "pos", cells.alias("cell")).select("artefact", "pos", "cell.*")


def manifest_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of the manifest, and whether its time can be read."""
    name = "manifest.json"
    data = spark.read.option("multiLine", True).json(f"{folder}/{name}")
    made = F.when(times.iso_us(F.col("generated_utc")).isNotNull(), "a time").otherwise("unreadable")
    told = F.array(*[F.struct(F.lit(c).alias("field"), (made if c == "generated_utc" else F.col(c).cast("string")).alias("value")) for c in data.columns])
    return data.select(F.lit(name).alias("artefact"), F.lit(0).cast("long").alias("pos"), F.explode(told).alias("cell")).select("artefact", "pos", "cell.*")


def packet_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The headings of the packet in order, and its entries by queue and number."""
    name = "diagnosed_review_packet.md"
    whole = spark.read.text(f"{folder}/{name}", wholetext=True)
    heading = F.posexplode(F.regexp_extract_all("value", F.lit(r"(?m)^(#{1,2} [^\n]*)"), 1)).alias("at", "value")
    headings = whole.select(heading).select((F.col("at") + 1).cast("long").alias("pos"), F.lit("heading").alias("field"), "value")
    entries = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\n### (.*?\n\*\*Scores:\*\*[^\n]*)"), 1)).alias("value"))
    mark = lambda i: F.regexp_extract("value", r"^([AB]\d?)-(\d+)\. ", i)
    both = headings.unionByName(entries.select(mark(2).cast("long").alias("pos"), mark(1).alias("field"), "value"))
    return both.select(F.lit(name).alias("artefact"), "pos", "field", "value")


def roundtrip(events: DataFrame) -> DataFrame:
    """All that a run over an export of ``events`` publishes, read back: ``artefact, pos, field, value``, scores with three digits."""
    spark = events.sparkSession
    source, out = export(events), shared_path(spark, "reports")
    analyze(spark, source, out)
    discard(spark.read.text(source))
    tables = [alert_cells(spark, out, "top_lifecycle_anomalies.csv", LIFECYCLE_ALERT), alert_cells(spark, out, "top_actor_anomalies.csv", SESSION_ALERT)]
    return tables[0].unionByName(tables[1]).unionByName(manifest_cells(spark, out)).unionByName(packet_cells(spark, out))


def _told(check: Callable[[], int], path: str | None) -> tuple[str | None, str | None, int | None]:
    """Class and text of the error, with the path as a mark, or the number that the check returns."""
    try:
        return None, None, check()
    except (FileNotFoundError, ValueError) as error:
        return type(error).__name__, str(error).replace(path, "<path>") if path else str(error), None


def guards(events: DataFrame) -> DataFrame:
    """``case, error, message, events``: exports made of ``events`` that cannot be used, and ones that can, with the events read."""
    spark = events.sparkSession
    parts = split.labelled(events)
    nowhere = shared_path(spark, "no-export")
    empty = shared_path(spark, "export")
    events.where("false").select("op").coalesce(1).write.text(empty)
    unnamed, timeless = export(events, ("caller",)), export(events, timestamp_epoch=F.lit("n/a"))
    mixed = export(events, timestamp_epoch=F.when(F.col("seq") % 7 == 0, "n/a").otherwise(seconds(F.col("t_us"))))
    out = shared_path(spark, "reports")

    def dry() -> int:
        """Events that a dry run has read, if it has written nothing."""
        analyze(spark, mixed, out, dry_run=True)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            raise ValueError("A dry run has written files.")
        return load_events(spark, mixed).count()

    read = lambda path: lambda: load_events(spark, path).count()
    learn = lambda part: lambda: sum(split.require_both(parts.where(F.col("part") != part)))
    cases = {
        "missing file": (read(nowhere), nowhere), "empty file": (read(empty), empty), "unknown headers": (read(unnamed), unnamed), "no readable time": (read(timeless), timeless),
        "some unreadable times": (read(mixed), mixed), "dry run": (dry, mixed), "nothing to learn from": (learn("train"), None), "nothing to score": (learn("test"), None),
        "both parts": (learn("val"), None),
    }
    rows = [(case, *_told(check, path)) for case, (check, path) in cases.items()]  # a row a case
    discard(*[spark.read.text(path) for path in (unnamed, timeless, mixed)])
    return spark.createDataFrame(rows, "case string, error string, message string, events long")
