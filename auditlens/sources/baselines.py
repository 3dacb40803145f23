"""A store of baselines by period: each new period reads its own events only.

A period (a day by default) has a folder with its states and with what every lifecycle that it touched had so far, so
that the next period's history goes on from there.  Folders never change.  A log of one row per change says which
count: a folder that is not in it, such as that of a job that broke off, is not there.  A log has one writer at a time.

* ``add`` takes periods in order; the newest one may be added again and then replaces itself.  ``add_all`` takes the
  periods of a table in one pass, however many: a step writes the states of all of them, a folder each.
* ``take_out`` removes what a period has contributed; lifecycles that began in it keep their history.
* ``compact`` writes the merged states once, and later versions start from them.
* ``states`` and ``model`` read any version of the log.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import model, sequence, split, states
from ..schema import BUCKET_US, DAY_US
from .shared import discard, written

_LOG = "version int, kind string, period long, folder string, period_us long"
#: Before all slices.
_FIRST = -(2**62)


class BaselineStore:
    def __init__(self, spark: SparkSession, path: str, period_us: int = DAY_US) -> None:
        if period_us <= 0 or period_us % BUCKET_US:
            raise ValueError("A period must be made of whole half hours, or sessions would lie in two.")
        self.spark, self.path, self.period_us = spark, path.rstrip("/"), period_us

    def entries(self, version: int | None = None) -> list[Row]:
        """Changes up to a version, in order; one row each."""
        try:
            rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log").orderBy("version").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            rows = []
        if any(r.period_us != self.period_us for r in rows):
            raise ValueError(f"The store at {self.path} has periods of another length.")
        return [r for r in rows if version is None or r.version <= version]

    def _record(self, known: list[Row], *versions: list[tuple[str, int | None, str]]) -> None:
        """Changes of one step are one file, so a reader sees all or none of them."""
        at = known[-1].version if known else 0
        rows = [(at + k, *change, self.period_us) for k, changes in enumerate(versions, 1) for change in changes]
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    @staticmethod
    def _active(known: list[Row]) -> dict[int, str]:
        """Folder of each period that counts."""
        held: dict[int, str] = {}
        for r in known:
            if r.kind == "add":
                held[r.period] = r.folder
            elif r.kind == "out" and held.get(r.period) == r.folder:
                del held[r.period]
        return held

    def _paths(self, folders, name: str) -> list[str]:
        """Where a table lies in each folder; a folder of several periods has one for each of them below the table."""
        split_up = [f.partition("/") for f in folders]
        return ["/".join(filter(None, [self.path, step, name, period])) for step, _, period in split_up]

    def periods(self, version: int | None = None) -> list[int]:
        return sorted(self._active(self.entries(version)))

    def _past(self, known: list[Row], before: int, ids: DataFrame) -> DataFrame | None:
        """What the lifecycles ``ids`` had before a period, from the newest earlier one that touched them; also from periods
        that have been taken out."""
        last = {r.period: r.folder for r in known if r.kind == "add" and r.period < before}
        if not last:
            return None
        held = self.spark.read.parquet(*self._paths(last.values(), "carry")).join(ids, "corr", "left_semi")
        newest = held.groupBy("corr").agg(F.max_by(F.struct("size", "first", "tail"), "period").alias("x"))
        return newest.select(F.lit("train").alias("part"), "corr", F.lit(_FIRST).alias("slice"), "x.*")

    def _ready(self, known: list[Row], period: int) -> None:
        last = max((r.period for r in known if r.kind == "add"), default=None)
        if last is not None and period < last:
            raise ValueError(f"Period {period} lies before period {last}, which the store has; histories go on in order.")

    def _put(self, known: list[Row], events: DataFrame, length: int, folder: str, first: int, by: str | None = None) -> None:
        """Write the states of ``events``, whose periods begin with ``first``; with ``by`` a folder for each value of that column."""
        period = F.floor(F.col("t_us") / self.period_us).cast("long")
        rows = written(sequence.in_slices(events.withColumn("part", F.lit("train")).withColumn("period", period), length, self.period_us), "rows")
        slices = sequence.summaries(rows).withColumn("period", F.floor(F.col("first") / self.period_us).cast("long"))
        past = self._past(known, first, rows.select("corr").distinct())
        if past is not None:
            slices = slices.unionByName(past.withColumn("period", F.lit(None).cast("long")))
        slices = written(slices, "slices")
        history = written(sequence.with_history(rows, slices.drop("period")).select("period", *model.NGRAM, "elapsed", "idx"), "history")

        def put(df: DataFrame, name: str) -> None:
            writer = df.write.partitionBy(by) if by else df.write
            writer.parquet(f"{self.path}/{folder}/{name}")

        ends = sequence.ends_of_periods(slices)
        put(ends.withColumn(by, F.col("period")) if by else ends, "carry")
        if by:
            rows, history = rows.withColumn(by, F.col("period")), history.withColumn(by, F.col("period"))
        for name, state in states.of_events(history, rows, *([by] if by else [])).items():
            put(state, name)
        discard(rows, slices, history)

    def _bounds(self, events: DataFrame) -> tuple[int | None, int | None, int]:
        """Ends of the span and the length of a slice, by one job: a period, if no lifecycle has more events in one than a
        slice is meant to have; else as in an analysis."""
        time = F.col("t_us")
        hours = events.groupBy("corr", F.floor(time / self.period_us).alias("period"), F.floor(time / split.SLICE_US)).agg(F.min(time).alias("low"), F.max(time).alias("high"), F.count("*").alias("n"))
        periods = hours.groupBy("corr", "period").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("hour"), F.sum("n").alias("n"))
        low, high, hour, most = periods.agg(F.min("low"), F.max("high"), F.coalesce(F.max("hour"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        return low, high, self.period_us if most <= sequence.MOST else sequence.slice_length(hour)

    def add(self, events: DataFrame, period: int) -> None:
        """Canonical events of one period (their time divided by its length); none are a period without events."""
        known = self.entries()
        self._ready(known, period)
        low, high, length = self._bounds(events)
        if low is not None and {low // self.period_us, high // self.period_us} != {period}:
            raise ValueError(f"There are events outside period {period}.")
        # a new folder for each attempt: one that broke off stays out of the log
        folder = f"period-{period}-{uuid.uuid4().hex}"
        self._put(known, events, length, folder, period)
        self._record(known, self._changes(known, period, folder))

    def _changes(self, known: list[Row], period: int, folder: str) -> list[tuple[str, int | None, str]]:
        old = self._active(known).get(period)
        return [*([("out", period, old)] if old else []), ("add", period, folder)]

    def add_all(self, events: DataFrame) -> None:
        """All periods of ``events`` in order, a version each: one pass, in which all periods are added or none."""
        known = self.entries()
        low, _, length = self._bounds(events)
        if low is None:
            return
        first = low // self.period_us
        self._ready(known, first)
        folder = f"periods-{uuid.uuid4().hex}"
        self._put(known, events, length, folder, first, "of")
        found = self.spark.read.parquet(f"{self.path}/{folder}/carry").select("period").distinct().orderBy("period").collect()  # a row per period
        self._record(known, *[self._changes(known, r.period, f"{folder}/of={r.period}") for r in found])

    def take_out(self, period: int) -> None:
        known = self.entries()
        folder = self._active(known).get(period)
        if folder is None:
            raise ValueError(f"The store at {self.path} has no period {period}.")
        self._record(known, [("out", period, folder)])

    def compact(self) -> None:
        known = self.entries()
        if not known:
            return
        folder = f"all-{uuid.uuid4().hex}"
        for name, state in self.states().items():
            state.write.parquet(f"{self.path}/{folder}/{name}")
        self._record(known, [("all", None, folder)])

    def states(self, version: int | None = None) -> dict[str, DataFrame]:
        """Merged states of a version: the last compact one before it and what has come or gone since."""
        known = self.entries(version)
        start = max((i for i, r in enumerate(known) if r.kind == "all"), default=-1)
        signs: dict[str, int] = {known[start].folder: 1} if start >= 0 else {}
        for r in known[start + 1 :]:
            signs[r.folder] = signs.get(r.folder, 0) + (1 if r.kind == "add" else -1)
        groups = {sign: [f for f, s in signs.items() if s == sign] for sign in (1, -1)}
        if not groups[1]:
            raise ValueError(f"The store at {self.path} holds no period.")

        def read(name: str) -> DataFrame:
            parts = [self.spark.read.parquet(*self._paths(folders, name)).withColumn("sign", F.lit(sign)) for sign, folders in groups.items() if folders]
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

        return {name: states.merged(name, read(name)) for name in states.TABLES}

    def model(self, version: int | None = None) -> model.Model:
        return states.baselines(self.states(version))
