"""Track A on a stream: lifecycles scored against saved baselines and closed by an event-time timer.

A keyed state per correlation id holds what comes next needs: the last four operations, first time,
position, both ends of ten operations, whether boundaries varied, and the events that the watermark has not passed yet, so that
arrival order does not matter.  Once the watermark passes an event it leaves with its history; a timer
closes the lifecycle when ``idle`` event time passed without one.  N-grams are a table that no task can hold,
so events are joined with it behind the state, in ``foreachBatch``; the running maxima of open lifecycles are a
table with a version per batch, made of the version before and the batch.  A batch that runs again overwrites
what it wrote, so a restart changes nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import lifecycle
from ..operators.lifecycle import ENDS
from ..operators.model import Model
from ..schema import HISTORY, MICROS, PAD

EVENT_OUT = "corr string, seq long, t_us long, op string, caller string, h1 string, h2 string, h3 string, h4 string, idx long, elapsed double"
CLOSED_OUT = "n long, first_t long, first_seq long, last_t long, first_caller string, context double, first_ops string, last_ops string"
SCORES = ["struct", "rarity", "dur_dev", "len_dev"]
_FIELDS = ["t_us", "seq", "op", "caller", "prov", "rg", "sub"]
_COLUMNS = [c.split()[0] for c in f"{EVENT_OUT}, {CLOSED_OUT}".split(", ")]


class _Open:
    """What is known of an open lifecycle; of bounded size but for the events within the lateness."""

    def __init__(self):
        self.pending: list[tuple] = []
        self.n, self.first, self.last, self.past = 0, None, 0, [PAD] * HISTORY
        self.head: list[str] = []
        self.tail: list[str] = []
        self.varied = False

    def take(self, before_us: int) -> Iterator[dict]:
        """Events before a time, in order, with their history."""
        ready = sorted(e for e in self.pending if e[0] < before_us)
        self.pending = [e for e in self.pending if e[0] >= before_us]
        for t, seq, op, caller, *bounds in ready:
            self.n += 1
            if self.first is None:
                self.first = (t, seq, caller, tuple(bounds))
            self.varied |= tuple(bounds) != self.first[3]
            self.last = max(self.last, t)
            yield {"seq": seq, "t_us": t, "op": op, "caller": caller, **{f"h{k}": self.past[-k] for k in range(1, HISTORY + 1)}, "idx": self.n, "elapsed": (t - self.first[0]) / MICROS}
            self.past = [*self.past[1:], op]
            self.head = [*self.head, op][:ENDS]
            self.tail = [*self.tail, op][-ENDS:]

    def closed(self) -> dict:
        t, seq, caller, _ = self.first
        return {"n": self.n, "first_t": t, "first_seq": seq, "last_t": self.last, "first_caller": caller, "context": float(self.varied), "first_ops": " -> ".join(self.head), "last_ops": " -> ".join(self.tail)}


def _steps(idle_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else _Open()
        if not state.hasTimedOut:
            for p in parts:
                held.pending += list(p[_FIELDS].itertuples(index=False, name=None))
        mark = state.getCurrentWatermarkMs()
        rows = list(held.take(mark * 1000))
        over = not held.pending and held.n and held.last // 1000 + idle_ms < mark
        if over:
            rows.append(held.closed())
            state.remove()
        else:
            state.update((pickle.dumps(held),))
            at = min(e[0] for e in held.pending) // 1000 + 1 if held.pending else held.last // 1000 + idle_ms + 1
            state.setTimeoutTimestamp(max(mark + 1, at))
        if rows:
            out = pd.DataFrame(rows).reindex(columns=_COLUMNS).astype(object)
            out["corr"] = key[0]
            yield out.where(out.notna(), None)

    return run


def with_history(events: DataFrame, late: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """Events with history once the watermark has passed them, and a row (``n`` not null) for each closed lifecycle."""
    timed = events.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", late)
    return timed.select("corr", *_FIELDS, "ts").groupBy("corr").applyInPandasWithState(
        _steps(idle_seconds * 1000), f"{EVENT_OUT}, {CLOSED_OUT}", "held binary", "append", GroupStateTimeout.EventTimeTimeout
    )


class LifecycleSink:
    """Scores batches of ``with_history`` and keeps two tables under ``path``: ``open`` (running maxima, a version
    per batch, the last two kept) and ``lifecycles`` (closed ones, a folder per batch)."""

    def __init__(self, path: str, model: Model):
        self.path, self.model = path, model

    def _folder(self, spark, *parts):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        m = self.model
        scored = lifecycle.score_events(rows.where("n is null"), m.ngrams, m.ngram_max, m.operations)
        new = scored.groupBy("corr").agg(*[F.max(c).alias(c) for c in SCORES])
        path, files = self._folder(spark, "open", f"version={batch_id - 1}")
        if files.exists(path):
            new = spark.read.schema(new.schema).parquet(path.toString()).unionByName(new).groupBy("corr").agg(*[F.max(c).alias(c) for c in SCORES])
        closed = rows.where("n is not null").drop(*[c.split()[0] for c in EVENT_OUT.split(", ")[1:]])
        done = closed.join(new, "corr")
        done = done.select(F.col("corr").alias("correlation_id"), F.col("first_caller").alias("caller"), "first_t", "first_seq", "last_t", F.col("n").alias("events"), *SCORES, "context", "first_ops", "last_ops")
        done.write.mode("overwrite").parquet(f"{self.path}/lifecycles/batch={batch_id}")
        new.join(closed.select("corr"), "corr", "left_anti").write.mode("overwrite").parquet(f"{self.path}/open/version={batch_id}")
        old, files = self._folder(spark, "open", f"version={batch_id - 2}")
        files.delete(old, True)
        rows.unpersist()


def score_lifecycles(events: DataFrame, model: Model, path: str, checkpoint: str, late: str = "10 minutes", idle_seconds: int = 86_400, **options) -> StreamingQuery:
    """Start a query that adds closed lifecycles to ``path/lifecycles``, with the columns of the batch scores."""
    out = with_history(events, late, idle_seconds).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return out.foreachBatch(LifecycleSink(path, model)).trigger(**(options or {"availableNow": True})).start()
