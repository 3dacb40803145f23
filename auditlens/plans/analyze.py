"""The whole analysis as one plan, and its artefacts."""

from __future__ import annotations

import datetime
import logging
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, lifecycle, model, packet, sequence, session, split
from ..schema import LIFECYCLE_ALERT, SESSION_ALERT, TOP_CONTEXT, TOP_SESSIONS, TOP_TOTAL
from ..sources import sinks
from ..sources.activity_csv import load_events
from ..sources.shared import discard, written

log = logging.getLogger(__name__)


@dataclass
class Analysis:
    """Tables of an analysis of canonical events; each is planned when asked for.

    ``events`` is read at most three times: for three numbers (``bounds``), once into ``rows`` and once
    into ``sliced``, tables of the shared folder with a folder per part that all later steps read.  With
    ``baselines`` nothing is learnt and all events are scored against them.
    """

    events: DataFrame
    baselines: model.Model | None = None

    @cached_property
    def bounds(self) -> split.Bounds:
        return split.bounds(self.events)

    @cached_property
    def parts(self) -> DataFrame:
        return self.events.withColumn("part", F.lit("test")) if self.baselines else split.labelled(self.events, self.bounds)

    @cached_property
    def sliced(self) -> DataFrame:
        return written(sequence.in_slices(self.parts, sequence.slice_length(self.bounds.fullest)), "sliced", "part")

    @cached_property
    def rows(self) -> DataFrame:
        """Events of both parts; ``sliced`` has them too, if it is there already."""
        return self.sliced if "sliced" in self.__dict__ else written(self.parts.where("part <> 'val'"), "rows", "part")

    @cached_property
    def history(self) -> DataFrame:
        return sequence.with_history(self.sliced)

    @cached_property
    def train(self) -> DataFrame:
        return self.rows.where("part = 'train'")

    @cached_property
    def test(self) -> DataFrame:
        return self.rows.where("part = 'test'")

    @cached_property
    def test_history(self) -> DataFrame:
        return self.history.where("part = 'test'")

    @cached_property
    def ngrams(self) -> DataFrame:
        return self.baselines.ngrams if self.baselines else written(model.ngrams(self.history.where("part = 'train'")), "ngrams")

    @cached_property
    def operations(self) -> DataFrame:
        return self.baselines.operations if self.baselines else model.operations(self.history.where("part = 'train'"))

    @cached_property
    def seen(self) -> DataFrame:
        return self.baselines.seen if self.baselines else model.seen(self.train)

    @cached_property
    def callers(self) -> DataFrame:
        return self.baselines.callers if self.baselines else model.callers(model.train_sessions(self.train))

    @cached_property
    def model(self) -> model.Model:
        return self.baselines or model.Model(self.ngrams, model.ngram_max(self.ngrams), self.operations, self.seen, self.callers)

    @cached_property
    def scored_events(self) -> DataFrame:
        most = self.baselines.ngram_max if self.baselines else model.ngram_max(self.ngrams)
        return lifecycle.score_events(self.test_history, self.ngrams, most, self.operations)

    @cached_property
    def lifecycles(self) -> DataFrame:
        return written(lifecycle.score_lifecycles(self.scored_events), "lifecycles")

    @cached_property
    def patterns(self) -> DataFrame:
        return written(lifecycle.patterns(self.lifecycles), "patterns")

    @cached_property
    def lifecycle_rows(self) -> DataFrame:
        return lifecycle.alert_rows(lifecycle.with_signals(self.patterns))

    @cached_property
    def lifecycle_alerts(self) -> DataFrame:
        return written(lifecycle.alerts(self.lifecycle_rows), "lifecycle-alerts")  # at most 40 rows

    @cached_property
    def sessions(self) -> DataFrame:
        return session.score_sessions(self.test, self.seen, self.callers)

    @cached_property
    def best_sessions(self) -> DataFrame:
        return written(session.best(self.sessions), "best-sessions")  # at most 100 rows

    @cached_property
    def session_alerts(self) -> DataFrame:
        return session.alerts(self.best_sessions, self.test)

    @cached_property
    def manifest(self) -> DataFrame:
        lifecycles, patterns = self.lifecycles, self.patterns
        return evaluate.manifest(lifecycles, session.keys(self.test), patterns)

    def release(self) -> None:
        """Delete the tables of the shared folder; nothing lazy can be read any more."""
        held = {id(t): t for n in ("rows", "sliced", "ngrams", "lifecycles", "patterns", "lifecycle_alerts", "best_sessions") if (t := self.__dict__.pop(n, None)) is not None}
        discard(*[t for t in held.values() if not self.baselines or t is not self.baselines.ngrams])


def analyze(spark: SparkSession, path: str, output_dir: str, dry_run: bool = False, fmt: str = "csv", model_dir: str | None = None, use_model: str | None = None) -> Analysis | None:
    """Load, split, train, score, rank and write both alert tables, the manifest and the packet.

    With ``dry_run`` the input is checked and nothing is written.  With
    ``model_dir`` the baselines are saved there as Parquet.  With ``use_model`` all events are scored against
    baselines saved so, and nothing is learnt.  ``output_dir`` may be on any file system that Spark reaches.
    """
    events = load_events(spark, path, fmt, hold=not dry_run)
    if dry_run:
        log.info("%s events can be read; nothing is written in a dry run", f"{events.count():,}")
        return None
    run = Analysis(events, model.Model.load(spark, use_model) if use_model else None)
    if run.baselines:
        log.info("scoring all events against the baselines of %s", use_model)
    else:
        sliced = run.sliced
        discard(events)  # the slices have all that is read from here on
        train, test = split.require_both(sliced)
        log.info("learning from %s events, scoring %s", f"{train:,}", f"{test:,}")
    if model_dir:
        run.model.save(model_dir)
    for r in evaluate.component_percentiles(run.lifecycles).collect():
        log.info("%s p50/p90/p99: %s %s %s", *r)
    out = output_dir.rstrip("/")
    sinks.write_csv(run.lifecycle_alerts, f"{out}/top_lifecycle_anomalies.csv", LIFECYCLE_ALERT, TOP_TOTAL + TOP_CONTEXT)
    sinks.write_csv(run.session_alerts, f"{out}/top_actor_anomalies.csv", SESSION_ALERT, TOP_SESSIONS)
    counts = run.manifest.drop("context_nonzero").first().asDict()
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    sinks.write_json(spark, {"generated_utc": now} | counts, f"{out}/manifest.json")
    sinks.publish(spark, f"{out}/diagnosed_review_packet.md", packet.render(run.lifecycle_alerts, run.session_alerts))
    run.release()
    discard(events)
    return run
