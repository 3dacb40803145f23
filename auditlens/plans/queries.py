"""Registered queries over the activity view of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import carry, evaluate, generations, lifecycle, model, overlap, packet, session, sketches, split, subtotals
from ..schema import DAY_US, DIMENSIONS, LIFECYCLE_ALERT, SESSION_ALERT
from ..sources.activity_csv import load_events
from ..sources.baselines import BaselineStore
from ..sources.events_view import activity, verdicts
from ..sources.feedback import FeedbackStore
from ..sources.shared import shared_path, written
from . import artefacts
from .analyze import Analysis

A = [*LIFECYCLE_ALERT, "csv_pos"]
B = [*SESSION_ALERT, "csv_pos"]
TOLD = ["category", "cause", "uncertainty"]


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty, blank and padded cells made from the event table, through the default rules."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 5
    cell = F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, " \t ").otherwise(F.concat(F.lit("\t "), "event_type", F.lit(" ")))
    first = F.when(kind == 0, F.lit(None)).when(kind == 1, "").otherwise(" first")
    other = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("seq"), text.first_filled(cell).alias("name"), text.first_filled(first, other).alias("chained"))


def _as_csv(rows: DataFrame, name: str) -> str:
    """Rows written as CSV files with headers, white space and empty cells kept."""
    path = shared_path(rows.sparkSession, name)
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def _ingest_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export in the generic layout made from the event table: times as numbers or ISO texts, unreadable times,
    quoted commas, quotes and line breaks, null, empty and blank cells, headers to normalise; read as any export."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    odd = F.when(n % 5 == 0, ', "x"/w').when(n % 5 == 1, "\nline/w").otherwise("/write")
    rows = e.select(
        F.when(n % 11 == 0, "n/a").when(n % 7 == 0, "").otherwise((t / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(20,6)").cast("string")).alias(" Timestamp Epoch"),
        F.concat("event_type", odd).alias("Operation"),
        F.when(n % 3 == 1, "").when(n % 3 == 2, " \t ").alias("Provider"),
        F.concat(F.lit("  user-"), F.col("user_id").cast("string"), F.lit(" ")).alias("Caller"),
        F.when(n % 2 == 0, "10.0.0.1").alias("Caller-IP"),
        F.lit("sub").alias("subscriptionId"),
        F.when(n % 4 == 0, "").otherwise("Rg").alias("Resource Group"),
        F.when(n % 6 == 0, " type ").alias("resource_type"),
        F.concat(F.lit("c-"), F.col("user_id").cast("string")).alias("Correlation-ID"),
        F.when(n % 11 == 0, "not a time").when(n % 7 == 0, iso).alias("timestamp"),
    )
    return load_events(spark, _as_csv(rows, "generic")).drop("seq")


def _ingest_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export in the native layout made from the event table, with columns of the generic one that are to be ignored."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = e.select(
        F.when(n % 13 == 0, "").when(n % 2 == 0, F.concat(iso, F.lit("+00:00"))).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z"))).alias("TimeGenerated"),
        F.concat(F.lit("app/"), "event_type", F.when(n % 3 == 0, "/read").otherwise("")).alias("OperationNameValue"),
        F.lit("prov").alias("ResourceProviderValue"),
        F.col("user_id").cast("string").alias("Caller"),
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("CorrelationId"),
        F.lit("ignored").alias("resource_type"),
        F.lit("5").alias("timestamp_epoch"),
        F.lit("ignored").alias("operation"),
        F.lit("ignored").alias("correlation_id"),
    )
    return load_events(spark, _as_csv(rows, "native")).drop("seq")


def _parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the event table as texts of many forms, readable or not, and back to microseconds."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    form = lambda pattern: F.date_format("ts", pattern)
    full = form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    forms = [full, F.concat(full, F.lit("Z")), F.concat(full, F.lit("+02:00")), form("yyyy-MM-dd HH:mm:ss"), form("yyyy-MM-dd"), form("yyyyMMdd'T'HHmmss"), form("yyyy-MM-dd'T'HH"), form("yyyy"), F.lit("not a time"), F.concat(F.lit(" "), full)]
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(20,6)").cast("string")
    numbers = [seconds, F.substring_index(seconds, ".", 1), F.lit("nan"), F.lit("1.5d"), F.lit(" 12.25 "), F.lit("1e3"), F.lit("")]
    pick = lambda some: F.element_at(F.array(*some), (n % len(some) + 1).cast("int"))
    return e.select(n.alias("seq"), times.iso_us(pick(forms)).alias("iso_us"), times.epoch_us(pick(numbers)).alias("number_us"))


def feedback_append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of the label table appended in bulk to a new store in the shared folder, twice, and read back; ids and times
    differ by run and are left out."""
    store, rows = FeedbackStore(spark, shared_path(spark, "feedback")), verdicts(spark, sf_dir)
    told = rows.select("alert_id", "track", "decision", F.concat(F.lit("label of "), "bucket").alias("reason"), F.when(F.col("decision") != "UNREVIEWED", "CERTAIN").alias("confidence"))
    store.append_all(told.where("track = 'A'"))
    store.append_all(told.where("track = 'B'").withColumn("analyst_id", F.lit("second")).withColumn("fn_source", F.lit("ticket")))
    return store.read().drop("id", "timestamp", "reviewed_at")


CALLER, TIME, TIE = ["caller"], "t_us", "seq"


def _last_other_address(a: Analysis) -> DataFrame:
    rows = a.events.select("seq", "caller", "t_us", "ip")
    out = carry.last_from_other(rows, "ip", CALLER, TIME, TIE, carry.length_for(rows, CALLER, TIME))
    return out.select("seq", F.col("other.seq").alias("other_seq"), F.col("other.ip").alias("other_ip"), (F.col("t_us") - F.col("other.t_us")).alias("since_us"))


def _errors_as_of_purchases(a: Analysis) -> DataFrame:
    """Each error with its caller's last purchase at or before it."""
    rows = a.events.select("seq", "caller", "t_us", "prov", "op")
    left, right = rows.where("prov = 'APP.ERROR'"), rows.where("prov = 'APP.PURCHASE'")
    out = carry.as_of(left, right.select("caller", "t_us", "seq", "op"), CALLER, TIME, TIE, "last", carry.length_for(rows, CALLER, TIME))
    return out.select("seq", F.col("last.seq").alias("last_seq"), F.col("last.op").alias("last_op"), (F.col("t_us") - F.col("last.t_us")).alias("since_us"))


def _gap_sessions(a: Analysis) -> DataFrame:
    rows = a.events.select("caller", "t_us", "seq")
    return carry.gap_sessions(rows, CALLER, TIME, TIE, carry.length_for(rows, CALLER, TIME))


def _events_before(a: Analysis) -> DataFrame:
    """Events of the caller in the half hour up to each event, and the highest operation name in it."""
    rows = a.events.select("seq", "caller", "t_us", "op")
    return carry.within_before(rows, CALLER, TIME, TIE, carry.GAP_US, {"events": F.count("*"), "last_op": F.max("op")}, 4).select("seq", "events", "last_op")


def _open_together(a: Analysis) -> DataFrame:
    """Lifecycles that are open at once; the shared time is a long, as in the SQL, unless a sum passes 64 bits, where the SQL ends in an error."""
    met = written(overlap.open_together(overlap.lifecycle_spans(a.events)), "met")  # a row per group and two parties
    fits = met.where(F.col("shared_us") > F.lit(2**63 - 1)).isEmpty()
    return met.withColumn("shared_us", F.col("shared_us").cast("long")) if fits else met


#: Days of a period of the stored baselines in the queries.
DAYS = 10


def _stored(a: Analysis) -> model.Model:
    """Baselines of all events, added by period, compacted, and then without the second period."""
    store = BaselineStore(a.events.sparkSession, shared_path(a.events.sparkSession, "baselines"), DAYS * DAY_US)
    store.add_all(a.events)
    store.compact()
    store.take_out(store.periods()[1])
    return store.model()


def _stored_callers(a: Analysis) -> DataFrame:
    """Stored baselines of each caller, with the number of values of each dimension it has used."""
    kept = _stored(a)
    used = kept.seen.groupBy("caller").agg(*[F.count_if(F.col("dim") == d).alias(f"{d}_values") for d in DIMENSIONS])
    return kept.callers.select("caller", *_six("rate_mean", "rate_std", "hour_mean")).join(used, "caller")


def _changes(a: Analysis) -> DataFrame:
    """N-grams of the training part against those of the test part."""
    return generations.ngram_changes(a.ngrams, model.ngrams(a.test_history))


def _drift(a: Analysis) -> DataFrame:
    return generations.caller_drift(_changes(a)).withColumn("divergence", F.round("divergence", 6))


def _shift(a: Analysis) -> DataFrame:
    moved = generations.operation_shift(a.operations, model.operations(a.test_history))
    return moved.select("op", "change", *_six("dur_shift", "idx_shift"))


def _outcomes(a: Analysis) -> DataFrame:
    return subtotals.diagnosed(a.lifecycle_rows, session.with_signals(a.sessions))


def _distincts(a: Analysis) -> DataFrame:
    """Distinct values of each operation by sketches of days, merged, beside the exact counts."""
    days = sketches.daily(a.rows)
    return sketches.check_distincts(sketches.distincts(sketches.merged(days, "op"), "op"), a.rows)


def _quantiles(a: Analysis) -> DataFrame:
    """Quantiles of elapsed times of each operation by sketches of days, merged, and whether their ranks are right."""
    days = sketches.daily(a.history, "elapsed")
    return sketches.check_quantiles(sketches.quantiles(sketches.merged(days, "op"), "op"), a.history, "elapsed")


def _on(function: Callable[[Analysis], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(Analysis(activity(spark, sf_dir)))


def _session_flags(a: Analysis) -> DataFrame:
    return a.sessions.select("caller", "bucket", "new_op", "new_prov", "new_sub", "new_rg", "new_type", "new_ip")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ingest_canonical": _on(lambda a: a.events),
    "ingest_derive_rtype": _on(lambda a: a.events.groupBy("op", "rtype").agg(F.count("*").alias("events"))),
    "ingest_defaults": _defaults,
    "ingest_csv_generic": _ingest_generic,
    "ingest_csv_native": _ingest_native,
    "parse_times": _parse_times,
    "time_bucket_30m": _on(lambda a: a.events.select("seq", times.bucket(F.col("t_us")).alias("bucket"))),
    "hour_of_day": _on(lambda a: a.events.select("seq", F.round(times.hour_of_day(F.col("t_us")), 6).alias("hour"))),
    "iso_range_format": _on(lambda a: a.events.select("seq", times.iso_range(F.col("t_us"), F.col("t_us") + 90_000_000).alias("window_text"))),
    "chrono_split_counts": _on(lambda a: split.counts(a.parts)),
    "chrono_split_rows": _on(lambda a: a.parts.select("seq", "part")),
    "ngram_history": _on(lambda a: a.history.select("seq", "part", "h1", "h2", "h3", "h4")),
    "lifecycle_position": _on(lambda a: a.history.select("seq", "idx", "n")),
    "lifecycle_elapsed": _on(lambda a: a.history.select("seq", *_six("elapsed"))),
    "model_ngram_counts": _on(lambda a: a.ngrams),
    "model_ngram_max": _on(lambda a: model.ngram_max(a.ngrams)),
    "model_op_duration": _on(lambda a: a.operations.select("op", *_six("dur_mean", "dur_std"))),
    "model_op_index": _on(lambda a: a.operations.select("op", *_six("idx_mean", "idx_std"))),
    **{
        f"model_seen_{'type' if d == 'rtype' else d}": _on(lambda a, d=d: a.seen.where(F.col("dim") == d).select("caller", "val"))
        for d in DIMENSIONS
    },
    "model_session_counts": _on(lambda a: model.train_sessions(a.train).select("caller", "bucket", "events", *_six("hour"))),
    "model_caller_baseline": _on(lambda a: a.callers.select("caller", *_six("rate_mean", "rate_std", "hour_mean"))),
    "score_event_structural": _on(lambda a: a.scored_events.select("seq", "struct")),
    "score_event_rarity": _on(lambda a: a.scored_events.select("seq", *_six("rarity"))),
    "score_event_duration": _on(lambda a: a.scored_events.select("seq", *_six("dur_dev"))),
    "score_event_length": _on(lambda a: a.scored_events.select("seq", *_six("len_dev"))),
    "lifecycle_first_caller": _on(lambda a: a.lifecycles.select("correlation_id", "caller")),
    "lifecycle_ops_first10": _on(lambda a: a.lifecycles.select("correlation_id", "first_ops")),
    "lifecycle_ops_last10": _on(lambda a: a.lifecycles.select("correlation_id", "last_ops")),
    "lifecycle_context": _on(lambda a: a.lifecycles.select("correlation_id", "context")),
    "lifecycle_scores": _on(lambda a: a.lifecycles.select("correlation_id", "caller", "first_t", "last_t", "events", "struct", *_six("rarity", "dur_dev", "len_dev"), "context")),
    "lifecycle_signals": _on(lambda a: lifecycle.with_signals(a.patterns).select("correlation_id", "total_score", "effective_signal_count")),
    "lifecycle_explanation": _on(lambda a: a.lifecycle_rows.select("correlation_id", "explanation")),
    "lifecycle_patterns": _on(lambda a: a.patterns.select("correlation_id", "caller", "last_ops", "struct", "context", "pattern_count")),
    "top20_total": _on(lambda a: lifecycle.top_total(a.lifecycle_rows).select(*A)),
    "top20_context": _on(lambda a: lifecycle.top_context(a.lifecycle_rows).select(*A)),
    "lifecycle_alerts": _on(lambda a: a.lifecycle_alerts.select(*A)),
    "session_new_entities": _on(_session_flags),
    "session_activity_dev": _on(lambda a: a.sessions.select("caller", "bucket", "events", *_six("activity_dev"))),
    "session_hour_dev": _on(lambda a: a.sessions.select("caller", "bucket", *_six("hour_dev"))),
    "session_scores": _on(
        lambda a: a.sessions.select(
            "caller", "bucket", "first_t", "last_t", "events", "new_op", "new_prov", "new_sub", "new_rg", "new_type", "new_ip", *_six("activity_dev", "hour_dev")
        )
    ),
    "session_dominant_signal": _on(lambda a: session.with_signals(a.sessions).select("caller", "bucket", "total_score", "effective_signal_count", "dominant_signal")),
    "session_context": _on(lambda a: session.first_operations(a.test)),
    "session_alerts_top100": _on(lambda a: a.session_alerts.select(*B)),
    "diagnose_lifecycle": _on(lambda a: a.lifecycle_alerts.select("correlation_id", *packet.diagnosis.lifecycle())),
    "diagnose_session": _on(lambda a: a.session_alerts.select("csv_pos", "caller", *packet.diagnosis.session())),
    "packet_queue_a1": _on(lambda a: packet.queue_a1(a.lifecycle_alerts).select("number", *A, *TOLD)),
    "packet_queue_a2": _on(lambda a: packet.queue_a2(a.lifecycle_alerts).select("number", *A, *TOLD)),
    "packet_queue_b": _on(lambda a: packet.queue_b(a.session_alerts).select("number", *B, *TOLD)),
    "component_percentiles": _on(lambda a: evaluate.component_percentiles(a.lifecycles)),
    "manifest_counts": _on(lambda a: a.manifest),
    "verdict_effectiveness": lambda spark, sf_dir: evaluate.verdict_effectiveness(verdicts(spark, sf_dir)),
    "next_op_topk_accuracy": _on(lambda a: evaluate.next_op_accuracy(a.ngrams, a.test_history)),
    "new_entity_listing": _on(lambda a: session.new_values(a.test, a.seen)),
    "asof_last_other_address": _on(_last_other_address),
    "asof_error_last_purchase": _on(_errors_as_of_purchases),
    "gap_sessions": _on(_gap_sessions),
    "range_frame_half_hour": _on(_events_before),
    "lifecycles_open_together": _on(_open_together),
    "feedback_append_roundtrip": feedback_append_roundtrip,
    "artefacts_roundtrip": lambda spark, sf_dir: artefacts.roundtrip(activity(spark, sf_dir)),
    "input_guards": lambda spark, sf_dir: artefacts.guards(activity(spark, sf_dir)),
    "baselines_merged_ngrams": _on(lambda a: _stored(a).ngrams),
    "baselines_merged_operations": _on(lambda a: _stored(a).operations.select("op", *[F.round(c, 3).alias(c) for c in ("dur_mean", "dur_std")], *_six("idx_mean", "idx_std"))),
    "baselines_merged_callers": _on(_stored_callers),
    "generation_ngram_changes": _on(_changes),
    "generation_caller_drift": _on(_drift),
    "generation_seen_changes": _on(lambda a: generations.seen_changes(a.seen, model.seen(a.test))),
    "generation_operation_shift": _on(_shift),
    "outcomes_by_cause": _on(lambda a: subtotals.by_cause(_outcomes(a))),
    "outcomes_by_confidence": _on(lambda a: subtotals.by_confidence(_outcomes(a))),
    "verdict_cube": lambda spark, sf_dir: subtotals.verdict_cube(verdicts(spark, sf_dir)),
    "sketch_distincts": _on(_distincts),
    "sketch_elapsed_quantiles": _on(_quantiles),
}
