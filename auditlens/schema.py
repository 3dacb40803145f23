"""Column layouts, thresholds and fixed labels of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("t_us", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("op", "prov", "caller", "ip", "sub", "rg", "rtype", "corr")]
)
DIMENSIONS = ("op", "prov", "sub", "rg", "rtype", "ip")
UNKNOWN = "UNKNOWN"

#: Header sets (after normalisation) by which an export is recognised; the native one wins.
NATIVE_REQUIRED = {"timegenerated", "operationnamevalue", "caller", "correlationid"}
GENERIC_REQUIRED = {"timestamp_epoch", "operation", "caller", "correlation_id"}

TRAIN_SHARE, TEST_SHARE = 0.70, 0.85
MICROS = 1_000_000
BUCKET_US = 1800 * MICROS
DAY_US = 86_400 * MICROS
HISTORY = 4
PAD = "START"
#: Deviations are linear in sigmas and reach 1 at this many.
SIGMAS = 5.0
EPSILON = 1e-6
TOP_TOTAL, TOP_CONTEXT, TOP_SESSIONS, QUEUE = 20, 20, 100, 20

# fixed values: columns of the two alert tables and of the verdict store, and the values its columns can have
LIFECYCLE_ALERT = [
    "timestamp_range", "caller", "correlation_id", "total_score", "effective_signal_count", "pattern_count",
    "structural_violation", "sequence_rarity", "duration_deviation", "length_deviation", "context_inconsistency",
    "explanation", "sequence_context",
]
SESSION_ALERT = [
    "timestamp_range", "caller", "total_score", "effective_signal_count", "dominant_signal", "new_op", "new_prov",
    "new_sub", "new_rg", "new_type", "new_ip", "activity_dev", "hour_dev", "explanation", "session_context",
]

DECISIONS = ("BENIGN_FALSE_POSITIVE", "CONFIRMED_ANOMALY", "UNREVIEWED")
TRACKS = ("A", "B")
CONFIDENCES = ("CERTAIN", "PROBABLE", "UNCERTAIN")
FEEDBACK = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("alert_id", T.StringType(), False),
    T.StructField("track", T.StringType(), False),
    T.StructField("decision", T.StringType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("analyst_id", T.StringType(), False),
    T.StructField("reviewer_count", T.IntegerType()),
    T.StructField("reviewer_ids", T.StringType(), False),
    T.StructField("confidence", T.StringType()),
    T.StructField("fn_source", T.StringType()),
    T.StructField("reviewed_at", T.TimestampType(), False),
    T.StructField("disagreement_flag", T.IntegerType()),
])
