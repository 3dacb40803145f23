"""Ordered rules from scores to category, cause and confidence label.

Rules are data: a condition, a category and a cause with a place for the operation
it names.  They are read on rounded scores, as reports show them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(signals: Column, structural: Column) -> Column:
    """``structural``: whether the one signal is a first sight."""
    return (
        F.when(signals >= 2, F.lit("HIGH_CONFIDENCE"))
        .when((signals == 1) & structural, F.lit("LOW_CONFIDENCE"))
        .when(signals == 1, F.lit("MODERATE"))
        .otherwise(F.lit("UNCLASSIFIED"))
    )


def _decide(rules: list[tuple[Column, str, str]], named: Column) -> tuple[Column, Column]:
    category, cause = F.lit(rules[-1][1]), F.lit(rules[-1][2])
    for condition, label, text in reversed(rules[:-1]):
        before, mark, after = text.partition("{}")
        told = F.concat(F.lit(before), named, F.lit(after)) if mark else F.lit(text)
        category, cause = F.when(condition, F.lit(label)).otherwise(category), F.when(condition, told).otherwise(cause)
    return category, cause


def lifecycle() -> list[Column]:
    """``category, cause, uncertainty`` over the columns of a lifecycle alert."""
    struct, context = F.col("structural_violation"), F.col("context_inconsistency")
    slow, long = F.col("duration_deviation") > 0.8, F.col("length_deviation") > 0.8
    # fixed texts of the report
    rules = [
        (context > 0, "Lateral Boundary Crossing", "CorrelationId unexpectedly traversed distinct resource groups or providers during `{}`."),
        ((struct == 1.0) & slow, "Critical Deployment/Migration Shift", "Unseen sequence path combined with massive latency, likely indicating a failed backend deployment involving `{}`."),
        (struct == 1.0, "New Microservice Routine", "Strictly unseen workflow path to `{}`, likely an unmodeled script or manual intervention."),
        (slow, "Latency / Retry Loop", "Standard workflow path, but extreme timing delay indicative of a backend retry loop terminating at `{}`."),
        (long, "Stalled Operation", "Abnormal volume of events within the same CorrelationId cycle."),
        (F.lit(True), "Unclassified Structural Anomaly", "Sequence violates historical n-gram priors."),
    ]
    last_op = F.element_at(F.split("sequence_context", " -> "), -1)
    category, cause = _decide(rules, last_op)
    return [category.alias("category"), cause.alias("cause"), confidence(F.col("effective_signal_count"), struct == 1.0).alias("uncertainty")]


def session() -> list[Column]:
    """``category, cause, uncertainty`` over the columns of a session alert."""
    op, ip = F.col("new_op") == 1.0, F.col("new_ip") == 1.0
    old_op, old_ip = F.col("new_op") == 0.0, F.col("new_ip") == 0.0
    activity, hour = F.col("activity_dev"), F.col("hour_dev")
    scope = (F.col("new_rg") == 1.0) | (F.col("new_prov") == 1.0)
    # fixed texts of the report
    rules = [
        (ip & op & (activity > 0.5), "Possible Credential/Token Compromise", "Identity used a brand new IP to execute unseen operations (`{}`) at an unusually high volume."),
        (ip & old_op & (F.col("new_prov") == 0.0), "VPN / Routing Shift", "Identity executed standard business operations from a previously unseen IP space."),
        (op & (activity > 0.8) & old_ip, "Automation / Batch Script Change", "Massive volume spike of unseen operations (`{}`) from a known IP, indicating a cron job or automation change."),
        (scope & old_ip, "RBAC Role Expansion", "Identity began operating in previously unseen resource groups or providers, suggesting a recent permissions grant."),
        ((hour > 0.8) & op, "Off-Hours Deviation", "Identity executed unseen operations during an historically inactive hour."),
        (F.lit(True), "Unclassified Behavioral Drift", "Session deviates from standard historical actor baseline."),
    ]
    first_op = F.element_at(F.split("session_context", ", "), 1)
    category, cause = _decide(rules, first_op)
    return [category.alias("category"), cause.alias("cause"), confidence(F.col("effective_signal_count"), op).alias("uncertainty")]
