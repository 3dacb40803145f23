"""Review queues over the alert tables, and the Markdown packet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import diagnosis
from ..schema import QUEUE


def _queue(rows: DataFrame, order: list, most: int = QUEUE) -> DataFrame:
    few = rows.orderBy(*order).limit(most)
    return few.withColumn("number", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _first() -> list:
    return [F.desc("total_score"), F.desc("timestamp_range"), "csv_pos"]


def queue_a1(alerts: DataFrame) -> DataFrame:
    """Best total; of equals the latest window text, then file order."""
    return _queue(alerts, _first()).select("*", *diagnosis.lifecycle())


def queue_a2(alerts: DataFrame) -> DataFrame:
    """Rows with context that the first queue has not taken; an alert table is small, so one window over it tells."""
    first = F.row_number().over(Window.orderBy(*_first()))
    rest = alerts.withColumn("first", first).where((F.col("context_inconsistency") > 0) & (F.col("first") > QUEUE)).drop("first")
    return _queue(rest, [F.desc("context_inconsistency"), F.desc("total_score"), "csv_pos"]).select("*", *diagnosis.lifecycle())


def queue_b(alerts: DataFrame) -> DataFrame:
    return _queue(alerts, ["csv_pos"]).select("*", *diagnosis.session())


# fixed values: titles, section texts and score labels of the packet
_TITLE = """# Diagnosed Analyst Review Packet

This packet maps raw anomaly scores into deterministic operational causal categories for SOC triage. Two independent review queues are provided for Track A."""
_SECTIONS = {
    "A1": ("Track A — Queue 1: Top 20 by Total Score", "Structural workflow violations or extreme timing deviations within a single backend operation lifecycle."),
    "A2": ("Track A — Queue 2: Top 20 by Context Inconsistency", "CorrelationIds that traversed distinct resource groups or subscriptions — a distinct cross-boundary anomaly axis, evaluated independently of sequence structure."),
    "B": ("Track B — Caller 30-Minute Session Drift", "Identity-centric behavioral drift: net-new access patterns or volume spikes over a 30-minute window."),
}
_SCORES_A = [("Total", "total_score"), ("Eff. Signals", "effective_signal_count"), ("Pattern Instances", "pattern_count"), ("Struct", "structural_violation"), ("Rarity", "sequence_rarity"), ("Duration", "duration_deviation"), ("Length", "length_deviation"), ("Context", "context_inconsistency")]
_SCORES_B = [("Total", "total_score"), ("Eff. Signals", "effective_signal_count"), ("Dominant Signal", "dominant_signal"), ("New Ops", "new_op"), ("New IP", "new_ip"), ("New RG", "new_rg"), ("Act Spike", "activity_dev"), ("Hour Dev", "hour_dev")]


def render(lifecycle_alerts: DataFrame, session_alerts: DataFrame) -> str:
    """The packet as text; the three queues are at most ``QUEUE`` rows each."""
    queues = {"A1": (queue_a1(lifecycle_alerts), "correlation_id", _SCORES_A), "A2": (queue_a2(lifecycle_alerts), "correlation_id", _SCORES_A), "B": (queue_b(session_alerts), "caller", _SCORES_B)}
    out = [_TITLE]
    for name, (rows, subject, scores) in queues.items():
        found = rows.orderBy("number").collect()
        if name == "A2" and not found:
            continue
        title, about = _SECTIONS[name]
        out.append(f"\n---\n\n## {title}\n{about}")
        for r in found:
            told = " | ".join(f"{label} `{r[column]}`" for label, column in scores)
            out.append(
                f"\n### {name}-{r['number']}. `{r[subject]}`\n**Window:** {r['timestamp_range']}\n**Uncertainty:** {r['uncertainty']}\n"
                f"**Category:** {r['category']}\n**Cause:** {r['cause']}\n**Scores:** {told}"
            )
    return "\n".join(out)
