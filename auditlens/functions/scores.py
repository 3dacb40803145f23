"""Score and signal expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EPSILON, SIGMAS


def deviation(value: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in sigmas, linear, 1 from ``SIGMAS`` on.

    Rounded to 12 places, so that the order in which tasks add up a baseline does not show.
    """
    return F.round(F.least(F.abs(value - mean) / (std + EPSILON) / SIGMAS, F.lit(1.0)), 12)


def count_true(*conditions: Column) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + F.when(c, 1).otherwise(0)
    return total.cast("long")


# fixed values: the names of signals and the texts of explanations below are those of the reports
def joined(parts: list[tuple[Column, str]], separator: str) -> Column:
    """The texts whose condition holds, joined in order; empty if none."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in parts])), separator)


def lifecycle_signals(struct: Column, rarity: Column, duration: Column, length: Column, context: Column) -> Column:
    return count_true(struct == 1.0, (rarity > 0.8) & (struct < 0.5), (duration > 0.8) & (struct < 0.5), context > 0, length > 0.8)


def lifecycle_explanation(struct: Column, duration: Column, context: Column) -> Column:
    text = joined([(struct > 0.5, "unseen sequence"), (duration > 0.5, "unusual timing"), (context > 0.5, "cross-boundary context shift")], " and ")
    return F.when(text == "", F.lit("Minor deviation.")).otherwise(F.concat(F.lit("CorrelationId exhibited "), text))


def session_signals(op: Column, ip: Column, activity: Column, hour: Column, scope: Column) -> Column:
    """``scope``: the greatest of the provider, subscription, group and type flags."""
    return count_true(op > 0, ip > 0, activity > 0.8, hour > 0.8, scope > 0)


def dominant_signal(op: Column, ip: Column, activity: Column, hour: Column, scope: Column) -> Column:
    """The strongest signal that fired; of equals the first in this order."""
    fired = [
        (F.when(op > 0, op), "New Operations"),
        (F.when(ip > 0, ip), "New IP"),
        (F.when(activity > 0.8, activity), "Activity Spike"),
        (F.when(hour > 0.8, hour), "Hour Deviation"),
        (F.when(scope > 0, scope), "Context/Role Expansion"),
    ]
    top = F.greatest(*[v for v, _ in fired])
    out = F.lit("None")
    for value, name in reversed(fired):
        out = F.when(value == top, F.lit(name)).otherwise(out)
    return out


def session_explanation(op: Column, ip: Column, activity: Column, hour: Column) -> Column:
    text = joined([(op > 0, "new operations"), (ip > 0, "new IP"), (activity > 0.8, "volume spike"), (hour > 0.8, "unusual hour")], ", ")
    return F.when(text == "", F.lit("Minor deviation.")).otherwise(F.concat(F.lit("Caller session: "), text))
