"""Which intervals of a group are open at once: a sweep over slices of time, without a join of intervals.

Two intervals meet when the later of the two begins, and part when the first of them ends.  So the pairs of two parties
and the time they share follow from how many intervals of each party are open when one begins or ends.  Begins
and ends of a party at one instant are one row with a count.  The rows of a group are cut into slices of at most ``bin_us``
and of some ``most`` rows; what each party has open at the begin of a slice, a row each, is carried by a window over
slices.  The work of a slice is its rows times the parties open in it, and never the pairs of intervals; a slice with
more than ``PARTIES`` parties is dealt as pairs of blocks of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MICROS
from ..sources.shared import discard, written

#: Longest slice; rows that a slice is meant to have; parties of a block.
BIN_US, MOST, PARTIES = 6 * 3600 * MICROS, 10_000, 256
#: Cells (rows by parties) that are held at once.
CELLS = 1 << 21
#: Times within a slice are summed in two parts.
BITS = 16


def lifecycle_spans(events: DataFrame) -> DataFrame:
    """``grp, party, id, begin, end``: when each lifecycle was open in a resource group, named by its first caller there."""
    by = events.groupBy(F.col("rg").alias("grp"), F.col("corr").alias("id"))
    return by.agg(F.min_by("caller", F.struct("t_us", "seq")).alias("party"), F.min("t_us").alias("begin"), F.max("t_us").alias("end"))


def _rows(spans: DataFrame, bin_us: int, most: int) -> DataFrame:
    """``grp, slice, party, kind, t, cnt, length``: begins (0) and ends (1) at ``t`` from the begin of their slice, and what was open before (-1)."""
    ends = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("t")) for kind, c in enumerate(("begin", "end"))])
    known = spans.where("grp is not null and party is not null and begin is not null")
    points = written(known.select("grp", "party", F.explode(ends).alias("x")).groupBy("grp", "party", "x.t", "x.kind").agg(F.count("*").alias("cnt")), "points")
    ranges = max(1, -(-points.count() // most))
    # which range a row is in is drawn by sampling, so it is written
    dealt = points.repartitionByRange(ranges, "grp", "t").withColumn("range", F.spark_partition_id())
    placed = written(dealt.withColumn("bin", F.floor(F.col("t") / bin_us)), "placed")
    discard(points)
    line = Window.partitionBy("grp").orderBy("from")  # a row per slice
    slices = placed.groupBy("grp", "bin", "range").agg(F.min("t").alias("from")).select("*", F.row_number().over(line).alias("slice"), F.lead("from").over(line).alias("until"))
    rows = placed.join(slices, ["grp", "bin", "range"])
    steps = rows.groupBy("grp", "party", "slice").agg(F.sum(F.when(F.col("kind") == 0, F.col("cnt")).otherwise(-F.col("cnt"))).alias("step"))
    order = Window.partitionBy("grp", "party").orderBy("slice")
    held = steps.select("grp", "party", "slice", F.sum("step").over(order).alias("cnt"), F.lead("slice").over(order).alias("next")).where("cnt > 0")
    later = F.explode(F.sequence(F.col("slice") + 1, F.col("next"))).alias("slice")
    carried = held.select("grp", later, "party", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("t"), "cnt")
    both = rows.select("grp", "slice", "party", "kind", (F.col("t") - F.col("from")).alias("t"), "cnt").unionByName(carried)
    return both.join(slices.select("grp", "slice", F.coalesce(F.col("until") - F.col("from"), F.lit(0)).alias("length")), ["grp", "slice"])


def _met(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs that meet in a slice and the time that pairs share in it, by party.

    Times are summed as upper parts and lower ``BITS``, as the sum for millions of open intervals passes 64 bits.
    """
    rows = rows.sort_values(["t", "kind"])  # of one instant, begins before ends
    names, party = np.unique(rows["party"].to_numpy(dtype=object), return_inverse=True)
    kind, t, cnt = (rows[c].to_numpy(np.int64) for c in ("kind", "t", "cnt"))
    pairs, upper, lower = np.zeros((3, len(names), len(names)), np.int64)
    now = np.zeros(len(names), np.int64)
    change = np.where(kind == 1, -cnt, cnt)
    step = max(1, CELLS // len(names))
    for at in range(0, len(rows), step):
        p, k = party[at : at + step], slice(at, at + step)
        held = np.zeros((len(p), len(names)), np.int64)
        held[np.arange(len(p)), p] = change[k]
        held = np.cumsum(held, axis=0) + now
        now = held[-1].copy()
        # one party changes in a row; the others have as many open before as after it
        order = np.argsort(p, kind="stable")
        first = np.flatnonzero(np.diff(p[order], prepend=-1))
        begun, left = np.where(kind[k] == 0, cnt[k], 0), -change[k]
        for total, weight in ((pairs, begun), (upper, (t[k] >> BITS) * left), (lower, (t[k] & (1 << BITS) - 1) * left)):
            total[p[order][first]] += np.add.reduceat((weight[:, None] * held)[order], first, axis=0)
    a, b = np.triu_indices(len(names), 1)
    length = int(rows["length"].iloc[0])
    out = pd.DataFrame({"party_a": names[a], "party_b": names[b]})
    for c, total, until in (("pairs", pairs, 0), ("upper", upper, length >> BITS), ("lower", lower, length & (1 << BITS) - 1)):
        # what is open at the end of the slice parts there
        out[c] = (total + total.T)[a, b] + until * now[a] * now[b]
    low, high, block = rows["low"].iloc[0], rows["high"].iloc[0], np.zeros(len(names), np.int64)
    block[party] = rows["block"]
    kept = (np.minimum(block[a], block[b]) == low) & (np.maximum(block[a], block[b]) == high) & out[["pairs", "upper", "lower"]].any(axis=1)
    return out[kept].assign(grp=rows["grp"].iloc[0])[["grp", "party_a", "party_b", "pairs", "upper", "lower"]]


def open_together(spans: DataFrame, bin_us: int = BIN_US, most: int = MOST, parties: int = PARTIES) -> DataFrame:
    """``grp, party_a, party_b, pairs, shared_us``: intervals of different parties of a group that share an instant, with the
    time they share as a decimal, since the sum over all pairs may pass 64 bits."""
    rows = _rows(spans, bin_us, most)
    sizes = rows.select("grp", "slice", "party").distinct().groupBy("grp", "slice").agg(F.ceil(F.count("*") / parties).cast("int").alias("blocks"))
    dealt = rows.join(sizes, ["grp", "slice"]).withColumn("block", F.pmod(F.xxhash64("party"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")
    met = dealt.groupBy("grp", "slice", "low", "high").applyInPandas(_met, "grp string, party_a string, party_b string, pairs long, upper long, lower long")
    part = lambda c: F.sum(F.col(c).cast("decimal(19,0)"))
    shared = (part("upper") * F.lit(1 << BITS).cast("decimal(6,0)") + part("lower")).cast("decimal(38,0)")
    return met.groupBy("grp", "party_a", "party_b").agg(F.sum("pairs").alias("pairs"), shared.alias("shared_us")).where("pairs > 0")
