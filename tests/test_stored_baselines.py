"""Stored baselines, generations, subtotals and sketches, against plain Python and a fit over all events."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditlens.cli import main
from auditlens.operators import generations, model, sequence, sketches, subtotals
from auditlens.schema import DAY_US, EVENT
from auditlens.sources import baselines
from auditlens.sources.baselines import BaselineStore

NAMES = EVENT.names


def rows(n=120, days=3, seed=3):
    """Events of some days with ties and lifecycles that go over midnight; one lifecycle has half of all rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.randrange(days) * DAY_US + 3_600_000_000 * rng.randrange(24)
        out.append((i, t, rng.choice(["A", "B", "C"]), "P", rng.choice("uv"), rng.choice(["1", "2", None]), "s", "r", "k", "hot" if i % 2 else f"c{rng.randrange(5)}"))
    return out


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(rows(), EVENT).repartition(2).cache()


def whole(events, *left_out):
    """Baselines of all events at once, without what the periods ``left_out`` have contributed."""
    parts = events.withColumn("part", F.lit("train"))
    history = sequence.with_history(sequence.in_slices(parts, 7 * 3_600_000_000))
    return model.fit(history.where(~F.floor(F.col("t_us") / DAY_US).isin(*left_out)) if left_out else history)


def same(got, want):
    for name in model.Model.TABLES:
        a, b = getattr(got, name), getattr(want, name)
        plain = lambda df: sorted((tuple(r) for r in df.select(*b.columns).collect()), key=repr)  # noqa: E731, B023
        a, b = plain(a), plain(b)
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert all(math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9) if isinstance(v, float) else u == v for u, v in zip(x, y)), (name, x, y)


@pytest.fixture(scope="module")
def store(spark, events, tmp_path_factory):
    out = BaselineStore(spark, str(tmp_path_factory.mktemp("store")))
    out.add_all(events)
    return out


def test_merged_days_equal_a_fit_over_all_of_them(store, events):
    assert store.periods() == [0, 1, 2]
    same(store.model(), whole(events))


def test_versions_take_out_and_compact(spark, store, events):
    store.compact()
    store.take_out(1)
    assert store.periods() == [0, 2]
    same(store.model(), whole(events, 1))  # taken out of the compact state
    same(store.model(version=3), whole(events))  # before the compact state was written
    # the newest day comes again: it replaces itself
    store.add(events.where(F.floor(F.col("t_us") / DAY_US) == 2), 2)
    assert store.periods() == [0, 2]
    same(store.model(), whole(events, 1))
    with pytest.raises(ValueError, match="no period"):
        store.take_out(1)
    with pytest.raises(ValueError, match="in order"):
        store.add(events.where("false"), 0)
    with pytest.raises(ValueError, match="outside"):
        store.add(events, 2)
    with pytest.raises(ValueError, match="another length"):
        BaselineStore(spark, store.path, 2 * DAY_US).periods()


@pytest.mark.parametrize("most", [1_000_000, 5])  # a slice is a period, or an hour
def test_all_periods_are_added_in_one_pass(spark, events, tmp_path, monkeypatch, most):
    tables, written = [], baselines.written
    monkeypatch.setattr(baselines, "written", lambda df, name, *by: tables.append(name) or written(df, name, *by))
    monkeypatch.setattr(sequence, "MOST", most)
    store, day = BaselineStore(spark, str(tmp_path)), F.floor(F.col("t_us") / DAY_US)
    store.add(events.where(day == 0), 0)
    tables.clear()
    store.add_all(events.where(day > 0))
    assert len(tables) == 3  # none for each period
    assert store.periods() == [0, 1, 2] and [r.version for r in store.entries()] == [1, 2, 3]
    same(store.model(), whole(events))
    # the next period goes on from what the pass has written
    store.add(events.where(day == 2), 2)
    same(store.model(), whole(events))


def test_a_day_that_broke_off_or_is_empty_changes_nothing(spark, store, events, monkeypatch):
    before = store.entries()

    def breaks(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(BaselineStore, "_record", breaks)
        with pytest.raises(RuntimeError):
            store.add(events.limit(0), 3)
    assert store.entries() == before
    store.add(events.limit(0), 3)
    same(store.model(), whole(events, 1))
    with pytest.raises(ValueError, match="half hours"):
        BaselineStore(spark, store.path, 1)
    with pytest.raises(ValueError, match="no period"):
        BaselineStore(spark, store.path + "-none").states()


def test_command_line(spark, tmp_path, capsys):
    export, where, saved = tmp_path / "in.csv", str(tmp_path / "kept"), str(tmp_path / "model")
    lines = [f"{day * 86_400 + k},op{k % 2},u,c{k % 3}" for day in (0, 1) for k in range(4)]
    export.write_text("\n".join(["timestamp_epoch,operation,caller,correlation_id", *lines]) + "\n")
    assert main(["baselines", "--store", where, "-i", str(export), "--take-out", "1970-01-02", "--model-dir", saved]) == 0
    assert "1 days count" in capsys.readouterr().out
    assert model.Model.load(spark, saved).ngrams.agg(F.sum("cnt")).first()[0] == 4
    assert main(["baselines", "--store", where, "--take-out", "1970-01-02"]) == 1
    assert "no period" in capsys.readouterr().err


def gram(caller, op, cnt):
    return (caller, None, "x", "y", "z", op, cnt)


GRAMS = "caller string, h4 string, h3 string, h2 string, h1 string, op string, cnt long"


def test_generations(spark):
    old = spark.createDataFrame([gram("a", "P", 3), gram("a", "Q", 1), gram("b", "P", 2), gram(None, "P", 5)], GRAMS)
    new = spark.createDataFrame([gram("a", "P", 1), gram("a", "R", 1), gram("c", "P", 2), gram(None, "P", 1)], GRAMS)
    changes = generations.ngram_changes(old, new)
    assert Counter(r.change for r in changes.collect()) == {"kept": 2, "lost": 2, "new": 2}
    got = {r.caller: r for r in generations.caller_drift(changes).collect()}
    p, q = {"P": 0.75, "Q": 0.25, "R": 0}, {"P": 0.5, "Q": 0, "R": 0.5}
    want = sum(x * math.log2(2 * x / (p[k] + q[k])) for d in (p, q) for k, x in d.items() if x) / 2
    assert (got["a"].new, got["a"].lost, got["a"].kept) == (1, 1, 1) and math.isclose(got["a"].divergence, want)
    assert got["b"].divergence is None and got["c"].divergence is None
    assert got[None].kept == 1 and math.isclose(got[None].divergence, 0, abs_tol=1e-12)  # null is a caller like any other
    assert generations.caller_drift(generations.ngram_changes(old.limit(0), new.limit(0))).count() == 0
    ops = spark.createDataFrame([("P", 1.0, 2.0, 1.0, 0.0), (None, 4.0, 1.0, 1.0, 1.0)], "op string, dur_mean double, dur_std double, idx_mean double, idx_std double")
    moved = {r.op: r for r in generations.operation_shift(ops, ops.withColumn("dur_mean", F.col("dur_mean") + 3)).collect()}
    assert moved["P"].dur_shift == 1.5 and moved["P"].idx_shift is None and moved[None].change == "kept"


def test_totals_and_null_keys_differ(spark):
    verdicts = spark.createDataFrame([("A", None, "X"), ("A", "b", "X"), ("B", "b", "Y")], "track string, bucket string, decision string")
    got = {(r.level, r.track, r.bucket, r.decision): r.verdicts for r in subtotals.verdict_cube(verdicts).collect()}
    assert got[7, None, None, None] == 3 and got[2, "A", None, "X"] == 2 and got[0, "A", None, "X"] == 1


def test_sketches_of_days_merge_within_their_error(spark):
    rng = random.Random(5)
    events = spark.range(60_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "few").otherwise("hot").alias("op"), (F.col("id") * 5_000_000).alias("t_us"), F.concat(F.lit("u"), F.col("id") % 20_011).alias("caller"),
        F.when(F.col("id") % 2 == 0, F.lit("one")).alias("ip"), F.lit(None).cast("string").alias("corr"), F.pmod(F.hash("id"), F.lit(rng.randrange(10**6, 10**7))).alias("value"),
    )
    days = sketches.daily(events, "value")
    assert days.count() > 6
    merged = sketches.merged(days, "op")
    checked = sketches.check_distincts(sketches.distincts(merged, "op"), events).collect()
    exact = {(r.op, r.column): r.exact for r in checked}
    assert all(r.within for r in checked) and exact["hot", "corr"] == 0 and exact["hot", "ip"] == 1 and exact["few", "caller"] > 15_000
    ranks = sketches.check_quantiles(sketches.quantiles(merged, "op"), events, "value").collect()
    assert len(ranks) == 6 and all(r.within for r in ranks)
    # a wrong estimate is told
    wrong = sketches.quantiles(merged, "op").withColumn("estimate", F.col("estimate") * 1.1)
    assert not all(r.within for r in sketches.check_quantiles(wrong, events, "value").collect())
    # nothing but nulls: no quantiles
    empty = sketches.merged(sketches.daily(events.withColumn("value", F.lit(None).cast("double")), "value"), "op")
    assert sketches.quantiles(empty, "op").count() == 0


def test_ends_hold_the_last_four_operations(spark, events):
    slices = sequence.summaries(sequence.in_slices(events.withColumn("part", F.lit("train")), 3_600_000_000))
    lines = defaultdict(list)
    for seq, t, op, *_, corr in sorted(rows(), key=lambda r: (r[1], r[0])):
        lines[corr].append((t, op))
    got = {r.corr: (r.size, r.first, r.tail) for r in sequence.ends(slices).collect()}
    assert got == {c: (len(x), x[0][0], [op for _, op in x[::-1][:4]]) for c, x in lines.items()}
