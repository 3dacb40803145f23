"""The activity-log engine: numeric goldens, traps, rules, artefacts."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from auditlens.cli import main, parser
from auditlens.functions import diagnosis, scores, text, times
from auditlens.operators import evaluate, lifecycle, packet, sequence, session, split
from auditlens.plans import analyze as plans
from auditlens.plans.analyze import Analysis, analyze
from auditlens.plans.queries import QUERIES
from auditlens.schema import EVENT, LIFECYCLE_ALERT, SESSION_ALERT
from auditlens.sources import activity_csv, sinks
from auditlens.sources.activity_csv import load_events, normalise
from auditlens.sources.events_view import activity
from auditlens.sources.feedback import FeedbackStore
from auditlens.streaming.sessions import score_stream

GENERIC = ["timestamp_epoch", "operation", "provider", "caller", "caller_ip", "subscription", "resource_group", "resource_type", "correlation_id"]
#: The operations of the smoke fixture.
OPS = [
    "MICROSOFT.COMPUTE/VIRTUALMACHINES/WRITE",
    "MICROSOFT.COMPUTE/VIRTUALMACHINES/DELETE",
    "MICROSOFT.RESOURCES/TAGS/WRITE",
    "MICROSOFT.SQL/SERVERS/DATABASES/WRITE",
    "MICROSOFT.NETWORK/NETWORKSECURITYGROUPS/WRITE",
]
BASE = 1_700_000_000


def write(path, header, rows, bom=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


@pytest.fixture(scope="module")
def smoke(tmp_path_factory):
    rows = [[BASE + 120 * i, OPS[i % 5], "MICROSOFT.COMPUTE", f"user-{i % 3}@example.com", "1.2.3.4", "sub-001", "rg-prod", "VIRTUALMACHINES", f"corr-{i % 6}"] for i in range(300)]
    return write(tmp_path_factory.mktemp("smoke") / "log.csv", GENERIC, rows)


@pytest.fixture(scope="module")
def smoke_run(spark, smoke):
    run = Analysis(load_events(spark, smoke))
    run.history = run.history.cache()
    return run


def events(spark, rows):
    """Events from (t seconds, caller, op, corr) and optional other fields."""
    full = []
    for seq, row in enumerate(rows):
        t, caller, op, corr, *rest = row
        other = {"prov": "P", "ip": "1", "sub": "s", "rg": "r", "rtype": "T"} | (rest[0] if rest else {})
        full.append((seq, int(t * 1_000_000), op, other["prov"], caller, other["ip"], other["sub"], other["rg"], other["rtype"], corr))
    return spark.createDataFrame(full, EVENT)


def test_smoke_split_and_scores(smoke_run):
    assert {r.part: r.events for r in split.counts(smoke_run.parts).collect()} == {"train": 210, "val": 45, "test": 45}
    found = {r.correlation_id: r for r in smoke_run.lifecycles.collect()}
    want = {"corr-0": (7, 0.340275), "corr-1": (7, 0.342878), "corr-2": (7, 0.329690), "corr-3": (8, 0.329690), "corr-4": (8, 0.333668), "corr-5": (8, 0.337202)}
    assert set(found) == set(want)
    for name, (n, dev) in want.items():
        r = found[name]
        assert (r.events, r.struct, r.context) == (n, 0.0, 0.0)
        assert r.rarity == pytest.approx(0.923077, abs=1e-6)
        assert r.dur_dev == pytest.approx(dev, abs=1e-6) and r.len_dev == pytest.approx(dev, abs=1e-6)


def test_smoke_sessions(smoke_run):
    want = {944461: (3, 0.383482, 0.101111), 944462: (5, 0.076696, 0.076111), 944463: (5, 0.076696, 0.034444), 944464: (2, 0.613571, 0.007222)}
    rows = smoke_run.sessions.collect()
    assert len(rows) == 12
    for r in rows:
        n, act, hour = want[r.bucket]
        assert (r.events, r.new_op, r.new_ip, r.new_sub) == (n, 0, 0, 0)
        assert r.activity_dev == pytest.approx(act, abs=1e-6) and r.hour_dev == pytest.approx(hour, abs=1e-6)


@pytest.mark.parametrize("most", [1, 3, 10**6])
def test_history_does_not_depend_on_slices(spark, most):
    """Crowded hours are sliced more finely; positions and history stay."""
    rows = [(7_000 + i * 0.25, "c", f"op{i % 7}", "busy" if i % 5 else "calm") for i in range(200)]
    parts = events(spark, rows).withColumn("part", F.lit("train"))
    length = sequence.slice_length(split.bounds(parts).fullest, most=most)
    got = {r.seq: r for r in sequence.with_history(sequence.in_slices(parts, length)).collect()}
    for corr in ("busy", "calm"):
        mine = [i for i, r in enumerate(rows) if r[3] == corr]
        for at, seq in enumerate(mine):
            r = got[seq]
            before = ["START"] * 4 + [rows[i][2] for i in mine[:at]]
            assert (r.idx, r.n, r.h1, r.h2, r.h3, r.h4) == (at + 1, len(mine), *before[-1:-5:-1])
            assert r.elapsed == pytest.approx(rows[seq][0] - rows[mine[0]][0])


def test_percentiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for values in (rng.random(1_001), np.round(rng.random(500), 2), np.array([1.0, 0.0, 1.0, 1.0]), np.array([0.25]), 0.5 + rng.random(300) * 1e-6):
        df = spark.createDataFrame([(float(v),) for v in values], "struct double").selectExpr("struct", "1 - struct AS rarity", "struct AS dur_dev", "0D AS len_dev")
        got = {r.component: (r.p50, r.p90, r.p99) for r in evaluate.component_percentiles(df).collect()}
        for name, x in (("struct", values), ("rarity", 1 - values), ("dur_dev", values), ("len_dev", 0 * values)):
            assert got[name] == pytest.approx(np.percentile(x, [50, 90, 99]), abs=1e-6)
    assert evaluate.component_percentiles(df.limit(0)).count() == 0


def test_dry_run_writes_nothing(spark, smoke, tmp_path):
    assert analyze(spark, smoke, str(tmp_path / "out"), dry_run=True) is None
    assert not (tmp_path / "out").exists()


def test_artefacts(spark, smoke, tmp_path):
    out = tmp_path / "out"
    analyze(spark, smoke, str(out), model_dir=str(tmp_path / "model"))
    with open(out / "top_lifecycle_anomalies.csv", encoding="utf-8") as f:
        a = list(csv.reader(f))
    with open(out / "top_actor_anomalies.csv", encoding="utf-8") as f:
        b = list(csv.reader(f))
    assert a[0] == LIFECYCLE_ALERT and len(a) == 7
    assert b[0] == SESSION_ALERT and len(b) == 13
    assert [float(r[3]) for r in a[1:]] == sorted((float(r[3]) for r in a[1:]), reverse=True)
    manifest = json.loads((out / "manifest.json").read_text())
    assert {k: v for k, v in manifest.items() if k != "generated_utc"} == {"track_a_scored": 6, "track_b_scored": 12, "track_a_deduplicated_patterns": 6}
    text_ = (out / "diagnosed_review_packet.md").read_text(encoding="utf-8")
    assert "### A1-6." in text_ and "### B-12." in text_ and "Queue 2" not in text_
    assert (tmp_path / "model" / "seen").exists()


def test_csv_layouts_and_defaults(spark, tmp_path):
    header = [" Timestamp Epoch", "OPERATION", "provider", "Caller", "caller-ip", "subscription", "resource_group", "resource_type", "correlation_id", "timestamp", "subscriptionid"]
    rows = [
        ["1000.5", "a/b/c", "", "  Bob ", "", "", "   ", "", "c1", "", "s2"],
        ["junk", "op\nline", "p", "x", "1", "s", "r", "t ", "c1", "2024-01-02T03:04:05Z", ""],
        ["nan", "a", "p", "x", "1", "s", "r", "t", "c1", "not a time", ""],
        ["5", "short"],
    ]
    got = load_events(spark, write(tmp_path / "g.csv", header, rows, bom=True)).orderBy("seq").collect()
    assert [r.t_us for r in got] == [1_000_500_000, 1_704_164_645_000_000, 5_000_000]
    first = got[0]
    assert (first.op, first.prov, first.caller, first.ip, first.sub, first.rg, first.rtype) == ("A/B/C", "UNKNOWN", "Bob", "UNKNOWN", "s2", "", "A/B")
    assert got[1].op == "OP\nLINE" and got[1].rtype == "T"
    assert got[2].op == "SHORT" and got[2].caller == "UNKNOWN" and got[2].rtype == "SHORT"


def test_large_csv_is_split_unless_a_cell_has_a_line_break(spark, tmp_path):
    header, row = ["timestamp_epoch", "operation", "caller", "correlation_id"], ["{}", "o,\"q\"", "c", "k"]
    plain = write(tmp_path / "plain.csv", header, [[str(i), *row[1:]] for i in range(5_000)], bom=True)
    broken = write(tmp_path / "broken.csv", header, [["1", "o\np", "c", "k"]])
    assert [f.breaks for f in activity_csv.files(spark, plain) + activity_csv.files(spark, broken)] == [False, True]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = load_events(spark, plain)
        assert got.rdd.getNumPartitions() > 4
        rows = got.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.t_us for r in rows] == [i * 1_000_000 for i in range(5_000)] and {r.op for r in rows} == {'O,"Q"'}


def test_one_file_with_line_breaks_leaves_the_others_split_and_all_in_order(spark, tmp_path):
    header, folder = ["timestamp_epoch", "operation", "caller", "correlation_id"], tmp_path / "export 1%"
    folder.mkdir()
    sizes = {"a.csv": 3, "b ü.csv": 4_000, "c.csv": 40, "d.csv": 2_500}  # Spark packs files by size
    want = []
    for name, n in sizes.items():
        rows = [[str(len(want) + i), "x\ny" if name == "c.csv" and i % 2 else "o", name, "k"] for i in range(n)]
        write(folder / name, header, rows)
        want += [(int(r[0]) * 1_000_000, r[1].upper(), name) for r in rows]
    (folder / "0.csv").write_text("\n\n")
    assert {f.name.rsplit("/")[-1]: f.breaks for f in activity_csv.files(spark, str(folder))} == {"a.csv": False, "b%20ü.csv": False, "c.csv": True, "d.csv": False}
    for conf in ({}, {"spark.sql.files.maxPartitionBytes": "8k"}, {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "100"}):
        for key, value in conf.items():
            spark.conf.set(key, value)
        try:
            got = load_events(spark, str(folder))
            assert not conf or got.rdd.getNumPartitions() > 8
            rows = got.orderBy("seq").collect()
        finally:
            for key in conf:
                spark.conf.unset(key)
        assert len({r.seq for r in rows}) == len(want) and [(r.t_us, r.op, r.caller) for r in rows] == want


def test_native_wins_and_ignores_generic_columns(spark, tmp_path):
    header = ["TimeGenerated", "OperationNameValue", "Caller", "CorrelationId", "resource_type", "timestamp_epoch", "operation", "correlation_id"]
    path = write(tmp_path / "n.csv", header, [["2024-01-01T00:00:00+00:00", "x/y", "c", "k", "IGNORED", "5", "other", "z"]])
    (row,) = load_events(spark, path).collect()
    assert (row.op, row.corr, row.rtype, row.t_us) == ("X/Y", "k", "X", 1_704_067_200_000_000)


def test_duplicate_headers_last_wins(spark, tmp_path):
    path = write(tmp_path / "d.csv", ["timestamp_epoch", "operation", "caller", "Caller", "correlation_id"], [["1", "o", "first", "last", "k"]])
    assert load_events(spark, path).first().caller == "last"


def test_input_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_events(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="fit neither layout"):
        load_events(spark, write(tmp_path / "bad.csv", ["timestamp_epoch", "caller"], [["1000", "user@example.com"]]))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        load_events(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(ValueError, match="readable time"):
        load_events(spark, write(tmp_path / "head.csv", GENERIC, []))
    one = write(tmp_path / "one.csv", GENERIC, [["7", "o", "", "c", "", "", "", "", "k"]] * 3)
    with pytest.raises(ValueError, match="nothing to learn"):
        analyze(spark, one, str(tmp_path / "o"))


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2024-01-01T00:00:00Z", 1_704_067_200_000_000), ("2024-01-01T02:00:00+02:00", 1_704_067_200_000_000), ("2024-01-01 00:00:00", 1_704_067_200_000_000),
        ("2024-01-01", 1_704_067_200_000_000), ("20240101T000000", 1_704_067_200_000_000), ("2024-01-01T00:00:00.123456", 1_704_067_200_123_456),
        ("2024", None), ("2024-01", None), ("junk", None), ("", None), (None, None),
    ],
)
def test_iso_times(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(times.iso_us(F.col("v"))).first()[0] == want


@pytest.mark.parametrize(("value", "want"), [("1.5", 1_500_000), ("-3", -3_000_000), ("1e3", 1_000_000_000), ("nan", None), ("inf", None), ("1_000", None), ("1.5d", None), ("", None)])
def test_epoch_times(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(times.epoch_us(F.col("v"))).first()[0] == want


def test_buckets_and_text_of_times(spark):
    df = spark.createDataFrame([(-1,), (0,), (1_700_000_000_123_000,)], "t long")
    got = df.select(times.bucket(F.col("t")), times.hour_of_day(F.col("t")), times.iso_text(F.col("t"))).collect()
    assert [r[0] for r in got] == [-1, 0, 944444]
    assert got[0][1] == pytest.approx(24.0) and got[1][1] == 0
    assert [r[2] for r in got[1:]] == ["1970-01-01T00:00:00+00:00", "2023-11-14T22:13:20.123000+00:00"]


def test_strip_knows_unicode_space(spark):
    df = spark.createDataFrame([("  x y\t ",)], "v string")
    assert df.select(text.strip(F.col("v"))).first()[0] == "x y"


@pytest.mark.parametrize("slice_seconds", [1, 7, 100_000])
def test_history_across_slices(spark, slice_seconds):
    """Slices of any length give what one window over the lifecycle gives, ties by sequence."""
    rows = [(i // 2, f"u{i % 3}", f"op{i % 7}", f"c{(i * i) % 4}") for i in range(120)]
    parts = split.labelled(events(spark, rows))
    got = {r.seq: r for r in sequence.with_history(sequence.in_slices(parts, slice_seconds * 1_000_000)).collect()}
    for part in ("train", "test"):
        for corr in range(4):
            line = [r for r in sorted(got.values(), key=lambda r: (r.t_us, r.seq)) if r.part == part and r.corr == f"c{corr}"]
            past = ["START"] * 4
            for i, r in enumerate(line):
                assert [r.h4, r.h3, r.h2, r.h1] == past[-4:]
                assert (r.idx, r.n, r.elapsed) == (i + 1, len(line), (r.t_us - line[0].t_us) / 1e6)
                past.append(r.op)


def _split_rows(train, test):
    """Rows whose first seven tenths of time are ``train``: anchors hold the span at 0..1000."""
    return [(0, "anchor", "A", "a0"), *train, *test, (1000, "anchor", "A", "a1")]


def test_unseen_operation_and_new_caller(spark):
    run = Analysis(events(spark, _split_rows([(10, "u", "A", "k"), (20, "u", "A", "k")], [(900, "new", "NEVER", "z", {"ip": "9"}), (901, "new", "NEVER", "z"), (902, "new", "A", "z")])))
    life = {r.correlation_id: r for r in run.lifecycles.collect()}["z"]
    assert (life.struct, life.dur_dev, life.len_dev, life.rarity) == (1.0, 1.0, 1.0, 1.0)
    ses = {r.caller: r for r in run.sessions.collect()}["new"]
    assert (ses.new_op, ses.new_prov, ses.new_ip, ses.new_type) == (1, 1, 1, 1)
    assert ses.activity_dev == pytest.approx(0.6, abs=1e-5) and ses.hour_dev == 0


def test_patterns_use_last_ten_and_show_first_ten(spark):
    long = [(900 + i, "u", "X" if i == 0 else f"O{i}", "one") for i in range(12)] + [(930 + i, "u", "Y" if i == 0 else f"O{i}", "two") for i in range(12)]
    rows = {r.correlation_id: r for r in Analysis(events(spark, _split_rows([(10, "u", "A", "k")], long))).patterns.collect()}
    assert "one" in rows and "two" not in rows and rows["one"].pattern_count == 2
    assert rows["one"].first_ops == " -> ".join(["X", *[f"O{i}" for i in range(1, 10)]])
    assert rows["one"].last_ops == " -> ".join(f"O{i}" for i in range(2, 12))


def test_first_caller_and_context(spark):
    test = [(900, "u1", "A", "k", {"rg": "r1"}), (901, "u2", "B", "k", {"rg": "r2"})]
    row = {r.correlation_id: r for r in Analysis(events(spark, _split_rows([(1, "u1", "A", "t")], test))).lifecycles.collect()}["k"]
    assert (row.caller, row.context, row.events) == ("u1", 1.0, 2)


def test_order_of_rows_and_gap_do_not_matter(spark):
    rows = [(i * 7 % 1000, f"u{i % 4}", f"o{i % 6}", f"c{i % 5}") for i in range(200)]
    base = events(spark, rows)
    pick = lambda e: sorted(map(tuple, Analysis(e).lifecycles.select("correlation_id", "struct", "rarity", "dur_dev", "len_dev", "context").collect()))
    assert pick(base) == pick(base.orderBy("op"))
    gap = base.unionByName(events(spark, [(750, "ghost", "g", "c0")]).withColumn("seq", F.lit(999).cast("long")))
    assert pick(gap) == pick(base)
    for r in pick(base):
        assert all(0 <= x <= 1 for x in r[1:]) and sum(r[1:]) <= 5


def test_signals_on_raw_scores_diagnosis_on_rounded(spark):
    row = spark.createDataFrame([(0.0, 0.5, 0.8004, 0.0, 0.0)], "struct double, rarity double, dur_dev double, len_dev double, context double")
    cols = [F.col(c) for c in ("struct", "rarity", "dur_dev", "len_dev", "context")]
    assert row.select(scores.lifecycle_signals(*cols)).first()[0] == 1
    shown = spark.createDataFrame([(0.0, 0.8, 0.0, 0.0, 1, "A -> B")], "structural_violation double, duration_deviation double, length_deviation double, context_inconsistency double, effective_signal_count long, sequence_context string")
    assert tuple(shown.select(*diagnosis.lifecycle()).first()) == ("Unclassified Structural Anomaly", "Sequence violates historical n-gram priors.", "MODERATE")


def test_lifecycle_rules(spark):
    levels = (0.0, 0.8, 0.9)
    rows = [(s, d, n, c, e, "A -> LAST") for s in (0.0, 1.0) for d in levels for n in levels for c in (0.0, 1.0) for e in (0, 1, 2)]
    df = spark.createDataFrame(rows, "structural_violation double, duration_deviation double, length_deviation double, context_inconsistency double, effective_signal_count long, sequence_context string")
    for r in df.select("*", *diagnosis.lifecycle()).collect():
        order = [
            (r.context_inconsistency > 0, "Lateral Boundary Crossing"), (r.structural_violation == 1 and r.duration_deviation > 0.8, "Critical Deployment/Migration Shift"),
            (r.structural_violation == 1, "New Microservice Routine"), (r.duration_deviation > 0.8, "Latency / Retry Loop"), (r.length_deviation > 0.8, "Stalled Operation"),
        ]
        assert r.category == next((name for hit, name in order if hit), "Unclassified Structural Anomaly")
        assert ("`LAST`" in r.cause) == (r.category not in ("Stalled Operation", "Unclassified Structural Anomaly"))
        n = r.effective_signal_count
        assert r.uncertainty == ("HIGH_CONFIDENCE" if n >= 2 else "UNCLASSIFIED" if n == 0 else "LOW_CONFIDENCE" if r.structural_violation == 1 else "MODERATE")


def test_session_rules(spark):
    flags, devs = (0.0, 1.0), (0.4, 0.6, 0.9)
    rows = [(o, i, g, p, a, h, e, "FIRST, B") for o in flags for i in flags for g in flags for p in flags for a in devs for h in devs for e in (0, 1, 3)]
    df = spark.createDataFrame(rows, "new_op double, new_ip double, new_rg double, new_prov double, activity_dev double, hour_dev double, effective_signal_count long, session_context string")
    for r in df.select("*", *diagnosis.session()).collect():
        order = [
            (r.new_ip and r.new_op and r.activity_dev > 0.5, "Possible Credential/Token Compromise"), (r.new_ip and not r.new_op and not r.new_prov, "VPN / Routing Shift"),
            (r.new_op and r.activity_dev > 0.8 and not r.new_ip, "Automation / Batch Script Change"), ((r.new_rg or r.new_prov) and not r.new_ip, "RBAC Role Expansion"),
            (r.hour_dev > 0.8 and r.new_op, "Off-Hours Deviation"),
        ]
        assert r.category == next((name for hit, name in order if hit), "Unclassified Behavioral Drift")


@pytest.mark.parametrize(
    ("values", "want"),
    [((0, 0, 0.1, 0.1, 0), "None"), ((1, 1, 1.0, 0, 1), "New Operations"), ((0, 1, 1.0, 0.9, 1), "New IP"), ((0, 0, 0.9, 0.95, 0), "Hour Deviation"), ((0, 0, 1.0, 0, 1), "Activity Spike"), ((0, 0, 0.9, 0.95, 1), "Context/Role Expansion")],
)
def test_dominant_signal(spark, values, want):
    df = spark.createDataFrame([tuple(float(v) for v in values)], "a double, b double, c double, d double, e double")
    assert df.select(scores.dominant_signal(*[F.col(c) for c in "abcde"])).first()[0] == want


def test_queues_are_disjoint(spark):
    run = Analysis(activity(spark, "/root/testdata/sf0.001"))
    alerts = run.lifecycle_alerts.cache()
    a1 = {r.correlation_id for r in packet.queue_a1(alerts).collect()}
    a2 = {r.correlation_id for r in packet.queue_a2(alerts).collect()}
    assert not a1 & a2 and len(a1) == min(20, alerts.count())


def test_feedback(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "verdicts"))
    a = store.append("c1", "A", "CONFIRMED_ANOMALY", "why", confidence="CERTAIN")
    b = store.append("c1", "A", "CONFIRMED_ANOMALY", "why")
    rows = store.read().collect()
    assert {r.id for r in rows} == {a, b} and all(r.timestamp == r.reviewed_at and r.reviewer_count == 1 and r.disagreement_flag == 0 for r in rows)
    for bad in ({"track": "C"}, {"decision": "MAYBE"}, {"confidence": "SURE"}):
        with pytest.raises(ValueError):
            store.append(**({"alert_id": "x", "track": "B", "decision": "UNREVIEWED", "reason": "r"} | bad))
    assert store.read().count() == 2


def test_command_line(spark, smoke, tmp_path, capsys):
    assert main(["analyze", "-i", smoke, "-o", str(tmp_path / "o"), "--dry-run"]) == 0
    assert main(["analyze", "-i", str(tmp_path / "none.csv")]) == 1
    assert main(["submit-feedback", "-t", "B", "--id", "u", "-d", "UNREVIEWED", "-r", "later", "--db", str(tmp_path / "db")]) == 0
    assert "UNREVIEWED" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        parser().parse_args(["submit-feedback", "-t", "Z", "--id", "u", "-d", "UNREVIEWED", "-r", "x"])


def test_stream_matches_batch(spark, tmp_path):
    run = Analysis(activity(spark, "/root/testdata/sf0.001"))
    run.model.save(str(tmp_path / "model"))
    model = type(run.model).load(spark, str(tmp_path / "model"))
    test = run.parts.where("part = 'test'").drop("part")
    test.write.parquet(str(tmp_path / "in"))
    # a far later event moves the watermark past every session
    late = events(spark, [(4_000_000_000, "late", "x", "y")])
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(test.schema).parquet(str(tmp_path / "in"))
    query = score_stream(stream, model).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    columns = ["caller", "bucket", "events", "new_op", "new_prov", "new_sub", "new_rg", "new_type", "new_ip", F.round("activity_dev", 6), F.round("hour_dev", 6)]
    got = set(map(tuple, spark.table("sessions").where("caller <> 'late'").select(*columns).collect()))
    assert got == set(map(tuple, session.score_sessions(run.test, model.seen, model.callers).select(*columns).collect()))


def test_plan_is_free_of_python_and_products(spark):
    run = Analysis(activity(spark, "/root/testdata/sf0.001"))
    plan = lifecycle.score_lifecycles(run.scored_events)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


CORE = [n for n in QUERIES if n.split("_")[0] in ("ngram", "lifecycle", "model", "score", "top20", "session", "diagnose", "packet", "component", "manifest", "next", "new", "chrono")]


@pytest.mark.parametrize("name", CORE)
def test_core_queries_scan_events_three_times_at_most(spark, monkeypatch, name):
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id")
    found = []

    def counted(df, *args):
        found.append(scans(df))
        return written(df, *args)

    written = plans.written
    monkeypatch.setattr(plans, "written", counted)
    last = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sum(found) + scans(last) + 1 <= 3  # and one for the bounds


def test_saved_baselines_score_a_new_export_alike(spark, smoke, tmp_path):
    whole = tmp_path / "whole"
    analyze(spark, smoke, f"file://{whole}", model_dir=str(tmp_path / "model"))
    with open(smoke, encoding="utf-8") as f:
        header, *rows = csv.reader(f)
    times_ = [float(r[0]) for r in rows]
    late = [r for r in rows if float(r[0]) >= min(times_) + 0.85 * (max(times_) - min(times_))]
    export = write(tmp_path / "late.csv", header, late)
    assert main(["analyze", "-i", export, "-o", str(tmp_path / "late"), "--use-model", str(tmp_path / "model")]) == 0
    for name in ("top_lifecycle_anomalies.csv", "top_actor_anomalies.csv", "diagnosed_review_packet.md"):
        assert (tmp_path / "late" / name).read_text() == (whole / name).read_text()
    assert sorted(x.name for x in whole.iterdir() if not x.name.endswith(".crc")) == ["diagnosed_review_packet.md", "manifest.json", "top_actor_anomalies.csv", "top_lifecycle_anomalies.csv"]


def test_publish_replaces_whole_files(spark, tmp_path):
    target = f"file://{tmp_path}/new/é.txt"
    for text_ in ("first\n", "", "second — \U0001f642\r\n"):
        sinks.publish(spark, target, text_)
        assert sinks.fetch(spark, target) == text_
    with pytest.raises(Exception):
        sinks.publish(spark, "nowhere://x/y", "z")


def test_normalise_needs_a_known_layout(spark):
    with pytest.raises(ValueError):
        normalise(spark.createDataFrame([("x",)], "a string"))


def test_analyze_parses_an_export_once(spark, smoke, tmp_path, monkeypatch):
    """Bounds and slices come from a table of the parsed events, which is gone afterwards."""
    read, made, bounds, table = [], [], split.bounds, activity_csv.written
    monkeypatch.setattr(split, "bounds", lambda e: read.extend(e.inputFiles()) or bounds(e))
    monkeypatch.setattr(activity_csv, "written", lambda *a: made.append(table(*a)) or made[-1])
    analyze(spark, smoke, str(tmp_path / "out"))
    assert read and not [f for f in read if f.endswith(".csv")] and len(made) == 1
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert not [f for f in made[0].inputFiles() if (p := folder(f)).getFileSystem(conf).exists(p)]


def test_strip_is_the_pattern_for_any_text(spark):
    ends = ["", "a", "~", "!", " ", "\t", "\n", "\x1f", "\x7f", "\x85", " ", " ", "é", "\U0001f642"]
    rows = [(a + m + b,) for a in ends for m in ("", "x y", " ") for b in ends] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    assert df.select(text.strip(F.col("t")).alias("got"), F.regexp_replace("t", text._ENDS, "").alias("want")).where("NOT got <=> want").collect() == []
