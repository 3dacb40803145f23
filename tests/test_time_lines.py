"""As-of joins, runs, gap sessions, sliding frames, interval overlaps and the two stream scorers, against plain Python and batch."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditlens.operators import carry, overlap, session
from auditlens.plans.analyze import Analysis
from auditlens.schema import EVENT
from auditlens.sources.events_view import activity
from auditlens.sources.feedback import FeedbackStore
from auditlens.streaming import corrections, lifecycles

SF = "/root/testdata/sf0.001"


def line(n=300, hot=True, seed=1):
    """Events (caller, t_us, seq, ip) with ties; ``hot``: of one caller only."""
    rng = random.Random(seed)
    return [("u" if hot else rng.choice("abc"), 1_000_000 * rng.randrange(4 * n), i, rng.choice(["x", "x", "x", "y", None, "z"])) for i in range(n)]


@pytest.fixture(params=[True, False])
def timeline(spark, request):
    rows = line(hot=request.param)
    return rows, spark.createDataFrame(rows, "caller string, t_us long, seq long, ip string").repartition(3)


LENGTHS = [7_000_000, 100_000_000, 10**15]


@pytest.mark.parametrize("length", LENGTHS)
def test_last_event_from_another_address(timeline, length):
    rows, frame = timeline
    got = {r.seq: r.other and (r.other.t_us, r.other.seq, r.other.ip) for r in carry.last_from_other(frame, "ip", ["caller"], "t_us", "seq", length).collect()}
    for c, t, seq, ip in rows:
        before = [(pt, ps, pip) for pc, pt, ps, pip in rows if pc == c and (pt, ps) < (t, seq) and pip != ip]
        assert got[seq] == max(before, key=lambda x: x[:2], default=None)


@pytest.mark.parametrize("length", LENGTHS)
def test_as_of(timeline, length):
    rows, frame = timeline
    right = frame.where("ip = 'y'").select("caller", "t_us", "seq", F.upper("ip").alias("extra"))
    got = {r.seq: r.m and (r.m.t_us, r.m.seq, r.m.extra) for r in carry.as_of(frame.where("ip = 'x'"), right, ["caller"], "t_us", "seq", "m", length).collect()}
    want = {}
    for c, t, seq, ip in rows:
        if ip == "x":
            want[seq] = max(((pt, ps, "Y") for pc, pt, ps, pip in rows if pc == c and pip == "y" and pt <= t), default=None)
    assert got == want
    assert carry.as_of(frame, right.where("false"), ["caller"], "t_us", "seq", "m", length).where("m is not null").count() == 0
    assert carry.as_of(frame.where("false"), right, ["caller"], "t_us", "seq", "m", length).count() == 0


@pytest.mark.parametrize("length", LENGTHS)
def test_gap_sessions_equal_session_windows(spark, timeline, length):
    _, frame = timeline
    got = carry.gap_sessions(frame, ["caller"], "t_us", "seq", length, gap_us=5_000_000)
    window = frame.groupBy("caller", F.session_window(F.timestamp_micros("t_us"), "5 seconds").alias("w")).agg(F.max("t_us").alias("session_end"), F.count("*").alias("events"))
    want = window.select("caller", F.unix_micros("w.start"), "session_end", "events")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("partial", [1, 3, 1000])
def test_sliding_frames(timeline, partial):
    rows, frame = timeline
    span = 20_000_000
    got = {r.seq: (r.n, r.low) for r in carry.within_before(frame, ["caller"], "t_us", "seq", span, {"n": F.count("*"), "low": F.min("t_us")}, partial).collect()}
    for c, t, seq, _ in rows:
        near = [pt for pc, pt, _, _ in rows if pc == c and t - span <= pt <= t]
        assert got[seq] == (len(near), min(near))


def test_a_hot_key_is_many_tasks(spark):
    frame = spark.createDataFrame(line(2_000), "caller string, t_us long, seq long, ip string")
    length = carry.length_for(frame, ["caller"], "t_us", most=50)
    assert length < 3600 * 1_000_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # as in a plan whose inputs are too large to broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        held = carry.last_value(frame, ["caller"], ["t_us", "seq"], F.col("ip"), "last", length).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(held) > 1 and max(r["count"] for r in held) < 1_500


@pytest.mark.parametrize(("bin_us", "most"), [(10, 1), (10, 3), (1_000, 4), (10**9, 10**6)])
def test_open_together(spark, bin_us, most):
    rng = random.Random(2)
    rows = [(rng.choice("gh"), rng.choice("pqr"), f"i{i}", t := rng.randrange(300), t + rng.choice([0, 1, 9, 10, 80])) for i in range(80)]
    got = {(r.grp, r.party_a, r.party_b): (r.pairs, r.shared_us) for r in overlap.open_together(spark.createDataFrame(rows, "grp string, party string, id string, begin long, end long"), bin_us, most).collect()}
    want = defaultdict(lambda: [0, 0])
    for ga, pa, _, sa, ea in rows:
        for gb, pb, _, sb, eb in rows:
            if ga == gb and pa < pb and max(sa, sb) <= min(ea, eb):
                want[ga, pa, pb][0] += 1
                want[ga, pa, pb][1] += min(ea, eb) - max(sa, sb)
    assert got == {k: tuple(v) for k, v in want.items()}
    plan = overlap.open_together(spark.createDataFrame(rows, "grp string, party string, id string, begin long, end long"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_open_together_does_not_list_pairs(spark):
    """Two parties with 100,000 intervals each that are all open at once: 10^10 pairs, and their time passes 64 bits."""
    n, long = 100_000, 10**10
    spans = spark.range(2 * n).select(
        F.lit("g").alias("grp"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("party"), F.col("id").cast("string").alias("id"), F.col("id").alias("begin"), (F.col("id") + long).alias("end")
    )
    (r,) = overlap.open_together(spans).collect()
    # intervals i < j share long - (j - i); odd differences d from 1 to 2n - 1 occur 2n - d times
    assert (r.party_a, r.party_b, r.pairs) == ("p", "q", n * n)
    assert r.shared_us == n * n * long - sum(d * (2 * n - d) for d in range(1, 2 * n, 2)) > 2**63


def test_open_together_of_many_parties(spark):
    rng = random.Random(4)
    rows = [("g", f"p{i % 40:02}", f"i{i}", t := rng.randrange(300), t + rng.randrange(60)) for i in range(160)]
    frame = spark.createDataFrame(rows, "grp string, party string, id string, begin long, end long")
    whole, dealt = [Counter(map(tuple, overlap.open_together(frame, 1_000, 50, parties).collect())) for parties in (1_000, 7)]
    assert whole == dealt and len(whole) > 500
    assert sum(r[3] for r in whole) == sum(a[1] < b[1] and max(a[3], b[3]) <= min(a[4], b[4]) for a in rows for b in rows)


@pytest.fixture(scope="module")
def batch(spark):
    run = Analysis(activity(spark, SF))
    return run, run.model


def arrivals(run, folder, shuffled, parts=5):
    """The test part as files, a micro-batch each, in order or not, and a far later event that closes everything."""
    rows = run.test.select(*EVENT.names).toPandas().sort_values(["t_us", "seq"])
    if shuffled:
        rows = rows.sample(frac=1, random_state=4)
    cut = -(-len(rows) // parts)
    frames = [rows.iloc[i : i + cut] for i in range(0, len(rows), cut)]
    last = rows.iloc[:1].assign(seq=10**9, t_us=int(rows.t_us.max()) + 10**13, corr="end", caller="end")
    folder.mkdir()
    for k, f in enumerate([*frames, last, last.assign(seq=10**9 + 1, t_us=last.t_us + 10**12)]):
        f.to_parquet(folder / f"{k:02}.parquet", index=False, coerce_timestamps=None)


def stream(spark, run, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))


LIFE = ["correlation_id", "caller", "first_t", "first_seq", "last_t", "events", "struct", "rarity", "dur_dev", "len_dev", "context", "first_ops", "last_ops"]


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_lifecycles_equal_batch(spark, batch, tmp_path, shuffled):
    run, model = batch
    arrivals(run, tmp_path / "in", shuffled)
    late = "100 days" if shuffled else "10 minutes"
    begin = lambda: lifecycles.score_lifecycles(stream(spark, run, tmp_path / "in"), model, str(tmp_path / "out"), str(tmp_path / "check"), late, idle_seconds=100_000)
    last = tmp_path / "in" / "06.parquet"
    kept = last.read_bytes()
    last.unlink()
    begin().awaitTermination(300)
    last.write_bytes(kept)
    begin().awaitTermination(300)  # from the checkpoint
    begin().awaitTermination(300)  # nothing new
    plain = lambda df: Counter(map(tuple, df.select(*[F.round(c, 9) if c in LIFE[6:11] else F.col(c) for c in LIFE]).collect()))
    rows = spark.read.parquet(str(tmp_path / "out" / "lifecycles")).where("correlation_id <> 'end'")
    want = plain(run.lifecycles)
    assert sum(want.values()) > 10 and plain(rows) == want
    versions = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "open").iterdir() if "=" in p.name)
    assert len(versions) <= 2
    # the last batch once more changes nothing
    open_now = spark.read.parquet(str(tmp_path / "out" / "open" / f"version={versions[-1]}"))
    assert open_now.where("corr <> 'end'").count() == 0


def test_state_of_a_lifecycle_is_bounded():
    held = lifecycles._Open()
    for i in range(5_000):
        held.pending.append((i, i, f"op{i}", "u", "p", "r", "s"))
        list(held.take(i))
    assert len(held.pending) == 1 and len(held.head) == len(held.tail) == 10 and len(held.past) == 4


@pytest.mark.parametrize("shuffled", [False, True])
def test_corrected_sessions_equal_batch(spark, batch, tmp_path, shuffled):
    run, model = batch
    arrivals(run, tmp_path / "in", shuffled)
    query = corrections.correct_sessions(stream(spark, run, tmp_path / "in"), model.seen, str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(300)
    columns = ["caller", "bucket", "first_t", "first_seq", "last_t", "events", *corrections.FLAGS]
    read = lambda: Counter(map(tuple, corrections.sessions(spark, str(tmp_path / "out")).where("caller <> 'end'").select(*columns).collect()))
    want = Counter(map(tuple, session.score_sessions(run.test, model.seen, model.callers).select(*columns).collect()))
    assert read() == want
    late = spark.read.parquet(str(tmp_path / "out" / "late")).where("caller <> 'end'").count()
    assert late > 0 if shuffled else late == 0
    # a batch replayed twice changes nothing
    sink = corrections.SessionSink(str(tmp_path / "out"), model.seen)
    again = spark.read.schema(EVENT).parquet(str(tmp_path / "in" / "03.parquet"))
    for _ in range(2):
        sink(again, 3)
    assert read() == want


def test_bulk_verdicts_are_checked_and_appended(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "verdicts"))
    good = spark.createDataFrame([("c1", "A", "UNREVIEWED", "later", None), ("c2", "B", "CONFIRMED_ANOMALY", "seen", "CERTAIN")], "alert_id string, track string, decision string, reason string, confidence string")
    store.append_all(good)
    store.append_all(good.drop("confidence"))
    rows = store.read().collect()
    assert len({r.id for r in rows}) == 4 and {r.analyst_id for r in rows} == {"SOC_ANALYST"} and all(r.timestamp == r.reviewed_at for r in rows)
    for column, value in (("track", "C"), ("decision", None), ("confidence", "SURE"), ("reason", None)):
        with pytest.raises(ValueError, match="cannot be stored"):
            store.append_all(good.unionByName(good.limit(1).withColumn(column, F.lit(value).cast("string"))))
    store.append_all(good.where("false"))
    assert store.read().count() == 4
