"""Dialogues and embeddings."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens.llm import chat, common, cover_tree

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def dialogue(df):
    return {(r.conv_id, r.perspective, r.part): r for r in df.collect()}


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann", "hi"), (1, 2, "Bob", "hello <|im_end|>"), (1, 3, "Ann", None), (2, 0, "system", "alone"), (3, None, "Cy", ""), (3, 5, None, "who"), (3, 5, " ", "who")]
    got = dialogue(chat.rotate(spark.createDataFrame(rows, TURNS).withColumn("parties", F.lit("x")).withColumn("name", F.lit("y"))))
    assert set(got) == {(1, "Ann", 0), (1, "Bob", 0), (3, "Cy", None), (3, "Cy", 0)}
    ann = got[1, "Ann", 0]
    assert ann.rendered == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user name=Bob\nhello < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann.rendered[s.start : s.end] for s in ann.spans] == ["hi<|im_end|>\n", "<|im_end|>\n"]
    bob = got[1, "Bob", 0]
    assert [bob.rendered[s.start : s.end] for s in bob.spans] == ["hello < |im_end|><|im_end|>\n"]
    assert bob.n_turns == 4 and bob.n_masked == sum(s.end - s.start for s in bob.spans)
    assert got[3, "Cy", 0].rendered == "<|im_start|>user name=unknown\nwho<|im_end|>\n" * 2 and not got[3, "Cy", 0].spans


def test_long_and_repeated_dialogues(spark):
    rows = [(None, i, "a" if i % 2 else "b", "t" * (i % 7)) for i in range(300)] + [(None, 7, "a", "t")] * 3
    got = dialogue(chat.rotate(spark.createDataFrame(rows, TURNS)))
    assert set(got) == {(None, p, k) for p in "ab" for k in range(5)}
    assert sum(r.n_turns for r in got.values()) == 2 * 303
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_speakers_with_equal_names_are_one(spark):
    rows = [(1, 0, "A<", "x"), (1, 1, "A|", "y"), (1, 2, "B", "z")]
    got = {r.perspective: r for r in chat.rotate(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {"A_", "B"} and len(got["A_"].spans) == 2 and got["A_"].rendered.count("assistant") == 2


def test_crowded_parts_are_rendered_in_pieces(spark):
    """Many turns without a number, and one that is repeated thousands of times: bounded pieces that hold every turn, as in SQL."""
    rows = [(1, None, "ab"[i % 2], f"text {i}") for i in range(2_500)] + [(1, None, "a", "again")] * 2_100 + [(1, 3, "b", "numbered"), (2, None, "c", "alone")]
    df = spark.createDataFrame(rows, TURNS)
    got = chat.rotate(df).collect()
    assert sum(r.n_turns for r in got) == 2 * 4_601 + 1 and max(r.n_turns for r in got) <= 1_000
    assert {r.piece for r in got if r.conv_id == 2} == {0}
    mine = [r for r in got if r.conv_id == 1 and r.perspective == "a"]
    assert sum(r.rendered.count("assistant\nagain<|im_end|>") for r in mine) == 2_100 and len(mine) == 6
    duck = duckdb.connect()
    conversations = df.toPandas()  # noqa: F841
    conversations["turn"] = conversations["turn"].astype("Int64")
    want = duck.sql(chat.ORACLE_SQL).fetchall()
    text = lambda spans: ",".join(f"{s.start}-{s.end}" for s in spans)
    assert Counter((r.conv_id, r.perspective, r.part, r.piece, r.n_turns, r.n_masked, r.rendered, text(r.spans)) for r in got) == Counter(want)


@pytest.mark.parametrize("most", [7, 1_000])
def test_pieces_in_order_are_the_dialogue(spark, most):
    """From ten to five thousand turns of a part: of one number, of twelve numbers, without a number, repeated."""
    rows = []
    for conv, n in enumerate((10, 999, 1_000, 1_001, 1_200, 5_000)):
        rows += [(conv, 5, "ann" if i % 3 else "bob", f"t{i % 1_700}") for i in range(n)]
    rows += [(10, i % 12, "ann" if i % 2 else "bob", f"t{i}") for i in range(1_200)] + [(11, None, "ann", f"{i}") for i in range(1_500)] + [(11, 1, "bob", "x")] + [(None, 3, "ann", "same")] * 2_500
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), most=most).where("perspective = 'ann'").collect()
    assert max(r.n_turns for r in got) <= most
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.part is not None, r.part or 0, r.piece))
        assert len({(r.part, r.piece) for r in mine}) == len(mine)
        ordered = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want = "".join(f"<|im_start|>{'assistant' if role == 'ann' else 'user name=' + role}\n{text}<|im_end|>\n" for _, role, text in ordered)
        assert "".join(r.rendered for r in mine) == want


def test_rotation_uses_no_python(spark):
    plan = chat.rotate(common.table(spark, "/root/testdata/sf0.001", "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def brute(rows, threshold=0.93):
    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if usable(a, la) and usable(b, lb) and la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                near[i, j] = near[j, i] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    component = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in np.argwhere(near):
            low = min(component[i], component[j])
            changed |= component[i] != low or component[j] != low
            component[i] = component[j] = low
    out = Counter()
    for i, (vec, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if component[j] == component[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out[(vec, int(near[i].sum()), least, vec == least)] += 1
    return out


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for label in range(3):
        centres = rng.normal(0, 1, (6, 8))
        for c in centres:
            for spread in (0.05, 0.2, 0.35):
                rows += [(len(rows) + k, (c + rng.normal(0, spread, 8)).astype("f4").tolist(), label) for k in range(6)]
    copy = rows[3][1]
    nan, inf = float("nan"), float("inf")
    odd = [copy, copy, [2 * x for x in copy], [0.0] * 8, [nan] * 8, [inf, *copy[1:]], [None, *copy[1:]], None, [], copy[:4], [1e38] * 8]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, copy, None), (3, copy, 0), (None, copy, 0), (None, [0.0] * 8, 1)]
    return rows


@pytest.mark.parametrize("block", [7, 2000])
def test_cover_tree(spark, vectors, block):
    df = spark.createDataFrame(vectors, VECTORS).withColumn("node", F.lit("n")).withColumn("__row", F.lit(1))
    got = cover_tree.near_duplicates(df, block=block)
    assert Counter(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == brute(vectors)


def test_cover_tree_of_nothing(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    got = cover_tree.near_duplicates(spark.createDataFrame([(1, None, None)], VECTORS)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, True)]


def test_trees_are_nested_and_cover():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def check(node):
        d = np.sqrt(np.maximum(2 - 2 * (x[node.points] @ x[node.centre]), 0))
        assert node.centre in node.points and d.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children]).tolist()) == sorted(node.points.tolist())
            assert node.centre in [c.centre for c in node.children]
            for c in node.children:
                assert len(c.points) < len(node.points)
                check(c)

    check(cover_tree.tree(x))
