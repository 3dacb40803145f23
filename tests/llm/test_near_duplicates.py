"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from auditlens.llm import common, near_dup, simhash

from .test_text_operators import DOCS, components, rows


def sets(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(table):
    """The first row of each component by id, null last."""
    order = sorted(range(len(table)), key=lambda i: (table[i][0] is None, table[i][0] or 0, i))
    table = [table[i] for i in order]
    found = components([sets(r[1]) for r in table], list(range(len(table))), near)
    return Counter(r[:2] for i, r in enumerate(table) if found[i] == i)


def edited():
    """Texts with more and more words changed, chains of them, a common line, copies and short texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    line = "this line stands in very many of the texts and is the same in all".split()
    out = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([30, 80, 200]))
        for changes in (0, 1, 1, 2, 3, 5, 8):
            text = list(base)
            for _ in range(changes):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(text + line * rng.randrange(2))
        chain = list(base)
        for _ in range(6):
            chain[rng.randrange(len(chain))] = "new"
            out.append(list(chain))
    out += [base[:6], base[:5], base[:4], base[:4], line, line + ["x"], line + ["y"]]
    rng.shuffle(out)
    return [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(out)]


@pytest.mark.parametrize("last, block", [(0, 1_000), (50_000, 5)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, last, block):
    monkeypatch.setattr(near_dup, "FREQUENT", last)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    for table in (edited(), rows()):
        df = spark.createDataFrame(table, DOCS)
        got = Counter((r.doc_id, r.text) for r in near_dup.keep_representatives(df).collect())
        assert got == brute(table) and sum(got.values()) < len(table)
    assert near_dup.keep_representatives(spark.createDataFrame([], DOCS)).count() == 0


def test_pairs_that_simhash_misses_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents").where("doc_id in (2, 56, 709, 944)")
    assert {r.doc_id for r in simhash.keep_representatives(docs).collect()} == {2, 56, 709, 944}
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    assert {r.doc_id for r in stage(spark, docs, sf).collect()} == {2, 709}


def test_stages_hold_texts_once_and_no_sets(spark, monkeypatch):
    """Of the tables in the shared folder none but one has texts; prefixes and buckets are gone when the stage has ended."""
    held = []
    written = common.written
    monkeypatch.setattr(common, "written", lambda df, *a: held.append(written(df, *a)) or held[-1])
    docs = spark.createDataFrame(edited(), DOCS)
    distinct = written(corpus_pipeline.exact_duplicates(spark, docs, ""), "distinct")
    assert held and not any("text" in t.columns for t in held)
    held.clear()
    assert corpus_pipeline.near_duplicates(spark, distinct, "").count()
    assert [t.columns for t in held if "text" in t.columns] == [[*DOCS.fieldNames(), "__row"]]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [f for t in held for f in t.inputFiles() if (p := folder(f)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)]
    assert not [f for f in there if any(x in f for x in ("shingle-sets", "near-sets", "near-buckets", "near-met", "near-open"))]
