"""The corpus pipeline: its stages' columns, and all of it against plain Python."""

import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from auditlens.llm import common, langid

from .test_language_predictions import told
from .test_near_duplicates import brute as distinct_texts
from .test_near_duplicates import edited
from .test_supported_letters import THAI
from .test_text_operators import DOCS, repeats, rows

SMALL = "/root/testdata/sf0.001"


def brute(table):
    """What is left of each row: Counter of (doc_id, tokens)."""
    table = [r for r, (_, lang, _, known) in zip(table, told(table)) if lang != "und" and known >= langid.REJECT_BELOW]
    groups = {}
    for r in table:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1] or ""), []).append(r)
    table = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    ids = list(distinct_texts(table).elements())
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for (doc, _), (body, gone) in zip(ids, repeats([text for _, text in ids])):
        kept, at = bytearray(), 0
        for ch in body.decode():
            raw = ch.encode()
            if not gone[at : at + len(raw)].all():
                kept += raw
            at += len(raw)
        out[doc, len(tokenizer.encode(kept.decode(), add_special_tokens=False).ids) + 1] += 1
    return out


def packed(df):
    """Counter of (doc_id, tokens) of the pieces; each document's pieces add up."""
    found = df.collect()
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
    return Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0)


def test_stages_keep_columns(spark):
    docs = common.table(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "suffix_dedup", "packing"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = common.written(stage(spark, docs, SMALL), "stage")
        assert new.columns == docs.columns and dict(new.dtypes) == dict(docs.dtypes) and 0 < new.count() <= docs.count()
        docs = new
    assert docs.count() < before


def test_pipeline_equals_brute_force(spark):
    table = [tuple(r) for r in common.table(spark, SMALL, "documents").select("doc_id", "text", "lang").collect()]
    assert packed(corpus_pipeline.run(spark, SMALL)) == brute(table)


@pytest.fixture(scope="module")
def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, and texts in a script nobody labels."""
    table = rows() + [(1000 + r[0], *r[1:]) for r in edited()[:60]]
    table += [(5000 + i, THAI * (i + 5), None, None, None) for i in range(3)] + [(5010, THAI * 20 + "one word", None, "s", 1)]
    return table


def test_awkward_rows_and_clashing_columns(spark, awkward, tmp_path):
    docs = spark.createDataFrame(awkward, DOCS).repartition(4)
    for name in ("LANG_PRED", "Lang_Score", "spans", "row", "__row", "key", "node", "set", "gone", "places", "bucket", "owner", "fp"):
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(awkward)
    assert packed(corpus_pipeline.run(spark, str(tmp_path))) == want
    ids = {doc for doc, _ in want}
    assert not ids & {4, 5, 6, 10, 5000, 5001, 5002, 5010} and {0, 1} & ids  # rejected by the language stage, and kept


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
