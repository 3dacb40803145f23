"""Rows that are repeated many times."""

import pyarrow as pa
from pyspark.sql import types as T

from auditlens.llm import suffix_dedup

from .test_text_operators import DOCS, PASSAGE


def test_places_do_not_grow_with_repeated_rows(spark):
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("differ", T.LongType())])

    def count(batch, places):
        yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in places], pa.int64()), pa.array([len(set(p.tolist())) for p in places], pa.int64())], names=["n", "differ"])

    for doc in (None, 7):
        rows = [(doc, PASSAGE * 3, "en", "s", 1)] * 60 + [(8, "x " + PASSAGE, "en", "s", 1)]
        got = suffix_dedup.with_repeats(spark.createDataFrame(rows, DOCS), "doc_id", "text", count, schema).collect()
        assert len(got) == 61 and all(0 < r.n == r.differ for r in got)
        out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS)).where("n_bytes > 300").collect()
        assert len(out) == 60 and all(r.n_removed == r.n_bytes for r in out)


def test_thousands_of_equal_rows(spark):
    """Time and places stay in proportion to the rows."""
    import time

    from pyspark.sql import functions as F

    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 19) for i in range(1000))
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(8, text[100:900] + "!"), (9, "unlike " * 3)], docs.schema))
    began = time.monotonic()
    got = suffix_dedup.suffix_dedup(docs).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(7, 2000, 2000, 20_000), (8, 801, 800, 1), (9, 21, 0, 1)}
    assert time.monotonic() - began < 90
