"""The corpus pipeline: five stages of the training-data operators over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.

Defined results: null and empty texts, and texts without a letter in a script that some
labelled document writes, go in the first stage; a null ``lang`` becomes the predicted one.  Of equal
and of similar texts the row with the least ``doc_id`` stays (of equal ones first the longest), null
ids last, of repeated rows one.  A text that is repeated elsewhere as a whole is empty after the
fourth stage and packed as its end id.  Further columns of any name are passed on.  An empty table
gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlens.llm import common, exact_dedup, langid, near_dup, packing, suffix_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, null labels filled; unlabelled scripts and texts without letters go."""
    common.importable(spark)
    return langid.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    common.importable(spark)
    return exact_dedup.keep_distinct(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links (five-word shingles, Jaccard similarity of 0.8 or more): SimHash links of
    the covering hash, checked, and what no radius of fingerprints reaches."""
    common.importable(spark)
    return near_dup.keep_representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur elsewhere."""
    common.importable(spark)
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    common.importable(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", pack),
]

#: Language models, suffix arrays and tokenizers are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
