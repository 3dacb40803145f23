"""SimHash near-duplicates by covering locality-sensitive hashing.

Each document's 64-bit fingerprint comes from its three-word shingles.
Candidate pairs come from ``2^(r+1) - 1`` structured bit masks: bit position
``i`` is given a non-zero vector ``m(i)`` of ``r + 1`` bits, and mask ``v`` keeps
the positions whose inner product with ``v`` is odd.  The vectors of any ``r``
differing positions span at most ``r`` dimensions, so some non-zero ``v`` is
orthogonal to all of them: its mask keeps none of the differing bits, and the
pair collides in that table.  No pair within the radius is missed.

Copies collapse to one row per distinct fingerprint before any table is built.
Inside a bucket only a spanning forest of links is emitted, never all pairs; a
bucket above ``BLOCK`` fingerprints is dealt as pairs of blocks.

Defined results: null or empty text has fingerprint zero, linked like any
other; a null ``doc_id`` gets a fingerprint and its component (null only if no
member has an id); repeated rows are returned as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

RADIUS = 3
SHINGLE = 3
#: Fingerprints of a bucket that one task compares at a time.
BLOCK = 2_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The ``2^(radius+1) - 1`` covering masks, as signed longs."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(bits)]  # position -> non-zero vector, evenly
    out = []
    for v in range(1, top):
        m = sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` and ``fp`` (a signed long holding the 64 bits)."""
    keep = docs.columns if keep is None else keep
    (fp,) = common.fresh(docs, "fp")
    columns = list(dict.fromkeys([*keep, text_col]))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name in keep] + [T.StructField(fp, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(x) for x in batch.column(text_col).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            arrays = [pa.array(out) if f.name == fp else batch.column(f.name).cast(f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return docs.select(*columns).mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Spanning-forest links (rows of two values) of the pairs between sorted arrays within the radius."""
    values = np.unique(np.concatenate([a, b]))
    parent = np.arange(len(values))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ia, ib = np.searchsorted(values, a), np.searchsorted(values, b)
    links = []
    ub = b.view(np.uint64)
    for at in range(0, len(a), 256):
        ua = a[at : at + 256].view(np.uint64)
        near = np.bitwise_count(ua[:, None] ^ ub[None, :]) <= radius
        for i, j in np.argwhere(near):
            x, y = root(ia[at + i]), root(ib[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((values[ia[at + i]], values[ib[j]]))
    return np.array(links, np.int64).reshape(-1, 2)


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of ``fp`` within the radius.

    ``distinct`` has one row per fingerprint (``fp``).
    """
    tables = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    keyed = distinct.select("fp", F.explode(tables).alias("t")).select("fp", "t.mask", "t.key")
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    placed = keyed.join(sizes, ["mask", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # member of block x takes part in the block pairs (x, y) and (y, x), each written low-high
    dealt = placed.where("blocks > 1").withColumn("own", own).select(
        "mask", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.select("mask", "key", "fp", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iat[0], pdf["high"].iat[0]
        a = np.unique(pdf["fp"][pdf["own"] == low].to_numpy(np.int64))
        b = a if low == high else np.unique(pdf["fp"][pdf["own"] == high].to_numpy(np.int64))
        out = _forest(a, b, radius)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    small = _small_buckets(placed.where("blocks = 1").select("mask", "key", "fp"), radius)
    large = dealt.groupBy("mask", "key", "low", "high").applyInPandas(find, "a long, b long")
    return small.unionByName(large).distinct()


def _small_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets of at most one block: rows sorted by bucket are streamed, one bucket held at a time."""
    schema = to_arrow_schema(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            block = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "fp")], axis=1)
            block = block if rest is None else np.concatenate([rest, block])
            cut = np.flatnonzero((block[1:, :2] != block[:-1, :2]).any(axis=1)) + 1
            if not len(cut):
                rest = block
                continue
            rest = block[cut[-1] :]
            yield from spans(block[: cut[-1]], np.concatenate([[0], cut]))
        if rest is not None and len(rest):
            yield from spans(rest, np.array([0, len(rest)]))

    def spans(block: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(edges)
        fp = block[:, 2]
        two = edges[:-1][sizes == 2]  # most buckets: one comparison each, all at once
        near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
        out = [np.stack([fp[two][near], fp[two + 1][near]], axis=1)]
        out += [_forest(x, x, radius) for x in (fp[s : s + n] for s, n in zip(edges[:-1][sizes > 2], sizes[sizes > 2]))]
        both = np.concatenate(out)
        if len(both):
            yield from common.emit({"a": both[:, 0], "b": both[:, 1]}, schema)

    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "a long, b long")


def components(prints: DataFrame, name: Column, radius: int = RADIUS, fp: str = "__fp") -> DataFrame:
    """``fp, component_id``: the least ``name`` reachable from each fingerprint by links within the radius."""
    classes = common.written(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(name).alias("least")), "classes")
    graph = common.connected_components(links(classes.select("fp"), radius))
    placed = classes.join(graph.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    placed = common.written(placed, "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(least, "component").select("fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``."""
    (fp,) = common.fresh(docs, "fp")
    prints = common.written(fingerprints(docs, text_col, [id_col]), "fingerprints")
    found = components(prints, F.col(id_col), radius, fp).withColumnRenamed("fp", fp)
    return prints.join(found, fp).select(F.col(id_col).alias("doc_id"), F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The input's columns, one row of each component: that with the least id, null last, and of repeated rows the first."""
    row, kept = common.fresh(docs, "row", "kept")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    (fp,) = common.fresh(numbered, "fp")
    table = common.written(fingerprints(numbered, text_col), "fingerprints")  # freezes the row numbers
    order = F.struct(F.col(id_col).isNull().alias("without"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = components(table.select(id_col, row, fp), order, radius, fp)
    first = found.select(F.col("component_id.row").alias(kept)).distinct()
    return table.join(first, F.col(row) == F.col(kept), "left_semi").select(*docs.columns)


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(common.table(spark, sf_dir, "documents"))
