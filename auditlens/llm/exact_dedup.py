"""Exact deduplication over an extendible-hash index on shared files.

1. Map tasks normalise each text, hash it and write the index files to the
   shared folder: a light row per document, and per chunk one content row for
   each distinct text (its best row and how many rows it stands for), so a text
   with millions of copies reaches its owner as one row per chunk.
2. The directory starts at a global depth that fits the entry count and is
   doubled: a slot whose bucket is overfull gets one more hash bit, until its
   buckets fit or the bits run out.
3. Owner tasks process key ranges of about ``OWNER_BYTES``: the buckets of a range one after
   another, and the buckets of an overfull slot each by a task of its own.  Rows sorted by key are
   streamed, rows of one key form a chain, and texts in a chain are equal only
   if their bytes are.

Defined results: null text counts as empty; a null ``doc_id`` sorts last among
candidates; repeated rows are separate rows of which exactly one is kept; an
empty table gives an empty result; columns of the input are passed through
untouched whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Characters that normalisation deletes (fixed values): tab to carriage return, and space.
SPACE = b"\t\n\x0b\x0c\r "
#: Entries and text bytes that a bucket of the index holds.
BUCKET_ROWS = 50_000
BUCKET_BYTES = 16 << 20
#: Text bytes that an owner task takes.
OWNER_BYTES = 64 << 20


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACE)


def key_of(digest: bytes) -> int:
    """Signed 64-bit key: the first eight bytes of the digest."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _better(a: tuple, b: tuple) -> bool:
    """Candidates are (code points, doc_id, row id): longest, then least id, then first."""
    rank = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])
    return rank(a) < rank(b)


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """The rows of the index files, not written yet, and the internal column names."""
    names = dict(zip(("kind", "key", "sha", "points", "count", "rid"), common.fresh(docs, "kind", "key", "sha", "points", "count", "rid")))
    source = docs.withColumn(names["rid"], F.monotonically_increasing_id())
    schema = T.StructType(
        source.schema.fields
        + [
            T.StructField(names["kind"], T.IntegerType()),
            T.StructField(names["key"], T.LongType()),
            T.StructField(names["sha"], T.StringType()),
            T.StructField(names["points"], T.LongType()),
            T.StructField(names["count"], T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    rid = names["rid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in common.chunks(batches, text_col):
            texts = common.texts_of(tab, text_col)
            ids, rids = tab.column(id_col).to_pylist(), tab.column(rid).to_pylist()
            keys, shas, points = [], [], []
            best: dict[bytes, list] = {}
            for i, text in enumerate(texts):
                body = normalised(text)
                digest = hashlib.sha256(body)
                keys.append(key_of(digest.digest()))
                shas.append(digest.hexdigest())
                points.append(len(text))
                held = best.get(body)
                if held is None:
                    best[body] = [i, 1]
                else:
                    held[1] += 1
                    j = held[0]
                    if _better((points[i], ids[i], rids[i]), (points[j], ids[j], rids[j])):
                        held[0] = i
            n = len(texts)
            light = {f.name: tab.column(f.name) if f.name in (id_col, rid) else pa.nulls(n, f.type) for f in arrow if f.name in tab.column_names}
            light |= {names["kind"]: np.zeros(n, np.int32), names["key"]: keys, names["sha"]: shas, names["points"]: points, names["count"]: np.ones(n, np.int64)}
            yield from _batches(light, arrow)
            at = np.fromiter((x[0] for x in best.values()), np.int64, len(best))
            full = tab.take(pa.array(at))
            rows = {f.name: full.column(f.name) for f in arrow if f.name in tab.column_names}
            rows |= {names["kind"]: np.ones(len(at), np.int32), names["key"]: [keys[i] for i in at], names["sha"]: [shas[i] for i in at], names["points"]: [points[i] for i in at], names["count"]: [x[1] for x in best.values()]}
            yield from _batches(rows, arrow)

    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return source.mapInArrow(run, loose), names


def index_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """Write the index files; returns the table and its internal column names."""
    rows, names = entries(docs, id_col, text_col)
    return common.written(rows, "exact-index"), names


def _batches(columns: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    arrays = []
    for f in schema:
        x = columns[f.name]
        arrays.append(x.cast(f.type) if isinstance(x, (pa.ChunkedArray, pa.Array)) else pa.array(x, type=f.type))
    yield from pa.Table.from_arrays(arrays, names=schema.names).to_batches(max_chunksize=5_000)


def directory(content: DataFrame, key: str, size: str, start: int, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame | None:
    """``slot, depth``: for each slot of the initial directory that is overfull, the depth at which its buckets fit.

    Slots that fit are not listed; None if all fit.  Each doubling counts only the keys of slots
    that are still overfull; keys that are all equal cannot be split and stop
    the doubling when a bucket has a single key.
    """
    slots = content.select(F.col(key).alias("key"), F.col(size).alias("size")).withColumn("slot", F.expr(f"shiftrightunsigned(key, {64 - start})"))
    over = (F.sum("size") > bucket_bytes) | (F.count("*") > bucket_rows)
    split = F.min("key") < F.max("key")
    found, depth = None, start
    open_slots = slots.groupBy("slot").agg((over & split).alias("over")).where("over").select("slot")
    while depth < 62:
        open_slots = common.written(open_slots, "directory")
        if open_slots.isEmpty():
            break
        depth += 1
        done_at = (
            slots.join(open_slots, "slot")
            .groupBy("slot", F.expr(f"shiftrightunsigned(key, {64 - depth})").alias("bucket"))
            .agg((over & split).alias("over"))
            .groupBy("slot")
            .agg(F.max("over").alias("over"))
        )
        done_at = common.written(done_at, "directory")
        closed = done_at.where("not over").select("slot", F.lit(depth).alias("depth"))
        found = closed if found is None else found.unionByName(closed)
        open_slots = done_at.where("over").select("slot")
    return found


def text_bytes(content: DataFrame, key: str, text_col: str, name: str) -> DataFrame:
    return content.select(key, F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias(name))


def groups(index: DataFrame, names: dict, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, start: int | None = None, light: DataFrame | None = None) -> DataFrame:
    """One row per distinct normalised text: the columns of its kept row, and ``key, sha, points, count, rid`` of the group.

    The directory is made of ``light``, if given: the key and text bytes of the content rows as a table without texts.
    """
    kind, key, rid, points, count, sha = (names[k] for k in ("kind", "key", "rid", "points", "count", "sha"))
    content = index.where(f"{kind} = 1").drop(kind)
    size, slot, depth, bucket, task = common.fresh(content, "bytes", "slot", "depth", "bucket", "owner")
    sized = text_bytes(content, key, text_col, size) if light is None else light.toDF(key, size)
    total = sized.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    start = start or math.ceil(math.log2(max(2 * total["n"] / bucket_rows, 2 * (total["b"] or 0) / bucket_bytes, 2)))
    owners = max(1, math.ceil((total["b"] or 0) / OWNER_BYTES))
    deeper = directory(sized, key, size, start, bucket_bytes, bucket_rows)
    placed = content.withColumn(slot, F.expr(f"shiftrightunsigned({key}, {64 - start})"))
    by_range = F.floor(F.col(slot) * owners / (1 << start)).cast("int")
    if deeper is None:
        placed = placed.withColumn(task, by_range).withColumnRenamed(slot, bucket)
    else:
        placed = placed.join(deeper.withColumnsRenamed({"slot": slot, "depth": depth}), slot, "left")
        local = F.coalesce(F.col(depth), F.lit(start))
        placed = placed.withColumn(bucket, F.call_function("shiftrightunsigned", F.col(key), F.lit(64) - local))
        placed = placed.withColumn(task, F.when(F.col(depth).isNull(), by_range).otherwise(F.pmod(F.xxhash64(local, bucket), F.lit(owners)).cast("int")))
    out_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in content.schema])
    arrow = to_arrow_schema(out_schema)

    def owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams rows in key order; holds one chain and one batch."""
        chain: list[list] = []  # [bytes, best row as a one-row batch, best rank, rows]
        now = None
        ready: list[list] = []

        def flush():
            if not ready:
                return
            tab = pa.Table.from_batches([x[1] for x in ready]).select(arrow.names)
            cols = {f.name: tab.column(f.name) for f in arrow}
            cols[count] = [x[3] for x in ready]
            ready.clear()
            yield from _batches(cols, arrow)

        for batch in batches:
            keys = batch.column(key).to_pylist()
            bodies = batch.column(text_col).to_pylist()
            ids, rids = batch.column(id_col).to_pylist(), batch.column(rid).to_pylist()
            lens, ns = batch.column(points).to_pylist(), batch.column(count).to_pylist()
            for i, k in enumerate(keys):
                if k != now:
                    ready.extend(chain)
                    chain, now = [], k
                    if len(ready) >= 2_000:
                        yield from flush()
                body, rank = normalised(bodies[i]), (lens[i], ids[i], rids[i])
                for link in chain:
                    if link[0] == body:  # equal bytes, not just an equal key
                        link[3] += ns[i]
                        if _better(rank, link[2]):
                            link[1], link[2] = batch.slice(i, 1), rank
                        break
                else:
                    chain.append([body, batch.slice(i, 1), rank, ns[i]])
        ready.extend(chain)
        yield from flush()

    return placed.repartitionById(owners, task).sortWithinPartitions(bucket, key).mapInArrow(owner, out_schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``; ``sizes``: those of :func:`groups`."""
    index, names = index_files(docs, id_col, text_col)
    key, sha, rid, count = names["key"], names["sha"], names["rid"], names["count"]
    best = groups(index, names, id_col, text_col, **sizes).select(
        F.col(key).alias("key"), F.col(sha).alias("sha"), F.col(id_col).alias("keep_id"), F.col(rid).alias("keep_rid"), F.col(count).alias("group_size")
    )
    best = common.written(best, "exact-groups")
    rows = index.where(f"{names['kind']} = 0").select(F.col(id_col).alias("doc_id"), F.col(key).alias("key"), F.col(sha).alias("sha"), F.col(rid).alias("rid"))
    return rows.join(best, ["key", "sha"]).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without exact copies, with the input's columns.

    No later result reads the light rows or a row's number, so the index files have keys and sizes only: texts go to
    their owners straight from ``docs`` and no second copy of them stays on disk.
    """
    rows, names = entries(docs, id_col, text_col)
    light = text_bytes(rows.where(f"{names['kind']} = 1"), names["key"], text_col, "bytes")
    light = common.written(light, "exact-index")
    found = groups(rows, names, id_col, text_col, light=light)
    return found.select(*docs.columns)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS b FROM documents),
h AS (SELECT doc_id, length(t) AS cp, sha256(b) AS text_sha256 FROM n),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
