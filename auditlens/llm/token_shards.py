"""Training-order materialisation: token sequences in permuted order in fixed-stride files.

Documents become token ids with an end id, laid end to end within a task and cut
into sequences of ``length`` ids.  Every sequence has a number (those of earlier
tasks first), and a keyed Feistel permutation of all numbers gives its global
slot; a value outside the range walks on along its cycle until it is inside.  Slot
ranges are shards: a shard is a file of the ids of its slots in order, little-endian
unsigned 16-bit, each slot ``stride`` bytes.  Slot ``s`` lies at byte
``(s % per_shard) * stride`` of the file of shard ``s // per_shard``, so a reader that
stopped at a slot seeks there and goes on, reading nothing else.  Behind its slots a file
has the number (64 bits) and the real length (32 bits) of the sequence of each, and a line feed.

The sequences are written to the shared folder once, so that their numbers stay the
same when tasks run again; then they are numbered, permuted, gathered by shard within
each batch and dealt to shards in one shuffle.  Only one number per input partition reaches
the driver.

Defined results: null or empty text is the end id alone; null ids and repeated
rows are documents like any other; the last sequence of a task is filled up with
the end id, its real length is in the index; an empty table gives no shards.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

LENGTH = 2048
PER_SHARD = 1024
END_ID = 50_256
KEY = 20_240_229
ROUNDS = 6
#: How hard sequences are compressed on their way to the shards.
LEVEL = 9
#: Bytes of a slot's entry behind the slots of a file.
ENTRY = 12


def permute(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The slots of ``numbers``: a permutation of ``range(size)`` chosen by ``key``."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) & (1 << 64) - 1) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(31)
            f *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (f >> np.uint64(29) & mask)
        return left << shift | right

    out = once(np.asarray(numbers, np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class Encoder:
    """Byte-level BPE ids of a rank file; one instance a worker."""

    _loaded: dict = {}

    @classmethod
    def of(cls, path: str):
        if path not in cls._loaded:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            cls._loaded[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return cls._loaded[path]


def sequences(batches: Iterator[pa.RecordBatch], text_col: str, path: str, length: int, end_id: int) -> Iterator[np.ndarray]:
    """A task's ids in pieces of ``length``; the last may be shorter."""
    encode = Encoder.of(path).encode_ordinary
    held: list[np.ndarray] = []
    size = 0
    for tab in common.chunks(batches, text_col, 4 << 20):
        for text in common.texts_of(tab, text_col):
            held.append(np.array([*encode(text), end_id], "<u2"))
            size += len(held[-1])
        if size >= length:
            flat = np.concatenate(held)
            whole = size - size % length
            yield from flat[:whole].reshape(-1, length)
            held, size = [flat[whole:]], size - whole
    if size:
        yield np.concatenate(held)


def shards(docs: DataFrame, text_col: str = "text", ranks: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end_id: int = END_ID) -> str:
    """Write the shard files; returns their folder."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark, stride = docs.sparkSession, 2 * length
    cut = T.StructType([T.StructField("task", T.LongType()), T.StructField("at", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    cut_arrow = to_arrow_schema(cut)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for held in batched(sequences(batches, text_col, path, length, end_id), 500):
            full = [x.tobytes() if len(x) == length else np.concatenate([x, np.full(length - len(x), end_id, "<u2")]).tobytes() for x in held]
            yield from common.emit({"task": [task] * len(held), "at": np.arange(at, at + len(held)), "length": [len(x) for x in held], "ids": full}, cut_arrow)
            at += len(held)

    tokens = common.written(docs.select(text_col).mapInArrow(tokenise, cut), "token-sequences", LEVEL)
    firsts, total = {}, 0
    for task, n in sorted(map(tuple, tokens.groupBy("task").count().collect())):  # one row per input partition
        firsts[task] = total
        total += n
    shared = spark.sparkContext.broadcast(firsts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's sequences by shard, compressed for the shuffle."""
        packer = pa.Codec("zstd", LEVEL)
        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.array([shared.value[t] for t in batch.column("task").to_pylist()], np.int64) + batch.column("at").to_numpy()
            slot = permute(number, total, key)
            order = np.argsort(slot, kind="stable")
            slot, number, size = slot[order], number[order], batch.column("length").to_numpy()[order]
            raw = batch.column("ids").take(pa.array(order))
            cuts = [0, *(np.flatnonzero(np.diff(slot // per_shard)) + 1).tolist(), len(slot)]
            runs = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_pydict({
                "shard": slot[cuts[:-1]] // per_shard, "slots": [slot[i:j].tobytes() for i, j in runs],
                "numbers": [number[i:j].tobytes() for i, j in runs], "lengths": [size[i:j].tobytes() for i, j in runs],
                "packed": [packer.compress(b"".join(raw.slice(i, j - i).to_pylist()), asbytes=True) for i, j in runs],
            })

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by shard; one shard is held at a time."""
        now, held = None, []
        packer = pa.Codec("zstd")

        def flush() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            slots, numbers, lengths, packed = zip(*held)
            at = np.frombuffer(b"".join(slots), np.int64) - now * per_shard
            if len(np.unique(at)) != len(at) or at.max() >= len(at):
                raise ValueError(f"shard {now} has gaps")
            bodies = [packer.decompress(x, len(s) // 8 * stride, asbytes=True) for x, s in zip(packed, slots)]
            columns = [np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, stride), np.frombuffer(b"".join(numbers), np.int64), np.frombuffer(b"".join(lengths), np.int32)]
            placed = [np.empty_like(c) for c in columns]
            for c, p in zip(columns, placed):
                p[at] = c
            yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int64()), "payload": pa.array([b"".join(p.tobytes() for p in placed)], pa.binary())})

        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "slots", "numbers", "lengths", "packed"))):
                if shard != now:
                    yield from flush()
                    now, held = shard, []
                held.append(row)
        yield from flush()

    n_shards = -(-total // per_shard)
    parts = max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = -(-n_shards // parts) if n_shards else 1  # neighbouring shards of one task
    gathered = "shard long, slots binary, numbers binary, lengths binary, packed binary"
    dealt = tokens.mapInArrow(gather, gathered).repartitionById(parts, F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard")
    files = dealt.mapInArrow(assemble, "shard long, payload binary")
    folder = f"{common.shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    # the text writer puts out the bytes of a row as they are; a task has whole shards, so a shard is one file
    files.select("shard", F.col("payload").cast("string")).write.partitionBy("shard").option("compression", "none").text(folder)
    common.discard(tokens)
    return folder


class Reader:
    """Reads slots of a folder of shards from any slot on; only the bytes asked for are read."""

    def __init__(self, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD):
        self.files, base = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        self.length, self.stride, self.per_shard = length, 2 * length, per_shard
        found = self.files.get_file_info(fs.FileSelector(base, recursive=True))
        self.shards = {int(m[1]): (x.path, (x.size - 1) // (self.stride + ENTRY)) for x in found if (m := re.search(r"/shard=(\d+)/part-[^/]*\.txt$", x.path))}

    def __len__(self) -> int:
        return sum(n for _, n in self.shards.values())

    def read(self, start: int, count: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(slot, ids)`` of ``count`` slots from ``start`` on, as far as there are slots."""
        end = min(start + count, len(self))
        while start < end:
            path, n = self.shards[start // self.per_shard]
            at = start % self.per_shard
            take = min(end - start, n - at)
            with self.files.open_input_file(path) as file:
                file.seek(at * self.stride)
                for i in range(take):
                    yield start + i, np.frombuffer(file.read(self.stride), "<u2")
            start += take


def manifest(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """One row per slot: ``slot, shard, byte_offset, sequence, n_tokens, ids_crc32`` (of the real ids), as the files have them."""
    stride = 2 * length
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("slot", "shard", "byte_offset", "sequence", "n_tokens", "ids_crc32")])
    arrow = to_arrow_schema(schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    files = files.select(F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long").alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist()):
                n = (len(body) - 1) // (stride + ENTRY)
                if len(body) != n * (stride + ENTRY) + 1:
                    raise ValueError(f"shard {shard} is not whole")
                number, size = np.frombuffer(body, "<i8", n, n * stride), np.frombuffer(body, "<i4", n, n * (stride + 8))
                at, view = np.arange(n) * stride, memoryview(body)
                crc = [zlib.crc32(view[a : a + 2 * k]) for a, k in zip(at.tolist(), size.tolist())]
                yield from common.emit({"slot": shard * per_shard + np.arange(n), "shard": np.full(n, shard), "byte_offset": at, "sequence": number, "n_tokens": size.astype(np.int64), "ids_crc32": crc}, arrow)

    return files.mapInArrow(run, schema)


def op4_token_shards(spark, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder and returns their manifest."""
    return manifest(spark, shards(common.table(spark, sf_dir, "documents")))
