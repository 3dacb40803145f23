"""Removal of repeated 200-byte strings by suffix arrays over content shards.

A suffix array of the whole corpus, or the merging of every pair of document
shards, grows beyond any cluster; so shards are formed by content.

1. Every 200-byte window of a text has an anchor: the leftmost position of its
   least ``GRAM``-byte hash.  Equal windows have their anchor at the same offset,
   so a repeat can only be found between occurrences of one anchor gram.  Each
   anchor owns a run of windows; their union is its context.
2. Anchor rows are range-partitioned by (gram, context digest), which splits any
   frequent gram over tasks, and streamed: a gram that occurs once is dropped, a
   context that occurs twice is repeated as a whole, and what is left is open.
   Contexts that a task has met twice already go in as one row; the others are
   known to be repeats and are dealt evenly.
3. Open contexts are dealt to shards by gram.  A shard's suffix array is built by
   Larsson-Sadakane refinement (ranks by 8 bytes, then doubling, sorting only
   groups that are not yet single), common prefixes by Kasai's recursion, all
   contexts in lockstep; windows with 200 bytes in common are repeats.
4. A gram with more than ``CAP`` different contexts would crowd a shard.  Its
   windows are told apart by longer grams instead: ranges of ``STEPS[1]`` windows
   share a gram of 184 bytes, then single windows are their own gram.  Each level
   is steps 2 and 3 again, so frequent passages never meet in one task.
5. Spans return to their documents, whose covered bytes are removed.

Rows that are equal in id and text are one row in all these steps; as they repeat each other,
nothing of them is kept.

Cross-shard merging by binary search is replaced by the sharding by content:
equal windows always meet in one shard, so no merge of shards is left.  The README has
the measured cost of the named method.

Contexts of one gram are told apart by 64 bits of XXH3: a wrong removal takes two different
contexts of one gram with equal digests, with ``n`` contexts of a gram at odds of n^2 / 2^65.
Windows of different contexts are compared by their bytes.

Defined results: null text is empty and keeps nothing; repeated rows repeat each
other; a null ``doc_id`` is allowed; texts under 200 bytes lose nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

LENGTH = 200
GRAM = 64
#: Windows that share one gram, by level.
STEPS = (LENGTH - GRAM + 1, 17, 1)
#: Different contexts of one gram that a shard takes.
CAP = 250
#: Context bytes for which one suffix array is built.
SHARD_BYTES = 1 << 20
#: Bytes that are hashed at a time.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
#: ``known``: 0 for a row of its own, 1 for one that stands for several of its task, 2 for the others of those.
_ROWS = T.StructType([T.StructField(n, T.LongType()) for n in ("gram", "context", "row", "place", "known")])


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row; together with its length it names it beyond doubt."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))


def pack(at, size, low, high):
    """Anchor position, row length (16 bits), and the first and last owned window as distances before the anchor."""
    return np.asarray(at, np.int64) << 32 | (np.asarray(size, np.int64) & 0xFFFF) << 16 | np.asarray(low, np.int64) << 8 | np.asarray(high, np.int64)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, place >> 16 & 0xFFFF, place >> 8 & 0xFF, place & 0xFF


_powers: list[np.ndarray] = []


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every position."""
    if not _powers:
        size = SEGMENT + 2 * LENGTH
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.extend([np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(raw)], dtype=np.uint64)])
    n = len(raw) - gram + 1
    h = (sums[gram:] - sums[:-gram]) * _powers[1][:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts laid end to end: position, gram hash, first and last owned window start."""
    out = []
    for start in range(0, len(raw), SEGMENT):
        part = raw[start : start + SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            break
        h = gram_hashes(part)
        tagged = (h >> np.uint64(24)) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(tagged, LENGTH - GRAM + 1)
        window = np.arange(len(least))
        near = ends[np.searchsorted(ends, start, side="right") : np.searchsorted(ends, start + len(least), side="left") + 1]
        stops = np.minimum(near - start, len(least))  # where each text's windows stop within the segment
        inside = window + (start + LENGTH) <= np.repeat(near, np.diff(stops, prepend=0))
        window, least = window[inside], least[inside]
        if not len(window):
            continue
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1
        at = (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
        out.append((start + at, h[at].view(np.int64), start + window[first], start + window[last]))
    if not out:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def anchor_rows(keyed: DataFrame) -> DataFrame:
    """``gram, context, row, place`` of every anchor of ``row, text``."""
    arrow = to_arrow_schema(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for tab in common.chunks(batches, "text", 8 << 20):
            texts = [t.encode() for t in common.texts_of(tab, "text")]
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            whole = b"".join(texts)
            at, gram, low, high = anchors(np.frombuffer(whole, np.uint8), ends)
            doc = np.searchsorted(ends, at, side="right")
            begin = (ends - sizes)[doc]
            near, far = at - high, at - low  # distances before the anchor of the last and first window
            shape = (near << 8 | far).tolist()
            context = np.fromiter((digest(whole[a : b + LENGTH], s) for a, b, s in zip(low.tolist(), high.tolist(), shape)), np.uint64, len(at)).view(np.int64)
            rows = tab.column("row").to_numpy()[doc]
            if len(at):
                yield from common.emit(combined(gram, context, rows, pack(at - begin, sizes[doc], near, far)), arrow)

    return keyed.mapInArrow(run, _ROWS)


def combined(gram: np.ndarray, context: np.ndarray, row: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of ``_ROWS``: of equal contexts one row keeps its gram, the others get scattered ones."""
    order = np.lexsort((context, gram))
    gram, context, row, place = gram[order], context[order], row[order], place[order]
    same = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])
    more, first = np.concatenate([[False], same]), np.concatenate([same, [False]])
    known = np.where(more, 2, np.where(first, 1, 0))
    mixed = (row.view(np.uint64) ^ place.view(np.uint64) * np.uint64(_BASE)) * np.uint64(0xD1342543DE82EF95)
    return {"gram": np.where(more, mixed.view(np.int64), gram), "context": context, "row": row, "place": place, "known": known}


def classify(rows: DataFrame) -> DataFrame:
    """Rows that may be repeats, with ``whole``: true for each row whose context occurs again, false once for each
    different context of a gram that occurs again.

    A gram at the edge of a task's range may go on in the next: it stays open.
    """
    schema = T.StructType([*_ROWS.fields, T.StructField("whole", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def settle(block: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``block``: complete runs of (gram, context); ``edge``: rows of grams that may go on elsewhere."""
        gram_new = np.concatenate([[True], block[1:, 0] != block[:-1, 0]])
        pair_new = gram_new | np.concatenate([[True], block[1:, 1] != block[:-1, 1]])
        gram_id, pair_id = np.cumsum(gram_new) - 1, np.cumsum(pair_new) - 1
        again = np.bincount(pair_id, 1 + block[:, 4])[pair_id] > 1
        live = (np.bincount(gram_id)[gram_id] > 1) | edge
        several = np.bincount(gram_id[pair_new])[gram_id] > 1
        first = pair_new & live & (several | edge)
        for mask, whole in ((again, True), (first, False)):
            part = block[mask]
            if len(part):
                yield from common.emit({n: part[:, j] for j, n in enumerate(_ROWS.names)} | {"whole": np.full(len(part), whole)}, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, head, split = None, None, None  # head: the task's first gram; split: a gram already passed on in part
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            sure = block[:, 4] == 2
            if sure.any():
                yield from common.emit({n: block[sure, j] for j, n in enumerate(_ROWS.names)} | {"whole": np.full(int(sure.sum()), True)}, arrow)
                block = block[~sure]
                if not len(block):
                    continue
            block = block if rest is None else np.concatenate([rest, block])
            head = block[0, 0] if head is None else head
            gram_cut = np.flatnonzero(block[1:, 0] != block[:-1, 0])
            pair_cut = np.flatnonzero((block[1:, :2] != block[:-1, :2]).any(axis=1))
            if len(gram_cut):
                cut = gram_cut[-1] + 1
            elif len(pair_cut) and len(block) > 200_000:  # a very frequent gram is passed on in parts
                cut = pair_cut[-1] + 1
            else:
                rest = block
                continue
            done, rest = block[:cut], block[cut:]
            yield from settle(done, (done[:, 0] == head) | (done[:, 0] == split) | (done[:, 0] == rest[0, 0]))
            split = rest[0, 0] if done[-1, 0] == rest[0, 0] else split
        if rest is not None:
            yield from settle(rest, (rest[:, 0] == head) | (rest[:, 0] == split) | (rest[:, 0] == rest[-1, 0]))

    spread = rows.repartitionByRange("gram", "context").sortWithinPartitions("gram", "context")
    return spread.select(*_ROWS.names).mapInArrow(run, schema)


def open_contexts(keyed: DataFrame, asked: DataFrame, level: int) -> DataFrame:
    """Fetch the bytes of open contexts from their texts.

    ``asked``: ``gram, row, place, frequent``.  Rows with ``bytes`` go to a shard;
    those without are the same windows under the longer grams of the next level.
    """
    wanted = asked.groupBy("row").agg(F.collect_list(F.struct("gram", "place", "frequent")).alias("asked"))
    joined = keyed.join(wanted, "row").select("row", "text", "asked")
    schema = T.StructType([*_ROWS.fields, T.StructField("bytes", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    step = STEPS[level + 1] if level + 1 < len(STEPS) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for tab in common.chunks(batches, "text", 4 << 20):
            near: list[tuple] = []
            finer: list[tuple] = []
            for row, text, wants in zip(tab.column("row").to_pylist(), common.texts_of(tab, "text"), tab.column("asked").to_pylist()):
                body = text.encode()
                for want in wants:
                    gram, place = want["gram"], want["place"]
                    at, size, low, high = (int(x) for x in unpack(np.int64(place)))
                    if size != len(body) & 0xFFFF:
                        continue
                    if not want["frequent"]:
                        near.append((gram, row, place, body[at - high : at - low + LENGTH]))
                        continue
                    for n in range(low // step, high // step + 1):
                        a, b = n * step, n * step + step - 1
                        core = digest(body[max(0, at - a) : at - b + LENGTH], (gram ^ n) & (1 << 64) - 1)
                        a, b = max(a, low), min(b, high)
                        inner = digest(body[at - b : at - a + LENGTH], a << 8 | b)
                        finer.append((_signed(core), _signed(inner), row, int(pack(at, size, a, b))))
                if len(near) > 20_000:
                    yield from shard_rows(near)
                    near = []
            yield from shard_rows(near)
            if finer:
                yield from common.emit(combined(*(np.array(c, np.int64) for c in zip(*finer))) | {"bytes": [None] * len(finer)}, arrow)

    def shard_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            gram, row, place, body = zip(*rows)
            yield from common.emit({"gram": gram, "context": [0] * len(rows), "row": row, "place": place, "known": [0] * len(rows), "bytes": body}, arrow)

    return joined.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def suffix_array(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``raw`` in order, and each one's place.

    Larsson-Sadakane: ``rank`` holds the last place of a suffix's group of equals;
    each round sorts only the groups that still have several members, by the
    ranks of the suffixes ``h`` bytes further on, and so doubles ``h``.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    room = np.minimum(np.arange(n, 0, -1), 8)  # a suffix that ends is before one that goes on with zeros
    order = np.lexsort((room, key))
    fresh = np.concatenate([(key[order[1:]] != key[order[:-1]]) | (room[order[1:]] != room[order[:-1]]), [True]])
    rank = np.empty(n, np.int64)
    ends = np.flatnonzero(fresh)
    rank[order] = np.repeat(ends, np.diff(ends, prepend=-1))
    h = 8
    while h < n:
        lone = np.concatenate([[True], fresh[:-1]]) & fresh
        at = np.flatnonzero(~lone)  # places of groups with several members
        if not len(at):
            break
        member = order[at]
        further = np.where(member + h < n, rank[np.minimum(member + h, n - 1)], -1)
        own = rank[member]
        by = np.lexsort((further, own))
        member, further, own = member[by], further[by], own[by]
        order[at] = member
        split = np.concatenate([(own[1:] != own[:-1]) | (further[1:] != further[:-1]), [True]])
        fresh[at] = split
        last = np.flatnonzero(split)
        rank[member] = at[np.repeat(last, np.diff(last, prepend=-1))]
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(raw: np.ndarray, order: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Kasai: for each suffix the bytes (up to ``most``) it shares with the one before it in order.

    From one position to the next the common prefix shrinks by one at most.  The
    stretches from ``starts`` to ``ends`` step together, each comparing one byte or
    moving on.
    """
    n = len(raw)
    out = np.zeros(n, np.int16)
    at, shared = starts.copy(), np.zeros(len(starts), np.int64)
    live = np.flatnonzero(at < ends)
    while len(live):
        i, h = at[live], shared[live]
        p = place[i]
        j = order[np.maximum(p - 1, 0)]
        same = (p > 0) & (h < most) & (np.maximum(i, j) + h < n)
        same &= raw[np.minimum(i + h, n - 1)] == raw[np.minimum(j + h, n - 1)]
        out[i[~same]] = h[~same]
        shared[live] = np.where(same, h + 1, np.maximum(h - 1, 0))
        at[live] = np.where(same, i, i + 1)
        live = live[at[live] < ends[live]]
    return out


def repeats_in_shard(contexts: list[bytes], far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur in two contexts of a shard at the same distance before their anchor: context, distance."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    order, place = suffix_array(raw)
    shared = common_prefixes(raw, order, place, starts, ends)
    text = np.cumsum(shared[order] < LENGTH)  # suffixes with one number have 200 bytes in common
    full = np.flatnonzero(np.arange(len(raw)) + LENGTH <= ends[owner])
    context = owner[full]
    distance = far[context] - (full - starts[context])
    label = text[place[full]] * 256 + distance
    _, inverse, count = np.unique(label, return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    return context[hit], distance[hit]


def shard_spans(contexts: DataFrame) -> DataFrame:
    """``row, place`` of repeated windows (as ranges) among open contexts ``gram, row, place, bytes``."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("place", T.LongType())])
    arrow = to_arrow_schema(schema)

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = pa.Table.from_batches(held)
        places = tab.column("place").to_numpy()
        at, size, near, far = unpack(places)
        context, distance = repeats_in_shard(tab.column("bytes").to_pylist(), far)
        if not len(context):
            return
        by = np.lexsort((distance, context))
        context, distance = context[by], distance[by]
        cut = np.concatenate([[True], (context[1:] != context[:-1]) | (distance[1:] != distance[:-1] + 1)])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(cut)) - 1
        c = context[first]
        yield from common.emit({"row": tab.column("row").to_numpy()[c], "place": pack(at[c], size[c], distance[first], distance[last])}, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            grams = batch.column("gram").to_numpy()
            lengths = np.diff(np.frombuffer(batch.column("bytes").buffers()[1], np.int32)[batch.column("bytes").offset :][: batch.num_rows + 1])
            start = 0
            for end in [*(np.flatnonzero(grams[1:] != grams[:-1]) + 1).tolist(), len(grams)]:
                if size >= SHARD_BYTES and grams[start] != last:
                    yield from solve(held)
                    held, size = [], 0
                held.append(batch.slice(start, end - start))
                size += int(lengths[start:end].sum())
                last, start = grams[end - 1], end
        if held:
            yield from solve(held)

    return contexts.repartition("gram").sortWithinPartitions("gram").select("gram", "row", "place", "bytes").mapInArrow(run, schema)


def repeated_windows(keyed: DataFrame, cap: int = CAP) -> tuple[DataFrame, list[DataFrame]]:
    """``row, place``: ranges of windows of ``row, text`` that occur anywhere else; and the tables it reads."""
    # dealing by range reads its rows twice, so they are made once
    rows, found, held = common.written(anchor_rows(keyed), "suffix-anchors"), None, []
    for level in range(len(STEPS)):
        sorted_out = common.written(classify(rows), "suffix-classes")
        if not level:
            common.discard(rows)
        held.append(sorted_out)
        whole = sorted_out.where("whole").select("row", "place")
        found = whole if found is None else found.unionByName(whole)
        if level + 1 == len(STEPS):
            break  # a window is its own gram: nothing stays open
        sizes = sorted_out.where("not whole").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
        sizes = common.written(sizes, "suffix-grams")  # so that the join below is between two shuffles, which AQE splits
        asked = sorted_out.where("not whole").join(sizes, "gram").select("gram", "row", "place", (F.col("n") > cap).alias("frequent"))
        fetched = common.written(open_contexts(keyed, asked, level), "suffix-contexts")
        held += [sizes, fetched]
        found = found.unionByName(shard_spans(fetched.where("bytes is not null")))
        rows = fetched.where("bytes is null").select(*_ROWS.names)
        if rows.isEmpty():
            break
    return found, held


def single_rows(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``row, text`` with each row once; and ``row, place`` of the rows that occur several times, if any do.

    Their negative place stands for the whole text; rows are told apart by two hashes.
    """
    twice = keyed.withColumn("check", F.xxhash64(F.lit("second"), "text"))
    several = twice.groupBy("row", "check", F.octet_length("text").alias("size")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    several = common.written(several, "suffix-several")
    if several.isEmpty():
        return keyed, None
    name = ["row", "check"]
    once = twice.join(several, name, "left_anti").select("row", "text")
    again = twice.join(several, name, "left_semi").groupBy(*name).agg(F.first("text").alias("text")).select("row", "text")
    return once.unionByName(again), several.select("row", whole_place(F.col("size")).cast("long").alias("place"))


def whole_place(size):
    """The place that stands for the whole of a text of ``size`` bytes."""
    return -1 - size % 65536


def covered(size: int, places: np.ndarray) -> np.ndarray:
    """Which bytes of a text of ``size`` bytes the window ranges cover."""
    if (places == whole_place(size)).any():
        return np.ones(size, bool)
    places = places[places >= 0]
    at, length, near, far = unpack(places)
    fits = length == size & 0xFFFF
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, (at - far)[fits], 1)
    np.add.at(step, (at - near + LENGTH)[fits], -1)
    return np.cumsum(step[:-1]) > 0


def with_repeats(docs: DataFrame, id_col: str, text_col: str, function, schema: T.StructType) -> DataFrame:
    """Join each row with its repeated windows and map ``function(batch, places of each row)`` over them."""
    key, spots = common.fresh(docs, "row", "places")
    keyed = docs.select(row_key(id_col, text_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    single, several = single_rows(keyed.where(F.octet_length("text") >= LENGTH))
    found, tables = repeated_windows(single)
    if several is not None:
        found = found.unionByName(several)
    found = common.written(found.groupBy(F.col("row").alias(key)).agg(F.collect_set("place").alias(spots)), "suffix-found")
    common.discard(*tables)
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(found, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.array(x or [], np.int64) for x in batch.column(spots).to_pylist()]
            yield from function(batch, places)

    return joined.mapInArrow(run, schema)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def measure(batch: pa.RecordBatch, places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {n: [] for n in arrow.names}
        cols["doc_id"] = batch.column("doc_id").to_pylist()
        for text, at in zip(batch.column("text").to_pylist(), places):
            body = (text or "").encode()
            gone = covered(len(body), at)
            cols["n_bytes"].append(len(body))
            cols["n_removed"].append(int(gone.sum()))
            cols["n_spans"].append(int((gone[1:] > gone[:-1]).sum() + gone[:1].sum()))
            kept = np.frombuffer(body, np.uint8)[~gone].tobytes() if len(at) else body
            cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        yield from common.emit(cols, arrow)

    return with_repeats(docs, "doc_id", "text", measure, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, texts without their repeated bytes.

    A character of which only some bytes are covered stays, so texts stay valid
    UTF-8.  A text that is removed wholly becomes empty; a null text stays null.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    arrow = to_arrow_schema(schema)

    def cut(batch: pa.RecordBatch, places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        texts = batch.column(text_col).to_pylist()
        for i, at in enumerate(places):
            if len(at):
                body = np.frombuffer(texts[i].encode(), np.uint8)
                gone = covered(len(body), at)
                lead = np.flatnonzero((body & 0xC0) != 0x80)  # first bytes of characters
                whole = np.logical_and.reduceat(gone, lead)
                texts[i] = body[~np.repeat(whole, np.diff(np.append(lead, len(body))))].tobytes().decode()
        arrays = [pa.array(texts, f.type) if f.name == text_col else batch.column(f.name).cast(f.type) for f in arrow]
        yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return with_repeats(docs, id_col, text_col, cut, schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT *, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(m.b, 0), d.n FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM s GROUP BY doc_id) m USING (doc_id)),
t AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS rest FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
