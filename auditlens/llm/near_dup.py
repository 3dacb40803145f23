"""The pipeline's near-duplicates: covering SimHash links, held to a Jaccard similarity and completed exactly.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of at
least ``LEAST``.  Fingerprints of such pairs differ in up to a third of their bits, more
than covering masks can reach, so the covering hash of :mod:`.simhash` finds the close
copies first, each link is checked on the sets, and prefix filtering finds the rest: with the
shingles of every text in one common order, two sets of similarity ``s`` or more share one of
the first ``n - ceil(s n) + 1`` shingles of each, so no linked pair is missed.  The order puts
the shingles that are frequent in the corpus last, so that common lines and passages are
not met; any order gives the same links.

Texts with equal sets collapse to one node first.  Nodes that share a prefix shingle are
a bucket, and pairs are compared inside buckets: a row carries its set's size, where the shingle stands in it and a
parity bitmap of the set, which together bound what two sets can share (two bitmaps differ in no more bits than
the sets in shingles), so hardly a pair is handed on that is not linked.  A bucket of more than ``BLOCK`` nodes is dealt by classes of
size, since similar sets are of similar size, and a class as pairs of blocks to many tasks.
First every node is tried with one partner of each of its buckets, the most likely one before it, which connects large
groups of near copies by few checks of whole sets; after ``ROUNDS`` of this, all pairs that
bounds allow and whose nodes are not connected yet.  The bounds do not change, so rows that they pair with no other row
of their bucket are met in the first round only.

Disk: prefixes are deleted once buckets are written, and buckets once their first round is over; pairs are checked on
their texts, which are smaller than the sets of their shingles.

Defined results: a text of fewer than five words is one shingle; texts without
words are one group; repeated rows and rows without an id are rows like others.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common, simhash

log = logging.getLogger(__name__)

SHINGLE = 5
#: Least similarity of a link, as numerator and denominator.
LEAST = (4, 5)
#: Shingles placed last in the common order; texts in which one must occur, of those a task takes at a time, to be counted.
FREQUENT = 200_000
OFTEN = 2
#: Text bytes that a task counts shingles of at a time.
COUNTED_BYTES = 12 << 20
#: Nodes of a bucket, or of a size class of it, that are compared with each other in one task.
BLOCK = 1_000
#: Rounds that try one partner a node and bucket, before all pairs are tried.
ROUNDS = 2
#: Bits of a set's parity bitmap: enough to tell sets of up to twice as many shingles apart.
PARITY_BITS = 256
#: Hashes of words that a task remembers while it checks pairs.
KNOWN = 1 << 18
#: Pairs that are compared at a time.
AT_ONCE = 1 << 18
#: Base of size classes: a little above the largest ratio of the sizes of similar sets, so these are in one class or neighbours.
CLASS = 1.01 * LEAST[1] / LEAST[0]
#: Bits of a shingle's hash that name its bucket: a bucket of several shingles only has more pairs to try.
BUCKET_BITS = 48
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def shingles(text: str | None, known: _Words, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([known[w] for w in words], np.uint64)
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of at least ``LEAST``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def fingerprint(grams: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        ones += np.unpackbits(grams[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big", signed=True)


def parity(grams: np.ndarray) -> bytes:
    """A bit per residue of shingles: whether an odd number of the set's shingles has it."""
    odd = np.bincount((grams & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix(grams: np.ndarray, last: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set: those not in ``last`` (sorted), whose number is given, then those by ``rank``."""
    if not len(grams):
        return grams, 0
    keep = len(grams) + (-len(grams) * LEAST[0] // LEAST[1]) + 1
    if not len(last):
        return grams[:keep], keep
    at = np.minimum(np.searchsorted(last, grams), len(last) - 1)
    order = np.where(last[at] == grams, rank[at], 0)
    return grams[np.argsort(order, kind="stable")[:keep]], min(keep, int((order == 0).sum()))


def frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the corpus that are met most, sorted, and how often they were met: at most ``FREQUENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in common.chunks(batches, text_col, COUNTED_BYTES):
            known = _Words()
            gram, n = np.unique(np.concatenate([shingles(t, known) for t in common.texts_of(tab, text_col)]), return_counts=True)
            often = n >= OFTEN
            yield pa.RecordBatch.from_pydict({"gram": gram[often].view(np.int64), "n": n[often].astype(np.int64)})

    counts = docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    gram = rows.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return gram[order], rows.column("n").to_numpy()[order]


def with_sets(docs: DataFrame, text_col: str, keep: list[str], names: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, and under ``names`` the hash, size and fingerprint of the text's set, its prefix, how
    many shingles of that are not frequent, and its parity bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col))
    types = [T.LongType(), T.IntegerType(), T.LongType(), T.BinaryType(), T.IntegerType(), T.BinaryType()]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name in keep] + [T.StructField(n, t) for n, t in zip(names, types)])
    arrow = to_arrow_schema(schema)
    node, size, print_, first, light, bits = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = shared.value
        for tab in common.chunks(batches, text_col, 4 << 20):
            known = _Words()
            cols: dict[str, list] = {n: [] for n in names}
            for text in common.texts_of(tab, text_col):
                grams = shingles(text, known)
                begin, n = prefix(grams, last, rank)
                cols[node].append(int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64)))
                cols[size].append(len(grams))
                cols[print_].append(fingerprint(grams))
                cols[first].append(begin.tobytes())
                cols[light].append(n)
                cols[bits].append(parity(grams))
            arrays = [pa.array(cols[f.name], f.type) if f.name in cols else tab.column(f.name).cast(f.type) for f in arrow]
            yield from pa.Table.from_arrays(arrays, schema=arrow).to_batches(max_chunksize=5_000)

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def buckets(leads: DataFrame) -> DataFrame:
    """``gram, node, size, pos, bits, n``: the ``n`` nodes of every prefix shingle that several nodes have, and where it stands."""
    arrow = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("bits", pa.binary())])

    def spread(often: bool):
        """The rare or the frequent shingles of prefixes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    raw = part.column("first").to_pylist()
                    n = np.array([len(x) // 8 for x in raw], np.int64)
                    node, size, light = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), n) for c in ("node", "size", "light"))
                    pos = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
                    kept = (pos >= light) == often
                    gram = np.frombuffer(b"".join(raw), np.int64) & ((1 << BUCKET_BITS) - 1)
                    bits = part.column("bits").take(pa.array(np.repeat(np.arange(part.num_rows), n)[kept]))
                    yield from common.emit({"gram": gram[kept], "node": node[kept], "size": size[kept], "pos": pos[kept], "bits": bits}, arrow)

        return run

    counted = pa.schema([*arrow, ("n", pa.int32())])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by shingle, those whose shingle others have too, with their number (``BLOCK + 1`` for more)."""
        held, large = None, None  # rows of the shingle that is still open, and a shingle known to have more than a block

        def told(tab: pa.Table) -> Iterator[pa.RecordBatch]:
            gram = tab.column("gram").to_numpy()
            _, place, n = np.unique(gram, return_inverse=True, return_counts=True)
            n = np.where(gram == large, BLOCK + 1, np.minimum(n[place], BLOCK + 1)) if large is not None else np.minimum(n[place], BLOCK + 1)
            yield from tab.append_column("n", pa.array(n, pa.int32())).filter(pa.array(n > 1)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            tab = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            gram = tab.column("gram").to_numpy()
            last = int(np.searchsorted(gram, gram[-1]))
            yield from told(tab.slice(0, last))
            held = tab.slice(last).combine_chunks()
            if len(held) > BLOCK or gram[-1] == large:
                large = gram[-1]
                yield from told(held)
                held = None
        if held is not None:
            yield from told(held)

    names = "gram long, node long, size int, pos int, bits binary"
    # rare shingles meet in one shuffle, which counts them; frequent ones, which may be very frequent, are counted before it
    rare = leads.mapInArrow(spread(False), names).repartition("gram").sortWithinPartitions("gram").mapInArrow(shared, f"{names}, n int")
    often = common.written(leads.mapInArrow(spread(True), names), "near-frequent")
    sizes = often.groupBy("gram").agg(F.least(F.count("*"), F.lit(BLOCK + 1)).cast("int").alias("n")).where("n > 1")
    met = common.written(rare.unionByName(often.join(sizes, "gram").select(*counted.names)), "near-buckets")
    common.discard(often)
    return met


def joined(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b`` and the ``columns`` of both nodes, as ``a_...`` and ``b_...``."""
    left = nodes.select(F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(left, "a").join(right, "b").select("a", "b", *[f"{x}_{c}" for x in "ab" for c in columns])


def linked(pairs: DataFrame, table: DataFrame, text_col: str, row: str) -> DataFrame:
    """The ``pairs`` of rows (``a, b``) of ``table`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, node, grams = _Words(), None, np.empty(0, np.uint64)
        for batch in batches:
            near = []
            for a, b, y in zip(*(batch.column(c) for c in ("a_text", "b_text", "b"))):
                if y.as_py() != node:  # pairs come in order of ``b``
                    node, grams = y.as_py(), shingles(b.as_py(), known)
                near.append(similar(shingles(a.as_py(), known), grams))
            if len(known) > KNOWN:
                known = _Words()
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = common.written(nodes, "near-nodes")
    few = common.with_batches_of(table.sparkSession, 100)  # two whole texts a row
    pairs, table, held = (common.read_in(few, x) for x in (pairs, table, nodes))
    texts = table.select(F.col(row).alias("node"), F.col(text_col).alias("text")).join(held, "node", "left_semi")
    out = common.written(joined(pairs, texts, ["text"]).mapInArrow(run, "a long, b long"), "near-links")
    common.discard(nodes)
    return common.read_in(nodes.sparkSession, out)


class Rows:
    """Columns of bucket rows; ``own`` and ``home`` tell the block and whether the row's size class is the group's."""

    KEY = ("gram", "cell", "low", "high")
    NAMES = (*KEY, "node", "size", "pos", "part", "own", "home", "n")

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Rows:
        held = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cls.NAMES}
        raw = b"".join(batch.column("bits").to_pylist())
        return cls(held | {"bits": np.frombuffer(raw, np.uint64).reshape(batch.num_rows, PARITY_BITS // 64)})

    def __len__(self) -> int:
        return len(self.columns["gram"])

    def part(self, rows) -> Rows:
        return Rows({k: v[rows] for k, v in self.columns.items()})

    def and_then(self, other: Rows) -> Rows:
        return Rows({k: np.concatenate([v, other.columns[k]]) for k, v in self.columns.items()})

    def edges(self) -> np.ndarray:
        """Where groups begin, and the end."""
        keys = [self.columns[k] for k in self.KEY]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if len(self) > 1 else np.empty(0, np.int64)
        return np.concatenate([[0], new, [len(self)]])

    def likely(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of rows those that can be similar and are not connected, with the difference of their bitmaps.

        If the shingle is the first that they share in the common order, no more is shared than stands from it on.
        """
        c = self.columns
        both = c["size"][i] + c["size"][j]
        most = np.minimum(c["size"][i] - c["pos"][i], c["size"][j] - c["pos"][j])
        fits = (c["part"][i] != c["part"][j]) & (c["home"][i] | c["home"][j]).astype(bool) & (most * sum(LEAST) >= both * LEAST[0])
        fits &= np.minimum(c["size"][i], c["size"][j]) * LEAST[1] >= np.maximum(c["size"][i], c["size"][j]) * LEAST[0]
        i, j, both = i[fits], j[fits], both[fits]
        apart = np.bitwise_count(c["bits"][i] ^ c["bits"][j]).sum(axis=1, dtype=np.int64)
        # shared <= (both - apart) / 2, and similar sets share at least LEAST[0] / sum(LEAST) of both
        near = (both - apart) * sum(LEAST) >= 2 * both * LEAST[0]
        return i[near], j[near], apart[near]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows of a group (of two blocks: of rows of one with the other), the row with the lesser node first."""
        begin = self.edges()
        starts, sizes = begin[:-1], np.diff(begin)
        crossed = self.columns["low"][starts] != self.columns["high"][starts]
        for n in np.unique(sizes[~crossed & (sizes <= 64)]):
            if n < 2:
                continue
            a, b = np.triu_indices(n, 1)
            here = starts[~crossed & (sizes == n)]
            for at in range(0, len(here), max(1, AT_ONCE // len(a))):
                some = here[at : at + max(1, AT_ONCE // len(a)), None]
                yield (some + a).ravel(), (some + b).ravel()
        for s, n, two in zip(starts[crossed | (sizes > 64)], sizes[crossed | (sizes > 64)], crossed[crossed | (sizes > 64)]):
            step = max(1, AT_ONCE // n)
            for at in range(0, n, step):
                later = np.arange(s + at, s + min(n, at + step))
                a, b = np.meshgrid(np.arange(s, later[-1]), later)
                before = a < b
                if two:
                    before &= self.columns["own"][a] != self.columns["own"][b]
                yield a[before], b[before]


def candidates(rows: DataFrame, every: bool) -> DataFrame:
    """``a, b``: pairs of nodes of a bucket in different parts that can be similar, ``every`` one or for each node the
    likeliest before it.  ``rows``: ``gram, node, size, pos, part, bits, n``.

    Unless ``every`` one is wanted, rows that have such a pair follow with their own columns but ``part``, in place of ``a, b``.
    """
    own = ["gram", "node", "size", "pos", "part", "bits", "n"]
    zero = F.lit(0)
    small = rows.where(F.col("n") <= BLOCK).select(*own, zero.alias("cell"), zero.alias("low"), zero.alias("high"), zero.alias("own"), F.lit(1).alias("home"))
    level = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(CLASS))).cast("int")
    placed = rows.where(F.col("n") > BLOCK).withColumn("at", F.explode(F.array(F.struct(level.alias("cell"), F.lit(1).alias("home")), F.struct((level + 1).alias("cell"), F.lit(0).alias("home")))))
    placed = placed.select(*own, "at.cell", "at.home")
    sizes = placed.groupBy("gram", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("home").alias("homes")).where("homes = 1").drop("homes")
    dealt = placed.join(sizes, ["gram", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    large = dealt.select(*own, "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "home")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group are streamed, one group held at a time."""
        rest: Rows | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                new = Rows.of(batch.slice(at, 2_000))
                held = new if rest is None else rest.and_then(new)
                last = held.edges()[-2]
                rest = held.part(slice(last, None))
                if last:
                    yield from chosen(held.part(slice(0, last)))
        if rest is not None:
            yield from chosen(rest)

    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gram", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("bits", pa.binary()), ("n", pa.int32())])

    def told(columns: dict[str, np.ndarray | list], n: int) -> Iterator[pa.RecordBatch]:
        yield from common.emit({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in arrow}, arrow)

    def chosen(held: Rows) -> Iterator[pa.RecordBatch]:
        found = [held.likely(i, j) for i, j in held.pairs()]
        i, j, apart = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
        node = held.columns["node"]
        if not every:
            some = held.part(np.unique(np.concatenate([i, j]))).columns
            yield from told({k: some[k] for k in ("gram", "node", "size", "pos", "n")} | {"bits": [x.tobytes() for x in some["bits"]]}, len(some["node"]))
            order = np.lexsort((node[i], apart, j))
            first = np.unique(j[order], return_index=True)[1]
            i, j = i[order][first], j[order][first]
        yield from told({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])}, len(i))

    key = list(Rows.KEY)
    both = small.select(*key, *own[1:], "own", "home").unionByName(large.select(*key, *own[1:], "own", "home"))
    return both.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(find, "a long, b long, gram long, node long, size int, pos int, bits binary, n int")


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """``a, b``: nodes whose fingerprints the covering hash links, by one node of each fingerprint, and that with its others."""
    prints = common.written(classes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    name = lambda c: prints.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    close = simhash.links(prints.select("fp")).join(name("a"), "a").join(name("b"), "b").select(F.struct(F.col("a_node").alias("node")).alias("x"), F.struct(F.col("b_node").alias("node")).alias("y"))
    equal = classes.select("fp", "node").join(prints.withColumnRenamed("node", "of"), "fp").where("node <> of")
    equal = equal.select(F.struct("node").alias("x"), F.struct(F.col("of").alias("node")).alias("y"))
    return close.unionByName(equal).select(*ordered("x", "y"))


def components(met: DataFrame, table: DataFrame, classes: DataFrame, text_col: str, row: str) -> DataFrame:
    """``node, component`` of all nodes that are linked to another.

    ``met`` has the buckets, which the first round deletes, ``table`` the texts of ``row``; the nodes of ``classes`` (``node, fp``) are rows.
    """
    spark = table.sparkSession
    found: DataFrame | None = None
    tried: DataFrame | None = None
    graph: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        if graph is None:
            both = common.written(candidates(met.withColumn("part", F.col("node")), False), "near-met")
            common.discard(met)
            close = common.written(fingerprint_pairs(classes), "near-close")
            pairs = common.written(both.where("a IS NOT NULL").select("a", "b").unionByName(close).distinct(), "near-pairs")
            met = common.written(both.where("a IS NULL").drop("a", "b").distinct(), "near-open")  # a row may be in several blocks
            common.discard(both, close)
        else:
            before, met = met, common.written(_apart(met.drop("part"), graph), "near-open")
            common.discard(before)
            pairs = candidates(met, turn == ROUNDS).where("a IS NOT NULL").select("a", "b").distinct()
            pairs = common.written(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        common.release(spark)
        links = linked(pairs, table, text_col, row)
        common.release(spark)
        log.info("near duplicates: round %s tried %s pairs, %s are linked; %s rows are open", turn, pairs.count(), links.count(), met.count())
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = links if found is None else found.unionByName(links)
        before, graph = graph, common.written(common.connected_components(found), "near-components")
        if before is not None:
            common.discard(before)
    common.discard(met, tried, found)
    return graph


def _apart(met: DataFrame, graph: DataFrame) -> DataFrame:
    """Rows of the buckets whose nodes are not all in one component, with the component as ``part``."""
    placed = met.join(graph, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    several = placed.groupBy("gram").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("gram")
    return placed.join(several, "gram", "left_semi")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, one row of each component: that with the least id, null last, and of repeated rows the first."""
    common.release(docs.sparkSession)
    (row,) = common.fresh(docs, "row")
    table = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "near-texts")  # freezes the row numbers
    names = common.fresh(table, "set", "size", "fp", "first", "light", "bits")
    sets = common.written(with_sets(table, text_col, [id_col, row], names), "shingle-sets")
    own = sets.select(F.col(row).alias("node"), *[F.col(n).alias(k) for n, k in zip(names, ("set", "size", "fp", "first", "light", "bits"))])
    order = F.struct(F.col(id_col).isNull().alias("without"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    classes = sets.groupBy(F.col(names[0]).alias("set")).agg(F.min(order).alias("least"), F.min(row).alias("node"), F.first(names[2]).alias("fp"), F.count("*").alias("n"))
    classes = common.written(classes, "shingle-classes")
    copies = own.select("set", "node").join(classes.where("n > 1").select("set", F.col("node").alias("lead")), "set").where("node <> lead")
    copies = common.written(copies.select("set", "node"), "shingle-copies")
    met = buckets(own.select("node", "size", "first", "light", "bits").join(copies, "node", "left_anti"))
    common.discard(sets)
    common.release(docs.sparkSession)
    graph = components(met, table, classes.select("node", "fp"), text_col, row)
    placed = classes.select("set", "node", "least").join(graph, "node", "left").select("set", "least", F.coalesce("component", "node").alias("component"))
    placed = common.written(placed, "near-placed")
    least = placed.groupBy("component").agg(F.min("least").alias("kept"))
    best = placed.select("set", "component").join(least, "component").select("set", F.col("kept.row").alias("kept"))
    (mark,) = common.fresh(table, "gone")
    rows = classes.select("set", "node").unionByName(copies)
    gone = rows.join(best, "set").where("node <> kept").select(F.col("node").alias(mark))
    gone = common.written(gone, "near-gone")
    common.discard(classes, placed, copies, graph)
    return table.join(gone, F.col(row) == F.col(mark), "left_anti").select(*docs.columns)
