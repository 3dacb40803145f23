"""Hidden Markov language model: Baum-Welch training and exact sequence likelihood.

The model is class based: ``P(word | state) = P(class | state) * P(word | class)``.
A word whose share of the training tokens is at least ``1 / OWN_CLASS`` is a class
of its own (so there are at most ``OWN_CLASS`` of them, whatever the corpus);
every other word, known or not, belongs to one of ``SUFFIX_CLASSES`` by its last
letters.  The parameters are thus of bounded size and are broadcast; the counts
of all words, which grow with the corpus, never leave Spark.

1. Map tasks write token blocks to the shared folder: each document as numbers
   into its block's word list, and each block's word list with training counts.
2. Word counts are summed by word; the statistics of each word go back to the
   blocks that hold it, and block by block the documents become class sequences.
3. Each Baum-Welch iteration is a pass over the class sequences: tasks run scaled
   forward and backward recursions over whole texts and emit expected counts, which
   Spark sums by class.
4. The score of a text is the scaled forward recursion over its whole class
   sequence plus its words' shares of their classes.

Texts of very different length step together in windows of ``WINDOW`` tokens.  The forward
and backward values at the ends of a window are those of the whole text: each window's
product of transition and emission matrices carries them across, so no transition is
dropped, and a text of any length takes the memory of a batch of windows.

Defined results: null text is empty (the end token alone).  A null id counts as
training.  Repeated rows train and are scored each.  With no training rows every
count is zero and all words are unknown.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

STATES = 8
ITERATIONS = 8
OWN_CLASS = 20_000
SUFFIX_CLASSES = 1_024
#: Tokens of a text that step one after another; the next window of the text steps beside them.
WINDOW = 1_024
#: Tokens that a task holds recursions for at a time.
BATCH_TOKENS = 1_000_000
#: Prior count of every class in every state.
PRIOR = 0.02


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that never train: crc32 of the id's text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of texts (the empty word is an end), the number of each token, and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at the ends splits off nothing
    upto = np.concatenate([[0], np.cumsum(real)])
    cuts = lists.offsets.to_numpy()
    coded = words.filter(pa.array(real)).dictionary_encode()
    starts = upto[cuts - cuts[0]] + np.arange(len(cuts))
    number = np.zeros(starts[-1], np.int32)
    inner = np.ones(len(number), bool)
    inner[starts[1:] - 1] = False
    number[inner] = coded.indices.to_numpy() + 1
    return ["", *coded.dictionary.to_pylist()], number, starts


def token_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Table of blocks: document rows (``word`` null) and word rows (``doc_id`` and ``tokens`` null)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("is_word", T.BooleanType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("tokens", T.BinaryType()), T.StructField("number", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("count", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for tab in common.chunks(batches, "text"):
            yield from _block(tab, block, arrow)
            del tab  # a task holds one chunk, not two
            block += 1

    return common.written(rows.mapInArrow(run, schema), "token-blocks")


def _block(tab: pa.Table, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Document rows and word rows of a chunk; all that is made for it ends with it."""
    words, number, starts = words_of(tab.column("text").combine_chunks())
    out = tab.column("held_out").to_numpy()
    n, m = len(out), len(words)
    seen = np.bincount(number[np.repeat(~out.astype(bool), np.diff(starts))], minlength=m)
    lines = [number[a:b].tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist())]
    nulls = lambda k, f: pa.nulls(k, schema.field(f).type)
    yield from _rows(schema, [np.full(n, block), np.zeros(n, bool), tab.column("doc_id"), tab.column("held_out"), lines, nulls(n, "number"), nulls(n, "word"), nulls(n, "count")])
    del lines, number, tab
    yield from _rows(schema, [np.full(m, block), np.ones(m, bool), nulls(m, "doc_id"), nulls(m, "held_out"), nulls(m, "tokens"), np.arange(m, dtype=np.int32), words, seen])


def _rows(schema: pa.Schema, columns: list) -> Iterator[pa.RecordBatch]:
    arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f, x in zip(schema, columns)]
    yield from pa.Table.from_arrays(arrays, schema=schema).to_batches(max_chunksize=10_000)


def word_statistics(blocks: DataFrame) -> tuple[DataFrame, dict, np.ndarray]:
    """``word, count, class, share``; totals; and the training tokens of every class.

    ``share`` is log10 of the word's probability within its class.
    """
    counts = common.written(blocks.where("is_word").groupBy("word").agg(F.sum("count").alias("count")), "word-counts")
    total = counts.agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    common_words = counts.where(F.col("count") * OWN_CLASS >= n).where("count > 0")  # at most OWN_CLASS rows
    own = common_words.select("word", (F.row_number().over(Window.orderBy(F.desc("count"), "word")) - 1).alias("own"))
    own = common.written(own, "own-classes")
    n_own = own.count()
    suffix = F.lit(n_own) + F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(SUFFIX_CLASSES)).cast("int")
    classed = counts.join(F.broadcast(own), "word", "left").withColumn("class", F.coalesce("own", suffix))
    sizes = classed.groupBy("class").agg(F.sum("count").alias("tokens"), F.count_if(F.col("count") > 0).alias("types"))
    found = sizes.collect()  # one row per class: at most OWN_CLASS + SUFFIX_CLASSES
    tokens = np.zeros(n_own + SUFFIX_CLASSES)
    for r in found:
        tokens[r["class"]] = r["tokens"]
    share = F.when(F.col("own").isNotNull(), 0.0).otherwise(F.log10((F.col("count") + 0.5) / (F.col("tokens") + 0.5 * (F.col("types") + 1))))
    small = common.written(sizes, "class-sizes")
    stats = classed.join(F.broadcast(small), "class").select("word", "count", "class", share.alias("share"))
    return stats, {"tokens": n, "types": v}, tokens


def class_sequences(blocks: DataFrame, stats: DataFrame, totals: dict) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, base_score, share, classes``."""
    lists = blocks.where("is_word").select("block", "number", "word").join(stats, "word").select(F.col("block").alias("of_block"), "number", "count", "class", "share")
    docs = blocks.where("not is_word").select("block", "doc_id", "held_out", "tokens")
    schema = T.StructType([docs.schema["doc_id"], docs.schema["held_out"]] + [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("share", T.DoubleType()), ("classes", T.BinaryType()))])
    arrow = to_arrow_schema(schema)
    below = totals["tokens"] + 0.5 * (totals["types"] + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("number").to_numpy()
        size = len(at)
        count, klass, share = np.zeros(size), np.zeros(size, np.uint16), np.zeros(size)
        count[at], klass[at], share[at] = (right.column(c).to_numpy() for c in ("count", "class", "share"))
        base = np.log10((count + 0.5) / below)
        cols: dict[str, list] = {n: [] for n in ("n_tokens", "n_known", "base_score", "share", "classes")}
        for raw in left.column("tokens").to_pylist():
            line = np.frombuffer(raw, np.int32)
            cols["n_tokens"].append(len(line))
            cols["n_known"].append(int((count[line] > 0).sum()))
            cols["base_score"].append(float(base[line].sum()))
            cols["share"].append(float(share[line].sum()))
            cols["classes"].append(klass[line].tobytes())
        arrays = [left.column("doc_id"), left.column("held_out")] + [pa.array(cols[f.name], f.type) for f in list(arrow)[2:]]
        return pa.Table.from_arrays(arrays, schema=arrow)

    # more partitions than blocks: a task has one block or a few, however many there are
    parts = max(1, 4 * docs.select("block").distinct().count())
    both = docs.repartition(parts, "block").groupBy("block").cogroup(lists.repartition(parts, "of_block").groupBy("of_block"))
    return common.written(both.applyInArrow(run, schema), "class-sequences")


class Parameters:
    """Start, transition and class probabilities of the states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start = start / start.sum()
        self.move = move / move.sum(axis=1, keepdims=True)
        self.emit = emit / emit.sum(axis=0, keepdims=True)  # [class, state]

    def single(self) -> Parameters:
        """The same in single precision, in which training steps are taken (counts are summed in double)."""
        out = Parameters.__new__(Parameters)
        out.start, out.move, out.emit = (x.astype(np.float32) for x in (self.start, self.move, self.emit))
        return out

    @classmethod
    def initial(cls, class_tokens: np.ndarray, states: int = STATES) -> Parameters:
        noise = np.random.default_rng(7).normal(0, 1, (len(class_tokens), states))
        emit = (class_tokens[:, None] + 1) * np.exp(noise)
        return cls(np.ones(states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit)


class Windows:
    """Texts cut into windows that step together, longest first; values at a window's ends are those of the whole text."""

    def __init__(self, lines: list[np.ndarray], window: int = WINDOW):
        sizes = np.array([len(x) for x in lines], np.int64)
        self.flat = np.concatenate(lines) if len(lines) else np.empty(0, np.uint16)
        self.texts = len(lines)
        count = -(-sizes // window)
        text = np.repeat(np.arange(len(lines)), count)
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(window, sizes[text] - place * window)
        order = np.argsort(-size, kind="stable")
        self.text, self.place, self.size = text[order], place[order], size[order]
        self.start = (np.cumsum(sizes) - sizes)[self.text] + self.place * window
        self.chained = np.flatnonzero(count[self.text] > 1)  # windows of texts that have several

    def _steps(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each step, how many of the windows (longest first) go on, and their classes."""
        size, start = self.size[rows], self.start[rows]
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for t, n in enumerate(active.tolist()):
            yield n, self.flat[start[:n] + t]

    def ends(self, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: forward values just before it, and backward values at its end, each up to a factor."""
        k, rows, kind = len(p.start), self.chained, p.emit.dtype
        before, after = np.tile(p.start, (len(self.size), 1)), np.ones((len(self.size), k), kind)
        if not len(rows):
            return before, after
        scaled, step = p.emit.astype(np.float64), p.move.astype(np.float64)
        scaled /= scaled.max(axis=1, keepdims=True)
        across = np.tile(np.eye(k), (len(rows), 1, 1))
        first = self.place[rows] == 0
        for t, (n, seen) in enumerate(self._steps(rows)):
            moved = (across[:n].reshape(-1, k) @ step).reshape(n, k, k)
            if t == 0:
                moved[first] = np.eye(k)  # a text starts in its start distribution
            across[:n] = moved * scaled.take(seen, axis=0)[:, None, :]
            if t % 16 == 15:
                across[:n] /= across[:n].sum(axis=(1, 2), keepdims=True)
        line = np.lexsort((self.place[rows], self.text[rows]))  # windows of a text one after another
        head = np.flatnonzero(self.place[rows][line] == 0)
        length = np.diff(np.append(head, len(rows)))
        by = np.argsort(-length, kind="stable")
        head, length = head[by], length[by]
        value = np.tile(p.start.astype(np.float64), (len(head), 1))
        for j in range(length[0] - 1):
            n = int((length > j + 1).sum())
            value = (value[:n, None, :] @ across[line[head[:n] + j]])[:, 0]
            value /= value.sum(axis=1, keepdims=True)
            before[rows[line[head[:n] + j + 1]]] = value
        value = np.ones((0, k))
        for j in range(length[0] - 1, 0, -1):
            n = int((length > j).sum())
            value = np.concatenate([value, np.ones((n - len(value), k))])
            value = (across[line[head[:n] + j]] @ value[:, :, None])[:, :, 0]
            value /= value.sum(axis=1, keepdims=True)
            after[rows[line[head[:n] + j - 1]]] = value
        return before, after

    def _groups(self, most: int) -> Iterator[np.ndarray]:
        """Windows of about ``most`` tokens at a time."""
        cut = np.flatnonzero(np.diff(np.cumsum(self.size) // most)) + 1
        yield from np.split(np.arange(len(self.size)), cut)

    def _forward(self, p: Parameters, rows: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Scaled forward values and scales of each step."""
        ones = np.ones(len(p.start), p.emit.dtype)  # sums along short rows are faster as products
        held = np.where((self.place[rows] == 0)[:, None], p.start, before[rows] @ p.move)
        for t, (n, seen) in enumerate(self._steps(rows)):
            held = (held if t == 0 else held[:n] @ p.move) * p.emit.take(seen, axis=0)
            scale = held @ ones
            held /= scale[:, None]
            yield held, scale

    def likelihood(self, p: Parameters) -> np.ndarray:
        """log10 probability of each text."""
        before, _ = self.ends(p)
        total = np.zeros(len(self.size))
        for rows in self._groups(4 * BATCH_TOKENS):
            for _, scale in self._forward(p, rows, before):
                total[rows[: len(scale)]] += np.log10(scale)
        return np.bincount(self.text, total, self.texts)

    def expected(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and classes, by the scaled backward recursion."""
        k = len(p.start)
        before, after = self.ends(p)
        start, move, emit, ones = np.zeros(k), np.zeros((k, k)), np.zeros(p.emit.shape), np.ones(k, p.emit.dtype)
        for rows in self._groups(BATCH_TOKENS):
            steps = list(self._forward(p, rows, before))
            weight, classes = [], []
            back = np.ones((0, k), p.emit.dtype)
            for t, (n, seen) in reversed(list(enumerate(self._steps(rows)))):
                held, scale = steps[t]
                m = len(back)
                if n > m:  # windows that end here
                    last = after.take(rows[m:n], axis=0)
                    last /= ((held[m:] * last) @ ones)[:, None]
                    now = np.concatenate([back, last])
                else:
                    now = back
                weight.append(held * now)
                classes.append(seen)
                ahead = now * p.emit.take(seen, axis=0)
                ahead /= scale[:, None]
                if t:
                    move += steps[t - 1][0][:n].T @ ahead
                    back = ahead @ p.move.T
                else:
                    opens = self.place[rows] == 0
                    start += weight[-1][opens].sum(axis=0)
                    move += before[rows[~opens]].T @ ahead[~opens]
            classes, weight = np.concatenate(classes), np.ascontiguousarray(np.concatenate(weight).T)
            for j in range(k):
                emit[:, j] += np.bincount(classes, weight[j], len(emit))
        return start, move * p.move, emit


def expected_counts(train: DataFrame, p: Parameters) -> list:
    """Expected counts over all training sequences: rows ``kind, place, v0..``; one row per class and state at most."""
    k = len(p.start)
    shared = train.sparkSession.sparkContext.broadcast(p.single())
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("place", T.IntegerType())] + [T.StructField(f"v{j}", T.DoubleType()) for j in range(k)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Parameters = shared.value
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(q.emit.shape)

        def add(lines: list[np.ndarray]) -> None:
            a, b, c = Windows(lines).expected(q)
            start[:] += a
            move[:] += b
            emit[:] += c

        held, size = [], 0
        for batch in batches:
            for raw in batch.column("classes").to_pylist():
                held.append(np.frombuffer(raw, np.uint16))
                size += len(held[-1])
                if size >= BATCH_TOKENS:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        at = np.flatnonzero(emit.any(axis=1))
        values = np.concatenate([start[None], move, emit[at]])
        kind = np.concatenate([[0], np.ones(k, np.int32), np.full(len(at), 2)]).astype(np.int32)
        place = np.concatenate([[0], np.arange(k), at]).astype(np.int32)
        yield from common.emit({"kind": kind, "place": place} | {f"v{j}": values[:, j] for j in range(k)}, arrow)

    rows = train.select("classes").mapInArrow(run, schema).groupBy("kind", "place").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(k)])
    out = rows.collect()
    shared.unpersist()
    return out


def baum_welch(train: DataFrame, class_tokens: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Parameters:
    p = Parameters.initial(class_tokens, states)
    prior = PRIOR * (class_tokens + 1) / (class_tokens + 1).mean()
    for _ in range(iterations):
        start, move = np.full(states, 0.1), np.full((states, states), 0.1)
        emit = np.repeat(prior[:, None], states, axis=1) + 1e-3
        for r in expected_counts(train, p):
            (start if r[0] == 0 else move[r[1]] if r[0] == 1 else emit[r[1]])[:] += r[2:]
        p = Parameters(start, move, emit)
    return p


def score_sequences(rows: DataFrame, p: Parameters, train_tokens: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(p)
    light = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    schema = T.StructType([rows.schema[c] for c in light] + [T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in common.chunks(batches, "classes", 4 << 20):
            lines = [np.frombuffer(x, np.uint16) for x in tab.column("classes").to_pylist()]
            score = Windows(lines).likelihood(shared.value) + tab.column("share").to_numpy()
            yield from _rows(arrow, [*(tab.column(c) for c in light), score])

    return rows.mapInArrow(run, schema).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    blocks = token_blocks(docs, id_col, text_col)
    stats, totals, class_tokens = word_statistics(blocks)
    rows = class_sequences(blocks, stats, totals)
    common.discard(blocks)
    p = baum_welch(rows.where("not held_out"), class_tokens, states, iterations)
    return score_sequences(rows, p, totals["tokens"])


def op1_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))


def lm_base_scores(spark, sf_dir: str) -> DataFrame:
    """The columns of ``op1_hmm_scoring`` that its token counts alone decide, by its own blocks and counts."""
    blocks = token_blocks(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    stats, totals, _ = word_statistics(blocks)
    rows = class_sequences(blocks, stats, totals)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"))


#: CRC-32 of the id's digits bit by bit; a text's words and one end (the empty word).
BASE_SCORES_SQL = r"""
WITH d AS (
  SELECT doc_id, xor(4294967295, list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, n: xor(x >> 1, 3988292384 * (x & 1))))) % 5 = 1 AS held_out,
         list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''), '') AS words
  FROM documents),
t AS (SELECT doc_id, held_out, unnest(words) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.5e0) / (n + 0.5e0 * (v + 1)))), 6) AS base_score
FROM t LEFT JOIN c USING (word) CROSS JOIN n GROUP BY doc_id, held_out
"""
