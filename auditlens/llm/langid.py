"""Language identification of mixed-language text.

Training counts hashed byte n-grams of every word of every labelled document, by
language, together with the letters that each language writes in each script.
Prediction scores each distinct word of a chunk once: its script narrows the
candidate languages, its n-grams score them.  Viterbi over the words of a text
with a penalty for switching labels spans; the text's language is the one with
most letters in its spans, and ``score`` is the share of all letters that lie in
its spans in words that themselves favour it.

The model has at most ``CELLS`` counts whatever the size of the corpus and however many the
languages: up to 128 languages have ``BUCKETS`` counts each, more languages share the room
by folding buckets together (``LEAST_BUCKETS`` at least), so what is broadcast is bounded.

Defined results: null text and text without a letter is ``und`` with score 0; so
is everything when nothing is labelled.  Null ids train and are not held out.
Repeated rows are predicted each; an empty table gives an empty result; ``lang``
and other columns of the input are never read for a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
SMOOTHING = 0.5
#: Log-probability lost by a change of language between two words.
SWITCH = 8.0
#: The most that one word can speak against a language.
CLIP = 12.0
#: A script is a language's if it writes this share of its letters in it.
SCRIPT_SHARE = 0.002
#: Counts of a model, and the fewest buckets to which they are folded.
CELLS = 1 << 22
LEAST_BUCKETS = 64
#: Share of supported letters below which the pipeline rejects a document.
REJECT_BELOW = 0.3
#: Text bytes that a task takes at a time with up to 16 languages (fewer with more), and distinct words that it scores at a time.
CHUNK_BYTES = 2 << 20
CHUNK_WORDS = 20_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: First code points of Unicode script ranges, and the script from there on.
_RANGES = [
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
SCRIPTS = sorted({s for _, s in _RANGES})
_STARTS = np.array([a for a, _ in _RANGES])
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in _RANGES])


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that never train: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased words with their ends, and the word each belongs to."""
    raw = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8)
    gap = raw == 32
    owner = np.cumsum(gap) - 1
    wide = raw.astype(np.uint64)
    buckets, owners = [], []
    for n in ORDERS:
        last = len(raw) - n + 1
        if last <= 0:
            continue
        code = np.full(last, n, np.uint64)
        inner = np.zeros(last, bool)
        for j in range(n):
            code = code * np.uint64(257) + wide[j : j + last]
            if 0 < j < n - 1:
                inner |= gap[j : j + last]
        if n == 2:
            inner = gap[:last] & gap[1 : last + 1]
        at = np.flatnonzero(~inner)
        mixed = (code[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        buckets.append(mixed.astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


def scripts_and_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    letters = np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words), np.int64, len(words))
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, side="right") - 1], letters


def train_counts(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``lang, feature, count`` over all labelled rows; features from ``BUCKETS`` on are scripts."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("feature", T.IntegerType()), T.StructField("count", T.LongType())])
    arrow = to_arrow_schema(schema)
    size = BUCKETS + len(SCRIPTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for tab in common.chunks(batches, text_col, CHUNK_BYTES):
            counted: dict[str, Counter] = {}
            for text, lang in zip(common.texts_of(tab, text_col), tab.column(label_col).to_pylist()):
                counted.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            for lang, words in counted.items():
                if not words:
                    continue
                names, n = list(words), np.fromiter(words.values(), np.float64, len(words))
                bucket, owner = ngrams(names)
                script, letters = scripts_and_letters(names)
                held = total.setdefault(lang, np.zeros(size))
                held[:BUCKETS] += np.bincount(bucket, n[owner], BUCKETS)
                held[BUCKETS:] += np.bincount(script, n * letters, len(SCRIPTS))
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield from common.emit({"lang": [lang] * len(at), "feature": at, "count": held[at].astype(np.int64)}, arrow)

    parts = labelled.select(text_col, F.col(label_col).cast("string").alias(label_col)).mapInArrow(run, schema)
    return parts.groupBy("lang", "feature").agg(F.sum("count").alias("count"))


def buckets_for(languages: int) -> int:
    """Buckets a language; halved until the counts of all languages fit."""
    size = BUCKETS
    while size > LEAST_BUCKETS and size * languages > CELLS:
        size //= 2
    return size


class Model:
    """Log-probabilities ``weights[bucket, language]`` and ``allowed[script, language]``."""

    def __init__(self, languages: list[str], place: np.ndarray, feature: np.ndarray, counted: np.ndarray, buckets: int = BUCKETS):
        """``counted``: how often language number ``place`` has ``feature``; those from ``buckets`` on are scripts."""
        self.languages, self.buckets = languages, buckets
        count = np.zeros((buckets + len(SCRIPTS), max(1, len(languages))))
        count[feature, place] = counted
        grams, letters = count[:buckets], count[buckets:]
        self.weights = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * buckets)).astype(np.float32)
        self.allowed = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
        self.written = self.allowed.any(axis=1)  # scripts that some language writes
        self.allowed[~self.written] = True

    def scores(self, words: list[str], script: np.ndarray) -> np.ndarray:
        """``[word, language]``: at most 0, the best candidate 0."""
        step = max(256, CHUNK_WORDS // (1 + len(self.languages) // 16))
        return np.concatenate([self._scores(words[i : i + step], script[i : i + step]) for i in range(0, len(words), step)])

    def _scores(self, words: list[str], script: np.ndarray) -> np.ndarray:
        bucket, owner = ngrams([w.lower() for w in words])
        bucket //= BUCKETS // self.buckets
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(words)))
        out = np.add.reduceat(self.weights[bucket[order]], edges, axis=0)
        out[~self.allowed[script]] = -np.inf
        return np.maximum(out - out.max(axis=1, keepdims=True), -CLIP)


def viterbi(score: np.ndarray, lines: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each line, all lines stepping together."""
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    sizes = np.array([len(lines[i]) for i in order])
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(lines)
    if not len(sizes) or not sizes[0]:
        return out
    flat = np.concatenate([lines[i] for i in order])
    start = np.cumsum(sizes) - sizes
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lines longer than t
    stay = np.zeros((len(flat), score.shape[1]), bool)
    source = np.zeros(len(flat), np.int32)
    value = np.zeros((len(sizes), score.shape[1]), np.float32)
    for t in range(sizes[0]):
        n = active[t]
        at = start[:n] + t
        held = value[:n]
        best = held.argmax(axis=1)
        top = held[np.arange(n), best][:, None] - (switch if t else 0)
        kept = held >= top
        stay[at], source[at] = kept, best
        value[:n] = np.where(kept, held, top) + score[flat[at]]
    state = np.zeros(len(sizes), np.int64)
    labels = np.zeros(len(flat), np.int32)
    for t in range(sizes[0] - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        fresh = sizes[:n] == t + 1
        state[:n] = np.where(fresh, value[:n].argmax(axis=1), state[:n])
        labels[at] = state[:n]
        state[:n] = np.where(stay[at, state[:n]], state[:n], source[at])
    for j, i in enumerate(order):
        out[i] = labels[start[j] : start[j] + sizes[j]]
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    labelled = docs.where(~held_out(id_col) & F.col(label_col).isNotNull())
    counts = common.written(train_counts(labelled, text_col, label_col), "language-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    buckets = buckets_for(len(languages))
    folded = F.when(F.col("feature") < BUCKETS, F.floor(F.col("feature") / (BUCKETS // buckets))).otherwise(F.col("feature") - (BUCKETS - buckets))
    # at most CELLS rows and the scripts' ones, as long as there is room for LEAST_BUCKETS of every language
    rows = counts.groupBy("lang", folded.cast("int").alias("feature")).agg(F.sum("count").alias("count")).toArrow()
    names = pa.array(languages, pa.string())
    place = pc.index_in(rows.column("lang"), value_set=names).to_numpy() if languages else np.empty(0, np.int64)
    return Model(languages, place, rows.column("feature").to_numpy(), rows.column("count").to_numpy(), buckets)


def predict(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = False, supported: bool = False, names: tuple[str, str, str] | None = None) -> DataFrame:
    """The input's columns and ``lang_pred, lang_score``, and ``spans`` if asked for; under ``names`` if given.

    With ``supported``, the score is the share of letters, in spans of any language, in words that
    favour their span's language and whose script some language writes.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    pred, mark, spans = names or ("lang_pred", "lang_score", "spans")
    chunk = CHUNK_BYTES // (1 + len(model.languages) // 16)
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField(pred, T.StringType()), T.StructField(mark, T.DoubleType())] + [T.StructField(spans, span_type)] * with_spans)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for tab in common.chunks(batches, text_col, chunk):
            texts = common.texts_of(tab, text_col)
            number: dict[str, int] = {}
            lines = [np.array([number.setdefault(w, len(number)) for w in _WORD.findall(t)], np.int32) for t in texts]
            names = list(number)
            langs, marks, found = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if names and m.languages:
                script, letters = scripts_and_letters(names)
                score = m.scores(names, script)
                clear = np.sort(score, axis=1)
                favours = np.where(clear[:, -1] > (clear[:, -2] if score.shape[1] > 1 else -1), score.argmax(axis=1), -1)
                labels = viterbi(score, lines)
                for i, (line, label) in enumerate(zip(lines, labels)):
                    size = letters[line]
                    whole = size.sum()
                    if not whole:
                        continue
                    best = int(np.bincount(label, size, len(m.languages)).argmax())
                    langs[i] = m.languages[best]
                    counted = (favours[line] == label) & (m.written[script[line]] if supported else label == best)
                    marks[i] = float(size[counted].sum() / whole)
                    if with_spans:
                        found[i] = _spans(texts[i], label, m.languages)
            cols = {f.name: tab.column(f.name) for f in arrow if f.name in tab.column_names}
            cols |= {pred: langs, mark: marks, spans: found}
            arrays = [x.cast(f.type) if isinstance(x := cols[f.name], pa.ChunkedArray) else pa.array(x, f.type) for f in arrow]
            yield from pa.Table.from_arrays(arrays, names=arrow.names).to_batches(max_chunksize=5_000)

    return docs.mapInArrow(run, schema)


def _spans(text: str, label: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of words with one label, as character offsets."""
    out: list[dict] = []
    for word, at in zip(_WORD.finditer(text), label.tolist()):
        if out and out[-1]["lang"] == languages[at]:
            out[-1]["end"] = word.end()
        else:
            out.append({"start": word.start(), "end": word.end(), "lang": languages[at]})
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, by a model of the rows that are not held out."""
    model = fit(docs, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model, "text").select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least: float = REJECT_BELOW, wanted: set[str] | None = None) -> DataFrame:
    """The rows whose languages, one or several, are known for at least ``least`` of their letters, and whose language is
    one of ``wanted`` (default: any); a null label becomes the predicted language."""
    model = fit(docs, id_col, text_col, label_col)
    names = tuple(common.fresh(docs, "lang_pred", "lang_score", "spans"))
    pred, mark, _ = names
    told = predict(docs, model, text_col, supported=True, names=names).where((F.col(pred) != UNKNOWN) & (F.col(mark) >= least))
    if wanted is not None:
        told = told.where(F.col(pred).isin(*wanted))
    label = F.coalesce(F.col(label_col), F.col(pred).cast(docs.schema[label_col].dataType)).alias(label_col)
    return told.select(*[label if c == label_col else c for c in docs.columns])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
