"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Lengths are partitioned into reciprocal-capacity classes: class ``k`` holds
documents of more than ``capacity / (k + 1)`` and at most ``capacity / k`` ids, and
each of its sequences takes exactly ``k`` of them.  Every worker fills its own
sequences, so there is no shuffle and no shared state: a sequence number is the
task's number and a counter.

A document longer than a sequence gives whole sequences first; what is left is
classed by its length.  A sequence that has its ``k`` documents and still room for
``1 / PAD`` of the capacity or more waits for the next document, which pads it: whole if it
fits, else with its head, and the rest is classed as a document.  No cut leaves a
piece shorter than that.  At the end of a task the unfinished sequences (fewer than
``k`` documents for each class, a bounded number) are packed first-fit decreasing;
those that stay short are laid end to end, and the last is closed at powers of two.

Open sequences are all that a task holds.  Defined results: null or empty text
is the end id alone; null ids and repeated rows are packed like any other row;
an empty table gives an empty result.  A special token's name in a text is its id, as
the tokenizer's library reads it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

CAPACITY = 2048
END_ID = 1
#: Room of less than this part of a sequence is left as padding; no cut leaves a piece below it.
PAD = 32
#: Distinct parts of words whose ids a task remembers; beyond it the memory starts anew.
MEMORY = 400_000
#: Text bytes that a task encodes at a time.
CHUNK_BYTES = 16 << 20


class WordIds:
    """Ids of texts, each distinct part of a word encoded once by the tokenizer.

    Texts are cut into words at ASCII white space, and words into parts between letters and
    ASCII punctuation: no normaliser, splitter or special token of the tokenizer looks across
    such a place (words with a special token's start stay whole, and those with an apostrophe,
    which may open a contraction, are not cut behind punctuation).  A cut behind a letter is
    made for letters that are still letters at their end once normalised: not for a capital I
    with a dot, nor for scripts in which a letter may fall into a letter and a mark.
    """

    _loaded: dict[str, WordIds] = {}
    _LETTERS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{410}-\x{44F}]"
    _MARKS = r"[!-&(-/:-@\[-`{-~]"  # ASCII punctuation but the apostrophe
    _JOINED = 200

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.closes[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64)

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The worker's instance, so that the tokenizer is loaded once."""
        if path not in cls._loaded:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def parts(self, words: pa.Array) -> pa.Array:
        """Each word's parts; letters of ASCII words in lower case."""
        cut = pc.replace_substring_regex(words, rf"({self._LETTERS})({self._MARKS})", r"\1 \2")
        more = pc.replace_substring_regex(cut, rf"({self._MARKS})([A-Za-z])", r"\1 \2")
        cut = pc.if_else(pc.match_substring(words, "'"), cut, more)
        cut = pc.if_else(pc.match_substring(words, "<|"), words, cut)
        return pc.split_pattern(cut, " ")

    def found(self, parts: list[str]) -> list[list[int]]:
        """Ids of new parts.  Runs of letters are encoded many at a time, parted by the ids that close them."""
        out: list[list[int]] = [[]] * len(parts)
        letters = [i for i, x in enumerate(parts) if x.isalpha()]
        alone = [i for i, x in enumerate(parts) if not x.isalpha()]
        groups = [letters[i : i + self._JOINED] for i in range(0, len(letters), self._JOINED)]
        for group, told in zip(groups, self._encode([" ".join([parts[i] for i in g]) for g in groups])):
            ends = (np.flatnonzero(self.closes[told]) + 1).tolist()
            if len(ends) != len(group):  # a letter that its lower case turns into a letter and a mark
                alone += group
                continue
            for i, a, b in zip(group, [0, *ends], ends):
                out[i] = told[a:b]
        for i, told in zip(alone, self._encode([parts[i] for i in alone])):
            out[i] = told
        return out

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 20_000):
            for x in self.tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False):
                yield x.ids

    def places(self, parts: list[str]) -> np.ndarray:
        """Each part's place in the memory; new ones are encoded."""
        new = [x for x in parts if x not in self.known]
        told = self.found(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, told), np.int64, len(told))])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in told for i in x), "<u4")])
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (each with ``end`` behind it, if given), and where each text's begin."""
        if len(self.known) > MEMORY:
            self.forget()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        cuts = self.parts(words.dictionary)
        parts = cuts.flatten()
        parts = pc.if_else(pc.match_substring_regex(parts, "^[A-Za-z]+$"), pc.ascii_lower(parts), parts).dictionary_encode()
        place = self.places(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        ids, starts = gathered(self.ids, self.sizes, place, cuts.offsets.to_numpy())  # of each distinct word
        ids, starts = gathered(ids, np.diff(starts), words.indices.to_numpy(), lists.offsets.to_numpy())
        if end is None:
            return ids, starts
        starts = starts + np.arange(len(starts))
        out = np.empty(starts[-1], "<u4")
        inner = np.ones(len(out), bool)
        inner[starts[1:] - 1] = False
        out[inner], out[~inner] = ids, end
        return out, starts


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` (of ``sizes``) that ``which`` names, end to end, and where each list of them begins."""
    size = sizes[which]
    upto = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], size) + np.arange(upto[-1])
    return flat[place], upto[cuts - cuts[0]]


class Filler:
    """A worker's sequences: ``add`` documents, ``ready`` pieces have their place."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.least = capacity, first, max(1, capacity // PAD)
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple[int, int]] = []  # sequences that have their documents, and their ids so far
        self.ready: list[tuple] = []

    def add(self, doc, ids: memoryview) -> None:
        """A document's ids, whole sequences first."""
        total, whole = len(ids), len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.close([(doc, start, ids[start : start + self.capacity], total)])
        if whole < total:
            self.remainder((doc, whole, ids[whole:], total))

    def remainder(self, piece: tuple) -> None:
        """A piece shorter than a sequence pads a waiting sequence, and joins its class with what is left."""
        while self.waiting and (n := len(piece[2])) >= self.least:
            sequence, filled = self.waiting.pop()
            room = self.capacity - filled
            take = n if n <= room else room if n - room >= self.least else n - self.least
            if take < self.least:
                self.waiting.append((sequence, filled))
                break
            head, piece = self.cut(piece, take)
            self.place(sequence, filled, [head])
            if not len(piece[2]):
                return
        if len(piece[2]):
            k = self.capacity // len(piece[2])
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                self.close(self.open.pop(k))

    @staticmethod
    def cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
        doc, start, ids, total = piece
        return (doc, start, ids[:at], total), (doc, start + at, ids[at:], total)

    def close(self, pieces: list[tuple]) -> None:
        self.next += 1
        self.place(self.next - 1, 0, pieces)

    def place(self, sequence: int, offset: int, pieces: list[tuple]) -> None:
        for piece in pieces:
            self.ready.append((*piece, sequence, offset))
            offset += len(piece[2])
        if self.capacity - offset >= self.least:
            self.waiting.append((sequence, offset))

    def settle(self) -> None:
        """Let go of the chunk that open pieces were cut from."""
        for held in self.open.values():
            held[:] = [(doc, start, memoryview(ids.tobytes()).cast("I"), total) for doc, start, ids, total in held]

    def finish(self) -> None:
        """First-fit decreasing over the pieces of unfinished sequences; short ones are laid end to end."""
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -len(p[2]))
        bins: list[list] = [[self.capacity - filled, [], sequence, filled] for sequence, filled in self.waiting]
        self.open, self.waiting = {}, []
        for piece in rest:
            n = len(piece[2])
            for b in bins:
                if b[0] >= n:
                    b[0] -= n
                    b[1].append(piece)
                    break
            else:
                bins.append([self.capacity - n, [piece], None, 0])
        line: list[tuple] = []
        for room, pieces, sequence, filled in bins:
            if sequence is not None:
                self.place(sequence, filled, pieces)
            elif room < self.least:
                self.close(pieces)
            else:
                line += pieces
        left = sum(len(p[2]) for p in line)
        while left:
            part = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= part
            held = []
            while part:
                head, tail = self.cut(line[0], min(part, len(line[0][2])))
                held.append(head)
                part -= len(head[2])
                line[:1] = [tail] if len(tail[2]) else []
            self.close(held)
        self.waiting = []


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` if asked for."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(TaskContext.get().partitionId() << 40, capacity)
        words = WordIds.of(path)

        def rows() -> Iterator[pa.RecordBatch]:
            if filler.ready:
                docs_, starts, ids, totals, seqs, offsets = zip(*filler.ready)
                filler.ready = []
                cols = {"doc_id": docs_, "start": starts, "length": list(map(len, ids)), "ids_crc32": list(map(zlib.crc32, ids)), "doc_tokens": totals, "sequence_id": seqs, "offset": offsets}
                if with_ids:
                    cols["ids"] = [x.tobytes() for x in ids]
                yield from common.emit(cols, arrow)

        for tab in common.chunks(batches, text_col, CHUNK_BYTES):
            ids, starts = words.encode(tab.column(text_col).combine_chunks(), end_id)
            flat, cuts = memoryview(ids), starts.tolist()
            for doc, a, b in zip(tab.column(id_col).to_pylist(), cuts, cuts[1:]):
                filler.add(doc, flat[a:b])
            yield from rows()
            filler.settle()
        words.forget()  # the worker lives on
        filler.finish()
        yield from rows()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op5_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
