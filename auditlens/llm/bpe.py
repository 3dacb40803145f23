"""Byte-level BPE encoding and decoding by merge replay.

Each task gathers the distinct pre-token pieces of its documents and replays the
merges over all of them at once: an inverted index leads from a token pair to
its positions; merges are applied in the order of their ranks, every
position of a rank in one step, and only the pairs that touch a merged position
are looked up again and filed anew.  Merges never cross a piece,
so the ids of a piece do not depend on how documents are dealt to tasks, and no
data is shuffled.  Documents are then written as the ids of their pieces.

A pair joins when its bytes together are a token; of several pairs with the same
rank in a piece the leftmost joins first, and a piece that is itself a token is
that token.  A vocabulary may hold a pair whose rank is below that of one of its
parts; a piece in which such a pair arises is replayed alone, least rank first.

Defined results: null or empty text has no ids (digests of the empty string);
null ids and repeated rows are encoded like any other; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

NONE = np.int32(2**31 - 1)


class Merges:
    """A rank file: token bytes by id, and the rank of each joinable pair of ids."""

    _loaded: dict[str, Merges] = {}

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    @classmethod
    def of(cls, path: str) -> Merges:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where they do not join."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_alone(self, piece: bytes) -> list[int]:
        """One piece, least rank first and leftmost first, by a heap of its pairs."""
        if piece in self.ids:
            return [self.ids[piece]]
        token = [int(self.of_byte[b]) for b in piece]
        n = len(token)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                rank = self.pairs.get(token[i] << 32 | token[after[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, token[i], token[after[i]]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue  # one of the two has joined meanwhile
            token[i], token[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [t for t in token if t >= 0]

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of distinct pieces, all replayed together."""
        whole = [self.ids.get(p) for p in pieces]
        work = [i for i, w in enumerate(whole) if w is None and pieces[i]]
        out: list[list[int]] = [[] if w is None else [w] for w in whole]
        if not work:
            return out
        raw = np.frombuffer(b"".join(pieces[i] for i in work), np.uint8)
        sizes = np.array([len(pieces[i]) for i in work])
        ends = np.cumsum(sizes)
        n = len(raw)
        token = self.of_byte[raw].astype(np.int32)
        # position n is a sentinel with no token; it stands beside the ends of pieces
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = n
        before[ends - sizes] = n
        token, after, before = (np.append(x, np.int32(v)) for x, v in ((token, -1), (after, n), (before, n)))
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after[:n] != n)
        rank[inner] = self.rank(token[inner], token[inner + 1])
        odd = np.zeros(n, bool)
        index: dict[int, list[np.ndarray]] = {}  # token pair -> positions
        pairs_of: dict[int, list[int]] = {}  # rank -> pairs in the index
        queue: list[int] = []

        def file(at: np.ndarray) -> None:
            """Put positions under their pairs."""
            at = at[rank[at] != NONE]
            if not len(at):
                return
            pair = token[at].astype(np.int64) << 32 | token[after[at]]
            order = np.argsort(pair, kind="stable")
            at, pair = at[order], pair[order]
            starts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(at)]
            for s, e, p, r in zip(starts, starts[1:], pair[starts[:-1]].tolist(), rank[at[starts[:-1]]].tolist()):
                if p in index:
                    index[p].append(at[s:e])
                    continue
                index[p] = [at[s:e]]
                if r in pairs_of:
                    pairs_of[r].append(p)
                else:
                    pairs_of[r] = [p]
                    heapq.heappush(queue, r)

        file(inner)
        while queue:
            now = heapq.heappop(queue)
            held = [x for pair in pairs_of.pop(now) for x in index.pop(pair)]
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[rank[at] == now]
            if len(at) > 1:  # pairs that share a token: the left one joins, in each run every second
                shared = after[at[:-1]] == at[1:]
                if shared.any():
                    order = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.concatenate([[True], ~shared]), order, 0))
                    at = at[(order - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            token[at], token[gone] = now, -1
            rank[gone] = NONE
            after[at], before[follow] = follow, at
            before[n] = after[n] = n
            left = before[at]
            rank[at] = np.where(follow == n, NONE, self.rank(token[at], token[follow]))
            some = left[left != n]
            rank[some] = self.rank(token[some], token[after[some]])
            both = np.concatenate([at, some])
            odd[both[rank[both] <= now]] = True
            file(np.unique(both))
        alive = np.flatnonzero(token[:n] >= 0)
        owner = np.searchsorted(ends, alive, side="right")
        bounds = np.searchsorted(owner, np.arange(len(work) + 1))
        flat = token[alive].tolist()
        for j, i in enumerate(work):
            out[i] = flat[bounds[j] : bounds[j + 1]]
        for j in np.unique(np.searchsorted(ends, np.flatnonzero(odd), side="right")).tolist():
            out[work[j]] = self.encode_alone(pieces[work[j]])
        return out


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` (array) if asked for."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split = Merges.of(path), regex.compile(pattern)
        for tab in common.chunks(batches, text_col):
            texts = common.texts_of(tab, text_col)
            number: dict[str, int] = {}  # distinct pieces of the chunk
            lines = [array("i", [number.setdefault(p, len(number)) for p in split.findall(t)]) for t in texts]
            coded: list[bytes] = []
            decoded: list[bytes] = []
            names = list(number)
            for at in range(0, len(names), 400_000):
                for ids in merges.replay([x.encode() for x in names[at : at + 400_000]]):
                    coded.append(" ".join(map(str, ids)).encode())
                    decoded.append(b"".join([merges.bytes[i] for i in ids]))
            cols: dict[str, list] = {"doc_id": tab.column(id_col).to_pylist(), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for pieces in lines:
                line = b" ".join([coded[p] for p in pieces])
                cols["n_tokens"].append(line.count(b" ") + 1 if line else 0)
                cols["ids_sha256"].append(hashlib.sha256(line).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(b"".join([decoded[p] for p in pieces])).hexdigest())
                if with_ids:
                    cols["ids"].append(list(map(int, line.split())))
            yield from common.emit(cols, arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents"))
