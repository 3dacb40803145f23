"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from auditlens.llm import bpe, common, exact_dedup, hmm_lm, langid, packing, simhash, suffix_dedup, token_shards

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
EN = "the cat sat on the mat and the dog ran to the house with a red ball "
DE = "der hund und die katze sind nicht in dem haus mit einem roten ball "
PASSAGE = "This very passage stands in several documents, word for word, and it goes on for much longer than two hundred bytes so that windows of it are found again wherever it was copied to, at the start, in the middle and at the end of other texts. "


def rows():
    texts = [
        EN * 3, DE * 3, EN * 3, EN.upper() * 3, None, "", " \t\n", "one", "one  two", "日本語のテキスト 🙂", "123 456 !!!", "a", "a", "aaaa" * 200, "x y z " * 4000,
        "start one " + PASSAGE + " end one", PASSAGE + "tail two", "head three " + PASSAGE + "丁", "".join(map(chr, range(0x4E10, 0x4E80))) + PASSAGE + "一 tail", "  one  ", "o n e", EN * 3 + "bird",
        "<|endoftext|> special <|startoftext|>", "word " * 50 + DE, "tab\tand\x0bother\x0cspace\r\nhere",
    ]
    out = [(i, t, None if t is None else "de" if i in (1, 23) else "en", f"src{i % 3}", None if i % 4 == 0 else 2**53 + i) for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out += [(None, "a row without an id " * 20, None, None, None)] * 2
    out += [(100 + i, f"{w} {EN if i % 2 else DE}" * (1 + i % 5), "en" if i % 2 else "de", "s", 1) for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split())]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    common.importable(spark)
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(docs):
    """The same rows with columns that bear internal names."""
    from pyspark.sql import functions as F

    for name in ("key", "slot", "depth", "row", "fp", "__fp", "__rid", "__bucket", "spans", "lang_pred", "__row", "places", "held_out", "bucket"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


def collected(df, columns):
    return Counter(map(tuple, df.select(*columns).collect()))


# exact dedup


def exact_expected():
    table = rows()
    groups = {}
    for place, (doc, text, *_) in enumerate(table):
        body = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(body, []).append((-len(text or ""), doc is None, doc or 0, place))
    return table, groups


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 2, "start": 1}])
def test_exact_dedup(docs, sizes):
    table, groups = exact_expected()
    got = exact_dedup.exact_dedup(docs, **sizes).collect()
    assert len(got) == len(table)
    by_sha = {}
    for r in got:
        by_sha.setdefault(r.text_sha256, []).append(r)
    assert len(by_sha) == len(groups)
    for body, members in groups.items():
        found = by_sha[hashlib.sha256(body.encode()).hexdigest()]
        best = min(members)
        keep = None if best[1] else best[2]
        assert all(r.group_size == len(members) and r.keep_id == keep for r in found)
        assert sum(r.kept for r in found) == 1 and next(r.doc_id for r in found if r.kept) == keep


def test_exact_dedup_keeps_columns(docs, empty):
    kept = exact_dedup.keep_distinct(clash(docs))
    assert kept.columns == clash(docs).columns and kept.count() == len(exact_expected()[1])
    assert kept.where("doc_id = 1").first().n_chars == 2**53 + 1
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_distinct(empty).count() == 0


def test_equal_keys_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string").coalesce(1)
    index, names = exact_dedup.index_files(df)
    forced = index.withColumn(names["key"], index[names["key"]] * 0)  # every entry in one chain
    got = {r.text.strip(): r[names["count"]] for r in exact_dedup.groups(forced, names, bucket_rows=1, start=1).collect()}
    assert got == {"a": 2, "b": 1}


# simhash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, ids, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(values))]


def test_simhash(docs, empty):
    table = rows()
    prints = [brute_fingerprint(r[1]) for r in table]
    found = components(prints, [r[0] for r in table], lambda a, b: (a ^ b).bit_count() <= 3)
    want = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(table, prints, found))
    assert collected(simhash.simhash_dedup(docs), ["doc_id", "fingerprint", "component_id"]) == want
    assert simhash.simhash_dedup(empty).count() == 0
    kept = simhash.keep_representatives(clash(docs))
    assert kept.columns == clash(docs).columns
    assert collected(kept, ["doc_id"]) == Counter((c,) for c in set(found))  # one of each component, repeated rows and rows without an id too


def test_masks_cover_every_difference():
    from itertools import combinations

    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    assert len(masks) == 15
    for positions in combinations(range(64), 3):
        bits = sum(1 << p for p in positions)
        assert any(m & bits == 0 for m in masks)


@pytest.mark.parametrize("block", [2, 50, 2000])
def test_links_find_every_pair(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40)
    values = set()
    for b in base.tolist():
        values.add(b)
        for _ in range(10):
            flips = sum(1 << int(p) for p in rng.choice(63, rng.integers(1, 6), replace=False))
            values.add(b ^ flips)
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.links(df, block=block).collect()
    want = components(values, values, lambda a, b: (a ^ b).bit_count() <= 3)
    got = components(list(range(len(values))), values, lambda i, j: False)
    index = {v: i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        assert ((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 3
        a, b = root(index[e.a]), root(index[e.b])
        parent[max(a, b)] = min(a, b)
    got = [values[root(i)] for i in range(len(values))]
    assert got == want


def test_connected_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1000, 1200)] + [(5, 7), (7, 7)], "a long, b long")
    got = dict(map(tuple, common.connected_components(df).collect()))
    assert got == {i: 1000 for i in range(1000, 1201)} | {5: 5, 7: 5}


# suffix dedup


def repeats(texts):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append((b, gone))
    return out


@pytest.mark.parametrize("cap", [suffix_dedup.CAP, 1])
def test_suffix_dedup(docs, cap, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (cap,))
    table = rows()
    want = Counter()
    for (doc, *_), (b, gone) in zip(table, repeats([r[1] for r in table])):
        spans = int((gone[1:] > gone[:-1]).sum() + gone[:1].sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.suffix_dedup(docs)
    assert collected(got, got.columns) == want
    assert any(k[2] for k in want)


def test_suffix_removal_keeps_whole_characters(docs, empty):
    cut = suffix_dedup.remove_repeats(clash(docs))
    assert cut.columns == clash(docs).columns
    table = {r.doc_id: r.text for r in cut.where("doc_id is not null").collect()}
    assert table[4] is None and table[0] == "" and table[16] == "tail two"
    assert table[18] == "".join(map(chr, range(0x4E10, 0x4E80))) + "一 tail" and table[17] == "head thre丁"  # "e " stands before the passage in two texts
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60) | st.integers(1, 40).map(lambda n: b"ab" * n) | st.integers(1, 60).map(lambda n: b"\0" * n))
def test_suffix_array_and_kasai(raw):
    data = np.frombuffer(raw, np.uint8)
    order, place = suffix_dedup.suffix_array(data)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    half = len(raw) // 2
    shared = suffix_dedup.common_prefixes(data, order, place, np.array([0, half]), np.array([half, len(raw)]), 200)
    for p in range(1, len(raw)):
        a, b = raw[order[p] :], raw[order[p - 1] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[order[p]] == min(n, 200)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 900), min_size=1, max_size=5), st.integers(1, 4), st.integers(0, 9))
def test_every_window_has_one_anchor(sizes, letters, seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 97 + letters, n, dtype=np.uint8)) for n in sizes]
    at, gram, low, high = suffix_dedup.anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes))
    owned = Counter(w for a, b in zip(low.tolist(), high.tolist()) for w in range(a, b + 1))
    begin = np.cumsum(sizes) - np.array(sizes)
    assert owned == Counter(int(s) + i for s, n in zip(begin, sizes) for i in range(max(0, n - 199)))
    assert all(a <= p <= p + suffix_dedup.GRAM <= a + 200 and p + suffix_dedup.GRAM <= b + 200 and b <= p for p, a, b in zip(at, low, high))


# tokens


@pytest.fixture(scope="module")
def tik():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, empty, tik):
    want = Counter()
    for doc, text, *_ in rows():
        ids = tik.encode_ordinary(text or "")
        want[(doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    got = bpe.encode_documents(clash(docs), with_ids=True)
    assert collected(got, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == want
    assert got.where("doc_id = 9").first().ids == tik.encode_ordinary(rows()[9][1])
    assert bpe.encode_documents(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=20) | st.text("aeinrst", max_size=30) | st.text("ab \n'", max_size=12), max_size=6))
def test_merge_replay_equals_library(texts):
    import regex

    merges = bpe.Merges.of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.ids, special_tokens={}) if not hasattr(test_merge_replay_equals_library, "enc") else test_merge_replay_equals_library.enc
    test_merge_replay_equals_library.enc = library
    split = regex.compile(public_tokenizers.PATTERN)
    pieces = sorted({p for t in texts for p in split.findall(t)})
    coded = dict(zip(pieces, merges.replay([p.encode() for p in pieces])))
    for t in texts:
        assert [i for p in split.findall(t) for i in coded[p]] == library.encode_ordinary(t)
    assert all(merges.encode_alone(p.encode()) == coded[p] for p in pieces)


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    table = rows()
    want = Counter(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in table)
    got = packing.pack_documents(clash(docs), with_ids=True, capacity=64).collect()
    fill = {}
    for r in got:
        assert r.length == len(r.ids) // 4 > 0 and r.ids_crc32 == zlib.crc32(r.ids)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    single = [r[0] for r in table if r[0] is not None and r[0] != 0]
    texts = {r[0]: r[1] for r in table}
    for doc in single:
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        ids = b"".join(r.ids for r in parts)
        assert [r.start for r in parts] == list(np.cumsum([0, *[r.length for r in parts[:-1]]]))
        assert all(r.doc_tokens == len(ids) // 4 for r in parts)
        assert ids == np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert sum(r.length for r in got) == sum(n * len(b) // 4 for b, n in want.items())
    assert packing.pack_documents(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000) | st.integers(1, 300), max_size=400))
def test_sequences_are_filled_by_class(lengths):
    filler = packing.Filler(7)
    for doc, n in enumerate(lengths):
        filler.add(doc, memoryview(np.arange(n, dtype="<u4")))
        filler.settle()
    filler.finish()
    held = {}
    for doc, start, ids, total, sequence, offset in filler.ready:
        assert total == lengths[doc] and list(ids) == list(range(start, start + len(ids)))
        held.setdefault(sequence, []).append((offset, len(ids)))
    assert sum(n for x in held.values() for _, n in x) == sum(lengths)
    for parts in held.values():
        parts.sort()
        assert [at for at, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
    sizes = [sum(n for _, n in x) for x in held.values()]
    assert all(n <= 2048 for n in sizes)
    short = [n for n in sizes if n <= 2048 - 64 and n & (n - 1)]
    assert len(short) <= 2  # sequences that were still waiting at the end
    cuts = sum(1 for _, _, ids, total, _, _ in filler.ready if len(ids) < 64 and total >= 64)
    assert cuts <= 25  # only where the last sequences are laid end to end


def test_full_class_takes_its_number_of_documents():
    filler = packing.Filler(0)
    for doc in range(3):
        filler.add(doc, memoryview(np.zeros(680, "<u4")))
    assert [(x[0], x[4], x[5]) for x in filler.ready] == [(0, 0, 0), (1, 0, 680), (2, 0, 1360)] and not filler.open and not filler.waiting


def test_words_are_encoded_as_the_library_does():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = packing.WordIds.of(public_tokenizers.path("word_bpe_49k.json"))
    pieces = st.lists(st.sampled_from(["a", "B", ".", "=", "\u0338", "İ", "\u0958", "ñ", "Я", "Σ", "ŉ", "ſ", "\u212b", "\ufb2a", "7", "--", "s", " ", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x0b", "\x0c", "\x1c", "\r"]), max_size=9).map("".join)

    @settings(max_examples=600, deadline=None)
    @example("İ:")
    @example("\u0958.")
    @example("".join(f" {chr(c)}. .{chr(c)} a{chr(c)}!x" for c in [*range(0x80, 0x590), *range(0x900, 0xA00), *range(0x1E00, 0x2070), *range(0xFB00, 0xFB50)]))
    @given(st.text(max_size=40) | st.text("aΣ éÉİ́̈\n\t\x85 'sd1", max_size=30) | pieces)
    def check(text):
        ids, starts = words.encode(pa.array(["b", text, None]))
        assert ids[starts[1] : starts[2]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids and starts[3] == starts[2]

    check()


@given(st.integers(1, 3000), st.integers(0, 2**40))
@settings(max_examples=40, deadline=None)
def test_permutation(size, key):
    assert sorted(token_shards.permute(np.arange(size), size, key).tolist()) == list(range(size))


def test_token_shards(docs, empty, tik):
    spark = docs.sparkSession
    folder = token_shards.shards(clash(docs), length=32, per_shard=16)
    listed = token_shards.manifest(spark, folder, 32, 16).collect()
    assert sorted(r.slot for r in listed) == list(range(len(listed))) and {r.sequence for r in listed} == set(range(len(listed)))
    assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 64 for r in listed)
    # the slot of every sequence is the keyed permutation's
    slots = token_shards.permute(np.arange(len(listed)), len(listed))
    assert all(slots[r.sequence] == r.slot for r in listed)
    table = rows()
    want = Counter(i for r in table for i in [*tik.encode_ordinary(r[1] or ""), token_shards.END_ID])
    reader = token_shards.Reader(folder, 32, 16)
    size = {r.slot: r.n_tokens for r in listed}
    held = dict(reader.read(0, 10**6))
    assert len(reader) == len(held) == len(listed) and Counter(i for s, x in held.items() for i in x[: size[s]].tolist()) == want
    # in order of their numbers the sequences are the documents' ids, end to end within a task
    line = [i for r in sorted(listed, key=lambda r: r.sequence) for i in held[r.slot][: r.n_tokens].tolist()]
    told = "\n" + "\n".join(map(str, line)) + "\n"
    assert all("\n" + "\n".join(map(str, [*tik.encode_ordinary(r[1] or ""), token_shards.END_ID])) + "\n" in told for r in table)
    crc = {r.slot: r.ids_crc32 for r in listed}
    assert all(zlib.crc32(x[: size[s]].tobytes()) == crc[s] for s, x in held.items())
    assert token_shards.manifest(spark, token_shards.shards(empty)).count() == 0


def test_reader_resumes_anywhere_and_reads_nothing_else(docs):
    folder = token_shards.shards(docs, length=32, per_shard=16)
    reader = token_shards.Reader(folder, 32, 16)
    whole, asked = dict(reader.read(0, len(reader))), []

    class Watched:
        def __init__(self, files):
            self.files = files

        def open_input_file(self, path):
            file = self.files.open_input_file(path)

            class Counted:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    file.close()

                def seek(self, at):
                    file.seek(at)

                def read(self, n):
                    asked.append(n)
                    return file.read(n)

            return Counted()

    reader.files = Watched(reader.files)
    for start in (0, 1, 15, 16, 33, len(reader) - 1, len(reader)):
        asked.clear()
        got = list(reader.read(start, 20))
        assert [s for s, _ in got] == list(range(start, min(start + 20, len(reader)))) and sum(asked) == 64 * len(got)
        assert all((x == whole[s]).all() for s, x in got)


# models


def test_hmm_counts_and_base(docs, empty):
    table = rows()
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) + ["\0"] for r in table]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in table]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r, ws, h in zip(table, words, held):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[(r[0], h, len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6))] += 1
    got = hmm_lm.score_documents(clash(docs).withColumnRenamed("held_out", "Held_Out"), states=3, iterations=2).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm_lm.score_documents(empty, states=2, iterations=1).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 100])
def test_forward_and_expected_counts_equal_enumeration(window):
    """Against sums over all state paths."""
    from itertools import product

    rng = np.random.default_rng(1)
    p = hmm_lm.Parameters(rng.random(3), rng.random((3, 3)), rng.random((5, 3)))
    lines = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 5)]
    steps = hmm_lm.Windows(lines, window)
    start, move, emit = steps.expected(p)
    want, s0, m0, e0 = [], np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for line in lines:
        total, local = 0.0, []
        for path in product(range(3), repeat=len(line)):
            w = p.start[path[0]] * p.emit[line[0], path[0]]
            for a, b, x in zip(path, path[1:], line[1:]):
                w = w * p.move[a, b] * p.emit[x, b]
            total += w
            local.append((path, w))
        want.append(math.log10(total))
        for path, w in local:
            s0[path[0]] += w / total
            for a, b in zip(path, path[1:]):
                m0[a, b] += w / total
            for s, x in zip(path, line):
                e0[x, s] += w / total
    assert steps.likelihood(p) == pytest.approx(want, rel=1e-12)
    assert start == pytest.approx(s0, rel=1e-10) and move == pytest.approx(m0, rel=1e-10) and emit == pytest.approx(e0, rel=1e-10)


@pytest.mark.parametrize("most", [2_000, 10**6])
def test_long_texts_train_and_score_as_one(most, monkeypatch):
    """Texts of thousands of tokens against a plain recursion from end to end."""
    monkeypatch.setattr(hmm_lm, "BATCH_TOKENS", most)
    rng = np.random.default_rng(3)
    p = hmm_lm.Parameters(rng.random(4), rng.random((4, 4)) ** 6, rng.random((50, 4)) ** 8)
    lines = [rng.integers(0, 50, n).astype(np.uint16) for n in (5_000, 1, 1_024, 2_049, 30)]
    start, move, emit, told = np.zeros(4), np.zeros((4, 4)), np.zeros((50, 4)), []
    for line in lines:
        ahead, scales = [], []
        for t, x in enumerate(line):
            value = (p.start if t == 0 else ahead[-1] @ p.move) * p.emit[x]
            scales.append(value.sum())
            ahead.append(value / scales[-1])
        told.append(sum(map(math.log10, scales)))
        back = np.ones(4)
        for t in range(len(line) - 1, -1, -1):
            emit[line[t]] += ahead[t] * back
            if t:
                move += np.outer(ahead[t - 1], p.emit[line[t]] * back / scales[t]) * p.move
                back = p.move @ (p.emit[line[t]] * back / scales[t])
        start += ahead[0] * back
    made = hmm_lm.Windows(lines)
    assert made.likelihood(p) == pytest.approx(told, rel=1e-12)
    for got, rough, want in zip(made.expected(p), made.expected(p.single()), (start, move, emit)):
        assert got == pytest.approx(want, rel=1e-9) and rough == pytest.approx(want, rel=1e-3)


def test_classes_sum_to_one(docs):
    """Probabilities of all training words and one unknown word in each class sum to one."""
    blocks = hmm_lm.token_blocks(docs, "doc_id", "text")
    stats, totals, class_tokens = hmm_lm.word_statistics(blocks)
    sums = {}
    for r in stats.collect():
        if r["count"]:
            sums[r["class"]] = sums.get(r["class"], 0) + 10 ** r.share
    assert all(x <= 1 + 1e-6 for x in sums.values()) and class_tokens.sum() == totals["tokens"]


def test_held_out_language_and_score(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert sum(found[i].lang_pred == truth[i] for i in held) / len(held) >= 0.95
    scored = hmm_lm.score_documents(docs, iterations=4).where("held_out").collect()
    assert sum(r.score for r in scored) > sum(r.base_score for r in scored)


def test_language_id(docs, empty):
    got = langid.identify(clash(docs)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == "de" and by[0].lang_pred == "en" and by[9].lang_pred in ("de", "en")
    for i in (4, 5, 6, 10):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(empty).count() == 0
    unlabelled = docs.withColumn("lang", docs["lang"].substr(50, 1)).where("lang is null")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    kept = langid.keep_identified(clash(docs))
    assert kept.columns == clash(docs).columns and kept.where("doc_id in (4, 5, 6, 10)").count() == 0


def test_mixed_text_is_labelled_in_spans(docs):
    model = langid.fit(docs)
    text = EN * 3 + DE * 3
    (row,) = langid.predict(docs.sparkSession.createDataFrame([(text,)], "text string"), model, with_spans=True).collect()
    spans = row[-1]
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].end - len(EN * 3)) <= 12 and spans[-1].end == len(text) - 1


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    score = -rng.random((6, 3)) * 10
    lines = [rng.integers(0, 6, n) for n in (5, 1, 0, 4)]
    for line, labels in zip(lines, langid.viterbi(score, lines, 3.0)):
        value = lambda path: sum(score[w, s] for w, s in zip(line, path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        if len(line):
            assert value(labels) == pytest.approx(max(map(value, product(range(3), repeat=len(line)))), abs=1e-4)
        else:
            assert len(labels) == 0
