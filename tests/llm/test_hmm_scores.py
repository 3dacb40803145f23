"""The language model's scores against one in plain Python, from words to log probabilities."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from auditlens.llm import common, hmm_lm

STATES, OWN, SUFFIXES = 3, 60, 16


def plain_model(docs):
    """Each text's words, and of every word its class and the log10 of its share of that."""
    texts = {i: [*(t or "").encode().lower().decode().split(), ""] for i, t in docs}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    count = Counter(w for i in train for w in texts[i])
    own = sorted((w for w, n in count.items() if n * OWN >= sum(count.values())), key=lambda w: (-count[w], w.encode()))
    place = {w: k for k, w in enumerate(own)}
    words = {w for t in texts.values() for w in t}
    klass = {w: place[w] if w in place else len(own) + xxhash.xxh64_intdigest(w[-3:].encode(), 42) % SUFFIXES for w in words}
    tokens, types = Counter(), Counter()
    for w in words:
        tokens[klass[w]] += count[w]
        types[klass[w]] += count[w] > 0
    share = {w: 0.0 if w in place else math.log10((count[w] + 0.5) / (tokens[klass[w]] + 0.5 * (types[klass[w]] + 1))) for w in words}
    return texts, train, klass, share, np.array([float(tokens[k]) for k in range(len(own) + SUFFIXES)])


def forward(p, line):
    """Scaled forward values and scales, a token at a time."""
    held, scales = [], []
    for t, c in enumerate(line):
        value = (p.start if t == 0 else held[-1] @ p.move) * p.emit[c]
        scales.append(value.sum())
        held.append(value / scales[-1])
    return held, scales


def step(p, lines, prior):
    """One Baum-Welch step over whole texts."""
    start, move = np.full(STATES, 0.1), np.full((STATES, STATES), 0.1)
    emit = np.repeat(prior[:, None], STATES, axis=1) + 1e-3
    for line in lines:
        held, scales = forward(p, line)
        back = np.ones(STATES)
        for t in range(len(line) - 1, -1, -1):
            emit[line[t]] += held[t] * back
            if t == 0:
                start += held[0] * back
                break
            ahead = p.emit[line[t]] * back / scales[t]
            move += np.outer(held[t - 1], ahead) * p.move
            back = p.move @ ahead
    return hmm_lm.Parameters(start, move, emit)


@pytest.fixture
def small_classes(monkeypatch):
    """Few enough classes that most words share one; windows shorter than most texts."""
    monkeypatch.setattr(hmm_lm, "OWN_CLASS", OWN)
    monkeypatch.setattr(hmm_lm, "SUFFIX_CLASSES", SUFFIXES)


def test_scores_equal_a_model_in_plain_python(spark, monkeypatch, small_classes):
    common.importable(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(50).select("doc_id", "text").collect()
    docs = [tuple(r) for r in docs] + [(10_001, None), (10_002, ""), (10_003, "  nowhere seen É Ab "), (10_004, "a")]
    learnt = []
    train = hmm_lm.baum_welch
    monkeypatch.setattr(hmm_lm, "baum_welch", lambda *a: learnt.append(train(*a)) or learnt[-1])
    got = {r.doc_id: r.score for r in hmm_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), states=STATES, iterations=3).collect()}
    texts, trained, klass, share, class_tokens = plain_model(docs)
    p = learnt[0]
    assert set(got) == set(texts) and len(class_tokens) == len(p.emit) and any(x < 0 for x in share.values())
    # the model that was trained, applied in plain Python
    for i, words in texts.items():
        want = sum(map(math.log10, forward(p, [klass[w] for w in words])[1])) + sum(share[w] for w in words)
        assert got[i] == pytest.approx(want, rel=1e-9), i
    # training in plain Python; the operator's steps are in single precision
    plain = hmm_lm.Parameters.initial(class_tokens, STATES)
    prior = hmm_lm.PRIOR * (class_tokens + 1) / (class_tokens + 1).mean()
    for _ in range(3):
        plain = step(plain, [[klass[w] for w in texts[i]] for i in sorted(trained)], prior)
    for name in ("start", "move", "emit"):
        np.testing.assert_allclose(getattr(p, name), getattr(plain, name), rtol=2e-3, atol=1e-6)
    for i, words in texts.items():
        want = sum(map(math.log10, forward(plain, [klass[w] for w in words])[1])) + sum(share[w] for w in words)
        assert got[i] == pytest.approx(want, rel=1e-5), i


def test_shares_of_a_class_and_one_unknown_word_sum_to_one(spark, small_classes):
    common.importable(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    stats, _, class_tokens = hmm_lm.word_statistics(hmm_lm.token_blocks(docs, "doc_id", "text"))
    known = {}
    for r in stats.where("count > 0").collect():
        known.setdefault(r["class"], []).append((r["count"], r["share"]))
    own = len(class_tokens) - SUFFIXES
    assert any(k >= own for k in known)
    for k, words in known.items():
        tokens, types = sum(n for n, _ in words), len(words)
        assert tokens == class_tokens[k]
        unknown = 0.5 / (tokens + 0.5 * (types + 1)) if k >= own else 0
        assert sum(10**s for _, s in words) + unknown == pytest.approx(1, rel=1e-12)


def test_a_chunk_is_gone_before_the_next_one_is_made():
    import weakref

    import pyarrow as pa

    from auditlens.llm import common

    batches = [pa.RecordBatch.from_pydict({"text": ["x" * 100]}) for _ in range(3)]
    alive = []
    for tab in common.chunks(iter(batches), "text", 50):
        alive.append(weakref.ref(tab))
        del tab
        assert alive[-1]() is None
    assert len(alive) == 3
