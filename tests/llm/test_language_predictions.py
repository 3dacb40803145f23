"""Language predictions from end to end against plain Python, many languages, and columns that bear internal names."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlens.llm import langid

from .test_text_operators import DOCS, rows

SCRIPT_STARTS = [start for start, _ in langid._RANGES]


def script(word):
    return langid._RANGES[max(i for i, s in enumerate(SCRIPT_STARTS) if s <= ord(word[0]))][1]


def grams(word):
    raw = b" " + word.lower().encode() + b" "
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            code = n
            for byte in raw[i : i + n]:
                code = (code * 257 + byte) % 2**64
            yield (code * 0x9E3779B97F4A7C15) % 2**64 >> 49


def words_of(text):
    return re.findall(r"[^\W\d_]+", text or "")


def letters(word):
    return sum(map(str.isalpha, word))


def brute(table):
    return Counter((doc, lang, score) for doc, lang, score, _ in told(table))


def told(table):
    """For each row its id, language, score and supported score, by counts, a Viterbi table and letters of each word."""
    counts, written = {}, {}
    for doc, text, lang, *_ in table:
        if lang is not None and not (doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2):
            for w in words_of((text or "").lower()):
                counts.setdefault(lang, Counter()).update(grams(w))
                written.setdefault(lang, Counter())[script(w)] += letters(w)
    langs = sorted(counts)
    total = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    allowed = {s: [x for x in langs if written[x][s] >= 0.002 * max(1, sum(written[x].values()))] for s in langid.SCRIPTS}

    def score(word):
        found = {x: sum(math.log((counts[x][g] + 0.5) / total[x]) for g in grams(word)) for x in (allowed[script(word)] or langs)}
        best = max(found.values())
        return {x: max(found.get(x, -math.inf) - best, -langid.CLIP) for x in langs}

    out = []
    for doc, text, *_ in table:
        words = words_of(text)
        if not words or not langs:
            out.append((doc, "und", 0.0, 0.0))
            continue
        scores, value, back = [score(w) for w in words], dict.fromkeys(langs, 0.0), []
        for t, s in enumerate(scores):
            best = max(langs, key=lambda x: (value[x], -langs.index(x)))
            top = value[best] - (langid.SWITCH if t else 0)
            back.append({x: x if value[x] >= top else best for x in langs})
            value = {x: max(value[x], top) + s[x] for x in langs}
        label, state = [], max(langs, key=lambda x: (value[x], -langs.index(x)))
        for step in reversed(back):
            label.append(state)
            state = step[state]
        label.reverse()
        size = Counter()
        for w, x in zip(words, label):
            size[x] += letters(w)
        main = max(langs, key=lambda x: (size[x], -langs.index(x)))
        sure = supported = 0
        for w, x, s in zip(words, label, scores):
            ranked = sorted(s.values())
            if s[x] == ranked[-1] and (len(ranked) == 1 or ranked[-1] > ranked[-2]):
                sure += letters(w) * (x == main)
                supported += letters(w) * bool(allowed[script(w)])
        out.append((doc, main, round(sure / sum(size.values()), 6), supported / sum(size.values())))
    return out


def test_predictions_equal_brute_force(spark):
    table = rows()
    got = langid.identify(spark.createDataFrame(table, DOCS).repartition(3)).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in got) == brute(table)


def test_kept_rows_equal_brute_force(spark):
    table = rows()
    docs = spark.createDataFrame(table, DOCS).repartition(3)
    for name in ("LANG_PRED", "Lang_Score", "Spans", "__lang_pred"):
        docs = docs.withColumn(name, F.lit(name))
    kept = langid.keep_identified(docs, least=0.5)
    assert kept.columns == docs.columns
    want = Counter((r[0], r[1], r[2] or lang) for r, (_, lang, _, known) in zip(table, told(table)) if lang != "und" and known >= 0.5)
    assert Counter((r.doc_id, r.text, r.lang) for r in kept.collect()) == want and sum(want.values()) < len(table)
    only = langid.keep_identified(docs, least=0.5, wanted={"de"}).collect()
    assert {r.doc_id for r in only} == {doc for doc, lang, _, known in told(table) if lang == "de" and known >= 0.5}


@pytest.mark.parametrize("cells", [1 << 22, 1 << 13])
def test_thousands_of_languages(spark, cells, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", cells)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}ent" for i in range(1_200)]
    table = [(4 * i, f"{w} {w}s " * 3, f"l{i:04d}", "s", 1) for i, w in enumerate(words)] + [(10**6 + i, w, None, "s", 1) for i, w in enumerate(words[:50])]
    docs = spark.createDataFrame(table, DOCS)
    model = langid.fit(docs)
    assert model.weights.size <= max(cells, 64 * len(model.languages))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert len(got) == len(table) and set(got.values()) <= set(model.languages)
    if cells > 1 << 20:
        learnt = set(model.languages)
        right = [got[10**6 + i] == f"l{i:04d}" for i in range(50) if f"l{i:04d}" in learnt]
        assert sum(right) >= 0.9 * len(right)


def test_more_languages_than_sixteen_bits_hold():
    import numpy as np

    score = np.full((3, 40_000), -langid.CLIP, np.float32)
    score[0, 35_000] = score[1, 35_000] = score[2, 39_999] = 0
    (label,) = langid.viterbi(score, [np.array([0, 1, 0, 2, 2, 2, 1])])
    assert label.tolist() == [35_000] * 3 + [39_999] * 3 + [35_000]
    assert np.bincount(label, minlength=40_000).argmax() == 35_000
