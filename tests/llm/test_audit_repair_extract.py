"""Filter audit, conversation repair and main texts against plain Python, with nulls, ties, repeats, long and empty input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlens.llm import common, conv_repair, filter_audit, html_extract

SMALL = "/root/testdata/sf0.01"
SPACE = "\x20\x09-\x0d"


def audit(docs, labels):
    """Every order replayed over all documents."""
    least, good, toxic, seen = {}, set(), set(), defaultdict(list)
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(f"[^{SPACE}]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        seen[lang or ""].append((fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part, rows in seen.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order, 1):
                lost = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(lost)
                unique = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                out[part, "".join(order), k] = [f, len(left), len(lost), sum(r[0][f] for r in rows) - len(lost), unique, sum(r[1] for r in lost), sum(r[2] for r in lost)]
        for key, row in out.items():
            if key[0] == part:
                row.append(shapley[row[0]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    rows = filter_audit.interactions(common.written(filter_audit.survivors(filter_audit.flagged(docs, labels)), "subsets")).collect()
    return {(r.part, r.filter_order, r.step): (r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_filter_audit(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(None, None, None), (1, None, "en"), (2, "", "en"), (None, "", ""), (3, "A", "en"), (3, "A", "en"), (4, "A", "de"), (0, "A" * 9, "de"), (5, "x\x0by z", None), (6, " \t\n", None)]
    for i in range(60):
        body = " ".join(rng.choices(words[: rng.choice([20, 400])], k=rng.choice([5, 199, 200, 500]))) + rng.choice(["", " 100%", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, " a|b"])
        docs += [(100 + i, body, rng.choice(["en", "de"]))] + ([(300 - i, body, "fr")] if i % 4 == 0 else [])
    docs.append((500, "long " * 200_000, "en"))
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for d in docs[::2]] + [(101, 0, 0), (101, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audit(docs, labels)
    assert audited(frame, table) == want
    for name in ("id", "part", "A", "digest", "n", "least", "good"):
        frame = frame.withColumn(f"{name}", F.lit("x")) if name not in frame.columns else frame
    assert audited(frame, table.withColumn("id", F.lit(1))) == want
    assert audited(frame.where("false"), table) == {}
    alone = audited(frame, table.where("false"))
    assert {k: v[:5] + v[7:] for k, v in alone.items()} == {k: v[:5] + v[7:] for k, v in want.items()} and all(v[5] == v[6] == 0 for v in alone.values())


def enumerated(signature):
    """The least (cost, edits) of all, by trying them."""
    best = [(4 * len(signature), "D" * len(signature))]

    def go(i, state, cost, edits):
        if cost > best[0][0]:
            return
        if i == len(signature) and state in (conv_repair.START, conv_repair.A):
            best[0] = min(best[0], (cost, edits))
        turn = conv_repair.A if state == conv_repair.U else conv_repair.U
        if not edits.endswith("III"):
            go(i, turn, cost + 3, edits + "I")
        if i < len(signature):
            initial, fault = conv_repair.INITIALS[(ord(signature[i]) - 97) // 4], (ord(signature[i]) - 97) % 4
            go(i + 1, state, cost + 4, edits + "D")
            if fault in (conv_repair.OK, conv_repair.CUT):
                more = 3 * (fault == conv_repair.CUT)
                if initial in conv_repair._AFTER[state]:
                    go(i + 1, conv_repair._AFTER[state][initial], cost + more, edits + "K")
                go(i + 1, turn, cost + 3 + more, edits + "R")

    go(0, conv_repair.START, 0, "")
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abdefhijlm", max_size=6), max_size=12))
def test_trie_finds_least_edits(signatures):
    trie = conv_repair.Trie()
    for s in sorted(set(signatures)):
        assert trie.answer(s) == enumerated(s)


def test_trie_shares_prefixes():
    trie = conv_repair.Trie()
    for s in sorted(["aei" * 50 + x for x in "abefij"]):
        trie.answer(s)
    assert trie.computed == 150 + 6 and len(trie.known) < 40


def mended(rows):
    """Every result of a conversation in plain Python."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        kept = groups[conv]
        r = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if r:
            role, text = "user" if r == 4 else role, "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
            kept += [(turn, role, text)] * (2 if r == 3 else 1)
    out = {}
    for conv, kept in groups.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        signature, seen, count = "", set(), Counter()
        for _, role, text in kept:
            last = re.sub(f"[{SPACE}]+$", "", text)[-1:]
            fault = conv_repair.BLANK if not last else conv_repair.COPY if (role, text) in seen else conv_repair.CUT if last not in ".!?" else conv_repair.OK
            seen.add((role, text))
            count[fault] += 1
            signature += conv_repair.letter(role[:1] if role[:1] in ("s", "u", "a") else "x", fault)
        turns = {t for t, *_ in kept if t is not None}
        cost, edits = conv_repair.Trie().answer(signature)
        lines, left, state = [], iter(kept), "a"
        for e in edits:
            role, text = ("", "") if e == "I" else next(left)[1:]
            if e in "RI":
                role = "assistant" if state == "u" else "user"
            if e != "D":
                state = role[:1]
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count[conv_repair.BLANK], count[conv_repair.COPY], count[conv_repair.CUT], sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string"


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_conversation_repair(spark, monkeypatch):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "userx"], ["Yes.", "No?", "well", "", " \t", None, "a b!\n", "line\nbreak.", "end", "Oh!"]
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {c} {t}.") for c in range(60) for t in range(rng.randrange(9))]
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y."), (71, None, None, None), (72, 1, "user", "same."), (72, 1, "user", "same."), (72, 1, "user", "same.")]
    rows += [(c, 5, "user", "only one row.") for c in range(200, 240)]  # of some every row is dropped
    rows += [(80, t, roles[t % 2], f"hot {t}." if t % 3 else "hot.") for t in range(400)] + [(81, 7, "user", f"tie {k}.") for k in range(200)] + [(82, 0, "user", "long " * 100_000 + ".")]
    rows += [(83, 1, "assistant", "ever the same.")] * 150
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    want = mended(rows)
    assert "" in {v[6] for v in want.values()} and any("R" in v[6] for v in want.values())
    assert found(conv_repair.repair(frame)) == want
    monkeypatch.setattr(conv_repair, "SEGMENT_ROWS", 3)
    monkeypatch.setattr(conv_repair, "SEGMENT_CHARS", 40)
    clash = frame
    for name in ("place", "n", "letters", "signature", "__r", "of", "digest"):
        clash = clash.withColumn(name, F.lit("x"))
    assert found(conv_repair.repair(clash)) == want
    assert found(conv_repair.repair(frame.where("false"))) == {}


@pytest.mark.parametrize("seed", range(6))
def test_marginals_are_exact(seed):
    rng = np.random.default_rng(seed)
    n = 7
    parents = np.array([-1, *[rng.integers(0, i) for i in range(1, n)]])
    tags, evidence, step = rng.integers(0, 4, n), rng.normal(size=(n, 3)) * 2, rng.normal(size=(4, 3, 3))
    step -= np.log(np.exp(step).sum(axis=2, keepdims=True))
    total = np.zeros((n, 3))
    for states in itertools.product(range(3), repeat=n):
        weight = np.exp(sum(evidence[i, s] + step[tags[i], states[parents[i]] if i else html_extract.FRAME, s] for i, s in enumerate(states)))
        total[range(n), states] += weight
    assert np.allclose(html_extract.marginals(tags, parents, evidence, step), total / total.sum(axis=1, keepdims=True))


def blocks(source):
    return [t for _, t, _ in html_extract.Page(source).texts]


def test_pages_are_read_as_browsers_do():
    assert blocks("<p>a<p>b<ul><li>c<li>d</ul>e<br>f &amp; &eacute;&nbsp;g") == ["a", "b", "c", "d", "e f & é g"]
    assert blocks("<script>var t='<p>no</p>';</script><style>p{}</style><p title='a>b'>x<!-- <p>y --> z</p></div>") == ["x z"]
    assert blocks("<title>t</title><head><meta><body><b>x<i>y</b> z<table><tr><td>1<td>2<tr><td>3</table>") == ["xy z", "1", "2", "3"]
    assert blocks("1 < 2 and <3 <p") == ["1 < 2 and <3"] and blocks("") == [] and blocks("<script>never closed <p>x") == []
    assert blocks("<p class='it>is'>x</p><p class=it's>y</p>") == ["x", "y"]
    deep = html_extract.Page("<div>" * 20_000 + "x" + "</div>" * 20_000)
    assert len(deep.tags) == 20_002


LONG = "This is a comment by a reader who has much to say about it, and who ends it well. " * 2
COMMENTS = "".join(f"<li><div><p>{LONG}</p></div></li>" for _ in range(40))
AROUND = [
    "<html><body><header><h2>Site</h2></header><div id=sidebar><p>{l}</p></div><div class='post-content'>{b}</div><section id=comments><ol>{c}</ol></section><form>Name <p>{l}</p></form></body></html>",
    "<body><div class='cookie-notice'><p>{l}</p></div><main>{b}<aside><p>{l}</p></aside><div class=comments><article><p>{l}</p></article></div></main>",
    "<body><div class=site-header>Big Site</div><article>{b}<div class=share-buttons>Share</div><div class=newsletter><p>{l}</p></div></article><div class='ad-slot'>{l}</div><div style='display:none'>{l}</div>",
]


def test_main_texts_of_held_out_pages(spark):
    pages = common.table(spark, SMALL, "pages")
    potentials = html_extract.train(pages.where("page_id % 2 = 0"), keys=["page_id"], train_pages=100)
    held = [r.html for r in pages.where("page_id % 2 = 1").collect()]
    want, bodies = [], []
    for source in held:
        bodies.append(re.search("<article>(.*?)</article>", source, re.S).group(1))
        want.append("\n".join(blocks(bodies[-1])))
    assert html_extract.main_texts(held, potentials) == want
    masked = html_extract.main_texts([re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", s) for s in held], potentials)
    assert sum(x == y for x, y in zip(masked, want)) >= 0.9 * len(want)
    for around in AROUND:
        got = html_extract.main_texts([around.format(b=b, l=LONG, c=COMMENTS) for b in bodies], potentials)
        assert sum(x == y for x, y in zip(got, want)) >= 0.95 * len(want), around


def test_extraction_of_awkward_rows(spark):
    rows = [(1, "u", None), (None, None, "<article><p>x. y &lt; z</p></article>"), (2, "v", ""), (2, "v", ""), (3, "w", "<nav>menu</nav>"), (4, "x", "<article>" + "<p>word word word.</p>" * 50_000 + "</article>"), (5, "y", "<article></article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("__html", F.lit(1)).repartition(2)
    seeded = html_extract.Potentials(Counter())
    potentials = html_extract.train(frame, keys=["page_id", "url"], labelled=spark.createDataFrame([("<nav data-main=0>menu</nav><article data-main=1><p>some words.</p></article>",)] * 20, "html string"))
    got = Counter((r.page_id, r.url, r.text) for r in html_extract.extract(frame, potentials, ["page_id", "url"]).collect())
    assert got == Counter([(1, "u", ""), (None, None, "x. y < z"), (2, "v", ""), (2, "v", ""), (3, "w", ""), (4, "x", "\n".join(["word word word."] * 50_000)), (5, "y", "")])
    assert html_extract.extract(frame.where("false"), seeded, ["page_id", "url"]).collect() == []
    assert html_extract.train(frame.where("false"), keys=["page_id"]).step.shape == seeded.step.shape
