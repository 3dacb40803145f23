"""Main text of web pages: a tree-structured graphical model over the DOM.

Nodes are a page's block elements and its runs of text.  Each has one of three states:
``FRAME`` (what stands around the article and holds it), ``MAIN`` (the article) and ``CHROME`` (all else).
Potentials tie a child's state to its parent's, by the child's tag; words of classes, ids and roles,
and the look of a run of text (length, share of links, sentence end), are evidence of their own.
Sum-product messages run upward and downward once, which is exact on a tree, and a run of
text is kept if its marginal of ``MAIN`` is over a half.  All pages of a batch pass messages level by
level in numpy.

Potentials are counted from labelled pages: pages of the table that label themselves (one outermost
``article``, or ``main`` where there is none: a landmark element), ``TRAIN_PAGES`` of them about, chosen by a hash
over the whole table, and once more with landmarks masked as ``div``, so that the text counts where a page has no
landmarks; further labelled pages (``data-main`` attributes) may be given.  ``seeds`` builds a few by rule from two
lists of words that menus, notices, comments and articles are usually named by.  Counts are added up in Spark; what
reaches the driver has at most one row per tag, state pair, hashed word and look.
Runs of a page's text share ``VOICE`` votes: they are no independent witnesses, and hundreds of long comments must not
outvote the name of the element that holds them.

Defined results: null html is empty, and a page without text in its article has an empty text.  Character
references are decoded; white space (Unicode's) inside a block becomes one space; a block is a run of text that no
start or end of a block element interrupts; ``br`` is white space.  Scripts, styles, titles, templates and other elements that
are not shown never are text.  Broken markup is read as browsers do where it matters here: implied ends
of paragraphs, list items and cells, stray ends ignored, all closed at the end.  Nesting may be of any
depth.  Rows are results of their own, ids null or repeated; further columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Self-labelled pages that potentials are counted from, in expectation.
TRAIN_PAGES = 20_000
#: Html characters that pass messages together.
BATCH_CHARS = 4 << 20
#: Votes of all text of a page, weight of an element's words, buckets of hashed words, weight of masked and of seed pages.
VOICE, NAMED, BUCKETS, MASKED, SEED = 6.0, 2.0, 4096, 0.1, 1.0
FRAME, MAIN, CHROME = range(3)

# fixed values: elements of HTML by how they are shown
BLOCKS = """html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4
h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table caption tbody td tfoot th thead tr ul button
template noscript svg math object video audio canvas""".split()
HIDDEN = set("head template noscript svg math object video audio canvas select button".split())
RAW = "script style title textarea xmp iframe noembed noframes".split()
VOID = {"hr"}
CLOSES_P = set(BLOCKS) - set("html head body dd dt li optgroup option td th tr tbody tfoot thead caption legend button select template noscript svg math object video audio canvas".split())
#: Start tags that end an open element of the first kind, unless one of the second is between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
}
TEXT, ROOT = "#text", "#root"
TAGS = {t: i for i, t in enumerate([ROOT, TEXT, *BLOCKS])}
LANDMARKS = {"article", "main", "nav", "footer", "header", "aside", "form", "section"}
_OTHERS = {"nav", "aside", "footer", "form", "dialog"}

# fixed values: names that page parts usually bear
CHROME_NAMES = """nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc header masthead topbar branding banner footer copyright legal contentinfo colophon
sidebar aside complementary widget rail notice cookie cookies consent gdpr privacy alert warning announcement popup modal overlay newsletter subscribe signup
ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion share sharing social follow related recommended recommendations trending popular
tags taglist login register search form contact comment comments commentlist reply replies respond discussion disqus feedback hidden skip toolbar""".split()
MAIN_NAMES = "article articlebody content post entry story main text prose body blogpost".split()
FRAME_NAMES = "page wrapper wrap container site layout row col grid app root inner outer".split()

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?|["'])*+)(>|\Z)""", re.S
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role|data-main)\s*+=\s*+(?:"([^"]*+)|'([^']*+)|([^\s"'>]++))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SHOWN = re.compile(r"(?<![^\s\"'/])hidden(?=[\s/=]|\Z)|display\s*:\s*none", re.I)


class Page:
    """A page's tree: per node tag, parent (itself before its children), words, mark; runs of text with their links."""

    __slots__ = ("tags", "parents", "words", "marks", "texts")

    def __init__(self, source: str):
        self.tags, self.parents, self.words, self.marks = [TAGS[ROOT]], [-1], [()], [None]
        self.texts: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._read(source)

    def _open(self, tag: str, parent: int, attributes: str = "") -> int:
        words, mark = [], None
        if attributes and attributes != "/":
            for name, *values in _NAMED.findall(attributes):
                value = values[0] or values[1] or values[2]
                if name.lower() == "data-main":
                    mark = value
                else:
                    words += [w.lower() for w in _PARTS.findall(value)]
            if _SHOWN.search(attributes):
                words.append("hidden")
        self.tags.append(TAGS[tag])
        self.parents.append(parent)
        self.words.append(tuple(dict.fromkeys(words)))
        self.marks.append(mark)
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack, names = [0], [ROOT]  # open elements
        held: list[str] = []
        linked, in_link, hidden = 0, False, 0

        def flush():
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    self.texts.append((self._open(TEXT, stack[-1]), text, linked))
            linked = 0

        def close(to: int):
            nonlocal hidden
            for name in names[to:]:
                hidden -= name in HIDDEN
            del stack[to:], names[to:]

        def said(raw: str):
            nonlocal linked
            if not hidden:
                text = references.unescape(raw) if "&" in raw else raw
                held.append(text)
                if in_link:
                    linked += len(text)

        at, end, find = 0, len(source), _TOKEN.search
        while at < end:
            token = find(source, at)
            if token is None:
                said(source[at:])
                break
            if token.start() > at:
                said(source[at : token.start()])
            at = token.end()
            tag = token.group(2)
            if tag is None or not token.group(4):
                continue
            tag = tag.lower()
            if tag in _RAW_END:
                if not token.group(1):
                    over = _RAW_END[tag].search(source, at)
                    at = over.end() if over else end
                continue
            if tag not in TAGS:
                if tag == "a":
                    in_link = not token.group(1)
                elif tag == "br":
                    held.append(" ")
                continue
            flush()
            if token.group(1):
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == tag:
                        close(k)
                        break
                continue
            if tag == "body" and "head" in names or names[-1] == "head" and tag in CLOSES_P:
                close(names.index("head"))
            if tag in ("html", "body") and tag in names:
                continue
            if tag in CLOSES_P and names[-1] == "p":
                close(len(names) - 1)
            elif tag in CLOSES:
                ended, bounds = CLOSES[tag]
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in bounds:
                        break
                    if names[k] in ended:
                        close(k)
                        if tag != "tr" and tag not in ("tbody", "tfoot", "thead"):
                            break
            node = self._open(tag, stack[-1], token.group(3))
            if tag not in VOID:
                stack.append(node)
                names.append(tag)
                hidden += tag in HIDDEN
        flush()

    def labels(self, masked: bool = False) -> list[int] | None:
        """States by ``data-main`` marks, else by the one landmark that holds the article; None if the page does not tell."""
        n = len(self.tags)
        inside: list[int | None] = [None] * n
        if any(m is not None for m in self.marks):
            for i in range(n):
                mark = self.marks[i]
                inside[i] = (MAIN if mark == "1" else CHROME) if mark is not None else inside[self.parents[i]] if i else None
        else:
            for name in ("article", "main"):
                own, outer = TAGS[name], [False] * n
                roots = []
                for i in range(1, n):
                    p = self.parents[i]
                    outer[i] = outer[p] or self.tags[i] == own
                    if self.tags[i] == own and not outer[p]:
                        roots.append(i)
                if roots:
                    break
            if len(roots) != 1:
                return None
            other = {TAGS[t] for t in _OTHERS | {"article"}}
            for i in range(roots[0], n):
                p = self.parents[i]
                if i == roots[0]:
                    inside[i] = MAIN
                elif inside[p] is not None:
                    inside[i] = CHROME if inside[p] == CHROME or self.tags[i] in other else MAIN
        holds = [x == MAIN for x in inside]
        for i in range(n - 1, 0, -1):
            holds[self.parents[i]] |= holds[i]
        return [x if x is not None else FRAME if h else CHROME for x, h in zip(inside, holds)]


def bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 13) % BUCKETS


def look(text: str, linked: int) -> int:
    """The look of a run of text: length, share of links, sentence end."""
    size = min(9, len(text).bit_length())
    links = 0 if not linked else min(3, 1 + 3 * linked // max(1, len(text)))
    return (size * 4 + links) * 2 + text.endswith((".", "!", "?", "…", "。", "！", "？"))


LOOKS = 80


def counted(page: Page, weight: float, into: Counter) -> None:
    """Add a labelled page's counts: ('t', tag, parent state, state), ('w', bucket, 0, state), ('l', look, 0, state)."""
    states = page.labels()
    if states is None:
        return
    for masked in (False, True):
        share = weight * (MASKED if masked else 1.0)
        for i, tag in enumerate(page.tags):
            tag = MASK[tag] if masked else tag
            into["t", tag, states[page.parents[i]] if i else FRAME, states[i]] += share
            if not masked:
                for w in page.words[i]:
                    into["w", bucket(w), 0, states[i]] += share
    for node, text, linked in page.texts:
        into["l", look(text, linked), 0, states[node]] += weight


MASK = [TAGS["div"] if t in LANDMARKS else i for t, i in TAGS.items()]


def seeds() -> list[str]:
    """Labelled pages by rule: each name of page chrome with short, linked and long text beside and inside an article."""
    long_, short = "This is a sentence of a longer text, and it goes on for a while before it ends. " * 3, "A few words"
    article = f"<h1>{short}</h1><p>{long_}</p><h2>{short}</h2><p>{long_}</p><ul><li>{short}.</li></ul><p>{long_}</p><p>{short}.</p>"
    links = "<ul>" + f'<li><a href="/x">{short}</a></li>' * 4 + "</ul>"
    out = []
    tags = ["nav", "header", "footer", "aside", "form", "section", "dialog", "div", "div", "div"]
    for i, name in enumerate(CHROME_NAMES):
        main, frame = MAIN_NAMES[i % len(MAIN_NAMES)], FRAME_NAMES[i % len(FRAME_NAMES)]
        for k in range(3):
            tag = tags[(i + k) % len(tags)]
            inner = [links, f"<p>{short}</p>", f"<div><p>{long_}</p></div><div><p>{long_}</p></div><article><p>{long_}</p></article>"][k]
            part = f'<{tag} class="{name}" data-main="0">{inner}</{tag}>'
            named = f'<{tag} id="{main}-{name}" data-main="0">{inner}</{tag}>' if k == 1 and i % 4 == 0 else ""
            holder = "article" if k == 2 and i % 2 else "div"
            body = f'<{holder} class="{main}" data-main="1">{article}{part if k == 2 else ""}</{holder}>'
            if k == 1:
                body = f'<main data-main="1"><header><h1>{short}</h1></header><section>{article}</section></main>'
            out.append(f'<body><div id="{frame}">{part if k == 0 else ""}{body}{part if k == 1 else ""}{named}</div></body>')
    out += [f'<body data-main="1">{article}</body>', f'<p data-main="1">{long_}</p>', f'<body data-main="1">{long_}<br>{long_}</body>'] * 5
    return out


class Potentials:
    """Log potentials from counts: ``step[tag, parent state, state]``, ``word[bucket, state]``, ``look[look, state]``."""

    def __init__(self, counts: dict[tuple, float]):
        step, word, seen = np.zeros((len(TAGS), 3, 3)), np.zeros((BUCKETS, 3)), np.zeros((LOOKS, 3))
        for (kind, a, b, state), n in counts.items():
            if kind == "t":
                step[a, b, state] += n
            elif kind == "w":
                word[a, state] += n
            else:
                seen[a, state] += n
        every = step.sum(axis=0) + 0.01
        every /= every.sum(axis=1, keepdims=True)
        step += every
        self.step = np.log(step / step.sum(axis=2, keepdims=True))
        word += 0.1
        self.word = NAMED * np.log(3 * word / word.sum(axis=1, keepdims=True))  # a word never met says nothing
        seen += 1.0
        self.look = np.log(seen / seen.sum(axis=0))
        self.look -= self.look.mean(axis=1, keepdims=True)
        self.buckets: dict[str, int] = {}

    def evidence(self, pages: list[Page]) -> np.ndarray:
        out = np.zeros((sum(len(p.tags) for p in pages), 3))
        begin = 0
        for p in pages:
            for i, words in enumerate(p.words):
                for w in words:
                    k = self.buckets.get(w)
                    if k is None:
                        if len(self.buckets) > 100_000:
                            self.buckets.clear()
                        k = self.buckets[w] = bucket(w)
                    out[begin + i] += self.word[k]
            voice = min(1.0, VOICE / max(1, len(p.texts)))
            for node, text, linked in p.texts:
                out[begin + node] += voice * self.look[look(text, linked)]
            begin += len(p.tags)
        return out


def _summed(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def marginals(tags: np.ndarray, parents: np.ndarray, evidence: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Exact marginals of every node of a forest; a root's parent is -1 and parents stand before children."""
    n = len(tags)
    depth = np.zeros(n, np.int64)
    for i, p in enumerate(parents.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(depth))]) if n else np.zeros(1, np.int64)
    up, sent = evidence.copy(), np.zeros((n, 3))
    for d in range(len(bounds) - 2, 0, -1):
        level = order[bounds[d] : bounds[d + 1]]
        sent[level] = _summed(step[tags[level]] + up[level][:, None, :], 2)
        np.add.at(up, parents[level], sent[level])
    down = np.zeros((n, 3))
    for d in range(len(bounds) - 1):
        level = order[bounds[d] : bounds[d + 1]]
        if d == 0:
            down[level] = step[tags[level], FRAME]
        else:
            above = up[parents[level]] + down[parents[level]] - sent[level]
            down[level] = _summed(step[tags[level]] + above[:, :, None], 1)
    both = up + down
    return np.exp(both - _summed(both, 1)[:, None])


def main_texts(sources: list[str], potentials: Potentials) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    sizes = [len(p.tags) for p in pages]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    parents = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + s) for p, s in zip(pages, starts)]) if pages else np.zeros(0, np.int64)
    tags = np.concatenate([np.array(p.tags) for p in pages]) if pages else np.zeros(0, np.int64)
    main = marginals(tags, parents, potentials.evidence(pages), potentials.step)[:, MAIN] > 0.5
    return ["\n".join(text for node, text, _ in p.texts if main[s + node]) for p, s in zip(pages, starts.tolist())]


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    yield from common.chunks(batches, column, BATCH_CHARS)


def train(pages: DataFrame, html_col: str = "html", keys: list[str] | None = None, train_pages: int = TRAIN_PAGES, labelled: DataFrame | None = None) -> Potentials:
    """Potentials from self-labelled pages, about ``train_pages`` rows chosen by a hash of ``keys``, from ``labelled`` pages
    (``html`` with ``data-main`` marks) and from ``seeds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: Counter = Counter()
        for tab in _groups(batches, "html"):
            for source in common.texts_of(tab, "html"):
                counted(Page(source), 1.0, into)
        rows = [(*k, v) for k, v in into.items()]
        yield pa.RecordBatch.from_pydict({name: [r[i] for r in rows] for i, name in enumerate(("kind", "a", "b", "state", "n"))}, schema=pa.schema([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("state", pa.int32()), ("n", pa.float64())]))

    some = pages
    if keys:
        share = max(1, -(-pages.count() // train_pages))
        some = pages.where(F.pmod(F.xxhash64(*keys), F.lit(share)) == 0)
    told = some.select(F.col(html_col).alias("html"))
    if labelled is not None:
        told = told.unionByName(labelled.select("html"))
    counts = told.mapInArrow(run, "kind string, a int, b int, state int, n double").groupBy("kind", "a", "b", "state").agg(F.sum("n").alias("n"))
    into: Counter = Counter()
    for source in seeds():
        counted(Page(source), SEED, into)
    for r in counts.collect():  # bounded by tags, buckets and looks
        into[r.kind, r.a, r.b, r.state] += r.n
    return Potentials(into)


def extract(pages: DataFrame, potentials: Potentials, keys: list[str], html_col: str = "html") -> DataFrame:
    """``keys`` and ``text``, the main text of each page."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    shared = pages.sparkSession.sparkContext.broadcast(potentials)  # fixed size
    (held,), out = common.fresh(pages.select(*keys), "html"), "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _groups(batches, held):
            texts = main_texts(common.texts_of(tab, held), shared.value)
            yield from pa.Table.from_arrays([*[tab.column(k) for k in keys], pa.array(texts, pa.string())], [*keys, out]).to_batches(max_chunksize=5_000)

    return pages.select(*keys, F.col(html_col).alias(held)).mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {out} string")


def op13_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages, keys = common.table(spark, sf_dir, "pages"), ["page_id", "url"]
    return extract(pages, train(pages, keys=keys), keys).withColumn("n_chars", F.length("text").cast("long"))
