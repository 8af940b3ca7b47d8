"""HTML extraction (operator 10): minimum-cut labelling.

A page is cut into blocks of text at block-level tags. Every block gets log-odds of being main text, which become the
capacities to the two terminals:

* what a linear classifier says of its text and place: length, share of links, of letters and digits and of separators, how it ends, its
  tag, whether it comes first or last. The classifier knows nothing of containers. It is fitted, with a ridge that
  pulls to the table ``TEXT``, on blocks that lie inside elements with a meaning of their own (article and main against nav,
  footer, aside, form and the like) of a bounded, documented sample of pages: containers give the labels and are no features;
* what its containers say (``EVIDENCE``): semantic elements much, class, id and role names less. A name counts in full
  only if most of its parts are such words and it stands on a container; on a paragraph, or in a name like ``ad-hoc``, it is a weak hint.

Neighbouring blocks, and following blocks with the same parent, are joined by smoothness edges that weaken with their distance
in the document tree and are strong between neighbours of one kind, and between a heading and what follows it. A maximum flow separates main text from boilerplate: the
cut with the least sum of classifier and smoothness costs. A short line between paragraphs thus stays, a paragraph-like line among
links goes. Blocks whose own capacity exceeds all their edges keep their label in every minimum cut, so they are
settled first; the flow runs on the rest.

Defined results: null html is empty; scripts, styles, comments and the head hold no text; an unclosed script, style or comment
hides the rest of its page; ``<br>`` is white space; a page without main text has the text ``""``; repeated rows
are extracted each; an empty table yields no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE = 1_000
#: Edges: between neighbours, over one more than their distance in the tree; between following children of one parent, of one
#: kind and of several.
SMOOTHNESS, ALIKE, SIBLINGS = 1.0, 2.0, 0.5
#: No block outweighs the page by more.
MOST = 6.0

# Fixed values of HTML.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template svg math iframe object head title textarea canvas audio video".split())
SELF_CLOSING = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}

#: Containers: by tag and by words of class, id and role.
TAGS = {"article": "article", "main": "article", "nav": "menu", "menu": "menu", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "select": "form", "button": "form", "dialog": "notice"}
HINTS = {
    "content": ("content", "article", "post", "entry", "story", "main"),
    "menu": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs"),
    "header": ("header", "masthead", "topbar", "contentinfo"),
    "footer": ("footer", "copyright", "colophon"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "share", "social", "tags", "complementary"),
    "advert": ("ad", "ads", "advert", "advertisement", "adbox", "adsense", "sponsor", "sponsored", "promo", "banner"),
    "notice": ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "gdpr", "disclaimer"),
    "comments": ("comment", "comments", "disqus", "replies", "reply", "respond"),
    "form": ("form", "login", "signup", "search"),
}
#: Parts of names that say nothing themselves.
NEUTRAL = frozenset("site page box wrapper wrap container block area section inner outer left right top bottom global list item items bar primary secondary the id js col row group body text links link large small unit slot".split())
#: Log-odds that a container's kind adds. ``hint``: each of the weak hints.
EVIDENCE = {"article": 2.0, "content": 1.2, "menu": -5.0, "header": -4.0, "footer": -5.0, "aside": -4.5, "advert": -5.0, "notice": -4.5, "comments": -6.0, "form": -5.0, "hint": -1.0}
#: The classifier's log-odds before any fitting, by feature.
TEXT = {"bias": -2.4, "length": 0.7, "links": -4.0, "letters": 1.0, "marks": -4.0, "sentence": 0.8, "heading": 1.2, "paragraph": 1.2, "item": -0.3, "ends": -0.8}
NAMES = list(TEXT)
_FLAGS = {name: 1 << i for i, name in enumerate(EVIDENCE)}
_GOOD = _FLAGS["article"]
#: Families that a name keeps even if it also speaks of content, and those that count in full on a paragraph.
_FIRM = ("menu", "aside", "advert", "comments")
_OWN = ("advert", "comments")
_WORDS = {w: k for k, words in HINTS.items() for w in words}
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption caption address summary".split())
_SECTIONS = {"article": 1, "main": 1, "nav": -1, "menu": -1, "footer": -1, "aside": -1, "form": -1, "fieldset": -1, "dialog": -1, "header": -1}
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: What separates entries of menus and stands in front of notices.
_MARKS = re.compile(r"[|\u00b7\u2022\u00a9\u00ae\u00bb\u00ab\u203a\u2039\u2192]")


def _named(name: str, textual: bool) -> int:
    """What one class, id or role name says."""
    parts = [w for w in _SPLIT.split(name.lower()) if w]
    kinds = {_WORDS[w] for w in parts if w in _WORDS}
    if not kinds:
        return 0
    unknown = sum(w not in _WORDS and w not in NEUTRAL for w in parts)
    firm = len(parts) > 2 * unknown
    if "content" in kinds:
        kinds &= {"content", *_FIRM}
        if len(kinds) > 1:
            kinds.discard("content")
    flags = 0
    for kind in kinds:
        if kind == "content":
            flags |= _FLAGS[kind] if firm and not textual else 0
        else:
            flags |= _FLAGS[kind] if firm and (not textual or kind in _OWN) else _FLAGS["hint"]
    return flags


def _own_flags(tag: str, attributes: str, inherited: int) -> int:
    if tag in ("body", "html"):  # their names describe the whole page
        return 0
    flags = _FLAGS.get(TAGS.get(tag, ""), 0)
    if tag == "header" and not inherited & _GOOD:
        flags |= _FLAGS["header"]
    if attributes:
        for value in _ATTRIBUTE.findall(attributes):
            for name in value.strip("\"'").split():
                flags |= _named(name, tag in _TEXTUAL)
    if tag in ("article", "main"):
        flags &= _GOOD | _FLAGS["content"] | _FLAGS["comments"] | _FLAGS["advert"]
    return flags


#: What a head may hold; the first other tag, or text, ends a head that is not closed.
_HEAD = frozenset("title meta link style script base noscript template".split())


def _head_end(page: str, pos: int) -> int:
    """Where the content of a head that is not closed ends."""
    while True:
        m = _TOKEN.search(page, pos)
        if not m or page[pos : m.start()].strip():
            return pos
        tag = (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        if tag and tag not in _HEAD:
            return m.start()
        pos = m.end()
        if tag in ("title", "style", "script", "noscript", "template") and not closing:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            if stop is None:
                return len(page)
            pos = stop.end()



def blocks(page: str | None) -> list[tuple]:
    """The blocks of a page in order: (text, tag, flags, share of linked characters, path of element numbers, whether semantic
    elements make it main text: 1, 0, -1)."""
    out: list[tuple] = []
    if not page:
        return out
    stack: list[tuple[str, int, int, int]] = []  # tag, number, flags, what its semantic elements say of it
    parts: list[str] = []
    linked = depth_a = number = 0
    pos, n = 0, len(page)

    def close() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                tag, _, flags, _ = stack[-1] if stack else ("", 0, 0, 0)
                out.append((text, tag, flags, min(1.0, linked / max(1, sum(map(len, parts)))), tuple(e[1] for e in stack), stack[-1][3] if stack else 0))
            parts = []
        linked = 0

    while pos < n:
        m = _TOKEN.search(page, pos)
        end = m.start() if m else n
        if end > pos:
            parts.append(page[pos:end])
            if depth_a:
                linked += end - pos
        if not m:
            break
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in HIDDEN:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
                if stop is None and tag == "head":
                    pos = _head_end(page, pos)
                else:
                    pos = stop.end() if stop else n
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            depth_a = 0 if closing else 1
        elif tag in BLOCK:
            close()
            depth_a = 0
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag != "hr":
                if stack and stack[-1][0] == "p":
                    stack.pop()
                while stack and stack[-1][0] in SELF_CLOSING.get(tag, ()):
                    stack.pop()
                number += 1
                inherited, section = stack[-1][2:] if stack else (0, 0)
                section = -1 if section < 0 else section if section > 0 and tag == "header" else _SECTIONS.get(tag, section)
                stack.append((tag, number, inherited | _own_flags(tag, m[3] or m[6], inherited), section))
    close()
    return out


def vectors(page_blocks: list[tuple]) -> np.ndarray:
    """The features of blocks, in the order of ``NAMES``; none comes from a container."""
    x = np.zeros((len(page_blocks), len(NAMES)))
    last = len(page_blocks) - 1
    for i, (row, (text, tag, _, links, _, _)) in enumerate(zip(x, page_blocks)):
        letters = sum(map(str.isalnum, text))
        marks = len(_MARKS.findall(text))
        row[:] = (
            1,
            math.log1p(text.count(" ") + 1),
            links,
            letters / len(text),
            min(1.0, 4 * marks / len(text)),
            text[-1] in ".!?:;\"\u201d\u00bb\u2026\u3002",
            _heading(tag),
            tag == "p",
            tag == "li",
            last > 1 and i in (0, last),
        )
    return x


def evidence(flags: int) -> float:
    """The log-odds that containers add: the strongest of what speaks against main text, else of what speaks for it."""
    have = [v for k, v in EVIDENCE.items() if flags & _FLAGS[k]]
    against = min(have, default=0.0)
    hint = EVIDENCE["hint"]
    return against if against < hint else max(0.0, max(have, default=0.0)) + (hint if against == hint else 0.0)


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, ridge: float = 0.02, steps: int = 400, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on rows that stand for ``times`` rows each; both labels weigh the same, and its ridge pulls to ``TEXT``."""
    prior = np.array(list(TEXT.values()))
    w = prior.copy()
    times = np.ones(len(y)) if times is None else times.astype(float)
    if not len(y) or y.min() == y.max():
        return w
    share = times / np.where(y > 0.5, times[y > 0.5].sum(), times[y < 0.5].sum()) / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (share * (p - y)) + ridge * (w - prior)) / (1 + ridge)
    return w


def odds(page_blocks: list[tuple], weights: np.ndarray) -> list[float]:
    """Each block's log-odds of being main text, from its text and from its containers."""
    held = [evidence(b[2]) for b in page_blocks]
    return np.clip(vectors(page_blocks) @ weights + held, -MOST, MOST).tolist()


def min_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The side of each node in a minimum cut: True where the source (main text) is. ``odds``: capacity to the
    source less that to the sink; ``edges``: symmetric capacities."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    side: list[bool | None] = [None] * n
    rest = list(odds)
    todo = deque(range(n))
    while todo:  # nodes that outweigh their edges are settled
        v = todo.popleft()
        if side[v] is None and abs(rest[v]) > sum(near[v].values()) + 1e-12:
            side[v] = rest[v] > 0
            for u, c in near[v].items():
                del near[u][v]
                rest[u] += c if side[v] else -c
                todo.append(u)
            near[v] = {}
    free = [v for v in range(n) if side[v] is None]
    residual = {v: dict(near[v]) for v in free}
    source = {v: rest[v] for v in free if rest[v] > 0}
    sink = {v: -rest[v] for v in free if rest[v] < 0}
    while True:  # shortest augmenting paths
        parent, queue, target = {v: -1 for v, c in source.items() if c > 1e-12}, deque(v for v, c in source.items() if c > 1e-12), None
        while queue:
            v = queue.popleft()
            if sink.get(v, 0) > 1e-12:
                target = v
                break
            for u, c in residual[v].items():
                if c > 1e-12 and u not in parent:
                    parent[u] = v
                    queue.append(u)
        if target is None:
            break
        path = [target]
        while parent[path[-1]] >= 0:
            path.append(parent[path[-1]])
        flow = min(sink[target], source[path[-1]], *(residual[b][a] for a, b in zip(path, path[1:])))
        sink[target] -= flow
        source[path[-1]] -= flow
        for a, b in zip(path, path[1:]):
            residual[b][a] -= flow
            residual[a][b] += flow
    return [s if s is not None else v in parent for v, s in enumerate(side)]


def _heading(tag: str) -> bool:
    return tag[:1] == "h" and tag[1:].isdigit()


def smoothness(page_blocks: list[tuple]) -> dict[tuple[int, int], float]:
    """Edges between neighbours in the page and between following blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple, int] = {}
    for i, b in enumerate(page_blocks):
        path = b[4]
        if i:
            before = page_blocks[i - 1][4]
            common = 0
            for p, q in zip(before, path):
                if p != q:
                    break
                common += 1
            edges[i - 1, i] = SMOOTHNESS / (1 + len(before) + len(path) - 2 * common)
            if _heading(page_blocks[i - 1][1]) and not _heading(b[1]):
                edges[i - 1, i] += ALIKE
        parent = path[:-1]
        if parent in last:
            j = last[parent]
            a = page_blocks[j]
            firm = ~_FLAGS["hint"]
            edges[j, i] = edges.get((j, i), 0) + (ALIKE if a[1] == b[1] and a[2] & firm == b[2] & firm else SIBLINGS)
        last[parent] = i
    return edges


def labels(page_blocks: list[tuple], weights: np.ndarray) -> list[bool]:
    """Which blocks are main text."""
    return min_cut(odds(page_blocks, weights), smoothness(page_blocks)) if page_blocks else []


def extract(page: str | None, weights: np.ndarray) -> str:
    """The main text of a page."""
    found = blocks(page)
    return "\n".join(b[0] for b, k in zip(found, labels(found, weights)) if k)


def train(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on the weak labels of at most ``sample`` pages, drawn by a hash of their id."""
    ids = pages.select(F.col("page_id").cast("long").alias("page_id")).dropDuplicates().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                for b, x in zip(found, vectors(found)):
                    if b[5]:
                        key = (*(round(float(v), 1) for v in x), float(b[5] > 0))
                        total[key] = total.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in total], pa.list_(pa.float64())), pa.array(list(total.values()), pa.int64())], ["x", "n"])

    # ids of a bounded sample may be broadcast; features are rounded, so what returns is small
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).join(F.broadcast(ids), "page_id").select("html").mapInArrow(work, "x array<double>, n long").groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").collect()
    if not rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    data, times = np.array([r.x for r in rows]), np.array([r.n for r in rows])
    return fit(data[:, :-1], data[:, -1], times)


def extract_all(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [extract(p, weights) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_all(pages, train(pages))
