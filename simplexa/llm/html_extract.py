"""Main text of web pages by minimum cut.

The page is cut into blocks: runs of text between block-level tags.  A block's cost of
being called boilerplate or content is the sum of two log odds: what the names, classes
and roles of the elements around it say, which is bounded, and what a classifier of its
own features says (share of link text, length, punctuation, kind of element, place in the
page, links next to it).  These costs are the capacities from the source and to the sink.
Neighbours in the page are tied by an edge, stronger for the same parent and weaker with
distance in the DOM.  The side of the source after a maximum flow is the content.  Where
elements are named plainly they decide; where they are not, the features and the cut do.

The classifier is a logistic regression, fitted on blocks that their surroundings label
plainly: at most ``fit_blocks`` blocks of the ``fit_pages`` pages of the smallest hash of
their id.  Without enough of both kinds built-in weights are used.

Cases: a null or empty page, and a page without content, give an empty text; unclosed
and stray tags are tolerated; texts of any length are read whole; repeated rows give
repeated results; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>(?:"[^"]*"|'[^']*'|[^"'>])*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.DOTALL)
#: One attribute with its value, so that nothing inside a value is taken for a name.
ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
NAMING = {"class", "id", "role"}
#: Elements that are text themselves: of a name of several parts only the last tells what they are.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th"}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is not markup (fixed by the HTML standard).
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Of these, and further ones, nothing is ever shown as running text.
SILENT = {"script", "style", "textarea", "title", "head", "iframe", "noembed", "noframes", "template", "svg", "math", "object", "select", "button", "datalist", "canvas", "audio", "video", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: A start tag that ends an open one of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"article", "aside", "body", "div", "dl", "footer", "form", "header", "html", "main", "menu", "nav", "ol", "section", "table", "td", "th", "ul"}

#: Weights of element names, of class, id and role words, and of a block's own features.
ELEMENT_WEIGHT = {"article": 6.0, "main": 4.0, "nav": -12.0, "aside": -12.0, "footer": -12.0, "form": -12.0, "menu": -12.0, "dialog": -8.0, "header": -4.0, "address": -2.0, "p": 1.0, "h1": 1.0, "h2": 0.5, "h3": 0.5, "blockquote": 0.5, "pre": 0.5}
NAME_WEIGHT = dict.fromkeys(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation navlinks breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert modal popup overlay newsletter subscribe signup login share sharing social related recommended widget comment comments reply replies disqus toolbar pager pagination copyright legal disclaimer search complementary contentinfo skip".split(),
    -12.0,
) | dict.fromkeys("content article post entry story body main text prose".split(), 2.0)
#: What the surroundings may say at most, and what counts as plain.
BOUND, PLAIN = 6.0, 4.0
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Which of ``features`` tell the kind of element.
KINDS = slice(5, 8)
#: Weights of ``features`` where none can be fitted.
DEFAULT = (-0.5, -4.0, 0.6, 0.5, 0.3, 0.8, -0.4, 0.3, 0.0, 0.0, -0.8)


class Block:
    __slots__ = ("links", "parent", "parts", "steps", "tag", "text", "weight")

    def __init__(self, tag: str, parent: int, steps: int, weight: float):
        self.parts: list[str] = []
        #: innermost block element, the number of the one around it, and how many block elements lie between this block and the one before
        self.tag, self.parent, self.steps = tag, parent, steps
        self.links, self.weight, self.text = 0, weight, ""


def _own_weight(tag: str, attrs: str, inside: bool) -> tuple[float, bool]:
    """Weight that an element lends to all within it, and whether it hides them."""
    w = ELEMENT_WEIGHT.get(tag, 0.0)
    if tag == "header" and inside:
        w = 0.0  # the heading of an article
    hidden = False
    if attrs and ("=" in attrs or "hidden" in attrs.lower()):
        low = 0.0
        for key, *values in ATTR.findall(attrs):
            value = next((v for v in values if v), "")
            key = key.lower()
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
            if key not in NAMING:
                continue
            for token in value.split():
                parts = NAME_PART.findall(token)
                if parts and (tag in TEXTUAL or parts[-1].lower() == "article"):
                    parts = parts[-1:]
                for part in parts:
                    x = NAME_WEIGHT.get(part.lower(), 0.0)
                    low = min(low, x) if x < 0 else low
                    w += x if x > 0 and tag in ("div", "section", "main") else 0.0
        w += low
    return w, hidden


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    out: list[Block] = []
    # name, weight so far, silent, and of the innermost block element: name, number, the number of the one around it, depth
    stack: list[tuple[str, float, bool, str, int, int, int]] = [("", 0.0, False, "", 0, 0, 0)]
    opened: Counter[str] = Counter()
    current: Block | None = None
    serial = 0
    last = low = 0  # block depth of the last text, and the least since
    at, size = 0, len(page)

    def text(piece: str) -> None:
        nonlocal current, last, low
        top = stack[-1]
        if top[2] or not piece:
            return
        if current is None:
            if piece.isspace():
                return
            depth = top[6]
            low = min(low, depth)
            current = Block(top[3], top[5], last + depth - 2 * low, top[1])
            last = low = depth
            out.append(current)
        piece = html.unescape(piece) if "&" in piece else piece
        current.parts.append(piece)
        if opened["a"]:
            current.links += len(piece)

    def pop_to(i: int) -> None:
        nonlocal low
        for entry in stack[i:]:
            opened[entry[0]] -= 1
        del stack[i:]
        low = min(low, stack[-1][6])

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCK:
            current = None
        elif tag in ("br", "img", "wbr") and tag != "wbr":
            text(" ")
        if closing:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and (opened["p"] or any(opened[t] for t in CLOSES.get(tag, ()))):  # a paragraph ends where another block begins
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in CLOSES.get(tag, ()):
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE and stack[i][0] not in CLOSES.get(tag, ()):
                    break
        weight, hidden = _own_weight(tag, attrs, opened["article"] > 0)
        serial += 1
        _, so_far, silent, name, number, around, depth = stack[-1]
        inner = (tag, serial, number, depth + 1) if tag in BLOCK else (name, number, around, depth)
        stack.append((tag, so_far + weight, silent or hidden or tag in SILENT, *inner))
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stop = end.start() if end else size
            at = stop
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def features(found: list[Block]) -> np.ndarray:
    """One row a block: a constant and what the block itself shows."""
    n = len(found)
    chars = np.array([len(b.text) for b in found], float)
    density = np.minimum(1.0, np.array([b.links for b in found]) / np.maximum(chars, 1))
    stops = np.array([sum(b.text.count(c) for c in ".!?。") for b in found], float)
    padded = np.concatenate(([0.0], density, [0.0]))
    place = (np.arange(n) + 0.5) / n
    kind = lambda names: np.array([b.tag in names for b in found], float)
    rows = (
        np.ones(n), density, np.log1p(chars) - 3.5, [b.text[-1] in ".!?:;\"'”»。" for b in found], np.minimum(stops, 5.0),
        kind({"p", "pre", "blockquote"}), kind({"li", "td", "option"}), kind(HEADINGS), place < 0.1, place > 0.9, (padded[:-2] + padded[2:]) / 2,
    )
    return np.array(rows, float).T


def costs(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """Log odds of content: bounded ones of the surroundings, and those of the features."""
    own = np.clip(features(found) @ weights, -BOUND / 2, BOUND / 2)
    return np.clip([b.weight for b in found], -BOUND, BOUND) + own


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, both kinds of equal weight."""
    if min((y == 0).sum(), (y == 1).sum()) < 20:
        return np.array(DEFAULT)
    # every row once more as if its element told nothing, for pages all of whose elements are alike
    bare = x.copy()
    bare[:, KINDS] = 0
    x, y = np.concatenate((x, bare)), np.concatenate((y, y))
    each = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (each * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Flow:
    """Maximum flow by shortest augmenting levels (Dinic)."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[float] = []
        self.adj: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        self.adj[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(forth)
        self.adj[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.adj)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in self.adj[v]:
                if self.cap[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    queue.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> list[bool]:
        """Saturate; tells which nodes stay on the source's side."""
        while True:
            level = self.levels(s)
            if level[t] < 0:
                return [x >= 0 for x in level]
            where = [0] * len(self.adj)
            path: list[int] = []
            v = s
            while True:
                if v == t:
                    least = min(self.cap[e] for e in path)
                    cut = None
                    for i, e in enumerate(path):
                        self.cap[e] -= least
                        self.cap[e ^ 1] += least
                        if cut is None and self.cap[e] <= 1e-12:
                            cut = i
                    del path[cut:]
                    v = self.to[path[-1]] if path else s
                elif where[v] < len(self.adj[v]):
                    e = self.adj[v][where[v]]
                    if self.cap[e] > 1e-12 and level[self.to[e]] == level[v] + 1:
                        path.append(e)
                        v = self.to[e]
                    else:
                        where[v] += 1
                elif path:
                    e = path.pop()
                    v = self.to[e ^ 1]
                    where[v] += 1
                else:
                    break


def label(found: list[Block], weights: np.ndarray, adjacency: float = 0.4, proximity: float = 0.8) -> list[bool]:
    """Which blocks are content: the source's side of a minimum cut."""
    n = len(found)
    if not n:
        return []
    value = costs(found, weights).tolist()
    if all(c > 0 for c in value) or all(c <= 0 for c in value):
        return [c > 0 for c in value]
    flow = Flow(n + 2)
    last: dict[int, int] = {}
    for i, (b, c) in enumerate(zip(found, value, strict=True)):
        flow.edge(n, i, max(c, 0.0))
        flow.edge(i, n + 1, max(-c, 0.0))
        if i:
            w = adjacency + proximity * 0.5 ** max(0, b.steps - 2)
            flow.edge(i - 1, i, w, w)
        if b.parent in last and last[b.parent] != i - 1:
            flow.edge(last[b.parent], i, proximity / 2, proximity / 2)
        last[b.parent] = i
    return flow.run(n, n + 1)[:n]


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    if not page:
        return ""
    found = blocks(page)
    keep = label(found, np.array(DEFAULT) if weights is None else weights)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def fit(pages: DataFrame, *, fit_pages: int = 400, fit_blocks: int = 20_000) -> np.ndarray:
    """Weights of ``features`` from blocks that their surroundings label plainly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = [], []
            for page in b.column(0).to_pylist():
                found = blocks(page)
                if found:
                    plain = [i for i, v in enumerate(found) if abs(v.weight) >= PLAIN]
                    x += features(found)[plain].tolist()
                    y += [int(found[i].weight > 0) for i in plain]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int64())], ["x", "y"])

    sample = pages.where("html is not null").orderBy(F.xxhash64("page_id", "html"), "page_id").limit(fit_pages).select("html")
    rows = sample.mapInArrow(run, "x array<double>, y long").limit(fit_blocks).collect()
    return fit_weights(np.array([r.x for r in rows]).reshape(len(rows), len(DEFAULT)), np.array([r.y for r in rows]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points of every page."""
    small_batches(pages.sparkSession)
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    weights = fit(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, weights) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return whole.mapInArrow(run, SCHEMA)
