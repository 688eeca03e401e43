"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier sees a block in two views: its shape
(length, links, punctuation, depth, its neighbours, what its parent element holds) and
its cues (elements, roles and names around it). It learns from pages that mark their
article, with and without the cues, so that it can also judge pages without any. Its
log odds are the terminal capacities. Neighbouring blocks, and more so blocks close in
the document tree, are tied by smoothness edges. The minimum cut separates content
from boilerplate.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import deque
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import field, fresh, per_row

TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH_ENDS = BLOCK - frozenset("body head html td th tr tbody thead tfoot caption option optgroup".split())
#: Open elements that a start tag closes first, up to the element that limits the search.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}
DROPPED = frozenset("head button select option datalist object audio video canvas map".split())
AGAINST_TAGS = frozenset("nav footer aside form menu dialog search".split())
FOR_TAGS = frozenset("article main".split())
AGAINST_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split()
)
#: Words in a class or id that often name boilerplate, and those that often name the article.
AGAINST_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar sidebar sidecol sidenav widget "
    "widgets ad ads advert adverts advertisement sponsor sponsored promo promoted banner cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "recommendations form search pagination pager tags skip toolbar copyright legal toc".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
FOR_NAMES = frozenset("article content main post entry story body text prose markdown".split())
#: Buckets of hashed names.
BUCKETS = 32


@dataclass(frozen=True)
class Around:
    """What the elements around a block tell."""

    landmark: int = 0  # 1 in an article or main element, -1 in navigation, a form and the like, 0 none
    name: int = 0  # 1 named like an article, -1 partly like boilerplate, -2 like boilerplate, 0 neither
    within: bool = False  # in something marked or named as the article
    names: frozenset[int] = frozenset()  # hashed names


@dataclass
class Block:
    """A run of text without a block border in it."""

    text: str
    path: tuple[int, ...]  # ids of the open block elements, outermost first
    around: Around
    linked: int  # characters inside links
    tag: str


@dataclass
class _Open:
    tag: str
    key: int
    around: Around
    drops: bool


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _named(label: str) -> int:
    """-2 or -1: a name is (or holds) a word for boilerplate; 1: one for an article; 0: neither or both in one name."""
    parts = [re.findall(r"[a-z]+", name) for name in label.lower().split()]
    if any(part in COMMENT_NAMES for words in parts for part in words):
        return -2
    if any(len(words) == 1 and words[0] in AGAINST_NAMES for words in parts):
        return -2
    told = [(not AGAINST_NAMES.isdisjoint(words), not FOR_NAMES.isdisjoint(words)) for words in parts]
    return -1 if (True, False) in told else int((False, True) in told)


def _around(tag: str, raw: str, outer: Around) -> Around:
    given = attributes(raw) if raw.strip() else {}
    role, hidden = given.get("role", "").lower(), "hidden" in given or given.get("aria-hidden") == "true"
    label = f"{given.get('class', '')} {given.get('id', '')}".strip()
    landmark, name, within, named = outer.landmark, outer.name, outer.within, _named(label) if label else 0
    if hidden or tag in AGAINST_TAGS or role in AGAINST_ROLES or tag == "header" and not within:
        landmark = -1
    elif (tag in FOR_TAGS or role in ("main", "article")) and landmark >= 0 and name > -2 and named > -2:
        # a comment is often marked up as an article of its own
        landmark, name, within, named = 1, 0, True, 0
    if named < 0:
        name = min(named, name)
    elif named > 0 and name > -2 and landmark >= 0:
        name, within = 1, True
    names = outer.names
    if label or tag not in ("div", "p"):
        words = [tag, *label.lower().split()]
        names = names | {zlib.crc32(w.encode()) % BUCKETS for w in words}
    return Around(landmark, name, within, names)


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in page order, with character references decoded and white space folded."""
    page = page or ""
    found: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = in_link = keys = at = 0

    def around() -> Around:
        return stack[-1].around if stack else Around()

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text and not (stack and stack[-1].drops):
            path = tuple(o.key for o in stack)
            found.append(Block(text, path, around(), min(linked, len(text)), stack[-1].tag if stack else ""))
        linked = 0

    def close(tags, limits=()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in limits:
                return

    while at < len(page):
        match = TAG.search(page, at)
        piece = page[at : match.start() if match else len(page)]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not match:
            break
        at = match.end()
        ending, tag, raw = match.group(1), (match.group(2) or "").lower(), match.group(3) or ""
        if not tag:
            continue
        if tag in RAW and not ending:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            in_link = 0 if ending else 1
        if tag not in BLOCK and tag not in DROPPED:
            continue
        flush()
        if ending:
            if tag == "p" and not any(o.tag == "p" for o in stack):
                continue
            close((tag,))
            continue
        if tag in PARAGRAPH_ENDS:
            close(("p",), ("td", "th", "table", "body", "html", "button"))
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in VOID:
            continue
        keys += 1
        drops = tag in DROPPED or bool(stack and stack[-1].drops)
        stack.append(_Open(tag, keys, _around(tag, raw, around()), drops))
    flush()
    return found


#: Weights before anything is learned: shape, then cues, then hashed names.
PLAIN_SHAPE = np.array([-3.0, 0.7, -4.0, 0.3, 0.5, 0.6, 0.05, 0.05, 0.0, 0.1, -1.0, 1.0, 0.0])
PLAIN_CUES = np.array([5.0, -8.0, 3.0, -3.0, -9.0, -4.0])
PLAIN = np.concatenate([PLAIN_SHAPE, PLAIN_CUES, np.zeros(BUCKETS)])
SHAPE = len(PLAIN_SHAPE)


def features(found: list[Block]) -> np.ndarray:
    """One row a block: ``SHAPE`` columns of its shape, then its cues."""
    n = len(found)
    if not n:
        return np.zeros((0, len(PLAIN)))
    size = np.array([len(b.text) for b in found], dtype=float)
    linked = np.array([b.linked for b in found], dtype=float)
    own = np.array(
        [
            (
                b.text.count(" ") / 20 if len(b.text) < 400 else 3.0,
                sum(map(b.text.count, ".,;:!?")) / (1 + b.text.count(" ")),
                float(b.text[-1] in ".!?:;\"'”»"),
                min(len(b.path), 12) / 4,
            )
            for b in found
        ]
    )
    # what the parent element holds
    parents: dict[int, int] = {}
    group = np.array([parents.setdefault(_parent(b), len(parents)) for b in found])
    held, links = np.bincount(group, size), np.bincount(group, linked)
    around = np.pad(np.log1p(size), 1)
    shape = [np.ones(n), np.log1p(size), linked / size, *own[:, :3].T, around[:-2], around[2:], own[:, 3]]
    shape += [np.log1p(held[group]) / 2, links[group] / held[group], held[group] / size.sum(), np.arange(n) / n]

    told = any(b.around.within for b in found)
    cues = np.array(
        [
            (
                b.around.landmark > 0,
                b.around.landmark < 0,
                b.around.within and b.around.landmark == 0,
                b.around.name == -1,
                b.around.name == -2,
                told and not b.around.within,
            )
            for b in found
        ],
        dtype=float,
    )
    names = np.zeros((n, BUCKETS))
    for i, b in enumerate(found):
        names[i, list(b.around.names)] = 1.0
    return np.hstack([np.stack(shape, axis=1), cues, names])


def _parent(block: Block) -> int:
    return block.path[-2] if len(block.path) > 1 else 0


def marked(found: list[Block]) -> np.ndarray:
    """Weak labels by elements alone, on a page that marks its article: 1 inside, -1 outside, 0 unknown."""
    if not any(b.around.landmark > 0 for b in found):
        return np.zeros(len(found), dtype=int)
    return np.array([(0 if b.around.name < 0 else 1) if b.around.landmark > 0 else -1 for b in found])


def fit_weights(pages: list[list[Block]], rounds: int = 50, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression, drawn towards ``PLAIN``, on the blocks of pages that mark their article.

    Every block is seen with its cues and without them; equal class weights.
    """
    x = [features(p) for p in pages]
    y = [marked(p) for p in pages]
    x, y = (np.concatenate(a) if a else np.zeros(0) for a in (x, y))
    told = y != 0
    x, y = x[told], y[told] > 0
    if len(y) == 0 or y.all() or not y.any():
        return PLAIN
    bare = x.copy()
    bare[:, SHAPE:] = 0
    x, y = np.vstack([x, bare]), np.concatenate([y, y])
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = PLAIN.copy()
    for _ in range(rounds):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) / len(y) + ridge * (w - PLAIN)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Network:
    """A flow network for shortest augmenting paths."""

    n: int
    to: list[int] = dataclass_field(default_factory=list)
    room: list[float] = dataclass_field(default_factory=list)
    edges: list[list[int]] = dataclass_field(init=False)

    def __post_init__(self):
        self.edges = [[] for _ in range(self.n)]

    def add(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def source_side(self, s: int, t: int) -> list[bool]:
        """Nodes that stay with ``s`` in a minimum cut (Dinic: level graphs, blocking flows)."""
        while True:
            level = [-1] * self.n
            level[s] = 0
            queue = deque([s])
            while queue:
                x = queue.popleft()
                for e in self.edges[x]:
                    if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if level[t] < 0:
                return [v >= 0 for v in level]
            following = [0] * self.n
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    del path[cut:]
                    x = self.to[path[-1]] if path else s
                    continue
                while following[x] < len(self.edges[x]):
                    e = self.edges[x][following[x]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        break
                    following[x] += 1
                if following[x] < len(self.edges[x]):
                    e = self.edges[x][following[x]]
                    path.append(e)
                    x = self.to[e]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    following[x] += 1
                else:
                    break


SMOOTH, TREE = 0.5, 1.5
#: The shape alone speaks for or against a block by no more than this.
SHAPE_ODDS = 3.0


def prices(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """Log odds that a block is content."""
    x = features(found)
    return np.clip(x[:, :SHAPE] @ weights[:SHAPE], -SHAPE_ODDS, SHAPE_ODDS) + x[:, SHAPE:] @ weights[SHAPE:]


def labels(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    if not found:
        return []
    n = len(found)
    net = Network(n + 2)
    for i, price in enumerate(prices(found, weights).tolist()):
        if price > 0:
            net.add(n, i, price)
        else:
            net.add(i, n + 1, -price)
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            shared = sum(1 for x, y in zip(b.path, found[i - 1].path) if x == y)
            near = shared / max(len(b.path), len(found[i - 1].path), 1)
            net.add(i - 1, i, SMOOTH * near, SMOOTH * near)
        parent = _parent(b)
        if parent in last:
            tie = TREE if b.tag == found[last[parent]].tag else TREE / 3
            net.add(last[parent], i, tie, tie)
        last[parent] = i
    return net.source_side(n, n + 1)[:n]


def main_text(page: str | None, weights: np.ndarray = PLAIN) -> str:
    """Content blocks in page order, joined by a line feed."""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, labels(found, weights)) if keep)


def fit(
    pages: DataFrame, page_id: str = "page_id", source: str = "html", rows: int = 300, row_chars: int = 200_000
) -> np.ndarray:
    """Weights from at most ``rows`` pages of up to ``row_chars`` characters, in the order of a hash of the id."""
    few = pages.filter(F.length(field(source)) <= row_chars)
    few = few.select(field(source).alias("h"), F.xxhash64(field(page_id), field(source)).alias("o"))
    # hashes first: tasks send numbers to the driver, and then only the chosen pages
    last = few.select("o").orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    chosen = few.filter(F.col("o") <= last).orderBy("o").limit(rows) if last is not None else few.limit(0)
    return fit_weights([blocks(r.h) for r in chosen.collect()])


def extract(df: DataFrame, weights: np.ndarray, source: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of every whole page; empty for a null or empty page.

    Character references are decoded, white space within a block becomes one space,
    blocks are joined by one line feed. Repeated rows stay; other columns pass
    through, and one named like the result is replaced.
    """
    made = fresh(df, "made")

    def make():
        return lambda pages: pd.DataFrame({"t": [main_text(p, weights) for p in pages]}, columns=["t"])

    keep = [field(c) for c in df.columns if c != text]
    return df.withColumn(made, per_row(make, "t string", field(source))).select(*keep, field(made)["t"].alias(text))
