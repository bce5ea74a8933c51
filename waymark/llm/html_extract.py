"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A logistic classifier, fitted on blocks whose tags or class
names tell what they are, gives each block its log-odds of being content; they become the capacities
of the block's edges from the source and to the sink. Smoothness edges join blocks that follow each
other, the more the nearer they are in the document tree, and blocks with the same parent. The
minimum cut labels all blocks at once.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names of HTML.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Dropped with all they hold, where they close; without an end tag they are ordinary.
SUBTREES = frozenset("svg template audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
BREAKS = frozenset(["hr"])
SPACES = frozenset(["br", "wbr"])
#: A start tag that ends an open element: of which tags, and which elements keep it from looking further up.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
# Fixed words: what tags and class names say about a block.
AWAY_TAGS = frozenset("nav aside footer form menu dialog button select option fieldset search".split())
MAIN_TAGS = frozenset(["article", "main"])
AWAY_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer footnav sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus form search pagination pager masthead topbar skip toolbar copyright".split())
#: Away words of places that hold articles of their own, unless a word of a wrapper stands beside them.
OTHERS_WORDS = frozenset("comment comments commentlist reply replies respond disqus related recommended promo promotion sponsored widget popup modal".split())
WRAPPER_WORDS = frozenset("wrap wrapper has with no page site layout container content".split())
MAIN_WORDS = frozenset("article post entry story content main body text".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
NAMED = re.compile(r"""\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What hides tags (comments, raw text), and the tags of subtrees.
HIDDEN_OR_SUBTREE = re.compile(rf"<!--(?:.*?-->|.*)|<({'|'.join(sorted(RAW))})(?=[\s/>])[^>]*>(?:.*?</\1(?=[\s/>])|.*)|<(/?)({'|'.join(sorted(SUBTREES))})(?=[\s/>])([^>]*)>", re.I | re.S)
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    depth: int
    low: int  # least depth between the block before and this one
    away: bool
    main: bool
    linked: int  # characters in links


@dataclass
class _Open:
    tag: str
    number: int
    away: bool
    main: bool
    kept_away: bool = False  # away by more than a form or a wrapper's class name


@dataclass
class Parser:
    """Tolerant reader of a page into blocks, in one pass over its characters."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0, False, False)])
    counts: dict[str, int] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: bool = False
    low: int = 0
    made: int = 0

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, top.tag, top.number, len(self.stack), self.low, top.away, top.main, self.linked))
                self.low = len(self.stack)
            self.pieces.clear()
            self.linked = 0

    def words(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self.pieces.append(text)
        if self.in_link:
            self.linked += len(text)

    def pop_to(self, at: int) -> None:
        for gone in self.stack[at:]:
            self.counts[gone.tag] -= 1
        del self.stack[at:]
        self.low = min(self.low, at)

    def opened(self, tag: str, attributes: str) -> None:
        self.flush()
        if self.counts.get("p") and self.stack[-1].tag == "p":
            self.pop_to(len(self.stack) - 1)
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].tag in ends:
                    self.pop_to(at)
                    break
                if self.stack[at].tag in stops:
                    break
        top = self.stack[-1]
        away, main, kept_away = top.away, top.main, top.kept_away
        if tag in MAIN_TAGS and away and not main and not kept_away:
            away = False
        names = {w.lower() for value in NAMED.findall(attributes) for w in WORDS.findall(value)} if "=" in attributes else ()
        if tag in ("html", "body", "head"):
            names = ()
        named_header = "header" in names and not main and MAIN_WORDS.isdisjoint(names)
        if tag in AWAY_TAGS or (tag == "header" and not main) or named_header or not AWAY_WORDS.isdisjoint(names):
            away = True
            others = not OTHERS_WORDS.isdisjoint(names) and WRAPPER_WORDS.isdisjoint(names)
            kept_away = kept_away or tag in AWAY_TAGS - {"form"} or tag == "header" or others
        elif tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(names):
            main = True
        self.made += 1
        self.stack.append(_Open(tag, self.made, away, main, kept_away))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def closed(self, tag: str) -> None:
        self.flush()
        if self.counts.get(tag):
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.pop_to(at)

    def feed(self, page: str) -> list[Block]:
        at, quotes = 0, True
        ends: dict[int, int] | None = None
        while True:
            mark = page.find("<", at)
            if mark < 0:
                self.words(page[at:])
                break
            if mark > at:
                self.words(page[at:mark])
            follows = page[mark + 1 : mark + 2]
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 2)
                if end < 0:
                    break
                at = end + 3
                continue
            if follows in ("!", "?") or (follows == "/" and not page[mark + 2 : mark + 3].isalpha()):
                end = page.find(">", mark)
                if end < 0:
                    break
                at = end + 1
                continue
            found = TAG.match(page, mark) if quotes else None
            if found:
                slash, tag, attributes = found.groups()
                at = found.end()
            elif follows.isalpha() and follows.isascii() or follows == "/":
                quotes = False  # a quotation mark without its fellow: from here tags end at the next >
                end = page.find(">", mark)
                if end < 0:
                    break
                slash, _, inner = page[mark + 1 : end].rpartition("/") if follows == "/" else ("", "", page[mark + 1 : end])
                slash = "/" if follows == "/" else ""
                tag, _, attributes = inner.partition(" ")
                attributes, at = " " + attributes, end + 1
            else:
                self.words("<")
                at = mark + 1
                continue
            tag = tag.lower()
            if tag in BLOCK:
                if slash:
                    self.closed(tag)
                else:
                    self.opened(tag, attributes)
            elif tag in RAW:
                if not slash and not attributes.endswith("/"):
                    end = RAW_END[tag].search(page, at)
                    if not end:
                        break
                    at = page.find(">", end.start()) + 1
                    if not at:
                        break
            elif tag in SUBTREES:
                if not slash:
                    ends = subtree_ends(page) if ends is None else ends
                    at = ends.get(mark, at)
            elif tag in SPACES:
                self.words(" ")
            elif tag in BREAKS:
                self.flush()
            elif tag == "a":
                self.in_link = not slash
        self.flush()
        return self.blocks


def subtree_ends(page: str) -> dict[int, int]:
    """Where each element of `SUBTREES` that has an end tag begins, and where it ends; an end tag closes the last open one."""
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for found in HIDDEN_OR_SUBTREE.finditer(page):
        slash, tag, attributes = found.group(2, 3, 4)
        if tag:
            open_tags = waiting.setdefault(tag.lower(), [])
            if not slash:
                if not attributes.endswith("/"):
                    open_tags.append(found.start())
            elif open_tags:
                ends[open_tags.pop()] = found.end()
    return ends


TAGS = {"p": 0, "pre": 1, "blockquote": 1, "li": 2, "option": 3, "h1": 4, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4}
#: What is known of a block (see `features`), and the weights that hold before any page is seen.
PRIOR = np.array([-1.0, 2.0, 1.0, 0.5, -3.0, 1.0, 1.0, -0.5, -3.0, 0.75, 0.0, 0.0, 2.5, -5.0])
#: Bounds of the sample the classifier is fitted on: pages, and blocks of each.
SAMPLE_PAGES, SAMPLE_BLOCKS = 400, 200


def features(blocks: list[Block]) -> np.ndarray:
    """A line for each block: 1, length twice, end of a sentence, share of links, five kinds of tags, place, depth, and what tag and class names say."""
    out = np.zeros((len(blocks), len(PRIOR)))
    for i, block in enumerate(blocks):
        size = len(block.text)
        line = out[i]
        line[:5] = 1.0, min(size / 160, 1.0), min(size / 400, 1.0), block.text[-1] in ".!?:;\"'”»…", min(1.0, block.linked / size)
        if block.tag in TAGS:
            line[5 + TAGS[block.tag]] = 1.0
        line[10:] = i / len(blocks), min(block.depth / 20, 1.0), block.main, block.away
    return out


def fitted(lines: np.ndarray, content: np.ndarray, *, spread: float = 1.0, steps: int = 8) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, drawn to `PRIOR` (a Gaussian of that `spread`).

    Lines whose names say content or away are the labelled ones. Each is used twice, the second time
    without what the names say, so that the weights of the rest serve pages without telling names.
    """
    bare = lines.copy()
    bare[:, -2:] = 0
    x, y = np.concatenate([lines, bare]), np.tile(content.astype(float), 2)
    share = 200 / max(len(x), 200)  # the sample speaks with the weight of 200 lines at most
    weights = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = share * (x.T @ (y - p)) - (weights - PRIOR) / spread**2
        bend = share * ((x * (p * (1 - p))[:, None]).T @ x) + np.eye(len(PRIOR)) / spread**2
        weights = weights + np.linalg.solve(bend, slope)
    return weights


def fit(pages: DataFrame, *, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS) -> np.ndarray:
    """The classifier's weights, from `sample_pages` pages chosen by hash and `sample_blocks` blocks of each, evenly spaced; `PRIOR` without pages."""
    chosen = pages.select(F.col(html_col).alias("html")).where("html IS NOT NULL").orderBy(F.xxhash64("html"), "html").limit(sample_pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page in batch.column(0):
                lines = features(Parser().feed(page.as_py()))
                lines = lines[lines[:, -2] != lines[:, -1]]
                found.append(lines[:: max(1, -(-len(lines) // sample_blocks))].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["lines"])

    raw = b"".join(bytes(r["lines"]) for r in chosen.mapInArrow(read, "lines binary").collect())
    lines = np.frombuffer(raw, dtype="<f4").reshape(-1, len(PRIOR)).astype(float)
    lines = lines[np.lexsort(lines.T)]  # sums in one order, whatever the partitions
    return fitted(lines, lines[:, -2] > lines[:, -1])


#: Weights of the smoothness edges, in log-odds.
FOLLOWING, SAME_PARENT = 1.0, 0.5


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(block, block, capacity): neighbours by their distance in the tree, and neighbours among the blocks of a parent."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            steps = blocks[i - 1].depth + block.depth - 2 * min(block.low, block.depth)
            edges.append((i - 1, i, FOLLOWING * exp(-steps / 2)))
        if block.parent in last and last[block.parent] != i - 1:
            edges.append((last[block.parent], i, SAME_PARENT))
        last[block.parent] = i
    return [(i, j, w) for i, j, w in edges if w > 1e-3]


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of |gain| over blocks labelled against their sign plus the capacities of edges with two labels.

    A block whose gain exceeds the capacities of all its open edges has its sign's label in every
    minimum cut: it is settled, and its edges move into its neighbours' gains. Max-flow does the rest.
    """
    n = len(gains)
    gains, near = list(gains), [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    slack = [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gains[i]) >= slack[i]:
            label[i] = gains[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    slack[j] -= w
                    gains[j] += w if label[i] else -w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        names = {i: k for k, i in enumerate(rest)}
        kept = [(names[i], names[j], w) for i, j, w in edges if i in names and j in names]
        for i, content in zip(rest, max_flow_labels([gains[i] for i in rest], kept), strict=True):
            label[i] = content
    return label


def max_flow_labels(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the source's side after a maximum flow (Dinic's algorithm)."""
    n = len(gains)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(u: int, v: int, forth: float, back: float) -> None:
        head[u].append(len(to))
        to.append(v)
        room.append(forth)
        head[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, gain in enumerate(gains):
        if gain > 0:
            join(source, i, gain, 0.0)
        elif gain < 0:
            join(i, sink, -gain, 0.0)
    for i, j, w in edges:
        join(i, j, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                u = to[path[cut] ^ 1]
                del path[cut:]
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                turn[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1


def labels(blocks: list[Block], weights: np.ndarray = PRIOR) -> list[bool]:
    """Whether each block is content: the minimum cut over the classifier's log-odds and the smoothness edges."""
    return minimum_cut((features(blocks) @ weights).tolist(), smoothness(blocks))


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page in their order, two line ends between them; empty for null."""
    blocks = Parser().feed(page or "")
    return "\n\n".join(b.text for b, content in zip(blocks, labels(blocks, weights), strict=True) if content)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row, from the whole page.

    The classifier is fitted on a bounded sample of these pages (see `fit`) unless its `weights` are
    given. A null or empty page, or one without content, has an empty text. Rows are independent but
    for the fit; other columns of `pages` are not read.
    """
    weights = fit(pages, html_col=html_col) if weights is None else weights
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = narrow.schema
    return narrow.mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars long")
