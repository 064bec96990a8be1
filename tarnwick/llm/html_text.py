"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks at its block-level tags. A logistic classifier over a block's
length, links, tags, place and surroundings gives the cost of calling it content and of
calling it boilerplate. They become the capacities from and to the terminals of a flow
network; blocks that follow one another, and blocks next to each other in the same
container, are joined by edges whose capacity falls with their distance in the tree. The
maximum flow's cut separates content from boilerplate at least cost, so a short paragraph
among long ones stays and a lone sentence in a list of links goes.

The classifier is fitted to the pages themselves: TRAIN_PAGES of them at most, chosen by
hash, with TRAIN_BLOCKS blocks each at most, where those with an article or main element
say which blocks lie in it. It learns from each page as it is, without its class, id and
role attributes, and without its telling tags either, so that it can do without them. The
element article or main itself is no feature but evidence of fixed weight. PRIOR holds the
weights that the fit starts from and is drawn to; it alone serves pages without a table.

A block whose terminal outweighs all of its edges lies on that terminal's side in some
minimum cut. Such blocks are settled first, one after another, and the flow is found for
what is left, part by part; the result is a minimum cut of the whole network.

Defined cases: null and empty pages, and pages without content, have the empty text.
Unclosed tags end with their container; what is left open ends with the page. Scripts,
styles, templates and comments of the markup are no blocks, nor is the head. Rows are
handled one by one, no length is cut, and the time to read a page is in proportion to its
length. Columns of the input other than those named are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pieces

TRAIN_PAGES, TRAIN_BLOCKS = 500, 200
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_STRICT = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
#: Tags without an end outside quotes that a page may have before quotes are no longer heeded.
STRICT_TRIES = 32
_NAMED = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
SILENT = set("script style noscript template svg math head title iframe object canvas audio video textarea select option datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold page furniture, and those that hold the article.
FURNITURE = set("nav header footer aside form menu dialog button fieldset".split())
ARTICLE = set("article main".split())
#: Words in class, id and role that speak for furniture, and for the article.
AWAY = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar side aside menu nav navigation navbar breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments reply replies respond disqus discussion widget pagination pager tags copyright legal disclaimer search form contentinfo complementary".split())
TOWARD = set("article articlebody main content entry post story text body prose".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: Elements whose own text is a part of what surrounds them, and which of them are headings and paragraphs.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary address".split())
HEADINGS, PARAGRAPHS = set("h1 h2 h3 h4 h5 h6".split()), set("p blockquote pre".split())
_RIGHTS = re.compile(r"^\W*(?:\(c\)|copyright\b)|\u00A9|all rights reserved", re.I)

FEATURES = ["bias", "length", "sentence", "linked", "paragraph", "heading", "item", "share", "paragraphs", "headed", "around_linked", "place", "repeated", "rights", "outside", "furniture", "away"]
#: Those that come from attributes, and from attributes or telling tags.
MARKED, TELLING = ["away"], ["furniture", "away"]
PRIOR = dict(zip(FEATURES, [-1.5, 1.0, 0.8, -4.0, 0.8, 0.3, -0.3, 2.0, 0.5, 0.7, -3.0, 0.0, -0.5, -3.0, -0.7, -5.0, -6.0]))
#: Evidence of an article or main element, and of words in attributes that speak for one.
ARTICLE_WEIGHT, TOWARD_WEIGHT = 4.0, 2.0


@dataclass
class Block:
    """A block, its container's number, the number of the group that surrounds it, and the steps of the tree from the block before."""

    tag: str
    box: int
    group: int
    steps: int
    furniture: bool
    away: bool
    article: bool
    toward: bool
    text: str = ""
    parts: list[str] = field(default_factory=list)
    linked: int = 0


@dataclass
class _Open:
    """An open element with what holds for all within it."""

    name: str
    number: int
    furniture: bool = False
    away: bool = False
    article: bool = False
    toward: bool = False


def _opened(name: str, number: int, attributes: str, within: _Open) -> _Open:
    words = {w for _, v in _NAMED.findall(attributes) for w in _WORD.findall(v.lower())} if "=" in attributes else set()
    away = bool(words & AWAY) or "hidden" in attributes.lower().split()
    toward = bool(words & TOWARD) and not words & AWAY
    return _Open(name, number, within.furniture or name in FURNITURE, within.away or away, within.article or name in ARTICLE, within.toward or toward)


class _Stack:
    """Open elements. Each step takes constant time, but for the elements that it closes."""

    def __init__(self):
        self.all, self.solid, self.by_name, self.links = [_Open("", 0)], [0], {}, 0  # solid: places of elements that are not inline

    def push(self, element: _Open) -> None:
        self.by_name.setdefault(element.name, []).append(len(self.all))
        if element.name not in INLINE:
            self.solid.append(len(self.all))
        self.links += element.name == "a"
        self.all.append(element)

    def cut(self, place: int) -> None:
        while len(self.all) > place:
            gone = self.all.pop()
            if gone.name:
                self.by_name[gone.name].pop()
            if self.solid[-1] == len(self.all):
                self.solid.pop()
            self.links -= gone.name == "a"

    def close(self, name: str) -> None:
        places = self.by_name.get(name)
        if not places:
            return
        place = places[-1]
        if name in INLINE and self.solid[-1] > place:  # it ends within other elements, which stay open
            places.pop()
            self.links -= name == "a"
            self.all[place] = _Open("", 0)
        else:
            self.cut(place)


def tags(page: str):
    """Start, end, whether it closes, name and attributes of each tag; comments and declarations have no name."""
    at, last, tries = 0, page.rfind(">"), STRICT_TRIES
    while (at := page.find("<", at)) >= 0:
        found = None
        if page[at + 1 : at + 2] in ("!", "?"):
            found = _COMMENT.match(page, at)
            yield at, found.end(), False, "", ""
        elif at < last:
            found = _STRICT.match(page, at) if tries else None
            if found is None and (loose := _LOOSE.match(page, at)):
                found, tries = loose, max(0, tries - 1)
            if found:
                yield at, found.end(), bool(found[1]), found[2].lower(), found[3]
        at = found.end() if found else at + 1


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    stack, found = _Stack(), []
    open_block: Block | None = None
    number, at, silent, least, depth = 0, 0, "", 1, 1  # least: the shallowest place since the block before, whose depth is depth

    def take(run: str) -> None:
        nonlocal open_block, least, depth
        if not run or silent:
            return
        if open_block is None:
            if run.isspace():
                return
            own, solid = stack.all[stack.solid[-1]], stack.solid
            inner = stack.all[-1] if stack.all[-1].name else own
            group = stack.all[solid[-2]].number if own.name in TEXTUAL and len(solid) > 1 else own.number
            box = stack.all[solid[-2]].number if len(solid) > 1 else own.number
            open_block = Block(own.name, box, group, depth + len(solid) - 2 * least, inner.furniture, inner.away, inner.article, inner.toward)
            least = depth = len(solid)
            found.append(open_block)
        run = html.unescape(run) if "&" in run else run
        open_block.parts.append(run)
        if stack.links:
            open_block.linked += len(run)

    for start, end, closing, name, attributes in tags(page):
        if start < at:
            continue
        take(page[at:start])
        at = end
        if not name:
            continue
        if silent:
            if closing and name == silent:
                silent = ""
            continue
        if name in SILENT and not closing:
            if name in ("script", "style", "title", "textarea"):  # raw text: only its own end tag ends it
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            elif not attributes.endswith("/"):
                silent = name
            if name not in INLINE:
                open_block = None
            continue
        if name not in INLINE:
            open_block = None
        elif name == "br":
            take(" " if open_block else "")
        if name in VOID:
            continue
        if closing:
            stack.close(name)
        else:
            solid = stack.all[stack.solid[-1]]
            if name in _ENDS_P and solid.name == "p":
                stack.cut(stack.solid[-1])
            elif name in _CLOSED_BY and stack.all[-1].name in _CLOSED_BY[name]:
                stack.cut(len(stack.all) - 1)
            if not attributes.endswith("/"):
                number += 1
                within = stack.all[-1] if stack.all[-1].name else stack.all[stack.solid[-1]]
                stack.push(_opened(name, number, attributes, within))
        least = min(least, len(stack.solid))
    take(page[at:])
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    # a block of white space alone is none, but its steps belong to the next
    kept, steps = [], 0
    for b in found:
        b.steps, steps = b.steps + steps, 0 if b.text else b.steps + steps
        if b.text:
            kept.append(b)
    return kept


def features(found: list[Block]) -> np.ndarray:
    """A row for each block; columns as in FEATURES."""
    n, same = len(found), Counter(b.text for b in found)
    sizes = np.array([len(b.text) for b in found], float)
    linked = np.array([min(b.linked, len(b.text)) for b in found], float)
    _, groups = np.unique([b.group for b in found], return_inverse=True)
    flag = lambda of: np.array([of(b) for b in found], float)
    paragraph, heading = flag(lambda b: b.tag in PARAGRAPHS), flag(lambda b: b.tag in HEADINGS)
    around = lambda x: np.bincount(groups, x)[groups]
    total = max(1.0, sizes.sum())
    headings = heading.cumsum()
    columns = [
        np.ones(n), np.log1p(sizes) / 4, flag(lambda b: b.text.endswith((".", "!", "?", ":", '"', "…"))), linked / np.maximum(1, sizes), paragraph, heading, flag(lambda b: b.tag in ("li", "dt", "dd", "td", "th")),
        around(sizes) / total, np.minimum(3, np.log1p(around(paragraph))), (around(heading) > 0).astype(float), around(linked) / np.maximum(1, around(sizes)), (sizes.cumsum() - sizes / 2) / total,
        flag(lambda b: same[b.text] > 1 and len(b.text) < 80), flag(lambda b: bool(_RIGHTS.search(b.text[:400]))), ((headings == 0) & (headings[-1] > 0)).astype(float), flag(lambda b: b.furniture), flag(lambda b: b.away),
    ]
    return np.stack(columns, axis=1)


def costs(found: list[Block], weights: dict[str, float] = PRIOR) -> tuple[list[float], list[float]]:
    """What it costs to call each block boilerplate, and to call it content, from the classifier."""
    marks = np.array([ARTICLE_WEIGHT * b.article + TOWARD_WEIGHT * b.toward for b in found])
    score = np.clip(features(found) @ np.array([weights[f] for f in FEATURES]) + marks, -20, 20)
    return np.logaddexp(0, score).tolist(), np.logaddexp(0, -score).tolist()


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the source's side of a minimum cut (shortest augmenting paths by levels)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)

    for i in range(n):
        join(s, i, source[i], 0.0)
        join(i, t, sink[i], 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        while True:  # one path after another along the levels, without recursion
            path, x = [], s
            while x != t:
                while turn[x] < len(out[x]):
                    e = out[x][turn[x]]
                    if room[e] > 1e-12 and level[to[e]] == level[x] + 1:
                        break
                    turn[x] += 1
                if turn[x] < len(out[x]):
                    path.append(e)
                    x = to[e]
                elif path:
                    x = to[path.pop() ^ 1]
                    turn[x] += 1
                else:
                    break
            if x != t:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow


def label(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """min_cut(), after settling the nodes whose terminal outweighs their edges."""
    n = len(source)
    pull, near = [a - b for a, b in zip(source, sink)], [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    ties, side = [sum(c for _, c in own) for own in near], [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None or abs(pull[i]) < ties[i]:
            continue
        side[i] = pull[i] > 0
        for j, c in near[i]:
            if side[j] is None:
                pull[j] += c if side[i] else -c
                ties[j] -= c
                todo.append(j)
    for first in range(n):
        if side[first] is not None:
            continue
        part, place = [first], {first: 0}
        for i in part:
            for j, _ in near[i]:
                if side[j] is None and j not in place:
                    place[j] = len(part)
                    part.append(j)
        inner = [(place[i], place[j], c) for i in part for j, c in near[i] if j in place and place[i] < place[j]]
        for i, kept in zip(part, min_cut([max(0.0, pull[i]) for i in part], [max(0.0, -pull[i]) for i in part], inner)):
            side[i] = kept
    return side


def joined(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks: twice a half for each step of the tree between neighbours, and between those next in one container."""
    edges, last = [], {}
    for k, b in enumerate(found):
        if k:
            edges.append((k - 1, k, 2 * 0.5 ** min(b.steps, 60)))
        if last.get(b.box, k) < k - 1:
            edges.append((last[b.box], k, 0.5))
        last[b.box] = k
    return edges


def extract(page: str | None, weights: dict[str, float] = PRIOR) -> str:
    """The main text: content blocks in page order, joined by one space."""
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, kept in zip(found, label(*costs(found, weights), joined(found))) if kept)


def fitted(x: np.ndarray, y: np.ndarray, pull: float = 20.0) -> dict[str, float]:
    """Logistic weights of least loss and squared distance from PRIOR, by Newton's steps."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull * np.eye(len(w)), slope)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(FEATURES, w.tolist()))


def training(page: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page that marks its article: as it is, without attributes' signs, and without any."""
    found = blocks(page or "")
    marked = np.array([b.article and not b.furniture and not b.away for b in found], float)
    if not marked.any():
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x = features(found)
    at = np.linspace(0, len(found) - 1, min(len(found), TRAIN_BLOCKS)).astype(int)  # evenly over a long page
    copies = [x[at], x[at], x[at]]
    for k, names in enumerate((MARKED, TELLING), 1):
        copies[k] = copies[k].copy()
        copies[k][:, [FEATURES.index(f) for f in names]] = 0
    return np.concatenate(copies), np.tile(marked[at], 3)


def fit(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", n_pages: int = TRAIN_PAGES) -> dict[str, float]:
    """The classifier's weights from at most n_pages pages, those with the least hashes; PRIOR where none marks its article."""
    rows = pages.select(F.xxhash64(F.col(id_col).cast("string"), F.col(url_col), F.col(html_col)).alias("hash"), F.col(html_col).alias("html"))
    least = rows.select("hash").orderBy("hash").limit(n_pages).agg(F.max("hash")).first()[0]
    if least is None:
        return dict(PRIOR)

    def run(batches):
        for batch in batches:
            for _, found in pieces(batch, "html"):
                for x, y in map(training, found):
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([y.astype("<f8").tobytes()], pa.binary())], ["x", "y"])

    sample = rows.filter(F.col("hash") <= least).orderBy("hash").limit(n_pages).select("html").mapInArrow(run, "x binary, y binary").collect()  # n_pages * TRAIN_BLOCKS blocks
    parts = sorted((bytes(r["x"]), bytes(r["y"])) for r in sample)
    x = np.concatenate([np.frombuffer(a, "<f8") for a, _ in parts]).reshape(-1, len(FEATURES))
    return fitted(x, np.concatenate([np.frombuffer(b, "<f8") for _, b in parts]))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row; weights are fitted to pages if they are not given."""
    weights = fit(pages, id_col, url_col, html_col) if weights is None else weights
    rows = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")

    def run(batches):
        for batch in batches:
            for part, found in pieces(batch, "html"):
                texts = [extract(p, weights) for p in found]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
