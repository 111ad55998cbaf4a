"""Main-text extraction from HTML by minimum cut.

A page becomes a row of text blocks in page order, each at its place in the element tree.  A
classifier gives every block two costs, of being called content and of being called boilerplate:
the losses of a logistic model over its length, links, sentences and what the elements around it
are called.  They become capacities to the two terminals of a graph.  Smoothness edges join
blocks next to each other in page order and blocks near each other in the element tree, the more
of their elements two blocks share the stronger.  The minimum cut is the labelling of least
total cost; it takes a short line of an article with the article, and a long sentence in a menu
with the menu.  What names say is bounded, so that a few edges outweigh it.

Reading, the tree and the cut take time in proportion to the page, whatever its markup: tags that
never close, quotes that never end, elements nested without limit.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import steps

STEP = 2 << 20
#: Elements whose begin and end part blocks of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements without an end tag.
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no markup, and never page text.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object audio video canvas".split())
#: A begin tag that ends an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: How far up an open element may be ended by CLOSES or by a stray end tag.
SCOPES = frozenset("html body table ul ol dl article section main aside nav header footer form div select blockquote".split())
#: Element names, and words of class, id and role, with their evidence for boilerplate (negative: for content).
BY_ELEMENT = {
    **dict.fromkeys("nav footer aside form menu dialog button select search head".split(), 4.0),
    **dict.fromkeys("header label".split(), 2.5),
    **dict.fromkeys("article main".split(), -1.2),
}
BY_WORD = {
    **dict.fromkeys("nav navbar navigation menu menubar topnav breadcrumb breadcrumbs pagination pager sidebar side widget".split(), 4.0),
    **dict.fromkeys("footer foot colophon copyright legal masthead topbar toolbar complementary contentinfo".split(), 4.0),
    **dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense".split(), 4.0),
    **dict.fromkeys("comment comments reply replies respond disqus".split(), 5.0),
    **dict.fromkeys("cookie cookies consent gdpr notice notices alert popup modal overlay toast".split(), 4.0),
    **dict.fromkeys("share sharing social follow subscribe subscription newsletter signup login related recommended trending search form".split(), 4.0),
    **dict.fromkeys("header".split(), 2.5),
    **dict.fromkeys("article post entry story content maincontent articlebody main".split(), -1.0),
}
#: How much all names around a block count at most, for boilerplate and for content.
MOST, LEAST = 5.0, -1.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Weights of the classifier's other evidence.
BIAS, PER_LOG_CHAR, LINKS, SENTENCE, HEADING = 2.8, -0.55, 4.0, -0.6, -0.6
#: Smoothness: between neighbours in page order, and more the more of their elements they share.
NEXT, SHARED = 0.05, 4.0

ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
CAMEL = re.compile(r"([a-z])([A-Z])")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
END_MARK = re.compile(r"[.!?…。]")
BOUNDS = re.compile("[>\"']")


@dataclass
class Block:
    text: str
    around: tuple[int, ...]  # serial numbers of the three innermost elements around it, innermost first
    depth: int  # number of elements around it
    shared: int  # how many of those the block before it has
    evidence: float  # for boilerplate, from the elements around it
    linked: int  # characters within links
    heading: bool


class _Open:
    """An open element, with what holds for everything in it."""

    __slots__ = ("name", "block", "evidence", "hidden", "heading", "depth", "around", "names")

    def __init__(self, name: str, serial: int, above: _Open | None, evidence: float, hidden: bool) -> None:
        self.name, self.block = name, name in BLOCKS
        self.evidence = evidence + (above.evidence if above else 0.0)
        self.hidden = hidden or above is not None and above.hidden
        self.heading = name in HEADINGS or above is not None and above.heading
        self.depth = (above.depth if above else 0) + self.block
        outer = above.around if above else ()
        self.around = (serial, *outer[:2]) if self.block else outer
        # how many elements of each name are open up to the nearest scope, that included
        self.names = above.names if above and above.name not in SCOPES else Counter()


class _Tags:
    """Where tags end: at the first > that isn't quoted, in time that is linear over all tags."""

    def __init__(self, page: str) -> None:
        self.page, self.known = page, None

    def end(self, at: int) -> int:
        """The place of the > that ends the tag that begins at `at`; -1 if none follows."""
        close = self.page.find(">", at)
        if close < 0:
            return -1
        double, single = self.page.count('"', at, close), self.page.count("'", at, close)
        if not single and not double % 2:
            return close
        if self.known is None:
            self._resolve()
        marks, ends = self.known
        k = bisect_left(marks, at)
        return ends[k] if ends[k] >= 0 else close  # quotes that never end quote nothing

    def _resolve(self) -> None:
        """For each mark, where a tag ends that is unquoted up to it: from right to left, each from a later one."""
        marks = [m.start() for m in BOUNDS.finditer(self.page)]
        ends = [-1] * (len(marks) + 1)
        later = {'"': -1, "'": -1}
        for k in range(len(marks) - 1, -1, -1):
            mark = self.page[marks[k]]
            if mark == ">":
                ends[k] = marks[k]
            else:
                ends[k] = ends[later[mark] + 1] if later[mark] >= 0 else -1
                later[mark] = k
        self.known = marks, ends


def _evidence(name: str, attributes: str, in_article: bool) -> float:
    out = 0.5 if name == "header" and in_article else BY_ELEMENT.get(name, 0.0)
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = CAMEL.sub(r"\1 \2", m[2] or m[3] or m[4] or "")
            out += sum(BY_WORD.get(w, 0.0) for w in WORD.findall(value.lower()))
    return out


class _Reader:
    """One pass over a page: its text blocks, in order, with character references decoded."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.stack: list[_Open] = []
        self.parts: list[str] = []
        self.linked = self.links = self.articles = self.serial = 0
        self.low = 0  # least depth since the last block
        self.scopes: Counter[str] = Counter()  # open elements that are scopes

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if self.links:
            self.linked += len(piece.strip())

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", _html.unescape("".join(self.parts))).strip()
            top = self.stack[-1] if self.stack else None
            if text and not (top and top.hidden):
                depth = top.depth if top else 0
                around = top.around if top else ()
                evidence = max(LEAST, min(MOST, top.evidence)) if top else 0.0
                self.found.append(Block(text, around, depth, min(self.low, depth), evidence, min(self.linked, len(text)), top is not None and top.heading))
                self.low = depth
            self.parts.clear()
        self.linked = 0

    def open(self, name: str, attributes: str) -> None:
        above = self.stack[-1] if self.stack else None
        self.serial += 1
        hidden = bool(attributes) and HIDDEN.search(attributes) is not None
        e = _Open(name, self.serial, above, _evidence(name, attributes, self.articles > 0), hidden)
        e.names[name] += 1
        self.scopes[name] += name in SCOPES
        self.stack.append(e)
        self.links += name == "a"
        self.articles += name == "article"

    def cut(self, names: frozenset[str] | set[str]) -> None:
        """Close the innermost of these elements, and all in it."""
        while True:
            e = self.stack.pop()
            e.names[e.name] -= 1
            self.scopes[e.name] -= e.name in SCOPES
            self.links -= e.name == "a"
            self.articles -= e.name == "article"
            if e.name in names:
                break
        self.low = min(self.low, self.stack[-1].depth if self.stack else 0)

    def holds(self, name: str) -> bool:
        """Whether such an element is open, and no scope within it."""
        return bool(self.stack) and self.stack[-1].name not in SCOPES and self.stack[-1].names[name] > 0

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if self.scopes[name] > 0 if name in SCOPES else self.holds(name):
            self.cut({name})

    def imply(self, name: str) -> None:
        """Close what a block's begin tag ends: an open paragraph, and elements of its group."""
        ends = CLOSES.get(name, frozenset()) | {"p"}
        if any(self.holds(e) for e in ends):
            self.cut(ends)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order, with character references decoded."""
    r, tags, lower = _Reader(), _Tags(page), ""
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            r.text(page[at:])
            break
        if begin > at:
            r.text(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", begin):
            end = page.find("]]>", begin)
            r.parts.append(page[begin + 9 : n if end < 0 else end])
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        ending = page.startswith("</", begin)
        m = NAME.match(page, begin + 1 + ending)
        end = tags.end(m.end()) if m else -1
        if not m or end < 0:
            if m:  # no > follows at all: what is left is text
                r.text(page[begin:])
                break
            r.text("<")
            at = begin + 1
            continue
        name, rest, at = m[0].lower(), page[m.end() : end], end + 1
        if ending:
            r.close(name)
        elif name == "br":
            r.parts.append("\n")
        elif name in RAW:
            if name in BLOCKS:
                r.flush()
            if not rest.endswith("/") or name in ("script", "style", "textarea", "title"):
                lower = lower or page.lower()
                end = lower.find(f"</{name}", at) if len(lower) == n else page.find(f"</{name}", at)
                end = page.find(">", end) if end >= 0 else -1
                at = n if end < 0 else end + 1
            if r.parts:
                r.parts.append(" ")
        else:
            if name in BLOCKS:
                r.flush()
                r.imply(name)
            if name not in VOID and not (rest.endswith("/") and name not in BLOCKS):
                r.open(name, rest)
    r.flush()
    return r.found


def costs(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """What calling each block content, and calling it boilerplate, costs: the losses of a logistic model."""
    size = np.array([len(b.text) for b in found], float)
    z = BIAS + PER_LOG_CHAR * np.log1p(size)
    z += np.array([b.evidence for b in found])
    z += LINKS * np.array([b.linked for b in found]) / np.maximum(size, 1)
    z += SENTENCE * np.array([END_MARK.search(b.text) is not None for b in found])
    z += HEADING * np.array([b.heading for b in found])
    return np.logaddexp(0, z), np.logaddexp(0, -z)


def nearness(shared: int, a: int, b: int) -> float:
    """How much of their elements two blocks of depths a and b share, from 0 to 1: a block's own element aside."""
    return min(1.0, (shared + 1) / (max(a, b) + 1))


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the next, and to the last one before under the same elements.

    Elements that hold the whole page don't make blocks near.
    """
    out = []
    root = min((b.shared for b in found[1:]), default=0)
    for i in range(1, len(found)):
        a, b = found[i - 1], found[i]
        out.append((i - 1, i, NEXT + SHARED * nearness(b.shared - root, a.depth - root, b.depth - root) ** 3))
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        # elements around a block, from its parent's element out: an earlier block under the same one is near
        for up, serial in enumerate(b.around[1:], 1):
            j = last.get(serial)
            if j is not None and j < i - 1:
                if b.depth - up > root:
                    out.append((j, i, SHARED * nearness(b.depth - up - root, found[j].depth - root, b.depth - root) ** 3))
                break
        for serial in b.around:
            last[serial] = i
    return out


def minimum_cut(to_source: np.ndarray, to_sink: np.ndarray, links: list[tuple[int, int, float]]) -> np.ndarray:
    """Whether each node is on the source side of a minimum cut.

    A node on the source side pays `to_sink`, on the sink side `to_source`, and a link whose
    ends are apart pays its weight.  Equal choices go to the sink side.

    Nodes whose terminals outweigh all their links are settled first, and their links become
    their neighbours' terminals; what is left, mostly little, is a maximum flow by level
    graphs with dead ends pruned.
    """
    n = len(to_source)
    pull = (np.asarray(to_source) - np.asarray(to_sink)).tolist()  # towards the source, if positive
    near_: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        if a != b and w > 0:
            near_[a][b] = near_[a].get(b, 0.0) + w
            near_[b][a] = near_[b].get(a, 0.0) + w
    weight = [sum(x.values()) for x in near_]
    side: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        u = queue.pop()
        if side[u] is None and (pull[u] > weight[u] + EPS or pull[u] <= -weight[u]):
            side[u] = pull[u] > 0
            for v, w in near_[u].items():
                if side[v] is None:
                    pull[v] += w if side[u] else -w
                    weight[v] -= w
                    queue.append(v)
    left = [u for u in range(n) if side[u] is None]
    if left:
        room = [{v: w for v, w in near_[u].items() if side[v] is None} if side[u] is None else {} for u in range(n)]
        reached = _flow(left, pull, room)
        for u in left:
            side[u] = u in reached
    return np.array(side, bool)


EPS = 1e-9


def _flow(nodes: list[int], pull: list[float], room: list[dict[int, float]]) -> set[int]:
    """Send all that goes from nodes with positive pull to those with negative; what is reached at the end.

    `pull` and `room`, what links can still carry, are used up.
    """
    while True:
        level = {u: 0 for u in nodes if pull[u] > EPS}
        wave, open_ = list(level), False
        while wave and not open_:
            after = []
            for u in wave:
                for v, w in room[u].items():
                    if w > EPS and v not in level:
                        level[v] = level[u] + 1
                        after.append(v)
            open_ = any(pull[v] < -EPS for v in after)
            wave = after
        if not open_:
            return set(level)
        arcs = {u: iter(list(room[u])) for u in level}
        for s in [u for u, k in level.items() if k == 0]:
            path = [s]
            while pull[s] > EPS and path:
                u = path[-1]
                if pull[u] < -EPS:  # a sink: send what the narrowest link lets through
                    push = min(pull[s], -pull[u], *(room[a][b] for a, b in pairwise(path)))
                    pull[s] -= push
                    pull[u] += push
                    short = 0
                    for k, (a, b) in enumerate(pairwise(path)):
                        room[a][b] -= push
                        room[b][a] = room[b].get(a, 0.0) + push
                        if room[a][b] <= EPS and not short:
                            short = k + 1
                    # go back to before the first full link, or stay if only the sink is full
                    if short:
                        arcs[path[short - 1]] = chain([path[short]], arcs[path[short - 1]])
                        del path[short:]
                    elif pull[u] >= -EPS:
                        path.pop()
                    continue
                for v in arcs[u]:
                    if room[u].get(v, 0.0) > EPS and level.get(v, -1) == level[u] + 1:
                        path.append(v)
                        break
                else:
                    path.pop()


def content_blocks(page: str | None) -> list[str]:
    """The content blocks of a page, in page order."""
    found = blocks(page or "")
    if not found:
        return []
    as_content, as_boilerplate = costs(found)
    keep = minimum_cut(as_boilerplate, as_content, edges(found))
    return [b.text for b, k in zip(found, keep, strict=True) if k]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "html", STEP):
        texts = ["\n".join(content_blocks(h)) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of pages.

    Blocks are joined by line feeds; white space within a block is one space.  Null or empty
    html, and pages without content, give an empty text; an empty table gives an empty one.
    Very long pages, and markup that never closes, are read whole in linear time.  Equal costs
    make a block boilerplate.  Repeated rows and null ids keep their rows; other columns are
    ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(partial(_extract), "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
