"""Main text of web pages: a minimum cut separates content from boilerplate.

A page becomes a sequence of text blocks. A logistic classifier gives every block the cost of
calling it content and of calling it boilerplate; these are the capacities between the
block and the two terminals. Blocks next to each other, and blocks near each other in the tree
of elements, are joined by edges that cost their weight where the two are told apart. The
cheapest labelling is a minimum cut, found by a maximum flow.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html import unescape
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffcast.llm.common import utf8

# Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template title textarea select option button iframe object "
                   "svg canvas audio video datalist noembed noframes xmp head".split())
# Of these, the ones whose content is not mark-up: it ends at their end tag only.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements within a line; all others start and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter "
                   "nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u "
                   "var wbr img br input area map".split())
# Elements that end with the next of their kind, and where that stops.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
PARAGRAPHS = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
# Elements that an end tag further out does not pass.
SCOPES = frozenset("article aside nav section main div table td th body html".split())

# Names of elements, and words in their class, id or role, that tell what their text is (fixed values).
CONTENT_WORDS = frozenset("article articlebody content main post entry story".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu submenu header masthead footer sidebar aside ad ads adbox adsense advert adverts "
    "advertisement advertising banner sponsor sponsored promo promotion notice cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup login register share sharing social comment "
    "comments commentlist reply replies respond disqus related recommended breadcrumb breadcrumbs "
    "pagination pager widget widgets toolbar topbar copyright legal disclaimer alert complementary contentinfo search "
    "form dialog skip tags".split()
)
# What stays boilerplate with an article inside it; a form or header may hold a whole page.
STRONG = frozenset("nav navbar navigation menu footer sidebar aside ad ads advert advertisement comment comments "
                   "commentlist replies disqus related recommended".split())
# A word after one of these says what is not there, or what the page has elsewhere.
NEGATIONS = frozenset("no not has with without non hide".split())

# Weights of the classifier: log odds of content.
BIAS, PLACE, OUTSIDE, WORDS, SENTENCES, LINKS, HEADING, RIGHTS = -1.0, 6.0, -4.0, 0.5, 1.0, -5.0, 1.0, -4.0
# Weights of the edges: next in the page, same parent, same grandparent.
NEXT, SIBLING, COUSIN = 0.2, 0.6, 0.3

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++))""", re.I)
_WORD = re.compile(r"[A-Z]{2,}(?![a-z])|[A-Z]?[a-z]+")
_ENDS = (".", "!", "?", "…", "。", "！", "？")


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    place: int
    silent: bool


@dataclass(slots=True)
class Block:
    """Text between two block borders, with the container it lies in."""

    container: Element
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _names(attributes: str) -> Iterator[str]:
    """Words of the class, id and role of an element, but those said not to be there."""
    for _, a, b, c in _NAMES.findall(attributes):
        for name in unescape(a or b or c).split():
            yield from re.split(r"[^a-z]+", name.lower())
            words = [w.lower() for w in _WORD.findall(name)]
            for before, word in zip(["", *words], words):
                if before in NEGATIONS:
                    yield f"{before}-{word}"
                else:
                    yield word
                    # A sideBar or side-bar is a sidebar.
                    yield before + word


def _place(tag: str, attributes: str, outer: int) -> int:
    """What a container says about its text: 1 content, -1 boilerplate, 0 nothing, -2 boilerplate for good.

    The innermost word counts, but no article inside a strong boilerplate is content.
    """
    words = {tag}
    if attributes and tag not in ("html", "body"):
        words.update(_names(attributes))
        words -= {w.partition("-")[2] for w in words if "-" in w}
    if outer == -2 or words & STRONG:
        return -2
    boilerplate = words & BOILERPLATE_WORDS
    # The header of an article holds its heading.
    if boilerplate and not (outer == 1 and boilerplate == {"header"}):
        return -1
    return 1 if words & CONTENT_WORDS else outer


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in page order; text of silent elements is left out.

    Anything is taken as a page: unknown, unclosed and stray tags, and text without any.
    """
    here = Element("", None, 0, False)
    blocks: list[Block] = []
    block: Block | None = None
    links, at = 0, 0
    opened: Counter[str] = Counter()

    def add(text: str) -> None:
        nonlocal block
        if here.silent or not text:
            return
        if block is None:
            if text.isspace():
                return
            container, heading = here, False
            while container.tag in PARAGRAPHS:
                heading |= container.tag != "p"
                container = container.parent
            block = Block(container, heading)
            blocks.append(block)
        block.parts.append(text)
        if links:
            block.linked += len(text)

    while at < len(page):
        found = _TAG.search(page, at)
        if found is None:
            add(unescape(page[at:]))
            break
        if found.start() > at:
            add(unescape(page[at:found.start()]))
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag, attributes = tag.lower(), found.group(3)
        if found.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                add(" ")
            elif tag not in INLINE:
                block = None
                if opened[tag]:
                    here = _closed(here, tag, opened)
            continue
        if tag == "a":
            links += 1
        if tag in INLINE and tag not in SILENT:
            if tag in VOID:
                add(" " if tag in ("br", "input", "img") else "")
            continue
        block, links = None, 0 if tag != "a" else links
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in VOID:
            continue
        here = _ended_by(here, tag, opened)
        opened[tag] += 1
        here = Element(
            tag, here, _place(tag, attributes, here.place),
            tag != "body" and (here.silent or tag in SILENT),
        )
    return blocks


def _up(here: Element, outer: Element, opened: Counter[str]) -> Element:
    """Leave all elements inside ``outer``."""
    while here is not outer:
        opened[here.tag] -= 1
        here = here.parent
    return outer


def _ended_by(here: Element, tag: str, opened: Counter[str]) -> Element:
    """The element a new one starts in, after those that it ends."""
    inner = here.parent if here.tag in PARAGRAPHS else here
    if tag in CLOSES:
        ended, stops = CLOSES[tag]
        outer = inner
        while outer.parent is not None and outer.tag not in stops:
            if outer.tag in ended:
                inner = outer.parent
            outer = outer.parent
    if inner.tag == "head":
        inner = inner.parent
    return _up(here, inner, opened)


def _closed(here: Element, tag: str, opened: Counter[str]) -> Element:
    """The element around the innermost open one of a name, unless a scope lies between."""
    outer = here
    while outer.tag != tag:
        if outer.tag in SCOPES and tag not in SCOPES:
            return here
        outer = outer.parent
    return _up(here, outer.parent, opened)


def log_odds(block: Block, text: str, has_content: bool) -> float:
    """Log odds that a block is content, by its place, length, sentences and links.

    ``has_content`` is whether any container of the page says that it is content.
    """
    place = block.container.place
    odds = BIAS + HEADING * block.heading + SENTENCES * text.endswith(_ENDS)
    odds += PLACE * ((place > 0) - (place < 0)) + OUTSIDE * (place == 0 and has_content)
    odds += WORDS * min(text.count(" ") + 1, 40) ** 0.5 + RIGHTS * ("©" in text)
    return odds + LINKS * block.linked / sum(map(len, block.parts))


def costs(odds: float) -> tuple[float, float]:
    """Cost of calling a block content and of calling it boilerplate: minus the log chances."""

    def minus_log(x: float) -> float:
        return log1p(exp(-x)) if x > -30 else -x

    return minus_log(odds), minus_log(-odds)


def smoothness(blocks: Sequence[Block]) -> dict[tuple[int, int], float]:
    """Edges between blocks: next in the page, and last before with the same parent or grandparent."""
    edges: dict[tuple[int, int], float] = {}
    seen: dict[tuple[int, int], int] = {}
    for i, block in enumerate(blocks):
        joined = [(i - 1, NEXT)] if i else []
        parent = block.container
        for level, weight in ((0, SIBLING), (1, COUSIN)):
            if (key := (level, id(parent))) in seen:
                joined.append((seen[key], weight))
            seen[key] = i
            parent = parent.parent or parent
        for j, weight in joined:
            edges[j, i] = edges.get((j, i), 0.0) + weight
    return edges


def minimum_cut(
    content: Sequence[float], boilerplate: Sequence[float], edges: dict[tuple[int, int], float]
) -> list[bool]:
    """Labels of the smallest sum of costs and of the weights of edges between unequal labels.

    ``content`` and ``boilerplate`` are the costs of a label. Of equally cheap labellings the
    one with the least content is given. A block whose costs differ by more than all its
    edges weigh has its label in every best labelling; it is decided first, and its edges become
    costs of its neighbours. The rest is cut by augmenting shortest paths in layers.
    """
    n = len(content)
    gain = [b - c for c, b in zip(content, boilerplate)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), weight in edges.items():
        near[i][j] = near[i].get(j, 0.0) + weight
        near[j][i] = near[j].get(i, 0.0) + weight
    label: list[bool | None] = [None] * n
    weights = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(gain[i]) <= weights[i]:
            continue
        label[i] = gain[i] > 0
        for j, weight in near[i].items():
            if label[j] is None:
                gain[j] += weight if label[i] else -weight
                weights[j] -= weight
                queue.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        number = {i: k for k, i in enumerate(left)}
        inner = [{number[j]: w for j, w in near[i].items() if j in number} for i in left]
        for i, reached in zip(left, _source_side([gain[i] for i in left], inner)):
            label[i] = reached
    return [bool(x) for x in label]


def _source_side(gain: Sequence[float], near: list[dict[int, float]]) -> list[bool]:
    """What the source still reaches after a maximum flow; a positive gain is an arc from it."""
    n = len(gain)
    tiny = 1e-12
    supply = [max(g, 0.0) for g in gain]
    demand = [max(-g, 0.0) for g in gain]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        ends = False
        while queue:
            i = queue.popleft()
            ends |= demand[i] > tiny
            for j, room in near[i].items():
                if room > tiny and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not ends:
            return [x >= 0 for x in level]
        arcs = [iter(list(x)) for x in near]
        ahead = [next(a, None) for a in arcs]
        for start in range(n):
            path = [start]
            while path and supply[start] > tiny:
                i = path[-1]
                if demand[i] > tiny:
                    steps = list(zip(path, path[1:]))
                    flow = min([supply[start], demand[i], *(near[a][b] for a, b in steps)])
                    supply[start] -= flow
                    demand[i] -= flow
                    for a, b in steps:
                        near[a][b] -= flow
                        near[b][a] += flow
                    full = next((k for k, (a, b) in enumerate(steps) if near[a][b] <= tiny), len(path) - 1)
                    del path[full + 1:]
                    continue
                j = ahead[i]
                while j is not None and not (near[i][j] > tiny and level[j] == level[i] + 1):
                    j = ahead[i] = next(arcs[i], None)
                if j is not None:
                    path.append(j)
                    continue
                path.pop()
                if path:
                    ahead[path[-1]] = next(arcs[path[-1]], None)


def extract(page: str) -> str:
    """Main text of one page: the content blocks in page order, joined by one space."""
    found = [(b, t) for b in blocks_of(page) if (t := b.text())]
    if not found:
        return ""
    blocks = [b for b, _ in found]
    has_content = any(b.container.place > 0 for b in blocks)
    priced = [costs(log_odds(b, t, has_content)) for b, t in found]
    labels = minimum_cut([c for c, _ in priced], [b for _, b in priced], smoothness(blocks))
    return " ".join(t for (_, t), kept in zip(found, labels) if kept)


def main_text(pages: DataFrame, keys: Sequence[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """One row per page: its keys, ``text`` and ``n_chars``, the code points of the text.

    A null, empty or wordless page has the empty text. Repeated pages give repeated rows; long ones
    are taken whole. Other columns play no part.
    """
    kinds = [f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys]
    names = [*keys, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.decode("utf-8", "replace")) for page in utf8(batch.column(len(keys)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names
            )

    rows = pages.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{html}`").cast("string"))
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars bigint"]))
