"""The main text of web pages by tag-path ratios.

A page becomes a row of text nodes with their root-to-leaf tag paths. For each path the length of its
text and its punctuation are added up and set against the number of its nodes; both ratios go to the
nodes, are smoothed along the page, and their product is compared with its own spread over the page.
The nodes above the threshold name the content: the deepest section that holds them is the article.
What markup declares as menu, footer, hidden and the like never takes part. An element whose class, id
or role is such a name goes unless most of the page stands in it; a form, or an element with such a name
as a piece of a longer one, goes only if the ratios of all its paths are below their spread.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math noframes noembed object".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TEXTUAL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th tr tbody thead tfoot caption address summary ul ol dl table center".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Elements that are never part of an article.
ASIDE = frozenset("nav footer aside menu button select dialog head".split())
#: Elements that may be a part of their own or stand around the whole page.
FORMS = frozenset("form fieldset".split())
#: Words in class, id or role that name such parts.
NAMES = frozenset(
    "ad ads advert advertisement adbox adslot adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside "
    "widget footer header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "search searchbox comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations pagination pager "
    "copyright legal disclaimer contentinfo complementary skip".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class Element:
    """An element of a page; elements are numbered as they open, tag paths as they are first met."""

    __slots__ = ("name", "parent", "dropped", "doubt", "depth", "path", "number", "solid", "article")

    def __init__(self, name: str, parent: Element | None, dropped: bool, doubt: int = 0, path: int = 0, number: int = 0) -> None:
        self.name, self.parent, self.doubt, self.path, self.number = name, parent, doubt, path, number
        self.dropped = dropped or (parent is not None and parent.dropped)
        self.depth = 0 if parent is None else parent.depth + 1
        #: The nearest element from here up that is not inline, and whether an article or main is among them.
        self.solid: Element = parent.solid if parent is not None and name in INLINE else self
        self.article = name in ("article", "main") or (parent is not None and parent.article)


#: What is said of an element: nothing, that its text decides, that it is a part of its own, that it never takes part.
PLAIN, LOOSE, NAMED, ASIDES = range(4)


def _doubt(name: str, attributes: str, above: Element) -> int:
    if name in ASIDE or (name == "header" and not above.article):
        return ASIDES
    out = LOOSE if name in FORMS else PLAIN
    if not attributes or name in ("html", "body", "article", "main"):
        return out
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value.strip() == "true") or (key == "style" and _NONE.search(value)):
            return ASIDES
        if key in ("class", "id", "role"):
            if not NAMES.isdisjoint(value.split()):
                out = NAMED
            elif not NAMES.isdisjoint(_WORD.findall(value)):
                out = max(out, LOOSE)
    return out


Node = tuple[Element, str, bool]


def nodes(page: str) -> tuple[list[Element], list[Node]]:
    """Elements as they open, and text nodes in page order: element, decoded text, and whether a block begins with it.

    Every element is opened and closed once and an end tag without a start is passed over, so the
    work grows with the page, however deep it is nested.
    """
    at = Element("", None, False)
    elements, out = [at], []
    paths: dict[tuple[int, str], int] = {}
    open_: Counter[str] = Counter()
    fresh, place, seek = True, 0, 0

    def text(end: int) -> None:
        nonlocal fresh
        if end > place and not at.dropped:
            out.append((at, html.unescape(page[place:end]), fresh))
            fresh = False

    def close(last: Element) -> None:
        nonlocal at
        while at is not last.parent:
            open_[at.name] -= 1
            at = at.parent

    while (opened := page.find("<", seek)) >= 0:
        m = _TOKEN.match(page, opened)
        if m is None:  # a sign in the text
            seek = opened + 1
            continue
        text(opened)
        place = seek = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            fresh = True
        if m[1]:
            if open_[name] > 0:
                here = at
                while here.name != name:
                    here = here.parent
                close(here)
            continue
        if name in RAW:
            ends = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, place)
            if not m[3].endswith("/"):
                place = seek = ends.end() if ends else len(page)
            continue
        if name in VOID:
            continue
        here = at.solid
        if name in CLOSES_P:
            if here.name == "p":
                close(here)
        elif name in SELF_CLOSING:
            while here.name == "p" and here.name not in SELF_CLOSING[name]:
                here = here.parent.solid
            if here.name in SELF_CLOSING[name]:
                close(here)
        doubt = PLAIN if at.dropped else _doubt(name, m[3], at)
        at = Element(name, at, doubt == ASIDES, doubt, paths.setdefault((at.path, name), len(paths) + 1), len(elements))
        elements.append(at)
        open_[name] += 1
    text(len(page))
    return elements, out


_BELL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)


def _smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian over two neighbours on each side; ends lean on what is there."""
    return (np.convolve(values, _BELL) / np.convolve(np.ones(len(values)), _BELL))[2:-2]


def _ratios(found: list[Node]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Numbers of the nodes that are not blank, and length and punctuation of their paths per node."""
    inked = [i for i, (_, t, _) in enumerate(found) if not t.isspace()]
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for i in inked:
        element, t, _ = found[i]
        length[element.path] += len(t)
        marks[element.path] += len(_PUNCTUATION.findall(t))
        count[element.path] += 1
    paths = [found[i][0].path for i in inked]
    return inked, np.array([length[p] / count[p] for p in paths]), np.array([(1 + marks[p]) / count[p] for p in paths])


def content(found: list[Node], smooth: bool = True) -> list[int]:
    """Numbers of the nodes whose fused path ratio reaches the spread over the page, at least the best one."""
    inked, ratio, punctuation = _ratios(found)
    if not inked:
        return []
    fused = _smooth(ratio) * _smooth(punctuation) if smooth else ratio * punctuation
    least = min(fused.std(), fused.max())
    return [i for i, v in zip(inked, fused) if v >= least]


def _section(element: Element) -> Element:
    while element.parent is not None and element.name in TEXTUAL:
        element = element.parent
    return element


def _sums(elements: list[Element], own: dict[int, int]) -> list[int]:
    """What stands in each element and all below it, from what stands in it itself, by number."""
    out = [0] * len(elements)
    for number, value in own.items():
        out[number] = value
    for e in reversed(elements):  # parents open before their children
        if e.parent is not None:
            out[e.parent.number] += out[e.number]
    return out


def _without(elements: list[Element], found: list[Node], gone: set[int]) -> list[Node]:
    """Nodes outside the elements; a block that began in one of them begins at the next node left."""
    if not gone:
        return found
    left_out = [False] * len(elements)
    for e in elements:
        left_out[e.number] = e.number in gone or (e.parent is not None and left_out[e.parent.number])
    out, began = [], False
    for element, t, fresh in found:
        if left_out[element.number]:
            began |= fresh
        else:
            out.append((element, t, fresh or began))
            began = False
    return out


def _parts(elements: list[Element], found: list[Node]) -> set[int]:
    """Named elements that go: all but those with most of the text, if no article or main stands outside of them."""
    own: dict[int, int] = defaultdict(int)
    for element, t, _ in found:
        if not t.isspace():
            own[element.number] += len(t)
    size = _sums(elements, own)
    articles = [e.name in ("article", "main") and size[e.number] > 0 for e in elements]
    below = _sums(elements, {i: 1 for i, x in enumerate(articles) if x})
    above = [0] * len(elements)
    for e in elements:
        if e.parent is not None:
            above[e.number] = above[e.parent.number] + articles[e.parent.number]
    gone = set()
    for e in elements:
        n = size[e.number]
        if e.doubt == NAMED and n and (2 * n <= size[0] or below[0] > below[e.number] + above[e.number]):
            gone.add(e.number)
    return gone


def _idle(elements: list[Element], found: list[Node]) -> set[int]:
    """Loose elements that go: those without a path above the threshold, a main heading, or most of the text."""
    heading = [False] * len(elements)
    for e in elements:
        heading[e.number] = e.name == "h1" or (e.parent is not None and heading[e.parent.number])
    chosen = set(content(found, smooth=False))
    held: dict[int, int] = defaultdict(int)
    own: dict[int, int] = defaultdict(int)
    for i, (element, t, _) in enumerate(found):
        own[element.number] += len(t.strip())
        held[element.number] += i in chosen or heading[element.number]
    size, kept = _sums(elements, own), _sums(elements, held)
    return {e.number for e in elements if e.doubt == LOOSE and not kept[e.number] and 2 * size[e.number] <= size[0]}


def extract(page: str | None) -> str:
    """The article's blocks in page order, joined by one space; empty if there is no text."""
    elements, found = nodes(page or "")
    found = _without(elements, found, _parts(elements, found))
    found = _without(elements, found, _idle(elements, found))
    chosen = content(found)
    if not chosen:
        return ""
    last = list(range(len(elements)))
    for e in reversed(elements):
        if e.parent is not None:
            last[e.parent.number] = max(last[e.parent.number], last[e.number])

    def inside(element: Element, root: Element) -> bool:
        return root.number <= element.number <= last[root.number]

    # The deepest section that holds all chosen nodes; an article element around the most text is one.
    root = _section(found[chosen[0]][0])
    for i in chosen[1:]:
        while not inside(found[i][0], root):
            root = root.parent
    own: dict[int, int] = defaultdict(int)
    for i in chosen:
        own[found[i][0].number] += len(found[i][1])
    size = _sums(elements, own)
    named = [e for e in elements if e.name in ("article", "main") and size[e.number]]
    if named:
        best = max(named, key=lambda e: (size[e.number], -e.depth))
        if 2 * size[best.number] >= size[0]:
            root = best
    text = "".join((" " if fresh else "") + t for element, t, fresh in found if inside(element, root))
    return " ".join(text.split())


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    A null or empty html, or one without text outside of the parts left out, gives an empty text.
    Rows that repeat are read each; further columns are left out; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
