"""Main text of web pages by tag-path ratios.

A page becomes its text nodes with the path of tags above each. Text length and punctuation are added up per
path and divided by the number of nodes of the path; both ratios are smoothed along the page and multiplied.
Paths whose fused ratio is over a threshold carry the content; what they carry is added up the element tree.
The article is the outermost article or main element with most of it, or else the innermost container that
leaves no such path and no heading outside. Its nodes are the text, but for those under tags,
roles or class names of menus, notices, adverts, forms, comments and the like.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hitledger.llm.texts import slices

#: Share of the mean fused ratio from which a path counts; share of the content that a container must hold.
THRESHOLD, MAJORITY = 0.5, 0.6
_SMOOTH = np.array([0.06, 0.24, 0.4, 0.24, 0.06])

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_GAP = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

# Fixed values of HTML: which tags stand alone, hold raw text, make blocks, are leaf blocks, or are never content.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea noscript iframe xmp noembed noframes template".split())
_LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption summary address".split())
_BLOCK = _LEAF | set(
    "html body div section article main header footer nav aside ul ol dl table thead tbody tfoot tr form fieldset figure details hr menu dialog center".split()
)
_NEVER = set("head script style title noscript template nav footer aside form button select option textarea iframe object svg menu dialog label".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words in class names and ids, and roles, of what is not the article.
_ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe signup login "
    "social share sharing related recommended comment comments respond reply replies disqus form search widget toolbar pagination pager copyright skip".split()
)
_ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_HEADS = {"header"}
_CORE = {"html", "body", "article", "main"}
_TITLES = set("h1 h2 h3 h4 h5 h6".split())


def _is_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the tag, its role or a sign of hiding take an element out."""
    if tag in _NEVER or (tag in _HEADS and not in_article):
        return True
    if tag in _CORE or not attributes:
        return False
    for name, value, flag in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if flag or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value.lower() in _ASIDE_ROLES:
            return True
    return False


def _named_aside(tag: str, attributes: str, in_article: bool) -> int:
    """2 if a class or id is the name of what is not the article, 1 if one has such a word beside others, else 0."""
    if tag in _CORE or not attributes:
        return 0
    most = 0
    listed = _ASIDE_WORDS if in_article else _ASIDE_WORDS | _HEADS
    for name, value, _ in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for part in value.strip("\"'").split():
                words = {w.lower() for w in _NAME_WORD.findall(part)}
                if words & listed:
                    most = max(most, 1 if words - listed else 2)
    return most


class _Page:
    """The text nodes of a page, and its elements as a tree."""

    def __init__(self, source: str):
        self.parent, self.tag, self.aside, self.named = [-1], [""], [False], [0]
        self.nodes: list[tuple[int, int, str]] = []  # (element, block, text)
        self._stack, self._block = [0], 0
        self._in_article = 0
        at = 0
        while m := _TOKEN.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                else:
                    self._open(tag, m[3])
                    if tag in _RAW:
                        end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                        at = end.start() if end else len(source)
        self._text(source[at:])

    def _text(self, raw: str) -> None:
        if raw:
            self.nodes.append((self._stack[-1], self._block, html.unescape(raw)))

    def _pop(self, depth: int) -> None:
        if any(self.tag[e] in _BLOCK for e in self._stack[depth:]):
            self._block += 1
        self._in_article -= sum(self.tag[e] in ("article", "main") for e in self._stack[depth:])
        del self._stack[depth:]

    def _find(self, tags: set[str], walls: set[str]) -> int | None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in tags:
                return depth
            if tag in walls:
                return None
        return None

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self._block += 1
            if (depth := self._find({"p"}, _BLOCK - {"p"})) is not None:
                self._pop(depth)
        if tag in _CLOSES and (depth := self._find(_CLOSES[tag], _WALLS[tag])) is not None:
            self._pop(depth)
        if tag in _VOID:
            if tag == "br":
                self._text(" ")
            return
        above = self._stack[-1]
        self.parent.append(above)
        self.tag.append(tag)
        self.aside.append(self.aside[above] or _is_aside(tag, attributes, self._in_article > 0))
        self.named.append(_named_aside(tag, attributes, self._in_article > 0))
        self._in_article += tag in ("article", "main")
        if not (attributes.rstrip().endswith("/") and tag in ("svg", "path")):
            self._stack.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        walls = set() if tag in _BLOCK else _BLOCK
        if (depth := self._find({tag}, walls)) is not None:
            self._pop(depth)

    def above(self, element: int) -> Iterator[int]:
        """The element and all that it is in, up to the root."""
        while element >= 0:
            yield element
            element = self.parent[element]

    def path(self, element: int) -> tuple[str, ...]:
        tags = []
        while element > 0:
            tags.append(self.tag[element])
            element = self.parent[element]
        return tuple(reversed(tags))


def path_scores(page: _Page, full: list[int]) -> np.ndarray:
    """The fused ratio of each text node in ``full``: that of its path, smoothed along the page."""
    paths: dict[tuple[str, ...], list[float]] = {}
    of = []
    for i in full:
        element, _, text = page.nodes[i]
        sums = paths.setdefault(page.path(element), [0.0, 0.0, 0.0])
        sums[0] += len(text.strip())
        sums[1] += len(_PUNCTUATION.findall(text))
        sums[2] += 1
        of.append(sums)
    length = np.array([s[0] / s[2] for s in of])
    points = np.array([s[1] / s[2] for s in of])

    def smooth(values: np.ndarray) -> np.ndarray:
        padded = np.pad(values, 2, mode="edge")
        return np.convolve(padded, _SMOOTH, mode="valid")

    fused = smooth(length) * (0.1 + smooth(points))
    for sums in {id(s): s for s in of}.values():  # one value for each path
        where = [k for k, s in enumerate(of) if s is sums]
        fused[where] = fused[where].mean()
    return fused


def _mass(page: _Page, full: list[int], fused: np.ndarray) -> dict[int, float]:
    """What the paths over the threshold carry, for each element that holds any."""
    mass: dict[int, float] = {}
    for i, value in zip(full, fused):
        if value >= THRESHOLD * fused.mean():
            element, _, text = page.nodes[i]
            for e in page.above(element):
                mass[e] = mass.get(e, 0.0) + len(text) * value
    return mass


def _drop_named(page: _Page, full: list[int]) -> None:
    """Elements with a listed class or id are aside, unless the content says otherwise.

    Around the article or main element stay those that hold most of the content; so do, in a page without one or
    inside of it, those that hold most of what is there, if the name has other words beside the listed one or if
    they hold all. A paragraph or section of an article, named by a listed word beside others, stays if it holds content.
    """
    mass = _mass(page, full, path_scores(page, full))
    held = {e for i in full for e in page.above(page.nodes[i][0])}
    cores = {e: [x for x in page.above(e) if page.named[x]] for e in sorted(held) if page.tag[e] in ("article", "main")}
    free = [e for e, around in cores.items() if not around]
    stay: set[int] = set()
    if cores and not free:
        core = max(cores, key=lambda e: mass.get(e, 0.0))
        if mass.get(cores[core][-1], 0.0) >= MAJORITY * mass[0]:
            stay.update(page.above(core))
            free = [core]
    if not cores or not free:
        stay.update(e for e, m in mass.items() if m >= MAJORITY * mass[0])
    for e in range(1, len(page.tag)):
        if page.aside[page.parent[e]]:
            page.aside[e] = True
        elif page.named[e] and e not in stay and not page.aside[e]:
            around = [x for x in page.above(e) if x in free]
            whole = mass.get(around[-1], 0.0) if around else 0.0
            most = whole > 0 and mass.get(e, 0.0) >= (MAJORITY if page.named[e] == 1 else 1.0) * whole
            part = bool(around) and page.named[e] == 1 and page.tag[e] in ("p", "section") and e in mass
            page.aside[e] = not (most or part)


def main_text(source: str | None) -> str:
    """The article's text: blocks in page order, one to a line; '' if there is none."""
    page = _Page(source or "")
    full = [i for i, (element, _, text) in enumerate(page.nodes) if not page.aside[element] and text.strip()]
    if not full:
        return ""
    if any(page.named):
        _drop_named(page, full)
        full = [i for i in full if not page.aside[page.nodes[i][0]]]
        if not full:
            return ""
    fused = path_scores(page, full)
    mass = _mass(page, full, fused)
    children: dict[int, list[int]] = {}
    for e in mass:
        children.setdefault(page.parent[e], []).append(e)
    cores = [e for e in mass if page.tag[e] in ("article", "main") and mass[e] >= MAJORITY * mass[0]]
    container = min(cores, default=0)  # elements are numbered as they open: the outermost
    titles: dict[int, int] = {}  # headings with a text below each element
    for element in {page.nodes[i][0] for i in full} if not cores else ():
        title = any(page.tag[e] in _TITLES for e in page.above(element))
        for e in page.above(element) if title else ():
            titles[e] = titles.get(e, 0) + 1
    counted: dict[int, int] = {}
    for i, value in zip(full, fused):
        if value >= THRESHOLD * fused.mean():
            for e in page.above(page.nodes[i][0]):
                counted[e] = counted.get(e, 0) + 1
    while not cores and (
        inner := [e for e in children.get(container, ()) if page.tag[e] in _BLOCK - _LEAF and counted[e] == counted[container] and titles.get(e, 0) == titles.get(container, 0)]
    ):
        container = inner[0]
    inside = {container}
    for e in range(container + 1, len(page.tag)):
        if page.parent[e] in inside:
            inside.add(e)
    blocks: dict[int, list[str]] = {}
    for element, block, text in page.nodes:
        if element in inside and not page.aside[element]:
            blocks.setdefault(block, []).append(text)
    lines = (_GAP.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """The rows with the main text of column ``source`` in ``name``, which replaces a column of that name.

    A null page is an empty one; equal pages give equal texts; other columns stay as they are.
    """
    keep = [c for c in pages.columns if c != name]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source):
            made = pa.array([main_text(t) for t in batch.column(source).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], names=[*keep, name])

    return pages.mapInArrow(run, schema)
