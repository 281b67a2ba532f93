"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each
block (paragraph, heading, list item, ...), with its text, its number of tags
and the elements it lies in.  A line's ratio is its characters per tag; the
ratios are smoothed by a Gaussian kernel over neighbouring lines, and lines
above a threshold, a share of the ratios' standard deviation, are content.

Content lines that lie together form a region.  A region ends where the page
says so, not where a short paragraph dips below the threshold: it is the
page's article (or main) element where there is one, else the innermost element
that holds nearly all characters of the content lines.  Every block of a chosen
region is given, but for what lies in boilerplate: elements that are no running
text (navigation, footers, asides, forms, scripts, styles, ...) or whose class,
id or role names them as menus, sidebars, notices, adverts or comments.  Outside
articles, lines that consist of links and lie below the threshold go too.

Text: character references are decoded; runs of white space inside a block,
line breaks among them, become one space; ends are trimmed; blocks without text
are left out and the others joined by line feeds in page order.

How it runs: pages are mapped in batches without a shuffle; memory is linear in
one page.

Cases: a null or empty page, and one without text, gives the empty string; tags
that are not closed or closed twice, and cut-off pages, are read as browsers do
in the main; a page without any region above the threshold gives its blocks
outside boilerplate; repeated rows give equal results; an empty table gives an
empty result; extra columns do no harm.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import row_slices

#: Lines on each side of a smoothed line, and the kernel's standard deviation.
RADIUS = 3
SIGMA = 1.0
#: The threshold, as a share of the standard deviation of the smoothed ratios.
SHARE = 0.9
#: Share of the content's characters that a region must hold.
HOLDS = 0.9
#: Share of a line's characters inside links from which it is a list of links.
LINKED = 0.6

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br button canvas cite code data datalist del dfn em embed font i iframe img input ins kbd "
    "label map mark meta link noscript object q rp rt ruby s samp script select small span strike strong style sub sup svg "
    "template textarea time tt u var video wbr".split()
)
#: Elements that hold no running text of an article.
BOILERPLATE = frozenset(
    "nav footer aside form script style noscript template head title iframe object embed svg canvas audio video button select "
    "textarea menu dialog datalist map fieldset".split()
)
#: Elements that may stand in a page's head.
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: The start of an element ends the nearest open one of these.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
PARAGRAPH = frozenset(["p"])
#: The search for an open element ends at these.
SCOPE = frozenset("html body table ul ol dl div article main section aside nav header footer form blockquote".split())

#: Words of classes, ids and roles that name boilerplate.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner sponsor sponsored sponsors promo "
    "promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar topbar masthead header "
    "footer sidebar sidebars aside complementary contentinfo search copyright legal disclaimer "
    "notice notices alert alerts cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist respond responses disqus reply replies discussion feedback "
    "share sharing social related recommended recommendations widget widgets".split()
)
#: Those of them that count on elements inside a block.
NAMED_INLINE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo".split())
#: Words of names that tell the text itself, and those that only speak of other parts.
TEXT_WORDS = frozenset("article main content body post entry story text page wrapper container".split())
SPEAKS_OF = frozenset("has no with without is".split())
_TAG_START = re.compile(r"<[A-Za-z/!?]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def is_named(attributes: list[tuple[str, str | None]], words: frozenset[str]) -> bool:
    """Whether a class, id or role names an element as boilerplate, or it is hidden.

    An element that is also named as the text itself ("main-content sidebar-right") is none.
    """
    found = False
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for token in value.split():
                parts = [w.lower() for w in _WORDS.findall(token)]
                if parts and TEXT_WORDS.issuperset(parts):
                    return False
                found = found or (not words.isdisjoint(parts) and SPEAKS_OF.isdisjoint(parts))
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return found


class Line(NamedTuple):
    """A block: its text, tags, characters inside links, innermost element, and whether it is boilerplate."""

    text: str
    tags: int
    linked: int
    element: int
    boilerplate: bool


class Open(NamedTuple):
    """An open element: its name, innermost block, whether that block is boilerplate, and whether it is itself."""

    name: str
    block: int
    block_boilerplate: bool
    boilerplate: bool


class LineParser(HTMLParser):
    """The lines of a page, and its block elements' parents and names, from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.names = [-1], [""]
        self.stack = [Open("", 0, False, False)]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.lines.append(Line(text, self.tags, self.linked, top.block, top.block_boilerplate))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop().name] -= 1

    def close_if_open(self, names: frozenset[str]) -> None:
        if not any(self.open.get(n) for n in names):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.stack[depth].name
            if name in names:
                return self.close_to(depth)
            if name in SCOPE:
                return

    def handle_starttag(self, tag, attrs):
        inline = tag in INLINE
        if not inline:
            self.end_line()
            if self.open.get("head") and tag not in IN_HEAD:
                self.close_to(next(d for d, o in enumerate(self.stack) if o.name == "head"))
            self.close_if_open(PARAGRAPH)
            if tag in ENDS:
                self.close_if_open(ENDS[tag])
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag not in VOID:
            top = self.stack[-1]
            boilerplate = top.boilerplate or self.is_boilerplate(tag, attrs, inline)
            if inline:
                entry = Open(tag, top.block, top.block_boilerplate, boilerplate)
            else:
                entry = Open(tag, len(self.parents), boilerplate, boilerplate)
                self.parents.append(top.block)
                roles = [v for k, v in attrs if k == "role" and v in ("main", "article")]
                self.names.append(roles[0] if roles else tag)
            self.stack.append(entry)
            self.open[tag] = self.open.get(tag, 0) + 1

    def is_boilerplate(self, tag, attrs, inline: bool) -> bool:
        if tag in ("html", "body"):
            return False
        if tag == "header" and not (self.open.get("article") or self.open.get("main")):
            return True
        return tag in BOILERPLATE or bool(attrs) and is_named(attrs, NAMED_INLINE if inline else NAMED)

    def handle_startendtag(self, tag, attrs):
        if tag not in BOILERPLATE:  # elsewhere the slash means nothing
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        inline = tag in INLINE
        if not inline:
            self.end_line()
        if self.open.get(tag):
            depth = len(self.stack) - 1
            while self.stack[depth].name != tag:
                if inline and self.stack[depth].name not in INLINE:
                    return
                depth -= 1
            self.close_to(depth)

    def handle_data(self, data):
        top = self.stack[-1]
        if top.boilerplate and not top.block_boilerplate:
            return  # inside the block, but no text of it
        self.parts.append(data)
        if self.open.get("a"):
            self.linked += len(data)

    def parse_comment(self, i, report=1):
        end = self.rawdata.find("-->", i + 4)
        return len(self.rawdata) if end < 0 else end + 3  # a comment without end takes the rest

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)  # "<![...": browsers take it for a comment


def page_lines(html: str) -> LineParser:
    parser = LineParser()
    cut_off = _TAG_START.search(html, html.rfind(">") + 1)  # a tag that the page ends in
    parser.feed(html[: cut_off.start()] if cut_off else html)
    parser.close()
    parser.end_line()
    return parser


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian mean over neighbouring lines; at the ends over those that exist."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    both = [np.convolve(x, kernel)[radius : radius + len(x)] for x in (ratios, np.ones(len(ratios)))]
    return both[0] / both[1]


def content_lines(lines: list[Line]) -> np.ndarray:
    """Whether a line's smoothed ratio reaches the threshold and the line is no boilerplate."""
    ratio = smoothed(np.array([len(x.text) / max(x.tags, 1) for x in lines], float))
    return (ratio >= SHARE * ratio.std()) & ~np.array([x.boilerplate for x in lines], bool)


def _outermost(parser: LineParser, name: str) -> list[int]:
    """For each element the outermost one of this name that it lies in, or -1."""
    found = [-1] * len(parser.parents)
    for e in range(1, len(found)):
        above = found[parser.parents[e]]
        found[e] = above if above >= 0 else e if parser.names[e] == name else -1
    return found


def _holding(parser: LineParser, content: list[Line]) -> list[bool]:
    """Whether each element lies in the innermost one, with further blocks inside, that holds nearly all characters of the content."""
    weight = [0] * len(parser.parents)
    nested = set(parser.parents)
    for x in content:
        weight[x.element] += len(x.text)
    for e in range(len(weight) - 1, 0, -1):  # an element comes after its parent
        weight[parser.parents[e]] += weight[e]
    region = max((e for e, w in enumerate(weight) if w >= HOLDS * weight[0] and e in nested), default=0)  # they lie in each other
    inside = [False] * len(weight)
    for e in range(region, len(weight)):
        inside[e] = e == region or inside[parser.parents[e]]
    return inside


def region_lines(parser: LineParser) -> list[str]:
    """The texts of the lines of the chosen regions."""
    lines = parser.lines
    kept = [i for i, x in enumerate(lines) if not x.boilerplate]
    if not kept:
        return []
    content = content_lines(lines)
    for name in ("article", "main"):
        outermost = _outermost(parser, name)
        size: dict[int, int] = {}
        for i in kept:
            e = outermost[lines[i].element]
            if e >= 0:
                size[e] = size.get(e, 0) + len(lines[i].text)
        if size:
            chosen = {outermost[lines[i].element] for i in kept if content[i]} - {-1}
            chosen = chosen or {max(size, key=size.get)}
            return [lines[i].text for i in kept if outermost[lines[i].element] in chosen]
    if not content.any():
        return [lines[i].text for i in kept]
    inside = _holding(parser, [lines[i] for i in kept if content[i]])
    is_list = lambda x: x.linked >= LINKED * len(x.text)
    return [lines[i].text for i in kept if inside[lines[i].element] and (content[i] or not is_list(lines[i]))]


def main_text(html: str | None) -> str:
    return "\n".join(region_lines(page_lines(html or "")))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: page_id, the columns ``keep``, text."""
    picked = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).alias("html"))
    out = picked.drop("html").schema.add("text", "string")

    def work(batches):
        for b in row_slices(batches, 64):
            texts = pa.array([main_text(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*b.schema.names[:-1], "text"])

    return picked.mapInArrow(work, out)


def with_length(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("n_chars", F.char_length("text").cast("long"))
