"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line's length is that of its text outside links, 0 if it stands
in a menu, header, footer, sidebar, advert, form or the like. Lengths are summed over sliding windows of lines; where the
sums rise from nothing is a surge point, where they fall back to nothing a dive point. The regions between surge and dive
points are kept that are dense enough next to the one with the most text, and what is between them if it is less than they
are. If a page marks its article, the tag is a weight on lines: inside, text in links has a length too, and what is outside
must be denser to be kept, unless most of the text is there.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, importable

#: Elements by their meaning in HTML. What RAW ones hold is not markup; of the others nothing is shown as text.
RAW = frozenset("script style title textarea iframe noscript".split())
UNSEEN = frozenset("template svg math object canvas audio video head select button datalist".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|sponsor(?:ed)?|sidebar|menus?|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|"
    r"cookies?|consent|comments?|disqus|share|sharing|newsletter|subscribe|signup|pagination|pager)(?:$|[\s_-])"
)
#: Words that mark containers only; a paragraph or heading may be about them.
CONTAINER_MARKS = re.compile(
    r"(?:^|[\s_-])(?:promo|side|notices?|replies|respond|social|related|recommended|popup|modal|widget|copyright|legal|toolbar|login|search)(?:$|[\s_-])"
)
#: Elements that hold text, not other blocks.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption pre blockquote legend span a b i em strong small u s q mark code".split())
#: Parts of a class that say how a page is laid out, not what an element holds (has-sidebar, comments-open).
STATES = frozenset("has with without no not is hide show open closed enabled disabled on off".split())
#: With these before it, "header" is that of the article (entry-header).
OWN = frozenset("entry post article story content".split())
#: Fixed value: a container of so many lines or more that holds over three quarters of the text is not marked by its class.
CONTAINER = 3
WINDOW = 3
#: Fixed value: a region is kept whose mean line has this share of that of the region with the most text.
DENSITY = 1 / 8
#: Fixed value: how much more a line counts in a marked article; outside it, a region must be as much denser.
WEIGHT = 16

#: Tags and what is not text; a quotation mark is one only after an equals sign and if another follows.
_ATTRIBUTES = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+|[^>=])*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_SPACE = re.compile(r"\s+")


#: What a start tag ends that stands open without an end tag, and the elements that this does not reach beyond.
_ENDS = {name: (frozenset([name]), frozenset(["ul", "ol", "menu"])) for name in ("li",)}
_ENDS |= {name: (frozenset(["dt", "dd"]), frozenset(["dl"])) for name in ("dt", "dd")}
_ENDS |= {name: (frozenset(["td", "th"]), frozenset(["tr", "table"])) for name in ("td", "th")}
_ENDS |= {"tr": (frozenset(["tr"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset())}
_P = frozenset(["p"]), frozenset("table td th caption button html body".split())
LINK = "a href"
_LINK = frozenset(["a", LINK])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KEEPS_P = frozenset("body html caption tbody td tfoot th thead tr option legend".split())


def _by_class(name: str, value: str, in_article: bool) -> bool:
    for token in value.split():
        parts = re.split("[_-]+", token)
        if len(parts) > 1 and STATES & {parts[0], parts[-1]}:
            continue
        if parts[-1] == "header" and (in_article or OWN & set(parts)):
            continue
        if MARKS.search(token) or name not in TEXTS and CONTAINER_MARKS.search(token):
            return True
    return False


def _marked(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Marked as not the article by what it is to a reader (hidden, a role); by words of its class or id."""
    sure = words = False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            words = words or name not in ("html", "body", "main", "article") and _by_class(name, value, in_article)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            sure = True
        elif key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
            sure = True
    return sure, words


class Line(NamedTuple):
    text: str
    free: int  # length outside links, 0 in what is not the article
    length: int  # in a marked article, links included
    kept: bool  # does not stand in an aside
    article: int  # number of the article that it stands in, negative if that is marked by <main> only, or 0
    heading: bool
    holder: int  # number of the container that it stands in, or 0


class Tag(NamedTuple):
    """An element that stands open."""

    name: str
    aside: bool
    mark: int  # number of its mark if its class marks it, or 0
    article: int  # its number if it is one, or 0
    unseen: bool
    loose: bool  # unseen, without an end tag in the rest of the page
    holds: bool  # a container: it holds other blocks


class _Page:
    """What stands open while a page is read. For each name the places on the stack are kept, so that a tag costs the same
    however many elements stand open; every element is pushed and popped once."""

    def __init__(self, page: str):
        self.page = page
        self.stack: list[Tag] = []
        self.places: dict[str, list[int]] = {}
        self.marks: list[int] = []
        self.articles: list[int] = []
        self.hidden: list[int] = []  # places of unseen elements
        self.holders: list[int] = []
        self.parents = [0]  # of each mark, the mark that it stands in
        self.tops = self.asides = self.links = self.headings = self.containers = 0
        self.ends: dict[str, int] = {}

    def push(self, tag: Tag) -> None:
        self.places.setdefault(tag.name, []).append(len(self.stack))
        if tag.unseen:
            self.hidden.append(len(self.stack))
        self.stack.append(tag)
        self._count(tag, 1)
        if tag.holds:
            self.containers += 1
            self.holders.append(self.containers)
        if tag.mark:
            self.marks.append(tag.mark)
        if tag.article:
            self.articles.append(tag.article)

    def _count(self, tag: Tag, by: int) -> None:
        self.asides += by * tag.aside
        self.links += by * (tag.name == LINK)
        self.headings += by * (tag.name in HEADINGS)

    def cut(self, size: int) -> None:
        """Ends all elements from that place on."""
        while len(self.stack) > size:
            tag = self.stack.pop()
            self.places[tag.name].pop()
            self._count(tag, -1)
            if tag.unseen:
                self.hidden.pop()
            if tag.holds:
                self.holders.pop()
            if tag.mark:
                self.marks.pop()
            if tag.article:
                self.articles.pop()

    def innermost(self, names: frozenset) -> int:
        return max((places[-1] for n in names if (places := self.places.get(n))), default=-1)

    def close(self, names: frozenset, until: frozenset = frozenset()) -> None:
        """Ends the innermost of these, and what stands open inside, unless one of `until` is in between."""
        at = self.innermost(names)
        if at >= 0 and self.innermost(until) < at:
            self.cut(at)

    def end_of(self, name: str, at: int) -> re.Match | None:
        """The next end tag from `at` on. Places only rise, so what was found once is not looked for again."""
        known = self.ends.get(name, 0)
        if known < 0:
            return None
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.page, max(at, known))
        self.ends[name] = found.start() if found else -1
        return found


def lines(page: str) -> list[Line]:
    """The text of each block in page order."""
    found: list[tuple[Line, int]] = []  # with the mark that it stands in
    state, parts, free = _Page(page), [], 0

    def flush() -> None:
        nonlocal free
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            mark, article, holder = (x[-1] if x else 0 for x in (state.marks, state.articles, state.holders))
            found.append((Line(text, free, 0, not state.asides, article, state.headings > 0, holder), mark))
        parts.clear()
        free = 0

    def text(raw: str) -> None:
        nonlocal free
        if not state.hidden:
            parts.append(raw)
            if not state.links:
                free += len(raw.strip())

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        block = name in BLOCKS
        if block:
            flush()
            if state.hidden:
                _show(state, name, bool(m[1]))
        elif name == "br":
            text(" ")
        if m[1]:  # an end tag closes what stands open inside; one without a start tag closes nothing
            state.close(_LINK if name == "a" else frozenset([name]))
            continue
        if name in RAW and not m[0].endswith("/>"):
            if end := state.end_of(name, at):
                at = end.end()
            elif name in ("script", "style"):
                break
            else:  # without an end tag: up to the next tag
                after = page.find("<", at)
                at = after if after >= 0 else len(page)
            continue
        if block and name not in _KEEPS_P:  # a paragraph ends where the next block begins
            state.close(*_P)
        if name in _ENDS:
            state.close(*_ENDS[name])
        if name in VOID or m[0].endswith("/>"):
            continue
        if name == "a":  # a link ends where the next one begins; without a target it is none
            state.close(_LINK, BLOCKS)
            name = LINK if any(k.lower() == "href" for k, _ in _ATTRIBUTE.findall(m[3])) else name
        article = name in ("article", "main")
        sure, words = _marked(name, m[3], bool(state.articles)) if m[3] else (False, False)
        if words:
            state.parents.append(state.marks[-1] if state.marks else 0)
        state.tops += article
        unseen = name in UNSEEN
        state.push(
            Tag(
                name,
                name in ASIDE and not (name == "header" and state.articles) or sure,
                len(state.parents) - 1 if words else 0,
                (-state.tops if name == "main" else state.tops) if article else 0,
                unseen,
                unseen and not state.end_of(name, at),
                block and name not in TEXTS and name not in ("html", "body"),
            )
        )
    flush()
    return _judged(found, state.parents)


#: What a select may hold, and where in a drawing there is text.
_OPTIONS = frozenset("option optgroup hr legend".split())
_IN_DRAWING = frozenset("foreignobject desc title".split())


def _show(state: _Page, name: str, end: bool) -> None:
    """A block's tag ends what cannot hold a block, or was never ended: a head, a select, a drawing, what has no end tag."""
    while state.hidden:
        at = state.hidden[-1]
        tag = state.stack[at]
        inside = tag.name in ("select", "datalist") and name in _OPTIONS or tag.name in ("svg", "math") and state.innermost(_IN_DRAWING) > at
        if tag.loose and not (inside and tag.name in ("select", "datalist")) or not end and not inside and tag.name in ("head", "select", "datalist", "svg", "math"):
            state.cut(at)
        else:
            return


def _judged(found: list[tuple[Line, int]], parents: list[int]) -> list[Line]:
    """Lines in asides and in what a class marks have length 0, unless that holds most of the page."""
    counts, sizes = [0] * len(parents), [0] * len(parents)
    for line, mark in found:
        counts[mark] += line.kept
        sizes[mark] += len(line.text) * line.kept
    all_text = sum(sizes)
    for mark in range(len(parents) - 1, 0, -1):  # a mark comes after the one that it stands in
        counts[parents[mark]] += counts[mark]
        sizes[parents[mark]] += sizes[mark]
    out = [False] * len(parents)
    for mark in range(1, len(parents)):
        out[mark] = out[parents[mark]] or not (counts[mark] >= CONTAINER and 4 * sizes[mark] > 3 * all_text)
    judged = []
    for line, mark in found:
        kept = line.kept and not out[mark]
        judged.append(line._replace(free=line.free if kept else 0, length=(len(line.text) if line.article else line.free) if kept else 0, kept=kept))
    return judged


def main_text(page: str | None) -> str:
    found = lines(page or "")
    regions = _regions(found)
    most = max(regions, key=lambda r: (r.free * (WEIGHT if r.article else 1), r.size), default=None)
    if not most:
        return ""

    def dense(r: Region) -> bool:
        if not most.article:  # the tag, if any, stands on something else than the text
            return r.free / r.lines >= DENSITY * most.free / most.lines
        return (r.size * WEIGHT if r.article else r.free / WEIGHT) / r.lines >= DENSITY * most.size / most.lines

    kept = [r for r in regions if r is most or dense(r)]
    chosen: list[str] = []
    for k, r in enumerate(kept):
        first = kept[k - 1].last if k and _bridged(found, kept[k - 1], r) else r.first
        chosen += [x.text for x in found[first : r.last] if x.kept]
    return " ".join(chosen)


def _bridged(found: list[Line], a: Region, b: Region) -> bool:
    """Whether what is between two regions belongs to the body: it is less than they are, or stands in the same container."""
    gap = [x for x in found[a.last : b.first] if x.kept]
    around = {found[a.last - 1].holder, found[b.first].holder} - {0}
    return a.article == b.article and (sum(len(x.text) for x in gap) < a.size + b.size or all(x.holder in around for x in gap))


class Region(NamedTuple):
    """From a surge point to its dive point."""

    first: int
    last: int  # the line after
    size: int
    free: int  # outside links
    lines: int  # with a length
    article: int


def _regions(found: list[Line]) -> list[Region]:
    """The regions in page order; where an article begins or ends, a region does too."""
    half, out, begin, taken = WINDOW // 2, [], 0, 0
    while begin < len(found):
        top, end = found[begin].article, begin
        while end < len(found) and found[end].article == top:
            end += 1
        lengths = [x.length for x in found[begin:end]]
        sums = [sum(lengths[max(0, k - half) : k + half + 1]) for k in range(len(lengths))]
        start = None
        for k, total in enumerate([*sums, 0]):
            if total and start is None:  # surge
                start = k
            elif not total and start is not None:  # dive
                own, n = found[begin + start : begin + k], sum(x > 0 for x in lengths[start:k])
                first, taken = _edges(found, begin + start, begin + k, max(begin, taken))
                out.append(Region(first, taken, sum(lengths[start:k]), sum(x.free for x in own), n, top))
                start = None
        begin = end
    return out


def _edges(found: list[Line], first: int, last: int, floor: int) -> tuple[int, int]:
    """A region reaches from its first line with a length to its last, with the headings right before it."""
    while first < last and not found[first].length:
        first += 1
    while first < last and not found[last - 1].length:
        last -= 1
    while first > floor and found[first - 1].kept and found[first - 1].heading:
        first -= 1
    return first, last


def html_extract(df: DataFrame, *, html_col: str = "html") -> DataFrame:
    """record (a struct of all columns of df but the html, so that no name can clash) and text: the main text, empty if there
    is none. A null html counts as empty; equal pages give equal texts; an empty table gives an empty one. A page is read
    once from its start to its end, so that a very long one costs time and memory in proportion to its length."""
    importable(df.sparkSession)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text)

    others = [col(c) for c in df.columns if c != html_col]
    return df.select(F.struct(*others).alias("record"), extract(F.coalesce(col(html_col), F.lit(""))).alias("text"))
