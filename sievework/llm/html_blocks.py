"""Operator 1, HTML extraction by line-block distribution.

Markup is stripped into lines, one a block element. Sums of the lines' lengths over sliding windows of
WINDOW lines show where text begins (a surge: the sum exceeds a threshold, with text in the lines behind)
and ends (a dive: the sum falls to 0); the text between is kept, links included, and so are the lines
before a surge up to a gap of WINDOW lines without text. A line's length is its text outside links.

What the markup says about a line is its weight in these sums:
* Lines in elements that are not the article by their name, role or class (menus, headers, footers,
  sidebars, notices, adverts, forms, reader comments) weigh nothing. A mark is hard if the name says what
  the element is (nav, class=ad, class=reader-comments) and soft if it only has to do with it
  (class=layout-with-sidebar, class=ad-free, a form). A soft mark is dropped where the densest window inside exceeds
  RELEASE times that of all text outside marks, and the threshold: a wrapper of the page is no part of it.
* Lines in a named article or main part weigh a threshold more, and their links count, so each is a surge.
  Text outside it is kept only where its windows exceed RELEASE times the article's densest one, and
  ELSEWHERE thresholds. Windows don't reach over the border of an article.
Outside lines are no gap between lines of one container.

Elements end as HTML implies: a paragraph at the next block, items, rows and cells at the next of their
kind, none across the border of a table cell. A link is an <a>, but for one with a name or id and no href,
which is a place to link to. One that the next <a> or the end of the page finds open ends there or where a
block begins or ends, whichever is first.

An element within a line that is not the article (a button, a marked span) has lines of its own; the text
behind it goes on in the line that it stands in.

Scale: a page is read once, on its own, without a shuffle; time and memory are in proportion to its length,
however its elements nest.

Defined results: null and empty pages give the empty text; broken markup is read as far as it goes (an
open element reaches to the end of what holds it); repeated rows give equal results; extra columns
pass through, but `main_text` and `n_chars` are replaced.
"""

from __future__ import annotations

import bisect
import heapq
import html
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import extended, keeps

WINDOW, THRESHOLD, RELEASE, ELSEWHERE = 3, 86, 2, 4
#: Elements whose text is no text of the page, elements that are not the article,
#: elements that begin a line, and words of classes, ids and roles that mark what is not the article.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title", "select", "canvas", "audio", "video"}
OUTSIDE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "header", "head"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main",
          "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb", "breadcrumbs",
         "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "disqus",
         "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
         "notification", "overlay", "pagination", "pager", "popup", "promo", "promoted", "promotion", "recommended", "related",
         "replies", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
         "toolbar", "widget"}
#: Marks of what readers write, which stay whatever stands beside them; words that say that a class has to do
#: with a mark; words of classes that name the article.
READERS = {"comment", "comments", "commentlist", "disqus", "replies"}
ABOUT = {"with", "has", "no", "without", "free", "enabled", "disabled"}
CONTENT = {"article", "body", "content", "entry", "main", "post", "story", "text"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ARTICLE = {"article", "main"}
READ = {"class", "id", "role", "hidden", "aria-hidden"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = HEADINGS | {"p", "pre", "blockquote", "li", "dt", "dd", "figcaption", "address", "summary"}
WHOLE = {"html", "body"}
#: For elements whose start ends others of a kind, these and what holds them back; the parts of tables.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",)),
        "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",))}
TABLE = {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\"[^\"]*\"|'[^']*'|([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NEXT_A = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_WORD = re.compile(r"[a-z]+")
_NAME = re.compile(r"[^\s]+")
_WITH = re.compile(r"^(?:has|with|no|without)[-_]", re.I)
NONE, SOFT, HARD = 0, 1, 2


class Line:
    """A block's text, how much of it there is and how much outside links, where it stands, and the containers it is in."""

    __slots__ = ("article", "homes", "length", "mark", "outside", "parts", "whole")

    def __init__(self, mark: int, article: bool, homes: tuple[int, ...] = ()):
        self.parts, self.length, self.whole, self.outside, self.mark, self.article, self.homes = [], 0, 0, False, mark, article, homes


class Mark:
    """A marked element: the one around it (-1: none), and whether its mark is hard."""

    __slots__ = ("hard", "up")

    def __init__(self, up: int, hard: bool):
        self.up, self.hard = up, hard


def _name_mark(name: str) -> int:
    """How a class or id marks an element."""
    words = _WORD.findall(name)
    if _WITH.match(name) or MARKS.isdisjoint(words):
        return NONE
    if not ABOUT.isdisjoint(words):
        return SOFT
    if words[0] in READERS or words[-1] in READERS or MARKS.issuperset(words):
        return HARD
    return HARD if words[-1] in MARKS and CONTENT.isdisjoint(words) else SOFT


def _marked(attributes: str) -> tuple[int, bool, bool]:
    """(how the attributes mark what is not the article, whether the role is main, is it a place to link to)."""
    mark, main, href, place, content = NONE, False, False, False, False
    for name, *values in _ATTR.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        href |= name == "href"
        place |= name in ("name", "id")
        if name not in READ:
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HARD, False, place and not href
        for word in _NAME.findall(value):
            main |= name == "role" and word == "main"
            found = _name_mark(word)
            if found == HARD and name == "role":
                return HARD, False, place and not href
            content |= found == NONE and not CONTENT.isdisjoint(_WORD.findall(word))
            mark = max(mark, 3 if found == HARD and not READERS.isdisjoint(_WORD.findall(word)) else found)
    mark = HARD if mark == 3 else min(mark, SOFT) if content else mark
    return mark, main and mark != HARD, place and not href


class _Stack:
    """Open elements, with the places of each name, so that no look goes through the whole of it."""

    def __init__(self):
        # (name, its mark or -1, is it the article, is it a link, the line that goes on behind it, if it is an
        # outside part within a line, its number)
        self.items: list[tuple[str, int, bool, bool, Line | None, int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[tuple[int, str, int]] = []
        #: places of what ends don't reach across: cells of tables, and for implied ends also parts within a line
        self.cells: list[int] = []
        self.bounds: list[int] = []

    def push(self, item: tuple[str, int, bool, bool, Line | None, int]) -> None:
        n, name = len(self.items), item[0]
        self.items.append(item)
        self.at[name].append(n)
        if name in BLOCKS:
            self.blocks.append((n, name, item[5]))
        if name in ("td", "th", "table"):
            self.cells.append(n)
        if name in ("td", "th", "table", "button") or item[4] is not None:
            self.bounds.append(n)

    def pop(self) -> tuple[str, int, bool, bool, Line | None, int]:
        item = self.items.pop()
        n = len(self.items)
        self.at[item[0]].pop()
        for places in (self.cells, self.bounds):
            if places and places[-1] == n:
                places.pop()
        if self.blocks and self.blocks[-1][0] == n:
            self.blocks.pop()
        return item

    def last(self, names, floor: int = -1) -> int:
        """Where the innermost open element of these names is; -1 if none is above the floor."""
        return max((self.at[x][-1] for x in names if self.at[x] and self.at[x][-1] > floor), default=-1)

    def outermost(self, names, floor: int) -> int:
        """Where the outermost open element of these names above the floor is; the height if none is."""
        n = len(self.items)
        for x in names:
            at = self.at[x]
            i = bisect.bisect_right(at, floor)
            if i < len(at):
                n = min(n, at[i])
        return n


def lines_of(page: str) -> tuple[list[Line], list[Mark]]:
    """Strips the markup of a page into lines, and the marked elements that they refer to."""
    lines: list[Line] = []
    marks: list[Mark] = []
    stack = _Stack()
    # loose is the number of open elements <a> without an end before the next <a>; they have the name "<a"
    mark, article, link, loose = -1, 0, 0, 0
    line, count = Line(-1, False, (0,)), 0

    def fresh() -> None:
        nonlocal line
        if line.parts:
            lines.append(line)
        line = Line(mark, article > 0, homes())

    def homes() -> tuple[int, ...]:
        """The block and the one around it, unless that is the whole page and the block no paragraph."""
        found = stack.blocks[-2:]
        if not found:
            return (0,)
        paragraph = found[-1][1] in PARAGRAPHS
        if len(found) == 1:
            return (found[0][2], 0) if paragraph else (found[0][2],)
        return (found[1][2],) if found[0][1] in WHOLE and not paragraph else (found[1][2], found[0][2])

    def text(piece: str) -> None:
        piece = html.unescape(piece)
        if piece:
            line.parts.append(piece)
            size = len("".join(piece.split()))
            line.whole += size
            if not link:
                line.length += size

    def close(n: int) -> None:
        nonlocal mark, article, link, line, loose
        while len(stack.items) > n:
            name, own, art, anchor, rest, _ = stack.pop()
            if own >= 0:
                mark = marks[own].up
            article, link, loose = article - art, link - anchor, loose - (name == "<a")
            if rest is not None:
                fresh()
                line = rest
            elif art and name not in BLOCKS:
                fresh()

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        closing, name, attributes = found.group(1), found.group(2), found.group(3)
        if name is None:
            continue
        name = name.lower()
        count += 1
        cell = stack.cells[-1] if stack.cells else -1
        if closing:
            if loose and name in BLOCKS:
                close(stack.outermost(("<a",), stack.blocks[-1][0] if stack.blocks else -1))
            where = stack.last(("a", "<a") if name == "a" else (name,), -1 if name in TABLE or name in WHOLE else cell)
            if where >= 0:
                close(where)
            if name in BLOCKS or name == "head":
                fresh()
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = over.end() if over else end
            continue
        if name == "body" and stack.at["head"]:
            close(stack.at["head"][-1])
        if name in ENDS:
            kinds, holders = ENDS[name]
            where = stack.last(kinds, max(stack.last(holders), -1 if name in TABLE else cell))
            if where >= 0:
                close(where)
        if name in BLOCKS and stack.at["p"]:
            where = stack.last(("p",), stack.bounds[-1] if stack.bounds else -1)
            if where >= 0:
                close(where)
                fresh()
        if name in HEADINGS and stack.items and stack.items[-1][0] in HEADINGS:
            close(len(stack.items) - 1)
        if name in ("br", "td", "th"):
            line.parts.append(" ")
        floor = stack.blocks[-1][0] if stack.blocks else -1
        if name == "a":
            close(stack.outermost(("a", "<a"), floor))
        elif loose and (name in BLOCKS or name in ("td", "th")):
            close(stack.outermost(("<a",), floor))
        if name in VOID:
            if name == "hr":
                fresh()
            continue
        kind, main, place = _marked(attributes) if attributes else (NONE, False, False)
        anchor = name == "a" and not place
        if name == "a":
            over = _NEXT_A.search(page, at)
            if over is None or not over.group(1):
                name = "<a"
        art = name in ARTICLE or main
        if name in OUTSIDE and not main:
            kind = max(kind, SOFT if name == "form" else HARD)
        if name in WHOLE or art and kind == SOFT:
            kind = NONE
        if kind and name == "header" and article and mark < 0:
            # a header inside the article keeps its headings only
            stack.push(("header", -1, False, False, None, count))
            fresh()
            continue
        art = art and not kind
        own = -1
        if kind:
            marks.append(Mark(mark, kind == HARD))
            own = len(marks) - 1
        rest = line if kind and name not in BLOCKS and name != "head" else None
        stack.push((name, own, art, anchor, rest, count))
        if own >= 0:
            mark = own
        article, link, loose = article + art, link + anchor, loose + (name == "<a")
        if rest is not None:
            line = Line(mark, article > 0)
        elif name in BLOCKS or art:
            fresh()
            if stack.at["header"] and name not in HEADINGS and mark < 0 and article:
                line.outside = True
    close(0)
    fresh()
    return lines, marks


def sums(length: list[int], window: int) -> list[int]:
    """The windows' sums: that of each line and the window - 1 lines behind it."""
    upto = [0, *itertools.accumulate(length)]
    n = len(length)
    return [upto[min(i + window, n)] - upto[i] for i in range(n)]


def runs(length: list[int], window: int, threshold: float) -> list[tuple[int, int]]:
    """(first, end) of the lines between surges and dives."""
    n, total, found, i, last = len(length), sums(length, window), [], 0, 0
    while i < n:
        # a surge: over the threshold at a line of text
        if total[i] <= threshold or length[i] == 0:
            i += 1
            continue
        end = start = i
        # the lines before it that are no gap
        while start > last and total[start - 1] > 0:
            start -= 1
        while length[start] == 0:
            start += 1
        while end < n and total[end] > 0:
            end += 1
        # the dive: the last line of text before the sums fall to 0
        while length[end - 1] == 0:
            end -= 1
        found.append((start, end))
        i = last = end
    return found


def _weight(x: Line) -> int:
    """A line's length as its place in a named article weighs it."""
    return max(x.whole, 1) + THRESHOLD if x.article else x.length


def settle(lines: list[Line], marks: list[Mark]) -> None:
    """Says which lines are outside: those in a mark that isn't dropped."""
    own: dict[int, list[int]] = defaultdict(list)
    for x in lines:
        own[x.mark].append(0 if x.outside else _weight(x))
    densest = [max(sums(own.get(i, []), WINDOW), default=0) for i in range(-1, len(marks))]
    seen, inner, below = densest[0], densest[1:], defaultdict(list)
    for i in range(len(marks) - 1, -1, -1):
        below[marks[i].up].append(i)
        if marks[i].up >= 0 and not marks[i].hard:
            inner[marks[i].up] = max(inner[marks[i].up], inner[i])
    dropped = {-1}
    wait = [(-inner[i], i) for i in below[-1] if not marks[i].hard]
    heapq.heapify(wait)
    while wait and -wait[0][0] > max(THRESHOLD, RELEASE * seen):
        _, i = heapq.heappop(wait)
        dropped.add(i)
        seen = max(seen, densest[i + 1])
        for j in below[i]:
            if not marks[j].hard:
                heapq.heappush(wait, (-inner[j], j))
    for x in lines:
        x.outside |= x.mark not in dropped


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by an empty line."""
    lines, marks = lines_of(page or "")
    kept = [(" ".join("".join(x.parts).split()), x) for x in lines]
    kept = [(t, x) for t, x in kept if t]
    settle([x for _, x in kept], marks)
    # outside lines between lines that share a container are no gap
    inner = [i for i, (_, x) in enumerate(kept) if not x.outside]
    drop: set[int] = set()
    for a, b in itertools.pairwise(inner):
        if b > a + 1 and not set(kept[a][1].homes).isdisjoint(kept[b][1].homes):
            drop.update(range(a + 1, b))
    kept = [x for i, x in enumerate(kept) if i not in drop]
    length = [0 if x.outside else _weight(x) for _, x in kept]
    named = any(x.article and not x.outside for _, x in kept)
    if named:
        dense = max(sums([0 if x.outside or not x.article else x.whole for _, x in kept], WINDOW))
        elsewhere = max(ELSEWHERE * THRESHOLD, RELEASE * dense)
    else:
        elsewhere = min(THRESHOLD, max(sums(length, WINDOW), default=0) // 2)
    chosen: list[str] = []
    # windows don't reach over the border of an article
    for article, part in itertools.groupby(range(len(kept)), lambda i: kept[i][1].article):
        own = list(part)
        for start, end in runs([length[i] for i in own], WINDOW, THRESHOLD if article else elsewhere):
            chosen += [kept[i][0] for i in own[start:end] if not kept[i][1].outside]
    return "\n\n".join(chosen)


@keeps(("html",), ("main_text", "n_chars"))
def extract(pages: DataFrame) -> DataFrame:
    """pages with main_text and n_chars."""
    columns = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            more = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.record_batch([batch.column(c) for c in columns] + more, [*columns, "main_text", "n_chars"])

    return pages.mapInArrow(run, extended(pages, main_text="string", n_chars="bigint"))


def extract_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "main_text", "n_chars").withColumnRenamed("main_text", "text")
