"""Main text of web pages: declared zones of the markup, and differences to the nearest page of the host.

A page is read into lines, one for each block of text. Lines in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are dropped by their markup. Pages of a
host are ordered by URL path and each is paired with the neighbour whose path has the longer common
beginning (of equal ones the earlier); pages of equal lines are copies, and the neighbour of
all of them is the next page before or after that is none. On every page the lines of the two are aligned by
their longest common subsequence; lines that both share are the host's, the others the page's own. Where a page
declares no article, its own lines are the main text. Where it declares some, the differences tell which:
an article or main element with a line of the page's own is the main text, one of shared lines only (teasers,
news boxes, breadcrumbs) is not. Two checks follow. An element so chosen stays whole: two articles may quote the same
passage. And the longest declared element stays even if the nearest page has all of its lines, as that page may be
the longer version of an article; without a nearest page all declared elements stay. An element inside an article
is a part of it.

Null and empty pages, and pages without a line left, have the empty text. A null URL counts as one
empty host and path. Repeated rows and copies of a page each get the same text. Reading a page takes time
and memory in proportion to its length, aligning two pages memory in proportion to their lines. An empty
table gives no rows; columns other than key, URL and page aren't read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from navspark.llm.neighbours import BUCKET, PLACE, in_order

# Elements by what they mean, and words in class, id or role that mark a part of no content.
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "title", "head"}
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button"}
CONTENT = {"article", "main"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
MARKS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget",
}

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_END = re.compile("[>\"']")
_MARK = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def _marked(attributes: str) -> bool:
    return any(w in MARKS for m in _MARK.findall(attributes) for w in _SPLIT.split(m.lower()))


class _Ends:
    """Where a tag ends that begins at a place: at the first `>` outside quotes, else at the first one.

    The ends are found once for the whole page, from its last character back, so reading a page takes
    time in proportion to its length, whatever it holds.
    """

    def __init__(self, page: str):
        self.places = [m.start() for m in _END.finditer(page)]
        self.ends = [-1] * (len(self.places) + 1)
        self.first = [-1] * (len(self.places) + 1)
        after: dict[str, int] = {}
        for i in range(len(self.places) - 1, -1, -1):
            c = page[self.places[i]]
            self.first[i] = self.places[i] if c == ">" else self.first[i + 1]
            if c == ">":
                self.ends[i] = self.places[i]
            else:
                # A value in quotes goes on to the next quote of its kind.
                self.ends[i] = self.ends[after[c] + 1] if c in after else -1
                after[c] = i

    def of(self, at: int) -> int:
        i = bisect_left(self.places, at)
        return self.ends[i] if self.ends[i] >= 0 else self.first[i]


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; comments and declarations have no name."""
    ends, at = _Ends(page), page.find("<")
    while at >= 0:
        after = -1
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            after = close + 3 if close >= 0 else len(page)
            yield at, after, "", False, ""
        elif page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            after = close + 1 if close >= 0 else len(page)
            yield at, after, "", False, ""
        else:
            closing = page.startswith("</", at)
            name = _NAME.match(page, at + 1 + closing)
            close = ends.of(name.end()) if name else -1
            if close >= 0:
                after = close + 1
                yield at, after, name[0].lower(), closing, page[name.end() : close]
        at = page.find("<", after if after >= 0 else at + 1)


def lines_of(page: str) -> list[tuple[int, str]]:
    """Text of each block in page order, with the number of the declared article or main element it lies in, or 0."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    opened: list[tuple[int, bool]] = []  # the element's number, and whether it is in an article
    declared, skipped, depth, at = 0, "", 0, 0
    unclosed: set[str] = set()

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((opened[-1][0] if opened else 0, line))

    for start, stop, name, closing, attributes in tags_of(page):
        if start < at:
            continue
        if not skipped:
            text.append(page[at:start])
        at = stop
        if not name:
            continue
        if skipped:
            if name == skipped and attributes[-1:] != "/":
                depth += -1 if closing else 1
            # An element left open ends where the article begins or ends.
            if depth == 0 or name in CONTENT or name == "body" and closing:
                skipped = ""
                depth = 0
            if skipped or name not in CONTENT:
                continue
        if name in HIDDEN and not closing:
            flush()
            end = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end is None:
                unclosed.add(name)
            at = end.end() if end else (at if name in ("head", "title") else len(page))
            continue
        if name not in INLINE:
            flush()
        if name in CONTENT:
            if closing:
                del opened[-1:]
            elif opened and opened[-1][1]:
                opened.append(opened[-1])
            else:
                declared += 1
                opened.append((declared, name == "article"))
            continue
        own = name in OUTSIDE or name == "header" and not opened
        if not closing and name not in VOID and name not in ("body", "html") and (own or attributes and _marked(attributes)):
            flush()
            skipped, depth = name, 1
    if not skipped:
        text.append(page[at:])
    flush()
    return out


def _growth(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of each beginning of `a` with all of `b`, from one bit row."""
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    masks: dict[int, int] = {}
    for i, line in enumerate(a):
        masks[line] = masks.get(line, 0) | 1 << i
    for line in b:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    zeros = bin(row | 1 << len(a))[3:][::-1].translate({48: 1, 49: 0})
    return [0, *accumulate(map(ord, zeros))]


def common(a: list[str], b: list[str]) -> set[int]:
    """Indexes in `a` of the lines of a longest common subsequence, in memory that grows with the lines only.

    Equal beginnings and ends go first. Then `b` is halved, and `a` cut where the best of both halves
    together is longest; the halves are aligned by themselves.
    """
    number: dict[str, int] = {}
    left, right = ([number.setdefault(x, len(number)) for x in lines] for lines in (a, b))
    out: set[int] = set()
    open_ = [(0, len(left), 0, len(right))]
    while open_:
        i, j, k, m = open_.pop()
        while i < j and k < m and left[i] == right[k]:
            out.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and left[j - 1] == right[m - 1]:
            j, m = j - 1, m - 1
            out.add(j)
        if i == j or k == m:
            continue
        if m - k == 1:
            if right[k] in left[i:j]:
                out.add(left.index(right[k], i, j))
            continue
        half = (k + m) // 2
        head = _growth(left[i:j], right[k:half])
        tail = _growth(left[i:j][::-1], right[half:m][::-1])[::-1]
        cut = max(range(j - i + 1), key=lambda x: head[x] + tail[x])
        open_ += [(i, i + cut, k, half), (i + cut, j, half, m)]
    return out


def main_text(lines: list[tuple[int, str]], other: list[tuple[int, str]] | None) -> str:
    """The lines that the other page doesn't share; of declared articles, those that hold such a line, whole."""
    shared = common([t for _, t in lines], [t for _, t in other]) if other else set()
    own = [(element, line) for i, (element, line) in enumerate(lines) if i not in shared]
    length: dict[int, int] = {}
    for element, line in lines:
        if element:
            length[element] = length.get(element, 0) + len(line)
    if not length:
        return " ".join(line for _, line in own)
    chosen = {element for element, _ in own} | {max(length, key=length.__getitem__)}
    return " ".join(line for element, line in lines if element and element in chosen)


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract(frame: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: key, url, text and n_chars (code points of the text)."""
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    bare = F.regexp_replace(address, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    source = frame.select(
        F.col(f"`{key}`").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(bare, "^[^/?#]*", 0)).alias("__host"),
        F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1).alias("__path"),
    )
    # The page's own key keeps the keys of many pages with one address apart.
    own = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")
    order = F.concat_ws("\x01", "__host", "__path", F.coalesce("url", F.lit("")), own)
    ordered = in_order(source, order, "html", "html")
    kind = source.schema["page_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                yield tuple(c[n][i].as_py() for n in (BUCKET, PLACE, "page_id", "url", "__host", "__path", "html"))

    def told(own: tuple, lines: list, before: tuple | None, after: tuple | None) -> str:
        """The main text, by the page before or after that has the longer common path and is no copy."""
        near = [n for n in (before, after) if n and n[0][0] == own[0] and n[0][4] == own[4]]
        near.sort(key=lambda n: -_alike(n[0][5], own[5]))
        return main_text(lines, near[0][1] if near else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        before: tuple | None = None  # the last page that is no copy of those in hand, with its lines
        held: list[tuple] = []  # copies of one page; they share its lines
        for row in chain(rows(batches), [None]):
            now = None if row is None else (row, lines_of(row[6]))
            same = now and held and held[0][0][0] == row[0] and held[0][0][4] == row[4] and held[0][1] == now[1]
            if not same:
                for own, lines in held:
                    if own[1] == 0:
                        text = told(own, lines, before, now)
                        found.append((own[2], own[3], text, len(text)))
                before, held = (held[-1] if held else None), []
            if now:
                held.append((row[:6], held[0][1] if held else now[1]))
            if len(found) >= 500:
                yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema=arrow)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema=arrow)

    names = ("page_id", "url", "text", "n_chars")
    arrow = pa.schema([("page_id", to_arrow_type(kind)), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return ordered.mapInArrow(run, f"page_id {kind.simpleString()}, url string, text string, n_chars long")


def pages_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(spark.read.parquet(f"{folder}/pages.parquet"))
