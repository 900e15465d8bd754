"""Main text of web pages by nearest-URL page differencing.

Pages of one host are put in order of their URL path; each is paired with the neighbour of other
content whose path shares more with its own. The text lines of both are aligned by a longest common
subsequence, and lines that both have are what the site puts on every page: they are deleted, inside
an ``article`` or ``main`` element too. A pairing that would delete nearly all of a page is one with a
near copy: then the other neighbour decides, or none. Markup is the other vote: containers that name
themselves (navigation, header, footer, form, advert, comments ...) are left out before, and lines
outside of the page's ``article`` or ``main`` elements are left out, unless more of the lines that are
the page's alone stands there than inside.

Only hashes of lines are stored, sorted and paired; equal pages of a host are one entry and share the result.

Defined results: null and empty html, and pages without text of their own, give the empty string; a
null or broken url is a host of its own and its pages are paired by what path there is; a page
without a neighbour of other content on its host is decided by markup alone; pages are read whole; an
empty table gives an empty result; columns other than key, url and html stay out.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idsieve.llm.shared import removed, written
from idsieve.llm.tokens import blocks

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select option "
                   "textarea button datalist".split())
#: Containers that are not the article.
CHROME = frozenset("nav aside footer form dialog menu header".split())
OWN = frozenset(("article", "main"))
CONTAINERS = CHROME | OWN | frozenset("div section ul ol dl table figure fieldset details center td th span body".split())
BLOCKS = CONTAINERS - {"span"} | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption pre blockquote address hr "
                                           "figcaption summary legend tbody thead tfoot html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog".split())
#: Words in class or id that name a container as not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|header|masthead|topbar|footer|copyright|comments?|commentlist|replies"
    r"|respond|disqus|related|recommended|share|sharing|social|newsletter|subscribe|login|signup|search|pagination|pager"
    r"|toolbar|skip)(?:$|[\s_-])", re.I)
#: Words that, as a whole class or id, name an article that is not the page's.
ASIDE = frozenset("comment comments reply replies related recommended teaser promo sponsored ad advert".split())
#: Fixed value: a pairing that would delete this share of a page's characters is one with a near copy.
COPY = 0.9
SPACE = re.compile(r"\s+")


class Reader(HTMLParser):
    """Blocks of a page as (text, whether it stands in an article or main element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.out: list[tuple[str, bool]] = []
        self.text: list[str] = []
        self.silent = self.dropped = self.own = 0

    def end_block(self) -> None:
        if self.text:
            line = SPACE.sub(" ", "".join(self.text)).strip()
            if line:
                self.out.append((line, self.own > 0))
            self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
            self.stack.append((tag, False))
            self.end_block() if tag in BLOCKS else None
            return
        if tag in BLOCKS:
            self.end_block()
        elif tag in ("br", "wbr", "img"):
            self.text.append(" " if tag == "br" else "")
        if tag not in CONTAINERS:
            return
        a = dict(attrs)
        names = f"{a.get('class') or ''} {a.get('id') or ''}"
        named = tag == "article" and not ASIDE.isdisjoint(names.lower().split())
        if tag in OWN and not named and not self.own:
            # A container left open before the article ends where it begins.
            self.stack = [x for x in self.stack if not x[1] and x[0] not in SILENT]
            self.dropped = self.silent = 0
        drop = named or tag not in OWN and (
            (tag in CHROME and not (tag == "header" and self.own)) or a.get("role") in ROLES or "hidden" in a
            or a.get("aria-hidden") == "true" or (tag != "body" and NAMES.search(names) is not None))
        self.stack.append((tag, drop))
        self.dropped += drop
        self.own += tag in OWN

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_block()
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_block()
        if tag not in CONTAINERS and tag not in SILENT:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for name, drop in self.stack[i:]:
                    self.dropped -= drop
                    self.own -= name in OWN
                    self.silent -= name in SILENT
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not self.silent and not self.dropped:
            self.text.append(data)


def read(html: str) -> list[tuple[str, bool]]:
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.end_block()
    return reader.out


def site(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by bit-parallel rows."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # Zero bits of a row mark where the common subsequence grows; walk them back.
    out, j = set(), len(b) - 1
    length = lambda i, j: 0 if i < 0 else (j + 1) - (rows[i] & ((1 << (j + 1)) - 1)).bit_count()
    i = len(a) - 1
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            out.add(i)
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out


def near(path: str, a: dict | None, b: dict | None, host: str) -> list[dict]:
    """The neighbours on the same host, the one whose path shares more leading characters first."""
    found = [x for x in (a, b) if x is not None and x["host"] == host]

    def common(p: str) -> int:
        n = 0
        for x, y in zip(path, p):
            if x != y:
                break
            n += 1
        return n

    return sorted(found, key=lambda x: -common(x["path"]))


def kept(lines: list[dict], others: list[list[int]]) -> list[bool]:
    """Which lines (h, size, own) are the page's text, given the lines of its neighbours, nearest first."""
    own, sizes, hashes = [x["own"] for x in lines], [x["size"] for x in lines], [x["h"] for x in lines]
    for other in others:
        gone = shared_lines(hashes, other)
        if sum(sizes[i] for i in gone) < COPY * sum(sizes):
            stay = [i not in gone for i in range(len(lines))]
            inside = sum(n for n, o, k in zip(sizes, own, stay, strict=True) if k and o)
            if any(own) and 2 * inside >= sum(n for n, k in zip(sizes, stay, strict=True) if k):
                stay = [k and o for k, o in zip(stay, own, strict=True)]
            return stay
    return own if any(own) else [True] * len(lines)


MARKS = pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int32()), ("own", pa.bool_())]))


def mark(lines: list[tuple[str, bool]]) -> list[dict]:
    """(h, size, own) of each line: what pages are paired by."""
    h = np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t, _ in lines], dtype=np.uint64).view(np.int64).tolist()
    return [{"h": x, "size": len(t), "own": o} for x, (t, o) in zip(h, lines, strict=True)]


def content(lines: list[tuple[str, bool]]) -> bytes:
    """Equal for pages of the same lines."""
    return hashlib.md5("\n".join(("+" if o else "-") + t for t, o in lines).encode()).digest()


def packed(lines: list[tuple[str, bool]]) -> bytes:
    """The lines' text, compressed for the exchange. No line holds a line end."""
    return pa.compress("\n".join(t for t, _ in lines).encode(), codec="zstd", asbytes=True)


def unpacked(data: bytes, stay: list[bool]) -> str:
    lines = pa.CompressedInputStream(pa.BufferReader(data), "zstd").read().decode().split("\n")
    return "\n\n".join(t for t, k in zip(lines, stay, strict=True) if k)


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text) of every page.

    Pages are read twice: once for the marks of their lines, which are paired, and once for the text, which is exchanged
    compressed and never stored.
    """
    kind = pages.schema[key].dataType.simpleString()

    def marked(batches):
        for b in batches:
            urls, htmls = b.column(0).to_pylist(), [h or "" for h in b.column(1).to_pylist()]
            for i, j in blocks(htmls):
                found = [(site(u), x) for u, h in zip(urls[i:j], htmls[i:j], strict=True) if (x := read(h))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for (h, _), _ in found], pa.string()), pa.array([content(x) for _, x in found], pa.binary()),
                     pa.array([p for (_, p), _ in found], pa.string()), pa.array([mark(x) for _, x in found], MARKS)],
                    ["host", "content", "path", "lines"])

    def parse(batches):
        for b in batches:
            urls, htmls = b.column(1).to_pylist(), [h or "" for h in b.column(2).to_pylist()]
            for i, j in blocks(htmls):
                lines = [read(h) for h in htmls[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([site(u)[0] for u in urls[i:j]], pa.string()),
                     pa.array([content(x) for x in lines], pa.binary()), pa.array([packed(x) if x else None for x in lines], pa.binary())],
                    ["key", "url", "host", "content", "packed"])

    rows = pages.select(F.col(key).alias("key"), F.col("url").cast("string").alias("url"), "html")
    shapes = rows.select("url", "html").mapInArrow(
        marked, "host string, content binary, path string, lines array<struct<h:long,size:int,own:boolean>>")
    # Pages of the same lines are one entry, at the least of their paths.
    entries = shapes.groupBy("host", "content").agg(
        F.min("path").alias("path"), F.first("lines").alias("lines"))
    order = ["host", "path", "content"]
    table = written(entries.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "page-lines")
    shown = table.withColumn("shown", F.struct("host", "path", F.transform("lines", lambda x: x["h"]).alias("lines")))
    ends = shown.groupBy("part").agg(F.min_by("shown", "pos").alias("first"), F.max_by("shown", "pos").alias("last"))
    across = Window.orderBy("part")
    ends = written(ends.select("part", F.lag("last").over(across).alias("before"), F.lead("first").over(across).alias("after")), "page-ends")
    inside = Window.partitionBy("part").orderBy("pos")
    paired = shown.withColumn("prev", F.lag("shown").over(inside)).withColumn("next", F.lead("shown").over(inside)).join(ends, "part")
    paired = paired.select("host", "content", "path", "lines", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))

    def difference(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                stay = [kept(r["lines"], [x["lines"] for x in near(r["path"], r["prev"], r["next"], r["host"])])
                        for r in part.select(["host", "path", "lines", "prev", "next"]).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(stay, pa.list_(pa.bool_()))], ["host", "content", "stay"])

    votes = written(paired.mapInArrow(difference, "host string, content binary, stay array<boolean>"), "page-votes")
    removed(table, ends)

    def text(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                out = ["" if x is None else unpacked(x, k) for x, k in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["key", "url", "text"])

    parsed = rows.mapInArrow(parse, f"key {kind}, url string, host string, content binary, packed binary")
    found = parsed.join(votes, ["host", "content"], "left").select("key", "url", "packed", "stay")
    return found.mapInArrow(text, f"key {kind}, url string, text string").withColumnRenamed("key", key)
