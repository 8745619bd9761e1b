"""Main text of web pages, by differencing pages that are neighbours in their site.

A page is read into lines, one for each block of text, without scripts, styles,
forms, hidden parts and whatever its markup names as menu, header, footer,
sidebar, notice, advert or comments. Within a host pages are ordered by the path
of their URL, and each is compared with the nearest others: the lines of both are
aligned by longest common subsequence, and lines that they share are taken as
the site's, not the page's.

What the page's markup itself calls the article is only doubted with more
evidence, as articles quote each other and are copied: there a line must be
shared with all neighbours, three at least, and a neighbour that has over half of
the article is a copy and isn't asked.

Lines are aligned by 64-bit hashes, so texts aren't moved to find neighbours.
Pages are numbered in the order of (host, path) by a range sort, cut into blocks
of neighbours, and each block also gets the few pages beyond its ends; a host of
any size is spread over blocks. The lines to delete go back to their page by the
hash of its row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pumpwatch.llm.common import configure, work_dir

#: Pages compared on either side.
NEAR = 2
#: Pages of a block of neighbours.
BLOCK_PAGES = 256
#: Bits of a table of alignment; larger ones are cut in halves.
TABLE_BITS = 1 << 27

# Fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
          "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: An open element of the right-hand side ends where one of the left begins.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
             "option": {"option"}, "optgroup": {"option", "optgroup"}}
#: Elements that keep an end from reaching beyond them.
WALLS = {"table", "td", "th", "ul", "ol", "dl", "select", "html", "body"}
#: A paragraph ends where any of these begins.
ENDS_P = BLOCKS - {"caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "frameset"}

#: Elements that are never part of an article.
NEVER = {"head", "nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "template", "svg", "math", "canvas", "audio",
         "video", "object", "datalist", "fieldset", "search"} | RAW
#: Words that name such parts where a class or role begins or ends with one, or an id of a container.
NAMES = {"ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "banners", "breadcrumb",
         "breadcrumbs", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer",
         "disqus", "footer", "gdpr", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
         "notices", "pager", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "search",
         "share", "sharing", "sidebar", "sidebars", "sidenav", "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe",
         "subscription", "toolbar", "topbar", "widget", "widgets"}
#: First words of a class that only says what else there is on the page.
ABOUT = {"has", "with", "without", "no", "is"}
#: Whole names of a container that holds the article.
HOLDERS = {"article", "article-body", "article-content", "articlebody", "content", "entry", "entry-content", "main", "main-content",
           "page-content", "post", "post-body", "post-content", "story", "story-body"}
#: Elements whose names alone say nothing: they hold the whole page, or a line of it.
UNNAMED = {"html", "body", "main"}
LINE_IDS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "a", "span", "li"}

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*)"
                   r"((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _named(name: str) -> bool:
    """Whether a class, id or role names a part that isn't the article's."""
    parts = [p.lower() for p in PARTS.findall(name)]
    return bool(parts) and parts[0] not in ABOUT and (parts[0] in NAMES or parts[-1] in NAMES)


class Lines:
    """The lines of a page that its markup leaves for an article.

    ``doubtful`` where the markup names no article, so that all lines are left
    that aren't in another named part. Of nested names the inner one holds.
    """

    def __init__(self, html: str, named: bool = True) -> None:
        self._text: list[str] = []
        self._level: list[int] = []                        # 2 in an article, 1 in a page's main part
        self._open: list[tuple[str, bool, int]] = []       # element, left out, level inside it
        self._out, self._named, self._now = 0, named, []
        self._read(html)
        best = max(self._level, default=0)
        self.text = [t for t, level in zip(self._text, self._level) if level == best]
        self.doubtful = not best
        if named and not self.text:        # the names misled: a wrapper called like a part of it
            again = Lines(html, named=False)
            self.text, self.doubtful = again.text, again.doubtful

    def _read(self, html: str) -> None:
        at, low = 0, None
        while at < len(html):
            m = TOKEN.search(html, at)
            if not self._out:
                self._now.append(html[at:m.start() if m else len(html)])
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if m[1]:
                self._end(name)
            elif name:
                self._begin(name, _attributes(m[3]))
                if name in RAW:            # up to its end tag, whatever it holds
                    low = html.lower() if low is None else low
                    stop = low.find("</" + name, at)
                    at = len(html) if stop < 0 else stop
        while self._open:
            self._pop()
        self._line()

    def _line(self) -> None:
        text = " ".join(unescape("".join(self._now)).split())
        self._now = []
        if text:
            self._text.append(text)
            self._level.append(self._open[-1][2] if self._open else 0)

    def _begin(self, name: str, attributes: dict[str, str]) -> None:
        if name in ENDS_P:
            self._close({"p"}, BLOCKS - {"p"})
        if name in CLOSED_BY:
            self._close(CLOSED_BY[name], WALLS - CLOSED_BY[name])
        if name in BLOCKS:
            self._line()
        elif name == "br" and not self._out:
            self._now.append(" ")
        if name in VOID:
            return
        names = [*attributes.get("class", "").split(), *attributes.get("role", "").split()]
        if name not in LINE_IDS:
            names += attributes.get("id", "").split()
        level = self._open[-1][2] if self._open else 0
        article = name == "article" or attributes.get("itemprop", "").lower() == "articlebody" or attributes.get("role", "").lower() == "article"
        out = (name in NEVER or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
               or "display:none" in attributes.get("style", "").replace(" ", "").lower()
               or name not in UNNAMED and self._named and any(map(_named, names))
               # a header in an article has its title
               or level < 2 and (name == "header" or name not in UNNAMED and self._named and any(
                   "header" in (p.lower() for p in PARTS.findall(n)) for n in names)))
        if article:
            level = 2
        elif name == "main" or any(n.lower() in HOLDERS for n in names):
            level = max(level, 1)
        self._open.append((name, out, level))
        self._out += out

    def _pop(self) -> str:
        name, out, _ = self._open[-1]
        if name in BLOCKS:
            self._line()
        self._open.pop()
        self._out -= out
        return name

    def _close(self, names: set[str], walls: set[str]) -> None:
        """End the nearest open element of ``names``, if there is one before a wall."""
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] in names:
                while len(self._open) > k:
                    self._pop()
                return
            if self._open[k][0] in walls:
                return

    def _end(self, name: str) -> None:
        if name == "br" and not self._out:
            self._now.append(" ")
        for k in range(len(self._open) - 1, -1, -1):
            here = self._open[k][0]
            if here == name:
                while len(self._open) > k:
                    self._pop()
                return
            if name not in BLOCKS and here in BLOCKS or here in ("td", "th", "table") and name not in CLOSED_BY and name != "table":
                return                     # an end without a beginning

    def hashes(self) -> np.ndarray:
        """Signed 64-bit hashes of the lines."""
        return np.fromiter((xxhash.xxh64_intdigest(t) for t in self.text), np.uint64, len(self.text)).view(np.int64)


def _rows(a: list, b: list) -> list[int]:
    """Bit j of row i tells whether the common subsequence of a[:i] and b doesn't grow with b[j]."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        out.append(v)
    return out


def _grown(v: int, n: int) -> np.ndarray:
    """Lengths of the common subsequence with b[:j], j from 0 to n."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of ``a`` and ``b``, as pairs of positions.

    Rows of the alignment are bit strings. Where all of them would take over
    ``TABLE_BITS``, ``a`` is cut in the middle and ``b`` where the halves' lengths
    add up best.
    """
    both = set(a) & set(b)
    at_a, at_b = ([i for i, x in enumerate(s) if x in both] for s in (a, b))
    x, y = [a[i] for i in at_a], [b[j] for j in at_b]
    out: list[tuple[int, int]] = []

    def cut(a0: int, a1: int, b0: int, b1: int) -> None:
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            out.append((at_a[a0], at_b[b0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((at_a[a1], at_b[b1]))
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            return
        if n > 1 and n * m > TABLE_BITS:
            half = a0 + n // 2
            ahead = _grown(_last(x[a0:half], y[b0:b1]), m)
            back = _grown(_last(x[half:a1][::-1], y[b0:b1][::-1]), m)[::-1]
            split = b0 + int(np.argmax(ahead + back))
            cut(a0, half, b0, split)
            cut(half, a1, split, b1)
            return
        rows, j = _rows(x[a0:a1], y[b0:b1]), m - 1
        for i in range(n - 1, -1, -1):
            while j >= 0 and rows[i] >> j & 1:          # no growth at j: b[j] isn't needed
                j -= 1
            if j < 0:
                break
            if i and not rows[i - 1] >> j & 1:          # already so long without a[i]
                continue
            out.append((at_a[a0 + i], at_b[b0 + j]))
            j -= 1
    cut(0, len(x), 0, len(y))
    return sorted(out)


def _last(a: list, b: list) -> int:
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return v


class Page:
    """What is compared of a page: hashes and sizes of its lines."""

    def __init__(self, key: bytes, host: str, lines: bytes, size: bytes, doubtful: bool) -> None:
        self.key, self.host, self.doubtful = key, host, doubtful
        self.lines = np.frombuffer(lines, np.int64).tolist()
        self.size = np.frombuffer(size, np.int64)

    def site_lines(self, others: list[Page]) -> list[int]:
        """The positions of the lines that are the site's, by what other pages of it share.

        Without an article by markup half of the others must share a line, and others
        that have all lines are copies and aren't asked; in an article all must, three
        at least, and others that have over half of it are copies.
        """
        shared, asked = Counter(), 0
        for o in others:
            same = [i for i, _ in common(self.lines, o.lines)]
            if len(same) == len(self.lines) if self.doubtful else 2 * self.size[same].sum() > self.size.sum():
                continue
            asked += 1
            shared.update(same)
        return sorted(i for i, n in shared.items() if (2 * n >= asked if self.doubtful else n == asked > 2))


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, host, path, html in zip(b["key"], b["host"], b["path"], b["html"]):
            page = Lines(html)
            size = np.fromiter(map(len, page.text), np.int64, len(page.text))
            rows.append((key, host, path, page.hashes().tobytes(), size.tobytes(), page.doubtful))
        yield pd.DataFrame(rows, columns=["key", "host", "path", "lines", "size", "doubtful"])


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of blocks in order; a page is judged once its last neighbour has come."""
    held: list[tuple[int, bool, Page]] = []
    now, judged = None, 0

    def judge(last: bool) -> list[tuple[bytes, bytes]]:
        nonlocal held, judged
        out = []
        while judged < len(held) - (0 if last else NEAR):
            _, own, page = held[judged]
            if own:
                near = held[max(0, judged - NEAR):judged] + held[judged + 1:judged + 1 + NEAR]
                gone = page.site_lines([p for _, _, p in near if p.host and p.host == page.host])
                if gone:
                    out.append((page.key, np.array(gone, np.int32).tobytes()))
            judged += 1
        drop = max(0, judged - NEAR)
        held, judged = held[drop:], judged - drop
        return out

    for b in batches:
        out = []
        for row in b.itertuples(index=False):
            if row.block != now:
                out += judge(True)
                held, judged, now = [], 0, row.block
            held.append((row.place, row.own, Page(row.key, row.host, row.lines, row.size, row.doubtful)))
            out += judge(False)
        yield pd.DataFrame(out, columns=["key", "gone"])
    yield pd.DataFrame(judge(True), columns=["key", "gone"])


def site_lines(pages: DataFrame) -> DataFrame:
    """(key, gone): the lines of each page of ``pages`` (key, host, path, html) that are its site's,
    as packed 32-bit positions; pages without such lines have no row. Equal keys are equal pages."""
    spark = pages.sparkSession
    parsed = pages.mapInPandas(_parsed, "key binary, host string, path string, lines binary, size binary, doubtful boolean")
    folder = work_dir(spark, "page-lines")
    parsed.dropDuplicates(["key"]).write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    order = [F.col("host"), F.col("path"), F.col("key")]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("pid"), (F.monotonically_increasing_id() % (1 << 33)).alias("at"))
    placed.write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    counts = placed.groupBy("pid").agg(F.count("*").alias("n"))         # a row for each partition
    before = counts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))
    placed = placed.join(F.broadcast(before), "pid").withColumn("place", F.col("before") + F.col("at"))
    blocks = F.array_distinct(F.transform(F.array(F.lit(-NEAR), F.lit(0), F.lit(NEAR)),
                                          lambda d: F.floor((F.col("place") + d) / BLOCK_PAGES)))
    spread = placed.select("key", "host", "lines", "size", "doubtful", "place", F.explode(blocks).alias("block")) \
        .withColumn("own", F.floor(F.col("place") / BLOCK_PAGES) == F.col("block"))
    return spread.repartition("block").sortWithinPartitions("block", "place").select(
        "block", "place", "own", "key", "host", "lines", "size", "doubtful").mapInPandas(_compared, "key binary, gone binary")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        b["lines"] = [z.compress("\n".join(Lines(h).text).encode("utf-8", "replace")) for h in b["html"]]
        yield b.drop(columns="html")


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        texts = []
        for lines, gone in zip(b["lines"], b["gone"]):
            text = z.decompress(lines).decode()
            if gone is not None:
                away = set(np.frombuffer(gone, np.int32).tolist())
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
            texts.append(text)
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Lines are joined by a line feed, white space inside a line is one space,
    character references are decoded. A null html is empty, and gives an empty text
    as a page without an article does. Pages without a host (a null or unusual
    url) have no neighbours. Equal rows are one page to their neighbours, and
    all of them are returned; other columns are ignored; an empty table gives no rows.
    """
    configure(pages.sparkSession)
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "url")]
    missing = F.concat(*[F.when(F.col(c).isNull(), "n").otherwise("v") for c in ("page_id", "url")])
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    keyed = pages.select(
        F.unhex(F.md5(F.concat_ws("\n", missing, *shown, html))).alias("key"),
        F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    gone = site_lines(keyed.select("key", "host", "path", "html"))
    packed = keyed.select("key", "page_id", "url", "html").mapInPandas(
        _packed, "key binary, page_id string, url string, lines binary")
    texts = packed.join(gone, "key", "left").select("page_id", "url", "lines", "gone").mapInPandas(
        _kept, "page_id string, url string, text string")
    return texts.select(F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "url", "text",
                        F.char_length("text").cast("long").alias("n_chars"))
