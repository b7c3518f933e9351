"""Main text of web pages: a page's own blocks, less the lines that its neighbour shares.

A page's markup is read in order into blocks (paragraphs, headings, list items, cells and other block elements), and
every block gets a standing from the elements it is in:

* out - inside navigation, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles, reader
  comments and the like, by element, role, class or id (inside an article a word of FURNITURE in a class or id counts
  only if it is the whole name or stands in a compound with COMPANIONS, and headings count by element or role alone);
* in - inside the article (an `article` element, or `main` where there is none), and not out;
* doubtful - in, but inside an element whose class or id has a word of FURNITURE, not one of HEADS, in another compound;
* open - anywhere else. What is open on a page that has an article is not its text, but is still compared.

Nearest-URL page differencing: all pages are sorted by host and URL path, and each is paired with its neighbour on the
same host, the one before or after it that shares the longer path prefix. The lines of the two that are not out are
aligned by longest common subsequence, and the lines they share are deleted: menus, slogans and other furniture recur,
the text does not. Standing settles what alignment can't: lines that are in, and not doubtful, stay, so mirrored articles
and sentences that two articles share stay whole; doubtful and open lines go if they are shared.

Copies are no evidence of furniture. Two pages are alike if the lines they share have LIKE of the characters of the
shorter one (copies, mirrors, print views; rows of one page_id too). Pages that follow each other and are alike form a
run, and a page's neighbours are the pages before and after its run. A page without an unlike page beside its run on its
host keeps its text whole.

Pages are read twice: once for the marks of their lines (64-bit hashes), which alone are sorted and compared, and once
for their text, from which the places found are taken; texts are shuffled only if those places are more than a broadcast
holds. The order is a range partitioning, so a host with a third of all pages is spread over many tasks; only the runs at
the two edges of a range look beyond it, through a table with a row for each range.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones dropped,
and the rest joined by a newline in page order.

Defined cases: null or empty html gives ""; unclosed and misnested elements are closed as browsers do for block
elements; truncated markup (an open tag or comment at the end) ends the page; a null or unusual URL counts as host "";
repeated rows each get a row, and a page is never paired with a row of its own page_id; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import clashing, cut, keys, longs

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template head title svg math iframe object canvas audio video map select button textarea".split())
OUT = frozenset("nav header footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id (split at case changes, digits and signs) that mark what is not the article's text.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that may stand beside one of FURNITURE in the name of an element inside an article that is not its text.
COMPANIONS = frozenset(
    "area articles bar block body bottom box btn button buttons container content count entries form global group icon icons inline inner item items left link links list main module more nav outer page panel post posts right row section site stories "
    "story tag thread title tools top wrap wrapper".split()
)
HEADS = frozenset(["header", "masthead"])
#: A header inside an article is its own, unless it names one of these.
SITE = frozenset("global menu nav navbar navigation site top".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: An element that ends an open one, as in browsers.
ENDS = {"li": {"li"}, "p": BLOCKS, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
OPEN, IN, DOUBTFUL = 0, 1, 2
LIKE = 0.9


def furniture(name: str) -> bool:
    """Whether a class or id names furniture inside an article."""
    words = {w.lower() for w in _WORDS.findall(name)}
    if not words & FURNITURE or not words <= FURNITURE | COMPANIONS | SITE:
        return False
    return bool(words & SITE) if words & HEADS else True


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # element, depth of articles, out, doubtful
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.text: list[str] = []
        self.now = (0, 0, False, False)

    def block(self) -> None:
        line = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        if line:
            self.lines.append((line, *self.now[1:]) if self.stack else (line, 0, False, False))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS or tag == "body":
            self.block()
            while self.stack and self.stack[-1][0] == "head":
                self.pop()
            while self.stack and tag in ENDS.get(self.stack[-1][0], ()):
                self.pop()
            if tag not in ("li", "td", "th", "tr", "dt", "dd", "option"):
                # inline elements left open in a paragraph don't keep it open
                at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] in BLOCKS), -1)
                if at >= 0 and self.stack[at][0] == "p":
                    while len(self.stack) > at:
                        self.pop()
        if tag in VOID:
            return
        _, article, out, doubt = self.now if self.stack else (0, 0, False, False)
        article += (2 if tag == "article" else 1) if tag in ("article", "main") else 0
        named = dict(attrs)
        own = tag in NEVER or tag in OUT and not (tag == "header" and article) or (named.get("role") or "").lower() in ROLES
        own = own or "hidden" in named or (named.get("aria-hidden") or "").lower() == "true"
        if not own and tag not in ("html", "body", "article", "main"):
            names = [x for k in ("class", "id") if named.get(k) for x in named[k].split()]
            words = {w.lower() for x in names for w in _WORDS.findall(x)} & FURNITURE
            if article:
                own = tag not in HEADINGS and any(map(furniture, names))
                doubt = doubt or tag not in HEADINGS and bool(words - HEADS)
            else:
                own = bool(words)
        self.stack.append((tag, article, out or own, doubt))
        self.now = (0, article, out or own, doubt)

    def pop(self) -> None:
        tag, *_ = self.stack.pop()
        self.now = (0, *self.stack[-1][1:]) if self.stack else (0, 0, False, False)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.block()
        if any(s[0] == tag for s in self.stack):
            if tag not in BLOCKS and any(s[0] in BLOCKS for s in self.stack[max(i for i, s in enumerate(self.stack) if s[0] == tag) :]):
                return  # an inline element doesn't close the blocks inside it
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        if not (self.stack and self.now[2]):
            self.text.append(data)


def blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, OPEN, IN or DOUBTFUL) of the blocks that are not out. Without an article, what main holds is in."""
    if not html:
        return []
    page = _Page()
    page.feed(html)
    if page.rawdata and page.rawdata.lstrip()[:1] != "<":
        page.close()  # text is left; markup that breaks off is not text
    page.block()
    top = max((a for _, a, out, _ in page.lines if not out), default=0)
    inside = 2 if top >= 2 else 1
    return [(line, (DOUBTFUL if doubt else IN) if article >= inside else OPEN) for line, article, out, doubt in page.lines if not out]


def text_lines(found: list[tuple[str, int]]) -> tuple[list[str], list[int]]:
    """The lines of a page's text before differencing, and for each of its blocks the place of its line among them if it
    may be deleted, else -1."""
    article = any(standing != OPEN for _, standing in found)
    lines, at = [], []
    for line, standing in found:
        mine = standing != OPEN or not article
        at.append(len(lines) if mine and standing != IN else -1)
        if mine:
            lines.append(line)
    return lines, at


def common_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b (Hunt and Szymanski: by matches, not by the full table)."""
    import bisect

    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    last: list = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect.bisect_left(ends, j)
            node = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    out, node = set(), last[-1] if last else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A mark for every line of a page that is not out, its size, and its place in the text if it may be deleted."""
    import xxhash

    for b in batches:
        marks, sizes, places = [], [], []
        for html in b["html"]:
            found = blocks(html)
            marks.append([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63 for x, _ in found])
            sizes.append([len(x) for x, _ in found])
            places.append(text_lines(found)[1])
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "row": b["row"], "marks": marks, "sizes": sizes, "places": places})


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"page_id": longs(b["page_id"]), "url": b["url"], "row": b["row"], "lines": [text_lines(blocks(html))[0] for html in b["html"]]})


def _evidence(page: str | None, marks: list, sizes: list, other) -> set[int] | None:
    """Places of the lines that a page shares with another one, or None if the two are alike."""
    if other["page_id"] is None or other["page_id"] == page or list(other["marks"]) == marks:
        return None
    shared = common_lines(marks, list(other["marks"]))
    return None if sum(sizes[i] for i in shared) >= LIKE * min(sum(sizes), sum(other["sizes"])) else shared


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether each page goes on with the run of the one before it."""
    for b in batches:
        like = []
        for page, host, marks, sizes, other in zip(b["page_id"], b["host"], b["marks"], b["sizes"], b["previous"], strict=True):
            like.append(other is not None and other["host"] == host and _evidence(page, list(marks), list(sizes), other) is None)
        yield b.assign(like=like)


def _differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places in its text of the lines that a page shares with its neighbour and that may be deleted."""
    import os.path

    for b in batches:
        out = []
        for page, host, path, marks, sizes, places, *sides in zip(b["page_id"], b["host"], b["path"], b["marks"], b["sizes"], b["places"], b["before"], b["after"], strict=True):
            gone: list[int] = []
            sides = [x for x in sides if x is not None and x["host"] == host]
            for near in sorted(sides, key=lambda x: -len(os.path.commonprefix([x["path"], path]))):  # the one before, if both share as much
                shared = _evidence(page, list(marks), list(sizes), near)
                if shared is not None:
                    gone = [int(places[i]) for i in sorted(shared) if places[i] >= 0]
                    break
            out.append(gone)
        yield pd.DataFrame({"page_id": b["page_id"], "row": b["row"], "gone": out})


def differenced(pages: DataFrame) -> DataFrame:
    """page_id, row, gone of each row of pages(page_id, url, row, marks, sizes, places): which lines of its text go."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    lines = pages.select("page_id", "url", "row", host.alias("host"), path.alias("path"), "marks", "sizes", "places")
    by = ["host", "path", "url", "page_id", "row"]
    # ranges of the sorted pages, of even size whatever a host's share; then the page before, within and across ranges
    lines = cut(lines.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "lines")
    order, back = Window.partitionBy("part").orderBy(*by), Window.partitionBy("part").orderBy(*[F.desc(c) for c in by])
    row = F.struct("page_id", "host", "path", "marks", "sizes")
    ranges, down = Window.orderBy("part"), Window.orderBy(F.desc("part"))  # a row a range
    ends = lines.groupBy("part").agg(F.max_by(row, F.struct(*by)).alias("end"))
    ends = ends.select("part", F.lag("end").over(ranges).alias("end"))
    near = lines.withColumn("previous", F.lag(row).over(order))
    near = near.where("previous IS NOT NULL").unionByName(near.where("previous IS NULL").drop("previous").join(ends, "part").withColumnRenamed("end", "previous"))
    schema = near.schema.simpleString()[len("struct<") : -1]
    runs = cut(near.mapInPandas(_runs, schema + ",like:boolean"), "runs")
    # wrapped, as the page before a run may be none
    begins = F.when(~F.col("like"), F.struct(F.col("previous").alias("page")))
    runs = runs.withColumns({
        "before": F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.last(F.when(~F.col("like"), row), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
    })
    edge = runs.groupBy("part").agg(F.max_by("before", F.struct(*by)).alias("b"), F.min_by(row, F.struct(*by)).alias("head"), F.min_by("like", F.struct(*by)).alias("on"), F.min_by("after", F.struct(*by)).alias("a"))
    edge = edge.select(
        "part",
        F.last("b", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("b"),
        F.last(F.when(F.col("on"), F.col("a")).otherwise(F.col("head")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("a"),
    )
    inner = runs.where("before IS NOT NULL AND after IS NOT NULL")
    outer = runs.where("before IS NULL OR after IS NULL").join(edge, "part").withColumns({"before": F.coalesce("before", "b"), "after": F.coalesce("after", "a")})
    both = inner.unionByName(outer.select(*inner.columns)).withColumn("before", F.col("before.page"))
    return both.select("page_id", "row", "host", "path", "marks", "sizes", "places", "before", "after").mapInPandas(_differ, "page_id string, row long, gone array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html)."""
    pages = keys(clashing(pages, ["page_id", "url", "html"]), "page_id").withColumn("row", F.xxhash64("page_id", "url", "html"))
    # written, as sampling the order would read all pages once more
    marked = cut(pages.mapInPandas(_marks, "page_id string, url string, row long, marks array<long>, sizes array<int>, places array<int>"), "marks")
    gone = differenced(marked).where(F.size("gone") > 0)
    # rows that repeat have the same neighbours and lose the same lines; the table's size tells Spark how to join
    gone = cut(gone.groupBy(F.coalesce("page_id", F.lit("")).alias("g_id"), F.col("row").alias("g_row")).agg(F.first("gone").alias("gone")), "shared-lines")
    read = pages.mapInPandas(_lines, "page_id long, url string, row long, lines array<string>")
    same = (F.coalesce(F.col("page_id").cast("string"), F.lit("")) == F.col("g_id")) & (F.col("row") == F.col("g_row"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("gone", i)))
    out = read.join(gone, same, "left").select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
