"""Main text by wrapper induction.

Pages of a host that have the same parts in the same order share a template. Each page's DOM tree is aligned with the
reference page of those by simple tree matching. Nodes whose text stays the same from page to page are
template, those whose text varies are slots; the content slot is the deepest node that
holds most of the varying text of the host's pages, and nodes beside it that have running text of their own on
most pages, as headings and leads have, are slots too. A page's main text is what it has there,
without the parts that are menus, notices and the like wherever they stand.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, written

#: Elements without content; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text; fixed values.
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that a content slot is never inside of; fixed values.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote".split())
#: Start tags that end an open element of these names; fixed values.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for such an element, or for a p, stops; fixed values.
SCOPE = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Elements that are never main text; fixed values.
ASIDE = frozenset("nav footer aside button dialog menu".split())
#: Parts of a class, id or role that say what a block is; fixed values.
SAYS_ASIDE = frozenset(
    "ad ads advert adverts advertisement alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer gdpr menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar".split()
)
#: The same, outside of articles and main parts, where a header isn't the article's own; fixed values.
SAYS_HEADER = frozenset("header masthead topbar".split())
#: Those of them that also name chapters, which have a heading and paragraphs, when an id alone says so inside an article.
NAMES_CHAPTER = frozenset("alert banner breadcrumbs dialog menu nav navigation notification pagination search share sharing social toolbar".split())
#: Parts that only say how a block is laid out; fixed values.
SAYS_LAYOUT = frozenset(
    "area bar block bottom box button buttons col column container content div end first fixed form group holder icon icons inner item items last left link links list main module outer page panel post pre primary region right row secondary section site slot small sticky thread top unit widget widgets wrap wrapper".split()
)
#: Blocks that such words can mark; others are text, whose id is an anchor.
MARKED = frozenset("div section aside ul ol dl table header footer form nav menu article span details dialog figure".split())
#: Descendants that make a block the frame of a page, whatever it is called; a form frames an article too.
FRAMES = frozenset("main h1".split())
#: Headings of chapters.
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Comments; elements whose content is not text of the page, whole; tags with their attributes; declarations.
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>script|style|title|noscript|template|textarea|iframe|object|svg|math|select|canvas|audio|video)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*))?""")
#: What attributes that hide or name a block have in them; only where they are found are attributes told apart.
MAY_HIDE = re.compile(r"hidden|display\s*:\s*none", re.I)
MAY_NAME = re.compile(r"\b(?:class|id|role)\s*=", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


def attributes(rest: str) -> Iterator[tuple[str, str]]:
    """Names in lower case and values of a start tag's attributes."""
    for name, value in ATTRIBUTE.findall(rest):
        yield name.lower(), value.strip("\"'") if value[:1] in "\"'" else value


def hides(rest: str) -> bool:
    """Whether an attribute hides the element; what attributes say about it in their values doesn't."""
    return any(name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and NO_DISPLAY.search(value) for name, value in attributes(rest))


#: Share of a host's varying text that a child must hold to be descended into.
HOLDS = 0.7
#: Share of a host's pages in which a text stands at one node, from which it is template; fewer pages than LEAST_PAGES tell nothing.
CONSTANT, LEAST_PAGES = 0.5, 4


NOTHING, ALWAYS, SAYS, FORM, CHAPTER = range(5)


def says_aside(rest: str, outside: bool) -> tuple[bool, bool]:
    """Whether a class, id or role names an aside: one of its names has an aside's part and else only parts of layout or digits,
    so that share-buttons counts and share-price doesn't. outside: of articles and main parts, where headers count too.
    Also whether ids alone say so, and only with names that chapters have."""
    asides, found, chapter = SAYS_ASIDE | SAYS_HEADER if outside else SAYS_ASIDE, False, not outside
    for key, value in attributes(rest):
        if key not in ("class", "id", "role"):
            continue
        for name in value.split():
            parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if p]
            if any(p in asides for p in parts) and all(p in asides or p in SAYS_LAYOUT for p in parts):
                found, chapter = True, chapter and key == "id" and all(p in NAMES_CHAPTER for p in parts)
    return found, found and chapter


class Page:
    """The tree of a page: tag, parent, children and aside of each node, blocks (node, text), and linked: whether links hold most of a block.

    Asides are hidden blocks, elements that never hold main text, blocks that say so unless a main part or a first heading
    stands inside them (or, where they may be chapters, a heading and mostly paragraphs), and forms unless a main part, a first
    heading or an article does, or half of the text that stands in no other aside."""

    def __init__(self, source: str):
        self.tag, self.parent, self.children = ["#"], [-1], [[]]
        self._mark = [0]  # of each node
        self.blocks: list[tuple[int, str]] = []
        self.linked: list[bool] = []
        self._open, self._live, self._text, self._links = [0], Counter(), [], 0
        at = 0
        for found in TOKEN.finditer(source):
            if found.start() > at:
                self._text.append(source[at : found.start()])
                if self._live["a"]:
                    self._links += found.start() - at
            at = found.end()
            tag = found["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if found["end"]:
                self._end(tag)
            else:
                self._start(tag, found["rest"])
        self._text.append(source[at:])
        self._flush()
        self.aside = self._asides()

    def _asides(self) -> list[bool]:
        n = len(self.tag)
        frames, article, size, aside = [False] * n, [False] * n, [0] * n, [False] * n
        prose, headed = [0] * n, [False] * n
        for node, text in self.blocks:
            size[node] += len(text)
            if self.tag[node] == "p":
                prose[node] += len(text)
        for node in range(n - 1, 0, -1):  # children have higher numbers than their parents
            mark, parent = self._mark[node], self.parent[node]
            told = mark == CHAPTER and not (headed[node] and 2 * prose[node] > size[node])
            aside[node] = mark == ALWAYS or (mark == SAYS or told) and not frames[node]
            if not aside[node]:
                prose[parent] += prose[node]
                headed[parent] |= headed[node] or self.tag[node] in HEADINGS
                frames[parent] |= frames[node] or self.tag[node] in FRAMES
                article[parent] |= article[node] or self.tag[node] == "article"
                size[parent] += size[node]
        for node in range(1, n):
            if self._mark[node] == FORM and not (frames[node] or article[node]) and 2 * size[node] < size[0]:
                aside[node] = True
            aside[node] = aside[node] or aside[self.parent[node]]
        return aside

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                node = next(n for n in reversed(self._open) if n == 0 or self.tag[n] in BLOCK)
                self.blocks.append((node, text))
                self.linked.append(2 * self._links > len(text))
            self._text, self._links = [], 0

    def _close(self, depth: int) -> None:
        self._live.subtract(self.tag[n] for n in self._open[depth:])
        del self._open[depth:]

    def _pop_to(self, names: set[str], scope: set[str]) -> None:
        if not any(self._live[n] for n in names):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            name = self.tag[self._open[depth]]
            if name in names:
                self._flush()
                self._close(depth)
                return
            if name in scope:
                return

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._text.append(" ")
        if tag in BLOCK:
            self._flush()
            self._pop_to({"p"}, {"button", "table", "td", "th", "li", "article", "section", "div", "body", "aside", "nav"} - {"p"})
        if tag in ENDS:
            self._pop_to(ENDS[tag], SCOPE.get(tag, set()))
        node, parent = len(self.tag), self._open[-1]
        self.tag.append(tag)
        self.parent.append(parent)
        self.children.append([])
        self.children[parent].append(node)
        if tag in ASIDE or tag == "header" and not self._within("article", "main") or rest and tag not in ("html", "body") and MAY_HIDE.search(rest) and hides(rest):
            mark = ALWAYS
        elif tag == "form":
            mark = FORM
        else:
            says, chapter = says_aside(rest, not self._within("article", "main")) if rest and tag in MARKED and MAY_NAME.search(rest) else (False, False)
            mark = CHAPTER if chapter else SAYS if says else NOTHING
        self._mark.append(mark)
        if tag not in VOID and not rest.endswith("/"):
            self._open.append(node)
            self._live[tag] += 1

    def _within(self, *tags: str) -> bool:
        return any(self._live[t] for t in tags)

    def _end(self, tag: str) -> None:
        if not self._live[tag]:
            return
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[depth]] == tag:
                if tag in BLOCK:
                    self._flush()
                self._close(depth)
                return
            if tag not in BLOCK and self.tag[self._open[depth]] in BLOCK:
                return

    def shape(self, shapes: dict[tuple, int]) -> list[int]:
        """A number for each node that stands for its subtree's tags, the same for equal subtrees."""
        out = [0] * len(self.tag)
        for node in range(len(self.tag) - 1, -1, -1):
            out[node] = shapes.setdefault((self.tag[node], *(out[c] for c in self.children[node])), len(shapes))
        return out


class Matching:
    """Simple tree matching of pages with one reference; scores of equal pairs of subtrees are remembered.

    A pair of subtrees of one tag scores one and the best sum of scores over matched children in their order. Equal children
    at both ends are matched as they are, which no other matching beats; of the rest a row of scores is made at a time, and
    every so many rows one is kept, from which those between are made again on the way back: whole results in little memory."""

    def __init__(self, reference: Page):
        self.reference, self.shapes, self.scores = reference, {}, {}
        self.shape = reference.shape(self.shapes)
        self.size = [1] * len(reference.tag)
        for node in range(len(reference.tag) - 1, 0, -1):
            self.size[reference.parent[node]] += self.size[node]

    def _known(self, a: int, b: int) -> int | None:
        if self.page.tag[a] != self.reference.tag[b]:
            return 0
        if self.sa[a] == self.shape[b]:
            return self.size[b]
        return self.scores.get((self.sa[a], self.shape[b]))

    def score(self, a: int, b: int) -> int:
        """Of a page's and a reference's node; pairs that it rests on are scored first, on a stack of our own."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is None:
                xs, ys, same = self._rest(x, y)
                missing = [(c, d) for c, d in self._pairs(xs, ys) if self._known(c, d) is None]
                if missing:
                    todo += missing
                    continue
                self.scores[self.sa[x], self.shape[y]] = 1 + same + self._best(xs, ys)
            todo.pop()
        return self._known(a, b)

    def _ends(self, xs: list[int], ys: list[int]) -> tuple[int, int]:
        """How many children are equal at the start and at the end."""
        start, stop, most = 0, 0, min(len(xs), len(ys))
        while start < most and self.sa[xs[start]] == self.shape[ys[start]]:
            start += 1
        while stop < most - start and self.sa[xs[-1 - stop]] == self.shape[ys[-1 - stop]]:
            stop += 1
        return start, stop

    def _rest(self, a: int, b: int) -> tuple[list[int], list[int], int]:
        """Children without the equal ones at both ends, and how much those score."""
        xs, ys = self.page.children[a], self.reference.children[b]
        start, stop = self._ends(xs, ys)
        return xs[start : len(xs) - stop], ys[start : len(ys) - stop], sum(self.size[y] for y in ys[:start]) + sum(self.size[y] for y in ys[len(ys) - stop :])

    def _pairs(self, xs: list[int], ys: list[int]) -> Iterator[tuple[int, int]]:
        """One of each kind of pair with equal tags."""
        kinds_x, kinds_y = {self.sa[x]: x for x in xs}, {self.shape[y]: y for y in ys}
        return ((x, y) for x in kinds_x.values() for y in kinds_y.values() if self.page.tag[x] == self.reference.tag[y])

    def _gains(self, xs: list[int], ys: list[int]) -> tuple[np.ndarray, list[int], np.ndarray]:
        """Scores of kinds of pairs, and the kind of each of xs and ys."""
        kinds_x = {self.sa[x]: x for x in xs}
        kinds_y = {self.shape[y]: y for y in ys}
        table = np.array([[self._known(x, y) for y in kinds_y.values()] for x in kinds_x.values()], np.int64).reshape(len(kinds_x), len(kinds_y))
        at_x, at_y = {k: i for i, k in enumerate(kinds_x)}, {k: i for i, k in enumerate(kinds_y)}
        return table, [at_x[self.sa[x]] for x in xs], np.array([at_y[self.shape[y]] for y in ys], np.int64)

    @staticmethod
    def _row(before: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """The next row of best sums: a column each for so many of ys."""
        row = before.copy()
        row[1:] = np.maximum(before[1:], before[:-1] + gain)
        return np.maximum.accumulate(row)

    def _best(self, xs: list[int], ys: list[int]) -> int:
        if not xs or not ys:
            return 0
        table, at_x, at_y = self._gains(xs, ys)
        row = np.zeros(len(ys) + 1, np.int64)
        for x in at_x:
            row = self._row(row, table[x][at_y])
        return int(row[-1])

    def _matched(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """Pairs of a matching with the best sum."""
        if not xs or not ys:
            return []
        table, at_x, at_y = self._gains(xs, ys)
        every = math.isqrt(len(xs) - 1) + 1
        kept, row = [], np.zeros(len(ys) + 1, np.int64)
        for i, x in enumerate(at_x):
            if i % every == 0:
                kept.append(row)
            row = self._row(row, table[x][at_y])
        pairs, j = [], len(ys)
        for part in range(len(kept) - 1, -1, -1):
            rows = [kept[part]]
            for x in at_x[part * every : (part + 1) * every]:
                rows.append(self._row(rows[-1], table[x][at_y]))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j = int(np.searchsorted(rows[i], rows[i][j]))
                else:
                    i, j = i - 1, j - 1
                    pairs.append((xs[part * every + i], ys[j]))
        return pairs

    def align(self, page: Page) -> dict[int, int]:
        """Reference node of each node of page that is matched."""
        self.page, self.sa = page, page.shape(self.shapes)
        if len(self.scores) > 200_000:
            self.scores = {}
        found, todo = {0: 0}, [(0, 0)]
        while todo:
            a, b = todo.pop()
            xs, ys = page.children[a], self.reference.children[b]
            if self.sa[a] == self.shape[b]:
                pairs = list(zip(xs, ys, strict=True))
            else:
                self.score(a, b)  # so that all pairs below are known
                start, stop = self._ends(xs, ys)
                tail, end = len(xs) - stop, len(ys) - stop
                pairs = [*zip(xs[:start], ys[:start], strict=True), *self._matched(xs[start:tail], ys[start:end]), *zip(xs[tail:], ys[end:], strict=True)]
            for x, y in pairs:
                found[x] = y
                todo.append((x, y))
        return found


def host_of(url):
    """Lower-case host of a url, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


#: Bytes of what all hosts have that are sent to every executor at most; beyond it pages and hosts meet by a shuffle.
SENT = 16_000_000


def join_hosts(pages: DataFrame, hosts: DataFrame, size) -> DataFrame:
    """pages left join hosts, without a shuffle of pages where hosts' measured size allows."""
    total = hosts.agg(F.sum(size)).first()[0] or 0
    return pages.join(F.broadcast(hosts) if total <= SENT else hosts, "host", "left")


#: Pages of a host that must have the same parts in a row for a wrapper of their own; others share the host's.
LAYOUT_PAGES = 20
#: Elements that are parts of a page; fixed values.
PART = r"(?i)<(header|nav|main|article|aside|section|footer)\b"


def with_sites(pages: DataFrame, layout_pages: int = LAYOUT_PAGES) -> DataFrame:
    """pages (page_id, url, html) with host: the url's, and the layout (kinds of parts in their order, repeats told once) of pages that have it often enough."""
    parts = F.transform(F.regexp_extract_all("html", F.lit(PART), F.lit(1)), lambda x: F.lower(x))
    once = F.filter(parts, lambda x, i: (i == 0) | (F.get(parts, i - 1) != x))
    told = pages.withColumn("host", F.concat_ws(" ", host_of(F.col("url")), F.xxhash64(F.array_join(once, " ")).cast("string")))
    often = told.groupBy("host").agg(F.count("*").alias("often"))
    met = join_hosts(told, written(often, "html-layouts"), F.lit(16) + F.octet_length("host"))
    return met.withColumn("host", F.when(F.col("often") >= layout_pages, F.col("host")).otherwise(host_of(F.col("url")))).drop("often")


BLOCKS = "array<struct<node:int,at:int,main:boolean,aside:boolean,linked:boolean,hash:long,text:string>>"


def references(pages: DataFrame) -> DataFrame:
    """host, reference (the html of its page of least page_id that has any), ends (of each node, the number after its subtree's)."""
    own = F.xxhash64("html")
    first = pages.where(F.col("html") != "").groupBy("host").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", own.alias("h"))).alias("k"))
    ids = first.select("host", F.col("k.page_id").alias("rid"), F.col("k.h").alias("rh"))
    chosen = join_hosts(pages, written(ids, "html-hosts"), F.lit(64) + F.octet_length("host")).where(F.col("page_id").eqNullSafe(F.col("rid")) & (own == F.col("rh")))
    one = chosen.groupBy("host").agg(F.min("html").alias("reference"))  # rows that repeat

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends = []
        for source in batch.column("reference").to_pylist():
            page = Page(source)
            last = list(range(1, len(page.tag) + 1))
            for node in range(len(page.tag) - 1, 0, -1):
                last[page.parent[node]] = max(last[page.parent[node]], last[node])
            ends.append(last)
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("reference"), pa.array(ends, pa.list_(pa.int32()))], ["host", "reference", "ends"])

    return map_batches(one, run, "host string, reference string, ends array<int>")


def aligned(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, url, host, blocks: of each block the reference node that it matches, or else (at) that of its innermost matched
    ancestor, paragraphs and the like left out; whether it is in an article or main part, or aside, or mostly links; its text."""
    both = join_hosts(pages, found.select("host", "reference"), F.octet_length("reference"))

    def run(batches):
        known: dict[str, Matching] = {}
        for batch in batches:
            out = []
            for source, reference in zip(batch.column("html").to_pylist(), batch.column("reference").to_pylist(), strict=True):
                if reference is None:
                    out.append([])
                    continue
                if reference not in known:
                    if len(known) > 64:
                        known.clear()
                    known[reference] = Matching(Page(reference))
                page = Page(source)
                match, at, main = known[reference].align(page), [0], [False]
                for node in range(1, len(page.tag)):
                    tag, parent = page.tag[node], page.parent[node]
                    at.append(match[node] if node in match and tag not in LEAF else at[parent])
                    main.append(main[parent] or tag == "article" or tag == "main")
                out.append([{"node": match.get(n, at[n]), "at": at[n], "main": main[n], "aside": page.aside[n], "linked": linked, "hash": zlib.crc32(text.encode()) | len(text) << 32, "text": text} for (n, text), linked in zip(page.blocks, page.linked, strict=True)])
            kind = pa.list_(pa.struct([("node", pa.int32()), ("at", pa.int32()), ("main", pa.bool_()), ("aside", pa.bool_()), ("linked", pa.bool_()), ("hash", pa.int64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(out, kind)], ["page_id", "url", "host", "blocks"])

    return both.mapInArrow(run, f"page_id long, url string, host string, blocks {BLOCKS}")


def wrappers(pages: DataFrame, found: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, slot and stop (the reference nodes of the content slot), beside (nodes out of it that are slots too), template (nodes and hashes of constant texts), from all of a host's pages.

    A node's mass is the varying text in its subtree that isn't mostly links; the slot is the innermost node that holds enough of the whole. Nodes beside it are
    slots where most pages have varying text there that isn't mostly links; on fewer pages than least_pages any such node is."""
    blocks = pages.select("host", F.explode("blocks").alias("b")).where(~F.col("b.aside")).select("host", "b.node", "b.at", "b.hash", F.char_length("b.text").cast("long").alias("size"), (~F.col("b.linked")).cast("long").alias("runs"))
    counts = written(pages.groupBy("host").agg(F.count("*").alias("pages")), "html-counts")
    texts = blocks.groupBy("host", "node", "at", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("runs").alias("runs"))
    constant = (F.col("pages") >= least_pages) & (F.col("n") >= CONSTANT * F.col("pages"))
    told = join_hosts(written(texts, "html-texts"), counts, F.lit(16) + F.octet_length("host")).withColumn("constant", constant)
    template = told.where("constant").groupBy("host").agg(F.collect_set(F.struct("node", "hash")).alias("template"))  # of a page's texts at most twice as many
    # links count only where all that varies is links; copies of a block are told apart by its hash, so it is linked or not alike
    per = told.where("NOT constant").groupBy("host", "node", "at").agg(F.sum("size").alias("size"), F.sum(F.when(F.col("runs") > 0, F.col("size")).otherwise(0)).alias("running"), (F.sum("runs") >= CONSTANT * F.max("pages")).alias("often"))
    mass = per.groupBy("host").agg(F.collect_list(F.struct("node", "at", "size", "running", "often")).alias("masses"))  # a reference's nodes at most
    rows = found.select("host", "ends").join(mass, "host", "left").join(template, "host", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, stops, besides = [], [], []
        for ends, masses in zip(batch.column("ends").to_pylist(), batch.column("masses").to_pylist(), strict=True):
            before = np.zeros(len(ends) + 1, np.int64)
            of = "running" if any(m["running"] for m in masses or ()) else "size"
            for m in masses or ():
                before[m["at"] + 1] += m[of]
            before = np.cumsum(before)
            held = before[np.array(ends)] - before[:-1]
            slot = int(np.flatnonzero(held >= HOLDS * held[0])[-1]) if held[0] else None
            slots.append(slot)
            stops.append(None if slot is None else ends[slot])
            besides.append(sorted({m["node"] for m in masses or () if slot is not None and m["often"] and not slot <= m["at"] < ends[slot]}))
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(slots, pa.int32()), pa.array(stops, pa.int32()), pa.array(besides, pa.list_(pa.int32())), batch.column("template")], ["host", "slot", "stop", "beside", "template"])

    return map_batches(rows, run, "host string, slot int, stop int, beside array<int>, template array<struct<node:int,hash:long>>")


def main_text(pages: DataFrame, layout_pages: int = LAYOUT_PAGES, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page's whole html. Pages of one layout have a wrapper of their own where a host has layout_pages
    of them, and share the host's otherwise; texts are template only where a wrapper has least_pages pages.

    Null and empty html give empty text; null urls are one host; a host's only page is its own
    reference, with nothing constant; rows that repeat count each; an empty table gives no rows; other columns aren't read."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = with_sites(pages, layout_pages)
    found = written(references(pages), "html-references")
    parsed = written(aligned(pages, found), "html-blocks")
    induced = written(wrappers(parsed, found, least_pages), "html-wrappers")
    joined = join_hosts(parsed, induced, 64 + 16 * F.coalesce(F.size("template"), F.lit(0)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for blocks, slot, stop, beside, template in zip(*(batch.column(c).to_pylist() for c in ("blocks", "slot", "stop", "beside", "template")), strict=True):
            slots = frozenset(beside or ())
            constant = {(t["node"], t["hash"]) for t in template or ()}
            usable = [b for b in blocks or () if not b["aside"]]
            varying = [b for b in usable if (b["node"], b["hash"]) not in constant]
            # constant lines of an article are its own; elsewhere in the slot they are template
            inside = [] if slot is None else [b for b in usable if slot <= b["at"] < stop and (b["main"] or (b["node"], b["hash"]) not in constant)]
            own = {id(b) for b in inside}
            # headings and leads beside the slot, if the page has something in it
            chosen = [b for b in usable if id(b) in own or b["node"] in slots and not b["linked"] and (b["node"], b["hash"]) not in constant] if inside else []
            # without a slot, or on a page that lacks it: nothing varies on this host, or this page is of another make
            chosen = chosen or [b for b in usable if b["main"]] or varying or usable
            texts.append("\n\n".join(b["text"] for b in chosen))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(joined.select("page_id", "url", "blocks", "slot", "stop", "beside", "template"), run, "page_id long, url string, text string, n_chars long")
