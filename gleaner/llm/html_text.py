"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by style path (block elements with their classes, numbers in them left out). The
importance of a branch is the entropy of its contents over the pages that have it, less by the share of its text that lies
in links, weighted by its presentation: the entropy of its shapes (children, and size of the text) or its share of the
pages' text, whichever is more. So menus, notices and adverts of a site come out low even where their words change, and
articles high. Branches of low importance are removed from each page, up to article and main elements inside them. Where
a host has too few pages to tell, a branch's class decides; elements that are by their kind no article always go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_among, staged

#: Pages of different content that a host's branch needs to be judged, and its least importance.
PAGES, IMPORTANCE = 5, 0.3
#: The share of the pages' text from which a branch has full weight whatever its shapes, and the factor of a branch whose class says that it isn't the article.
FULL, DOUBT = 0.25, 0.6
#: Rows of the table of judged branches up to which it is broadcast; beyond, pages and branches meet in a shuffle join.
BROADCAST_ROWS = 20_000

#: Fixed values of HTML: elements without content, blocks, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("article aside blockquote body details div dl fieldset figure footer form header html li main nav ol section table td th tr ul".split())
#: Elements and roles that aren't the article, classes that may not be, and classes of reader comments.
NEVER = frozenset("head title script style noscript template nav footer aside button select textarea iframe svg canvas object dialog search menu".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended footer pagination pager widget toolbar skip copyright".split()
)
COMMENTS = frozenset("comment comments disqus reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ARTICLE = frozenset({"article", "main"})
_ABOUT_OTHERS = re.compile(r"(?:has|no|not|with|without|is)[-_]")


def _number(text: str) -> int:
    n = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return n - (1 << 64) if n >> 63 else n


@lru_cache(maxsize=4096)
def style(tag: str, names: str) -> str:
    """A branch's tag and classes, without numbers and in order."""
    return ".".join([tag, *sorted({x for x in re.sub(r"\d+", "", names).split() if x})])


@lru_cache(maxsize=4096)
def said_by_class(names: str) -> tuple[bool, bool, bool]:
    """Whether class and id name reader comments, noise as a whole name, and noise as a part of one (a name like has-sidebar is about others)."""
    tokens = names.lower().split()
    parts = {w for t in tokens if not _ABOUT_OTHERS.match(t) for w in re.split(r"[^a-z0-9]+", t)}
    return bool(parts & COMMENTS), any(t in NOISE for t in tokens), bool(parts & NOISE)


class Branch:
    """What the subtree of an element holds: text, text in links, words, blocks, a digest of its text and of its children."""

    __slots__ = ("blocks", "chars", "digest", "kids", "links", "noisy", "path", "safe", "words")

    def __init__(self, path: int, noisy: bool, safe: bool) -> None:
        self.path, self.noisy, self.safe = path, noisy, safe
        self.chars = self.links = self.words = self.blocks = self.digest = self.kids = 0

    def add(self, chars: int, links: int, words: int, blocks: int, digest: int) -> None:
        self.chars += chars
        self.links += links
        self.words += words
        self.blocks += blocks
        self.digest = (self.digest * 1_000_003 + digest) & 0xFFFFFFFFFFFFFFFF


class Element:
    __slots__ = ("branch", "counts", "gone", "link", "low", "main", "tag")

    def __init__(self, tag: str, branch: Branch, counts: dict, gone: bool, low: bool, main: bool, link: bool) -> None:
        self.tag, self.branch, self.counts, self.gone, self.low, self.main, self.link = tag, branch, counts, gone, low, main, link


class Page(HTMLParser):
    """blocks: the kept texts in page order, without branches in low and those of a noisy class not in spared.

    nodes: for each style path of a branch that isn't gone by its kind what the page's branches of that path hold.
    """

    def __init__(self, low: frozenset = frozenset(), spared: frozenset = frozenset(), tree: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.low, self.spared, self.tree = low, spared, tree
        self.blocks: list[str] = []
        self.nodes: dict[int, Branch] = {}
        self.held: list[tuple[str, bool]] = []
        root = Element("", Branch(0, False, False), {}, False, False, False, False)
        self.open = [root]
        self.named: dict[str, int] = {}  # open elements by tag

    def flush(self) -> None:
        if not self.held:
            return
        held, self.held = self.held, []
        text = " ".join("".join(t for t, _ in held).split())
        if not text:
            return
        if self.tree:
            links = min(len(text), sum(len(t.strip()) for t, link in held if link))
            self.open[-1].branch.add(len(text), links, text.count(" ") + 1, 1, _number(text))
        else:
            self.blocks.append(text)

    def close_down_to(self, n: int) -> None:
        while len(self.open) > n:
            e = self.open.pop()
            self.named[e.tag] -= 1
            up = self.open[-1]
            if up.counts is not e.counts:
                b = e.branch
                if self.tree and not e.gone and b.chars:
                    up.branch.add(b.chars, b.links, b.words, b.blocks, b.digest)
                    up.branch.safe |= b.safe and not b.noisy
                    seen = self.nodes.setdefault(b.path, Branch(b.path, b.noisy, b.safe))
                    seen.add(b.chars, b.links, b.words, b.blocks, b.digest)
                    seen.kids = (seen.kids * 1_000_003 + b.kids) & 0xFFFFFFFFFFFFFFFF
                    seen.safe |= b.safe
            else:
                up.counts[e.tag] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
            if tag != "br":
                top = self.open[-1]
                ends = CLOSES.get(tag, ()) or ("p",)
                if "p" not in ends:
                    ends = {*ends, "p"}
                if any(top.counts.get(t) for t in ends) or top.counts.get("") in ends:
                    for i in range(len(self.open) - 1, 0, -1):
                        if self.open[i].tag in ends:
                            self.close_down_to(i)
                            break
                        if self.open[i].tag in HOLDS:
                            break
        if tag in VOID:
            if block:
                self.open[-1].branch.kids += 1
            return
        up = self.open[-1]
        gone, low, main, branch, counts = up.gone, up.low, up.main, up.branch, up.counts
        said = {k: v or "" for k, v in attrs}
        role = said.get("role", "").lower()
        names = f"{said.get('class', '')} {said.get('id', '')}"
        remarks, whole, part = said_by_class(names) if len(names) > 1 else (False, False, False)
        if tag not in ("html", "body", "main"):
            gone = gone or tag in NEVER or (tag == "header" and not main) or remarks or role in ROLES or "hidden" in said
        if block:
            branch.kids = (branch.kids * 1_000_003 + hash_of(tag)) & 0xFFFFFFFFFFFFFFFF
        if tag in HOLDS and tag != "body" and tag != "html":
            noisy = tag == "form" or (tag not in ARTICLE and (whole or (part and not main)))
            path = _number(f"{branch.path}>{style(tag, said.get('class', ''))}")
            own = path in self.low or (noisy and path not in self.spared)
            low = own or (low and tag not in ARTICLE)
            branch, counts = Branch(path, noisy, main or tag in ARTICLE), {"": tag}
        else:
            counts[tag] = counts.get(tag, 0) + 1
            if tag == "h1":
                branch.safe = True
            if (whole or (part and not main)) and tag not in ("html", "body"):
                low = True  # an inline element or a paragraph of such a class, which is no branch
        self.named[tag] = self.named.get(tag, 0) + 1
        self.open.append(Element(tag, branch, counts, gone, low, main or tag in ARTICLE, up.link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
            found = self.named.get(tag, 0) > 0
        else:
            found = self.open[-1].counts.get(tag, 0) > 0
        if found:
            i = len(self.open) - 1
            while self.open[i].tag != tag:
                i -= 1
            self.close_down_to(i)

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        if not at.gone and (self.tree or not at.low):
            self.held.append((data, at.link))

    def finish(self) -> Page:
        self.close()
        self.flush()
        self.close_down_to(1)
        return self


@lru_cache(maxsize=256)
def hash_of(tag: str) -> int:
    return _number(tag) & 0xFFFFFFFF


def parse(html: str | None, low: frozenset = frozenset(), spared: frozenset = frozenset(), tree: bool = False) -> Page:
    page = Page(low, spared, tree)
    page.feed(html or "")
    return page.finish()


def host(url: Column) -> Column:
    """The host that a URL names, in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]*)", 1), F.lit("")))


def different(pages: DataFrame) -> DataFrame:
    """host and html of pages(url, html), each content of a host once.

    Only pages that have copies are moved, one of them from each task.
    """
    at = host(F.col("url"))
    keyed = pages.select(at.alias("host"), "html", F.md5(F.concat(at, F.lit("\n"), F.coalesce("html", F.lit(""))).cast("binary")).alias("key"))
    copied = staged(pages.sparkSession, keyed.groupBy("key").count().where("count > 1").select("key"))
    some, rest = split_among(keyed, "key", copied)
    return rest.unionByName(some.dropDuplicates(["key"])).select("host", "html")


def shape(branch: Branch) -> int:
    """The children of a branch, and the size of its text in steps of four."""
    return _number(f"{branch.kids}/{(branch.words.bit_length() + 1) // 2}")


NODES = "host string, path long, content long, shape long, links double, share double, safe boolean, noisy boolean"


def _nodes(batches) -> Iterator:
    """A row for each style path of a page (host, html)."""
    import pyarrow as pa

    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
    for b in batches:
        out: list[tuple] = []
        for at, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            page = parse(html, tree=True)
            total = page.open[0].branch.chars
            out += [(at, n.path, n.digest - (1 << 63), shape(n), n.links / n.chars, n.chars / total, n.safe, n.noisy) for n in page.nodes.values()]
        cols = list(zip(*out, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])


def style_tree(pages: DataFrame, least_pages: int = PAGES) -> DataFrame:
    """host, path, pages, importance and noisy (the class says so) of the branches that hold text in pages(url, html).

    Importance lies between 0 and 1: entropy of the contents, times the share of text outside links, times the larger of
    the entropy of the shapes and the share of the pages' text (full from FULL on, and for branches in an article or with
    the page's title). Copies of a page count once. Only counts and pages that have copies leave a task, and a node's
    counts are added up in parts, so a host may hold any share of the pages. Null for a branch on fewer than least_pages pages.
    """
    nodes = different(pages).mapInArrow(_nodes, NODES)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("shape").alias("value")))
    seen = nodes.select("*", F.explode(kinds).alias("x")).groupBy("host", "path", "x").agg(F.count("*").cast("double").alias("n"), F.sum("links").alias("links"), F.sum("share").alias("share"), F.max("safe").alias("safe"), F.max("noisy").alias("noisy"))
    by_kind = seen.groupBy("host", "path", F.col("x.kind").alias("kind")).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("links").alias("links"), F.sum("share").alias("share"), F.max("safe").alias("safe"), F.max("noisy").alias("noisy"))
    entropy = F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    both = by_kind.withColumn("h", entropy).groupBy("host", "path").agg(F.max("pages").alias("pages"), pick(0, "h").alias("c"), pick(1, "h").alias("p"), pick(0, "links").alias("links"), pick(0, "share").alias("share"), F.max("safe").alias("safe"), F.max("noisy").alias("noisy"))
    weight = F.when(F.col("safe"), 1.0).otherwise(F.greatest("p", F.least(F.lit(1.0), F.col("share") / F.col("pages") / FULL)))
    importance = F.col("c") * (1 - F.col("links") / F.col("pages")) * weight * F.when(F.col("noisy"), DOUBT).otherwise(1.0)
    return both.select("host", "path", "pages", F.when(F.col("pages") >= least_pages, importance).alias("importance"), "noisy")


def _texts(batches) -> Iterator:
    import pyarrow as pa

    for b in batches:
        texts = []
        for html, low, spared in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            texts.append("\n".join(parse(html, frozenset(low or ()), frozenset(spared or ())).blocks))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(spark: SparkSession, pages: DataFrame, importance: float = IMPORTANCE) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html).

    Null or empty html gives an empty text; pages without a host share a tree; repeated rows each give a row; broken and
    cut-off markup is closed where it ends, and a page takes time in proportion to its length. With importance 0 the
    tree removes nothing. Other columns are not read.
    """
    judged = style_tree(pages).where(F.col("importance").isNotNull() & ((F.col("importance") < importance) | F.col("noisy")))
    is_low = F.col("importance") < importance
    low = judged.groupBy(F.col("host").alias("__host")).agg(F.collect_list(F.when(is_low, F.col("path"))).alias("low"), F.collect_list(F.when(~is_low, F.col("path"))).alias("spared"))
    low = staged(spark, low)
    few = low.limit(BROADCAST_ROWS + 1).agg(F.sum(F.size("low") + F.size("spared")).alias("n"), F.count("*").alias("h")).first()
    small = few["h"] <= BROADCAST_ROWS and (few["n"] or 0) <= BROADCAST_ROWS
    joined = pages.select("page_id", "url", "html").join(F.broadcast(low) if small else low, host(F.col("url")) == F.col("__host"), "left")
    return joined.select("page_id", "url", "html", "low", "spared").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
