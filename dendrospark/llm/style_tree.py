"""Main text of web pages by a site style tree.

The DOMs of one host are merged.  A style node is an element's tag, classes and declared role,
below its parent's node; generic containers of one style are told apart by their place among their
siblings, text elements (``REPEATED``) are not.  For each node two entropies are measured over the
pages of the host that have it: of the layouts (what elements it holds, presentation) and of the
texts directly in it (content).  They are collision entropies: ``1 - exp(-H)`` is the chance that
two of the pages differ there, whose estimate is the same in the mean for every number of pages.
``PRIOR`` pairs of pages are added to those seen, at 0.5, or 1 inside a declared article; so nothing
is decided on a host of one page, and no host is treated otherwise for its size.

A text node's importance is the mean of both.  That of a container is its presentation and the mean
of its children, weighted by ``DECAY`` to the power of their number.  On that importance

* a branch below ``LOW`` is a template and is cut, be it a container or a text;
* a branch of ``HIGH`` or more, no container in which lies ``PEAK`` above it, holds main text;
* others are undecided: they stay inside a main branch or declared article, as a first-level
  heading, or on pages that have neither branch nor article, and go elsewhere.

Elements that markup itself declares to be no content (menus, page headers and footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments, by element name, role or class word) have
importance 0 and take no part in the statistics.  Text elements of a declared article are never
templates, since near copies of an article look like one; nor are body, article and main themselves.

Only counts by (host, node, mark) are shuffled, combined before the shuffle; levels of the tree are
joined from the leaves up.  Pages are read twice and joined with the short list of their host's
decided nodes by a key, which Spark broadcasts where that list is small, and else splits where a
host is hot.

Defined cases: null or empty html gives an empty text; a null url counts as a host of its own;
repeated pages are extracted each, and count once, as do pages of equal content; a tie of two
importances decides neither node against the other; elements below ``DEEPEST`` levels belong to
their ancestor there; very long pages are read whole, in time linear in their length; an empty table
gives no rows.  Columns named ``text`` or starting with ``_`` cannot be kept (ValueError).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialise, own_names, rows_of

LOW, HIGH, PEAK = 0.2, 0.6, 0.05
DECAY = 0.9
PRIOR = 6
DEEPEST = 64

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select svg math iframe object head title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOT_CONTENT = frozenset("nav footer aside form button menu dialog".split()) | RAW
UNPARSED = frozenset("script style textarea title noscript iframe template".split())
IN_HEAD = frozenset("title script style noscript template meta link base".split())
ROOTS = frozenset("#root html body article main".split())
REPEATED = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre blockquote figcaption caption".split())
CLOSED_BY = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|breadcrumbs?|header|masthead|footer|sidebar|widget|related|share|social|cookies?|consent|notice|popup|modal|newsletter|subscribe|comments?|replies|disqus|pagination)(?:$|[\s_-])", re.I)

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")

ROOT = 0
LAYOUT, TEXT = 0, 1  #: kinds of marks
Decided = tuple[frozenset[int], frozenset[int]]  #: nodes of templates and of main branches
NOTHING: Decided = (frozenset(), frozenset())


def host_of(url: str | None) -> str:
    if not url or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.partition("://")[2], maxsplit=1)[0].lower()


class Node:
    """An open element.  ``home`` is the node its text and layout belong to: itself if it is a block."""

    __slots__ = ("article", "cut", "depth", "home", "key", "kids", "layout", "main", "outer", "skip", "tag", "text", "up")

    def __init__(self, tag: str, key: int, home: Node | None, article: bool = False, skip: bool = False) -> None:
        self.tag, self.key, self.skip = tag, key, skip
        self.home = self
        self.up = home.key if home else ROOT
        self.depth = home.depth + 1 if home else 0
        self.article = article or tag in ("article", "main")
        self.cut = self.main = False
        self.outer: list[str] | None = None  #: text of a block around this inline element without content
        self.kids: dict[str, int] = {}
        self.layout: list[str] = []
        self.text: list[str] = []


class Block:
    """A run of text between block elements, and what is known of the node it lies in."""

    __slots__ = ("article", "cut", "main", "skip", "tag", "text")

    def __init__(self, node: Node, text: str, article: bool) -> None:
        self.tag, self.text, self.article = node.tag, text, article
        self.skip, self.cut, self.main = node.skip, node.cut, node.main


def walk(html: str, decided: Decided = NOTHING, nodes: list[Node] | None = None) -> list[Block]:
    """The blocks of a page in order.  Style nodes with content are added to ``nodes``, if given."""
    cuts, mains = decided
    stack = [Node("#root", ROOT, None)]
    opened: dict[str, int] = {}
    blocks: list[Block] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            home = stack[-1].home
            blocks.append(Block(home, text, stack[-1].article))
            home.text.append(text)

    def close(to: int) -> None:
        while len(stack) > to:
            if stack[-1].tag in BLOCK:
                flush()
            node = stack.pop()
            opened[node.tag] = opened.get(node.tag, 0) - 1
            if node.outer is not None:
                held[:] = node.outer
            if nodes is not None and node.home is node and not node.skip:
                nodes.append(node)

    at, end = 0, len(html)
    # no tag ends after the last bracket, though a comment may stay open
    last = max(html.rfind(">"), html.rfind("<!--"))
    while at < end:
        m = TAG.search(html, at) if at <= last else None
        if m is None:
            held.append(unescape(html[at:]))
            break
        if m.start() > at:
            part = html[at : m.start()]
            held.append(unescape(part) if "&" in part else part)
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    if tag in BLOCK:
                        flush()
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "table") and tag not in ("body", "html", "div", "section"):
                    break
        elif m[2]:
            tag = m[2].lower()
            if stack[-1].tag == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            if tag in BLOCK:
                flush()
            while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
                close(len(stack) - 1)
            if opened.get("p") and tag in CLOSED_BY["p"] and tag != "hr":
                close(max(i for i, x in enumerate(stack) if x.tag == "p"))
            home, article = stack[-1].home, stack[-1].article
            if tag in VOID:
                home.layout.append(tag)
                if tag in ("br", "hr"):
                    held.append(" ")
                continue
            if tag in UNPARSED:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = stop.end() if stop else end
                continue
            attrs = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(m[3])} if m[3] else {}
            style = ".".join([tag, *sorted(attrs.get("class", "").lower().split())])
            if m[3].endswith("/") and tag not in BLOCK:
                home.layout.append(style)
                continue
            skip = home.skip or no_content(tag, attrs, article)
            if not skip:
                home.layout.append(style)
            if skip and not home.skip:
                node = Node(tag, ROOT, home, article, True)
                if tag not in BLOCK:
                    node.outer = held[:]
                    held.clear()
            elif tag in BLOCK and not skip and home.depth < DEEPEST:
                place = home.kids[style] = home.kids.get(style, 0) + 1
                if place > 1 and tag not in REPEATED:
                    style = f"{style}:{place}"
                node = Node(tag, xxhash.xxh64_intdigest(style.encode("utf-8", "surrogatepass"), home.key), home, article)
                node.cut, node.main = home.cut or node.key in cuts, home.main or node.key in mains
            else:
                node = Node(tag, home.key, home, article, skip)
                node.home = home
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    close(0)
    return blocks


def no_content(tag: str, attrs: dict[str, str], article: bool) -> bool:
    """Whether an element's name, state, role or class words declare it to be no content."""
    if tag in NOT_CONTENT or (tag == "header" and not article) or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    words = NAMES.search(attrs.get("class", "")) or NAMES.search(attrs.get("id", ""))
    return attrs.get("role", "").lower() in ROLES or bool(words and tag not in ("html", "body", "article", "main"))


def main_text(html: str, decided: Decided = NOTHING) -> str:
    """The blocks of a page that its host's decided nodes and its declared articles leave, joined by newlines."""
    blocks = [b for b in walk(html, decided) if not (b.skip or b.cut)]
    if any(b.main or b.article for b in blocks):
        blocks = [b for b in blocks if b.main or b.article or b.tag == "h1"]
    return "\n".join(b.text for b in blocks)


def features(html: str) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """(node, node above, depth, flags, kind, children, mark) of all a page shows, and a hash of its content."""
    nodes: list[Node] = []
    blocks = walk(html, NOTHING, nodes)
    merged: dict[int, list[Node]] = {}
    for n in nodes:
        merged.setdefault(n.key, []).append(n)
    out = []
    for key, own in merged.items():
        n = own[0]
        head = key, n.up, n.depth, n.article | (2 if n.tag in ROOTS or (n.article and n.tag not in ("div", "section")) else 0)
        # how often a repeated element occurs is its parent's layout; its own are the different ones it has
        shapes = sorted({"\x1f".join(x.layout) for x in own})
        out.append((*head, LAYOUT, sum(sum(x.kids.values()) for x in own), crc("\x1e".join(shapes))))
        text = "\x1e".join("\x1f".join(x.text) for x in own if x.text)
        if text:
            out.append((*head, TEXT, 0, crc(text)))
    content = "\n".join(b.text for b in blocks if not b.skip).encode("utf-8", "surrogatepass")
    return out, int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def signed(key: int) -> int:
    return key - (key >> 63 << 64)


MARKS = "host string, node long, up long, depth int, flags int, kind int, kids int, mark long, page long"


def node_counts(pages: DataFrame, url: str, html: str) -> DataFrame:
    """How many pages of a host, counted by different content, show the same layout or text at a style node."""

    def explode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, short = pa.int64(), pa.int32()
        schema = pa.schema([("host", pa.string()), ("node", long), ("up", long), ("depth", short), ("flags", short), ("kind", short), ("kids", short), ("mark", long), ("page", long)])
        for batch in source:

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for link, body in rows_of(batch, "_url", "_html"):
                    host = host_of(link)
                    marks, page = features(body or "")
                    for node, up, depth, flags, kind, kids, mark in marks:
                        yield host, signed(node), signed(up), depth, flags, kind, kids, mark, page

            yield from batches(rows(), schema, 4 << 20)

    marks = pages.select(pages[url].alias("_url"), pages[html].alias("_html")).mapInArrow(explode, MARKS)
    return marks.groupBy("host", "node", "up", "depth", "flags", "kind", "kids", "mark").agg(F.count_distinct("page").alias("pages"))


def entropy_importance(seen: Column, same: Column, prior: Column) -> Column:
    """The chance that two of ``seen`` pages differ; ``same`` counts ordered pairs that do not."""
    pairs = seen * (seen - 1) / 2
    return (pairs - same / 2 + PRIOR * prior) / (pairs + PRIOR)


def nodes_of(counts: DataFrame) -> DataFrame:
    """The nodes of all hosts' trees: presentation and content importance, pages seen, mean number of children."""
    n = F.col("pages").cast("double")

    def over(kind: int, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    sums = counts.groupBy("host", "node", "up", "depth", "flags").agg(
        over(LAYOUT, n).alias("seen"), over(LAYOUT, n * (n - 1)).alias("same"), (over(LAYOUT, n * F.col("kids")) / over(LAYOUT, n)).alias("kids"),
        over(TEXT, n).alias("read"), over(TEXT, n * (n - 1)).alias("alike"),
    )
    prior = F.when(F.col("flags").bitwiseAND(1) == 1, 1.0).otherwise(0.5)
    return sums.select("host", "node", "up", "depth", "flags", "seen", "kids", "read", entropy_importance(F.col("seen"), F.col("same"), prior).alias("presentation"), entropy_importance(F.col("read"), F.col("alike"), prior).alias("content"))


def importance(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``importance``, ``below`` (that of the most important child with children) and ``most`` (that of the whole branch)."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    out: DataFrame | None = None
    level: DataFrame | None = None
    text = (F.col("presentation") + F.col("content")) / 2
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        own = nodes.where(F.col("depth") == depth)
        if level is None:
            scored = own.select("*", F.coalesce(text, "presentation").alias("importance"), F.lit(None).cast("double").alias("below"))
            scored = scored.withColumn("most", F.col("importance"))
        else:
            kids = level.groupBy("host", F.col("up").alias("node")).agg(F.sum(F.col("seen") * F.col("importance")).alias("total"), F.sum("seen").alias("weight"), F.max(F.when(F.col("kids") > 0, F.col("importance"))).alias("below"), F.max("most").alias("under"))
            joined = own.join(kids, ["host", "node"], "left")
            read = F.coalesce("read", F.lit(0.0))
            mean = (F.col("total") + F.coalesce(read * text, F.lit(0.0))) / (F.col("weight") + read)
            share = F.pow(F.lit(DECAY), F.col("kids") + F.when(read > 0, 1).otherwise(0))
            inner = (1 - share) * F.col("presentation") + share * mean
            joined = joined.withColumn("importance", F.when(F.col("total").isNull(), F.coalesce(text, "presentation")).otherwise(inner))
            scored = joined.select(*nodes.columns, "importance", "below", F.greatest("importance", "under").alias("most"))
        level = materialise(scored, f"level{depth}")
        out = level if out is None else out.unionByName(level)
    return nodes.select("*", *(F.lit(None).cast("double").alias(c) for c in ("importance", "below", "most"))) if out is None else out


def decisions(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, cuts, mains): the template and main nodes of each host that has any, in the shared folder."""
    scored = importance(materialise(nodes_of(node_counts(pages, url, html)), "nodes"))
    cut = (F.col("most") < LOW) & (F.col("flags") < 2)
    main = (F.col("importance") >= HIGH) & F.coalesce(F.col("below") <= F.col("importance") + PEAK, F.lit(True))
    chosen = scored.where(cut | main).groupBy("host").agg(F.collect_list(F.when(cut, F.col("node"))).alias("cuts"), F.collect_list(F.when(main, F.col("node"))).alias("mains"))
    return materialise(chosen, "decisions")


def extract(pages: DataFrame, url: str, html: str, keep: list[str], by_tree: bool = True) -> DataFrame:
    """``keep`` columns and ``text``, the main text of every page.

    Without ``by_tree`` declared roles and articles alone decide.
    """
    own_names(keep, "text")
    host = F.lower(F.regexp_extract(F.coalesce(pages[url], F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    own = pages.select(*keep, pages[html].alias("_html"), host.alias("_host"))
    if by_tree:
        own = own.join(decisions(pages, url, html).withColumnRenamed("host", "_of"), F.col("_host") == F.col("_of"), "left")
    else:
        own = own.withColumns({c: F.lit(None).cast("array<long>") for c in ("cuts", "mains")})
    joined = own.select("_html", F.col("cuts").alias("_cuts"), F.col("mains").alias("_mains"), *keep)
    out_type = T.StructType([*(pages.schema[k] for k in keep), T.StructField("text", T.StringType())])

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            schema = pa.schema([*(batch.schema.field(k) for k in keep), ("text", pa.string())])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for body, cuts, mains, *rest in rows_of(batch, "_html", "_cuts", "_mains", *keep):
                    decided = frozenset(k % (1 << 64) for k in cuts or ()), frozenset(k % (1 << 64) for k in mains or ())
                    yield (*rest, main_text(body or "", decided))

            yield from batches(rows(), schema)

    return joined.mapInArrow(read, out_type)
