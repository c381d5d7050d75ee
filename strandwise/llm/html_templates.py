"""HTML extraction with site templates removed.

Every page is read into a tree of elements. The hash of an element's subtree
covers its name, its attributes and its children in order, with runs of white
space as one space; comments count for nothing, scripts and styles are
dropped. The pages of a host that hold a hash are counted in Spark, for all
pages. A subtree that is site furniture by its own form (a navigation, footer
or advertisement element, by name or by class, id or role, or a list of links)
is template from MIN_PAGES pages of its host on, whatever the host's size. Any
other must be on MIN_PAGES and on MIN_SHARE of the pages too, or on MANY_PAGES
however large the host is: copies of an article, or short paragraphs, recur on
a few pages without being template. A template is deleted, wherever it lies,
before the text of the page is taken. Blocks start lines of the text.

The template table is broadcast only if its measured size allows it; otherwise
every page is joined with those of its own subtrees that are template, so that
no task has all pages of a host.

Defined cases: null and empty HTML gives the empty text, and an empty table an
empty one. A subtree on exactly as many pages as needed is template. Pages of
any length are read whole; further columns may have any name. A page whose URL has
no host (null, empty or malformed) belongs to the host "". Rows that repeat a
page_id and URL count once for the statistics of their host, and come back as
often as they came; ids may be null. Text outside of any tag, unclosed and
stray tags are kept as browsers do, roughly: an unclosed element ends with its
parent. Subtrees without text are never counted, as they don't show.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import BROADCAST_BYTES, materialize, slices, table

MIN_PAGES = 5
MIN_SHARE = 0.2
MANY_PAGES = 50
LINK_LIST = 3  # links, and no other words, that make a subtree furniture

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd label mark q s samp small span strong sub sup u var".split())
_CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S | re.I)
_SPACE = re.compile(r"\s+")
_FURNITURE = frozenset("nav footer header aside menu form".split())
_CONTENT = frozenset("html head title body main article".split())
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+)", re.I)
_FURNITURE_WORD = re.compile(r"(?<![a-z])(?:ads?|advert[a-z]*|adsbygoogle|sponsor(?:ed)?|promo|banner|nav|navigation|navbar|menu|menubar|breadcrumbs?|sidebar|footer|contentinfo|complementary|masthead|cookies?|consent|share|social|related|newsletter|subscribe|pagination|pager|widget|toolbar|copyright)(?![a-z])")


class Node:
    """An element: its children are Nodes and strings."""

    __slots__ = ("name", "attributes", "children", "digest", "shows", "links", "loose", "furniture")

    def __init__(self, name: str, attributes: str):
        self.name, self.attributes, self.children = name, attributes, []


@lru_cache(1 << 14)
def _named_furniture(attributes: str) -> bool:
    return any(_FURNITURE_WORD.search(value.lower()) for value in _NAMED.findall(attributes))


def _seal(node: Node) -> None:
    """Sets the hash of a node whose children are complete, and whether its form is that of site furniture."""
    state = blake2b(f"{node.name}\0{node.attributes}\0".encode(errors="replace"), digest_size=8)
    shows = loose = False
    link = node.name == "a"
    links = int(link)
    for child in node.children:
        if isinstance(child, str):
            state.update(b"\1" + child.encode(errors="replace"))
            shows = True
            loose = loose or not link and any(c.isalnum() for c in child)
        else:
            state.update(b"\2" + child.digest)
            shows = shows or child.shows
            links += child.links
            loose = loose or child.loose and not link
    node.digest, node.shows, node.links, node.loose = state.digest(), shows, links, loose
    node.furniture = node.name not in _CONTENT and (node.name in _FURNITURE or links >= LINK_LIST and not loose or bool(node.attributes) and _named_furniture(node.attributes))


def parse(text: str) -> Node:
    """The tree of a page, every node with its hash."""
    root = Node("", "")
    stack, depth = [root], {}

    def close() -> None:
        node = stack.pop()
        depth[node.name] -= 1
        _seal(node)

    at = 0
    for m in _TAG.finditer(text):
        if m.start() > at and (s := _SPACE.sub(" ", text[at : m.start()])) != " ":
            stack[-1].children.append(s)
        at = m.end()
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        if m.group(2):
            if depth.get(name):
                while stack[-1].name != name:
                    close()
                close()
            continue
        while len(stack) > 1 and name in _CLOSED_BY.get(stack[-1].name, ()):
            close()
        node = Node(name, _SPACE.sub(" ", m.group(4).strip(" \t\r\n/")))
        stack[-1].children.append(node)
        if name in _VOID:
            _seal(node)
        else:
            stack.append(node)
            depth[name] = depth.get(name, 0) + 1
    if at < len(text) and (s := _SPACE.sub(" ", text[at:])) != " ":
        stack[-1].children.append(s)
    while len(stack) > 1:
        close()
    _seal(root)
    return root


def _number(node: Node) -> int:
    """63 bits of the hash; the lowest bit says that the node is furniture."""
    return int.from_bytes(node.digest, "little", signed=True) & ~1 | node.furniture


def subtree_hashes(text: str) -> set[int]:
    """Hashes of all elements of a page that hold text."""
    found, todo = set(), [parse(text)]
    while todo:
        for child in todo.pop().children:
            if not isinstance(child, str) and child.shows:
                found.add(_number(child))
                todo.append(child)
    return found


def extract(text: str, template: set[int] | frozenset[int]) -> tuple[str, int]:
    """(text of a page without its template subtrees, how many were deleted)."""
    out: list[str] = []
    deleted = 0
    todo: list = [parse(text)]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if node.name and node.shows and _number(node) in template:
            deleted += 1
            out.append("\n")
            continue
        block = node.name not in _INLINE
        if block:
            out.append("\n")
            todo.append("\n")
        todo.extend(reversed(node.children))
    # entities are read after the tags, so that an escaped tag stays text
    lines = (" ".join(html.unescape(x).split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), deleted


def host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(F.col("page_id"), F.col("url")).alias("page"), host().alias("host"), F.col("html").alias("body"))


def page_hashes(rows: DataFrame) -> DataFrame:
    """(host, page, digests) of every page: the subtrees that it holds, each once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, texts in slices(batch, "body"):
                found = [sorted(subtree_hashes(t)) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column("page"), cut.column("host"), pa.array(found, pa.list_(pa.int64()))], names=["page", "host", "digests"])

    seen = rows.select("page", "host", "body").mapInArrow(hashes, "page long, host string, digests array<long>")
    return seen.groupBy("host", "page").agg(F.array_distinct(F.flatten(F.collect_list("digests"))).alias("digests"))


def templates(once: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, digest) of the template subtrees, given those of every page."""
    # the counts of a hot host are combined before they are shuffled
    counted = once.select("host", F.explode(F.concat("digests", F.array(F.lit(None).cast("long")))).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n"))
    pages = counted.where("digest is null").select("host", F.col("n").alias("pages"))
    often = counted.where(f"digest is not null and n >= {int(min_pages)}").join(pages, "host").where((F.col("digest").bitwiseAND(F.lit(1)) == 1) | (F.col("n") >= F.least(F.lit(min_share) * F.col("pages"), F.lit(float(many_pages)))))
    return often.select("host", "digest")


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, deleted, text) of every page."""
    rows = _rows(pages)
    once = materialize(page_hashes(rows))
    known = materialize(templates(once, min_pages, min_share, many_pages))
    size = known.agg(F.coalesce(F.sum(16 + F.octet_length("host")), F.lit(0))).first()[0]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for batch in batches:
            for cut, texts in slices(batch, "body"):
                done = []
                for at, t, d in zip(cut.column("at").to_pylist(), texts.to_pylist(), cut.column("digests")):
                    own = sets.get(at)
                    if own is None:
                        own = frozenset(d.as_py() or ())
                        if at is not None:
                            sets[at] = own
                    done.append(extract(t, own))
                yield pa.RecordBatch.from_arrays([cut.column("page_id"), cut.column("host"), pa.array([n for _, n in done], pa.int32()), pa.array([t for t, _ in done], pa.string())], names=["page_id", "host", "deleted", "text"])

    if size <= broadcast_bytes:
        of_host = known.groupBy("host").agg(F.collect_set("digest").alias("digests"))
        joined = rows.join(F.broadcast(of_host), "host", "left").withColumn("at", F.col("host"))
    else:
        # every page gets those of its own subtrees that are template
        of_page = once.select("page", "host", F.explode("digests").alias("digest")).join(known, ["host", "digest"]).groupBy("page", "host").agg(F.collect_list("digest").alias("digests"))
        joined = rows.join(of_page, ["page", "host"], "left").withColumn("at", F.lit(None).cast("string"))
    return joined.select("page_id", "host", "body", "at", "digests").mapInArrow(take, "page_id long, host string, deleted int, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of all pages."""
    return extracted(table(spark, sf_dir, "pages"))
