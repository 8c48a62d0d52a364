"""Main text of web pages by site template removal.

Every page is parsed into a tree and its element subtrees are hashed, from the leaves
up, by tag, class, id and content.  Spark counts per host on how many pages each subtree
occurs and inside how many different parents.  Subtrees that recur on many pages of
their host are the site's template and are deleted.  What the markup itself names as
menu, header, footer, sidebar, notice, advert, form, script or comment is deleted on
every page, so pages of small hosts are cleaned too.

An article may be copied on many pages, and may hold a sentence that others hold too.
So an article, what contains it, and plain text blocks inside it are never taken for
template; and a subtree counts as recurring only if its parents differ.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import rows, steps
from fillgauge.llm.url_filter import host_and_path
from fillgauge.operators.joins import attach
from fillgauge.session import settle

#: A subtree is template from this many pages of its host on, in that many different parents.
MIN_PAGES = 5

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option
p pre section summary table tbody td tfoot th thead title tr ul""".split())
DROPPED = frozenset("""script style textarea title xmp noscript iframe noembed noframes head nav aside footer form
button select input dialog menu template svg math canvas object audio video map""".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr figcaption caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}
#: Whole names in class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset("""ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs
comment comments commentlist complementary contentinfo cookie cookies consent disqus footer gdpr header login masthead
menu modal nav navbar navigation newsletter notice popup promo promotion related respond search share sharing sidebar
signup social sponsor sponsored subscribe toolbar widget widgets""".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "hash", "article", "marks", "named", "holds")

    def __init__(self, tag: str, parent: Node | None, rest: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.article = tag in ("article", "main")
        self.marks = ""
        self.named = self.holds = False
        self.dropped = tag in DROPPED
        if rest and "=" in rest or "hidden" in rest:
            self._look_at(rest)

    def _look_at(self, rest: str) -> None:
        found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
        self.marks = "|".join(found.get(k, "") for k in ("class", "id", "role"))
        names = set(self.marks.lower().replace("|", " ").split())
        self.article = self.article or found.get("role") == "main"
        hidden = ("hidden" in found or found.get("aria-hidden") == "true"
                  or "display:none" in found.get("style", "").replace(" ", "").lower())
        self.named = bool(names & NOT_ARTICLE) and self.tag not in ("html", "body")
        self.dropped = self.dropped or hidden


def parse(page: str) -> Node:
    """A tree of elements (:class:`Node`) and texts, as lenient as a browser about missing end tags."""
    root = Node("#root", None)
    now, at = root, 0
    low = None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside a script or the like
        if m.start() > at:
            now.children.append(page[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            node = now
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                now = node.parent
            continue
        if tag in BLOCK:
            now = _leave(now, {"p"}, {"table", "td", "th", "button", "object", "caption"})
            if tag in CLOSES:
                now = _leave(now, CLOSES[tag], FENCES[tag])
        node = Node(tag, now, m.group("rest"))
        now.children.append(node)
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find("</" + tag, at)
            at = len(page) if end < 0 else end
        elif tag not in VOID and not m.group("rest").endswith("/"):
            now = node
    # a tag that the end of the page cuts off is no text
    rest = page[at:]
    if rest:
        now.children.append(rest)
    return root


def _leave(now: Node, closed: set[str], fences: set[str]) -> Node:
    """Where a start tag goes that ends the innermost open element of ``closed``."""
    node = now
    while node.parent is not None and node.tag not in fences:
        if node.tag in closed:
            return node.parent
        node = node.parent
    return now


def label(root: Node) -> None:
    """Hash every subtree and spread what holds for ancestors; no recursion, as pages may nest deeply."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        digest = xxhash.xxh64(f"{node.tag}|{node.marks}")
        for child in node.children:
            if isinstance(child, Node):
                digest.update(child.hash.to_bytes(8, "little", signed=True))
            elif not child.isspace():
                digest.update(" ".join(child.split()))
        node.hash = digest.intdigest() - (1 << 63)
        # a page may name what holds the article after such a part; then the name says nothing
        node.holds = not node.dropped and (node.article or any(isinstance(c, Node) and c.holds for c in node.children))
        node.dropped = node.dropped or node.named and not node.holds


def _walk(root: Node) -> Iterator[tuple[Node, bool, bool]]:
    """(element, whether an article is around it, whether one is inside it) of what the markup leaves."""
    holds: set[int] = set()
    todo = [(root, False)]
    found = []
    while todo:
        node, inside = todo.pop()
        if node.dropped or node.tag == "header" and not inside:
            continue
        found.append((node, inside))
        if node.article:
            up = node
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
        todo += [(c, inside or node.article) for c in node.children if isinstance(c, Node)]
    for node, inside in found:
        yield node, inside, id(node) in holds


def candidates(root: Node) -> dict[int, int]:
    """Hash of each subtree that may be template, and of its parent."""
    return {node.hash: node.parent.hash for node, inside, holds in _walk(root)
            if node.parent is not None and node.tag in BLOCK and node.tag not in ("html", "body")
            and not holds and not (inside and node.tag in TEXT_BLOCKS)}


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the article, or of the whole page if none is marked, without template subtrees."""
    protected, only_article = {}, False
    for node, inside, holds in _walk(root):
        protected[id(node)] = holds or inside and node.tag in TEXT_BLOCKS
        only_article = only_article or node.article
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside or not only_article:
                line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif id(item) in protected and (protected[id(item)] or item.hash not in template):
            within = inside or item.article
            block = item.tag in BLOCK
            if block:
                flush()
                todo.append((None, inside))
            todo += [(c, within) for c in reversed(item.children)]
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; columns of these names are replaced.

    NULL or empty html gives the empty text.  Pages without a host (NULL url, no ``://``)
    are no site: only what their markup names is deleted.  Repeated rows are pages of
    their own.  White space inside a block becomes one space, blocks are joined by line
    feeds in page order.
    """
    if html in ("text", "n_chars"):
        raise ValueError("the column with the page must not be called like a result")
    host = host_and_path(F.col(url))[0]
    page_key = F.md5(F.concat_ws("\n", host, F.col(html)).cast("binary"))  # a page's subtrees follow from both
    sent = T.StructType([T.StructField("host", T.StringType()), T.StructField("page", T.StringType()),
                         T.StructField("subtree", T.LongType()), T.StructField("parent", T.LongType())])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, "html"):
            site, key, subtree, parent = [], [], [], []
            for name, place, page in zip(*(table.column(c).to_pylist() for c in ("host", "page", "html"))):
                root = parse(page or "")
                label(root)
                found = candidates(root)
                site += [name] * len(found)
                key += [place] * len(found)
                subtree += found.keys()
                parent += found.values()
            yield rows(sent, [site, key, subtree, parent])

    sites = pages.select(host.alias("host"), page_key.alias("page"), F.col(html).alias("html")).filter(F.col("host") != "")
    found_in = settle(sites.mapInArrow(hashes, sent))
    counted = (found_in.groupBy("host", "subtree", "parent").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("host", "subtree").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parents"))
               .filter((F.col("n") >= min_pages) & (F.col("parents") >= min_pages)))
    # every page gets those of its own subtrees only, so no list grows with the host
    templates = settle(attach(found_in.select("host", "page", "subtree"), counted.select("host", "subtree"),
                              ["host", "subtree"], how="inner")
                       .groupBy("page").agg(F.collect_set("subtree").alias("__template")))

    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in keep] + [
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, "__html"):
            found = []
            for page, template in zip(table.column("__html").to_pylist(), table.column("__template").to_pylist()):
                root = parse(page or "")
                label(root)
                found.append(main_text(root, set(template or ())))
            yield rows(schema, [*[table.column(f"__{i}") for i in range(len(keep))], found, [len(t) for t in found]])

    named = pages.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col(html).alias("__html"),
                         page_key.alias("page"))
    return attach(named, templates, ["page"], settled=True).mapInArrow(texts, schema)


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
