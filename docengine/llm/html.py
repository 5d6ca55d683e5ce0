"""Main text of web pages by removal of site templates.

A tolerant scanner turns a page into a tree of its block elements. Every subtree gets a
hash of its tags and texts. Spark counts, for each host, the different pages on which a
subtree stands; a subtree on ``least`` pages or more, and on ``share`` of the host's pages
(one in a thousand, so that a host's list has at most 1,000 times the subtrees of a mean
page), is part of the site's template and is deleted from its pages. A page is counted by
its content: copies count once, and a subtree inside an article counts by the different
articles that hold it. In an article, paragraphs, headings and what holds them are never
templates: articles may quote and copy one another.

Counts cannot know the template of a site of one or two pages, nor what differs from page
to page, as readers' comments do. There, what a page declares is the fallback (``declared``):
where it marks its article or main element, only that is kept, and navigation, headers,
footers, sidebars, adverts, notices, forms and comments go by element, role or class.
Without it, only templates and what is never shown are deleted.

Text: character references decoded, white space inside a block turned into one space,
blocks joined in page order by one line feed. A null or empty page has an empty text;
null or odd URLs share one host. Equal pages of a host have equal texts, and repeated rows
stay. An empty table gives an empty result. A column of the output's name is replaced;
others are kept, whatever their names.

Counting moves 24 bytes a subtree. Templates reach the pages as one broadcast if there are
``max_broadcast`` hashes or fewer (8 bytes each); else each page's own hashes are
intersected with its host's list in a join, which Spark may split for a host with most pages.
"""

import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.shared import materialize

SHARE = 0.001
LEAST = 3

# Names of elements, roles and classes of HTML pages.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta nobr "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr base area param source track embed".split()
)
DROPPED = frozenset(
    "head title nav footer aside form script style noscript template iframe object svg canvas button select "
    "textarea dialog menu audio video math".split()
)
#: Never shown, with or without what a page declares.
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
CLOSED_BY = {
    "p": frozenset(
        "p div ul ol dl table h1 h2 h3 h4 h5 h6 article section aside nav header footer main form pre blockquote "
        "figure hr address details fieldset".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption br hr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
CLASSES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent notice notices popup modal comment comments disqus reply "
    "replies share sharing social related newsletter subscribe signup widget".split()
)
#: A word of CLASSES drops an element as a whole class or id, or in a compound with one of these.
PARTS = "area bar block box btn button buttons container form icon icons inner item items link links list menu panel section slot unit widget wrap wrapper"
COMPOUND = re.compile(
    rf"(?:(?:main|page|primary|secondary|site|top|bottom|left|right)[-_])?(?:{'|'.join(sorted(CLASSES))})(?:[-_](?:{'|'.join(PARTS.split())}|\d+))?"
)
#: Never dropped for a class or id.
KEPT = frozenset("html body main article".split())
#: These are dropped outside the main element only; inside it they hold the article's own title.
OUTER = frozenset(["header", "masthead", "banner"])

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("tag", "parent", "dropped", "main", "inside", "parts", "hash", "template", "held")

    def __init__(self, tag, parent, dropped, main):
        self.tag, self.parent, self.dropped, self.main = tag, parent, dropped, main
        self.inside = main or (parent is not None and parent.inside)
        #: child nodes and texts, in order
        self.parts, self.hash, self.template = [], 0, False
        #: of an inline node, the text before it, which goes on after it
        self.held = []


def parse(page: str) -> Node:
    """The tree of block elements; inline elements are only their text, which joins its block."""
    root = Node("#", None, False, False)
    at, text, pos, size = root, [], 0, len(page)

    def flush():
        if text:
            # one block of text; white space is settled later
            at.parts.append("".join(text))
            text.clear()

    def leave(to):
        nonlocal at
        while at is not to:
            flush()
            text.extend(at.held)
            at = at.parent

    while pos < size:
        m = TOKEN.match(page, pos)
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                text.append(piece)
            continue
        tag = tag.lower()
        if m.group(1):
            node = at
            while node is not None and node.tag != tag and (tag not in INLINE or node.tag in INLINE):
                node = node.parent
            if node is not None and node.tag == tag:
                leave(node.parent)
            if tag not in INLINE:
                flush()
            continue
        attributes = m.group(3)
        attributed = "class" in attributes or "id" in attributes or "role" in attributes
        if tag in INLINE and at.tag not in INLINE and not attributed:
            continue
        if tag in RAW:
            # its content is no markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            if not attributes.endswith("/"):
                pos = end.end() if end else size
            continue
        marks, role = set(), ""
        if attributes:
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                value = (a or b or c).lower()
                if key.lower() == "role":
                    role = value.strip()
                else:
                    marks.update(value.split())
        main = tag in ("article", "main") or role == "main"
        dropped = tag in DROPPED or role in ROLES or (tag not in KEPT and any(map(COMPOUND.fullmatch, marks)))
        # in a dropped inline element, others count to find its end
        if tag in INLINE and not dropped and at.tag not in INLINE:
            continue
        if tag in ("br", "hr"):
            flush()
            continue
        void = attributes.endswith("/") or tag in ("img", "input", "link", "meta", "embed", "source", "track", "wbr", "area", "base", "param")
        if tag in INLINE:
            if not void:
                node = Node(tag, at, True, False)
                at.parts.append(node)
                node.held, at = text[:], node
                text.clear()
            continue
        while True:
            # a paragraph that ends takes along inline elements that were left open
            node = at
            while node.tag in INLINE:
                node = node.parent
            if node.tag not in CLOSED_BY or tag not in CLOSED_BY[node.tag]:
                break
            leave(node)
            flush()
            at = node.parent
        flush()
        if (tag in OUTER or tag not in KEPT and not marks.isdisjoint(OUTER)) and not at.inside and not main:
            dropped = True
        node = Node(tag, at, dropped or at.dropped, main and not dropped and not at.dropped)
        at.parts.append(node)
        if not void:
            at = node
    leave(root)
    flush()
    return root


def settled(text: str) -> str:
    return " ".join((references.unescape(text) if "&" in text else text).split())


def hashed(root: Node) -> list[Node]:
    """All nodes, children first, with the hashes of their subtrees; texts become settled."""
    from xxhash import xxh64_intdigest

    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node))
    order.reverse()
    for node in order:
        node.parts = [p if isinstance(p, Node) else settled(p) for p in node.parts]
        node.parts = [p for p in node.parts if p]
        seed = "\x01".join([node.tag, *(f"\x02{p.hash:x}" if isinstance(p, Node) else p for p in node.parts)])
        node.hash = xxh64_intdigest(seed.encode("utf-8", "surrogatepass")) - (1 << 63)
    return order


def candidates(root: Node) -> list[Node]:
    """Nodes that may be a template: not those that hold the main element, nor prose in it, nor empty ones."""
    nodes, holds = hashed(root), set()
    for node in nodes:
        # what holds the main element, or in it prose that is no bare list
        if node.main or id(node) in holds or (node.inside and node.tag in PROSE and node.tag != "li" and node.parts and not node.dropped):
            while node.parent is not None and id(node.parent) not in holds:
                node = node.parent
                holds.add(id(node))
    return [n for n in nodes if n.parts and n.parent is not None and not n.main and id(n) not in holds and n.tag not in ("html", "body") and not (n.inside and n.tag in PROSE)]


def subtrees(page: str | None) -> list[tuple]:
    """Different (hash, content) of the subtrees of a page that may be templates, and (None, content) for the page.

    content is the hash of the outermost main element that holds the subtree, else of the page.
    """
    if not page:
        return []
    root = parse(page)
    nodes, out = candidates(root), set()
    for n in nodes:
        content, up = root.hash, n
        while n.inside and up is not None:
            if up.main:
                content = up.hash
            up = up.parent
        out.add((n.hash, content))
    return [(None, root.hash), *sorted(out)]


def main_text(page: str | None, templates, declared: bool = True) -> str:
    """The text of a page without the given templates (anything with ``in``) and, if ``declared``, without what it declares to be no article."""
    if not page:
        return ""
    root = parse(page)
    known = set(templates or ()) if isinstance(templates, (list, tuple)) else templates
    for node in candidates(root):
        node.template = node.hash in known
    only_main, stack = False, [root] if declared else []
    while stack and not only_main:
        node = stack.pop()
        only_main = node.main
        stack.extend(p for p in node.parts if isinstance(p, Node))
    out, stack = [], [(root, False)]
    while stack:
        part, inside = stack.pop()
        if isinstance(part, str):
            if inside or not only_main:
                out.append(part)
        elif not part.template and not (part.dropped if declared else part.tag in HIDDEN):
            stack.extend((p, part.inside) for p in reversed(part.parts))
    return "\n".join(out)


def host_of(url):
    """Host as the URL filter takes it; empty for a null or odd URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


class Sorted:
    """Membership in a sorted array."""

    def __init__(self, values):
        self.values = values

    def __contains__(self, x) -> bool:
        at = self.values.searchsorted(x)
        return at < len(self.values) and self.values[at] == x


def templates_of(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, templates): the hashes of the template of each host that has one, for ``pages`` (host, html)."""

    @F.arrow_udf("array<struct<hash:long,content:long>>")
    def found(rows: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("content", pa.int64())]))
        return pa.array([[{"hash": h, "content": c} for h, c in subtrees(x.as_py())] for x in rows], kind)

    counts = pages.select("host", F.explode(found("html")).alias("s")).select("host", "s.*").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "subtrees")
    seen = counts.where(F.col("hash").isNotNull() & (F.col("n") >= least))
    sizes = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    return seen.join(sizes, "host").where(F.col("n") >= F.col("pages") * share).groupBy("host").agg(F.collect_list("hash").alias("templates"))


def extract(
    pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", share: float = SHARE, least: int = LEAST, declared: bool = True, max_broadcast: int = 4_000_000
) -> DataFrame:
    """``pages`` with the main text in column ``out``."""
    hosted = pages.select(F.struct("*").alias("row"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    lists = materialize(templates_of(hosted.select("host", "html"), share, least), "templates")
    n = lists.agg(F.sum(F.size("templates") + 8)).first()[0] or 0
    if n <= max_broadcast:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: np.sort(np.array(r["templates"], np.int64)) for r in lists.toLocalIterator()})

        @F.arrow_udf("string")
        def text_of(rows: pa.Array, hosts: pa.Array) -> pa.Array:
            none = np.zeros(0, np.int64)
            return pa.array([main_text(x.as_py(), Sorted(known.value.get(h.as_py(), none)), declared) for x, h in zip(rows, hosts, strict=True)], pa.string())

        df = hosted.select("row", text_of("html", "host").alias("made"))
    else:

        @F.arrow_udf("array<long>")
        def hashes(rows: pa.Array) -> pa.Array:
            return pa.array([sorted({h for h, _ in subtrees(x.as_py()) if h is not None}) for x in rows], pa.list_(pa.int64()))

        @F.arrow_udf("string")
        def text_by(rows: pa.Array, templates: pa.Array) -> pa.Array:
            return pa.array([main_text(x.as_py(), t.as_py() or [], declared) for x, t in zip(rows, templates, strict=True)], pa.string())

        # a row takes along only the templates that it holds
        df = hosted.withColumn("own", hashes("html")).join(lists, "host", "left").select("row", "html", F.array_intersect("own", "templates").alias("own"))
        df = df.select("row", text_by("html", "own").alias("made"))
    return df.select(*(F.col("row")[c].alias(c) for c in pages.columns if c != out), F.col("made").alias(out))


def op4_html_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
