"""Main text of HTML pages: the template that a site's pages share goes, what is left is the text.

Pass 1 parses every page and hashes its element subtrees in two ways.
  tree: tags and words of the subtree. Template if it stands on `share` of the host's distinct pages, or on many_pages
    of them, whichever is less, and on min_pages at least.
  slot: the path of tags and class names that leads to the subtree, whatever stands in it. Template if most pages of
    the host (half, slot_pages at least) have it, it holds under slot_text of a page's text on average, and what stands
    there is shared: mostly links, or at most half as many different contents as pages.
Counts are pre-aggregated by host and hash, so a host with a third of all pages is no group of its own. Copies of a
page count once. Pass 2 parses again, deletes template subtrees and writes the blocks of what is left.

Never template: an ancestor of <article> or <main>, and inside these paragraphs, headings, list items and cells (a
sentence that many articles share stays) or slots.

Fallback, for what no template tells (hosts of few pages, rare furniture): elements that are no article text by the
HTML standard go (nav, header, footer, aside, form and the like), and those named so by class, id or role, unless they
hold an <article> or <main> or, for forms and names, most of the page's text. Of the rest, all outermost <article>
elements are the text, else <main>, else the body. fallback=False leaves only what scripts, styles and heads are, so
the template alone decides.

White space in a block becomes one space, <br> is white space, blocks are joined by line feeds, character references
are decoded.

Defined cases: null or empty html gives an empty text; pages with a null url are hosts of their own; unclosed and stray
tags are repaired as browsers do for paragraphs, items and cells; nesting of any depth is walked without recursion; an
empty table gives an empty result; repeated pages are treated alike. Extra columns stay, `text` and `n_chars` are
replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import discard, stored
from tidemark.llm.url_rules import url_host

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)

#: Element names of HTML, fixed by its standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NO_TEXT = frozenset(["head", *RAW])
FURNITURE = frozenset("nav header footer aside form button select dialog menu svg canvas object audio video map".split()) | NO_TEXT
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article main section div body html table td th ul ol dl nav aside header footer form blockquote".split())
#: Words in class, id and role that name furniture.
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright disqus footer gdpr login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion related replies reply respond "
    "search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget".split()
)


#: First parts of class names that speak of a page's layout, not of the element.
LAYOUT = frozenset("no has with without not is hide hidden show".split())


def named(words: list[str]) -> bool:
    """Whether one of the class, id and role words names furniture: site-footer does, no-sidebar does not."""
    for word in words:
        parts = re.findall(r"[a-z]+", word)
        if parts and parts[0] not in LAYOUT and not NAMES.isdisjoint(parts):
            return True
    return False


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "words", "main", "digest", "size", "links", "out", "holds")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "", words: list[str] = (), main: bool = False):
        self.tag, self.parent, self.children, self.attrs, self.words, self.main = tag, parent, [], attrs, words, main


def attribute(attrs: str, name: str) -> str | None:
    """Value of an attribute with character references decoded."""
    for k, a, b, c in _ATTR.findall(attrs):
        if k.lower() == name:
            return unescape(a or b or c)
    return None


def parse(html: str) -> Node:
    """A tree of nodes and strings (character references decoded)."""
    root = here = Node("", None)
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            here.children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[1] or m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[0][1] == "/":
            node = here
            while node.parent is not None and node.tag != tag and not (tag in INLINE and node.tag in SCOPES):
                node = node.parent
            if node.tag == tag and node.parent is not None:
                here = node.parent
            continue
        closes = CLOSED_BY.get(tag)
        if closes or tag not in INLINE:
            node = here
            while node.parent is not None and node.tag not in SCOPES - {"td", "th"} and node.tag not in (closes or {"p"}):
                node = node.parent
            while node.parent is not None and node.tag in (closes or {"p"}):
                here = node = node.parent
        attrs = (m[2] if m[1] else m[4]) or ""
        words: list[str] = []
        role = ""
        if "=" in attrs and ("class" in attrs or "id" in attrs or "role" in attrs or "CLASS" in attrs):
            for k, a, b, c in _ATTR.findall(attrs):
                k = k.lower()
                if k in ("class", "id", "role"):
                    value = (a or b or c).lower()
                    role = value if k == "role" else role
                    words += value.split()
        node = Node(tag, here, attrs, words, tag in ("article", "main") or role == "main")
        here.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = close.start() if close else end
            done = html.find(">", at)
            at = done + 1 if close and done >= 0 else end
            continue
        here = node
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def measure(root: Node) -> list[Node]:
    """Sets of every node: digest (of the subtree: tags and words), size (characters of text), links (those within
    <a>), holds (whether it is or holds an article or main)."""
    found = nodes(root)
    for node in reversed(found):
        h = hashlib.blake2b(node.tag.encode("utf-8", "replace"), digest_size=8)
        size = links = 0
        holds = node.main
        for c in node.children:
            if isinstance(c, Node):
                h.update(c.digest)
                size += c.size
                links += c.links
                holds = holds or c.holds
            elif not c.isspace():
                h.update(b"\0" + " ".join(c.split()).encode("utf-8", "replace"))
                size += len(c)
        node.digest, node.holds = h.digest(), holds
        node.size = 0 if node.tag in NO_TEXT else size
        node.links = node.size if node.tag == "a" else links
    return found


def slots(root: Node) -> list[tuple[Node, int]]:
    """Nodes outside article and main that may fill a slot, with the number of the slot."""
    out, stack = [], [(root, b"")]
    while stack:
        node, path = stack.pop()
        for c in node.children:
            if isinstance(c, Node) and c.tag not in INLINE and c.tag not in NO_TEXT and not c.main:
                at = hashlib.blake2b(path + b"/" + ".".join([c.tag, *sorted(c.words)]).encode("utf-8", "replace"), digest_size=8).digest()
                if not c.holds and c.tag not in ("html", "body"):
                    out.append((c, number(at)))
                stack.append((c, at))
    return out


def within(found: list[Node]) -> set[int]:
    """ids of the nodes inside (not at) an article or main."""
    out: set[int] = set()
    for n in found:
        if n.parent is not None and (n.parent.main or id(n.parent) in out):
            out.add(id(n))
    return out


def candidates(found: list[Node]) -> set[int]:
    """Digests of subtrees that may be template."""
    inside = within(found)
    return {number(n.digest) for n in found if n.parent is not None and n.size and not n.holds and n.tag not in INLINE and n.tag not in ("html", "body") and not (id(n) in inside and n.tag in TEXT_BLOCKS)}


def furniture(found: list[Node], fallback: bool) -> None:
    """Sets out: whether a node goes whatever the template is."""
    most = max((n.size for n in found), default=0) / 2
    for n in found:
        n.out = n.tag in NO_TEXT
        if fallback and not n.out and not n.holds and n.tag not in ("html", "body", ""):
            n.out = n.tag in FURNITURE and (n.tag != "form" or n.size <= most) or named(n.words) and n.size <= most


def tops(root: Node, fallback: bool) -> list[Node]:
    """The nodes whose text is wanted, in page order: the outermost articles, else mains, else the root."""
    out: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [root]
    while stack and fallback:
        n = stack.pop()
        if n.out:
            continue
        if n.main:
            out["article" if n.tag == "article" else "main"].append(n)
        if n.tag != "article":
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out["article"] or out["main"][:1] or [root]


def blocks(top: Node, gone: set[int]) -> list[str]:
    """Texts of the blocks below top without the nodes whose ids are in `gone`."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(buffer).split()):
            out.append(text)
        buffer.clear()

    stack: list = [iter(top.children)]
    kinds = [True]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if kinds.pop():
                flush()
            continue
        if not isinstance(child, Node):
            buffer.append(child)
            continue
        block = child.tag not in INLINE
        if block:
            flush()
        elif child.tag == "br":
            buffer.append(" ")
        if child.out or id(child) in gone:
            continue
        stack.append(iter(child.children))
        kinds.append(block)
    return out


def main_text(html: str | None, template: frozenset[int] = frozenset(), fallback: bool = True) -> str:
    if not html:
        return ""
    root = parse(html)
    found = measure(root)
    furniture(found, fallback)
    gone: set[int] = set()
    if template:
        inside = within(found)
        gone = {id(n) for n in found if not n.holds and n.tag not in INLINE and not (id(n) in inside and n.tag in TEXT_BLOCKS) and number(n.digest) in template}
        gone |= {id(n) for n, slot in slots(root) if slot in template}
    return "\n".join(x for top in tops(root, fallback) for x in blocks(top, gone))


PAGE, TREE, SLOT = 0, 1, 2
FACTS = "host string, page long, kind int, tree long, content long, text double, links double"


def _facts(html: str):
    """For each page that a task meets first: its row, and those of its subtrees and slots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for batch in batches:
            rows: list[tuple] = []
            for host, key, page in zip(batch["host"], batch["page"], batch[html]):
                if not page or (host, key) in seen:
                    continue
                seen = set() if len(seen) > 1 << 20 else seen
                seen.add((host, key))
                root = parse(page)
                found = measure(root)
                whole = max(1, root.size)
                rows.append((host, key, PAGE, 0, 0, 0.0, 0.0))
                rows += [(host, key, TREE, d, 0, 0.0, 0.0) for d in candidates(found)]
                at: dict[int, list[Node]] = defaultdict(list)
                for n, slot in slots(root):
                    if n.size:
                        at[slot].append(n)
                for slot, ns in at.items():
                    size = sum(n.size for n in ns)
                    what = ns[0].digest if len(ns) == 1 else hashlib.blake2b(b"".join(n.digest for n in ns), digest_size=8).digest()
                    rows.append((host, key, SLOT, slot, number(what), size / whole, sum(n.links for n in ns) / size))
            yield pd.DataFrame(rows, columns=["host", "page", "kind", "tree", "content", "text", "links"])

    return run


def template_of(facts: DataFrame, share: float, min_pages: int, many_pages: int, slot_pages: int, slot_text: float) -> DataFrame:
    """host, tree (numbers of subtrees and slots) of the template."""
    one = facts.dropDuplicates(["host", "kind", "tree", "page"])
    by = one.groupBy("host", "kind", "tree", "content").agg(F.count("*").alias("n"), F.sum("text").alias("text"), F.sum("links").alias("links"))
    by = by.groupBy("host", "kind", "tree").agg(F.sum("n").alias("n"), F.count("*").alias("contents"), F.sum("text").alias("text"), F.sum("links").alias("links"))
    by = by.where(F.col("n") >= min_pages)
    whole = by.where(F.col("kind") == PAGE).select("host", F.col("n").alias("pages"))
    n, pages = F.col("n"), F.col("pages")
    tree = (F.col("kind") == TREE) & (n >= F.least(F.ceil(share * pages), F.lit(many_pages)))
    shared = (F.col("links") >= 0.5 * n) | (2 * F.col("contents") <= n)
    slot = (F.col("kind") == SLOT) & (n >= F.greatest(F.lit(slot_pages), F.ceil(0.5 * pages))) & (F.col("text") <= slot_text * n) & shared
    return by.where(F.col("kind") != PAGE).join(whole, "host").where(tree | slot).select("host", "tree")


def _texts(html: str, columns: list[str], fallback: bool, held=None):
    """held: a broadcast dict of each host's template; without it rows carry theirs in _template."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = (held.value.get(h, frozenset()) for h in batch["_host"]) if held else (frozenset() if t is None else frozenset(t) for t in batch["_template"])
            batch["text"] = [main_text(h, t, fallback) for h, t in zip(batch[html], own)]
            batch["n_chars"] = [len(t) for t in batch["text"]]
            yield batch[columns]

    return run


def page_host(url: Column, html: Column) -> Column:
    """Host of the URL; a page without a URL is a host of its own."""
    return F.when(url.isNull(), F.concat(F.lit(":"), F.xxhash64(html).cast("string"))).otherwise(url_host(url))


def extract(pages: DataFrame, share: float = 0.2, min_pages: int = 4, many_pages: int = 50, slot_pages: int = 16, slot_text: float = 0.3, fallback: bool = True, template: bool = True, url: str = "url", html: str = "html", broadcast_trees: int = 500_000) -> DataFrame:
    """pages with text and n_chars. template=False leaves pass 1 out, to compare."""
    pages = pages.drop("text", "n_chars")
    spark = pages.sparkSession
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    keyed = pages.withColumn("_host", page_host(F.col(url), F.col(html)))
    if not template:
        return keyed.mapInPandas(_texts(html, schema.names, fallback, spark.sparkContext.broadcast({})), schema)
    facts = keyed.select(F.col("_host").alias("host"), F.xxhash64(html).alias("page"), F.col(html)).mapInPandas(_facts(html), FACTS)
    facts = stored(facts, "subtrees")
    trees = stored(template_of(facts, share, min_pages, many_pages, slot_pages, slot_text), "template")
    if trees.count() <= broadcast_trees:
        by: dict[str, set] = defaultdict(set)
        for x in trees.collect():  # broadcast_trees rows at most
            by[x["host"]].add(x["tree"])
        held = spark.sparkContext.broadcast({h: frozenset(t) for h, t in by.items()})
        discard(facts, trees)
        return keyed.mapInPandas(_texts(html, schema.names, fallback, held), schema)
    # more: each page gets the numbers that it has itself, and no host's whole template
    own = facts.join(trees, ["host", "tree"], "left_semi").groupBy("host", "page").agg(F.collect_set("tree").alias("_template"))
    own = own.select(F.col("host").alias("_oh"), F.col("page").alias("_op"), "_template")
    joined = keyed.join(own, (F.col("_host") == F.col("_oh")) & (F.xxhash64(html) == F.col("_op")), "left")
    return joined.select(*pages.columns, "_template").mapInPandas(_texts(html, schema.names, fallback), schema)
