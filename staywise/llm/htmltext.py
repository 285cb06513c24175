"""Main text of web pages: site templates are found by counting, then removed.

Every element's subtree is hashed.  Spark counts, per host, on how many
different articles each hash occurs; subtrees that recur across many of them
are template and are deleted, wherever they stand.  Inside articles recurrence
alone is no proof: the articles must differ otherwise (near copies share their
paragraphs), and a single line must stand at one place on most articles.  Of
what is left, the article's blocks are kept, without the elements whose role
(tag, class, id) is navigation, advert, notice, form, comment and the like.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from staywise.llm.common import cut, map_batches, pick

_TAG = re.compile(r"<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: After so many < that open no tag, a tag must end within so many characters:
#: each search then has a bound, whatever a broken page holds.
BROKEN, SHORT_TAG = 32, 1024
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
#: Start tags that end an open paragraph or item of the same kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol table dl menu select body html article section div td th".split())
STOPS = SCOPE | frozenset("p li dt dd tr option".split())
_OPENS = frozenset("/!?abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Elements that are never part of the main text.
SKIP = frozenset("head script style noscript template textarea title xmp iframe nav footer aside form button select input menu dialog svg object canvas".split())
#: The same by words of class, id or role.
ROLES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments "
    "disqus replies share sharing social newsletter subscribe signup login search related recommended widget widgets pagination "
    "pager toolbar complementary contentinfo".split())
#: Those that also name subjects; inside an article they count only where the subtree recurs on the host.
WEAK = frozenset(
    "notice notices alert related recommended social share sharing search cookie cookies consent gdpr menu banner promotion "
    "login signup".split())
STRONG = ROLES - WEAK
#: Blocks that hold others; of the rest only those that do are deleted for a name alone.
CONTAINERS = frozenset("article aside details div dl fieldset figure footer form header main menu nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Node:
    tag: str
    marks: frozenset[str] = frozenset()  # words of class, id and role
    names: frozenset[str] = frozenset()  # whole names of class and role, and the id
    raw: str = ""
    children: list = field(default_factory=list)
    hash: int = 0
    own: bool = False  # has text outside inner blocks
    lines: int = 0  # blocks with text of their own, itself included


class Open:
    """The open elements, with the places of each tag, of all blocks and of
    those that end or bound paragraphs and items, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks, self.stops = [root], {}, [], []

    def push(self, n: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(n)
        self.places.setdefault(n.tag, []).append(at)
        if n.tag in BLOCK:
            self.blocks.append(at)
        if n.tag in STOPS:
            self.stops.append(at)

    def close(self, at: int) -> None:
        """The element at ``at`` and all inside it."""
        while len(self.nodes) > at:
            n = self.nodes.pop()
            for places in (self.places[n.tag], self.blocks, self.stops):
                if places and places[-1] == len(self.nodes):
                    places.pop()

    def end(self, tag: str) -> None:
        places = self.places.get(tag)
        if places and (tag in BLOCK or not self.blocks or places[-1] > self.blocks[-1]):  # an inline end does not close blocks
            self.close(places[-1])

    def end_open(self, tags: set[str], scope: frozenset[str] | set[str]) -> None:
        for at in reversed(self.stops):
            tag = self.nodes[at].tag
            if tag in tags:
                self.close(at)
            if tag in tags or tag in scope:
                return


def parse(page: str) -> Node:
    """A tolerant element tree: unknown ends ignored, missing ends supplied."""
    root = Node("#root")
    stack, at, broken = Open(root), 0, 0
    while at < len(page):
        lt = page.find("<", at)
        if lt >= 0 and page.startswith("<!--", lt):
            if lt > at:
                stack.nodes[-1].children.append(page[at:lt])
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt, len(page) if broken < BROKEN else lt + SHORT_TAG) if lt >= 0 else None
        if m is None:
            broken += lt >= 0 and page[lt + 1:lt + 2] in _OPENS
            to = len(page) if lt < 0 else lt + 1  # a lone < is text
            stack.nodes[-1].children.append(page[at:to])
            at = to
            continue
        if lt > at:
            stack.nodes[-1].children.append(page[at:lt])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            stack.end(tag)
            continue
        if tag in BLOCK:
            stack.end_open({"p"}, SCOPE | {"li"})
        if tag in ENDS:
            stack.end_open(ENDS[tag], SCOPE - ({"td", "th"} if tag in ("tr", "td", "th") else set()))
        node = Node(tag, *(roles(tag, m[3]) if m[3] else ()))
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            node.raw = page[at:end.start()] if end else page[at:]
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            stack.push(node)
    return root


def roles(tag: str, attributes: str) -> tuple[frozenset[str], frozenset[str]]:
    """(words of class, id and role, whole names of class and role and the id).
    A heading's id is made of its text and is no name."""
    marks, names = set(), set()
    for name, *value in _ATTRIBUTE.findall(attributes):
        if (name := name.lower()) in ("class", "id", "role"):
            text = "".join(value).lower()
            marks.update(w for w in re.split(r"[^a-z0-9]+", text) if w)
            if name != "id":
                names.update(text.split())
            elif tag not in HEADINGS:
                names.add(text.strip())
    return frozenset(marks), frozenset(names)


def digest(root: Node) -> None:
    """Hashes all subtrees and counts their lines, children first, without recursion."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        parts = [n.tag, *sorted(n.marks), n.raw]
        parts += [f"\x01{c.hash:x}" if isinstance(c, Node) else " ".join(c.split()) for c in n.children]
        n.hash = xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
        n.own = any(c.own and c.tag not in BLOCK if isinstance(c, Node) else not c.isspace() for c in n.children)
        n.lines = sum(c.lines for c in n.children if isinstance(c, Node)) + (n.own and n.tag in BLOCK)


def skipped(n: Node, inside: bool) -> bool:
    """Not main text by its role.  Inside the article a header is text, and only
    a whole name that is not weak decides alone, of a block that holds others:
    a paragraph, a heading or an element inside a line (a comment in a listing)
    goes only if it recurs."""
    if inside:
        return n.tag in SKIP or not STRONG.isdisjoint(n.names) and holds(n)
    return n.tag in SKIP or not ROLES.isdisjoint(n.marks) or n.tag == "header"


def holds(n: Node) -> bool:
    return n.tag in CONTAINERS or n.tag in BLOCK and n.tag != "pre" and any(isinstance(c, Node) and c.tag in BLOCK for c in n.children)


def hinted(n: Node) -> bool:
    """Has a role word, be it weak or part of a name: not main text if it recurs."""
    return not ROLES.isdisjoint(n.marks)


def articles(root: Node) -> list[Node]:
    """The article elements, else main elements, else the whole page."""
    for want in ("article", "main"):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.tag == want or (want == "main" and "main" in n.marks and n.tag in BLOCK):
                found.append(n)
            elif not skipped(n, False) or n.tag == "header":
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


#: Where a block stands: outside the article, inside it, or on a page that has none; or, not outside, that a role word hints at it.
OUTSIDE, INSIDE, PLAIN, HINTED = range(4)


def walk(root: Node, tops: list[Node]):
    """(node, where it stands, (depth, place among its siblings) from the start
    and from the end) of every block, and in the text of every element with a
    role word, that has content."""
    within, own = PLAIN if tops[0] is root else INSIDE, {id(t) for t in tops}
    todo = [(root, OUTSIDE, 0, 0, 0)]
    while todo:
        n, where, depth, start, end = todo.pop()
        top = id(n) in own
        if n.children and (where or not top):
            if where and hinted(n):
                yield n, HINTED, depth << 32 | start, depth << 32 | end
            elif n.tag in BLOCK:
                yield n, where, depth << 32 | start, depth << 32 | end
        nodes = [c for c in n.children if isinstance(c, Node)]
        todo += [(c, within if top else where, 1 if top else depth + 1, i, len(nodes) - 1 - i) for i, c in enumerate(nodes)]


def identity(tops: list[Node]) -> int:
    """Hash of the article."""
    return signed(xxh64_intdigest(repr([t.hash for t in tops]).encode()))


def subtrees(page: str) -> tuple[int, set[tuple[int, int]]]:
    """(hash of the article, {(hash, where it stands)}) of every block with content."""
    root = parse(page)
    digest(root)
    tops = articles(root)
    return identity(tops), {(signed(n.hash), where) for n, where, _, _ in walk(root, tops)}


#: Odd factors, one per least hash of an article's signature.
FACTORS = np.random.default_rng(9).integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(line: str, width: int = 3) -> np.ndarray:
    """Least hashes of the line's runs of ``width`` words, one per factor."""
    words = line.split()
    runs = {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}
    h = np.array([xxh64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs], dtype=np.uint64)
    return np.min([(h[i:i + 4096, None] * FACTORS).min(axis=0) for i in range(0, len(h), 4096)], axis=0)


def signature(text: str, known: dict[str, np.ndarray]) -> list[int]:
    """Least hashes over all lines: near copies agree on most."""
    lines = text.split("\n")
    for x in lines:
        if x not in known:
            known[x] = least_hashes(x)
    return np.min([known[x] for x in lines], axis=0).view(np.int64).tolist()


def held_blocks(page: str, wanted: set[int]) -> tuple[int, list[tuple[int, int, bool, list[int]]]]:
    """(hash of the article, [(hash, where it stands, is a single line, [*signature
    of the other text, place from the start, place from the end])] of the wanted
    blocks not outside."""
    root = parse(page)
    digest(root)
    tops = articles(root)
    held: dict[tuple[int, int], tuple[bool, int, int]] = {}
    for n, where, start, end in walk(root, tops):
        key = signed(n.hash), where
        if where and key[0] in wanted:
            _, s, e = held.get(key, (False, start, end))
            held[key] = (n.lines <= 1, min(s, start), min(e, end))
    known: dict[str, np.ndarray] = {}
    return identity(tops), [(*key, line, [*signature(text_of(tops, {key[0]}), known), start, end])
                            for key, (line, start, end) in held.items()]


def main_text(page: str, template: set[int]) -> str:
    """Blocks of the article in page order, one per line."""
    root = parse(page)
    if template:
        digest(root)
    return text_of(articles(root), template)


def text_of(tops: list[Node], template: set[int]) -> str:
    blocks: list[list[str]] = [[]]
    for top in tops:
        blocks.append([])
        todo: list = [top]
        while todo:
            n = todo.pop()
            if n is None:
                blocks.append([])
            elif isinstance(n, str):
                blocks[-1].append(n)
            elif n.tag in ("br", "wbr"):
                blocks[-1].append(" " if n.tag == "br" else "")
            elif (n is top or not skipped(n, True)) and not (template and signed(n.hash) in template):
                edge = [None] if n.tag in BLOCK else []
                todo += edge
                todo += reversed(n.children)
                todo += edge
        blocks.append([])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, min_pages: int = 5, outside: float = 0.005, inside: float = 0.2) -> DataFrame:
    """(host, template): hashes of the subtrees that recur on at least
    ``min_pages`` different articles of a host and on at least this share of
    them, outside or inside the article; a page without an article, and an element
    with a role word, is judged by the share for outside.  What stands inside, or on such a page, needs
    ``proof``.  A host's list is bounded by its page size over the share.

    ``pages`` has page_id, url, host and html."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            article, found = subtrees(page or "")
            out.append((host, article, 0, None))
            out += [(host, article, h, i) for h, i in found]
        hosts, art, hashes, where = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(art, pa.int64()), pa.array(hashes, pa.int64()), pa.array(where, pa.int8())],
            ["host", "article", "hash", "where"])

    seen = map_batches(pages.select("host", "html"), run, "host string, article long, hash long, where byte").distinct()
    n = seen.groupBy("host", "hash", "where").agg(F.count(F.lit(1)).alias("n"))
    # one row per host has no hash: its number of different articles
    where = F.col("where")
    n = cut(n.where((F.col("n") >= min_pages) | where.isNull()))
    totals = n.where(where.isNull()).select(F.col("host").alias("h_"), F.col("n").alias("all"))
    hit = n.where(where.isNotNull()).join(totals, F.col("host") == F.col("h_"))
    share = F.when(where == INSIDE, F.lit(inside)).otherwise(F.lit(outside))
    hit = hit.where(F.col("n") >= share * F.col("all"))
    sure = hit.where(where == OUTSIDE).select("host", "hash")
    maybe = cut(hit.where(where != OUTSIDE).join(sure, ["host", "hash"], "left_anti").select("host", "hash", "where", "all"))
    if not maybe.isEmpty():
        sure = sure.unionByName(proof(pages, maybe))
    return sure.groupBy("host").agg(F.collect_set("hash").alias("template"))


def proof(pages: DataFrame, maybe: DataFrame, differ: float = 0.4, inside: float = 0.5, plain: float = 0.75) -> DataFrame:
    """(host, hash) of the blocks not outside the article that are template.

    The articles that hold a block must differ besides: by one least hash or another at
    least ``differ`` of them are distinct (and more of a few, whose share is less
    sure), which near copies are by none.  A block of a single line, which
    articles may share as any phrase, must stand at one place from the start or
    the end: on at least the share ``inside`` of all the host's articles, or on
    pages without an article on the share ``plain`` of those that hold it.  For
    one with a role word the word stands in for the place."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for host, page, wanted in zip(*(b.column(c).to_pylist() for c in ("host", "html", "template"))):
            article, held = held_blocks(page or "", set(wanted))
            out += [(host, article, *row) for row in held]
        if not out:
            return None
        types = (pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.bool_(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), types)], ["host", "article", "hash", "where", "line", "marks"])

    lists = maybe.groupBy("host").agg(F.collect_set("hash").alias("template"))
    held = with_templates(pages, lists).where("template is not null").select("host", "html", "template")
    held = map_batches(held, run, "host string, article long, hash long, where byte, line boolean, marks array<long>").distinct()
    block = ["host", "hash", "where", "line"]
    value = held.select(*block, F.posexplode("marks").alias("kind", "value"))
    value = value.groupBy(*block, "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    kind = value.groupBy(*block, "kind").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("same"), F.sum("n").alias("n"))
    sig = F.col("kind") < len(FACTORS)
    found = kind.groupBy(*block).agg(
        F.max(F.when(sig, F.col("distinct"))).alias("distinct"), F.max(F.when(~sig, F.col("same"))).alias("same"), F.max("n").alias("n"))
    found = found.join(maybe, ["host", "hash", "where"])
    least = F.when(F.col("where") == INSIDE, F.lit(inside) * F.col("all")).otherwise(F.lit(plain) * F.col("n"))
    found = found.where(~F.col("line") | (F.col("where") == HINTED) | (F.col("same") >= least))
    found = found.where(F.col("distinct") - 1 >= (F.lit(differ) + 1 / F.sqrt("n")) * (F.col("n") - 1))
    return found.select("host", "hash").distinct()


#: Bytes of template lists up to which every task gets all of them.
SHARED_BYTES = 16 << 20
#: Parts that each host's pages are dealt to where the lists are larger.
PARTS = 64


def with_templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Adds each page's template list.  The lists are broadcast if they measure
    no more than ``SHARED_BYTES``; else pages are joined by host and part, so
    that a host with a third of all pages is not one task's."""
    found = cut(found.withColumnRenamed("host", "host_"))
    held = found.agg(F.coalesce(F.sum(8 * F.size("template") + F.length("host_")), F.lit(0))).first()[0]
    if held <= SHARED_BYTES:
        return pages.join(F.broadcast(found), F.col("host") == F.col("host_"), "left")
    found = found.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")
    return pages.join(found, (F.col("host") == F.col("host_")) & (part == F.col("part_")), "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text ('' if none), n_chars (code points).

    Null and empty pages have no text; pages with a null url share one nameless
    host.  Repeated rows give one row each and count as one article.  Other
    columns are not read."""
    p = pick(pages, page_id=id_col, url=url_col, html=html_col)
    p = p.withColumn("host", host_of(F.col("url")))
    p = with_templates(p, templates(p)).select("page_id", "url", "html", "template")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [main_text(page or "", set(t or ())) for page, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
            ["page_id", "url", "text", "n_chars"])

    kind = p.schema["page_id"].dataType.simpleString()
    return map_batches(p, run, f"page_id {kind}, url string, text string, n_chars long")
