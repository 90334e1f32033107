"""Main text of web pages by removing site templates.

Element subtrees are hashed page by page and counted per host in Spark;
subtrees that recur across many pages of a host are deleted, together with
elements that by name, role or class are no article: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, small_enough
from .urlfilter import split_url

# Elements that are content of their own even if they recur: paragraphs and headings of an article, and what spans the page.
KEPT = frozenset({"#root", "html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figure", "figcaption"})
#: A subtree is a template of its host if it is on at least so many pages of different main texts, however many pages the host has.
MIN_PAGES = 4
#: Templates are sent to the workers for up to this many (host, subtree) pairs; with more, each page is joined with its own.
BROADCAST_TEMPLATES = 1_000_000

# Elements by their part in a page.
RAW = frozenset({"script", "style", "noscript", "template", "textarea", "title"})
DROPPED = frozenset({"nav", "header", "footer", "aside", "form", "button", "select", "iframe", "object", "svg", "canvas", "dialog", "menu", "head", *RAW})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
INLINE = frozenset({"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"})
NOISE_WORDS = frozenset({"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "footer", "header", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"})
# Words that leave a class a name of noise when they stand next to such a word; any other word (with-sidebar, no-comments, share-price) does not.
PLAIN_WORDS = frozenset({"area", "bar", "block", "bottom", "box", "buttons", "container", "content", "global", "inner", "item", "items", "left", "links", "list", "main", "page", "primary", "right", "secondary", "section", "site", "top", "wrapper"})
# Nouns that make a name one of noise whatever words stand before them, and words behind them that only name a part.
NOISE_HEADS = frozenset({"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "menu", "nav", "navbar", "navigation", "newsletter", "popup", "respond", "sidebar", "sponsored"})
PART_WORDS = frozenset({"area", "bar", "body", "box", "container", "feed", "form", "inner", "item", "items", "links", "list", "posts", "reply", "section", "signup", "slot", "thread", "unit", "widget", "wrapper"})
# Words that tell of noise that is beside the element, or is not there.
ASIDE_WORDS = frozenset({"allow", "disable", "disabled", "enable", "enabled", "has", "have", "hide", "is", "no", "non", "off", "on", "open", "show", "with", "without"})
NOISE_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"})
CLOSES_P = frozenset({"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"})
P_SCOPE = ("article", "body", "div", "section", "td", "th", "li", "blockquote", "main", "table")
LIST_SCOPE = ("ul", "ol", "dl", "table", "select", "article", "body")
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
# A name without value matches too, so that no long name is tried again from its middle.
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    """noise: 0 for content, 1 for noise by class, id or role, 2 by element or since it isn't shown."""

    __slots__ = ("tag", "noise", "kids", "hash")

    def __init__(self, tag: str, noise: int):
        self.tag, self.noise, self.kids, self.hash = tag, noise, [], None


def _noisy_name(name: str) -> bool:
    """Whether a class or id names noise: its head noun does (part names behind it left off), or all of its words do."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if not words:
        return False
    if len(words) == 1:  # commentlist, navbar: a noun and a part in one word
        words = next(([words[0][:k], words[0][k:]] for k in range(3, len(words[0])) if words[0][:k] in NOISE_HEADS and words[0][k:] in PART_WORDS), words)
    if not NOISE_WORDS.isdisjoint(words) and NOISE_WORDS | PLAIN_WORDS >= {*words}:
        return True
    if not ASIDE_WORDS.isdisjoint(words):
        return False
    if words[0] == "related" and {*words[1:]} <= PART_WORDS | PLAIN_WORDS:
        return True
    while len(words) > 1 and words[-1] in PART_WORDS:
        words.pop()
    return words[-1] in NOISE_HEADS


def _noise(tag: str, attrs: str, in_article: bool) -> int:
    if tag in DROPPED and not (tag == "header" and in_article):  # an article's own header holds its headline
        return 2
    if tag in ("html", "body", "main", "header") or "=" not in attrs and "hidden" not in attrs:
        return 0
    if tag == "article":  # of an article's names only those of a comment count
        names = " ".join(m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id")).lower().split()
        return 2 if any("comment" in n and _noisy_name(n) for n in names) else 0
    found = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and any(map(_noisy_name, value.split())) or name == "role" and value.strip() in NOISE_ROLES:
            found = 1
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
    return 2 if re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)) else found


class _Open:
    """The open elements, with the places of each tag among them, so that no tag needs a walk over all of them."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()


def parse(page: str | None) -> Node:
    """A forgiving tree: unclosed paragraphs, items and cells end where HTML ends them, stray end tags are ignored."""
    root = Node("#root", 0)
    open_, at, page = _Open(root), 0, page or ""
    while True:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            open_.stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if place := open_.last((tag,)):
                open_.close(place)
            continue
        ends, until = (("p",), P_SCOPE) if tag in CLOSES_P else (SELF_CLOSING.get(tag, ()), LIST_SCOPE)
        if (place := open_.last(ends)) > open_.last(until):
            open_.close(place)
        node = Node(tag, _noise(tag, m[3], open_.last(("article",)) > 0))
        open_.stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.push(node)
    if at < len(page):
        open_.stack[-1].kids.append(page[at:])
    return root


def hash_subtrees(root: Node) -> set[int]:
    """Hashes of the containers that hold text, by tag and content; sets each node's hash.  Walks without recursion."""
    found, todo = set(), [(root, False)]
    while todo:
        node, done = todo.pop()
        if not done:
            todo.append((node, True))
            todo += [(k, False) for k in node.kids if isinstance(k, Node)]
            continue
        parts, filled = [node.tag], False
        for k in node.kids:
            if isinstance(k, Node):
                if k.hash:
                    parts.append(str(k.hash))
                    filled = True
            elif k := _SPACE.sub(" ", k).strip():
                parts.append(k)
                filled = True
        node.hash = xxhash.xxh64_intdigest("\x1f".join(parts)) - 2**63 if filled else 0
        if filled and node.tag not in KEPT and node.tag not in INLINE:
            found.add(node.hash)
    return found


def main_text(root: Node, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of the articles (else of main, else of the body), without noise and template subtrees.

    Articles and main elements inside noise are taken only if there are no
    others and the noise is told by a class, id or role alone; an article whose
    class or id tells of a comment never is.
    """
    top = next((found for level in (1, 2) for tag in ("article", "main") if (found := _first(root, tag, level))), [root])
    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        if text := _SPACE.sub(" ", html.unescape("".join(current))).strip():
            blocks.append(text)
        current.clear()

    for start in top:
        todo: list = [start]
        while todo:
            k = todo.pop()
            if k is None:
                flush()
            elif isinstance(k, str):
                current.append(k)
            elif k.tag == "br":
                current.append(" ")
            elif not (k.noise or (k.hash in templates and k is not start)):
                block = k.tag not in INLINE
                if block:
                    flush()
                    todo.append(None)
                todo += reversed(k.kids)
        flush()
    return " ".join(blocks)


def _first(root: Node, tag: str, noise: int) -> list[Node]:
    """The outermost elements of a tag that no noise of this level holds or is."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            found.append(node)
        else:
            todo += [k for k in reversed(node.kids) if isinstance(k, Node) and k.noise < noise]
    return found


def site_templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(host, hash) of the template subtrees, and the subtrees of each page: id, host, hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            roots = [parse(h) for h in b.column(2).to_pylist()]
            found = [sorted(hash_subtrees(r)) for r in roots]
            main = [xxhash.xxh64_intdigest(main_text(r)) - 2**63 for r in roots]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([split_url(u)[0] for u in b.column(1).to_pylist()], pa.string()), pa.array(main, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["_id", "_host", "_main", "_hashes"])

    hashed = Scratch(pages.sparkSession).write(pages.select("_id", url_col, html_col).mapInArrow(run, "_id long, _host string, _main long, _hashes array<long>"), "hashed")
    # Pages of one host with equal main texts count once: their common parts are no template but copies.
    nodes = hashed.select("_id", "_host", "_main", F.explode("_hashes").alias("_hash"))
    counts = nodes.select("_host", "_hash", "_main").distinct().groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    return counts.select("_host", "_hash"), nodes


def extract_main(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars.

    Null and empty pages give an empty text.  Pages without a host form one
    site of their own.  Repeated rows give equal texts; an empty table stays
    empty; other columns are not carried.
    """
    keyed = pages.select(F.xxhash64(F.col(id_col).cast("string"), url_col, html_col).alias("_id"), id_col, url_col, html_col)
    templates, nodes = site_templates(keyed, url_col=url_col, html_col=html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long"

    def extract(b: pa.RecordBatch, dropped: Iterable) -> pa.RecordBatch:
        texts = []
        for h, drop in zip(b.column(2).to_pylist(), dropped):
            root = parse(h)
            if drop:
                hash_subtrees(root)
            texts.append(main_text(root, set(drop or ())))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    templates = Scratch(pages.sparkSession).write(templates, "templates")
    if small_enough(templates, BROADCAST_TEMPLATES):
        by_host: dict[str, set[int]] = {}
        for r in templates.collect():
            by_host.setdefault(r["_host"], set()).add(r["_hash"])
        sent = pages.sparkSession.sparkContext.broadcast(by_host)

        def by_site(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                yield extract(b, [sent.value.get(split_url(u)[0]) for u in b.column(1).to_pylist()])

        return pages.select(id_col, url_col, html_col).mapInArrow(by_site, out)
    hits = nodes.join(templates, ["_host", "_hash"]).groupBy("_id").agg(F.collect_set("_hash").alias("_drop"))  # no more than a page's elements

    def by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield extract(b, b.column(3).to_pylist())

    return keyed.join(hits, "_id", "left").select(id_col, url_col, html_col, "_drop").mapInArrow(by_page, out)
