"""Main text of web pages by paths on which the pages of a host agree."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import url_filter, util

#: Votes that a path needs to win, on its template or its host.
LEAST_VOTES = 2
#: A path longer than this goes on from its hash, so that deep nesting stays linear.
PATH_CHARS = 4_000

# Elements of HTML by their role.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "title", "textarea", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "embed", "source", "track", "param",
}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset", "option", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form", "alertdialog"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = ("ul", "ol", "dl", "table", "tbody", "thead", "select")

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[A-Za-z][^>]*>|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S
)
_CUT = re.compile(r"<[!?/]")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Words in class and id names: boilerplate, parts of a page, page headers, articles. Outside of an article any
# part of a name counts; inside one the whole name, but for words that say nothing, or many links.
SHED = {
    "navbar", "sidebar", "cookie", "cookies", "consent", "gdpr", "advert", "adverts", "advertisement", "advertising", "ads", "adsense", "sponsor", "sponsored", "comment", "comments",
    "commentlist", "respond", "replies", "disqus", "breadcrumb", "breadcrumbs", "pagination", "pager", "popup", "modal", "newsletter", "subscribe", "subscription", "signup",
}
FRAME = {
    "nav", "navigation", "menu", "footer", "side", "aside", "notice", "alert", "banner", "ad", "promo", "share", "sharing", "social", "related", "recommended", "login", "widget", "toolbar", "skip", "hidden",
}
HEAD = {"header", "masthead"}
#: Words of names that say nothing of what an element holds.
PLAIN = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "card", "col", "container", "content", "div", "form", "group", "holder", "inline", "inner", "left", "links", "list", "main",
    "message", "module", "overlay", "panel", "placeholder", "right", "row", "section", "slot", "text", "thread", "top", "unit", "user", "reader", "readers", "wrap", "wrapper", "zone",
}
ENTRY = {"article", "entry", "post", "story"}
_MAIN_NAME = re.compile(r"(?:^|[-_ ])(?:article|content|entry|main|post|story|text|body)(?:$|[-_ ])", re.I)
KEPT, DOUBTED, LEFT = 0, 1, 2

ENTRIES = {"item", "items"}  # of comments, but also of a menu that an article is about


@lru_cache(10_000)
def by_name(names: str, inside: bool) -> int:
    """What class and id names say of an element: it is left out, or left out if it is mostly links, or kept."""
    out = KEPT
    for name in names.lower().split():
        parts = {re.sub(r"\d+$", "", x) for x in re.split("[-_]+", name)} - {""}
        shed = parts & (SHED | FRAME)
        if (shed and (not inside or parts <= SHED | FRAME | PLAIN or (parts & SHED and parts <= SHED | FRAME | PLAIN | ENTRIES))) or (parts & HEAD and not inside and not parts & ENTRY):
            return LEFT
        if shed:
            out = DOUBTED
    return out


@lru_cache(10_000)
def _kind(names: str) -> str:
    return re.sub(r"\d+", "", ".".join(sorted(names.split())))


@dataclass
class Element:
    tag: str
    path: str  # generalised: tags with their classes, without numbers
    parent: Element | None
    aside: bool
    gain: float  # how much its kind and name speak for a container
    main: bool = False  # it or an element around it is an article or main
    doubt: Element | None = None  # the outermost element around it that is left out if it is mostly links
    score: float = 0.0
    order: int = 0


@dataclass
class Block:
    element: Element
    words: str
    linked: int = 0  # characters inside links


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _attrs(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)} if source.strip() else {}


def _open(tag: str, attrs: dict[str, str], parent: Element | None) -> Element:
    names = attrs.get("class", "")
    both = f"{names} {attrs.get('id', '')}"
    kind = _kind(names)
    inside = parent is not None and parent.main
    aside = tag in ASIDE or (tag == "header" and not inside) or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
    aside = aside or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
    said = KEPT if tag in ("html", "body", "article", "main") else by_name(both, inside)
    gain = 3.0 if tag in ("article", "main") or "articleBody" in attrs.get("itemprop", "") else 1.5 if tag != "body" and _MAIN_NAME.search(both) else 1.0
    above = parent.path if parent else ""
    if len(above) > PATH_CHARS:
        above = "#" + hashlib.blake2b(above.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    path = f"{above}/{tag}" + (f".{kind}" if kind else "")
    out = Element(tag, path, parent, aside or said == LEFT or (parent is not None and parent.aside), gain, inside or tag in ("article", "main"))
    out.doubt = (parent.doubt if parent else None) or (out if said == DOUBTED else None)
    return out


def parse(source: str) -> Page:
    """Elements and the blocks of text outside of asides, in page order; tolerant of tags that are never closed."""
    page = Page()
    root = Element("", "", None, False, 0.0)
    stack = [root]
    where: dict[str, list[int]] = {}  # places on the stack by tag
    solid = [0]  # places on the stack of what isn't inline
    held: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if held:
            words = " ".join(html.unescape("".join(held)).split())
            if words and not stack[-1].aside:
                page.blocks.append(Block(stack[solid[-1]], words, min(linked, len(words))))
            held.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        if solid[-1] >= k:
            flush()
        while len(stack) > k:
            gone = stack.pop().tag
            where[gone].pop()
            links -= gone == "a"
            if gone not in INLINE:
                solid.pop()

    def last(*tags: str) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    at, closed = 0, source.rfind(">")
    while at < len(source):
        if at > closed:  # no tag ends any more: what looks like one is text, up to a comment or end tag that is cut off
            cut = _CUT.search(source, at)
            held.append(source[at : cut.start() if cut else len(source)])
            linked += len(held[-1]) * (links > 0)
            break
        m = _PART.match(source, at)
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if not source.startswith("<", m.start()) or m[0] == "<":
                held.append(m[0])
                linked += len(m[0]) * (links > 0)
            continue
        if m["end"]:
            k = last(tag)
            if k and (tag not in INLINE or k > solid[-1]):
                close(k)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(source, at)
            at = (source.find(">", end.end()) + 1 if end else 0) or len(source)
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in CLOSES_P and stack[solid[-1]].tag == "p":
            close(solid[-1])
        if tag in SIBLINGS and (k := last(*SIBLINGS[tag])) > last(*LISTS):
            close(k)
        element = _open(tag, _attrs(m["attrs"]), stack[-1])
        if tag not in INLINE:
            flush()
            element.order = len(page.elements)
            page.elements.append(element)
            solid.append(len(stack))
        links += tag == "a"
        where.setdefault(tag, []).append(len(stack))
        stack.append(element)
    flush()
    return _settled(page)


def _settled(page: Page) -> Page:
    """Without the blocks of doubted elements that are mostly links."""
    sums: dict[int, list[int]] = {}
    for b in page.blocks:
        if b.element.doubt is not None:
            total = sums.setdefault(id(b.element.doubt), [0, 0])
            total[0] += b.linked
            total[1] += len(b.words)
    if sums:
        page.blocks = [b for b in page.blocks if b.element.doubt is None or 2 * sums[id(b.element.doubt)][0] < sums[id(b.element.doubt)][1]]
    return page


def score(page: Page) -> None:
    """Each block's unlinked length counts in full for its parent and half as much with every level above."""
    for b in page.blocks:
        share = len(b.words) - b.linked + 25 * b.words.count(",")
        e = b.element if b.element.tag in ("article", "main", "section", "div", "td", "body") else b.element.parent
        while e is not None and e.tag and share:  # after some 1,100 levels a half is 0
            e.score += share * e.gain
            share /= 2
            e = e.parent


def best(page: Page) -> Element | None:
    good = [e for e in page.elements if e.score > 0 and not e.aside and e.tag != "html"]
    return max(good, key=lambda e: (e.score, -e.order), default=None)


def candidates(page: Page) -> dict[str, Element]:
    """The first element on each path that may hold the main text, and its score there is the path's best."""
    out: dict[str, Element] = {}
    for e in page.elements:
        if e.score > 0 and not e.aside and e.tag != "html":
            first = out.setdefault(e.path, e)
            first.score = max(first.score, e.score)
    return out


def template(page: Page) -> str:
    """A page's layout: the distinct paths of its outermost containers, below body."""
    return "\n".join(sorted({e.path for e in page.elements if not e.aside and e.path.count("/") <= 3}))


def extract(page: Page, path: str | None) -> str:
    """Text of all containers on the path, or of the whole page where no container stands out."""
    if path is None:
        return " ".join(b.words for b in page.blocks)
    inside = {id(e): True for e in page.elements if e.path == path and not e.aside and e.score > 0}

    def chosen(e: Element | None) -> bool:
        passed = []
        while e is not None and id(e) not in inside:
            passed.append(id(e))
            e = e.parent
        found = e is not None and inside[id(e)]
        inside.update(dict.fromkeys(passed, found))
        return found

    return " ".join(b.words for b in page.blocks if chosen(b.element))


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _read(pages: DataFrame) -> DataFrame:
    """Each page's text by its own best container, and what its containers are called: hashes of path with template and host."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = [], []
            for host, source in zip(batch.column(4).to_pylist(), batch.column(5), strict=True):
                page = parse(source.as_py() or "")
                score(page)
                own = best(page)
                layout = template(page)
                texts.append(extract(page, own.path if own else None))
                places.append([{"place": e.order, "own": e.path == own.path, "score": e.score, "keys": [_hash(host, layout, p), _hash(host, p)]} for p, e in candidates(page).items()])
            kinds = pa.list_(pa.struct([("place", pa.int32()), ("own", pa.bool_()), ("score", pa.float64()), ("keys", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string()), pa.array(places, kinds)], ["page_id", "url", "_k1", "_k2", "text", "places"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "_k1", "_k2", "host", "html").mapInArrow(read, f"{kinds}, _k1 bigint, _k2 bigint, text string, places array<struct<place: int, own: boolean, score: double, keys: array<bigint>>>")


def _overruled(read: DataFrame) -> DataFrame:
    """(_k1, _k2, place) of the pages whose template or host has voted for another of their containers."""
    named = read.select("_k1", "_k2", F.explode("places").alias("p")).select("_k1", "_k2", "p.place", "p.own", "p.score", F.posexplode("p.keys").alias("level", "key"))
    named = util.save(named, "containers")
    votes = named.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.count_if("own").alias("n"))
    met = util.attach(named, util.save(votes, "votes"), ["key"], "copies", named.count(), F.col("_k1"))
    count = lambda level: F.max(F.when((F.col("level") == level) & (F.col("n") >= LEAST_VOTES), F.col("n")).otherwise(0))
    judged = met.groupBy("_k1", "_k2", "place").agg(count(0).alias("template"), count(1).alias("host"), F.max("score").alias("score"), F.bool_or("own").alias("own"))
    rank = F.struct("template", "host", "score", -F.col("place"))
    return judged.groupBy("_k1", "_k2").agg(F.max_by("place", rank).alias("place"), F.max_by("own", rank).alias("own")).filter("NOT own").select("_k1", "_k2", "place")


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    Each page scores its containers and votes for the path of its best one, once for its template (the paths of its
    outermost containers) and once for its host. Of the paths that a page holds, the one with the most votes of its own
    template wins, then of its host; a path needs two votes, and a page whose paths have none keeps its own best container.
    Pages that are overruled are extracted again. However many templates a host has, each is decided by its own pages.

    Menus, page headers, footers, asides, notices, adverts, forms, scripts, styles and reader comments are left out
    wherever they stand; inside an article a name counts if it is made of such words alone, or if the element is mostly
    links. Headings inside the winning container belong to the text, one outside of it is a page header and does not.
    All containers on the winning path count, in page order.

    Null and empty html give an empty text; texts and nesting may be of any length, and tags that are never closed by a bracket
    are text; of equal scores the first container
    counts; a null url belongs to the host of no name; repeated rows give repeated results (and votes), an empty table
    an empty one; other columns are ignored. Returns page_id, url, text, n_chars.
    """
    host = F.coalesce(url_filter.host_of(F.col("url")), F.lit(""))
    keyed = pages.select("page_id", "url", F.xxhash64(F.lit(1), "page_id", "url", "html").alias("_k1"), F.xxhash64("html", F.lit(2), "page_id", "url").alias("_k2"), host.alias("host"), "html")
    first = util.save(_read(keyed), "read")
    changed = util.small(util.save(_overruled(first), "overruled"))

    def redo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, place in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                page = parse(source.as_py() or "")
                score(page)
                out.append(extract(page, page.elements[place].path))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    again = keyed.join(changed, ["_k1", "_k2"]).select("page_id", "url", "html", "place").mapInArrow(redo, f"{kinds}, text string")
    kept = first.join(changed, ["_k1", "_k2"], "left_anti").select("page_id", "url", "text")
    return kept.unionByName(again).withColumn("n_chars", F.char_length("text").cast("bigint"))
