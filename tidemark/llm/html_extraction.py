"""Main text of web pages by site template removal.

Every element subtree gets two hashes: of its content (tag, class, id, text and
children) and of its slot (the tags, classes and ids on the way to it, what its
children are, and whether most of its text is links), which a menu or footer keeps
while its words vary from page to page. Spark counts both on the different pages
of each host; subtrees that recur on many of them are the site's template and are
deleted with all they hold.

What recurs but is no template: a slot with a large part of the host's text, an
element that holds an article, and paragraphs, headings, lists and tables that
aren't links; repeated pages and repeated sentences keep their text.

Elements that are furniture by their tag or role (menus, footers, forms, ...) go on
any page. On a host with enough pages to count the counts decide all else: neither
an article element nor the name of a class takes text out there, but for a named
element inside an article whose slot recurs. Only on hosts with too few pages a class
or id that names furniture goes (unless that would leave nothing), and a main or
article element that holds half of the text or more is all of it.

Defined cases: null or empty html gives empty text; pages without a host share
the host ''. Script, style, title, textarea and iframe end at their end tag only,
or at the end of the page, as in browsers.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch, written

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is no markup and no text of the page.
_RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "msub", "msup", "mrow",
    "object", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var",
}
_FURNITURE = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "canvas", "audio", "video", "template", "option", "optgroup", "datalist"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
#: Words of a class or id that name furniture.
_NAMES = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer masthead sidebar sidebars aside cookie cookies consent gdpr notice notices notification alert banner ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond "
    "popup modal overlay widget pagination pager toolbar search login hidden".split()
)
_HEADER_NAMES = {"header", "siteheader", "topbar"}
_CONTAINERS = {"article", "main"}
#: Elements of running text: never a template by their slot, unless they are lists of links.
_PLAIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "blockquote", "pre", "figcaption", "caption"}
_LISTS = {"ul", "ol", "dl", "table", "figure"}
#: A new one ends an open one (up to the element that holds them).
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}

#: What a recurring subtree is by: its content or its slot.
BY_CONTENT, BY_SLOT = 0, 1


class Templates(NamedTuple):
    """Hashes that recur on a host. counted: whether the host has enough pages to count."""

    content: frozenset[int] = frozenset()
    slots: frozenset[int] = frozenset()
    counted: bool = False


class _Element:
    __slots__ = ("tag", "above", "block", "furniture", "named", "container", "link", "sign", "way", "parts", "kinds", "own", "linked", "content", "slot", "holds_container", "inline", "out")

    def __init__(self, tag: str, above: _Element | None) -> None:
        self.tag, self.above = tag, above
        self.furniture = self.named = self.holds_container = self.out = False
        self.container, self.link = (above.container, above.link or tag == "a") if above else ("", False)
        #: The nearest element around it that is not inline, or itself.
        self.block = above.block if above and tag in _INLINE else self
        self.sign, self.way = tag, 0
        self.parts: list[bytes] = []
        self.kinds: set[str] = set()
        self.own = self.linked = 0
        self.content = self.slot = 0
        self.inline: dict[str, int] = {}  # open inline elements since this block began


class _Block(NamedTuple):
    text: str
    owner: _Element


def _digest(raw: bytes) -> int:
    value = xxhash.xxh64_intdigest(raw)
    return value - (1 << 64) if value >> 63 else value


def _begun(tag: str, attrs: str, above: _Element) -> _Element:
    e = _Element(tag, above)
    names = ""
    e.furniture = tag in _FURNITURE
    if "=" in attrs or "hidden" in attrs:
        got = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
        names = re.sub(r"\d+", "0", f"{got.get('class', '')}#{got.get('id', '')}")
        e.sign = f"{tag}.{got.get('class', '')}#{got.get('id', '')}"
        if tag not in ("html", "body"):
            words = {w for n in ("class", "id") for w in re.split(r"[^a-z0-9]+", got.get(n, "").lower())}
            e.named = bool(words & _NAMES) or (not e.container and bool(words & _HEADER_NAMES))
            e.furniture |= got.get("role", "").lower() in _ROLES or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
        if got.get("role") == "main" or got.get("itemprop") == "articleBody":
            e.container = e.container or "main"
    e.furniture |= tag == "header" and not e.container
    e.furniture |= above.furniture
    if tag in _CONTAINERS and not e.furniture:
        e.container = e.container or tag
    if tag not in _INLINE:
        e.way = _digest(above.block.way.to_bytes(8, "little", signed=True) + f"{tag}.{names}".encode("utf-8", "surrogatepass"))
    return e


def parse(html: str) -> tuple[list[_Element], list[_Block]]:
    """All elements in the order in which they begin, and the blocks of text with the element that each is in."""
    root = _Element("", None)
    stack, elements, blocks, buffer = [root], [root], [], []
    open_tags: dict[str, int] = {}

    def flush() -> None:
        text = " ".join("".join(t for t, _ in buffer).split())
        if text:
            owner = stack[-1].block
            linked = sum(len(t) for t, link in buffer if link)
            blocks.append(_Block(text, owner))
            owner.own += len(text)
            owner.linked += min(len(text), linked)
        buffer.clear()

    def close() -> None:
        e = stack[-1]
        if e.tag in _INLINE:
            e.block.inline[e.tag] -= 1
        else:
            flush()
        stack.pop()
        open_tags[e.tag] -= 1
        above = stack[-1]
        e.content = _digest(e.sign.encode("utf-8", "surrogatepass") + b"\x1f".join(e.parts))
        e.parts.clear()
        above.parts.append(e.content.to_bytes(8, "little", signed=True))
        above.holds_container |= e.holds_container or (e.tag in _CONTAINERS and not e.furniture)
        if e.tag not in _INLINE:
            link = b"a" if 2 * e.linked >= e.own > 0 else b""
            e.slot = _digest(e.way.to_bytes(8, "little", signed=True) + ",".join(sorted(e.kinds)).encode("utf-8", "surrogatepass") + link)
            above.block.kinds.add(e.tag)
            above.block.own += e.own
            above.block.linked += e.linked

    def words(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            buffer.append((text, stack[-1].link))
            if said := text.split():
                stack[-1].parts.append(" ".join(said).encode("utf-8", "surrogatepass"))

    # behind the last > no tag can end, so the search for one never runs to the end of the page in vain
    at, n = 0, html.rfind(">") + 1
    while at < n:
        m = _TAG.search(html, at, n)
        if not m:
            break
        words(html[at : m.start()])
        at = m.end()
        if not m["tag"]:
            if html.startswith("<!--", m.start()) and not html.endswith("-->", m.start(), at):
                at = n = len(html)  # an open comment
            continue
        tag = m["tag"].lower()
        if m["end"]:
            # nothing to close, or an inline element beyond the block that this is in
            if not (stack[-1].block.inline if tag in _INLINE else open_tags).get(tag):
                continue
            while stack[-1].tag != tag:
                close()
            close()
            continue
        if tag in _RAW:
            # a slash closes them in drawings and formulas only
            if not (m["attrs"].endswith("/") and (open_tags.get("svg") or open_tags.get("math"))):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words(" ")
            continue
        if tag not in _INLINE:
            flush()
            ended, block = _ENDS.get(tag, {"p"}), stack[-1].block
            while block.tag in ended:
                while stack[-1] is not block:
                    close()
                close()
                block = stack[-1].block
        e = _begun(tag, m["attrs"], stack[-1])
        if tag in _INLINE:
            e.block.inline[tag] = e.block.inline.get(tag, 0) + 1
        open_tags[tag] = open_tags.get(tag, 0) + 1
        stack.append(e)
        elements.append(e)
        if m["attrs"].endswith("/") and e.tag in ("svg", "math", "object"):
            close()
    if at < len(html):
        words(re.split("<[!?]", html[at:], maxsplit=1)[0])
    while len(stack) > 1:
        close()
    flush()
    return elements, blocks


def _counted(elements: list[_Element]) -> Iterator[tuple[int, int, int]]:
    """(by, hash, characters) of each subtree of a page that counts may delete."""
    total = elements[0].own
    for e in elements[1:]:
        if not e.own or e.tag in _INLINE or e.holds_container or e.tag in _CONTAINERS or e.tag in _PLAIN or e.tag in ("html", "body"):
            continue
        if e.tag in _LISTS and 2 * e.linked < e.own:
            continue
        yield BY_SLOT, e.slot, e.own
        if e.own <= 0.3 * total:
            yield BY_CONTENT, e.content, e.own


def _outcast(e: _Element, templates: Templates, by_name: bool) -> bool:
    """Whether an element by itself (not by what is around it) is no part of the main text. by_name: whether names decide where counts can't."""
    if e.furniture:
        return True
    if e.tag in _INLINE or e.holds_container or e.tag in _CONTAINERS or e.tag in ("", "html", "body"):
        return False
    inside = bool(e.above.container)
    if e.tag in _PLAIN:
        return by_name and e.named and not inside
    links = 2 * e.linked >= e.own > 0
    if e.content in templates.content or (e.slot in templates.slots and (links or not (inside or e.tag in _LISTS))):
        return True
    return e.named and (by_name or e.slot in templates.slots)


def _left(elements: list[_Element], blocks: list[_Block], templates: Templates, by_name: bool) -> list[_Block]:
    for e in elements[1:]:
        e.out = e.above.out or _outcast(e, templates, by_name)
    return [b for b in blocks if not b.owner.out]


def main_text(html: str | None, templates: Templates = Templates()) -> str:
    """Blocks on lines of their own, without those in a subtree of the host's templates."""
    elements, blocks = parse(html or "")
    left = _left(elements, blocks, templates, by_name=not templates.counted)
    if not templates.counted:
        left = left or _left(elements, blocks, templates, by_name=False)
        size = lambda some: sum(len(b.text) for b in some)
        for containers in ({"main"}, _CONTAINERS):
            held = [b for b in left if b.owner.container in containers]
            if 2 * size(held) >= size(left) > 0:
                left = held
                break
    return "\n".join(b.text for b in left)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def template_subtrees(pages: DataFrame, *, url: str = "url", html: str = "html", min_pages: int = 3, min_share: float = 0.25, max_text: float = 0.3) -> DataFrame:
    """host, by, subtree: what recurs on min_pages different pages and min_share of the host's different pages, as a written table.

    by: BY_CONTENT or BY_SLOT; a slot with more than max_text of the host's text is
    none, unless it is links. A row with a null subtree names each host with enough
    pages to count. A host has 2 / min_share times its average page's subtrees at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, signs, totals, found = [], [], [], []
            for body in batch.column(1).to_pylist():
                elements, blocks = parse(body or "")
                pages.append(_digest("\n".join(b.text for b in blocks).encode("utf-8", "surrogatepass")))
                signs.append(_digest((body or "").encode("utf-8", "surrogatepass")))
                totals.append(elements[0].own)
                of_page: dict[tuple[int, int], int] = {}
                for by, subtree, chars in _counted(elements):
                    of_page[by, subtree] = of_page.get((by, subtree), 0) + chars
                found.append([{"by": by, "subtree": subtree, "chars": chars} for (by, subtree), chars in of_page.items()])
            kind = pa.list_(pa.struct([("by", pa.int32()), ("subtree", pa.int64()), ("chars", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.int64()), pa.array(signs, pa.int64()), pa.array(totals, pa.int64()), pa.array(found, kind)], names=["host", "page", "sign", "total", "found"])

    seen = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, page long, sign long, total long, found array<struct<by: int, subtree: long, chars: long>>")
    with Scratch(pages.sparkSession) as scratch:
        # pages of the same text count once, as the one of the first markup; written, as two sums follow
        one = seen.groupBy("host", "page").agg(F.min_by(F.struct("total", "found"), "sign").alias("p"))
        seen = scratch.written(one.select("host", "page", "p.total", "p.found"), "subtrees")
        return written(_recurring(seen, min_pages, min_share, max_text), "templates")


def _recurring(seen: DataFrame, min_pages: int, min_share: float, max_text: float) -> DataFrame:
    """host, by, subtree from the subtrees found on each host's different pages."""
    totals = seen.groupBy("host").agg(F.count("*").alias("pages"), F.sum("total").alias("total")).where(F.col("pages") >= min_pages)
    counts = seen.select("host", F.explode("found").alias("f")).groupBy("host", "f.by", "f.subtree").agg(F.count("*").alias("n"), F.sum("f.chars").alias("chars")).where(F.col("n") >= min_pages)
    often = counts.join(totals, "host").where(F.col("n") >= min_share * F.col("pages")).where((F.col("by") == BY_CONTENT) | (F.col("chars") <= max_text * F.col("total")))
    return often.select("host", "by", "subtree").unionByName(totals.select("host", F.lit(None).cast("int").alias("by"), F.lit(None).cast("long").alias("subtree")))


def extract(pages: DataFrame, templates: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", broadcast_rows: int = 100_000, salt: int = 16) -> DataFrame:
    """key, url, text and n_chars of every page.

    templates (see template_subtrees) is broadcast up to broadcast_rows rows, about
    2 MB; beyond that pages are joined with it by host, a host's pages dealt to salt
    keys.
    """
    of_host = templates.groupBy(F.col("host").alias("__host")).agg(
        F.collect_list(F.when(F.col("by") == BY_CONTENT, F.col("subtree"))).alias("__content"),
        F.collect_list(F.when(F.col("by") == BY_SLOT, F.col("subtree"))).alias("__slots"),
    )
    page = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(html).alias("__html"), host_of(F.col(url)).alias("__host"))
    if templates.count() <= broadcast_rows:
        joined = page.join(F.broadcast(of_host), "__host", "left")
    else:
        dealt = of_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        joined = page.withColumn("__salt", F.pmod(F.xxhash64("__key", "__url"), F.lit(salt)).cast("int")).join(dealt.hint("merge"), ["__host", "__salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Templates] = {}
        for batch in batches:
            if len(known) > 1000:
                known.clear()
            texts = []
            for i, (host, body) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if host not in known:
                    content, slots = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                    known[host] = Templates(frozenset(content or ()), frozenset(slots or ()), content is not None)
                texts.append(main_text(body, known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "text", "n_chars"])

    kind = dict(pages.select(key).dtypes)[key]
    out = joined.select("__key", "__url", "__html", "__host", "__content", "__slots").mapInArrow(run, f"k {kind}, u string, text string, n_chars long")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
