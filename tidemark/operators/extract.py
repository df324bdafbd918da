"""Records from stored list pages, by ranked locators.

pages: page_id, url, html and what else identifies them. A spec names the list
(ranked locators, one match or more) and its fields (ranked locators inside an
item, exactly one match). The first locator that matches is used; any but the
first is drift.

A page is parsed once, by a small helper, into an array of its elements in preorder:
an element's descendants are the ones right behind it, up to its last. Texts and inner
HTML are places in the page's own text and source, so a page takes memory in
proportion to its length, however deep it is. Locators are column expressions that
look at the elements of a scope only, which is a slice of the array. All of a page is
one row, so nothing is shuffled and the pages are spread as they are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = {"b", "i", "em", "strong", "span", "a"}
# Roles that elements have by themselves, and inputs by their type.
ROLES = {
    "button": "button", "summary": "button", "textarea": "textbox", "option": "option", "progress": "progressbar", "dialog": "dialog", "li": "listitem", "ul": "list", "ol": "list", "nav": "navigation", "main": "main",
    "article": "article", "table": "table", "tr": "row", "td": "cell", "form": "form", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
}
INPUT_ROLES = {
    "button": "button", "submit": "button", "reset": "button", "image": "button", "checkbox": "checkbox", "radio": "radio", "range": "slider", "search": "searchbox", "number": "spinbutton", "": "textbox", "text": "textbox",
    "email": "textbox", "tel": "textbox", "url": "textbox",
}
#: What a string is cast to an integer from: signs and digits, between blanks and control characters.
_INT = re.compile(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*")
#: An element: its place, its parent's and its last descendant's, its depth; its place among its siblings and among those of its tag;
#: its children; what labels it (-1: nothing); where its text and its inner HTML begin and end, in bytes.
_FIELDS = {"node": "int", "up": "int", "last": "int", "depth": "int", "tag": "string", "attrs": "map<string, string>", "nth": "int", "kin": "int", "kids": "array<int>", "label": "int", "said_from": "int", "said_to": "int", "html_from": "int", "html_to": "int"}
NODE = f"struct<{', '.join(f'{k}: {v}' for k, v in _FIELDS.items())}>"


class _Elements(HTMLParser):
    """Flat list of a page's elements; element 0 is the page. said: its text, with single spaces."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines = [0, *(i + 1 for i, c in enumerate(html) if c == "\n")]
        self.rows: list[dict] = []
        self.words: list[bytes] = []
        self.size, self.spaced, self.silent = 0, True, 0
        self.open: list[dict] = []
        self.open_tags: dict[str, int] = {}
        self._begin("", {}, 0)
        self.feed(html)
        self.close()
        while self.open:
            self._end(len(html))
        self.said = b"".join(self.words)
        self._label()
        raw = np.frombuffer(html.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) > len(html):  # places in bytes
            at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).tolist()
            for row in self.rows:
                row["html_from"], row["html_to"] = at[row["html_from"]], at[row["html_to"]]

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _say(self, raw: str) -> None:
        words = " ".join(raw.split())
        said = (" " if raw[:1].isspace() and not self.spaced else "") + words + (" " if words and raw[-1:].isspace() else "")
        if said:
            self.spaced = said.endswith(" ")
            self.words.append(said.encode("utf-8", "replace"))
            self.size += len(self.words[-1])

    def _begin(self, tag: str, attrs: dict[str, str], source: int) -> None:
        up = self.open[-1] if self.open else None
        counts = up["counts"] if up else {}
        counts[""], counts[tag] = counts.get("", 0) + 1, counts.get(tag, 0) + 1
        row = {
            "node": len(self.rows), "up": up["node"] if up else -1, "last": 0, "depth": len(self.open), "tag": tag, "attrs": list(attrs.items()), "nth": counts[""], "kin": counts[tag], "kids": [], "label": -1,
            "said_from": self.size, "said_to": 0, "html_from": source, "html_to": source, "counts": {},
        }
        if up:
            up["kids"].append(row["node"])
        self.rows.append(row)
        self.open.append(row)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self.silent += tag in ("script", "style")

    def _end(self, source: int) -> None:
        row = self.open.pop()
        row |= {"last": len(self.rows) - 1, "said_to": self.size, "html_to": source}
        self.open_tags[row["tag"]] -= 1
        self.silent -= row["tag"] in ("script", "style")
        if row["tag"] not in _INLINE:
            self._say(" ")

    def _label(self) -> None:
        """The one element that an element's aria-labelledby, or a label's `for`, names, or the label around it."""
        ids: dict[str, list[int]] = {}
        labels: dict[str, list[int]] = {}
        for row in self.rows:
            attrs = dict(row["attrs"])
            ids.setdefault(attrs.get("id", ""), []).append(row["node"])
            if row["tag"] == "label" and attrs.get("for"):
                labels.setdefault(attrs["for"], []).append(row["node"])
        around = -1
        for row in self.rows:
            attrs = dict(row["attrs"])
            if row["tag"] == "label":
                around = row["node"]
            field = row["tag"] in ("input", "select", "textarea")
            told = ids.get(attrs["aria-labelledby"].strip(), []) if attrs.get("aria-labelledby") else labels.get(attrs.get("id") or "", []) if field else []
            if len(told) == 1:
                row["label"] = told[0]
            elif field and around >= 0 and row["node"] <= self.rows[around]["last"]:
                row["label"] = around

    def handle_starttag(self, tag, attrs):
        here = self._here()
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1]["tag"] == tag:
            self._end(here)
        after = here + len(self.get_starttag_text())
        self._begin(tag, {k: v or "" for k, v in attrs}, after)
        if tag in VOID:
            self._end(after)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(self._here())

    def handle_endtag(self, tag):
        if tag in VOID or not self.open_tags.get(tag):
            return
        here = self._here()
        while self.open[-1]["tag"] != tag:
            self._end(here)
        self._end(here)

    def handle_data(self, data):
        if not self.silent:
            self._say(data)


def elements(html: str) -> list[dict]:
    """A page's elements in preorder, with the fields of NODE; attrs as pairs."""
    return _Elements(html).rows


class Page(NamedTuple):
    """Columns of a parsed page: its elements, its text and its source as bytes."""

    nodes: Column
    said: Column
    html: Column


def with_nodes(pages: DataFrame) -> DataFrame:
    """page_id, nodes (the array of a page's elements), said and html."""
    kind = dict(pages.select("page_id").dtypes)["page_id"]
    kinds = {"int": pa.int32(), "string": pa.string(), "map<string, string>": pa.map_(pa.string(), pa.string()), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # a page at a time, so that memory follows the page
                html = batch.column(1)[i].as_py() or ""
                found = _Elements(html)
                fields = pa.StructArray.from_arrays([pa.array([row[n] for row in found.rows], kinds[k]) for n, k in _FIELDS.items()], names=list(_FIELDS))
                nodes = pa.ListArray.from_arrays(pa.array([0, len(found.rows)], pa.int32()), fields)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), nodes, pa.array([found.said], pa.binary()), pa.array([html.encode("utf-8", "surrogatepass")], pa.binary())], names=["page_id", "nodes", "said", "html"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, nodes array<{NODE}>, said binary, html binary")


def page() -> Page:
    """The page of a row of with_nodes."""
    return Page(F.col("nodes"), F.col("said"), F.col("html"))


def node_at(of: Page, place: Column) -> Column:
    return F.element_at(of.nodes, place + 1)


def text_of(of: Page, node: Column) -> Column:
    return F.trim(F.substring(of.said, node["said_from"] + 1, node["said_to"] - node["said_from"]).cast("string"))


def inner_of(of: Page, node: Column) -> Column:
    return F.substring(of.html, node["html_from"] + 1, node["html_to"] - node["html_from"]).cast("string")


def attr_of(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def inside(of: Page, scope: Column) -> Column:
    """The elements inside one."""
    return F.slice(of.nodes, scope["node"] + 2, scope["last"] - scope["node"])


def role_of(node: Column) -> Column:
    """The role given, or else an element's own; null where neither is sure."""
    own = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    of_input = F.create_map(*(F.lit(x) for pair in INPUT_ROLES.items() for x in pair))
    tag, has = node["tag"], lambda name: F.coalesce(attr_of(node, name), F.lit("")) != ""
    given = F.substring_index(F.trim(F.coalesce(attr_of(node, "role"), F.lit(""))), " ", 1)
    return (
        F.when(given != "", given).when(tag.isin("a", "area"), F.when(attr_of(node, "href").isNotNull(), "link")).when(tag == "img", F.when(has("alt"), "img"))
        .when(tag == "select", F.when(attr_of(node, "multiple").isNotNull() | (F.coalesce(attr_of(node, "size").try_cast("int"), F.lit(1)) > 1), "listbox").otherwise("combobox"))
        .when(tag == "input", F.when(attr_of(node, "list").isNotNull(), "combobox").otherwise(F.try_element_at(of_input, F.lower(F.coalesce(attr_of(node, "type"), F.lit(""))))))
        .otherwise(F.try_element_at(own, tag))
    )


def role_in(tag: str, attrs: dict[str, str]) -> str | None:
    """What role_of says, of an element outside Spark."""
    given = attrs.get("role", "").strip(" ").split(" ")[0]
    if given:
        return given
    if tag in ("a", "area"):
        return "link" if "href" in attrs else None
    if tag == "img":
        return "img" if attrs.get("alt") else None
    if tag == "select":
        size = _INT.fullmatch(attrs.get("size", ""))
        return "listbox" if "multiple" in attrs or (size and 1 < int(size[1]) < 1 << 31) else "combobox"
    if tag == "input":
        return "combobox" if "list" in attrs else INPUT_ROLES.get(attrs.get("type", "").lower())
    return ROLES.get(tag)


def name_of(of: Page, node: Column) -> Column:
    """What an element is called: by its aria-label, what labels it, a button's value, an image's alternative, or its text."""
    squeezed = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    button = (node["tag"] == "input") & F.lower(F.coalesce(attr_of(node, "type"), F.lit(""))).isin("button", "submit", "reset")
    return F.coalesce(
        squeezed(attr_of(node, "aria-label")),
        F.when(node["label"] >= 0, F.nullif(let(F.try_element_at(of.nodes, node["label"] + 1), lambda n: text_of(of, n)), F.lit(""))),
        F.when(button, squeezed(attr_of(node, "value"))),
        F.when(node["tag"] == "img", squeezed(attr_of(node, "alt"))),
        text_of(of, node),
    )


# --- locators, as expressions over the array of elements

_SIMPLE = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:=["']?(?P<value>[^"'\]]*)["']?)?\]|:nth-(?P<of>of-type|child)\((?P<nth>\d+)\)""")
_STEP = re.compile(r"""\s*(>|\s)?\s*((?:[^\s>\["']|\[[^\]]*\])+)""")


def _simple(selector: str, node: Column) -> Column:
    """Whether an element fits a compound selector: tag, class, id, attribute and place."""
    test, at = F.lit(True), 0
    attr = partial(attr_of, node)
    while at < len(selector):
        m = _SIMPLE.match(selector, at)
        if not m:
            raise ValueError(f"selector not understood: {selector}")
        at = m.end()
        if m["tag"] and m["tag"] != "*":
            test &= node["tag"] == m["tag"].lower()
        elif m["cls"]:
            test &= F.array_contains(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), m["cls"])
        elif m["id"]:
            test &= F.coalesce(attr("id") == m["id"], F.lit(False))
        elif m["attr"]:
            test &= attr(m["attr"]).isNotNull() if m["value"] is None else F.coalesce(attr(m["attr"]) == m["value"], F.lit(False))
        elif m["nth"]:
            test &= node["kin" if m["of"] == "of-type" else "nth"] == int(m["nth"])
    return test & (node["node"] > 0)


def _places(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["node"])


def _next(of: Page, reached: Column, child: bool, fits: Callable[[Column], Column]) -> Column:
    """Places of the elements that fit and are children (or else descendants) of one that was reached, in order."""

    def near(place: Column) -> Column:
        if child:
            return F.filter(node_at(of, place)["kids"], lambda k: fits(node_at(of, k)))
        return let(node_at(of, place), lambda a: _places(F.filter(inside(of, a), fits)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(reached, near))))


def _css(of: Page, scope: Column, selector: str) -> Column:
    steps, at, text = [], 0, selector.strip()
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise ValueError(f"selector not understood: {selector}")
        steps.append((m[1] == ">", m[2]))
        at = m.end()
    first = partial(_simple, steps[0][1])
    reached = _places(F.filter(inside(of, scope), first))
    if len(steps) > 1:  # ancestors may be the scope itself, what is found is inside it
        reached = F.concat(F.when(first(scope), F.array(scope["node"])).otherwise(F.array().cast("array<int>")), reached)
    for child, simple in steps[1:]:
        reached = _next(of, reached, child, partial(_simple, simple))
    return reached


def _xpath(of: Page, scope: Column, path: str) -> Column:
    steps = re.findall(r"(//|/)([\w*-]+)(?:\[(\d+)\])?", path.lstrip("."))
    if "".join(f"{d}{t}{f'[{n}]' if n else ''}" for d, t, n in steps) != path.lstrip("."):
        raise ValueError(f"path not understood: {path}")
    reached = F.array(scope["node"])

    def fits(tag: str, nth: str, n: Column) -> Column:
        test = F.lit(True) if tag == "*" else n["tag"] == tag.lower()
        return test & (n["nth" if tag == "*" else "kin"] == int(nth)) if nth else test

    for deep, tag, nth in steps:
        reached = _next(of, reached, deep == "/", partial(fits, tag, nth))
    return reached


def matches(of: Page, scope: Column, locator: dict) -> Column:
    """Places of the elements inside scope that a locator (kind, value, and for some name, role, exact, level) names, in order."""
    kind, value = locator["kind"], locator.get("value") or ""
    says = lambda told, t: told == t if locator.get("exact") else F.contains(F.lower(told), F.lit(t.lower()))
    if kind == "css":
        return _css(of, scope, value)
    if kind == "xpath":
        return _xpath(of, scope, value)
    if kind == "testId":
        return _places(F.filter(inside(of, scope), lambda n: F.coalesce(attr_of(n, "data-testid") == value, F.lit(False))))
    if kind == "text":  # the innermost: the next one found is not inside it
        innermost = lambda found: F.filter(found, lambda n, i: F.coalesce(F.try_element_at(found, i + 2)["node"] > n["last"], F.lit(True)))
        return _places(let(F.filter(inside(of, scope), lambda n: says(text_of(of, n), value)), innermost))
    if kind == "role":

        def fits(n: Column) -> Column:
            test = F.coalesce(role_of(n) == locator.get("role", value), F.lit(False))
            if locator.get("level"):
                test &= n["tag"] == f"h{locator['level']}"
            return test & says(name_of(of, n), locator["name"]) if locator.get("name") else test

        return _places(F.filter(inside(of, scope), fits))
    raise ValueError(f"unknown locator {kind}")


def _resolved(of: Page, scope: Column, locators: list[dict], many: bool, make) -> Column:
    """make(place, elements) of the first locator that matches (one element exactly, for a list one or more); null if none does."""

    def tried(i: int, locator: dict) -> Column:
        return let(matches(of, scope, locator), lambda found: F.when(F.size(found) > 0 if many else F.size(found) == 1, make(i, found)))

    return F.coalesce(*(tried(i, locator) for i, locator in enumerate(locators)))


def _items(of: Page, spec: dict, make) -> Column:
    """make(item, place) of every element of a page's list."""
    listed = _resolved(of, F.element_at(of.nodes, 1), spec["list"], True, lambda _, found: found)
    return F.transform(listed, lambda item, place: let(F.struct(node_at(of, item).alias("item"), place.alias("place")), lambda x: make(x["item"], x["place"])))


def _value(of: Page, place: Column, how: str) -> Column:
    def read(node: Column) -> Column:
        if how in ("text", "html"):
            return text_of(of, node) if how == "text" else inner_of(of, node)
        return F.coalesce(attr_of(node, how.removeprefix("attr:")), F.lit(""))

    return let(node_at(of, place), read)


def extract_records(pages: DataFrame, spec: dict) -> DataFrame:
    """page_id, item_idx, fields, item_error and drift of every list item.

    spec: {"list": [locators], "fields": [{"name", "locators", "read", "required"}]};
    read is text, html or attr:NAME. A page whose list isn't found gives nothing; a
    selector or path beyond what is known here is an error when the plan is made.
    """
    of = page()

    def record(item: Column, place: Column) -> Column:
        got = [_resolved(of, item, f["locators"], False, lambda i, found, f=f: F.struct(F.lit(i).alias("used"), _value(of, F.element_at(found, 1), f.get("read", "text")).alias("value"))) for f in spec["fields"]]
        return F.struct(place.alias("item_idx"), *(g.alias(f"f{i}") for i, g in enumerate(got)))

    rows = with_nodes(pages).select("page_id", F.explode(_items(of, spec, record)).alias("r"))
    got = lambda i, name: F.col(f"r.f{i}.{name}")
    fields = F.create_map(*(c for i, f in enumerate(spec["fields"]) for c in (F.lit(f["name"]), got(i, "value"))))
    lacking = F.array_compact(F.array(*(F.when(F.coalesce(got(i, "value"), F.lit("")) == "", f["name"]) for i, f in enumerate(spec["fields"]) if f.get("required")), F.lit(None).cast("string")))
    drift = F.array_compact(F.array(*(F.when(got(i, "used") > 0, F.struct(F.lit(f["name"]).alias("field"), got(i, "used").alias("used"))) for i, f in enumerate(spec["fields"]))))
    error = F.when(F.size(lacking) > 0, F.concat(F.lit("empty: "), F.array_join(lacking, ", ")))
    return rows.select("page_id", F.col("r.item_idx").alias("item_idx"), fields.alias("fields"), error.alias("item_error"), drift.alias("drift"))


def locator_attempts(pages: DataFrame, spec: dict) -> DataFrame:
    """page_id, item_idx, target, locator and matches: how many elements each locator of each field matches in each item."""
    of = page()

    def tried(item: Column, place: Column) -> Column:
        return F.array(*(F.struct(place.alias("item_idx"), F.lit(f["name"]).alias("target"), F.lit(k).alias("locator"), F.size(matches(of, item, loc)).alias("matches")) for f in spec["fields"] for k, loc in enumerate(f["locators"])))

    return with_nodes(pages).select("page_id", F.explode(F.flatten(_items(of, spec, tried))).alias("a")).select("page_id", "a.*")


def locator_coverage(attempts: DataFrame, least: float = 0.6) -> DataFrame:
    """target, locator, share of items where it matches exactly once; kept marks those with enough, or all if none has."""
    shares = attempts.groupBy("target", "locator").agg(F.avg((F.col("matches") == 1).cast("double")).alias("share"))
    best = shares.groupBy("target").agg(F.max("share").alias("__best"))
    return shares.join(best, "target").withColumn("kept", (F.col("share") >= least) | (F.col("__best") < least)).drop("__best")
