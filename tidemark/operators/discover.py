"""Lists that stored pages hold, and locators for them and for the fields of their items.

Pages are parsed as for extraction (operators.extract). Elements look alike if they
have the same tag and share a stable class (one without digits), or, where neither has
one, children of the same tags. Look-alikes under one parent are a list, and so are
those under parents that look alike, as boards split their lists into parts.

Groups are made by hashing looks, never by comparing elements in pairs. A locator
counts only if it finds exactly what it should: that is checked on the page itself.

A page's lists and their locators need nothing but the page, so a small helper finds
them as it parses: one pass, and no expression that a filter behind it would repeat.
Pages are dealt out before, by their hash: a file may hold all of them as one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain as chained

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.operators import extract
from tidemark.operators.extract import Page

#: Ancestors by which a selector for a list may begin; levels of one for a field.
MOST_PREFIX, MOST_LEVELS = 3, 3
#: Pages that are written at once.
PAGES_AT_ONCE = 256
_CLASS = r"^[A-Za-z][A-Za-z_-]*$"
# $ is before a last line break, too, of which Java knows more
_STABLE = re.compile(r"[A-Za-z][A-Za-z_-]*[\u0085\u2028\u2029]?")
_Level = tuple[str, tuple[str, ...]]


def stable_classes(node: Column) -> Column:
    """An element's classes that don't look generated, in their order."""
    given = F.split(F.coalesce(extract.attr_of(node, "class"), F.lit("")), r"\s+")
    return F.array_distinct(F.filter(given, lambda c: c.rlike(_CLASS)))


def _level(node: Column) -> Column:
    """Tag and first two stable classes, as a selector has them."""
    return F.struct(node["tag"].alias("tag"), F.slice(stable_classes(node), 1, 2).alias("classes"))


def _said(level: Column) -> Column:
    return F.concat_ws(".", F.array(level["tag"]), level["classes"])


def _like(node: Column, level: Column) -> Column:
    """Whether an element fits a selector's level."""
    return (node["tag"] == level["tag"]) & (F.size(F.array_except(level["classes"], stable_classes(node))) == 0)


def _above(of: Page, node: Column, levels: int) -> list[Column]:
    """An element's parent, its parent, ...; null beyond the page."""
    found = []
    for _ in range(levels):
        node = F.try_element_at(of.nodes, F.when(node["up"] > 0, node["up"] + 1))
        found.append(node)
    return found


@lru_cache(1 << 12)
def _stable(given: str) -> tuple[str, ...]:
    """stable_classes of a class attribute, outside Spark."""
    return tuple(dict.fromkeys(c for c in re.split(r"[ \t\n\x0b\f\r]+", given) if _STABLE.fullmatch(c)))


class _Lists:
    """A page's lists and locators for them, from its elements."""

    def __init__(self, html: str) -> None:
        self.rows = extract.elements(html)
        self.attrs = [dict(r["attrs"]) for r in self.rows]
        self.classes = [_stable(a.get("class", "")) for a in self.attrs]
        self.with_tag = self._places(r["tag"] for r in self.rows)
        self.fitting: dict[tuple[_Level, ...], list[int]] = {}
        self.with_role: dict[str | None, list[int]] | None = None
        self.with_test_id: dict[str | None, list[int]] | None = None

    @staticmethod
    def _places(keys: Iterator[str | None]) -> dict[str | None, list[int]]:
        found: dict[str | None, list[int]] = {}
        for place, key in enumerate(keys):
            found.setdefault(key, []).append(place)
        return found

    def _level(self, place: int) -> _Level:
        return self.rows[place]["tag"], self.classes[place][:2]

    def _above(self, place: int, levels: int) -> int | None:
        """An element's parent, its parent, ...; none beyond the page."""
        for _ in range(levels):
            place = self.rows[place]["up"]
            if place <= 0:
                return None
        return place

    def _card(self, place: int) -> bool:
        """Whether an element has some structure: a link or three elements in it, or more."""
        last = self.rows[place]["last"]
        return last - place >= 3 or any(self.rows[k]["tag"] == "a" and "href" in self.attrs[k] for k in range(place + 1, last + 1))

    def _looks(self, place: int) -> list[str]:
        tag = self.rows[place]["tag"]
        return [f"{tag}.{c}" for c in self.classes[place]] or [f"{tag}>{','.join(self.rows[k]['tag'] for k in self.rows[place]['kids'])}"]

    def groups(self) -> list[dict]:
        """rank, look, size, depth and nodes of the lists, by rank."""
        siblings: dict[tuple[str, int], list[int]] = {}
        cousins: dict[tuple[str, str], list[int]] = {}
        for place, row in enumerate(self.rows):
            if row["up"] > 0 and row["tag"] not in ("html", "head", "body"):  # no body, and nothing outside it
                around = _words(self._level(row["up"]))
                for look in self._looks(place):
                    siblings.setdefault((look, row["up"]), []).append(place)
                    cousins.setdefault((look, around), []).append(place)
        apart = ((key, nodes) for key, nodes in cousins.items() if any(self.rows[k]["up"] != self.rows[nodes[0]]["up"] for k in nodes))
        looks: dict[tuple[int, ...], str] = {}
        for (look, _), nodes in chained(siblings.items(), apart):
            if len(nodes) > 1:
                looks[tuple(nodes)] = min(look, looks.get(tuple(nodes), look))
        cards = {nodes for nodes in looks if all(map(self._card, nodes))}
        found = [{"look": looks[nodes], "size": len(nodes), "depth": min(self.rows[k]["depth"] for k in nodes), "nodes": list(nodes)} for nodes in cards or looks]
        found.sort(key=lambda g: (-g["size"], g["depth"], g["nodes"][0], g["look"]))
        return [g | {"rank": i} for i, g in enumerate(found, 1)]

    def _fit(self, chain: tuple[_Level, ...]) -> list[int]:
        """Places of the elements that fit a chain of levels (their own first, then their parent's, ...); looked for once on a page."""
        if chain not in self.fitting:
            (tag, classes), levels = chain[-1], len(chain) - 1
            found = []
            for place in self._fit(chain[:-1]) if levels else self.with_tag.get(tag, []):
                level = self._above(place, levels)
                if level is not None and self.rows[level]["tag"] == tag and set(classes) <= set(self.classes[level]):
                    found.append(place)
            self.fitting[chain] = found
        return self.fitting[chain]

    def _path(self, place: int) -> str:
        """The path from the page to an element, by tags and their places."""
        steps = []
        while place > 0:
            steps.append(f"/{self.rows[place]['tag']}[{self.rows[place]['kin']}]")
            place = self.rows[place]["up"]
        return "".join(reversed(steps))

    def locators(self, nodes: list[int] | None) -> list[dict[str, str]]:
        """kind and value of the locators that find all of a list's items and nothing else, best first."""
        if not nodes or not all(0 <= k < len(self.rows) for k in nodes):
            return []
        first = nodes[0]
        tag, attrs = self.rows[first]["tag"], self.attrs[first]
        common = [c for c in self.classes[first] if all(c in self.classes[k] for k in nodes)]
        levels = [(tag, tuple(common[:2]))]
        for n in range(1, MOST_PREFIX + 1):
            place = self._above(first, n)
            if place is None or self.rows[place]["tag"] in ("html", "body"):
                break
            levels.append(self._level(place))
        if self.with_role is None or self.with_test_id is None:
            self.with_role = self._places(extract.role_in(r["tag"], a) for r, a in zip(self.rows, self.attrs, strict=True))
            self.with_test_id = self._places(a.get("data-testid") for a in self.attrs)
        found: list[dict[str, str]] = []

        def exact(kind: str, value: str, places: list[int]) -> None:
            if places == nodes:
                found.append({"kind": kind, "value": value})

        def chains(specific: bool) -> None:
            for n in range(1, len(levels) + 1):
                chain = tuple(levels[:n])
                if any(classes for _, classes in chain) == specific:
                    exact("css", " > ".join(map(_words, reversed(chain))), self._fit(chain))

        if test_id := attrs.get("data-testid"):
            exact("testId", test_id, self.with_test_id[test_id])
        chains(True)
        if (role := extract.role_in(tag, attrs)) is not None:
            exact("role", role, self.with_role[role])
        chains(False)
        if (up := self.rows[first]["up"]) >= 0:
            exact("xpath", f"{self._path(up)}/{tag}", [k for k in self.rows[up]["kids"] if self.rows[k]["tag"] == tag])
        return found


def _words(level: _Level) -> str:
    """_said of a level, outside Spark."""
    return ".".join([level[0], *level[1]])


_LOCATORS = "array<struct<kind: string, value: string>>"
_FOUND = {"rank": ("int", pa.int32()), "look": ("string", pa.string()), "size": ("int", pa.int32()), "depth": ("int", pa.int32()), "nodes": ("array<int>", pa.list_(pa.int32()))}
_TOLD = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))


def _of_pages(batch: pa.RecordBatch, make, kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """page_id and the rows that make(page, i) gives for the i-th page of a batch of page_id, html, ..."""
    for begin in range(0, len(batch), PAGES_AT_ONCE):
        at, rows = [], []
        for i in range(begin, min(begin + PAGES_AT_ONCE, len(batch))):
            made = make(_Lists(batch.column(1)[i].as_py() or ""), i)
            at += [i] * len(made)
            rows += made
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds.items())], names=["page_id", *kinds])


def _found(pages: DataFrame, locators: bool, look: str | None = None) -> DataFrame:
    pages = pages.select("page_id", "html")
    kinds = {k: kind for k, (_, kind) in _FOUND.items()} | ({"locators": _TOLD} if locators else {})

    def lists(page: _Lists, _: int) -> list[dict]:
        groups = [g for g in page.groups() if look is None or g["look"] == look]
        return [g | {"locators": page.locators(g["nodes"])} for g in groups] if locators else groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _of_pages(batch, lists, kinds)

    told = ", ".join([f"page_id {dict(pages.dtypes)['page_id']}", *(f"{k} {kind}" for k, (kind, _) in _FOUND.items()), *([f"locators {_LOCATORS}"] if locators else [])])
    return pages.repartition(F.xxhash64("page_id", "html")).mapInArrow(run, told)


def list_groups(pages: DataFrame) -> DataFrame:
    """page_id, rank, look, size, depth, nodes: the lists of each page, the one to propose first.

    If some list's items all are cards (they have structure), only such lists count.
    The largest is first, then the outermost, then the earlier one; lists with the same
    items are one, by its first look. Pages that share a page_id have lists of their own.
    """
    return _found(pages, False)


def located_lists(pages: DataFrame, look: str | None = None) -> DataFrame:
    """list_groups with the locators of each list (see list_locators), from one parse of a page; for a look, of such lists only."""
    return _found(pages, True, look)


def _chain_matches(of: Page, within: Column, chain: Column, levels: int, top: Column | None = None) -> Column:
    """Places of the elements of `within` that fit a chain of levels (their own first, then their parent's, ...), of some length up to levels."""

    def fits(n: Column) -> Column:
        test = _like(n, F.element_at(chain, 1))
        for i, above in enumerate(_above(of, n, levels - 1), 2):
            inner = above.isNotNull() if top is None else F.coalesce(above["node"] > top, F.lit(False))
            test &= (F.size(chain) < i) | F.coalesce(inner & _like(above, F.try_element_at(chain, F.lit(i))), F.lit(False))
        return test

    return F.transform(F.filter(within, fits), lambda n: n["node"])


def _selector(chain: Column) -> Column:
    return F.array_join(F.reverse(F.transform(chain, _said)), " > ")


def _path(of: Page, node: Column) -> Column:
    """The path from the page to an element, by tags and their places."""
    zero = F.struct(node["node"].alias("at"), F.lit("").alias("path"))

    def up(so_far: Column, _: Column) -> Column:
        n = extract.node_at(of, so_far["at"])
        return F.struct(n["up"].alias("at"), F.concat(F.lit("/"), n["tag"], F.lit("["), n["kin"].cast("string"), F.lit("]"), so_far["path"]).alias("path"))

    return F.aggregate(F.slice(of.nodes, 1, node["depth"]), zero, up, lambda x: x["path"])


_LOCATOR = "struct<kind: string, value: string>"


def _locator(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value")).cast(_LOCATOR)


def list_locators(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """page_id, rank, locators: of each list those that find all its items and nothing else, best first.

    Test ids come first, then selectors with classes from short to long, the role, selectors
    of tags only, and the path. A list that no locator tells from others has none.
    """
    kinds = dict(groups.select("page_id", "rank").dtypes)
    of_page = groups.groupBy("page_id").agg(F.collect_list(F.struct("rank", "nodes")).alias("lists"))
    # the source goes to its lists, a page once
    some = pages.select("page_id", "html").join(of_page.hint("merge"), "page_id")
    some = some.select("page_id", "html", F.col("lists.rank").alias("ranks"), F.col("lists.nodes").alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = lambda page, i, at=batch: [{"rank": r, "locators": page.locators(n)} for r, n in zip(at.column(2)[i].as_py(), at.column(3)[i].as_py(), strict=True)]
            yield from _of_pages(batch, told, {"rank": batch.schema.field(2).type.value_type, "locators": _TOLD})

    return some.mapInArrow(run, f"page_id {dict(some.dtypes)['page_id']}, rank {kinds['rank']}, locators {_LOCATORS}")


def field_locators(pages: DataFrame, groups: DataFrame, least: float = 0.6) -> DataFrame:
    """page_id, rank, value, levels, items, share: selectors relative to an item that find one element in a share of `least` of a list's items or more.

    For each element of an item the shortest selector that finds it alone inside the
    item is a candidate; candidates are then tried in all items. A list without enough
    agreement keeps all, as coverage does (extract.locator_coverage).
    """
    of = extract.page()
    some = extract.with_nodes(pages).join(groups.select("page_id", "rank", F.col("nodes").alias("__group")), "page_id")

    def own(item: Column) -> Column:
        def shortest(n: Column) -> Column:
            above = [F.when(a["node"] > item["node"], _level(a)) for a in _above(of, n, MOST_LEVELS - 1)]
            tried = []
            for k in range(1, MOST_LEVELS + 1):
                chain = F.array(_level(n), *above[: k - 1])
                within = above[k - 2].isNotNull() if k > 1 else F.lit(True)
                alone = F.size(_chain_matches(of, extract.inside(of, item), chain, k, item["node"])) == 1
                tried.append(F.when(F.coalesce(within & alone, F.lit(False)), chain))
            return F.coalesce(*tried)

        return F.array_compact(F.transform(extract.inside(of, item), shortest))

    tried = F.array_distinct(F.flatten(F.transform("__group", lambda k: let(extract.node_at(of, k), own))))

    def share(chain: Column) -> Column:
        once = F.filter("__group", lambda k: let(extract.node_at(of, k), lambda item: F.size(_chain_matches(of, extract.inside(of, item), chain, MOST_LEVELS, item["node"])) == 1))
        return F.struct(_selector(chain).alias("value"), F.size(chain).alias("levels"), F.size("__group").alias("items"), (F.size(once) / F.size("__group")).alias("share"))

    found = some.select("page_id", "rank", F.inline(F.transform(tried, share)))
    best = F.max("share").over(Window.partitionBy("page_id", "rank"))
    return found.withColumn("__best", best).where((F.col("share") >= least) | (F.col("__best") < least)).drop("__best")
