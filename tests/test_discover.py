"""Lists and locators found on pages, against comparisons of all pairs and against extraction itself."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemark.operators import discover, extract, heal
from tidemark.registry import registered


class Tree(HTMLParser):
    """A page's elements by plain nesting."""

    def __init__(self, html):
        super().__init__()
        self.all, self.open = [], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        e = {"tag": tag, "attrs": dict(attrs), "up": self.open[-1] if self.open else None, "kids": [], "node": len(self.all) + 1}
        if self.open:
            self.open[-1]["kids"].append(e)
        self.all.append(e)
        self.open.append(e)

    def handle_endtag(self, tag):
        self.open.pop()


def classes(e):
    return [c for c in e["attrs"].get("class", "").split() if re.fullmatch("[A-Za-z][A-Za-z_-]*", c)]


def below(e):
    return [x for k in e["kids"] for x in (k, *below(k))]


def plain_groups(html):
    """Every pair of elements is compared; the lists are the sets of look-alikes."""
    todo = [e for e in Tree(html).all if e["up"] and e["tag"] not in ("html", "body", "head")]
    shape = lambda e: ",".join(k["tag"] for k in e["kids"])
    looks = lambda e: {f"{e['tag']}.{c}" for c in classes(e)} or {f"{e['tag']}>{shape(e)}"}
    around = lambda e: (e["up"]["tag"], *classes(e["up"])[:2])
    found = {}
    for a in todo:
        for look in looks(a):
            alike = [b for b in todo if look in looks(b)]
            kin, kind = [b for b in alike if b["up"] is a["up"]], [b for b in alike if around(b) == around(a)]
            for group in (kin, kind):
                if len(group) > 1 and (group is kin or len({id(b["up"]) for b in group}) > 1):
                    nodes = tuple(b["node"] for b in group)
                    cards = all(len(below(b)) >= 3 or any(x["tag"] == "a" and "href" in x["attrs"] for x in below(b)) for b in group)
                    found[nodes] = (cards, min(look, found.get(nodes, (0, look))[1]))
    some = any(c for c, _ in found.values())
    return {nodes: look for nodes, (cards, look) in found.items() if cards or not some}


def random_page(deal):
    def element(depth):
        tag = deal.choice(["div", "span", "ul", "section", "a"])
        attrs = deal.choice(["", " class='job'", " class='job x1'", " class='card job'", " class='q9'", " data-testid='t'", " href='/'"])
        return f"<{tag}{attrs}>" + "".join(element(depth + 1) for _ in range(deal.randrange(4) if depth < 4 else 0)) + f"{deal.choice(['', 'w'])}</{tag}>"

    return "<html><body>" + "".join(element(1) for _ in range(4)) + "</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    deal = random.Random(8)
    return spark.createDataFrame([(i, random_page(deal)) for i in range(25)] + [(98, None), (99, "")], "page_id long, html string")


def test_groups_equal_a_comparison_of_all_pairs(spark, pages):
    got = {}
    for r in discover.list_groups(pages).collect():
        got.setdefault(r.page_id, []).append(r)
    for p in pages.collect():
        want, rows = plain_groups(p.html or ""), sorted(got.get(p.page_id, []), key=lambda r: r["rank"])
        assert {tuple(r.nodes): r.look for r in rows} == want
        assert [(-r.size, r.depth, r.nodes[0]) for r in rows] == sorted((-r.size, r.depth, r.nodes[0]) for r in rows)
    assert discover.list_groups(pages.limit(0)).count() == 0


def test_every_locator_finds_exactly_its_list(spark, pages):
    groups = discover.list_groups(pages).where("rank <= 3").persist()
    found = discover.list_locators(pages, groups).join(groups, ["page_id", "rank"]).collect()
    distinct = sorted({(x.kind, x.value) for r in found for x in r.locators})
    assert len(found) > 30 and len(distinct) > 20 and {k for k, _ in distinct} >= {"css", "xpath"}
    of, whole = extract.page(), F.element_at("nodes", 1)
    parsed = extract.with_nodes(pages).persist()
    told = {}
    for i in range(0, len(distinct), 20):
        some = distinct[i : i + 20]
        for r in parsed.select("page_id", *(extract.matches(of, whole, {"kind": k, "value": v, "role": v}).alias(f"m{j}") for j, (k, v) in enumerate(some))).collect():
            told |= {(r.page_id, *locator): r[f"m{j}"] for j, locator in enumerate(some)}
    parsed.unpersist()
    for r in found:
        assert all(told[r.page_id, x.kind, x.value] == r.nodes for x in r.locators)


def test_locators_are_not_computed_again_by_what_follows(spark, pages, sf_dir):
    """Rows made of locators bring a filter on them, which took all their expressions with it, a hundred times as long."""
    groups = discover.list_groups(pages)
    for rows in (discover.list_locators(pages, groups).select("page_id", F.posexplode("locators")), registered()["d9_list_locators"][0](spark, sf_dir)):
        assert rows.count() > 0 and len(rows._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    key = lambda df: sorted(map(repr, df.select("page_id", "rank", "locators").collect()))
    assert key(discover.located_lists(pages)) == key(discover.list_locators(pages, groups))
    assert {r.look for r in discover.located_lists(pages, "ul.job").collect()} == {"ul.job"}
    # a page is a row: another one with its id has lists of its own
    twice = pages.where("page_id < 3").union(pages.where("page_id < 3"))
    assert key(discover.located_lists(twice)) == sorted(2 * key(discover.located_lists(pages.where("page_id < 3"))))


def test_what_is_told_of_elements_outside_spark(spark):
    """Roles and stable classes by the helper and by Spark's expressions, with odd attributes."""
    attrs = ["", "role='row x'", "role=' listitem'", "role='  '", "class=' a  b\u0085\tc-d_e \u00e4b a'", "class=x1", "href", "size='2 '", "size=' +3\t'", "size=1.5", "size=-4", "size=99999999999", "size=x multiple", "type=SUBMIT", "type=zz", "list=q", "alt=x", "alt"]
    html = "".join(f"<{tag} {a}>" for tag in ("a", "area", "img", "select", "input", "li", "div") for a in attrs)
    of = extract.with_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    told = F.transform("nodes", lambda n: F.struct(n["tag"].alias("tag"), n["attrs"].alias("attrs"), extract.role_of(n).alias("role"), discover.stable_classes(n).alias("classes")))
    rows = of.select(told.alias("x")).first().x
    assert len(rows) == 7 * len(attrs) + 1 and {r.role for r in rows} >= {"link", "img", "listbox", "combobox", "textbox", "button", "row", "listitem"}
    assert [(extract.role_in(r.tag, r.attrs), list(discover._stable(r.attrs.get("class", "")))) for r in rows] == [(r.role, r.classes) for r in rows]


def test_fields_agree_with_extraction(spark):
    item = "<li class=job><h2 class='title big'><a href=/{0}>T{0}</a></h2><div><span class=loc>L</span><span>x</span></div>{1}</li>"
    html = "<ul><li><a href=/>menu</a></li></ul><main><ul>" + "".join(item.format(i, "<em>new</em>" if i < 2 else "") for i in range(6)) + "</ul></main>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    groups = discover.list_groups(pages).where("rank = 1")
    assert groups.first().look == "li.job" and groups.first().size == 6
    assert [x.value for x in discover.list_locators(pages, groups).first().locators][:2] == ["li.job", "ul > li.job"]
    fields = {r.value: r.share for r in discover.field_locators(pages, groups).collect()}
    assert fields == {"h2.title.big": 1.0, "a": 1.0, "div": 1.0, "span.loc": 1.0}
    spec = {"list": [{"kind": "css", "value": "li.job"}], "fields": [{"name": v, "locators": [{"kind": "css", "value": v}]} for v in fields]}
    assert {(r.target, r.share) for r in extract.locator_coverage(extract.locator_attempts(pages, spec)).collect()} == set(fields.items())


def test_every_element_locator_is_alone(spark, pages):
    """Locators of every element of random pages, each tried by extraction on its own page."""
    some = pages.where("page_id < 6")
    parsed = extract.with_nodes(some)
    wanted = parsed.select("page_id", F.explode(F.transform(F.filter("nodes", lambda n: n["node"] > 0), lambda n: n["node"])).alias("node"))
    found = heal.element_locators(some, wanted).collect()
    assert len(found) == wanted.count() and all(r.locators for r in found)
    of, whole = extract.page(), F.element_at("nodes", 1)
    distinct = sorted({(x.kind, x.value) for r in found for x in r.locators if x.kind != "xpath"} | {(r.locators[-1].kind, r.locators[-1].value) for r in found[::9]})
    told = {}
    for i in range(0, len(distinct), 25):
        part = distinct[i : i + 25]
        for r in parsed.select("page_id", *(extract.matches(of, whole, {"kind": k, "value": v}).alias(f"m{j}") for j, (k, v) in enumerate(part))).collect():
            told |= {(r.page_id, *locator): r[f"m{j}"] for j, locator in enumerate(part)}
    assert all(told.get((r.page_id, x.kind, x.value), [r.node]) == [r.node] for r in found for x in r.locators)


def test_healing_on_redesigned_pages(spark):
    """Every link and text of pages whose classes were renamed, with wrappers and entries put in: 0.9 found again or more, hardly one wrong."""
    deal = random.Random(3)
    old, new = [], []
    for page in range(30):
        jobs = [(f"/job/{page}-{i}", " ".join(deal.choice("senior lead junior baker pilot nurse north river night shift".split()) for _ in range(3)) + f" {i}") for i in range(8)]
        card = '<li class="{c}"><h3><a class="{t}" href="{u}">{s}</a></h3><span class="{p}">Place {u}</span></li>'
        build = lambda names, rows, before, after: f"<html><body>{before}<ul>" + "".join(card.format(u=u, s=s, **names) for u, s in rows) + f"</ul>{after}<input name=q><button id=go>Go</button></body></html>"
        old.append((page, build({"c": "job", "t": "title", "p": "loc"}, jobs, "<main>", "</main>")))
        moved = jobs[:]
        deal.shuffle(moved)
        moved.insert(deal.randrange(8), (f"/job/{page}-new", "quite another post"))
        new.append((page, build({"c": "x-card", "t": "x-name", "p": "x-where"}, moved, "<header><p>Hello</p></header><main><div class=wrap>", "</div></main>")))
        before, after = spark.createDataFrame(old, "page_id long, html string"), spark.createDataFrame(new, "page_id long, html string")
    of = extract.page()

    def known(pages):
        texts = F.filter("nodes", lambda n: n["tag"].isin("a", "span", "input", "button"))
        key = lambda n: F.concat_ws(" ", n["tag"], F.coalesce(extract.attr_of(n, "href"), F.regexp_extract(extract.text_of(of, n), "/job.*", 0)))
        return extract.with_nodes(pages).select("page_id", F.inline(F.transform(texts, lambda n: F.struct(key(n).alias("step_id"), n["node"].alias("node")))))

    prints = heal.fingerprints_of(before, known(before))
    found = {(r.page_id, r.step_id): r.node for r in heal.heal(after, prints).collect()}
    want = {(r.page_id, r.step_id): r.node for r in known(after).collect()}
    asked = {(r.page_id, r.step_id) for r in prints.collect()}
    missed = [k for k in asked if found.get(k) != want[k]]
    right = sum(found.get(k) == want[k] for k in asked)
    assert len(asked) == 30 * 18 and right >= 0.9 * len(asked) and len(found) - right <= 0.01 * len(asked), missed[:9]
    # what is gone has no winner
    gone = prints.where("step_id = 'button '").withColumn("page_id", F.lit(-1).cast("long"))
    assert heal.heal(after, gone).count() == 0
    told = heal.suggestions(after, heal.heal(after, prints.where("page_id = 0")), spark.createDataFrame([("button ", ["#old"])], "step_id string, locators array<string>")).collect()
    assert [(r.step_id, r.locator.value, r.failed, r.source) for r in told] == [("button ", "#go", ["#old"], "fingerprint")]
