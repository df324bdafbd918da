"""Fitted operators against held-out labels and planted cases, page extraction, and the pipeline."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_exact import texts
from tests.llm.test_near_copies import brute_groups
from tidemark.llm import decontamination, html_extraction, language_id, queries, storage, textbytes, toxicity

SF = "/root/testdata/sf0.01"


# --- bytes and words


def test_word_hashes():
    rows = ["Café au lait", None, "", "a-b A", "x" * 50 + " y", "lait"]
    got = {}
    for limit in (1, 20, 1 << 20):
        found = []
        for first, data, at in textbytes.blocks(pa.array(rows, pa.string()), limit):
            begin, end, row = textbytes.word_spans(data, at)
            hashes = textbytes.SpanHasher(data)(begin, end)
            found += [(first + r, bytes(data[b:e]).decode().lower(), int(h)) for b, e, r, h in zip(begin, end, row, hashes)]
        got[limit] = found
    assert [(r, w) for r, w, _ in got[1]] == [(0, "café"), (0, "au"), (0, "lait"), (3, "a"), (3, "b"), (3, "a"), (4, "x" * 50), (4, "y"), (5, "lait")]
    assert got[1] == got[20] == got[1 << 20]
    by_word = {}
    for _, w, h in got[1]:
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


# --- toxicity


def auc(scores, labels):
    p, n = scores[labels == 1], scores[labels == 0]
    return (p[:, None] > n[None]).mean() + 0.5 * (p[:, None] == n[None]).mean()


@pytest.fixture(scope="module")
def toxic_model(spark):
    return queries.toxicity_model(spark, queries.table(spark, SF, "documents"), SF)


def test_toxicity_held_out(spark, toxic_model):
    docs = queries.table(spark, SF, "documents")
    got = toxicity.score(docs, toxic_model).join(queries.table(spark, SF, "labels"), "doc_id").where(queries.fold("doc_id", 3) == 1).select("toxic", "score", "predicted").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.85
    assert got[got.toxic == 0].predicted.mean() < 0.05


def test_toxicity_edges(spark, toxic_model):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "the idiot is a pathetic worthless loser, the moron", "x")], "doc_id long, text string, Score string")
    rows = {r.doc_id: r for r in toxicity.score(df, toxic_model).collect()}
    assert rows[1].score == rows[2].score < 0.3 and rows[3].predicted == 1 and all(0 <= r.score <= 1 for r in rows.values())
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = toxicity.fit(docs, labels)
    assert [r.score for r in toxicity.score(df, none).collect()] == [0.0] * 3


def test_gradient_of_the_risk():
    """Both branches of the non-negative risk against differences of the risk itself."""
    rng = np.random.default_rng(5)

    def rows(n, k):
        row = np.sort(rng.integers(0, n, 4 * n))
        return toxicity.Rows(row, rng.integers(0, 6, len(row)), rng.random(len(row)), rng.integers(0, k, n))

    toxic, unlabelled = rows(20, 1), rows(60, 2)
    branches = set()
    for shift in (-4.0, 0.0, 3.0):
        w = rng.standard_normal((2, 7))
        w[:, -1] += shift

        def parts(w):
            as_clean, as_toxic = [], []
            for k in range(2):
                as_clean.append(toxic.risk(w[k : k + 1]))
                loss, grad, n = toxic.risk(-w[k : k + 1])
                as_toxic.append((loss, -grad, n))
            join = lambda some, i: np.concatenate([x[i] for x in some])
            return tuple(join(as_clean, i) for i in range(3)), (join(as_toxic, 0), join(as_toxic, 1)), unlabelled.risk(w)

        def risks(w, prior):
            of_toxic, on_toxic, of_unlabelled = parts(w)
            positive = prior * on_toxic[0] / of_toxic[2]
            negative = of_unlabelled[0] / of_unlabelled[2] - prior * of_toxic[0] / of_toxic[2]
            return positive, negative

        for prior in (0.1, 0.9):
            of_toxic, on_toxic, of_unlabelled = parts(w)
            risk, grad = toxicity.nnpu_gradient(of_toxic, of_unlabelled, on_toxic, prior)
            positive, negative = risks(w, prior)
            assert np.allclose(risk, positive + np.maximum(0, negative))
            for k in range(2):
                branches.add(bool(negative[k] >= 0))
                for j in range(7):
                    step = np.zeros_like(w)
                    step[k, j] = 1e-5
                    up, down = risks(w + step, prior), risks(w - step, prior)
                    slope = lambda i: (up[i][k] - down[i][k]) / 2e-5
                    want = slope(0) + slope(1) if negative[k] >= 0 else -slope(1)
                    assert abs(grad[k, j] - want) < 1e-6
    assert branches == {True, False}


# --- language


def test_language_held_out(spark):
    docs = queries.table(spark, SF, "documents")
    got = queries.op2_language_hierarchical(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(docs)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "é"), (5, "—…"), (6, "the and of the")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, model).collect()}
    assert [got[i] for i in (1, 2, 3, 5)] == [("und", 0.0)] * 4 and got[4][0] != "und" and got[6][0] == "en"
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, empty).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in language_id.identify(df, one).collect()} == {"und", "fr"}


def test_planes_near_the_least_loss():
    """The averaged steps against a long plain descent on the same weighted hinge loss."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((300, 30))).astype(np.float32)
    x /= x.sum(1, keepdims=True)
    y = np.where(x[:, 0] + x[:, 1] - x[:, 2] + 0.02 * rng.standard_normal(300) > 0.03, 1, -1)
    scale, share = 1 / np.linalg.norm(x, axis=1).mean(), {k: len(y) / (2 * (y == k).sum()) for k in (1, -1)}

    def loss(w, b):
        return 5e-5 * (w @ w) / scale**2 + np.mean(np.where(y > 0, share[1], share[-1]) * np.maximum(0, 1 - y * (x @ w + b)))

    w, b, best = np.zeros(30), 0.0, np.inf
    for step in range(1, 20_000):
        hit = (y * (x @ w + b) < 1) * np.where(y > 0, share[1], share[-1]) * y
        w += 60 / step**0.5 * (x.T @ hit / len(y) - 1e-4 * w / scale**2)
        b += 1 / step**0.5 * hit.mean()
        best = min(best, loss(w, b))
    own = language_id._svm(x, np.arange(300), y, 60, 1e-4)
    assert loss(*own) < 1.15 * best + 0.02


def test_duels_equal_a_plain_vote():
    """Prediction against counting each text's letter grams, family and votes one by one; a tie goes to the larger margin, then the name."""
    rng = np.random.default_rng(9)
    size, languages = 1 << language_id.BITS, {"a": ["x1", "x2", "x3"], "b": ["y1"]}
    duels = {"a": [(2, 0, 1), (3, 0, 2), (4, 1, 2)], "b": []}
    model = language_id.Model(["a", "b"], languages, duels, rng.standard_normal((size, 5)).astype(np.float32), rng.standard_normal(5) / 50)
    words = ["alpha", "bêta", "gamma delta", "Ünder way", "x", "one two three four"]
    texts_ = [" ".join(rng.choice(words, 4)) for _ in range(80)] + ["", "12"]
    names, _ = model.predict(pa.array(texts_))
    for text, name in zip(texts_, names, strict=True):
        raw = text.encode()
        if not any(c.isalpha() for c in text):
            assert name == "und"
            continue
        bucket, _ = textbytes.letter_grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), language_id.BITS)
        plane = [sum(float(model.weights[b, p]) for b in bucket) / max(1, len(bucket)) + model.bias[p] for p in range(5)]
        if plane[1] > plane[0]:
            assert name == "y1"
            continue
        votes, margin = [0, 0, 0], [0.0, 0.0, 0.0]
        for p, i, j in duels["a"]:
            votes[i if plane[p] >= 0 else j] += 1
            margin[i], margin[j] = margin[i] + plane[p], margin[j] - plane[p]
        assert name == languages["a"][max(range(3), key=lambda i: (votes[i], margin[i], languages["a"][i]))]
    still = language_id.Model(["a"], {"a": ["x1", "x2"]}, {"a": [(1, 0, 1)]}, np.zeros((size, 2), np.float32), np.zeros(2))
    assert still.predict(pa.array(["a word"]))[0] == ["x1"]


# --- page extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><p>Site</p></header><nav><ul><li>Menu</li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><article><h1>Head &amp; line</h1><p>One <b>two</b>&nbsp;three<br>four<p>Five<div class="ad"><p>Buy</p></div>
<form><input value="x"><p>Sign</p></form><ul><li>a<li>b</ul><section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; me</footer>"""


def test_main_text():
    assert html_extraction.main_text(PAGE) == "Head & line\nOne two three four\nFive\na\nb"
    assert html_extraction.main_text(None) == html_extraction.main_text("") == ""
    assert html_extraction.main_text("<p>a &lt; b &am c</p>x < y <i>z</i>") == "a < b &am c\nx < y z"
    assert html_extraction.main_text("<div><p title='a>b'>q</p></div><!-- open") == "q"
    assert html_extraction.main_text("just text") == "just text"


def page(i, body):
    return f"<html><body><div class='x1'><p>Always here</p><p>on this host</p></div><div class='q'><p>{body}</p><p>And more of {body} for page {i}.</p></div></body></html>"


def test_templates_are_found_by_recurrence(spark):
    rows = [(i, f"https://One.example/{i}", page(i, f"Own words number {i}, long enough to be the larger part of this page")) for i in range(8)]
    rows += [(100 + i, "https://copies.example/x", page(0, "The same page over and over, which is no template at all")) for i in range(20)]
    rows += [(200 + i, f"https://art.example/{i}", f"<article><p>Repeated sentence.</p><p>Text {i}</p></article>") for i in range(9)]
    rows += [(300, None, None), (301, "no scheme", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    templates = html_extraction.template_subtrees(df)
    assert {r.host for r in templates.where("subtree is not null").collect()} == {"one.example"}
    assert {r.host for r in templates.where("subtree is null").collect()} == {"one.example", "art.example"}
    for limit in (0, 1000):
        got = {r.page_id: r for r in html_extraction.extract(df, templates, broadcast_rows=limit).collect()}
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
        assert "Always" not in got[3].text and got[3].text.startswith("Own words number 3")
        assert got[105].text.startswith("Always here") and got[204].text == "Repeated sentence.\nText 4"
        assert got[300].text == "" and got[301].text == "x"


def test_furniture_by_count_alone(spark):
    """Pages without an article element, class names or telling tags: what recurs on a host goes, its text stays."""
    import re

    def bare(html):
        html = re.sub(r' class="[^"]*"', "", html)
        return re.sub(r"</?article>", "", re.sub(r"<(/?)(nav|footer)\b", r"<\1div", html))

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    stripped = spark.createDataFrame([(p.page_id, p.url, bare(p.html)) for p in pages.collect()], pages.schema)
    templates = html_extraction.template_subtrees(stripped)
    hosts = {r.host for r in templates.where("subtree is null").collect()}
    got = {r.page_id: r for r in html_extraction.extract(stripped, templates).collect()}
    want = {r.page_id: r.text for r in queries.op3_template_removal(spark, SF).collect()}
    checked = [i for i, r in got.items() if r.url.split("://")[1].split("/")[0] in hosts]
    assert len(checked) > 150 and all(got[i].text == want[i] for i in checked)


def test_templates_equal_a_count_of_all_pages(spark):
    from collections import Counter, defaultdict

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    of_host = defaultdict(dict)
    for p in pages.collect():
        elements, blocks = html_extraction.parse(p.html)
        of_host[p.url.split("://")[1].split("/")[0].lower()]["\n".join(b.text for b in blocks)] = (elements[0].own, list(html_extraction._counted(elements)))
    want = set()
    for host, found in of_host.items():
        pages_with, chars = Counter(), Counter()
        for _, subtrees in found.values():
            pages_with.update({(by, s) for by, s, _ in subtrees})
            for by, s, n in subtrees:
                chars[by, s] += n
        total = sum(n for n, _ in found.values())
        if len(found) >= 3:
            want |= {(host, None, None)}
            want |= {(host, *k) for k, n in pages_with.items() if n >= 3 and n >= 0.25 * len(found) and (k[0] == html_extraction.BY_CONTENT or chars[k] <= 0.3 * total)}
    assert {tuple(r) for r in html_extraction.template_subtrees(pages).collect()} == want and len(want) > 100


def test_hard_markup():
    text = html_extraction.main_text
    assert text("<article><p>c<noscript>vis</noscript> d</p><option>o</option><p>e <math><mi>x</mi></math> <object>o</object></p><p class='banner-text'>k</p></article>") == "c d\ne x o\nk"
    assert text("<p>a</p><svg><text>drawn<p>b") == "a\ndrawn\nb"
    assert text("<article><div class='comments'>no</div><div class='body'>yes</div></article>") == "yes"
    assert text("<div>x" * 3000) == "\n".join("x" * 3000)
    for page in ("<a " * 20000, "</x>" * 20000, "<b>" * 20000 + "</i>" * 20000, "<span>" * 5000 + "<p>q</p>" * 500, "<!--" * 20000):
        text(page)


def test_what_ends_scripts_and_what_names_may_take():
    text = html_extraction.main_text
    assert text('<script src="x"/>var leak=1;</script><style a=b/>p{}</style><p>said</p>') == "said"
    assert text('<svg><style/><text>drawn</text></svg><p>said</p>') == "drawn\nsaid"
    assert text('<div class="alert-body hidden-gems"><p>body</p></div>') == "body"
    assert text("<main><p>intro</p><article>body</article><p>outro</p></main><div>beside</div>") == "intro\nbody\noutro"
    assert text("<article>teaser</article><div><p>The real text of this page, which is longer.</p></div>") == "teaser\nThe real text of this page, which is longer."
    counted = html_extraction.Templates(counted=True)
    assert text('<div class="notice"><p>kept</p></div><article><p>body of the page</p></article><nav>menu</nav>', counted) == "kept\nbody of the page"


def test_counts_decide_on_counted_hosts(spark):
    """Most given pages change if what recurs on their hosts is left out; pages repeat, tables may be empty."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    templates = html_extraction.template_subtrees(pages)
    only_hosts = templates.where("subtree is null")
    with_counts = {r.page_id: r.text for r in html_extraction.extract(pages, templates).collect()}
    without = {r.page_id: r.text for r in html_extraction.extract(pages, only_hosts).collect()}
    assert sum(with_counts[i] != without[i] for i in with_counts) > 0.6 * len(with_counts)
    few = pages.limit(3)
    repeated = few.unionByName(few)
    assert html_extraction.extract(repeated, templates).count() == 6
    empty = pages.limit(0)
    assert html_extraction.extract(empty, html_extraction.template_subtrees(empty)).count() == 0


def test_pages_query(spark):
    rows = {r.page_id: r.text for r in queries.op3_template_removal(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = p.html.split("<article>")[1].split("</article>")[0]
        import html
        import re

        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert rows[p.page_id] == "\n".join(b for b in blocks if b)


# --- decontamination


def test_common_subsequence():
    item = [1, 2, 3, 1, 4]
    masks = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i

    def brute(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        return table[-1, -1]

    rng = np.random.default_rng(1)
    for _ in range(200):
        words = rng.integers(0, 6, rng.integers(0, 12)).tolist()
        assert decontamination.common_subsequence(masks, 5, words) == brute(item, words)


def test_recall_of_the_candidate_search(spark):
    """Verbatim and altered items inside other words, at two sizes of the benchmark, against the subsequence check of every window."""
    import random

    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    deal = random.Random(3)
    others = [t for t in texts(spark, SF).values() if t and len(t.split()) > 130]
    vocabulary = [w for t in others for w in t.split()]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    items += [(1000 + i, " ".join(deal.choice(others).split()[60 : 60 + deal.randrange(15, 60)])) for i in range(300)]

    def altered(words, kind):
        words = list(words)
        if kind == "sixth":
            for i in range(deal.randrange(6), len(words), 6):
                words[i] = deal.choice(vocabulary)
        elif kind == "order":
            for i in range(deal.randrange(5), len(words) - 1, 6):
                words[i], words[i + 1] = words[i + 1], words[i]
        elif kind == "answer":
            words = [w for i, w in enumerate(words) if i >= len(words) - 5 or deal.random() < 0.72]
        return words

    frequencies = decontamination.document_frequencies(docs)
    sample = decontamination.sampled_passages(docs, frequencies[2], F.xxhash64("doc_id", "text"))
    for some in (items[:40], items):
        index = decontamination.fit(sample, some, frequencies)
        for kind in ("verbatim", "sixth", "order", "answer"):
            planted = []
            for _ in range(100):
                j = deal.randrange(len(some))
                around = deal.choice(others).split()
                planted.append((j, " ".join(around[:50] + altered(some[j][1].split(), kind) + around[50:])))
            data, at = textbytes.text_bytes(pa.array([t for _, t in planted]))
            words = decontamination._words(data, at)
            bounds = np.searchsorted(words[1], np.arange(len(planted) + 1))
            found = set(decontamination._search(index, *words, len(planted)))
            want = set()
            for r, (j, _) in enumerate(planted):
                n, own = len(index.words[j]), words[0][bounds[r] : bounds[r + 1]]
                if any(decontamination._verdict(index, j, own[max(0, i - n) : i + 32 + n].tolist()) for i in range(0, len(own), 16)):
                    want.add((r, j))
            assert len(want) > 80 and len(found & want) >= 0.95 * len(want), (kind, len(some))
    # the passage of the review: between few words of a small vocabulary
    small = [f"v{i}" for i in range(400)]
    item = " ".join(deal.choice(small) for _ in range(30))
    filled = [(i, " ".join(deal.choice(small) for _ in range(80))) for i in range(30)]
    between = lambda: " ".join(deal.choice(small) for _ in range(40))
    df = spark.createDataFrame([*filled, (100, f"{between()} {item} {between()}"), (101, item)], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {100, 101}


def test_planted_leaks(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    filler = " ".join(f"filler{i} word{i % 7}" for i in range(120))
    planted = []
    for n, (i, text) in enumerate(items[:20]):
        words = text.split()
        if n % 2:  # every sixth word another one
            words = [w if k % 6 else f"other{k}" for k, w in enumerate(words, 1)]
        planted.append((10_000 + i, f"{filler} {' '.join(words).upper() if n % 4 == 0 else ' '.join(words)} {filler}"))
    clean = [(20_000, filler), (20_001, None), (20_002, ""), (20_003, items[0][1][: len(items[0][1]) // 3])]
    df = docs.unionByName(spark.createDataFrame(planted + clean, "doc_id long, text string")).withColumn("item_id", F.lit(1))
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(df.drop("item_id"), queries.table(spark, SF, "benchmark")).collect()}
    assert {(10_000 + i, i) for i, _ in items[:20]} <= found
    assert not {d for d, _ in found} & {20_000, 20_001, 20_002, 20_003}
    # verbatim passages in the given documents
    plain = lambda s: " ".join((s or "").lower().split())
    verbatim = {(r.doc_id, i) for r in docs.collect() for i, t in items if plain(t) in plain(r.text)}
    assert verbatim <= found
    kept = decontamination.without_leaks(df, queries.table(spark, SF, "benchmark"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in df.select("doc_id").collect()} - {d for d, _ in found}
    none = queries.table(spark, SF, "benchmark").limit(0)
    named = queries.table(spark, SF, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("doc_id"), "text").unionByName(spark.createDataFrame([(None, None), ("", ""), (None, "???")], "doc_id string, text string"))
    again = {(r.doc_id, r.item_doc_id) for r in decontamination.leaks(df.drop("item_id"), named, item="doc_id", settings=decontamination.Settings(items_at_once=15, blocks_at_once=2)).collect()}
    assert {(10_000 + i, f"item {i}") for i, _ in items[:20]} <= again
    assert decontamination.leaks(docs, none).count() == 0 and decontamination.without_leaks(docs.limit(0), queries.table(spark, SF, "benchmark")).count() == 0


# --- pipeline


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    kept = docs
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = storage.written(stage(spark, before, SF), name)
        ids[name] = {r.doc_id for r in kept.select("doc_id").collect()}
        if name != "byte_bpe":
            assert kept.columns == docs.columns
        if name == "near_duplicates":
            assert ids[name] == set(brute_groups({r.doc_id: r.text for r in before.select("doc_id", "text").collect()}).values())
    sizes = [docs.count(), *(len(ids[n]) for n, _ in corpus_pipeline.STAGES)]
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4] == sizes[5]
    labels = {r.doc_id: r.toxic for r in queries.table(spark, SF, "labels").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert len(ids["toxicity"] & set(clean)) > 0.97 * len(clean)
    digest = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts(spark, SF).items()}
    assert all(digest[r.doc_id] == r.decoded_sha256 for r in kept.collect())


def test_pipeline_edges(spark):
    """Null and empty texts, null and repeated ids, a further column; an empty table."""
    sample = queries.table(spark, SF, "documents").limit(40)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "the and of the with that", "en", "s", 3), (9003, "a of the", "en", "s", 3), (9003, "a of the", "en", "s", 3)], sample.schema)
    df = sample.unionByName(odd).withColumns({"score": F.lit("mine"), "predicted": F.lit(7), "lang_pred": F.lit("xx"), "fp": F.lit(1)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = storage.written(stage(spark, df, SF), "edge")
        assert {tuple(r) for r in df.select("score", "predicted", "lang_pred", "fp").collect()} == {("mine", 7, "xx", 1)}
    got = [r.doc_id for r in df.where("doc_id > 9000 or doc_id is null").collect()]
    assert got.count(9003) == 1 and 9001 not in got and 9002 not in got
    empty = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
