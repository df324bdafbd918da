"""Operators with one right answer, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, components, near_copies, neighbours, queries, sharding, simhash, token_counts, url_filters

DOC = "doc_id long, text string"


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


# --- sharding


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 7, 8, 9, 100])
def test_jump_shard(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567, *range(2, 300)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: jump(k, shards) for k in keys}


def test_shards_of_documents(spark, sf_dir):
    rows = queries.op4_jump_sharding(spark, sf_dir).collect()
    all_texts = texts(spark, sf_dir)
    assert sorted(r.doc_id for r in rows) == sorted(all_texts)
    slots = defaultdict(list)
    for r in rows:
        raw = (all_texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == jump(r.doc_id, 8) and r.grown_shard in (r.shard, 8) and r.grown_shard == jump(r.doc_id, 9)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_one_repeated_key(spark):
    """A key with most of the rows: gapless slots, from many buckets; many shards: few jumps."""
    df = spark.createDataFrame([(None if i % 2 else 7, "x") for i in range(3000)] + [(i, "y") for i in range(500)], "doc_id long, text string")
    slots = defaultdict(list)
    for r in sharding.assign(df, bucket_rows=100).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 3500
    many = df.select("doc_id", sharding.jump_shard(F.col("doc_id"), 3000).alias("s")).where("doc_id > 7").distinct().collect()
    assert many and all(r.s == jump(r.doc_id, 3000) for r in many)


def test_shard_edge_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "é", 2), (5, "a", 3), (5, "a", 3)], "doc_id long, text string, shard int")
    rows = sorted(tuple(r) for r in sharding.assign(df).select("doc_id", "size", "text_crc32", "shard", "slot").na.fill(-1).collect())
    assert [r[:3] for r in rows] == [(-1, 1, 0), (-1, 3, zlib.crc32("é".encode())), (5, 2, zlib.crc32(b"a")), (5, 2, zlib.crc32(b"a"))]
    assert sharding.assign(df.limit(0)).count() == 0


# --- neighbours


def brute_neighbours(rows, k=5):
    x = {i: np.array(v, np.float64) for i, v in rows}
    n = {i: v / np.linalg.norm(v) for i, v in x.items()}
    return {q: sorted(((-round(float(n[q] @ n[i]), 9), i) for i in n if i != q))[:k] for q in n if q % 50 == 0}


def test_neighbours_recall(spark, sf_dir):
    rows = queries.op5_cross_polytope(spark, sf_dir).collect()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute_neighbours(table)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert all(a[1] >= b[1] for v in got.values() for a, b in zip(v, v[1:]))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_vectors_are_hashed(spark, monkeypatch, sf):
    """No comparison of everything, and 0.9 of the true neighbours or more."""
    hashed = []
    real = neighbours._hashed

    def noted(classes, tables, plans, *, index):
        hashed.append(plans)
        return real(classes, tables, plans, index=index)

    monkeypatch.setattr(neighbours, "_hashed", noted)
    sf_dir = f"/root/testdata/{sf}"
    rows = queries.op5_cross_polytope(spark, sf_dir).collect()
    assert len(hashed) == 2 and all(set(p) == {64} and p[64][1] < 128 for p in hashed)
    want = brute_neighbours([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in rows)
    assert hits >= 0.9 * 5 * len(want)


def test_wide_vectors_and_full_comparison(spark):
    """More axes than are probed at several turns; in_full finds the same as brute force."""
    rng = np.random.default_rng(4)
    table = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((120, 2100)))]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    want = {q: [i for _, i in v] for q, v in brute_neighbours(table).items()}
    for full in (False, True):
        got = defaultdict(set)
        for r in neighbours.search(df, F.col("vec_id") % 50 == 0, in_full=full).collect():
            got[r.query_id].add(r.vec_id)
        assert sum(len(got[q] & set(want[q])) for q in want) >= (15 if full else 0.9 * 15)


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (100, [1.0, 1.0, 1.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in sorted(neighbours.search(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    assert got == {0: [3, 3, 50, 2, 9], 50: [0, 3, 3, 2, 9]}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_equal_vectors_keep_only_what_can_be_near(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(120)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert [got[0, i] for i in range(1, 6)] == [1, 2, 3, 4, 5] and [got[100, i] for i in range(1, 6)] == [0, 1, 2, 3, 4]


def test_neighbours_of_parallel_and_repeated_rows(spark):
    factors = [1, 1.37, 0.1, 3, 7.7, 1e-3, 12.1, 2.3]
    rows = [(i, [1.0 * f, 2.0 * f, -0.3 * f]) for i in range(40) for f in [factors[i % 8]]] + [(100, [0.9, 0.1, 0.0]), (101, [0.9, 0.1, 0.0]), (101, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert [got[0, i][0] for i in range(1, 6)] == [1, 2, 3, 4, 5] and all(abs(got[0, i][1] - 1) < 1e-12 for i in range(1, 6))
    assert [got[100, i][0] for i in range(1, 6)] == [101, 0, 1, 2, 3]


def test_probes_follow_the_data(spark, monkeypatch):
    """Hashed lengths, with one turn and with two, against brute force; clustered vectors take few probes."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 16))
    near = np.repeat(centres, 20, axis=0) + 0.1 * rng.standard_normal((1200, 16))
    for block, x in ((2048, rng.standard_normal((1200, 16))), (32, near)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        table = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
        got = defaultdict(set)
        for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect():
            got[r.query_id].add(r.vec_id)
        want = brute_neighbours(table)
        assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 5 * len(want)


# --- token counts and BPE

HARD = ["", " ", "a", "  a  b ", "word\n\n word", "it's  they'll 'tis", "x" * 5000, "é à ü " * 50, "tab\t space  nbsp 　wide", "<|endoftext|> and <|endoftext|>x", "a  b ​ c", "हिन्दी 中文文字", "1234 5678 !!! ??", "trailing ", "\x85 \x1c b"]


def test_token_counts_equal_library(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    mine = token_counts.TokenCounter(queries.tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(5)
    random_texts = ["".join(rng.choice("ab é\n\t  '.1 ") for _ in range(rng.randrange(60))) for _ in range(500)]
    cases = HARD + random_texts + [t or "" for t in texts(spark, sf_dir).values()]
    want = [len(e.ids) for e in whole.encode_batch(cases, add_special_tokens=False)]
    assert mine.count_all(cases) == want
    for chunk, overlap in ((7, 2), (64, 8), (500, 16)):
        assert [mine.count_long(t, chunk, overlap) for t in cases[:520] if t] == [n for t, n in zip(cases[:520], want) if t]


def test_token_count_query(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op6_token_counts(spark, sf_dir).collect()}
    for i, t in texts(spark, sf_dir).items():
        assert rows[i].n_bytes == len((t or "").encode()) and rows[i].over_limit == (rows[i].n_tokens > 512)
    df = spark.createDataFrame([(1, None, 9), (2, "", 9)], "doc_id long, text string, n_tokens int")
    assert [r.n_tokens for r in token_counts.count_tokens(df, queries.tokenizer_file("byte_bpe_50k.json")).collect()] == [0, 0]


def test_bpe_tree_equals_library(spark, sf_dir, monkeypatch):
    import base64

    import tiktoken

    path = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.TreeCodec(path, queries.pattern())
    rng = random.Random(6)
    random_texts = ["".join(rng.choice("ab é\n\t  '.1 s") for _ in range(rng.randrange(200))) for _ in range(400)]
    cases = HARD + random_texts + [t or "" for t in texts(spark, sf_dir).values()]
    for leaf, window in ((3, 1), (16, 4), (1 << 14, 32)):
        monkeypatch.setattr(byte_bpe, "LEAF", leaf)
        monkeypatch.setattr(byte_bpe, "WINDOW", window)
        for t in cases if leaf > 10 else cases[:300]:
            ids = codec.encode(t)
            assert ids == library.encode_ordinary(t), t
            assert codec.decode(ids) == t.encode()


def test_bpe_query(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op10_byte_bpe(spark, sf_dir).collect()}
    for i, t in texts(spark, sf_dir).items():
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    path = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, None), (2, "two words")], DOC)
    both = byte_bpe.decode(byte_bpe.encode(df, path, queries.pattern()), path, queries.pattern())
    assert {r.doc_id: bytes(r.decoded) for r in both.collect()} == {1: b"", 2: b"two words"}


# --- SimHash


def brute_fingerprint(text, words=4):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, sf_dir):
    fps = {i: brute_fingerprint(t) for i, t in texts(spark, sf_dir).items()}
    want = brute_components(fps)
    rows = queries.op7_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == want


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    fps[50:120] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64))
    lanes = simhash.within(fps, simhash.bit_planes(fps), radius)
    got = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")[:, :200].astype(bool)
    assert (got == (np.bitwise_count(fps[:, None] ^ fps[None]) <= radius)).all()


@pytest.mark.parametrize("slice_rows", [8, 2048])
def test_links_find_every_group(spark, slice_rows):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = set(centres.tolist())
    for _ in range(400):  # walks of a few bits from what is there
        f = int(rng.choice(centres[:8])) if rng.random() < 0.7 else int(list(fps)[int(rng.integers(len(fps)))])
        for b in rng.integers(0, 64, int(rng.integers(1, 6))):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    want = brute_components(dict(enumerate(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df, slice_rows=slice_rows)).collect()}
    groups, brute = defaultdict(set), defaultdict(set)
    for i, f in enumerate(signed):
        groups[roots.get(f, f)].add(i)
        brute[want[i]].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_simhash_edges_and_one_of_copies(spark):
    rows = [(3, None, 1), (1, "", 1), (None, "a b c d e", 1), (7, "A b c d e", 2), (7, "A b c d e", 2), (9, "q", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    groups = simhash.near_duplicates(df)
    assert Counter((r.doc_id, r.component_id) for r in groups.collect()) == Counter({(3, 1): 1, (1, 1): 1, (None, 7): 1, (7, 7): 2, (9, 9): 1})
    one_id = spark.createDataFrame([(3, "a b c d e"), (5, "a b c d e"), (5, "q r s t u"), (5, "q r s t u")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_copies.keep_one(one_id).collect()) == [(3, "a b c d e"), (5, "q r s t u")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components.components(path).collect()} == {0}


# --- URL filters


def test_url_rules_and_spread(spark, sf_dir):
    rows = {r.page_id: r for r in queries.op8_link_graph(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        rest = p.url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(r), r, v) for v, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fit) if fit else (0, None, None)
        assert (rows[p.page_id].host, rows[p.page_id].path, rows[p.page_id].rule) == (host, path, best[1])
        assert rows[p.page_id].verdict == best[2] if best[1] else rows[p.page_id].verdict in ("allow", "block")


def test_links_carry_trust_and_distrust(spark):
    page = "spam page <a href='http://{}/x'>a</a> <A class=q HREF=//own.net/y>b</A>"
    rows = [
        (1, "http://good.org/a", page.format("FRIEND.net")),
        (2, "http://friend.net/a", "none"),
        (3, "http://bad.com/de/a", "none"),
        (4, "http://farm.net/a", page.format("bad.com")),
        (5, "http://own.net/", None),
        (6, None, None),
        (7, "no scheme", ""),
        (8, "HTTP://Lone.NET?q#f", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, queries.URL_RULES).collect()}
    assert got[1] == ("good.org", "/a", "org/", "allow") and got[3] == ("bad.com", "/de/a", "com/de/", "block")
    assert got[4][3] == "block" and got[2][3] == "allow" and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("lone.net", "", None, "allow")
    assert url_filters.judge(df.limit(0), queries.URL_RULES).count() == 0


def brute_ranks(seeds, links, damping=0.85):
    """Fixed point of one kind: seeds node -> mass, links (a, b) -> n."""
    nodes = sorted(set(seeds) | {x for edge in links for x in edge})
    at = {n: i for i, n in enumerate(nodes)}
    step, start = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    for n, mass in seeds.items():
        start[at[n]] = mass / sum(seeds.values())
    for (a, b), n in links.items():
        step[at[b], at[a]] = n / sum(m for (x, _), m in links.items() if x == a)
    dangling = step.sum(0) == 0
    rank = start
    for _ in range(300):
        rank = (1 - damping) * start + damping * (step @ rank + rank[dangling].sum() * start)
    return dict(zip(nodes, rank))


def test_page_ranks_of_hosts(spark):
    """Trust and distrust over cross-host links with cycles, chains and hosts without links, against the fixed point."""
    rng = random.Random(4)
    hosts = [f"h{i}.net" for i in range(40)] + [f"good{i}.org" for i in range(4)] + [f"x{i}.com" for i in range(4)]
    rows, links = [], Counter()
    for i, h in enumerate(hosts):
        to = [rng.choice(hosts) for _ in range(rng.choice([0, 1, 3]))] + ([hosts[i + 1]] if i < 20 else [])
        rows.append((i, f"http://{h}{'/de/' if h.startswith('x') else '/'}", "".join(f'<a href="https://{t}/">x</a>' for t in to)))
        links.update((h, t) for t in to if t != h)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    trust = brute_ranks({h: 1 for h in hosts if h.endswith(".org")}, links, 0.5)
    distrust = brute_ranks({h: 1 for h in hosts if h.startswith("x")}, {(b, a): n for (a, b), n in links.items()}, 0.5)
    got = {r.host: r for r in url_filters.judge(df, queries.URL_RULES, damping=0.5, tolerance=1e-6).collect()}
    for h in hosts:
        if not got[h].rule and abs(trust.get(h, 0) - distrust.get(h, 0)) > 1e-5:
            assert got[h].verdict == ("block" if distrust.get(h, 0) > trust.get(h, 0) else "allow"), h
    assert {"allow", "block"} <= {got[h].verdict for h in hosts if not got[h].rule}
    seeds = spark.createDataFrame([("trust", h, 0.25) for h in hosts if h.endswith(".org")], "kind string, node string, mass double")
    ways = spark.createDataFrame([("trust", a, b, n / sum(m for (x, _), m in links.items() if x == a)) for (a, b), n in links.items()], "kind string, a string, b string, share double")
    ranks = {r.node: r.mass for r in url_filters.spread(seeds, ways, damping=0.5, tolerance=1e-6).collect()}
    assert all(abs(ranks.get(h, 0) - trust.get(h, 0)) < 1e-5 for h in hosts) and abs(sum(ranks.values()) - 1) < 1e-6
