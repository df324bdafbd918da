"""Near copies against the Jaccard similarity of all pairs."""

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.test_exact import texts
from tidemark.llm import near_copies, queries, simhash

SF = "/root/testdata/sf0.01"


def shingle_set(text, words=5):
    found = (text or "").lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_groups(rows, similarity=0.8):
    """Smallest id of each id's group: links by the similarity of every pair that shares a shingle."""
    sets = {i: shingle_set(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, pairs = {}, set()
    for i, s in sets.items():
        for x in s or {()}:
            holders.setdefault(x, []).append(i)
    for group in holders.values():
        pairs |= {(a, b) for n, a in enumerate(group) for b in group[n + 1 :]}
    close = [(a, b) for a, b in pairs if not (sets[a] | sets[b]) or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    for a, b in close:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in rows}


def test_stage_keeps_one_of_each_group(spark):
    docs = queries.table(spark, SF, "documents")
    want = brute_groups(texts(spark, SF))
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(want.values())


def test_planted_similarities(spark):
    """One large group of edited copies, pairs just above and below the similarity, short and empty texts."""
    deal = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, base = {}, [deal.choice(words) for _ in range(200)]
    for i in range(60):
        edited = list(base)
        for k in deal.sample(range(200), 2):
            edited[k] = deal.choice(words)
        rows[i] = " ".join(edited)
    for i in range(100, 160, 2):
        own = [deal.choice(words) for _ in range(100)]
        rows[i] = " ".join(own)
        rows[i + 1] = " ".join(own[: 96 - (i - 100) // 2])  # similarity 0.96 down to 0.66
    rows |= {200: None, 201: " ", 202: "Two words", 203: "two\nWORDS", 204: "two other"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == brute_groups(rows)


def test_chains_of_near_copies_in_blocks(spark, monkeypatch):
    """Copies of copies, each a few words further, in cells of many small blocks, with and without leaders."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 16)
    deal = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    chain, rows = [deal.choice(words) for _ in range(120)], {}
    for i in range(150):
        if i % 3 == 0:
            chain = list(chain)
            chain[deal.randrange(120)] = deal.choice(words)
        own = list(chain)
        own[deal.randrange(120)] = deal.choice(words)
        rows[i] = " ".join(own)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = brute_groups(rows)
    for rounds in (0, 2):
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, rounds=rounds).collect()}
        # a link may be missed by all bands, but hardly in a chain with so many
        assert got == want


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (0, 1, 50, 200, 300, 50)]
    for at_once in (7, 4096):
        near_copies.SHARED_AT_ONCE = at_once
        got = near_copies.shared_counts(sets, 4)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(4) for j in range(6) if i != j)
    near_copies.SHARED_AT_ONCE = 4096


def test_stage_finds_by_simhash(spark):
    """Two texts of similarity 0.82 whose MinHash bands all differ: only their fingerprints bring them together."""
    deal = random.Random(33699)
    one = [f"w{deal.randrange(5000)}" for _ in range(104)]
    two = ["other" if i in (30, 75) else w for i, w in enumerate(one)]
    rows = {1: " ".join(one), 2: " ".join(two), 3: "quite another text of more than five words"}
    _, fps, cells = near_copies._marks(pa.array(list(rows.values())), 5)
    assert not (cells[0] == cells[1]).any() and ((fps[0] ^ fps[1]) & (1 << 64) - 1).bit_count() <= 7
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()} == set(brute_groups(rows).values()) == {1, 3}


def test_fingerprints_are_majorities_of_distinct_shingles():
    rows = ["a b c d e f g a b c d e f g a b c d e", "one", "", None, "x y z x y z x y z x y z"]
    _, fps, _ = near_copies._marks(pa.array(rows, pa.string()), 5)
    for text, fp in zip(rows, fps, strict=True):
        own = near_copies._sets(pa.array([text], pa.string()), 5)[0].tolist()
        want = sum((sum(h >> b & 1 for h in own) * 2 > len(own)) << b for b in range(64)) if own else None
        assert (fp if fp is None else fp & (1 << 64) - 1) == want


def test_near_pairs(spark):
    """In small, large and cut cells: every pair of up to 7 bits, none beyond the radius, far ones mostly."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, 1500, np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, False).astype(np.uint64)) for n in rng.integers(1, 15, 1500)]
    fps = np.concatenate([base, base ^ np.array(flips, np.uint64)])
    # cells with hundreds of rows: the first 22 bits agree
    fps[:600] &= np.uint64((1 << 64) - (1 << 22))
    fps[1500:1800] = fps[:300] ^ np.array(flips[:300], np.uint64)
    fps = np.unique(fps)
    apart = np.bitwise_count(fps[:, None] ^ fps[None])
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    df = spark.createDataFrame([(f,) for f in place], "fp long")
    for slice_rows in (2048, 100):
        got = {tuple(sorted((place[r.a], place[r.b]))) for r in simhash.near_pairs(df, slice_rows=slice_rows).collect()}
        all_near = set(zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= 13, 1))), strict=True))
        sure = set(zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= 7, 1))), strict=True))
        assert sure <= got <= all_near and len(got) > 0.85 * len(all_near) and len(sure) > 500


def test_crowded_fingerprints_stay_linked(spark):
    """A crowd within the radius leaves a few links for each member, and they connect it."""
    center = 0x0123456789ABCDEF
    fps = [center ^ 1 << b for b in range(60)] + [center ^ 3 << b for b in range(60)] + [center]
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    reached, wave = {fps[-1]}, {fps[-1]}
    while wave:
        wave = ({a for a, b in got if b in wave} | {b for a, b in got if a in wave}) - reached
        reached |= wave
    assert reached == set(fps) and len(got) < len(fps) ** 2 / 4


def test_no_link_is_lost_in_a_crowd_and_no_row_stands_for_a_pair(spark, monkeypatch):
    """The pair that only fingerprints find, in a crowd of texts near both fingerprints whose similarity is below 0.8."""
    deal = random.Random(33699)
    one = [f"w{deal.randrange(5000)}" for _ in range(104)]
    rows = {1: " ".join(one), 2: " ".join("other" if i in (30, 75) else w for i, w in enumerate(one))}
    for n in range(10, 710):
        at = {30, 75, deal.randrange(2, 12), deal.randrange(90, 102)} if n % 2 else {deal.randrange(5, 25), deal.randrange(45, 60), deal.randrange(85, 100)}
        rows[n] = " ".join(f"x{n}" if i in at else w for i, w in enumerate(one))
    want = brute_groups(rows)
    assert want[2] == 1 and len(set(want.values())) == len(rows) - 1
    made, write = {}, near_copies.Scratch.written

    def counted(self, df, name):
        out = write(self, df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies.Scratch, "written", counted)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == want
    # a row for each table of cells at most, and one leader for each node
    assert made["near"][0] <= 36 * len(rows) and made["pairs"][0] <= len(rows)


def test_near_groups(spark):
    """Every pair that near_pairs finds is in a group, in small, large and cut cells; a crowd's rows grow with its size."""
    rng = np.random.default_rng(9)
    center = np.uint64(0x0123456789ABCDEF)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, False).astype(np.uint64)) for n in rng.integers(1, 7, 250)]
    fps = np.unique(np.concatenate([center ^ np.array(flips, np.uint64), rng.integers(0, 1 << 64, 100, np.uint64)])).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for slice_rows in (2048, 100):
        groups, of = {}, {}
        got = simhash.near_groups(df, slice_rows=slice_rows).collect()
        for r in got:
            groups.setdefault(r.cell, set()).add(r.fp)
            of.setdefault(r.fp, set()).add(r.cell)
        assert all(len(g) > 1 for g in groups.values()) and len(got) <= sum(map(len, groups.values()))
        pairs = simhash.near_pairs(df, slice_rows=slice_rows).collect()
        assert pairs and all(of[r.a] & of[r.b] for r in pairs)
        apart = {(a, b) for a in fps for b in fps if a < b and 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 7}
        assert len(apart) > len(pairs) and all(of[a] & of[b] for a, b in apart)
        if slice_rows == 2048:
            assert len(got) <= 36 * len(fps)


def test_no_table_of_the_corpus_is_broadcast(spark, tmp_path):
    """Read from files, which Spark takes for small: an exploded index has 36 rows for each fingerprint in them."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def plans():
        bus.waitUntilEmpty(30_000)
        found = store.executionsList()
        return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}

    spark.createDataFrame([(i * 0x9E3779B97F4A7C1 % (1 << 63),) for i in range(500)], "fp long").write.parquet(f"{tmp_path}/fps")
    deal = random.Random(4)
    base = [f"w{deal.randrange(999)}" for _ in range(150)]
    texts = [(i, " ".join(f"x{i}" if k == i else w for k, w in enumerate(base[i // 60 * 3 :]))) for i in range(120)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    before = set(plans())
    simhash.near_groups(spark.read.parquet(f"{tmp_path}/fps")).collect()
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == set(brute_groups(dict(texts)).values())
    joins = [j for i, plan in plans().items() if i not in before for j in re.findall(r"(BroadcastHash|SortMerge)Join (\w+)", plan)]
    # only ids that texts are chosen by may be
    assert ("SortMerge", "Inner") in joins and set(joins) & {("BroadcastHash", kind) for kind in ("Inner", "LeftOuter", "RightOuter")} == set()
