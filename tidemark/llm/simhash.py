"""SimHash near duplicates by bit-sliced comparison.

Every text gets a 64-bit fingerprint of its word shingles. Texts with one
fingerprint are one node. Nodes that may lie within the radius meet in cells:
the 64 bits are cut into more parts than may differ, and each choice of parts
that must then agree is a table whose value is the cell (no pair is lost). In a
cell the fingerprints are stored as vertical bit planes, 64 fingerprints to a
machine word; one fingerprint is compared with all of them by XOR of planes and
carry-save bitwise counters, and words in which every distance exceeds the radius
are abandoned early. A cell passes on a spanning star for each group that it
links, never all pairs; the groups of all cells are joined by components().

Cells above a size are cut into pairs of slices by the fingerprints' hash, which
other tasks compare: no cell is one task's work, and none is capped.

near_groups() and near_pairs() go beyond the radius that bit ranges can promise, for callers
that check what they get: wider cells, compared at a wide radius. A group is a row for each
of its fingerprints, so it grows with their number; pairs are for tables of few near ones.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any
other. Rows with a null id get a fingerprint and their component's id, but are
never a component's id; a component of null ids only has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes
from tidemark.llm.components import components
from tidemark.llm.storage import written

SEED = 42
#: Fingerprints of a cell's slice; a larger cell is cut.
SLICE = 2048
#: Parts of the bits and how many of them must agree in near_groups and near_pairs, and from how many nodes on the narrower cells serve.
WIDE, NARROW, WIDE_NODES = (9, 2), (10, 3), 30_000_000
#: Two fingerprints with more neighbours than this in a cell pass on the link to the first one only.
CROWD = 8


def fingerprint(text: str | None, words: int = 4) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half of the shingles' XXH64."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = list(accumulate(map(len, found), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def majorities(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: a bit is set if it is in over half of the run that begins at its start."""
    half = np.diff(np.append(starts, len(hashes))).astype(np.uint64)
    out = np.zeros(len(starts), np.uint64)
    for b in range(64):
        count = np.add.reduceat(hashes >> np.uint64(b) & np.uint64(1), starts)
        out |= (count * np.uint64(2) > half).astype(np.uint64) << np.uint64(b)
    return out


def add_fingerprints(docs: DataFrame, *, text: str = "text", words: int = 4, out: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(batch.schema.get_field_index(text))
        return {out: pa.array([fingerprint(x.as_py(), words) for x in column], pa.int64())}

    return textbytes.append_columns(docs, make, T.StructType([T.StructField(out, T.LongType())]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


# --- bit-sliced comparison -------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 x words: bit i of word w of plane b is bit b of fingerprint 64 w + i."""
    n = -(-len(fps) // 64) * 64
    rows = np.zeros(n, np.uint64)
    rows[: len(fps)] = fps
    bits = np.unpackbits(rows.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64).reshape(64, n // 64)


def within(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """queries x words: a bit is set where the fingerprint in that lane differs in radius bits at most.

    The running distances of 64 lanes are vertical counters. They start at the
    largest value minus the radius, so that the carry out of the last counter says
    that a lane is beyond the radius.
    """
    size = max(1, (radius + 1).bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = (1 << size) - 1 - radius
    shape = (len(queries), planes.shape[1])
    row, word = (x.ravel() for x in np.indices(shape))
    counters = [np.full(len(row), full if first >> k & 1 else 0, np.uint64) for k in range(size)]
    beyond = np.zeros(len(row), np.uint64)
    out = np.zeros(shape, np.uint64)
    flips = [np.where(queries >> np.uint64(b) & np.uint64(1), full, np.uint64(0)) for b in range(64)]
    for b in range(0, 64, 2):
        x, y = planes[b][word] ^ flips[b][row], planes[b + 1][word] ^ flips[b + 1][row]
        low = counters[0]
        # carry-save: two planes and the lowest counter give a sum and one carry for the next counter
        half = x ^ y
        counters[0] = half ^ low
        carry = (x & y) | (half & low)
        for k in range(1, size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        beyond |= carry
        if b % 16 == 14:
            alive = beyond != full
            if not alive.any():
                return out
            if alive.mean() < 0.75:
                row, word, beyond = row[alive], word[alive], beyond[alive]
                counters = [c[alive] for c in counters]
    out[row, word] = ~beyond
    return out


def _lanes(fps: np.ndarray, radius: int, rows_at_once: int = 256) -> np.ndarray:
    """within() of all fingerprints among themselves."""
    n = len(fps)
    planes = bit_planes(fps)
    lanes = np.zeros((n, planes.shape[1]), np.uint64)
    for i in range(0, n, rows_at_once):
        lanes[i : i + rows_at_once] = within(fps[i : i + rows_at_once], planes, radius)
    tail = n % 64
    if tail:
        lanes[:, -1] &= np.uint64((1 << tail) - 1)
    return lanes


def linked_groups(fps: np.ndarray, radius: int, rows_at_once: int = 256) -> np.ndarray:
    """For each of distinct fingerprints the place of the first one of its group (linked directly or over others)."""
    n = len(fps)
    lanes = _lanes(fps, radius, rows_at_once)
    first = np.full(n, -1)
    unpack = lambda mask: np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))
    for i in range(n):
        if first[i] >= 0:
            continue
        group = np.zeros(lanes.shape[1], np.uint64)
        group[i // 64] = np.uint64(1 << (i % 64))
        wave = np.array([i])
        while len(wave):
            reach = np.bitwise_or.reduce(lanes[wave], axis=0) & ~group
            group |= reach
            wave = unpack(reach)
        first[unpack(group)] = i
    return first


def _small_groups(fps: np.ndarray, begins: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the links inside small cells, all at once: row i against row i + d of the sorted table, as shifted bit planes."""
    for d in range(1, int(sizes.max()) if len(sizes) else 0):
        at = np.concatenate([np.arange(b, b + s - d) for b, s in zip(begins[sizes > d], sizes[sizes > d], strict=True)])
        planes = bit_planes(fps[at] ^ fps[at + d])
        close = within(np.zeros(1, np.uint64), planes, radius)[0]
        hit = np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little")[: len(at)])
        yield at[hit], at[hit] + d


def _by_size(cells: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Begins and sizes of the small cells of more than one row, and (begin, size) of the larger ones; the rows are sorted by cell."""
    begins = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, int)
    sizes = np.diff(np.append(begins, len(cells)))
    few = (sizes > 1) & (sizes <= small)
    return begins[few], sizes[few], list(zip(begins[sizes > small], sizes[sizes > small], strict=True))


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _compare(cells: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect each cell; the rows are sorted by cell."""
    begins, sizes, large = _by_size(cells, 24)
    found = [(fps[i], fps[j]) for i, j in _small_groups(fps, begins, sizes, radius)]
    for b, s in large:
        own = np.unique(fps[b : b + s])
        first = linked_groups(own, radius)
        other = first != np.arange(len(own))
        found.append((own[first[other]], own[other]))
    return _joined(found)


def _uncrowded(i: np.ndarray, j: np.ndarray, degree: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the pairs of places i < j go on: all of a place with few neighbours, else j's with its first neighbour."""
    return (np.minimum(degree[i], degree[j]) <= CROWD) | (first[j] == i)


def _direct_pairs(cells: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of each cell within the radius, less what is crowded."""
    order = np.lexsort((fps, cells))
    cells, fps = cells[order], fps[order]
    begins, sizes, large = _by_size(cells, 128)
    i, j = (x.astype(np.int64) for x in _joined(list(_small_groups(fps, begins, sizes, radius))))
    first = np.full(len(fps), len(fps))
    np.minimum.at(first, j, i)
    keep = _uncrowded(i, j, np.bincount(np.concatenate([i, j]), minlength=len(fps)), first)
    found = [(fps[i[keep]], fps[j[keep]])]
    for b, s in large:
        own = np.unique(fps[b : b + s])
        lanes = _lanes(own, radius)
        degree = np.bitwise_count(lanes).sum(1, dtype=np.int64) - 1
        some = np.flatnonzero(degree)
        first = np.zeros(len(own), int)
        for at in np.split(some, range(256, len(some), 256)):
            near = np.unpackbits(lanes[at].view(np.uint8), axis=1, bitorder="little")
            first[at] = near.argmax(1)
            later, earlier = np.nonzero(near)
            later = at[later]
            keep = earlier < later
            earlier, later = earlier[keep], later[keep]
            keep = _uncrowded(earlier, later, degree, first)
            found.append((own[earlier[keep]], own[later[keep]]))
    return _joined(found)


def _cell_groups(cells: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Group and fingerprint of all that has another within the radius in its cell; equal groups of several cells have one id."""
    order = np.lexsort((fps, cells))
    cells, fps = cells[order], fps[order]
    begins, sizes, large = _by_size(cells, 128)
    i, j = (x.astype(np.int64) for x in _joined(list(_small_groups(fps, begins, sizes, radius))))
    first, before = np.arange(len(fps)), None
    while before is None or (first != before).any():
        before, least = first.copy(), np.minimum(first[i], first[j])
        np.minimum.at(first, i, least)
        np.minimum.at(first, j, least)
        first = first[first]
    for b, s in large:
        own, at = np.unique(fps[b : b + s], return_index=True)
        first[b + at] = b + at[linked_groups(own, radius)]
    size = np.bincount(first, minlength=len(fps))
    member = np.flatnonzero(size[first] > 1)
    ids = size.astype(np.uint64)
    np.add.at(ids, first[member], mixed(fps[member]))
    return mixed(ids[first[member]]), fps[member]


# --- tables and cells ------------------------------------------------------


def _tables(nodes: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bit ranges (from, width) that make each table's cell.

    Of radius + k parts at least k agree. More parts for more nodes: a cell then
    holds few nodes at any size of the corpus.
    """
    k = 1 if nodes < 20_000 else 2 if nodes < 20_000_000 else 3 if nodes < 1_000_000_000 else 4
    return _choices(radius + k, k)


def _choices(parts: int, agree: int) -> list[list[tuple[int, int]]]:
    edges = np.linspace(0, 64, parts + 1).round().astype(int)
    ranges = [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [list(c) for c in combinations(ranges, agree)]


def _cell(fp: Column, table: int, ranges: list[tuple[int, int]]) -> Column:
    cell = F.lit(0).cast("long")
    for begin, width in ranges:
        cell = F.shiftleft(cell, width).bitwiseOR(F.shiftrightunsigned(fp, begin).bitwiseAND(F.lit((1 << width) - 1)))
    # above the bits of any table, whose widths differ
    return cell.bitwiseOR(F.lit(table << 48).cast("long"))


def links(nodes: DataFrame, *, radius: int = 4, slice_rows: int = SLICE) -> DataFrame:
    """Links a, b (signed fingerprints) that connect all of nodes(fp), distinct, within the radius of each other."""
    return _in_cells(nodes, _tables(nodes.count(), radius), lambda cells, fps: _compare(cells, fps, radius), slice_rows)


def near_pairs(nodes: DataFrame, *, radius: int = 13, slice_rows: int = SLICE) -> DataFrame:
    """Pairs a, b (signed fingerprints) of nodes(fp), distinct, that differ in radius bits at most.

    A pair meets if two of nine parts of the bits agree: surely up to 7 different bits, by chance beyond
    (three of ten from WIDE_NODES on). Fingerprints crowded in a cell pass on a link to one neighbour.
    """
    tables = _choices(*(WIDE if nodes.count() < WIDE_NODES else NARROW))
    return _in_cells(nodes, tables, lambda cells, fps: _direct_pairs(cells, fps, radius), slice_rows)


def near_groups(nodes: DataFrame, *, radius: int = 13, slice_rows: int = SLICE) -> DataFrame:
    """cell, fp (signed): groups of nodes(fp), distinct, that links of radius bits at most hold together in a cell.

    Two fingerprints that near_pairs would bring together, crowded or not, are in a group. A
    fingerprint has one row for each cell at most, so no row stands for a pair.
    """
    tables = _choices(*(WIDE if nodes.count() < WIDE_NODES else NARROW))
    return _in_cells(nodes, tables, lambda cells, fps: _cell_groups(cells, fps, radius), slice_rows).toDF("cell", "fp")


def _in_cells(nodes: DataFrame, tables: list[list[tuple[int, int]]], compare: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], slice_rows: int) -> DataFrame:
    """What compare finds in each cell of the tables, distinct."""
    index = nodes.select("fp", F.explode(F.array(*(_cell(F.col("fp"), i, r) for i, r in enumerate(tables)))).alias("cell"))
    sizes = index.groupBy("cell").count().where("count > 1")
    slices = F.ceil(F.col("count") / slice_rows).cast("int")
    # merged at every size: Spark takes the exploded index for as small as nodes and would send all its rows to the driver
    member = index.join(sizes.hint("merge"), "cell").select("cell", "fp", slices.alias("slices"), F.pmod(F.xxhash64("fp"), slices).cast("int").alias("own"))
    others = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("low"), F.greatest(o, F.col("own")).alias("high")))
    placed = member.select("fp", "cell", F.explode(others).alias("pair"))
    placed = placed.select("fp", F.when(F.col("pair.high") == 0, F.col("cell")).otherwise(F.xxhash64("cell", "pair.low", "pair.high")).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_cell, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cells = np.concatenate([rest_cell, batch.column(0).to_numpy()])
            fps = np.concatenate([rest_fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(cells):
                continue
            whole = np.searchsorted(cells, cells[-1])  # the last cell may go on in the next batch
            rest_cell, rest_fp = cells[whole:], fps[whole:]
            yield batch_of(*compare(cells[:whole], fps[:whole]))
        yield batch_of(*compare(rest_cell, rest_fp))

    return placed.select("place", "fp").repartition("place").sortWithinPartitions("place").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """key, fp (signed fingerprint) and component_id (the smallest key reachable) of every row."""
    marked = written(add_fingerprints(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), text="__text", words=words).drop("__text"), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("__key").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius=radius))
    grouped = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(F.col("__key").alias(key), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
