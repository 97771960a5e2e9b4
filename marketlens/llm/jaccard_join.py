"""Exact Jaccard join of word shingle sets, and the classes that its links form.

Distances are Jaccard distances, a metric. Between unrelated texts they are all about 1, so a pivot text
separates nothing there; the first partition is therefore made of cells that are exact by counting: a set's
shingles are dealt to one more bucket than two linked sets can differ in, so linked sets
agree in a whole bucket. Sets with an equal bucket share a cell; sets near a border of the size steps are replicated
into the next step. Inside the cells pivots take over: each set goes to one pivot (its Voronoi region), and the links
found there form components. Sets of one component need no comparison. Cells that still hold several components
are joined again by region, the cells around one component: every set is kept as its difference from the region's pivot,
the set of what most members hold, from which all distances follow exactly. No pair is emitted but links that join
components, and nothing is capped.

Sets travel only where a link is possible. A set's profile counts its hashes in 256 ranges; the counts of two sets differ by no
more than the sets do, so that profiles too far apart rule a link out for certain. What they leave is compared exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.components import components, merged
from marketlens.llm.texts import chunked, give_back, lowered, mixed, prefix_hashes, small_batches, span_hashes, word_spans
from marketlens.sources.scratch import discard, staged

WORDS_PER_SHINGLE = 3
PERCENT = 90
#: Sets of one part of a region, and differences that are compared at once.
BLOCK, _COLUMNS = 512, 4096
_SCHEMES = 4
_MIXERS = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(column: pa.Array, width: int = WORDS_PER_SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text with fewer words is one shingle; without words it has none."""
    for first, last, data, offsets in chunked(column):
        data = lowered(data)
        starts, ends, place = word_spans(data, offsets)
        words = span_hashes(prefix_hashes(data), starts, ends)
        total = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            total += mixed(words[k : k + len(total)] + np.uint64(k + 1)) * _MIXERS[k % 6]
        shingles = mixed(total)
        for i in range(last - first):
            a, b = place[i], place[i + 1]
            if b - a >= width:
                yield np.unique(shingles[a : b - width + 1])
            elif b > a:
                parts = words[a:b] * np.array([_MIXERS[k % 6] for k in range(b - a)], np.uint64)
                yield mixed(np.array([parts.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


class Cells:
    """Bucket signatures: two sets with a Jaccard index of `percent` or more always share one."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent, self.bounds = percent, [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, self.bounds[-1] * 3 // 2))
        self.buckets: dict[int, tuple[int, int]] = {}

    def step(self, n: int) -> int:
        return bisect_right(self.bounds, n) - 1

    def most_different(self, n: int) -> int:
        """Shingles that a set of n and a linked set of n or more can differ in."""
        other = n * 100 // self.percent
        return (n + other) * (100 - self.percent) // (100 + self.percent)

    def dealt(self, step: int) -> tuple[int, int]:
        """(buckets, empty buckets allowed): the sets of a step, so that a bucket with content is left equal."""
        if step not in self.buckets:
            least, differ = self.bounds[step], self.most_different(self.bounds[step + 1] - 1)
            spare = 0
            while differ and differ * 0.25 > spare and (differ + 1 + spare) * exp(-least / (differ + 1 + spare)) > 0.02 * (spare + 1):
                spare += 1
            self.buckets[step] = (differ + 1 + spare, spare)
        return self.buckets[step]

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        step = self.step(n)
        steps = [step]
        # The smaller set of a pair decides the step, so sets near the lower border join the step below.
        if step and -(-n * self.percent // 100) < self.bounds[step]:
            steps.append(step - 1)
        out = []
        for s in steps:
            count, spare = self.dealt(s)
            if count == 1:  # sets of this size are linked only if they are equal
                continue
            for scheme in range(_SCHEMES):
                h = hashes if scheme == 0 else np.sort(mixed(hashes + _MIXERS[scheme]))
                bucket = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
                at = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
                tag = np.uint64(((s * _SCHEMES + scheme + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
                out.append(mixed(np.add.reduceat(mixed(h), at) + bucket[at] * _MIXERS[4] + tag))
                if count - len(at) <= spare:
                    break
                if scheme == _SCHEMES - 1:
                    empty = np.setdiff1d(np.arange(count, dtype=np.uint64), bucket[at])
                    out.append(mixed(empty * _MIXERS[5] + tag))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, the set's size, 128 bits that name the set, and its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(percent)
        for batch in batches:
            n, one, two, signatures = [], [], [], []
            for h in shingle_sets(batch.column("text"), width):
                n.append(len(h))
                one.append(h.sum(dtype=np.uint64))
                two.append(mixed(h + _MIXERS[5]).sum(dtype=np.uint64))
                signatures.append(cells.signatures(h) if len(h) else h)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in signatures])])
            flat = np.concatenate([np.zeros(0, np.uint64), *signatures]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["doc_id", "n", "one", "two", "signatures"],
            )

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n long, one long, two long, signatures array<long>")


def profile(hashes: np.ndarray) -> np.ndarray:
    """Counts of the hashes in 256 ranges, 255 at most."""
    return np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8)


def may_link(one: np.ndarray, n_one: np.ndarray, two: np.ndarray, n_two: np.ndarray, percent: int) -> np.ndarray:
    """False only where the profiles prove the Jaccard index to be below `percent`."""
    apart = np.abs(one.astype(np.int16) - two.astype(np.int16)).sum(-1, dtype=np.int64)
    return (100 + percent) * apart <= (100 - percent) * (n_one + n_two)


def _contents(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, profile, hashes) of the texts that stand for a set in a shared cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([profile(s).tobytes() for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["node", "n", "profile", "hashes"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    return rows.mapInArrow(run, "node long, n long, profile binary, hashes array<long>")


def _profiles(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 256)


def _possible(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their profiles do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(_profiles(batch.column(f"p_{x}")), batch.column(f"n_{x}").to_numpy()) for x in "ab"]
            keep = pa.array(may_link(*sides[0], *sides[1], percent))
            yield batch.select(["a", "b"]).filter(keep)

    of = {x: contents.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("profile").alias(f"p_{x}")) for x in "ab"}
    return staged(pairs.select("a", "b").join(of["a"], "a").join(of["b"], "b").mapInArrow(run, "a long, b long"), "jaccard-pairs")


def _verified(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """(a, b, same, together): sizes of the intersection and the union of each pair that can be a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("of_a", "of_b"):
                column = batch.column(name)
                sides.append((np.asarray(column.values).view(np.uint64), np.asarray(column.offsets)))
            (va, oa), (vb, ob) = sides
            same, together = [], []
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                if len(x) > len(y):
                    x, y = y, x
                hit = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                same.append(hit)
                together.append(len(x) + len(y) - hit)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int64()), pa.array(together, pa.int64())], names=["a", "b", "same", "together"])
        give_back()

    left = contents.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = contents.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    possible = _possible(pairs, contents, percent)
    joined = possible.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    verified = staged(joined.mapInArrow(run, "a long, b long, same long, together long"), "jaccard-verified")
    discard(possible)
    return verified


def block_links(sets: list[np.ndarray], side: np.ndarray, group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different groups, as many as it takes to join those groups.

    The pivot is the set of what most sets of the block hold. Sets are kept as their differences from it, and the difference
    of two sets follows from the sizes of theirs and what these share.
    """
    m, sizes = len(sets), np.array([len(h) for h in sets])
    row = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    pivot = 2 * count > m
    lacking = pivot.sum() - np.bincount(row, weights=pivot[column], minlength=m)
    differ = lacking + np.bincount(row, weights=~pivot[column], minlength=m)
    # Only differences that two sets can share need a column.
    used = np.flatnonzero(np.where(pivot, m - count, count) > 1)
    place = np.full(len(count), -1)
    place[used] = np.arange(len(used))
    at = place[column]
    order = np.argsort(at, kind="stable")
    at, by = at[order], row[order]
    shared = np.zeros((m, m), np.float32)
    for first in range(0, len(used), _COLUMNS):
        low, high = np.searchsorted(at, [first, first + _COLUMNS])
        part = used[first : first + _COLUMNS]
        d = np.zeros((m, len(part)), np.float32)
        d[by[low:high], at[low:high] - first] = 1
        d[:, pivot[part]] = 1 - d[:, pivot[part]]
        shared += d @ d.T
    apart = differ[:, None] + differ[None, :] - 2 * shared
    both = sizes[:, None] + sizes[None, :]
    near = (100 * (both - apart) >= percent * (both + apart)) & (group[:, None] != group[None, :])
    near &= np.where(side.any(), (side[:, None] == 1) & (side[None, :] == 2), np.triu(np.ones((m, m), bool), 1))
    up = {int(g): int(g) for g in group}

    def root(g: int) -> int:
        while up[g] != g:
            up[g] = up[up[g]]
            g = up[g]
        return g

    out = []
    for i, j in zip(*np.nonzero(near)):
        a, b = root(int(group[i])), root(int(group[j]))
        if a != b:
            up[a] = b
            out.append((int(i), int(j)))
    return out


_PLACE = ["region", "low", "high"]


def _met(region: DataFrame, contents: DataFrame) -> DataFrame:
    """The sets of each region, in blocks. A large region is dealt to parts, and every two parts meet in a block of their own."""
    parts = region.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = region.join(parts, "region").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("region", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), side.alias("side"), "component", "node")
    return dealt.join(contents, "node").repartition(*_PLACE).sortWithinPartitions(*_PLACE)


def _by_block(rows: DataFrame, finish, schema: str) -> DataFrame:
    """`finish(table)` of the rows of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in _PLACE)))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if keys[i] != now and held:
                    yield finish(pa.Table.from_batches(held).combine_chunks())
                    held = []
                now = keys[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield finish(pa.Table.from_batches(held).combine_chunks())
        held = []
        give_back()

    return rows.mapInArrow(run, schema)


def _apart(side: np.ndarray, group: np.ndarray, rows: slice) -> np.ndarray:
    """Which sets of a block are to be compared with those of `rows`: of another component, and of the other part."""
    other = group[rows, None] != group[None, :]
    return other & (side[rows, None] != side[None, :]) if side.any() else other


def _open_rows(region: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """The rows of each region that may be linked with a set of another component there, by their profiles."""

    def finish(t: pa.Table) -> pa.RecordBatch:
        profiles, n, side, group = _profiles(t.column("profile")), t.column("n").to_numpy(), t.column("side").to_numpy(), t.column("component").to_numpy()
        near = np.zeros(len(n), bool)
        for i in range(0, len(n), 16):
            rows = slice(i, i + 16)
            near[rows] = (may_link(profiles[rows, None], n[rows, None], profiles[None], n[None], percent) & _apart(side, group, rows)).any(1)
        return t.select(["region", "node", "component"]).filter(pa.array(near)).combine_chunks().to_batches()[0] if near.any() else pa.RecordBatch.from_pylist([], t.select(["region", "node", "component"]).schema)

    rows = _met(region, contents.select("node", "n", "profile"))
    return staged(_by_block(rows, finish, "region long, node long, component long").distinct(), "jaccard-regions")


def _region_links(region: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Links inside each region."""

    def finish(t: pa.Table) -> pa.RecordBatch:
        lists = t.column("hashes").chunk(0)
        flat, cuts = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
        nodes = t.column("node").to_numpy()
        found = block_links([flat[a:b] for a, b in zip(cuts, cuts[1:])], t.column("side").to_numpy(), t.column("component").to_numpy(), percent)
        a, b = ([nodes[x[k]] for x in found] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_block(_met(region, contents.select("node", "hashes")), finish, "a long, b long")


def classes(docs: DataFrame, percent: int = PERCENT, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) for every row of `docs`.

    Texts are compared by A-Z lower-cased words, whole. Rows with equal sets are linked; empty and null texts have an
    empty set and are linked with nothing. A row without a doc_id gets its size and no component. Rows that
    repeat a doc_id are judged each by its own text. An empty table gives an empty result.
    """
    sets = staged(_sets(docs, percent, width), "jaccard-sets")
    alike = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "one", "two").agg(F.min("doc_id").alias("node"))
    alike = staged(alike, "jaccard-alike")

    # The cells that more than one set falls into: one shuffle by cell gives both the count and the members.
    stand_ins = sets.withColumn("node", F.col("doc_id")).join(alike, ["node", "n", "one", "two"], "left_semi")
    dealt = stand_ins.select("node", F.explode("signatures").alias("cell"))
    whole_cell = Window.partitionBy("cell")
    dealt = dealt.withColumns({"pivot": F.min("node").over(whole_cell), "other": F.max("node").over(whole_cell)})
    members = staged(dealt.where("pivot < other").select("cell", "pivot", "node").distinct(), "jaccard-members")
    rows = staged(sets.select("doc_id", "n", "one", "two"), "jaccard-rows")
    discard(sets)
    contents = staged(_contents(docs, members.select("node").distinct(), width), "jaccard-contents")

    # Regions: every set goes to the pivot of its first cell; sets alike tend to agree on that cell.
    first = members.where("node <> pivot").groupBy("node").agg(F.min(F.struct("cell", "pivot")).alias("m"))
    checked = _verified(first.select(F.col("m.pivot").alias("a"), F.col("node").alias("b")), contents, percent)
    linked = 100 * F.col("same") >= percent * F.col("together")
    component = components(checked.where(linked).select("a", "b"))
    sizes = alike.groupBy("node").agg(F.min("n").alias("n"))

    def still_open(rest: DataFrame, component: DataFrame) -> DataFrame:
        """Members of the cells that hold several components, with their component and the cell's largest one."""
        now = rest.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        counts = now.groupBy("cell", "component").agg(F.count("*").alias("n_of"))
        cells = counts.groupBy("cell").agg(F.max(F.struct("n_of", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        return staged(now.join(cells.select("cell", F.col("main.component").alias("main")), "cell"), "jaccard-open")

    def unseen(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        return pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")

    def fitting(one: str, two: str) -> Column:
        """Sizes that allow a link."""
        return 100 * F.least(one, two) >= percent * F.greatest(one, two)

    # Cells that hold several components: to close most of them early, the sets outside a cell's largest component
    # meet one of that component's sets in each of their cells.
    open_members = still_open(members.select("cell", "node"), component)
    now = open_members.join(sizes, "node")
    discard(members)
    probe = now.where("component = main").groupBy("cell").agg(F.min(F.struct(F.xxhash64("cell", "node"), "node", "n")).alias("m")).select("cell", F.col("m.node").alias("a"), F.col("m.n").alias("n_a"))
    probes = now.where("component <> main").select("cell", F.col("node").alias("b"), "n").join(probe, "cell").where(fitting("n", "n_a"))
    component = merged(component, _verified(unseen(probes), contents, percent).where(linked).select("a", "b"))

    # What is still open is joined by region: the cells around one component, every set once.
    region = staged(still_open(now.select("cell", "node"), component).select(F.col("main").alias("region"), "node", "component").distinct(), "jaccard-regions")
    every, region = region, _open_rows(region, contents, percent)
    component = merged(component, _region_links(region, contents, percent))

    whole = rows.select("doc_id", "n", "one", "two").join(alike, ["n", "one", "two"], "left").join(component, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    judged = staged(whole.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")), "jaccard-classes")
    discard(rows, alike, checked, open_members, contents, every, region, component)
    return judged
