"""Near-duplicate embeddings by p-stable hashing for Euclidean distance, with exact cosine checks.

On the unit sphere a cosine is a distance. A hash value is a random projection, shifted and cut into steps of `WIDTH`;
a bucket is a row of such values, and there are as many tables as it takes to miss a pair at the threshold with a
probability of `MISS` at most. Every pair that shares a bucket is checked; a pair counts in the first table where it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.components import components
from marketlens.llm.texts import mixed, small_batches
from marketlens.llm.vectors import matrix, unit, usable
from marketlens.sources.scratch import staged

LEAST_COSINE = 0.9
WIDTH, MISS = 2.0, 0.005
#: Unrelated vectors that are expected in a bucket, and vectors that are compared with each other at once.
CROWD, BLOCK = 40, 1024


def agreement(distance: float, width: float = WIDTH) -> float:
    """Probability that one hash value of two vectors at a distance is equal."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


@dataclass(frozen=True)
class Tables:
    """Random projections of `tables` tables with `values` hash values each; the same for a seed."""

    values: int
    tables: int
    seed: int = 11

    @staticmethod
    def planned(rows: int, least: float = LEAST_COSINE) -> Tables:
        values = max(4, ceil(log(max(rows, CROWD) / CROWD) / -log(agreement(sqrt(2)))))
        near = agreement(sqrt(2 - 2 * least)) ** values
        return Tables(values, ceil(log(MISS) / log(1 - near)))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """A (rows, tables) array of bucket numbers of unit vectors."""
        rng = np.random.default_rng([self.seed, x.shape[1]])
        n = self.values * self.tables
        steps = np.floor((x @ rng.standard_normal((x.shape[1], n)) + rng.uniform(0, WIDTH, n)) / WIDTH).astype(np.int64)
        steps = mixed(steps.view(np.uint64) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return mixed(steps.reshape(len(x), self.tables, self.values).sum(axis=2, dtype=np.uint64) + np.uint64(x.shape[1]))


def _block_links(x: np.ndarray, ids: np.ndarray, side: np.ndarray, weights: np.ndarray, table: int, tables: Tables, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one block of a bucket: (links of each row, two ends of links that hold its groups together).

    side is 0 where rows meet each other, or 1 and 2 where rows of side 1 meet those of side 2.
    """
    counts = np.zeros(len(x), np.int64)
    left, right = (np.flatnonzero(side != 2), np.flatnonzero(side != 1))
    a, b = np.nonzero(x[left] @ x[right].T >= least)
    a, b = left[a], right[b]
    once = (a < b) if not side.any() else np.ones(len(a), bool)
    a, b = a[once], b[once]
    if table and len(a):
        touched = np.unique(np.concatenate([a, b]))
        keys = tables.buckets(x[touched])[:, :table]
        pa_, pb = np.searchsorted(touched, a), np.searchsorted(touched, b)
        before = np.zeros(len(a), bool)
        for k in range(table):
            before |= keys[pa_, k] == keys[pb, k]
        a, b = a[~before], b[~before]
    np.add.at(counts, a, weights[b])
    np.add.at(counts, b, weights[a])
    # A link is kept if it joins two groups of this block.
    up = np.arange(len(x))
    keep = []
    for k in range(0, len(a)):
        i, j = a[k], b[k]
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        while up[j] != j:
            up[j] = up[up[j]]
            j = up[j]
        if i != j:
            up[max(i, j)] = min(i, j)
            keep.append(k)
    return counts, ids[a[keep]], ids[b[keep]]


def classes(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding, more columns are left out).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component. Vectors of different lengths are never linked. Equal vectors are one class and are expanded at the end only. Rows
    that repeat a vec_id are rows of their own that share its component. A null vec_id gets its links and no
    component. An empty table gives an empty result.
    """
    rows = small_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).withColumn("usable", usable(F.col("embedding")))
    same = rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    # A class without any id still counts as a neighbour; its stand-in lies below all ids.
    same = same.withColumn("class", F.monotonically_increasing_id())
    same = staged(same, "vector-classes")
    tables = Tables.planned(same.count(), least)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("embedding").value_lengths())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                keys = tables.buckets(unit(matrix(part.column("embedding"))))
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("class").to_numpy(), tables.tables)), pa.array(np.tile(np.arange(tables.tables, dtype=np.int32), n)), pa.array(keys.ravel().view(np.int64))],
                    names=["class", "table", "bucket"],
                )

    keyed = staged(same.select("class", "embedding").mapInArrow(bucket, "class long, table int, bucket long"), "vector-buckets")
    full = keyed.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    # A large bucket is dealt to parts; every two parts meet in a block of their own.
    parts = F.ceil(F.col("n") / BLOCK)
    part = F.pmod(F.xxhash64("class", "table"), F.col("parts")).cast("int")
    dealt = keyed.join(full.withColumn("parts", parts), ["table", "bucket"]).withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))
    dealt = dealt.withColumn("other", other).select(
        "class", "table", "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    # Rows of a block's own part also meet those of the other part, but not each other there.
    blocks = dealt.join(same.select("class", "copies", "embedding"), "class")
    block = ["table", "bucket", "low", "high"]
    blocks = blocks.repartition(*block).sortWithinPartitions(*block)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finish() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x, ids = unit(matrix(t.column("embedding").chunk(0))), t.column("class").to_numpy()
            counts, a, b = _block_links(x, ids, t.column("side").to_numpy(), t.column("copies").to_numpy(), now[0], tables, least)
            some = counts > 0
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[some], a])), pa.array(np.concatenate([np.full(some.sum(), -1), b])), pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)]))],
                names=["a", "b", "n"],
            )

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in block)))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if keys[i] != now and held:
                    yield finish()
                    held = []
                now = keys[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield finish()

    found = staged(blocks.mapInArrow(link, "a long, b long, n long"), "vector-links")
    component = components(found.where("b >= 0").select("a", "b"))
    links = found.where("b < 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    member = same.select("class", "node", "copies", "embedding").join(links, "class", "left").join(component.withColumnRenamed("node", "class"), "class", "left")
    member = member.withColumn("component", F.coalesce("component", "class"))
    least_id = member.groupBy("component").agg(F.min("node").alias("component_id"))
    member = member.join(least_id, "component").select("embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("usable").select("vec_id", "embedding").join(member, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    whole = linked.unionByName(alone)
    whole = whole.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.col("component_id")))
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
