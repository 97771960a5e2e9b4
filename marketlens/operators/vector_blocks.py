"""Exact nearest vectors for many queries: corpus blocks of near vectors, most of which a query can skip.

The corpus is dealt to a bounded number of centres. Angles between unit vectors are a metric, so nothing in a cluster is nearer to a
query than the angle to its centre less the cluster's radius. Each query first meets the block that
holds its own cluster; its k-th score there is written down, and a second round scores it only with the blocks that have a cluster which
can still reach that score. The centres are fitted on a sample; they decide what is skipped, never what is found.

The second round sends rows by tiles, runs of neighbouring blocks, so that a vector is copied once per tile and not once per block. In a
tile single precision sorts out what cannot reach a query's k-th score, which rises as the tile is gone through; the rest is scored in double.
Where vectors are too far apart for blocks to be skipped the products stay quadratic; rows sent and groups are fewer by the square of a tile's size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.ranked import top_k
from marketlens.sources.scratch import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HITS = "query_id long, vec_id long, score double"
SCORED_ROWS = 1024
# Centres at most, and the rows each is fitted on.
CENTRES, ROWS_PER_CENTRE, FIT_STEPS = 1024, 4, 4
# Scores are compared after rounding to 6 digits; an angle near 0 has half the digits of its cosine.
SCORE_SLACK, ANGLE_SLACK = 2e-6, 1e-7
# Tiles are as large as that many doubles, and smaller while there are few groups for each core.
TILE_BYTES, GROUPS_PER_CORE = 32 << 20, 4
# Partitions for each group, so that few share one, up to a number for each core.
PARTITIONS_PER_GROUP, PARTITIONS_PER_CORE = 4, 32


def unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def best(query_ids: np.ndarray, queries: np.ndarray, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of some vectors for each query, ties by id."""
    matrix, ids = unit_rows(found["embedding"]), found["vec_id"].to_numpy()
    parts = []
    for at in range(0, len(ids), SCORED_ROWS):
        scores = np.round(queries @ matrix[at:at + SCORED_ROWS].T, 6)
        if scores.shape[1] > k:
            # Everything that ties with the k-th score stays in until the ids decide.
            least = np.partition(scores, -k, axis=1)[:, [-k]]
            asked, hit = np.nonzero(scores >= least)
        else:
            asked, hit = np.nonzero(np.ones(scores.shape, dtype=bool))
        parts.append(pd.DataFrame({
            "query_id": query_ids[asked], "vec_id": ids[at + hit], "score": scores[asked, hit],
        }))
    return merge(parts, k)


def merge(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    both = pd.concat(parts).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return both.groupby("query_id").head(k)


@dataclass
class Layout:
    """Clusters with their size and radius, the run of blocks that each one's rows are dealt to, and the number of blocks in a tile."""

    centres: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    run: int

    def shared(self, spark: SparkSession) -> Broadcast[tuple]:
        """Its values for the tasks, CENTRES rows at most; plain ones, since a broadcast names the class by a module that workers may not have."""
        return spark.sparkContext.broadcast((self.centres, self.sizes, self.radius, self.first, self.parts, self.run))

    def angles(self, queries: np.ndarray) -> np.ndarray:
        return np.where(self.sizes > 0, np.arccos(np.clip(queries @ self.centres.T, -1, 1)), np.inf)

    def reach(self, angles: np.ndarray) -> np.ndarray:
        """What no score of a query with a row of a cluster is above."""
        return np.where(self.sizes > 0, np.cos(np.clip(angles - self.radius - ANGLE_SLACK, 0, np.pi)), -np.inf)

    def members(self) -> np.ndarray:
        """Clusters by tiles: 1 where the cluster has rows in the tile."""
        low, high = self.first // self.run, (self.first + self.parts - 1) // self.run
        tiles = np.arange(high.max() + 1)
        return ((low[:, None] <= tiles) & (tiles <= high[:, None])).astype(np.float32)

    def clusters(self, blocks: np.ndarray) -> Layout:
        """The part of the layout that has rows in the blocks, which are in order."""
        inside = np.searchsorted(blocks, self.first) < np.searchsorted(blocks, self.first + self.parts)
        return Layout(*[x[inside] for x in (self.centres, self.sizes, self.radius, self.first, self.parts)], self.run)


def fit_centres(corpus: DataFrame, count: int) -> np.ndarray:
    """Unit centres, by a few steps of k-means on a bounded sample; each stands beside its nearest in the order."""
    rows = corpus.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ROWS_PER_CENTRE * count).select("embedding").toPandas()
    points = unit_rows(rows["embedding"])
    centres = points[:count].copy()
    for _ in range(FIT_STEPS):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        norms = np.linalg.norm(sums, axis=1)
        moved = norms > 0
        centres[moved] = sums[moved] / norms[moved, None]
    order, left = [0], np.ones(len(centres), dtype=bool)
    left[0] = False
    while left.any():
        near = np.where(left, centres @ centres[order[-1]], -np.inf)
        order.append(int(near.argmax()))
        left[order[-1]] = False
    return centres[order]


def _placed(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """Vectors with their nearest centre and the angle to it, written once."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)  # CENTRES rows at most
    schema = T.StructType([*corpus.schema.fields, *T._parse_datatype_string("cluster int, angle double").fields])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SCORED_ROWS):
                part = batch.iloc[at:at + SCORED_ROWS]
                near = unit_rows(part["embedding"]) @ shared.value.T
                cluster = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(part)), cluster], -1, 1))
                yield part.assign(cluster=cluster.astype(np.int32), angle=angle)

    return staged(corpus.mapInPandas(place, schema), "placed-vectors")


def _layout(placed: DataFrame, centres: np.ndarray, block: int, run: int) -> Layout:
    """Neighbouring clusters share a block while they fit; a larger cluster is dealt to blocks of its own."""
    n = len(centres)
    sizes, radius = np.zeros(n, np.int64), np.zeros(n)
    for cluster, size, angle in placed.groupBy("cluster").agg(F.count(F.lit(1)), F.max("angle")).collect():  # CENTRES rows at most
        sizes[cluster], radius[cluster] = size, angle
    first, parts = np.zeros(n, np.int64), np.ones(n, np.int64)
    current, room = -1, 0
    for c in range(n):
        if sizes[c] > block:
            parts[c] = -(-sizes[c] // block)
            first[c] = current + 1
            current, room = current + parts[c], 0
            continue
        if current < 0 or sizes[c] > room:
            current, room = current + 1, block
        first[c] = current
        room -= sizes[c]
    return Layout(centres, sizes, radius, first, parts, run)


def _routed(queries: DataFrame, layout: Layout, second: bool) -> DataFrame:
    """The queries with their home block, or in the second round (`bound` is the k-th score so far) once for each tile they need, with its number."""
    shared = layout.shared(queries.sparkSession)
    made = T.StructField("tile", T.ArrayType(T.LongType())) if second else T.StructField("block", T.LongType())
    schema = T.StructType([*queries.schema.fields, made])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = Layout(*shared.value)
        members = plan.members()
        for batch in batches:
            for at in range(0, len(batch), SCORED_ROWS):
                part = batch.iloc[at:at + SCORED_ROWS]
                angles = plan.angles(unit_rows(part["embedding"]))
                if second:
                    near = plan.reach(angles) >= part["bound"].to_numpy()[:, None] - SCORE_SLACK
                    met = near.astype(np.float32) @ members > 0
                    yield part.assign(tile=[np.flatnonzero(row) for row in met])
                else:
                    yield part.assign(block=plan.first[angles.argmin(axis=1)])

    routed = queries.mapInPandas(route, schema)
    return staged(routed, "routed-queries").withColumn("tile", F.explode("tile")) if second else routed


def _met(asked: DataFrame, found: DataFrame, key: str, most: int, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Hits of the queries and rows that share a key. Queries of a key are dealt to slices of about `most`."""
    slices = staged(asked.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).alias("slices")), "slices")
    groups = slices.agg(F.sum("slices")).first()[0] or 1
    left = asked.join(slices, key).withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices"))).drop("slices")
    right = found.join(slices, key).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    # A group's work is in its products, of which its bytes tell nothing: the partitions are not merged by size.
    partitions = min(PARTITIONS_PER_GROUP * groups, PARTITIONS_PER_CORE * asked.sparkSession.sparkContext.defaultParallelism)
    left, right = (df.repartition(partitions, key, "slice").groupBy(key, "slice") for df in (left, right))

    def hits(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or found.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return score(asked, found)

    return left.cogroup(right).applyInPandas(hits, HITS)


class Nearest:
    """The k nearest so far of some queries. `bound` is the k-th score, below which nothing is looked at."""

    def __init__(self, queries: np.ndarray, bound: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.bound, self.rows, self.ids, self.k = queries, bound.copy(), rows, ids, k
        self.asked, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting, self.count = [], 0

    def add(self, asked: np.ndarray, row: np.ndarray) -> None:
        self.waiting.append((asked, row))
        self.count += len(asked)
        if self.count > 2 * self.k * len(self.queries):
            self.settle()

    def settle(self) -> None:
        asked, row = (np.concatenate(x) for x in zip((self.asked[:0], self.row[:0]), *self.waiting))
        score, most = np.zeros(len(asked)), max(1, TILE_BYTES // (8 * max(self.rows.shape[1], 1)))
        for at in range(0, len(asked), most):
            some = slice(at, at + most)
            score[some] = np.round(np.einsum("ij,ij->i", self.queries[asked[some]], self.rows[row[some]]), 6)
        good = score >= self.bound[asked]
        asked, row, score = (np.concatenate(x) for x in ((self.asked, asked[good]), (self.row, row[good]), (self.score, score[good])))
        order = np.lexsort((self.ids[row], -score, asked))
        asked, row, score = asked[order], row[order], score[order]
        place = np.arange(len(asked)) - np.searchsorted(asked, asked)
        last = place == self.k - 1
        self.bound[asked[last]] = np.maximum(self.bound[asked[last]], score[last])
        self.asked, self.row, self.score = asked[place < self.k], row[place < self.k], score[place < self.k]
        self.waiting, self.count = [], 0


def first_copies(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of equal vectors the k of the smallest ids, since no query has others among its k nearest; in the order of their blocks."""
    found = found.sort_values("vec_id")
    copy = found.groupby([v.tobytes() for v in found["embedding"]]).cumcount()
    return found[(copy < k).to_numpy()].sort_values("block", kind="stable")


def best_of_tile(layout: Layout, asked: pd.DataFrame, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query its k nearest of a tile as far as they reach its bound."""
    found = first_copies(found, k)
    rows, ids = unit_rows(found["embedding"]), found["vec_id"].to_numpy()
    blocks, starts = np.unique(found["block"].to_numpy(), return_index=True)
    plan, single = layout.clusters(blocks), rows.astype(np.float32)
    # Both vectors and each step of the sum are rounded to 24 bits; the products' absolute values add up to 1 at most.
    slack = SCORE_SLACK + (rows.shape[1] + 8) * 2.0**-23
    parts = []
    for at in range(0, len(asked), SCORED_ROWS):
        part = asked.iloc[at:at + SCORED_ROWS]
        queries = unit_rows(part["embedding"])
        near, rough = plan.reach(plan.angles(queries)), queries.astype(np.float32)
        nearest = Nearest(queries, part["bound"].to_numpy(), rows, ids, k)
        for block, start, end in zip(blocks, starts, [*starts[1:], len(ids)]):
            reach = near[:, (plan.first <= block) & (block < plan.first + plan.parts)].max(axis=1)
            for low in range(start, end, SCORED_ROWS):
                who = np.flatnonzero(reach >= nearest.bound - SCORE_SLACK)
                if len(who):
                    chosen = rough if len(who) == len(rough) else rough[who]
                    scores = chosen @ single[low:min(low + SCORED_ROWS, end)].T
                    good = scores >= (nearest.bound[who] - slack).astype(np.float32)[:, None]
                    if scores.shape[1] > k and np.count_nonzero(good) > 4 * k * len(who):
                        # k of these rows are not below the k-th rough score by more than its error.
                        good &= scores >= np.partition(scores, -k, axis=1)[:, [-k]] - np.float32(2 * slack)
                    hit, row = np.nonzero(good)
                    nearest.add(who[hit], low + row)
        nearest.settle()
        parts.append(pd.DataFrame({
            "query_id": part["query_id"].to_numpy()[nearest.asked], "vec_id": ids[nearest.row], "score": nearest.score,
        }))
    return pd.concat(parts)


@dataclass
class Plan:
    """The two rounds: what meets in each, and the hits of the first."""

    layout: Layout
    rows: int
    blocks: DataFrame
    home: DataFrame
    hits: DataFrame
    rest: DataFrame


def tile_rows(spark: SparkSession, count: int, width: int) -> int:
    """Rows of a tile: few enough that tiles by tiles make work for all cores, and that a task holds them."""
    even = count / (GROUPS_PER_CORE * spark.sparkContext.defaultParallelism) ** 0.5
    return int(max(1, min(max(even, SCORED_ROWS), TILE_BYTES / (8 * max(width, 1)))))


def plan_rounds(queries: DataFrame, corpus: DataFrame, k: int, block: int) -> Plan:
    corpus = corpus.select("vec_id", "embedding")
    count = corpus.count()
    centres = fit_centres(corpus, int(min(max(count ** 0.5, 1), CENTRES)))
    placed = _placed(corpus, centres)
    rows = max(block, tile_rows(corpus.sparkSession, count, centres.shape[1]))
    layout = _layout(placed, centres, block, rows // block)
    dealt_to = [(c, int(f), int(p)) for c, (f, p) in enumerate(zip(layout.first, layout.parts))]
    homes = corpus.sparkSession.createDataFrame(dealt_to, "cluster int, first long, parts long")  # CENTRES rows at most
    dealt = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    blocks = placed.join(F.broadcast(homes), "cluster").select("vec_id", "embedding", dealt.alias("block"))
    home = _routed(queries, layout, second=False)
    hits = staged(_met(home, blocks, "block", block, lambda asked, found: best(
        asked["query_id"].to_numpy(), unit_rows(asked["embedding"]), found, k)), "home-hits")
    bounds = top_k(hits, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("bound"))
    asked = queries.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    return Plan(layout, rows, blocks, home, hits, _routed(asked, layout, second=True))


def topk_blocks(queries: DataFrame, corpus: DataFrame, k: int, block: int) -> DataFrame:
    """At most k hits per row of the queries and tile it met; among them are its k nearest."""
    if corpus.isEmpty():
        return corpus.sparkSession.createDataFrame([], HITS)
    plan = plan_rounds(queries, corpus, k, block)
    tiles = plan.blocks.withColumn("tile", F.floor(F.col("block") / plan.layout.run))
    shared = plan.layout.shared(corpus.sparkSession)
    # The second round meets the home block again, so its hits replace those of the first.
    return _met(plan.rest, tiles, "tile", plan.rows, lambda asked, found: best_of_tile(Layout(*shared.value), asked, found, k))
