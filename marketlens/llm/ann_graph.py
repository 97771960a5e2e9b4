"""Approximate nearest neighbours by inner product, over robust-pruned directed graphs.

The vectors are dealt to shards. A shard's graph is built by inserting points in growing batches: a greedy search over the graph
so far proposes neighbours, and robust pruning keeps those that no kept neighbour is closer to by the factor `ALPHA`. Queries run
a beam search in every shard; their best are scored again in double precision and merged. A component that
fills all vectors up to one length turns the inner product into a distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.texts import small_batches
from marketlens.llm.vectors import matrix, usable

NEAREST = 20
SHARDS, SHARD_ROWS = 6, 100_000
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 128, 1.2
_QUERIES = 256


class Graph:
    """A graph over distinct points; `ids` are the vectors' ids of each point, ascending."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> None:
        self.degree, self.alpha = degree, alpha
        lengths = np.einsum("ij,ij->i", x, x)
        self.x = np.concatenate([x, np.sqrt(np.maximum(lengths.max(initial=0) - lengths, 0))[:, None]], axis=1).astype(np.float32)
        self.squares = np.einsum("ij,ij->i", self.x, self.x)
        n = len(x)
        self.near = np.full((n, degree), -1, np.int32)
        self.enter = int(np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
        order = np.random.default_rng(0).permutation(n)
        order = np.concatenate([[self.enter], order[order != self.enter]]).astype(np.int64) if n else order
        done = 1
        while done < n:
            for new in np.array_split(order[done : min(n, 2 * done)], max(1, -(-min(done, n - done) // 512))):
                ids, _, _ = self.search(self.x[new], beam)
                self._insert(new, ids)
            done = min(n, 2 * done)

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each row of q to its own row of points; infinite where there is none."""
        d = self.squares[ids] - 2 * np.einsum("ijk,ik->ij", self.x[ids], q) + np.einsum("ij,ij->i", q, q)[:, None]
        return np.where(ids >= 0, np.maximum(d, 0), np.inf)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(points, distances, steps): the beam of each query, nearest first; -1 fills up."""
        m, n = len(q), len(self.x)
        rows = np.arange(m)
        ids = np.full((m, beam), -1, np.int64)
        ids[:, 0] = self.enter
        dist = np.full((m, beam), np.inf, np.float32)
        dist[:, 0] = self._distances(q, ids[:, :1])[:, 0]
        opened = np.ones((m, beam), bool)
        opened[:, 0] = False
        seen = np.zeros((m, n), bool)
        seen[:, self.enter] = True
        steps = 0
        live = rows
        while len(live):
            at = np.argmin(opened[live], axis=1)  # the nearest point that is not opened
            going = ~opened[live, at]
            live, at = live[going], at[going]
            if not len(live):
                break
            steps += 1
            opened[live, at] = True
            found = self.near[ids[live, at]].astype(np.int64)
            known = seen[live[:, None], np.maximum(found, 0)] | (found < 0)
            found = np.where(known, -1, found)
            r, c = np.nonzero(found >= 0)
            seen[live[r], found[r, c]] = True
            d = self._distances(q[live], found).astype(np.float32)
            all_ids = np.concatenate([ids[live], found], axis=1)
            all_d = np.concatenate([dist[live], d], axis=1)
            all_open = np.concatenate([opened[live], found < 0], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            dist[live] = np.take_along_axis(all_d, best, 1)
            opened[live] = np.take_along_axis(all_open, best, 1) | (ids[live] < 0)
        return ids, dist, steps

    def _prune(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Robust pruning: up to `degree` of each row's candidates, near ones first, that are spread out."""
        ids = np.where(ids == points[:, None], -1, ids)
        d = self._distances(self.x[points], ids)
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        alive = ids >= 0
        alive[:, 1:] &= ~((ids[:, 1:] == ids[:, :-1]) & (ids[:, 1:] >= 0))
        x = self.x[np.maximum(ids, 0)]
        out = np.full((len(points), self.degree), -1, np.int32)
        rows = np.arange(len(points))
        for k in range(self.degree):
            pick = np.argmax(alive, axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[some, k] = ids[rows, pick][some]
            alive[rows, pick] = False
            chosen = x[rows, pick]
            apart = self.squares[np.maximum(ids, 0)] - 2 * np.einsum("ijk,ik->ij", x, chosen) + np.einsum("ij,ij->i", chosen, chosen)[:, None]
            alive &= ~((self.alpha**2 * np.maximum(apart, 0) <= d) & some[:, None])
        return out

    def _insert(self, new: np.ndarray, candidates: np.ndarray) -> None:
        self.near[new] = self._prune(new, candidates)
        # Edges back; a point with too many is pruned again.
        r, c = np.nonzero(self.near[new] >= 0)
        target, source = self.near[new][r, c].astype(np.int64), new[r]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        points, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        extra = np.full((len(points), width), -1, np.int64)
        extra[np.repeat(np.arange(len(points)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate([self.near[points].astype(np.int64), extra], axis=1)
        fits = (both >= 0).sum(axis=1) <= self.degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        self.near[points[fits]] = packed[fits][:, : self.degree]
        rest = np.flatnonzero(~fits)
        for some in np.array_split(rest, max(1, len(rest) // 512)):
            if len(some):
                self.near[points[some]] = self._prune(points[some], both[some])

    def nearest(self, q: np.ndarray, beam: int) -> np.ndarray:
        """The beam's points for each query. A graph no larger than the beam is looked through as a whole."""
        if len(self.x) <= beam:
            return np.tile(np.arange(len(self.x)), (len(q), 1))
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        return self.search(q, beam)[0]


class Shard:
    """The distinct vectors of a shard, their ids and their graph."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.x, of = np.unique(x[order], axis=0, return_inverse=True)
        by = np.argsort(of.ravel(), kind="stable")
        self.ids, self.cuts = ids[order][by], np.searchsorted(of.ravel()[by], np.arange(len(self.x) + 1))
        self.graph = Graph(self.x)

    def best(self, queries: np.ndarray, q: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        for first in range(0, len(q), _QUERIES):
            part = q[first : first + _QUERIES]
            for query, v, points in zip(queries[first : first + _QUERIES], part, self.graph.nearest(part, beam)):
                points = points[points >= 0]
                scores = (self.x[points] * v).sum(axis=1)
                found = 0
                order = np.lexsort((self.ids[self.cuts[points]], -scores))
                out = []
                for p in order:
                    # Points of one score may interleave their ids, so a score is finished before stopping.
                    if found >= k and out and scores[p] < out[-1][1]:
                        break
                    ids = self.ids[self.cuts[points[p]] : self.cuts[points[p] + 1]][: k + 1]
                    own = ids[ids != query][:k]
                    out += [(int(i), float(scores[p])) for i in own]
                    found += len(own)
                out.sort(key=lambda r: (-r[1], r[0]))
                for i, score in out[:k]:
                    yield int(query), i, score


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, shards: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each row of `queries`.

    Both tables have vec_id and embedding. Vectors that are null, empty, zero or hold null or non-finite components take no part, and neither do
    rows without an id. A query meets only vectors of its own length and never rows of its own id. Rows that repeat a
    vec_id are candidates once, by their least vector, and one query. Ties go to the smaller id. Equal vectors are one point
    of a graph. Empty tables give an empty result.
    """
    slim = lambda t: t.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    one = lambda t: slim(t).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("size", F.size("embedding"))
    base, asked = one(small_batches(vectors)), one(queries)
    if shards is None:
        shards = max(SHARDS, -(-vectors.count() // SHARD_ROWS))
    kept = base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("kind", F.lit(0))
    asking = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("kind", F.lit(1))
    # A shard's vectors come first, so its queries stream past the finished graph.
    rows = kept.unionByName(asking).repartition(shards, "size", "shard").sortWithinPartitions("size", "shard", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, ready = None, [], [], None
        for batch in batches:
            size, shard, kind = (batch.column(c).to_numpy() for c in ("size", "shard", "kind"))
            cuts = np.flatnonzero((np.diff(size) != 0) | (np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(size)]):
                if i == j:
                    continue
                piece = batch.slice(i, j - i)
                own, x = piece.column("vec_id").to_numpy(), matrix(piece.column("embedding"))
                if (size[i], shard[i]) != now:
                    now, ids, parts, ready = (size[i], shard[i]), [], [], None
                if kind[i] == 0:
                    ids.append(own)
                    parts.append(x)
                    continue
                if not ids:
                    continue
                ready = ready or Shard(np.concatenate(ids), np.concatenate(parts))
                found = list(ready.best(own, x, k, beam))
                a, b, s = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
