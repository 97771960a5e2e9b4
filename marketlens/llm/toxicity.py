"""Toxicity by two class-conditional Kneser-Ney models of characters.

Four-grams of 32 symbols (letters, a blank for all else, five classes of non-ASCII bytes) are counted per class over all
learnable rows. Each class discounts its own counts and backs off to continuation counts that both classes
share, so rare expressions weigh the same in both. A text's score is the difference of the two log-likelihoods per symbol, put on 0 to 1 by a
logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.texts import chunked, fold, held_out, small_batches
from marketlens.sources.scratch import staged

ORDER, SYMBOLS, BITS = 4, 32, 5
GRAMS = SYMBOLS**ORDER  # a model is one number for each: 4 MB
DISCOUNT = 0.75
#: Labelled rows the logistic curve is fitted on, at most.
CALIBRATION_ROWS = 20_000

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 5


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray  # log of toxic over ordinary likelihood of each four-gram's last symbol
    slope: float
    offset: float


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, four-gram codes, their offsets by row); runs of blanks count as one."""
    lower = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    for first, last, data, offsets in chunked(lower):
        symbols = _SYMBOL[data]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
        starts = offsets[:-1][np.diff(offsets) > 0]
        keep[starts] = True
        kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
        symbols = symbols[keep].astype(np.int32)
        n = len(symbols) - ORDER + 1
        if n < 1:
            yield first, last, np.zeros(0, np.int32), np.zeros(last - first + 1, np.int64)
            continue
        code = np.zeros(n, np.int32)
        for k in range(ORDER):
            code = (code << BITS) | symbols[k : k + n]
        row = np.repeat(np.arange(last - first), np.diff(kept))
        inside = row[:n] == row[ORDER - 1 :]
        yield first, last, code[inside], np.searchsorted(row[:n][inside], np.arange(last - first + 1))


def learn(counts: np.ndarray) -> np.ndarray:
    """Log ratios of all four-grams from counts of shape (2, GRAMS): ordinary, toxic."""

    def discounted(n: np.ndarray, below: np.ndarray) -> np.ndarray:
        n = n.reshape(-1, SYMBOLS).astype(np.float64)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        below = np.tile(below.reshape(-1, SYMBOLS), (len(n) // (below.size // SYMBOLS), 1))
        own = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * below) / np.maximum(total, 1)
        return np.where(total > 0, own, below).ravel()

    shared = [(counts.sum(axis=0) > 0).astype(np.int64)]
    for order in range(ORDER - 1, 0, -1):  # how many symbols come before each shorter gram
        shared.append((shared[-1] if order == ORDER - 1 else (shared[-1] > 0).astype(np.int64)).reshape(SYMBOLS, -1).sum(axis=0))
    below = (shared[-1] + 1.0) / (shared[-1].sum() + SYMBOLS)
    for order in range(2, ORDER):
        below = discounted(shared[ORDER - order], below)
    ordinary, toxic = (np.log(np.maximum(discounted(c, below), 1e-12)) for c in counts)
    return (toxic - ordinary).astype(np.float32)


def _counts(rows: DataFrame) -> DataFrame:
    """(part, toxic, code, n) over all rows; each task sums up what it reads before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            part, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "toxic"))
            for first, last, codes, cuts in grams(batch.column("text")):
                kind = np.repeat(part[first:last] * 2 + toxic[first:last], np.diff(cuts))
                for k in np.unique(kind):
                    key = (int(k) // 2, int(k) % 2)
                    total.setdefault(key, np.zeros(GRAMS, np.int64))
                    total[key] += np.bincount(codes[kind == k], minlength=GRAMS)
        for (part, toxic), n in total.items():
            code = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), part, np.int32)), pa.array(np.full(len(code), toxic, np.int32)), pa.array(code.astype(np.int32)), pa.array(n[code])], names=["part", "toxic", "code", "n"])

    found = rows.mapInArrow(run, "part int, toxic int, code int, n long")
    return found.groupBy("part", "toxic", "code").agg(F.sum("n").alias("n"))


def _ratio(codes: np.ndarray, cuts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(ratios[codes], dtype=np.float64)])[cuts]
    return np.diff(total) / np.maximum(np.diff(cuts), 1)


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps with a small ridge; a constant where one class is missing."""
    if not len(x) or y.min() == y.max():
        return 0.0, float(-4 if not len(x) or y.max() == 0 else 4)
    centre, spread = x.mean(), max(float(x.std()), 1e-9)
    z, w = np.stack([(x - centre) / spread, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, z.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all rows with a label that are not held out.

    The curve is fitted on ratios of one part of these rows under counts of the others, so that it
    meets texts that the counts have not seen; the model itself has the counts of all.
    """
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # One kind of join at every size: the texts that can be learned from are shuffled once, the labels never broadcast.
    rows = small_batches(docs).select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(marks.hint("merge"), "doc_id").select("doc_id", "text", "toxic", (fold(F.col("doc_id")) == 4).cast("int").alias("part"))
    rows = staged(rows, "toxic-learn")
    found = staged(_counts(rows), "toxic-counts").toPandas()  # 4 x GRAMS rows at most
    counts = np.zeros((2, 2, GRAMS), np.int64)
    counts[found["part"], found["toxic"], found["code"]] = found["n"]
    ratios = learn(counts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros(batch.num_rows)
            for first, last, codes, cuts in grams(batch.column("text")):
                x[first:last] = _ratio(codes, cuts, ratios)
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column("toxic")], names=["x", "toxic"])

    some = rows.where("part = 1").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "toxic").limit(CALIBRATION_ROWS)
    tried = rows.where("part = 1").join(staged(some.select("doc_id"), "toxic-curve"), "doc_id", "left_semi").select("text", "toxic")
    seen = tried.mapInArrow(run, "x double, toxic int").toPandas().sort_values(["x", "toxic"])
    slope, offset = _fitted(seen["x"].to_numpy(), seen["toxic"].to_numpy())
    return Model(learn(counts.sum(axis=0)), slope, offset)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to each row.

    A text that is null, empty or without a four-gram has a ratio of 0 and the score that goes with it. Rows that repeat
    score alike, an empty table gives an empty result, and columns of these names are replaced.
    """
    df = small_batches(docs.drop("score", "predicted"))
    schema = df.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros(batch.num_rows)
            for first, last, codes, cuts in grams(batch.column(text)):
                x[first:last] = _ratio(codes, cuts, model.ratios)
            p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return df.mapInArrow(run, schema)
