"""Language of a text by the nearest of several centroids per language.

Vectors are hashed byte n-grams of the letters, weighted by TF-IDF and normalised. Document frequencies
come from all learnable rows. The centroids are fitted on at most `sample` rows per language (a documented bound).
A text whose cosine with its nearest centroid falls below that centroid's limit counts as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.texts import buffers, held_out, small_batches
from marketlens.sources.scratch import staged

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 1000
CENTROIDS_PER_LANGUAGE = 3
#: One centroid takes 16 kB, so a model is never above 50 MB.
MOST_LANGUAGES = 1000
#: A text is rejected below REJECT_SHARE of the cosine that all but LOW_QUANTILE of the sampled rows of its centroid have.
REJECT_SHARE, LOW_QUANTILE = 0.3, 0.01
#: Runs of the clustering, the least share of a language's rows that a centroid has, and shares of a hot language.
STARTS, LEAST_SHARE, SHARES = 4, 0.05, 64
UNKNOWN = "und"
_TEXTS, _BYTES = 256, 1 << 20

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Centroids:
    languages: np.ndarray  # of each centroid
    matrix: np.ndarray  # (centroids, DIMENSIONS), rows of length 1
    limits: np.ndarray  # least cosine that is not rejected
    weights: np.ndarray  # inverse document frequencies


def gram_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, counts of hashed 2- and 3-grams) over runs of rows."""
    data, offsets = buffers(pc.utf8_lower(column.fill_null("")))
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, min(first + _TEXTS, int(np.searchsorted(offsets, offsets[first] + _BYTES, "right")) - 1))
        at = offsets[first : last + 1] - offsets[first]
        letters = _LETTER[data[offsets[first] : offsets[last]]].astype(np.uint32)
        row = np.repeat(np.arange(last - first, dtype=np.int64), np.diff(at))
        counts = np.zeros((last - first) * DIMENSIONS, np.int64)
        for width in (2, 3):
            m = len(letters) - width + 1
            if m < 1:
                continue
            code, blank = np.zeros(m, np.uint32), np.ones(m, bool)
            for k in range(width):
                code = (code << np.uint32(8)) | letters[k : k + m]
                blank &= letters[k : k + m] == 32
            slot = ((code + np.uint32(width)) * np.uint32(2654435761)) >> np.uint32(20)
            good = (row[:m] == row[width - 1 :]) & ~blank
            counts += np.bincount(row[:m][good] * DIMENSIONS + slot[good], minlength=len(counts))
        yield first, last, counts.reshape(-1, DIMENSIONS)
        first = last


def normalised(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * weights.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spread_rows(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k rows drawn one after the other, each with a chance that grows with its distance from those drawn before."""
    chosen = [int(draw.integers(len(x)))]
    while len(chosen) < min(k, len(x)):
        away = np.clip(1 - (x @ x[chosen].T).max(axis=1), 0, None).astype(np.float64)
        if away.sum() < 1e-9:
            break
        chosen.append(int(draw.choice(len(x), p=away / away.sum())))
    return x[chosen]


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, the centroid of each row), by cosine: the best of STARTS runs from weighted random rows, with a fixed seed.

    A centroid with less than LEAST_SHARE of the rows is dropped and its rows go to the others.
    """
    best, draw = None, np.random.default_rng(len(x))
    for _ in range(STARTS):
        centres = _spread_rows(x, k, draw).copy()
        for step in range(rounds):
            own = np.argmax(x @ centres.T, axis=1)
            held = np.bincount(own, minlength=len(centres))
            if step and held.min() < LEAST_SHARE * len(x) and len(centres) > 1:
                centres = np.delete(centres, held.argmin(), axis=0)
                continue
            for j in np.flatnonzero(held):
                mean = x[own == j].mean(axis=0)
                centres[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
        near = x @ centres.T
        found = (float(near.max(axis=1).mean()), centres, np.argmax(near, axis=1))
        best = found if best is None or found[0] > best[0] else best
    return best[1], best[2]


def _first_of_language(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows of each language in an order, with their `place`; a hot language is dealt to shares, ranked one by one, before."""
    share = F.pmod(F.xxhash64(*order), F.lit(SHARES))
    some = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("place") <= most)
    return some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= most)


def fit(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS_PER_LANGUAGE) -> Centroids:
    """Learn from the text and lang of rows that are not held out; rows without a language or a letter are left out."""
    rows = small_batches(docs).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).where(F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for first, last, counts in gram_counts(batch.column("text")):
                total += (counts > 0).sum(axis=0)
                n += last - first
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[n], total]))], names=["slot", "n"])

    parts = rows.select("text").mapInArrow(frequencies, "slot long, n long")
    seen = {r["slot"]: r["n"] for r in parts.groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # DIMENSIONS + 1 rows at most
    weights = np.log((1 + seen.get(-1, 0)) / (1 + np.array([seen.get(i, 0) for i in range(DIMENSIONS)]))) + 1

    ids = rows.select("doc_id", "lang").distinct()
    chosen = staged(_first_of_language(ids, [F.xxhash64("doc_id"), F.col("doc_id")], sample).select("doc_id", "lang"), "language-sample")
    if (languages := chosen.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; a model holds {MOST_LANGUAGES} at most")
    if not languages:
        return Centroids(np.zeros(0, object), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), weights)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, counts in gram_counts(batch.column("text")):
                x = normalised(counts, weights)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIMENSIONS).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(first, last - first), batch.column("place").slice(first, last - first), flat], names=["lang", "place", "x"])

    # Rows that repeat an id come along, so the bound is applied again; each task sends on `sample` rows at most.
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    rows = _first_of_language(rows, [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")], sample).select("lang", "place", "text")

    def means(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group.sort_values("place")["x"].to_numpy())
        centres, own = spherical_means(x, k)
        used = [j for j in range(len(centres)) if (own == j).any()]
        least = [float(np.quantile(x[own == j] @ centres[j], LOW_QUANTILE)) * REJECT_SHARE for j in used]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "part": used, "least": least, "x": [centres[j] for j in used]})

    found = rows.mapInArrow(vectors, "lang string, place int, x array<float>").groupBy("lang").applyInPandas(means, "lang string, part int, least double, x array<float>")
    model = sorted(found.collect(), key=lambda r: (r["lang"], r["part"]))  # bounded by MOST_LANGUAGES and k
    return Centroids(np.array([r["lang"] for r in model], object), np.array([r["x"] for r in model], np.float32), np.array([r["least"] for r in model]), weights)


def predict(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Add lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected to each row.

    A text that is null, empty or without a letter gets `und`, score 0 and is rejected. Equally near
    languages go to the first by code point. Columns of the input with these names are replaced.
    """
    made = ("lang_pred", "score", "rejected")
    df = small_batches(docs.drop(*made))
    lettered = "llm_has_letter"
    schema = df.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "rejected": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(lettered).to_numpy(zero_copy_only=False)
            names, scores, rejected = np.full(len(has), UNKNOWN, object), np.zeros(len(has)), np.ones(len(has), bool)
            if len(model.languages):
                for first, last, counts in gram_counts(batch.column(text)):
                    cosine = normalised(counts, model.weights) @ model.matrix.T
                    best = np.argmax(cosine, axis=1)
                    top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                    ok = has[first:last]
                    names[first:last] = np.where(ok, model.languages[best], UNKNOWN)
                    scores[first:last] = np.where(ok, top, 0)
                    rejected[first:last] = ~ok | (top < model.limits[best])
            kept = [c for c in batch.schema.names if c != lettered]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=[*kept, *made]
            )

    return df.withColumn(lettered, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
