"""Importance resampling towards a target corpus by hashed n-grams.

Separators are collapsed to single spaces. One pattern per n, scanned with overlapping matches over pieces of whole words, then finds
every run of n words between two boundaries, and the bytes of each span are counted in their CRC-32 bucket. A bucket's gain compares its
share in the target with its share in the corpus; a document's weight is the sum over its features. Gumbel noise that
depends on the id alone turns the weights into a draw without replacement: the documents with the largest sums are taken.

The texts are read twice: once for the counts of all buckets, once for the weights. What tasks get is a table of
one whole number per bucket, whose size is a parameter. The draw numbers only ids and scores, by ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.texts import give_back, small_batches
from marketlens.operators.ordered import numbered
from marketlens.sources.scratch import staged

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10000, 1, 20, 10, 2024
#: Features of a text that are looked at at once.
RUN = 1 << 16
#: Bytes that are scanned at once; one with a longer word is longer.
PIECE = 1 << 20
#: A-Z in lower case, separators as spaces.
_FOLDED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def patterns(longest: int = LONGEST) -> dict[int, regex.Pattern]:
    """For each n up to `longest`: n words with single spaces between them, bounded by spaces or the ends."""
    return {n: regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, longest + 1)}


def collapsed(text: str | None) -> bytes:
    """The words with A-Z in lower case and single spaces between them."""
    return b" ".join((text or "").encode().translate(_FOLDED).split())


def pieces(line: bytes, n: int) -> Iterator[bytes]:
    """Whole words of about PIECE bytes; a piece begins n - 1 words before the end of the last, so each n words stand in one piece."""
    start = end = 0
    while end < len(line):
        end = line.find(b" ", max(start + PIECE, end + 1))
        end = len(line) if end < 0 else end
        yield line[start:end]
        back = end
        for _ in range(n - 1):
            back = line.rfind(b" ", start, back)
            if back < 0:
                break
        # A piece of less than n words held none of them; the next one begins where it did.
        start = start if back < 0 else back + 1


def bucket_runs(text: str | None, scans: dict[int, regex.Pattern], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of all features of a text, in runs of bounded length."""
    line = collapsed(text)
    for n, scan in scans.items():
        for piece in pieces(line, n):
            found = scan.findall(piece, overlapped=True)
            for at in range(0, len(found), RUN):
                run = found[at:at + RUN]
                yield np.fromiter(map(zlib.crc32, run), np.int64, len(run)) % buckets


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all texts; each task sends a bucket at most once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, scans = np.zeros(buckets, np.int64), patterns(longest)
        for batch in batches:
            for value in batch.column(0):
                for found in bucket_runs(value.as_py(), scans, buckets):
                    counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])
        give_back()

    counts = small_batches(docs.select(text)).mapInArrow(run, "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: what one feature in it adds to a document's weight. `buckets` whole numbers."""
    spark = docs.sparkSession
    s = bucket_counts(docs, text, longest, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, text, longest, buckets).withColumnRenamed("n", "t")
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    # Sums of the table of buckets itself, which has a fixed number of rows.
    # A table of a fixed number of rows, whatever the documents are.
    counts = sorted(both.collect())
    s_all, t_all = (sum(r[c] for r in counts) for c in ("s", "t"))
    ratio = lambda r: (r["t"] + 1.0) * (s_all + float(buckets)) / ((r["s"] + 1.0) * (t_all + float(buckets)))
    return [math.floor(1000 * math.log(ratio(r))) for r in counts]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, per_bucket: list[int], text: str = "text", longest: int = LONGEST) -> DataFrame:
    """The documents without their text, with n_words, n_features and weight."""
    made = ["n_words", "n_features", "weight"]
    df = docs.drop(*made)
    rest = [f for f in df.schema if f.name != text]
    schema = T.StructType([*rest, *[T.StructField(c, T.LongType()) for c in made]])
    table = df.sparkSession.sparkContext.broadcast(np.array(per_bucket, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, scans = table.value, patterns(longest)
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, value in enumerate(batch.column(text)):
                words, features, weight = 0, 0, 0
                for n, scan in scans.items():
                    runs = 0
                    for found in bucket_runs(value.as_py(), {n: scan}, len(gain)):
                        runs += len(found)
                        weight += int(gain[found].sum())
                    features += runs
                    words = runs if n == 1 else words
                out[:, i] = words, features, weight
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], *map(pa.array, out)], names=schema.names)
        give_back()

    return small_batches(df).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST,
             buckets: int = BUCKETS, seed: int = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document without its text, with n_words, n_features, weight, score and rank; rank is null where it was not drawn.

    `percent` of the documents with `least_words` words or more are drawn, rounded down: those of the highest
    scores, ties to the smaller id. Rows that repeat an id get the same noise and are drawn each on its own, in any order
    where they agree in score. A null id has the noise of an empty one and comes first among ties. A null or empty text has no feature and weight 0.
    Empty tables give an empty result; an empty target makes every gain the inverse of the corpus counts.
    Columns named like the made ones, in either case, are replaced; others pass through.
    """
    clash = {"n_words", "n_features", "weight", "score", "rank", "_tie", "_place"}
    plain = docs.drop(*[c for c in docs.columns if c.lower() in clash and c not in (text, doc_id)])
    rows = weighed(plain, gains(plain, target, text, longest, buckets), text, longest)
    scored = staged(rows.withColumn("score", F.col("weight") + noise(F.col(f"`{doc_id}`"), seed)), "resampling")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = numbered(able, [F.desc("score"), F.asc_nulls_first(doc_id)], "_place", "resampling-order")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).drop("_place").unionByName(short)
