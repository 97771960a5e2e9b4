"""Removal of repeated byte strings: every byte that a string of `length` bytes covers which also starts earlier.

Each window of `length` bytes is owned by one anchor, the least-hashed short string inside it, so equal windows have equal
anchors at equal places. Runs of windows with one anchor form a context. Contexts that agree as a whole are settled by
grouping. What is left are anchors in differing contexts: those go to shards by anchor, where a suffix
array (Larsson-Sadakane refinement) and common prefixes (Kasai) find the equal windows. An anchor with more contexts than
a shard takes is dealt to several shards; their sorted windows are then merged by binary search against split points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.texts import chunked, mixed, prefix_hashes, small_batches, span_hashes
from marketlens.sources.scratch import staged

LENGTH, ANCHOR = 100, 24
#: Contexts of one shard (about 180 bytes each), and of one anchor before it is dealt to several shards.
SHARD_CONTEXTS, ANCHOR_CONTEXTS = 10_000, 20_000
_PIECE = 1 << 20


def contexts_of(data: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, context hash, first, last): the runs of window starts of one text that one anchor owns."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    windows = len(data) - length + 1
    for begin in range(0, max(0, windows), _PIECE):
        end = min(windows, begin + _PIECE)  # windows of this piece
        part = data[begin : end + length - 1]
        prefix = prefix_hashes(part)
        n = len(part) - anchor + 1
        at = np.arange(n)
        grams = span_hashes(prefix, at, at + anchor)
        low = np.uint64((1 << 21) - 1)
        key = (grams & ~low) | at.astype(np.uint64)  # the leftmost of equal anchors wins
        width, have = length - anchor + 1, 1
        while have < width:
            step = min(have, width - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(key)]]) - 1
        own = (key[first] & low).astype(np.int64)
        # The place of the anchor in its first window is part of the context.
        whole = mixed(span_hashes(prefix, first, last + length) + (own - first).astype(np.uint64))
        for store, value in zip(out, (grams[own] >> np.uint64(14), whole, first + begin, last + begin)):
            store.append(value)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) if x else np.zeros(0, np.int64) for x in out)


def _contexts(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """anchor, context, doc_id, first, count (windows) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for low, high, data, offsets in chunked(batch.column("text")):
                found: list[list[np.ndarray]] = [[], [], [], [], []]
                for i in range(high - low):
                    a, c, first, last = contexts_of(data[offsets[i] : offsets[i + 1]], length, anchor)
                    for store, value in zip(found, (a, c, np.full(len(a), ids[low + i]), first, last - first + 1)):
                        store.append(value)
                columns = [np.concatenate([np.zeros(0, np.int64), *(np.asarray(v).astype(np.uint64).view(np.int64) for v in x if len(v))]) for x in found]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:3]), pa.array(columns[3].astype(np.int32)), pa.array(columns[4].astype(np.int32))], names=["anchor", "context", "doc_id", "first", "count"])

    rows = small_batches(docs).where("doc_id IS NOT NULL").where(F.octet_length("text") >= length)
    return rows.mapInArrow(run, "anchor long, context long, doc_id long, first int, count int")


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by their first `depth` bytes. Groups that are already single are not sorted again.

    Equal suffixes share the rank of the first; at a depth of all bytes ranks are places.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # a group's rank is its first place
    have = 8
    while have < depth:
        step = min(have, depth - have)
        single = fresh & np.append(fresh[1:], True)
        places = np.flatnonzero(~single)
        if not len(places):
            break
        suffixes = order[places]
        ahead = suffixes + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[suffixes]
        again = np.lexsort((second, group))
        order[places] = suffixes[again]
        group, second = group[again], second[again]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        fresh[places] = new
        heads = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        rank[order[places]] = places[heads]
        have += step
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, place: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Kasai: the prefix (up to `most`) that each suffix shares with the one before it in `order`.

    All texts advance together: within a text the shared prefix falls by one at most from a suffix to the next.
    `order` sorts whole suffixes; those of counts[i] places from starts[i] on are computed.
    """
    n = len(data)
    shared = np.zeros(n, np.int64)
    held = np.zeros(len(starts), np.int64)
    for t in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > t)
        here = starts[live] + t
        where = place[here]
        there = np.where(where > 0, order[np.maximum(where - 1, 0)], -1)
        h = np.where(there >= 0, np.maximum(held[live] - 1, 0), 0)
        grow = np.flatnonzero(there >= 0)
        while len(grow):
            i, j = here[grow] + h[grow], there[grow] + h[grow]
            same = (h[grow] < most) & (i < n) & (j < n)
            same[same] = data[i[same]] == data[j[same]]
            grow = grow[same]
            h[grow] += 1
        shared[here] = h
        held[live] = h
    return shared


def equal_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, group): the windows of texts laid end to end, equal windows in one group."""
    order, place = suffix_array(data, len(data))
    shared = common_prefixes(data, order, place, starts, sizes, length)
    group = np.cumsum(shared[order] < length)
    inside = np.arange(len(data)) - np.repeat(starts, sizes) <= np.repeat(sizes, sizes) - length
    opens = inside[order]
    return order[opens], group[opens]


def _repeats(found: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans that shards find in their contexts, and the first windows of anchors that lie in several shards."""

    def settle(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        # Rows that repeat a document bring its contexts again; a context counts once.
        rows = sorted({r[:3]: r for r in sorted(rows)}.values(), key=lambda r: (r[1], r[2]))
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        starts = np.cumsum(sizes) - sizes
        at, group = equal_windows(data, starts, sizes, length)
        # Anchors share a shard by chance only; equal windows have equal anchors, so groups never mix them.
        order = np.lexsort((at, group))
        at, group = at[order], group[order]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        text = np.searchsorted(starts, at, "right") - 1
        spans, firsts = [], []
        again = np.sort(at[~head])
        of = np.searchsorted(starts, again, "right") - 1
        if len(again):
            cut = np.concatenate([[True], (np.diff(again) != 1) | (np.diff(of) != 0)])
            begin, end = again[cut], again[np.append(cut[1:], True)]
            for b, e, k in zip(begin, end, of[cut]):
                base = rows[k][2] - starts[k]
                spans.append((rows[k][1], int(b + base), int(e + base + length)))
        for b, k in zip(at[head], text[head]):
            if rows[k][4]:
                firsts.append((rows[k][0], data[b : b + length].tobytes(), rows[k][1], int(b - starts[k] + rows[k][2])))
        return spans, firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            spans, firsts = settle(rows)
            return pa.RecordBatch.from_pylist(
                [{"doc_id": d, "start": a, "end": b, "anchor": None, "window": None} for d, a, b in spans] + [{"doc_id": d, "start": p, "end": p + length, "anchor": a, "window": w} for a, w, d, p in firsts],
                schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("anchor", pa.int64()), ("window", pa.binary())]),
            )

        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "anchor", "doc_id", "first", "bytes", "dealt"))):
                if shard != now and rows:
                    yield out(rows)
                    rows = []
                now = shard
                rows.append(tuple(row))
        if rows:
            yield out(rows)

    result = staged(found.mapInArrow(run, "doc_id long, start int, end int, anchor long, window binary"), "suffix-repeats")
    return result.where("anchor IS NULL").select("doc_id", "start", "end"), result.where("anchor IS NOT NULL")


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, limit: int = ANCHOR_CONTEXTS) -> DataFrame:
    """(doc_id, start, end) of repeated bytes; spans of a document may overlap."""
    rows = _contexts(docs, length, anchor)
    shared = rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    rows = staged(rows.join(shared, "anchor", "left_semi"), "suffix-shared")
    place = F.struct("doc_id", "first")
    first = rows.groupBy("anchor", "context").agg(F.min(place).alias("origin"), F.max("count").alias("count"))
    first = staged(first, "suffix-first")
    whole = rows.join(first.select("anchor", "context", "origin"), ["anchor", "context"]).where(place != F.col("origin"))
    whole = whole.select("doc_id", F.col("first").alias("start"), (F.col("first") + F.col("count") - 1 + length).alias("end"))

    # Anchors in contexts that differ: only the first copy of each context is compared.
    several = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / limit)
    open_rows = first.join(several, "anchor").select("anchor", "origin.doc_id", "origin.first", "count", parts.alias("parts"))
    open_rows = staged(open_rows, "suffix-open")
    shards = max(1, -(-open_rows.count() // SHARD_CONTEXTS))
    salt = F.pmod(F.xxhash64("doc_id", "first"), F.col("parts"))
    shard = F.pmod(F.xxhash64("anchor", salt), F.lit(shards))
    wanted = open_rows.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "count", (F.col("parts") > 1).alias("dealt"), shard.alias("shard"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
                raw = text.encode()
                for w in asked:
                    made.append({"shard": w["shard"], "anchor": w["anchor"], "doc_id": doc, "first": w["first"], "bytes": raw[w["first"] : w["first"] + w["count"] - 1 + length], "dealt": w["dealt"]})
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("shard", pa.int64()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("bytes", pa.binary()), ("dealt", pa.bool_())]))

    pieces = docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(cut, "shard long, anchor long, doc_id long, first int, bytes binary, dealt boolean")
    pieces = pieces.where(F.length("bytes") >= length).repartition(shards, "shard").sortWithinPartitions("shard")
    spans, firsts = _repeats(pieces, length)

    # Range partitioning looks up each sorted window among split points by binary search; equal windows then lie side by side.
    firsts = firsts.repartitionByRange("anchor", "window")
    origin = firsts.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "start")).alias("origin"), F.count("*").alias("n")).where("n > 1")
    crossing = firsts.join(origin, ["anchor", "window"]).where(F.struct("doc_id", "start") != F.col("origin")).select("doc_id", "start", "end")
    return whole.unionByName(spans).unionByName(crossing)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and `kept`, the bytes, on request) of every row.

    Texts are taken as UTF-8 bytes, whole; a null or empty text and one below `length` bytes loses nothing.
    Rows without a doc_id lose nothing and count as no one's origin. A doc_id stands for one text: rows that repeat one with
    its text are no copies of each other and get the same result; should their texts differ, each gets the
    spans of all. Extra columns are left out. An empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(slim, length, **options).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = staged(spans, "suffix-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, made = batch.column("spans"), []
            flat = lists.values
            begin, end, cuts = np.asarray(flat.field("start")), np.asarray(flat.field("end")), np.asarray(lists.offsets)
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                a, b = begin[cuts[i] : cuts[i + 1]], end[cuts[i] : cuts[i + 1]]
                gone = np.zeros(len(raw) + 1, np.int64)
                np.add.at(gone, np.minimum(a, len(raw)), 1)
                np.add.at(gone, np.minimum(b, len(raw)), -1)
                covered = np.cumsum(gone)[:-1] > 0
                runs = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                made.append((len(raw), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            n, removed, count, digest, kept = zip(*made) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = small_batches(slim).join(spans, "doc_id", "left").withColumn("spans", F.coalesce("spans", none)).select("doc_id", "text", "spans")
    rows = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return rows if keep_text else rows.drop("kept")
