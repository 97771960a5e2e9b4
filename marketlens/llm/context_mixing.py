"""Language-model scores of texts by logistic mixing of hashed-context bit predictors.

A text is coded as binary decisions, a few for each token: has this pair of words been seen, is the word known at all, and the six bits
of the word's class (a hash of its last letters). What is left after them is a share of counts: the pair's among those
of the word before, or the word's among those of its class. Each decision is predicted by several
hashed contexts (what came before, at several distances; the word before; how frequent it is). Their log-odds are combined by weights that a gate selects by the kind
of the decision; the weights follow each text online as it is read, and a second stage refines the
mixed probability by what has happened at like predictions in this text. The sum of the bits is the score.

Probabilities depend on the training rows and on what came earlier in the text only. Tokens are scored as in the unigram base: all words that are not known are one
token. The probabilities of all tokens at one place sum to one at most.

What is gathered: counts of every word and of every pair of words, by 64-bit hashes, in ranges of the hash whose number grows with
the input. Texts are turned into chunks of token numbers once; a chunk asks the ranges for the counts of its distinct
words and pairs and gets them back in the same order, so that a frequent key is asked for once a chunk. The
tables of the decisions have a fixed number of hashed slots (`SLOT_BITS`) and are counted over all training rows;
there, a row's own occurrence of a pair or word is left out of its counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.texts import chunked, fold, give_back, lowered, mixed, prefix_hashes, small_batches, span_hashes, word_spans
from marketlens.sources.scratch import staged

CLASS_BITS = 6
#: Kinds of decisions, the gate of the mixer: pair seen, word known, each bit of the class.
GATES = 2 + CLASS_BITS
#: Hashed slots of each context, as powers of two; the fourth is the word before.
SLOT_BITS = (10, 16, 18, 20, 16, 18)
CONTEXTS = len(SLOT_BITS)
#: Tokens in one range of hashes, and in one run of texts that are mixed side by side.
RANGE_TOKENS, RUN_TOKENS = 4 << 20, 1 << 18
#: Decisions of a text between two changes of its weights; from LATE on a share of what it has had.
BLOCK, LATE, LATE_SHARE = 32, 4096, 1 / 16
RATE, START_WEIGHT, REFINE_STEPS, REFINE_PRIOR = 0.02, 0.3, 24, 12.0

_LOW = np.uint64((1 << CLASS_BITS) - 1)
_END = (mixed(np.array([0xE7D], np.uint64)) & ~_LOW)[0]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_BOUNDS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
CHUNK = "chunk long, n long, learn binary, sizes binary, n_bytes binary, n_words long, words binary, places binary"


def packed(a: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(b, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token keys of all texts, tokens per text, bytes per text. A key is a hash whose low bits are the class."""
    keys, sizes, lengths = [], [], []
    for _, _, data, offsets in chunked(column):
        low = lowered(data)
        starts, ends, first = word_spans(low, offsets)
        hashes = span_hashes(prefix_hashes(low), starts, ends)
        last = low[ends - 1].astype(np.uint64)
        before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        words = (hashes & ~_LOW) | (mixed(last * np.uint64(256) + before + np.uint64(1)) & _LOW)
        keys.append(np.insert(words, first[1:], _END))
        sizes.append(np.diff(first) + 1)
        lengths.append(np.diff(offsets))
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (sizes, np.int64), (lengths, np.int64)))


def pair_keys(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; the first of a text follows an end."""
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[np.cumsum(sizes) - sizes] = _END
    return mixed(before * _ODD[0] + mixed(keys)) & ~np.uint64(1)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    columns = zip(*rows) if rows else [[] for _ in shape]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape)], schema=shape)


def _schema(spec: str, *more: T.StructField) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(spec).fields, *more])


def _chunks(docs: DataFrame) -> DataFrame:
    """Rows of `doc_id, text, learn` as chunks of token numbers, numbered by task and place in it."""
    schema = _schema(CHUNK, T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(b for b in batches if b.num_rows):
            keys, sizes, lengths = tokens_of(batch.column("text"))
            words, places = np.unique(keys, return_inverse=True)
            learn = np.array(batch.column("learn").to_pylist(), np.uint8)
            row = (base + k, len(keys), learn.tobytes(), sizes.tobytes(), lengths.tobytes(), len(words), packed(words), packed(places.astype(np.uint32)))
            yield _batch([(*row, batch.column("doc_id").to_pylist())], schema)
        give_back()

    return staged(small_batches(docs.select("doc_id", "text", "learn")).mapInArrow(run, schema), "mixing-chunks")


@dataclass
class Chunk:
    learn: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, r: dict) -> Chunk:
        return cls(np.frombuffer(r["learn"], np.uint8).astype(bool), np.frombuffer(r["sizes"], np.int64),
                   unpacked(r["words"], r["n_words"], np.uint64), unpacked(r["places"], r["n"], np.uint32))

    @property
    def learned(self) -> np.ndarray:
        return np.repeat(self.learn, self.sizes)

    @property
    def pairs(self) -> np.ndarray:
        return pair_keys(self.words[self.places], self.sizes)


def _requests(chunks: DataFrame, ranges: int) -> DataFrame:
    """For each chunk and range: the distinct words (kind 0) and pairs (kind 1) in it, in order, and their counts in the chunk's training rows."""
    schema = _schema("kind int, part int, chunk long, n long, keys binary, counts binary")
    bounds = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk.of(r)
                learned = c.learned
                s = np.sort(c.pairs | learned.astype(np.uint64))
                heads = np.flatnonzero(np.diff(s >> np.uint64(1), prepend=~s[:1] >> np.uint64(1)))
                asked = [(c.words, np.bincount(c.places[learned], minlength=len(c.words))),
                         (s[heads] & ~np.uint64(1), np.add.reduceat(s & np.uint64(1), heads) if len(s) else s)]
                out = []
                for kind, (keys, counts) in enumerate(asked):
                    cuts = [0, *np.searchsorted(keys, bounds), len(keys)]
                    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        if b > a:
                            out.append((kind, part, r["chunk"], b - a, packed(keys[a:b]), packed(counts[a:b].astype(np.uint64))))
                for row in out:
                    yield _batch([row], schema)
        give_back()

    return chunks.mapInArrow(run, schema)


REPLY = "kind int, part int, chunk long, n long, counts binary, distinct long, by_class binary"


def _answers(requests: DataFrame) -> DataFrame:
    """The corpus counts that each chunk asked for; and for each range (chunk -1) its distinct training keys and their counts by class."""
    schema = _schema(REPLY)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([unpacked(r["keys"], r["n"], np.uint64) for r in rows])
        counts = np.concatenate([unpacked(r["counts"], r["n"], np.uint64) for r in rows])
        distinct, places = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, places, counts)
        kind, part = rows[0]["kind"], rows[0]["part"]
        ends = np.cumsum([r["n"] for r in rows])
        out = [(kind, part, r["chunk"], r["n"], packed(total[places[e - r["n"] : e]]), None, None) for r, e in zip(rows, ends)]
        by_class = np.zeros(1 << CLASS_BITS, np.uint64)
        np.add.at(by_class, (distinct & _LOW).astype(np.int64), total)
        out.append((kind, part, -1, 0, None, int((total > 0).sum()), by_class.tobytes()))
        return pa.Table.from_batches([_batch(out, schema)])

    return staged(requests.groupBy("kind", "part").applyInArrow(answer, schema), "mixing-counts")


def _counted(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk with the corpus counts of its words and of the pair at each token."""
    schema = T.StructType([*chunks.schema, *_schema("word_counts binary, pair_counts binary")])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        (r,) = left.to_pylist()
        replies = sorted(right.to_pylist(), key=lambda x: (x["kind"], x["part"]))
        words, pairs = (np.concatenate([np.zeros(0, np.uint64), *[unpacked(x["counts"], x["n"], np.uint64) for x in replies if x["kind"] == k]]) for k in (0, 1))
        _, places = np.unique(Chunk.of(r).pairs, return_inverse=True)
        return pa.Table.from_batches([_batch([(*r.values(), packed(words), packed(pairs[places]))], schema)])

    asked = answers.where("chunk >= 0").select("kind", "part", "chunk", "n", "counts")
    return staged(chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(join, schema), "mixing-counted")


# Decisions


@dataclass
class Tokens:
    """What decisions are made of, for a run of whole texts."""

    sizes: np.ndarray
    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray


def runs_of(r: dict, training: bool) -> Iterator[tuple[int, int, Tokens]]:
    """(first text, text after the last, tokens) of a chunk; for training only its training rows, and without their own occurrence."""
    c = Chunk.of(r)
    n = r["n"]
    keys = c.words[c.places]
    word = unpacked(r["word_counts"], len(c.words), np.uint64).astype(np.int64)[c.places]
    pair = unpacked(r["pair_counts"], n, np.uint64).astype(np.int64)
    sizes = c.sizes
    if training:
        keep = c.learned
        keys, word, pair, sizes = keys[keep], word[keep] - 1, pair[keep] - 1, sizes[c.learn]
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        start = ends[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(ends, start + RUN_TOKENS, "right")))
        part = slice(start, ends[b - 1])
        yield a, b, Tokens(sizes[a:b], keys[part], word[part], pair[part])
        a = b


def _back(values: np.ndarray, place: np.ndarray, steps: int) -> np.ndarray:
    """The value some tokens earlier in the same text, or 0."""
    out = np.zeros_like(values)
    out[steps:] = values[:-steps] if steps else values
    out[place < steps] = 0
    return out


def decisions(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(decisions per token, kind of each decision, its outcome, its slot in each context), in the order of the text."""
    n = len(t.keys)
    place = np.arange(n) - np.repeat(np.cumsum(t.sizes) - t.sizes, t.sizes)
    seen, known = t.pair > 0, t.word > 0
    group = (t.keys & _LOW).astype(np.uint64)
    told = np.uint64(512) + (seen.astype(np.uint64) << np.uint64(7)) + (known.astype(np.uint64) << np.uint64(6)) + group
    one, two, three = (_back(told, place, k) for k in (1, 2, 3))
    often = np.zeros(n, np.uint64)
    often[1:] = np.frexp(np.maximum(t.word[:-1], 0).astype(np.float64))[1].astype(np.uint64)
    often[place == 0] = 63
    before = _back(t.keys, place, 1)
    ten = np.uint64(10)
    contexts = np.stack([np.zeros(n, np.uint64), one, (one << ten) | two, before, (often << ten) | ((one >> np.uint64(6)) << np.uint64(4)) | (two >> np.uint64(6)), (two << ten) | three])
    per = np.where(seen, 1, np.where(known, 2 + CLASS_BITS, 2))
    starts = np.cumsum(per) - per
    total = int(per.sum())
    kind, outcome, slots = np.empty(total, np.uint8), np.empty(total, bool), np.empty((CONTEXTS, total), np.int32)

    def put(which: np.ndarray, gate: int, node: np.ndarray, bit: np.ndarray) -> None:
        at = starts[which] + gate
        kind[at], outcome[at] = gate, bit
        for k in range(CONTEXTS):
            x = (contexts[k, which] * np.uint64(128) + node) * _ODD[k]
            x ^= x >> np.uint64(29)
            slots[k, at] = _BOUNDS[k] + ((x * _ODD[(k + 1) % CONTEXTS]) >> np.uint64(64 - SLOT_BITS[k])).astype(np.int64)

    every, unseen = np.arange(n), np.flatnonzero(~seen)
    put(every, 0, np.zeros(n, np.uint64), seen)
    put(unseen, 1, np.ones(len(unseen), np.uint64), known[unseen])
    coded = unseen[known[unseen]]
    for b in range(CLASS_BITS):
        node = np.uint64(2 + (1 << b)) + (group[coded] >> np.uint64(CLASS_BITS - b))
        put(coded, 2 + b, node, (group[coded] >> np.uint64(CLASS_BITS - 1 - b)) & np.uint64(1))
    return per, kind, outcome, slots


def _tables(counted: DataFrame) -> np.ndarray:
    """Log-odds of each slot, from the decisions of all training rows: a table of fixed size."""
    schema, width = _schema("part int, counts binary"), 1 << 16
    total = 2 * int(_BOUNDS[-1])
    parts = -(-total // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(parts * width, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                for _, _, t in runs_of(r, True):
                    _, _, outcome, slots = decisions(t)
                    for k in range(CONTEXTS):
                        low, size = 2 * int(_BOUNDS[k]), 2 << SLOT_BITS[k]
                        counts[low : low + size] += np.bincount((slots[k].astype(np.int64) << 1) + outcome - low, minlength=size)
        for p in range(parts):
            part = counts[p * width : (p + 1) * width]
            if part.any():
                yield _batch([(p, packed(part))], schema)
        give_back()

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = np.zeros(width, np.int64)
        for r in rows:
            total += unpacked(r["counts"], width, np.int64)
        return pa.Table.from_batches([_batch([(rows[0]["part"], packed(total))], schema)])

    counts = np.zeros(parts * width, np.int64)
    for r in counted.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect():
        counts[r["part"] * width : (r["part"] + 1) * width] = unpacked(bytes(r["counts"]), width, np.int64)
    no, yes = counts[:total].reshape(-1, 2).T
    return np.clip(np.log((yes + 0.4) / (no + 0.4)), -8, 8).astype(np.float32)


def mix(per_text: np.ndarray, kind: np.ndarray, outcome: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each text's decisions.

    `odds` has the log-odds of each context in a column per decision. The texts are read side by side, a block of decisions at a time; a
    block is predicted with the weights and the refinement that the text's earlier blocks have left.
    """
    texts = len(per_text)
    text = np.repeat(np.arange(texts), per_text)
    j = np.arange(len(kind)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    block = (j // BLOCK).astype(np.float64)
    late = j >= LATE
    block[late] = LATE // BLOCK + np.floor(np.log(j[late] / LATE) / np.log1p(LATE_SHARE))
    block = block.astype(np.int32)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(int(block.max(initial=-1)) + 2))
    weights = np.full((texts * GATES, odds.shape[1]), START_WEIGHT, np.float32)
    hits, tries = (np.zeros(texts * GATES * REFINE_STEPS) for _ in range(2))
    out = np.zeros(texts)
    for a, b in zip(cuts, cuts[1:]):
        rows = order[a:b]
        s, y, whose = odds[rows], outcome[rows].astype(np.float32), text[rows]
        state = whose * GATES + kind[rows]
        x = np.einsum("ij,ij->i", weights[state], s)
        np.clip(x, -12, 12, out=x)
        p = 1 / (1 + np.exp(-x))
        like = state * REFINE_STEPS + np.clip((x + 6) * 2, 0, REFINE_STEPS - 1).astype(np.int64)
        refined = (hits[like] + REFINE_PRIOR * p) / (tries[like] + REFINE_PRIOR)
        final = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
        out += np.bincount(whose, np.log(np.where(y > 0, final, 1 - final)), texts)
        hits += np.bincount(like, y, len(hits))
        tries += np.bincount(like, minlength=len(hits))
        rate = RATE / np.maximum(1, np.bincount(state, minlength=len(weights)) / 16)
        error = y - p
        for k in range(odds.shape[1]):
            weights[:, k] += rate * np.bincount(state, error * s[:, k], len(weights))
    return out


@dataclass
class Model:
    tokens: int
    distinct: int
    by_class: np.ndarray
    odds: np.ndarray


def _scored(counted: DataFrame, model: Model, id_type: T.DataType) -> DataFrame:
    spec = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    schema = T.StructType([T.StructField("doc_id", id_type), *_schema(spec)])
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def rows_of(r: dict) -> Iterator[tuple]:
        m = shared.value
        lengths, learn = np.frombuffer(r["n_bytes"], np.int64), np.frombuffer(r["learn"], np.uint8)
        for a, b, t in runs_of(r, False):
            per, kind, outcome, slots = decisions(t)
            text = np.repeat(np.arange(b - a), t.sizes)
            score = mix(np.bincount(text, per, b - a).astype(np.int64), kind, outcome, m.odds[slots].T)
            # Shares of counts: of the pair after the word before it, or of the word in its class.
            before = np.empty_like(t.word)
            before[1:] = t.word[:-1]
            before[np.cumsum(t.sizes) - t.sizes] = t.word[np.cumsum(t.sizes) - 1]
            seen, known = t.pair > 0, t.word > 0
            whole = np.where(seen, before, m.by_class[(t.keys & _LOW).astype(np.int64)])
            share = np.where(seen, t.pair, t.word) / np.maximum(whole, 1)
            score += np.bincount(text, np.log(np.where(seen | known, np.minimum(share, 1), 1)), b - a)
            score /= np.log(10)
            base = np.bincount(text, np.log10((t.word + 0.5) / (m.tokens + 0.5 * (m.distinct + 1))), b - a)
            n_known = np.bincount(text, known, b - a).astype(np.int64)
            for k in range(b - a):
                size = int(lengths[a + k])
                bits = float(-score[k] / np.log10(2) / size) if size else None
                yield (r["ids"][a + k], not learn[a + k], int(t.sizes[k]), int(n_known[k]), m.tokens, float(base[k]), float(score[k]), size, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch(list(rows_of(r)), schema)
        give_back()

    return counted.mapInArrow(run, schema)


def learnable(doc_id: Column) -> Column:
    """Rows to learn from; a row without an id is held out."""
    return F.coalesce(fold(doc_id) != 1, F.lit(False))


def score(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row.

    Reads doc_id and text and leaves other columns out. `learn` says which rows are learned from (by default by `learnable`). A null text counts as empty:
    one token, the end, and no bits per byte. Rows that repeat are learned from and scored each on its own. An empty
    table gives an empty result; without training rows no word is known. A text of any length is scored whole.
    """
    rows = docs.select("doc_id", "text", (learnable(F.col("doc_id")) if learn is None else learn).alias("learn"))
    chunks = _chunks(rows)
    tokens = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    answers = _answers(_requests(chunks, max(1, -(-tokens // RANGE_TOKENS))))
    # One row a range, with sums over its keys.
    stats = answers.where("chunk < 0 AND kind = 0").select("distinct", "by_class").collect()
    by_class = sum((np.frombuffer(bytes(r["by_class"]), np.uint64).astype(np.int64) for r in stats), np.zeros(1 << CLASS_BITS, np.int64))
    counted = _counted(chunks, answers)
    model = Model(int(by_class.sum()), sum(r["distinct"] for r in stats), by_class, _tables(counted))
    return _scored(counted, model, rows.schema["doc_id"].dataType)
