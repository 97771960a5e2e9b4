"""Byte-level BPE with a rank file. In each partition, recursive DuckDB queries contract the words.

Texts are split by the pattern of the rank file's encoder, on whole Arrow batches at once. The distinct
words of a batch become token-position rows; a recursive query joins neighbours with the merge table and contracts each
word's leftmost pair of least rank until no pair is left. Only the last step of a position is kept. Decoding joins the
ids with the vocabulary and puts the bytes together by an ordered aggregation. What one query takes is bounded, whatever
the number of words and the length of a text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.texts import chunked, give_back, prefix_hashes, small_batches, span_hashes

#: Words of more bytes are contracted with a heap: a query step for each merge would take the square of their length.
LONG_WORD = 64
#: Bytes of one recursive query, ids of one decoding query, and words whose ids a worker remembers before it starts afresh.
QUERY_BYTES, QUERY_IDS, REMEMBERED = 200_000, 200_000, 2_000_000
_CHUNK = 2 << 20

# The suffixes that the pattern splits off after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
# The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_kinds: list[np.ndarray] = []

CONTRACT = f"""
WITH RECURSIVE steps(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM bytes_of
  UNION
  (WITH around AS (
     SELECT word, pos, tok, lead(tok) OVER near AS after, lead(pos) OVER near AS next
     FROM recurring.steps WHERE tok >= 0 AND word IN (SELECT word FROM steps)
     WINDOW near AS (PARTITION BY word ORDER BY pos)),
   best AS (
     SELECT word, min(merges.made::BIGINT * {1 << 20} + pos) AS key
     FROM around JOIN merges ON tok = merges.a AND after = merges.b GROUP BY word)
   SELECT word, unnest([pos, next]), unnest([(key // {1 << 20})::INTEGER, -1])
   FROM around JOIN best USING (word) WHERE pos = key % {1 << 20})
)
SELECT word, tok FROM steps WHERE tok >= 0 ORDER BY word, pos
"""
DECODE = "SELECT doc, string_agg(vocabulary.hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (id) GROUP BY doc"


def load_ranks(path: str) -> bytes:
    """The rank file's content; it is bounded by the vocabulary and goes along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _kind_of_code_points() -> np.ndarray:
    if not _kinds:
        kinds = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
            for m in regex.finditer(pattern, every):
                run = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
                kinds[run] = kind
        kinds[list(WHITE_SPACE)] = _SPACE
        _kinds.append(kinds)
    return _kinds[0]


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words of all texts start, and the first word of each text (n + 1 numbers)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _kind_of_code_points()[points]
    n = len(points)
    fresh = np.zeros(n + 1, bool)  # a text starts here
    fresh[np.searchsorted(at, offsets)] = True
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    change[1:n] = (kind[1:] != kind[:-1]) | fresh[1:n]
    start = change[:n].copy()
    space = kind == _SPACE
    # The last character of a run of white space before a word stands alone or, if it is a blank, opens that word.
    last = np.zeros(n, bool)
    last[: n - 1] = space[:-1] & change[1:n] & ~fresh[1:n]
    start |= last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (points[:-1] == 0x20)
    start &= ~joined
    # An apostrophe that is a run of its own and opens a word takes a suffix along.
    quote = np.flatnonzero((points == 0x27) & start & change[:n] & change[1:])
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == _LETTER) & ~fresh[quote + 1]]
    for suffix in SUFFIXES:
        fits = quote[quote + len(suffix) < n]
        for k, c in enumerate(suffix):
            fits = fits[(points[fits + 1 + k] == ord(c)) & ~fresh[fits + 1 + k]]
        start[fits + 1] = False
        after = fits + 1 + len(suffix)
        start[after[after < n]] = True
    starts = at[start]
    return starts, np.searchsorted(starts, offsets)


class Merges:
    """The vocabulary and the merge table in a DuckDB of this process, and the words it has seen."""

    def __init__(self, content: bytes) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}
        top = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * top
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, made = (np.array(x, np.int32) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int32),) * 3
        self.merges = pa.table({"a": a, "b": b, "made": made})
        self._db: duckdb.DuckDBPyConnection | None = None
        self._forget()

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        if self._db is None:
            self._db = duckdb.connect()
            for setting in ("threads = 1", "memory_limit = '400MB'", "temp_directory = ''", "preserve_insertion_order = false"):
                self._db.execute(f"SET {setting}")
            self._db.register("given", self.merges)
            self._db.execute("CREATE TABLE merges AS SELECT * FROM given")
            self._db.register("given", pa.table({"id": np.arange(len(self.tokens), dtype=np.int32), "hex": [t.hex() for t in self.tokens]}))
            self._db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
            self._db.unregister("given")
        return self._db

    def rest(self) -> None:
        """Close the database at the end of a task: Spark keeps idle workers, and their memory counts. Words stay known."""
        if self._db is not None:
            self._db.close()
            self._db = None

    def _forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: a word of the vocabulary is its own id, the others are merged."""
        out: list[np.ndarray | None] = [None] * len(words)
        open_words = []
        for i, w in enumerate(words):
            if (rank := self.ranks.get(w)) is not None:
                out[i] = np.array([rank], np.int32)
            elif len(w) > LONG_WORD:
                out[i] = np.array(self._by_heap(w), np.int32)
            else:
                open_words.append(i)
        ends = np.cumsum([len(words[i]) for i in open_words], dtype=np.int64)
        last = 0
        while last < len(open_words):
            first, done_bytes = last, ends[last - 1] if last else 0
            last = int(np.searchsorted(ends, done_bytes + QUERY_BYTES, "right"))  # a word has LONG_WORD bytes at most
            part = open_words[first:last]
            sizes = np.array([len(words[i]) for i in part])
            raw = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            begin = np.cumsum(sizes) - sizes
            rows = pa.table({"word": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "pos": (np.arange(len(raw)) - np.repeat(begin, sizes)).astype(np.int32), "tok": self.byte_ids[raw]})
            self.db.register("bytes_of", rows)
            done = self.db.execute(CONTRACT).fetchnumpy()
            self.db.unregister("bytes_of")
            toks, cuts = np.asarray(done["tok"], np.int32), np.searchsorted(np.asarray(done["word"]), np.arange(len(part) + 1))
            for j, i in enumerate(part):
                out[i] = toks[cuts[j] : cuts[j + 1]]
        return out

    def _by_heap(self, word: bytes) -> list[int]:
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i] + parts[j]))

        for i in range(len(word)):
            offer(i)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j] = made, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[p] for p in parts if p is not None]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n + 1 offsets into them."""
        starts, texts = split_words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, where, each = np.unique(span_hashes(prefix_hashes(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if new.any():
            raw = data.tobytes()
            ids = self.contract([raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
            count = np.array([len(x) for x in ids])
            first = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, *ids])
            order = np.argsort(all_keys := np.concatenate([self.keys, keys[new]]), kind="stable")
            self.keys, self.first, self.count = all_keys[order], np.concatenate([self.first, first])[order], np.concatenate([self.count, count])[order]
            place = np.searchsorted(self.keys, keys)
        first, count = self.first[place][each], self.count[place][each]
        ends_of = np.cumsum(count)
        ids = self.pool[np.repeat(first - (ends_of - count), count) + np.arange(ends_of[-1])]
        return ids, np.concatenate([[0], ends_of])[texts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids."""
        docs = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        pieces: list[list[bytes]] = [[] for _ in range(len(offsets) - 1)]
        for k in range(0, len(ids), QUERY_IDS):
            part = ids[k : k + QUERY_IDS]
            self.db.register("ids", pa.table({"doc": docs[k : k + QUERY_IDS], "pos": np.arange(len(part), dtype=np.int32), "id": part}))
            for doc, text in self.db.execute(DECODE).fetchall():
                pieces[doc].append(bytes.fromhex(text))
            self.db.unregister("ids")
        return [b"".join(x) for x in pieces]

    def round_trip(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids and decoded bytes of each text. Remembered words are found by a 64-bit hash, so a text that
        does not come back as it was is encoded again, word by word."""
        ids, cuts = self.encode(data, offsets)
        for i, decoded in enumerate(self.decode(ids, cuts)):
            own, text = ids[cuts[i] : cuts[i + 1]], data[offsets[i] : offsets[i + 1]].tobytes()
            if decoded != text:
                starts, _ = split_words(data[offsets[i] : offsets[i + 1]], np.array([0, len(text)]))
                spans = zip(starts.tolist(), [*starts[1:].tolist(), len(text)])
                own = np.concatenate([np.zeros(0, np.int32), *self.contract([text[a:b] for a, b in spans])])
                decoded = self.decode(own, np.array([0, len(own)]))[0]
            yield own, decoded


_loaded: dict[bytes, Merges] = {}


def merges_of(content: bytes) -> Merges:
    key = hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Merges(content)
    return _loaded[key]


def _with(docs: DataFrame, text: str, fields: list[T.StructField], make) -> DataFrame:
    names = [f.name for f in fields]
    kept = [c for c in docs.columns if c not in names and c != text]
    schema = T.StructType([*[f for f in docs.schema if f.name in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *make(batch.column(text))], names=[*kept, *names])
        finally:
            for merges in _loaded.values():
                merges.rest()
            give_back()

    return small_batches(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))).mapInArrow(run, schema)


def encode(docs: DataFrame, content: bytes, text: str = "text") -> DataFrame:
    """All columns but the text, and `ids`. A null or empty text has no ids; an empty table gives an empty result."""

    def make(column: pa.Array) -> list[pa.Array]:
        merges, parts = merges_of(content), []
        for _, _, data, offsets in chunked(column, _CHUNK):
            parts += [ids for ids, _ in merges.round_trip(data, offsets)]
        return [pa.array(parts, pa.list_(pa.int32()))]

    return _with(docs, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode(rows: DataFrame, content: bytes, ids: str = "ids") -> DataFrame:
    """All columns but the ids, and `bytes`; null ids count as none, an id without a token is an error."""

    def make(column: pa.Array) -> list[pa.Array]:
        merges, lists = merges_of(content), column.to_pylist()
        sizes = [len(x or ()) for x in lists]
        flat = np.array([i for x in lists for i in x or ()], np.int32)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(merges.tokens)):
            raise ValueError("an id is not in the vocabulary")
        return [pa.array(merges.decode(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.binary())]

    return _with(rows, ids, [T.StructField("bytes", T.BinaryType())], make)


def digests(docs: DataFrame, content: bytes, text: str = "text") -> DataFrame:
    """All columns but the text, and n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding it."""

    def make(column: pa.Array) -> list[pa.Array]:
        merges, n, one, two = merges_of(content), [], [], []
        for _, _, data, offsets in chunked(column, _CHUNK):
            for ids, decoded in merges.round_trip(data, offsets):
                n.append(len(ids))
                one.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                two.append(hashlib.sha256(decoded).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _with(docs, text, fields, make)
