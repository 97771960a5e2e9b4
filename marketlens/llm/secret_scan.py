"""Secrets in texts: three fixed kinds, and strings of high entropy.

The fourth kind slides a window over every candidate string, keeps the Shannon entropy of the window by
incremental counts, and compares it with a threshold for the string's character class.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.texts import chunked, lowered, small_batches

KINDS = ("assign", "access", "hex", "entropy")
BASE_KINDS = KINDS[:3]
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join([*map(_either_case, WORDS[:4]), _either_case("api") + "_?" + _either_case("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run below the least length fails as a whole, so asking for the length at once finds the same matches.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{14,}"), re.compile("[0-9a-f]{16,}")
ASSIGN_LEAST = 12

#: Candidate strings and, for each character class, the entropy in bits that a window must reach.
WINDOW = 20
CANDIDATE = re.compile(f"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Long words of one case come near random letters, so these need more than letters among digits.
CLASSES = (
    ("digits", re.compile("[0-9]+"), 2.7), ("hex", re.compile("[0-9a-fA-F]+"), 3.2),
    ("one-case letters", re.compile("[a-z]+|[A-Z]+"), 3.65), ("lower alphanumeric", re.compile("[a-z0-9]+"), 3.3),
    ("upper alphanumeric", re.compile("[A-Z0-9]+"), 3.3), ("base64", re.compile(".+"), 3.9),
)
#: A candidate is also looked at without its separators: a name before "=" must not change the class of the key.
INNER = re.compile(f"[A-Za-z0-9]{{{WINDOW},}}")
#: Strings that are known to be harmless: alphabets, counters and documentation values.
ALLOWED = ("abcdefghijklmnop", "ABCDEFGHIJKLMNOP", "0123456789", "EXAMPLE", "example", "00000000", "xxxxxxxx", "XXXXXXXX", "deadbeef", "sha256-", "sha512-")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

Span = tuple[int, int, int]
Run = tuple[int, int]  # first, one after the last


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the three fixed kinds, by start and kind. Offsets are code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def window_entropies(text: str, width: int = WINDOW) -> Iterator[float]:
    """Entropy in bits of each window of `width` characters. One character comes and one goes at each step."""
    part = [0.0, *(c * math.log2(c) for c in range(1, width + 2))]
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += part[n + 1] - part[n]
        counts[c] = n + 1
        if i >= width:
            n = counts[text[i - width]]
            total += part[n - 1] - part[n]
            counts[text[i - width]] = n - 1
        if i >= width - 1:
            yield math.log2(width) - total / width


def entropy_spans(text: str, allowed=ALLOWED) -> list[Span]:
    """Runs of windows that reach the threshold of their class, in a candidate or in its parts between separators.
    Windows that hold a part of an allowed string are left out. Work and memory grow with the candidate, whatever it holds."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if "://" in text[max(0, m.start() - 8) : m.start()]:
            continue
        parts = [(0, s), *((x.start(), x[0]) for x in INNER.finditer(s) if len(x[0]) < len(s))]
        hot = list(_united(sorted(run for at, part in parts for run in _hot_windows(at, part))))
        if not hot:
            continue
        touched = _united(heapq.merge(*(_touching(s, a) for a in allowed)))
        spans = _united((a, b - 1 + WINDOW) for a, b in _without(hot, touched))
        out += [(m.start() + a, 3, m.start() + b) for a, b in spans]
    return out


def _hot_windows(at: int, part: str) -> Iterator[Run]:
    """Runs of starts of the windows that reach the threshold; `at` is where the part begins."""
    least = next(x[2] for x in CLASSES if x[1].fullmatch(part))
    return _united((at + i, at + i + 1) for i, h in enumerate(window_entropies(part)) if h >= least)


def _united(runs: Iterable[Run]) -> Iterator[Run]:
    """Runs, which come by their first number, with those that overlap or touch made one."""
    begin = end = None
    for a, b in runs:
        if end is not None and a <= end:
            end = max(end, b)
            continue
        if end is not None:
            yield begin, end
        begin, end = a, b
    if end is not None:
        yield begin, end


def _without(runs: list[Run], holes: Iterator[Run]) -> Iterator[Run]:
    """What the holes leave of some runs. Both come in order and each is passed once."""
    hole = next(holes, None)
    for a, b in runs:
        while hole is not None and hole[1] <= a:
            hole = next(holes, None)
        while hole is not None and hole[0] < b:
            if a < hole[0]:
                yield a, hole[0]
            a = max(a, hole[1])
            if hole[1] >= b:
                break
            hole = next(holes, None)
        if a < b:
            yield a, b


def _touching(text: str, part: str) -> Iterator[Run]:
    """Runs of starts of the windows that hold some of an occurrence of `part`."""
    i = text.find(part)
    while i >= 0:
        yield i - WINDOW + 1, i + len(part)
        i = text.find(part, i + 1)


def spans_of(text: str, allowed=ALLOWED) -> list[Span]:
    return sorted(base_spans(text) + entropy_spans(text, allowed))


_HEX, _CANDIDATE = (np.zeros(256, bool) for _ in range(2))
_HEX[[*b"0123456789abcdef"]] = True
_CANDIDATE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def _runs(inside: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of `width` bytes that lie inside throughout, by doubling."""
    have = 1
    while have < width and len(inside) > min(have, width - have):
        step = min(have, width - have)
        inside = inside[:-step] & inside[step:]
        have += step
    return np.flatnonzero(inside) if have == width else np.zeros(0, np.int64)


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold a span at all; the others need no pattern matching. Leaves out no text that has one."""
    places = [_runs(_HEX[data], 16), _runs(_CANDIDATE[data], WINDOW)]
    low = lowered(data).tobytes()
    for word in (*WORDS, "akia"):
        found, part = [], word.encode()
        i = low.find(part)
        while i >= 0:
            found.append(i)
            i = low.find(part, i + 1)
        places.append(np.array(found, np.int64))
    return np.unique(np.searchsorted(offsets, np.concatenate(places), "right") - 1)


def _mapped(df: DataFrame, text: str, schema: T.StructType, finish) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            spans: list[list[Span]] = [[] for _ in range(len(column))]
            for first, _, data, offsets in chunked(column):
                for k in suspects(data, offsets):
                    spans[first + k] = spans_of(data[offsets[k] : offsets[k + 1]].tobytes().decode())
            yield finish(batch, spans)

    return small_batches(df).mapInArrow(run, schema)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and `secret_spans`: (kind, start, end) by start and then kind, in code points.

    A null or empty text has no spans. Rows that repeat are scanned alike, an empty table gives
    an empty result, and a column of the input named `secret_spans` is replaced.
    """
    df = docs.drop("secret_spans") if text != "secret_spans" else docs
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([*[f for f in df.schema if f.name != text], T.StructField("secret_spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def finish(batch: pa.RecordBatch, spans: list[list[Span]]) -> pa.RecordBatch:
        made = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in spans], kind)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], made], names=[*rest, "secret_spans"])

    return _mapped(df, text, schema, finish)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span replaced by `mask`; spans that overlap or touch get one mask.

    Texts without a span, null texts included, stay as they are.
    """

    def finish(batch: pa.RecordBatch, spans: list[list[Span]]) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        if not any(spans):
            return batch
        texts = batch.column(text).to_pylist()
        for i, found in enumerate(spans):
            if found:
                out, done = [], 0
                for a, _, b in found:
                    if a > done or not out:
                        out += [texts[i][done:a], mask]
                    done = max(done, b)
                texts[i] = "".join(out) + texts[i][done:]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return _mapped(docs, text, docs.schema, finish)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans, and all spans as text, from `secret_spans`."""
    spans = F.col("secret_spans")
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda s: F.concat_ws(",", F.transform(s, shown))
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return scanned.withColumns(
        {f"n_{k}": count(k) for k in BASE_KINDS}
        | {"base_sha256": F.sha2(joined(base).cast("binary"), 256), "spans": joined(spans)}
    ).drop("secret_spans")
