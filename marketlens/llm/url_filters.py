"""URL rules with wildcards, all simulated at once by one bit-parallel automaton.

A rule is compiled to glob patterns; all patterns' states are packed into 64-bit words
(Shift-And with self-loops for the wildcards). A batch of urls advances together, one byte a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.texts import buffers, small_batches

#: (verdict, host, path): a rule fits its host and every subdomain where the url's path starts with its path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), AZ, az)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class Globs:
    """Patterns of bytes, `*` (any run without a slash) and `**` (any run), matched against whole strings.

    A backslash takes the next character literally. State i of a pattern means that i of its
    literal bytes are matched; a wildcard after them is a self-loop on that state.
    """

    def __init__(self, patterns: list[str]) -> None:
        parsed = [self._parse(p) for p in patterns]
        bits = sum(len(literals) + 1 for literals, _ in parsed)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        not_slash = [b for b in range(256) if b != ord("/")]
        for literals, loops in parsed:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for i, byte in enumerate(literals):
                self.step[byte, (at + i + 1) // 64] |= np.uint64(1 << (at + i + 1) % 64)
            for state, every in loops.items():
                self.stay[slice(None) if every else not_slash, (at + state) // 64] |= np.uint64(1 << (at + state) % 64)
            at += len(literals)
            self.last.append((at // 64, np.uint64(1 << at % 64)))
            at += 1

    @staticmethod
    def _parse(pattern: str) -> tuple[bytes, dict[int, bool]]:
        literals, loops, i = b"", {}, 0
        while i < len(pattern):
            if pattern[i] == "*":
                every = pattern.startswith("**", i)
                loops[len(literals)] = loops.get(len(literals), False) or every
                i += 2 if every else 1
                continue
            if pattern[i] == "\\" and i + 1 < len(pattern):
                i += 1
            literals += pattern[i].encode()
            i += 1
        return literals, loops

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each string whether each pattern matches it: a (strings, patterns) array."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        begin, longest = offsets[:-1][order], -sizes[order]
        states = np.tile(self.start, (len(sizes), 1))
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(longest, -t, "left"))  # strings longer than t
            now, byte = states[:n], data[begin[:n] + t]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:n] = (shifted & self.step[byte]) | (now & self.stay[byte])
        out = np.empty((len(sizes), len(self.last)), bool)
        for k, (word, bit) in enumerate(self.last):
            out[order, k] = (states[:, word] & bit) != 0
        return out


def literal(text: str) -> str:
    return "".join("\\" + c if c in "*\\" else c for c in text)


def rule_globs(host: str, path: str) -> list[str]:
    """The host itself and its subdomains; a host has no slash, so `*` stays inside it."""
    tail = literal(host) + literal(path) + "**"
    return [tail, "*." + tail]


def judge(pages: DataFrame, rules=RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each row of `pages`; the fitting rule with the most characters wins.

    Among rules of equal length the first in the list wins. A null url, or one without ://, has an
    empty host and path, no rule and the default verdict. Rows that repeat are judged alike; columns of
    the input that are named like a result, in capitals or not, are replaced. An empty table gives an empty result.
    """
    rules = tuple(rules)
    globs = [g for _, host, path in rules for g in rule_globs(host, path)]
    ranked = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in made]
    parts = pages.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    full = parts.withColumns({"rule": F.lit("").cast("string"), "verdict": F.lit(default)})
    schema = full.schema
    schema["rule"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, wide = Globs(globs), pa.large_string()
        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            canonical = pc.binary_join_element_wise(host.cast(wide), path.cast(wide), pa.scalar("", wide))
            hit = automaton.matches(*buffers(canonical))
            hit = hit[:, 0::2] | hit[:, 1::2]
            rule, verdict = [None] * len(host), [default] * len(host)
            for i in reversed(ranked):
                for row in np.flatnonzero(hit[:, i]):
                    rule[row], verdict[row] = rules[i][1] + rules[i][2], rules[i][0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return small_batches(parts).mapInArrow(run, schema)
