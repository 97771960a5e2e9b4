import hashlib
import random

import numpy as np
import pytest

from brute import kept_bytes
from marketlens.llm import suffix_dedup


def texts(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40), prose(25), "=" * 130, prose(120)]
    out = ["", None, "short", "z" * 99, "z" * 100, "z" * 260, "ab" * 200, shared[3], shared[3]]
    for _ in range(60):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a : a + rng.randint(60, len(s))], prose(rng.randint(0, 30))]
        out.append(" ".join(parts))
    out += [out[20], out[21] + " tail", out[22][5:], out[23] * 3]
    return out


@pytest.mark.parametrize("limit", [20_000, 3])
def test_matches_brute_force(spark, docs_of, limit):
    rng = random.Random(limit)
    rows = [(k * 3 - 20, t) for k, t in enumerate(texts(rng))]
    rng.shuffle(rows)
    wanted = kept_bytes(rows)
    for r in suffix_dedup.remove_repeats(docs_of(rows), keep_text=True, limit=limit).collect():
        n, removed, runs, kept = wanted[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, removed, runs), r["doc_id"]
        assert bytes(r["kept"]) == kept and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_odd_rows(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).collect() == []
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, 0), (1, long, 1), (None, long, 2), (2, long, 3)]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.remove_repeats(docs_of(rows, "doc_id long, text string, n_bytes int")).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, len(long))]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 700).astype(np.uint8)
    data[300:500] = data[50:250]
    raw = data.tobytes()
    order, rank = suffix_dedup.suffix_array(data, 40)
    cut = [raw[i : i + 40] for i in order]
    assert cut == sorted(cut)
    assert all((rank[i] == rank[j]) == (raw[i : i + 40] == raw[j : j + 40]) for i, j in rng.integers(0, 650, (500, 2)))
    order, place = suffix_dedup.suffix_array(data, len(data))
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw))) and (order[place] == np.arange(len(data))).all()
    shared = suffix_dedup.common_prefixes(data, order, place, np.array([0, 300]), np.array([300, 400]), 60)
    for i in rng.integers(0, 700, 200):
        if place[i]:
            j, h = order[place[i] - 1], 0
            while h < 60 and max(i, j) + h < 700 and raw[i + h] == raw[j + h]:
                h += 1
            assert shared[i] == h
