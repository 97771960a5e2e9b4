import random

import numpy as np
import pytest

from marketlens.llm import jaccard_join
from marketlens.llm.components import components
from brute import jaccard_classes, joined


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [f"w{rng.randrange(10**6)}"], [words[at], f"v{rng.randrange(10**6)}"]])
        out.append(" ".join(words))
    return out


def found(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(docs).collect()}


def test_classes_match_brute_force(docs_of):
    rng, texts = random.Random(5), []
    for size, edits in [(2, 1), (8, 1), (12, 2), (21, 2), (40, 3), (150, 12), (700, 40)]:
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        texts += near_copies(rng, base, 40, edits)
    common = " ".join(f"c{i}" for i in range(60))
    texts += [common + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(20)) for _ in range(40)]
    texts += ["", None, "one", "ONE", "two words", "two\twords", "a b c", "A\x0bB\x0cC", "a b c", "x " * 5000]
    rng.shuffle(texts)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)]
    assert found(docs_of(rows)) == jaccard_classes(rows)


def test_odd_rows(spark, docs_of):
    assert jaccard_join.classes(docs_of([])).collect() == []
    extra = docs_of([(1, "a b c d", 5), (1, "a b c d", 6), (None, "a b c d", 7), (3, "a b c d", 8)], "doc_id long, text string, component_id int")
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(extra).collect())
    assert rows == [(-1, 2, None), (1, 2, 1), (1, 2, 1), (3, 2, 1)]


@pytest.mark.parametrize("size", [9, 10, 14, 40, 97, 300])
def test_linked_sets_share_a_cell(size):
    rng, cells = np.random.default_rng(size), jaccard_join.Cells()
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        gone, new = rng.integers(0, size // 10 + 1), rng.integers(0, size // 10 + 1)
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
        same = len(np.intersect1d(x, y))
        if 100 * same >= 90 * (len(x) + len(y) - same) and not np.array_equal(x, y):
            assert np.intersect1d(cells.signatures(x), cells.signatures(y)).size


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for pair in links for n in pair if pair[0] != pair[1]}
    assert got == {n: c for n, c in joined(nodes, [x for x in links if x[0] != x[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("block", [5, 40])
def test_regions_in_parts(docs_of, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "_COLUMNS", 7)
    rng = random.Random(block)
    base = [f"b{i}" for i in range(100)]
    rows = list(enumerate(near_copies(rng, base, 120, 9)))
    assert found(docs_of(rows)) == jaccard_classes(rows)


@pytest.mark.parametrize("n", [1, 5, 60, 900, 30000])
def test_profiles_rule_out_no_link(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        # 255 is the most a range can count: the large sets go beyond it.
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(rng.integers(0, 3) * 2)
        other = np.concatenate([base[: int(n * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.3)), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        same = len(np.intersect1d(a, b))
        for percent in (80, 90):
            if 100 * same >= percent * (len(a) + len(b) - same):
                assert jaccard_join.may_link(jaccard_join.profile(a), len(a), jaccard_join.profile(b), len(b), percent)
    far = [jaccard_join.profile(rng.integers(0, 1 << 64, 1000, dtype=np.uint64)) for _ in range(2)]
    assert not jaccard_join.may_link(far[0], 1000, far[1], 1000, 80)
