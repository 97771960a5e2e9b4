import numpy as np
import pytest

from brute import joined
from marketlens.llm import ann_graph, embedding_dedup

NAN, INF = float("nan"), float("inf")


def clustered(rng, n, size=24, groups=6, noise=0.12):
    centres = rng.standard_normal((groups, size))
    x = centres[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, size))
    return x * rng.uniform(0.2, 3, (n, 1))


def table(spark, x, extra=()):
    rows = [(i * 5, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


ODD = [(100_001, None), (100_002, []), (100_003, [0.0] * 24), (100_004, [1.0] * 23 + [None]), (100_005, [NAN] * 24), (100_006, [INF] + [1.0] * 23), (100_007, [1.0, 2.0])]


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = np.concatenate([clustered(rng, 150), rng.standard_normal((100, 24))])
    x[40:60] = x[40]
    x[60] = 2 * x[40]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    ids = [i * 5 for i in range(len(x))]
    component = joined(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(links))])
    got = {r["vec_id"]: r for r in embedding_dedup.classes(table(spark, x, ODD)).collect()}
    assert len(got) == len(x) + len(ODD)
    found, there = sum(r["n_links"] for r in got.values()), int(links.sum())
    assert 0.99 * there <= found <= there
    assert all(got[i]["n_links"] <= links[k].sum() and got[i]["component_id"] >= component[i] for k, i in enumerate(ids))
    assert np.mean([got[i]["component_id"] == component[i] for i in ids]) > 0.99
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in ODD)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_no_rows_and_repeated_ids(spark):
    assert embedding_dedup.classes(table(spark, [])).collect() == []
    rows = embedding_dedup.classes(table(spark, [], [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [2.0, 0.0]), (8, [0.0, 1.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 2, 0, False), (3, 2, 3, True), (3, 2, 3, True), (8, 0, 8, True)]


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([clustered(rng, 2500, noise=0.5), rng.standard_normal((500, 24))])
    x[100:400] = x[100]  # one common vector
    rows = table(spark, x, ODD)
    got = ann_graph.search(rows, rows.where("vec_id % 100 = 0"), shards=2, beam=64).collect()
    ids = np.arange(len(x)) * 5
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [i for i in ids if i % 100 == 0]
    recall = []
    for q, rows in by.items():
        scores = x @ x[q // 5]
        order = [ids[i] for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert rows == [r for r in sorted(rows, key=lambda r: (-r[2], r[1]))]
        assert np.allclose([r[2] for r in rows], [scores[r[1] // 5] for r in rows], rtol=1e-12)
        recall.append(len({r[1] for r in rows} & set(order)) / 20)
    assert np.mean(recall) > 0.95


def test_few_candidates(spark):
    rows = table(spark, [], [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [0.5, 0.5]), (40, None), (23, [1.0, 0.0, 0.0])])
    got = ann_graph.search(rows, rows.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 20, 1.0), (0, 2, 21, 0.5), (0, 3, 22, 0.5), (20, 1, 0, 1.0), (20, 2, 21, 0.5), (20, 3, 22, 0.5)]
    assert ann_graph.search(rows.limit(0), rows.limit(0)).collect() == []
