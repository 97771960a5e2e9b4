import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import context_mixing as cm


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base_by_hand(rows):
    """doc_id -> (held out, tokens, known, training tokens, base score)."""
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    counts = Counter(t for i, x in rows if learned(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, x in rows:
        ts = tokens(x)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        out[i] = (not learned(i), len(ts), sum(counts[t] > 0 for t in ts), n, pytest.approx(base, rel=1e-9))
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["Der", "die", "haus", "the", "house", "été", "日本", "a", "ung.", "x" * 300]
    return [(i, " ".join(rng.choices(words, [9, 8, 1, 7, 2, 1, 1, 5, 1, 1], k=rng.randrange(40)))) for i in range(n)]


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "neverseen"), (904, "die haus " * 20000), (905, "w" * 200000), (None, "the house")]


def test_counts_and_base(docs_of, monkeypatch):
    monkeypatch.setattr(cm, "RANGE_TOKENS", 5000)
    rows = corpus(300) + ODD
    docs = docs_of(rows).repartition(5).withColumn("Score", F.lit("mine"))
    got = {r["doc_id"]: r for r in cm.score(docs).collect()}
    assert len(got) == len(rows)
    for i, wanted in base_by_hand(rows).items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == wanted
        assert r["score"] < 0 and math.isfinite(r["score"])
        size = len((dict(rows)[i] or "").encode())
        assert r["n_bytes"] == size
        assert r["bits_per_byte"] == (pytest.approx(-r["score"] / math.log10(2) / size) if size else None)
    again = {r["doc_id"]: r["score"] for r in cm.score(docs_of(rows).coalesce(1)).collect()}
    assert again == {i: pytest.approx(r["score"], rel=1e-4) for i, r in got.items()}


def test_probabilities_of_all_short_texts_sum_to_at_most_one(docs_of):
    rows = [(i, x) for i, x in corpus(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    words = sorted({t for _, x in rows for t in tokens(x) if t})
    asked = ["", "neverseen", *words, *[f"{a} {b}" for a in words for b in [*words, "neverseen"]]]
    ids = [i for i in range(10**4, 10**5) if zlib.crc32(str(i).encode()) % 5 == 1][: len(asked)]
    got = {r["doc_id"]: r["score"] for r in cm.score(docs_of(rows + list(zip(ids, asked)))).collect()}
    total = sum(10 ** got[i] for i in ids)
    assert 0.01 < total <= 1


def test_decisions_follow_the_text():
    words = np.array([5, 64 + 7, 5, cm._END], np.uint64)
    t = cm.Tokens(np.array([3, 1]), words, np.array([4, 0, 4, 9]), np.array([0, 0, 2, 0]))
    per, kind, outcome, slots = cm.decisions(t)
    assert per.tolist() == [8, 2, 1, 8]
    assert kind.tolist() == [*range(8), 0, 1, 0, *range(8)]
    assert outcome[:8].tolist() == [False, True, *[bool(5 >> b & 1) for b in range(5, -1, -1)]]
    assert outcome[8:11].tolist() == [False, False, True]
    for k in range(cm.CONTEXTS):
        assert (slots[k] >= cm._BOUNDS[k]).all() and (slots[k] < cm._BOUNDS[k + 1]).all()
    # The first tokens of both texts stand after the same things.
    assert slots[:, 0].tolist() == slots[:, 11].tolist()


def one_by_one(kind, outcome, odds):
    """The mix of one text, decision by decision."""
    block = [j // cm.BLOCK if j < cm.LATE else cm.LATE // cm.BLOCK + math.floor(math.log(j / cm.LATE) / math.log1p(cm.LATE_SHARE)) for j in range(len(kind))]
    weights = [[cm.START_WEIGHT] * odds.shape[1] for _ in range(cm.GATES)]
    hits, total = {}, 0.0
    for b in sorted(set(block)):
        mine = [j for j in range(len(kind)) if block[j] == b]
        changes, notes = {}, []
        for j in mine:
            x = max(-12, min(12, sum(w * s for w, s in zip(weights[kind[j]], odds[j]))))
            p = 1 / (1 + math.exp(-x))
            like = (kind[j], int(max(0, min(cm.REFINE_STEPS - 1, (x + 6) * 2))))
            h, n = hits.get(like, (0, 0))
            final = (p + (h + cm.REFINE_PRIOR * p) / (n + cm.REFINE_PRIOR)) / 2
            total += math.log(final if outcome[j] else 1 - final)
            changes.setdefault(kind[j], []).append([(outcome[j] - p) * s for s in odds[j]])
            notes.append((like, outcome[j]))
        for g, steps in changes.items():
            rate = cm.RATE / max(1, len(steps) / 16)
            weights[g] = [w + rate * sum(s[k] for s in steps) for k, w in enumerate(weights[g])]
        for like, y in notes:
            h, n = hits.get(like, (0, 0))
            hits[like] = (h + y, n + 1)
    return total


def test_mix_of_many_texts_is_that_of_each():
    rng = np.random.default_rng(2)
    per = np.array([1, 0, 33, 700, 5200])
    n = int(per.sum())
    kind, odds = rng.integers(0, cm.GATES, n).astype(np.uint8), rng.normal(0, 2, (n, 3)).astype(np.float32)
    outcome = rng.random(n) < 1 / (1 + np.exp(-odds.sum(1) / 2))
    got = cm.mix(per, kind, outcome, odds)
    ends = np.cumsum(per)
    for k, (a, b) in enumerate(zip(ends - per, ends)):
        assert got[k] == pytest.approx(one_by_one(kind[a:b].tolist(), outcome[a:b].tolist(), odds[a:b].astype(float)), rel=1e-3)
    # Weights that adapt do better than the first ones throughout.
    x = np.clip(odds[ends[3]:].sum(1) * cm.START_WEIGHT, -12, 12)
    still = np.log(1 / (1 + np.exp(np.where(outcome[ends[3]:], -x, x)))).sum()
    assert got[4] > still


def test_odd_tables(docs_of):
    assert cm.score(docs_of([])).count() == 0
    rows = [(1, "one two one"), (1, "one two one"), (1, "one two one")]
    same = cm.score(docs_of(rows), F.lit(True)).collect()
    assert len({(r["n_known"], r["train_tokens"], r["score"]) for r in same}) == 1 and same[0]["train_tokens"] == 12
    untaught = cm.score(docs_of(rows), F.lit(False)).first()
    assert (untaught["n_known"], untaught["train_tokens"], untaught["base_score"]) == (0, 0, 0.0)


def test_better_than_the_base_on_rows_held_out(spark, sf_dir):
    got = cm.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert got["s"] > 0.85 * got["b"]
