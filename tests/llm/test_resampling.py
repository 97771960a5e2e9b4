import hashlib
import math
import random
import re
import sys
import zlib

from pyspark.sql import functions as F

from marketlens.llm import resampling


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def by_hand(rows, target, longest, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t, out = [0] * buckets, [0] * buckets, []
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for f in features(x, longest)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    for i, x in rows:
        n, found = features(x, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r, rank.get(id(r))) for r in out]


def order(r):
    return repr(r)


def test_resample(spark, docs_of):
    rng = random.Random(4)
    words = ["wort", "été", "Haus", "x", "42", "日本", "a", "the"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "\x00", "--"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " .\t"), (None, "the été " * 30), (503, "Aa" * 40000), (504, "very long " * 70000)]
    target = ["the été the haus", None, "42 42"]
    docs = docs_of(rows).repartition(5).withColumn("Score", F.lit("mine")).withColumn("extra", F.lit(1))
    for longest in (1, 3):
        got = resampling.resample(docs, docs_of([(0, t) for t in target]), 20, 10, longest, 101).collect()
        found = [(r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got]
        assert sorted(found, key=order) == sorted(by_hand(rows, target, longest, 101, 20, 10), key=order)
        assert {r["extra"] for r in got} == {1}


def test_resample_odd_tables(docs_of):
    text = "one two " * 15
    same = resampling.resample(docs_of([(1, text)] * 10), docs_of([(0, text)])).collect()
    assert sorted(r["rank"] or 0 for r in same) == [0] * 9 + [1] and len({r["score"] for r in same}) == 1
    empty = docs_of([])
    assert resampling.resample(empty, docs_of([(0, text)])).count() == 0
    alone = resampling.resample(docs_of([(1, text), (2, "one")]), empty).collect()
    assert {r["doc_id"]: r["n_features"] for r in alone} == {1: 30, 2: 1}


def test_runs_join(monkeypatch):
    monkeypatch.setattr(resampling, "RUN", 7)
    text = "A b! c d e f g h i j k"
    runs = list(resampling.bucket_runs(text, resampling.patterns(2), 1000))
    assert [len(r) for r in runs] == [7, 4, 7, 3]
    wanted = [zlib.crc32(f.encode()) % 1000 for f in features(text, 2)[1]]
    assert [int(x) for r in runs for x in r] == wanted


def test_pieces_lose_and_repeat_nothing(monkeypatch):
    rng = random.Random(7)
    texts = [" ".join("x" * rng.choice([1, 2, 3, 40]) for _ in range(n)) for n in (0, 1, 2, 3, 50, 200)]
    for piece in (1, 5, 64):
        monkeypatch.setattr(resampling, "PIECE", piece)
        for text in texts:
            for n, scan in resampling.patterns(4).items():
                got = [int(x) for run in resampling.bucket_runs(text, {n: scan}, 1000) for x in run]
                words = text.split()
                assert got == [zlib.crc32(" ".join(words[i:i + n]).encode()) % 1000 for i in range(len(words) - n + 1)]
    assert max(len(p) for p in resampling.pieces(b"ab " * 1000, 2)) < 80


def test_no_interpreted_step_for_each_feature():
    """The check's budget is 900 CPU seconds a GB, nearly all of it the scan: a call for each feature took it beyond."""
    text, scans, calls = "Wort, haus " * 5000, resampling.patterns(), []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        found = sum(len(run) for run in resampling.bucket_runs(text, scans))
    finally:
        sys.setprofile(None)
    assert found == 10000 and len(calls) < 500
