import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

import brute
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.llm import language_id, mixing, secret_scan, toxicity, url_filters
from marketlens.llm.texts import fold, held_out


def test_folds(docs_of):
    rows = docs_of([(i, "") for i in (0, 7, -3, 10**12)] + [(None, "")])
    for r in rows.select("doc_id", fold(rows.doc_id).alias("f"), held_out(rows.doc_id).alias("h")).collect():
        if r["doc_id"] is None:
            assert r["h"]
        else:
            assert r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["h"] == (r["f"] == 0)


# Mixing


def targets_of(sizes, share=1.5, most=2.0):
    """{source: target} by dealing the excess again until no source is above its bound."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, free, total = {}, set(order), share * sum(sizes.values())
    while free:
        level = total / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in full}
        total -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def test_mix(spark, docs_of):
    rng, rows = random.Random(2), []
    for s, n in [("a", 300), ("b", 40), ("Z", 40), ("é", 30), (None, 20), ("c", 5), ("empty", 2)]:
        for _ in range(n):
            rows.append((len(rows), " ".join("w" * rng.randint(1, 5) for _ in range(0 if s == "empty" else int(rng.paretovariate(1) * 20))), s))
    rows += [rows[0], rows[0], (None, "one two", "a"), (10**6, None, "a"), (10**6 + 1, " \t\x0b", "b")]
    docs = docs_of(rows, "doc_id long, text string, source string")
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    wanted = targets_of(sizes)
    got = mixing.taken(mixing.plan(docs)).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, count(t)) for i, t, _ in rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and np.allclose([r["target"] for r in own], wanted[s])
        assert abs(sum(r["taken"] for r in own) - wanted[s]) <= 0.02 * wanted[s] + 5
        assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in own)
    again = mixing.taken(mixing.plan(docs.repartition(7))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(count(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.taken(mixing.plan(docs.limit(0))).collect() == []


def test_rounding_keeps_probabilities(docs_of):
    docs = docs_of([(i, "w " * (3 + i % 11), "a") for i in range(120)], "doc_id long, text string, source string")
    draws = [{r["doc_id"]: r["copies"] for r in mixing.plan(docs, share=0.4, seed=s).collect()} for s in range(4)]
    means = np.array([[d[i] for d in draws] for i in range(120)])
    assert set(means.ravel()) == {0, 1} and abs(means.mean() - 0.4) < 0.05
    assert 0.1 < means[::11].mean() < 0.7


def test_mix_is_native(docs_of):
    docs = docs_of([(1, "a b c", "x"), (2, "d e", "y")], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Secrets


def test_base_spans():
    text = 'x password="abcdefghijkl" Token: short api-key=aaaaaaaaaaaa ApiKey = 0123456789abcdef0 AKIA' + "A1" * 7 + " AKIA123 é" + "f" * 16 + " token: secret: abcdefghijklmn ſecret=abcdefghijklmn"
    got = [(secret_scan.KINDS[k], text[a:b]) for a, k, b in secret_scan.base_spans(text)]
    assert got == [("assign", 'password="abcdefghijkl'), ("assign", "ApiKey = 0123456789abcdef0"), ("hex", "0123456789abcdef0"), ("access", "AKIA" + "A1" * 7), ("hex", "f" * 16)]


def test_entropy():
    rng = random.Random(1)
    s = "".join(rng.choice("ABCdef123xyzQRS789+/") for _ in range(60))
    for width in (4, 20):
        plain = []
        for i in range(len(s) - width + 1):
            w = s[i : i + width]
            plain.append(-sum(w.count(c) / width * np.log2(w.count(c) / width) for c in set(w)))
        assert np.allclose(list(secret_scan.window_entropies(s, width)), plain)
    key = "kJ8sQ2xVb7LmZ4tRwY9pNc3H"
    assert secret_scan.entropy_spans(f"ab {key} cd") == [(3, 3, 3 + len(key))]
    assert secret_scan.entropy_spans("a" * 40 + " internationalisationalisation 12345678901234567890123 abcdefghijklmnopqrstuvwxyzABC0123456789") == []


def test_secrets_against_plain_search():
    rng = random.Random(12)
    pieces = ["password", "PassWd", "Secret", "ToKeN", "api_key", "APIkey", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIA1234567890ABCD", "0123abcd", "deadbeefcafe", "hunter2", "x/y+z", ".", "-", "_", "ſ", "é", "\n", "kJ8sQ2xVb7", "EXAMPLE", "00000000", "://"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert secret_scan.base_spans(text) == brute.base_secrets(text), text
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for n in range(150):
        some = [rng.choice(secret_scan.ALLOWED) if rng.random() < 0.06 else rng.choice("=_/-") if rng.random() < 0.05 else rng.choice(mixed[: rng.choice((26, 62))]) for _ in range(rng.randrange(150))]
        text = "key " + "".join(some) + " end"
        plain = brute.entropy_runs(text, secret_scan.CANDIDATE, secret_scan.INNER, secret_scan.CLASSES, secret_scan.ALLOWED, secret_scan.WINDOW)
        assert secret_scan.entropy_spans(text) == plain, text


def test_a_long_candidate_full_of_allowed_strings():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    piece = ["EXAMPLE" + "".join(rng.choice(letters) for _ in range(33)) for _ in range(1000)]
    started = time.monotonic()
    spans = secret_scan.entropy_spans("".join(piece * 10))
    assert time.monotonic() - started < 20  # 400 kB; by pairs of window and allowed string it takes minutes
    assert len(spans) > 5000 and all(b - a <= 33 for a, _, b in spans)


def test_no_short_text_is_passed_over():
    for text in ("f" * 16, "kJ8sQ2xVb7LmZ4tRwY9p", "a kJ8sQ2xVb7LmZ4tRwY9pNc3H", "token=abcdefghijkl"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert secret_scan.spans_of(text) and list(secret_scan.suspects(raw, np.array([0, len(raw)]))) == [0]


def test_repeated_rows_are_scanned_alike(docs_of):
    docs = docs_of([(1, "key kJ8sQ2xVb7LmZ4tRwY9pNc3H"), (1, "key kJ8sQ2xVb7LmZ4tRwY9pNc3H"), (1, "other")])
    found = sorted(len(r["secret_spans"]) for r in secret_scan.find_secrets(docs).collect())
    assert found == [0, 1, 1]


@pytest.mark.parametrize(("alphabet", "n", "share"), [
    ("0123456789", 20, 0.9), ("0123456789", 32, 0.95), ("abcdefghijklmnopqrstuvwxyz234567", 20, 0.9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32, 0.95),
    ("abcdefghijklmnopqrstuvwxyz0123456789", 32, 0.95), ("abcdefghijklmnopqrstuvwxyz", 32, 0.8),
])
def test_keys_of_one_letter_case(docs_of, alphabet, n, share):
    rng = random.Random(n)
    keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(300)]
    for before in ("", "key="):
        assert np.mean([bool(secret_scan.entropy_spans(f"{before}{k}")) for k in keys]) >= share
    words = "electroencephalographically counterrevolutionaries uncharacteristically INTERNATIONALIZATION_ERROR well-known-and-often-used"
    assert secret_scan.entropy_spans(words) == [] and secret_scan.entropy_spans("0" * 30) == []
    docs = docs_of([(i, f"key={k} end") for i, k in enumerate(keys[:40])])
    masked = [r["text"] for r in secret_scan.redact(docs).collect()]
    assert np.mean(["[SECRET]" in t for t in masked]) >= share - 0.1


def test_scan_and_redact(spark, docs_of):
    rng = random.Random(8)
    pieces = ["the word ", "é ", "password=", "hunter2hunter2x ", "token", ": ", "a1b2c3d4e5f60718 ", "AKIA", "ABCDEFGHIJKLMNOPQR ", "kJ8sQ2xVb7LmZ4tRwY9pNc3H ", "\n", "api_key='"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(300)] + ["", None, "plain " * 4000, "f" * 100_000]
    docs = docs_of([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, secret_spans int")
    got = {r["doc_id"]: [tuple(s) for s in r["secret_spans"]] for r in secret_scan.find_secrets(docs).collect()}
    assert got == {i: [(secret_scan.KINDS[k], a, b) for a, k, b in secret_scan.spans_of(t or "")] for i, t in enumerate(texts)}
    for r in secret_scan.digest(secret_scan.find_secrets(docs)).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in got[r["doc_id"]] if k != "entropy")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in got[r["doc_id"]])
        assert r["n_hex"] == sum(k == "hex" for k, _, _ in got[r["doc_id"]])
    for r in secret_scan.redact(docs).collect():
        spans, text = got[r["doc_id"]], texts[r["doc_id"]]
        assert r["text"] == text if not spans else "[SECRET]" in r["text"]
        if spans:
            outside = "".join(c for i, c in enumerate(text) if not any(a <= i < b for _, a, b in spans))
            assert r["text"].replace("[SECRET]", "") == outside
    assert secret_scan.find_secrets(docs.limit(0)).collect() == []


# URLs


def test_judged_urls(spark):
    urls = ["http://example.net/en/1", "https://a.Example.NET/de/1?x#y", "http://example.net", "http://x.org/fr/a", "http://notorg/fr/a", "ftp://a.b/x.net/en", "http://.net/", None, "no url", "http://example.com/de/", "HTTP://EXAMPLE.com/DE/",
            "a://b://c.net/", "http://é.example.net/en/é", "http://example.net:80/en/", "http://net/" + "a" * 20_000]
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filters.judge(rows).collect()}
    wanted = {}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        wanted[i] = (host, rule, verdict)
    assert got == wanted
    assert url_filters.judge(rows.limit(0)).collect() == []
    clashing = spark.createDataFrame([(1, urls[0], "h", "p"), (1, urls[0], "h", "p")], "page_id long, url string, HOST string, Verdict string")
    assert [(r["host"], r["verdict"]) for r in url_filters.judge(clashing).collect()] == [("example.net", "allow")] * 2


def test_globs():
    rng, letters = random.Random(6), "ab/."
    patterns = ["".join(rng.choice(["a", "b", "/", ".", "*", "**"]) for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["a" * 70, "a" * 64 + "*b"]
    strings = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(200)] + ["", "a" * 70, "a" * 64 + "xyb"]
    raw = [s.encode() for s in strings]
    hit = url_filters.Globs(patterns).matches(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for k, p in enumerate(patterns):
        regex = re.compile("".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.findall(r"\*\*|.", p)), re.S)
        assert [bool(h) for h in hit[:, k]] == [bool(regex.fullmatch(s)) for s in strings], p


# Languages and toxicity

SYLLABLES = {"xa": ["ka", "lo", "mi", "tu"], "yb": ["sch", "ung", "ein", "der"], "zc": ["ción", "que", "ñe", "os"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, rng.randint(3, 60)).upper() if i % 9 == 0 else prose(rng, lang, rng.randint(3, 60)), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1001, None, "xa"), (1002, "", "xa"), (1003, "123 !?", "xa"), (1004, "kalo", None), (None, "kalomi", "xa"), (1005, "漢字漢字 かな", None)]
    docs = docs_of(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample=60)
    got = language_id.predict(docs.withColumnRenamed("lang", "score"), model).collect()
    right = [r["lang_pred"] == dict((i, x) for i, _, x in rows)[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean(right) > 0.97 and len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True) for i in (1001, 1002, 1003))
    assert by[1004]["lang_pred"] == "xa" and by[1005]["rejected"] and not by[5]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.predict(docs.limit(0), model).collect() == []
    none = language_id.predict(docs, language_id.fit(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_held_out_rows_teach_nothing(docs_of):
    rows = [(i, "kalo mitu", "xa") if zlib.crc32(str(i).encode()) % 5 else (i, "sch ung", "yb") for i in range(60)]
    assert set(language_id.fit(docs_of(rows, "doc_id long, text string, lang string")).languages) == {"xa"}


def test_odd_rows_do_not_take_a_centroid():
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(np.eye(20)[:3], 200, axis=0), np.eye(20)[10:14]]) + 0.03 * rng.standard_normal((604, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, own = language_id.spherical_means(x, 3)
    assert sorted(np.argmax(centres[:, :3], axis=1)) == [0, 1, 2] and np.bincount(own).min() >= 190
    same, _ = language_id.spherical_means(x, 3)
    assert np.array_equal(centres, same)
    one, own = language_id.spherical_means(np.repeat(x[:1], 9, axis=0), 3)
    assert len(one) == 1 and set(own) == {0}


def test_a_hot_language_is_ranked_as_a_whole(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "if(id % 50 = 0, 'yb', 'xa') as lang")
    got = language_id._first_of_language(rows, [F.xxhash64("doc_id"), F.col("doc_id")], 70)
    plain = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where("place <= 70")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_spherical_means():
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(3), 10, axis=0) + 0.05 * rng.standard_normal((30, 3))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    _, own = language_id.spherical_means(x, 3)
    assert len({tuple(own[i : i + 10]) for i in (0, 10, 20)}) == 3 and all(len(set(own[i : i + 10])) == 1 for i in (0, 10, 20))


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    counts = np.zeros((2, toxicity.GRAMS), np.int64)
    np.add.at(counts[0], rng.integers(0, toxicity.GRAMS, 5000), 1)
    counts[1] = counts[0]
    assert np.allclose(toxicity.learn(counts), 0)
    counts[1] = 0
    other = np.unique(rng.integers(0, toxicity.GRAMS, 300))
    counts[1, other] = 50
    ratios = toxicity.learn(counts)
    assert ratios[other].mean() > 1 and np.isfinite(ratios).all()


@pytest.mark.parametrize("empty", [False, True])
def test_toxicity(spark, docs_of, empty):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = prose(rng, "xa", rng.randint(20, 60)).split()
        for _ in range(1 + len(words) // 15 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["wretch", "vermin", "Wretch!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "!!"), (1003, "wretch " * 9000)]
    labels += [(1000, 1), (5, None), (0, 1)]
    docs, marks = docs_of(rows), docs_of(labels[: 0 if empty else None], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    if not empty:
        held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
        assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.95
        assert got[1003]["predicted"] == 1
        assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"]
