"""The stages of the corpus pipeline beside plain versions of them."""

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline
from brute import joined, shingles
from marketlens.llm import secret_scan

SCHEMA = "doc_id long, text string, source string"


def least_rows(rows):
    """Rows that stay: of each group the one with the least id; of those that are left, any with that id."""
    sets, links = [shingles(t, 5) for _, t, _ in rows], []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                links.append((a, b))
    groups = collections.defaultdict(list)
    for row, c in joined(range(len(rows)), links).items():
        groups[c].append(rows[row])
    return [min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()], list(groups.values())


def changed(words, places):
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_near_copies_match_brute_force(spark, docs_of):
    rng, rows = random.Random(9), []
    for size in (3, 6, 20, 60, 150, 400):
        base = [f"b{size}x{i}" for i in range(size)]
        for _ in range(25):
            rows.append((rng.randrange(200), changed(base, set(rng.sample(range(size), rng.randint(0, max(1, size // 25))))), rng.choice("ab")))
    long = [f"w{i}" for i in range(1000)]
    rows += [(1001, " ".join(long), "a"), (1000, changed(long, set(range(25, 1000, 50))), "a")]  # 0.82 on five words, 0.887 on three
    rows += [(2000, "one text of its own here", "a"), (2001, "one text of its own here", "a"), (2001, "another text with the same id", "a"), (2002, "twice the same row in here", "b"), (2002, "twice the same row in here", "b")]
    rows += [(None, "one text of its own here", "a"), (None, "a text that has no id at all", "b"), (3000, "", "a"), (3001, None, "a"), (3002, "", "a")]
    rng.shuffle(rows)
    left = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs_of(rows, SCHEMA), "").collect()]
    least, groups = least_rows(rows)
    assert sorted((r[0] is None, r[0] or 0) for r in left) == sorted(least)
    for g in groups:
        assert any(r in g for r in left)
    ids = [r[0] for r in left]
    assert 1000 in ids and 1001 not in ids and ids.count(2002) == 1
    assert [r[1] for r in left if r[0] == 2001] == ["another text with the same id"]
    assert corpus_pipeline.drop_near_copies(spark, docs_of([], SCHEMA), "").collect() == []


def test_secrets_and_lengths(spark, docs_of):
    key = "abcdefgh2345ijklmnop67qrstuvwxyz"[::3] + "q7w2e5r4t6y3u"
    texts = ["plain words", f"key={key} end", "password=hunter2hunter2x and é", "", None]
    docs = docs_of([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    for r in corpus_pipeline.redact_secrets(spark, docs, "").collect():
        text = texts[r["doc_id"]]
        if text is None:
            assert (r["text"], r["n_chars"]) == (None, 7)
            continue
        wanted, done = "", 0
        for a, _, b in secret_scan.spans_of(text):
            wanted += text[done:a] + ("[SECRET]" if a > done or not wanted else "") if b > done else ""
            done = max(done, b)
        assert (r["text"], r["n_chars"]) == (wanted + text[done:], len(wanted + text[done:]))


def test_mixed_rows_are_rows_of_the_input(spark, docs_of):
    rows = [(i, "w " * (3 + i % 7), "abc"[i % 3]) for i in range(300)]
    left = collections.Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, docs_of(rows, SCHEMA), "").collect())
    assert set(left) <= set(rows) and max(left.values()) <= 2


def test_token_ids(spark, docs_of):
    tiktoken, files = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(files.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["two  words", "漢字 naïve", "", "don't"]
    for r in corpus_pipeline.encode(spark, docs_of([(i, t, "a") for i, t in enumerate(texts)], SCHEMA), "").collect():
        ids = encoder.encode_ordinary(texts[r["doc_id"]])
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_rejected_languages_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = corpus_pipeline.identify_language(spark, docs, sf_dir).collect()
    whole = collections.Counter(map(tuple, docs.collect()))
    kept = collections.Counter(map(tuple, left))
    assert not kept - whole and all(not re.search(r"[^\W\d_]", r[1] or "") for r in (whole - kept) if len(r[1] or "") < 10)
