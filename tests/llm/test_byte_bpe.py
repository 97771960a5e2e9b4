import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from marketlens.llm import byte_bpe  # noqa: E402
from marketlens.llm.texts import buffers  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    texts = ["", " ", "  ", "\n", "a", "don't we'll they're I'd 's ''s !'s x''ll it'sa 'S", "  two  blanks ", "tab\t\tx  y　z\x1cq\x85r", "a\n\n b\r\n  c",
             "naïve Überraschung señor 12345 ①②½ x²", "😀😀 👩‍👩‍👧 é", "漢字かな交じり文 한국어", "<|endoftext|> [SECRET]", "a" * 3000, " " * 500 + "x", "'" * 7 + "t", "ab'", "ab' ", "\x00\x01",
             "'ll", "x'r", "x're", "x'rea", "'t't't", " 't", "\n't"]
    pieces = ["the", "'", "s", " ", "  ", "\n", "é", "9", "!", "'ll", "Über", " ", "x" * 70, "ing", "\t", "漢"]
    return texts + ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)]


def test_ids_match_the_library(encoder):
    texts = odd_texts()
    merges = byte_bpe.Merges(byte_bpe.load_ranks(PATH))
    for part in (texts, texts[::-1]):  # the second pass meets remembered words
        data, offsets = buffers(pa.array(part))
        for text, (ids, decoded) in zip(part, merges.round_trip(data, offsets), strict=True):
            assert ids.tolist() == encoder.encode_ordinary(text), text
            assert decoded == text.encode()


def test_remembered_words_are_checked(encoder):
    merges = byte_bpe.Merges(byte_bpe.load_ranks(PATH))
    data, offsets = buffers(pa.array(["hello worlds"]))
    list(merges.round_trip(data, offsets))
    merges.first[:] = 0  # as if two words had one hash
    (ids, decoded), = merges.round_trip(data, offsets)
    assert decoded == b"hello worlds" and ids.tolist() == encoder.encode_ordinary("hello worlds")


def test_queries_stay_within_the_memory_of_the_database(encoder):
    rng = random.Random(4)
    merges = byte_bpe.Merges(byte_bpe.load_ranks(PATH))
    words = list({"".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(13)) for _ in range(50_000)})
    for word, ids in list(zip(words, merges.contract([w.encode() for w in words]), strict=True))[::500]:
        assert ids.tolist() == encoder.encode_ordinary(word)
    ids = np.array([rng.randrange(len(merges.tokens)) for _ in range(4_000_000)], np.int32)
    cuts = np.array([0, 0, 3, 3_900_000, 3_900_000, len(ids)])
    assert merges.decode(ids, cuts) == [b"".join(merges.tokens[i] for i in ids[a:b]) for a, b in zip(cuts, cuts[1:])]


def test_round_trip_and_digests(spark, docs_of, encoder):
    content, texts = byte_bpe.load_ranks(PATH), odd_texts()[:60]
    docs = docs_of([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, None), (5, "again", "y")], "doc_id long, text string, ids string")
    encoded = byte_bpe.encode(docs.drop("ids"), content)
    back = {r["doc_id"]: r["bytes"] for r in byte_bpe.decode(encoded, content).collect() if r["doc_id"] not in (None, 5)}
    assert back == {i: t.encode() for i, t in enumerate(texts) if i != 5}
    rows = byte_bpe.digests(docs, content).collect()
    assert len(rows) == len(texts) + 2 and "ids" in rows[0].asDict()
    for r in rows:
        if r["doc_id"] == 9:
            ids = np.array(encoder.encode_ordinary(texts[9]), "<u4")
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[9].encode()).hexdigest()
        if r["doc_id"] is None:
            assert (r["n_tokens"], r["decoded_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert byte_bpe.digests(docs_of([]), content).collect() == []
