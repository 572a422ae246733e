import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from snapscope.llm import bpe
from snapscope.llm.queries import QUERIES, multilingual_vocabulary

from tests.llm.cases import documents, odd_texts, prose

regex, tiktoken = pytest.importorskip("regex"), pytest.importorskip("tiktoken")


def merged(piece: bytes, ranks: dict) -> list:
    """Byte pairs merged one by one, the least rank first."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def ranks():
    import base64

    with open(multilingual_vocabulary()[0], "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def brute(text, ranks):
    return [i for m in regex.findall(multilingual_vocabulary()[1], text) for i in merged(m.encode(), ranks)]


def test_ids_are_those_of_merges_within_each_match(ranks):
    r = random.Random(3)
    signs = "ab'sé日本語ひカ한1٣ \n\t　 。!<|>-_́'llre\x1c\x85\U0001f600"
    for _ in range(200):
        text = "".join(r.choice(signs) * r.choice([1, 1, 2, 7]) for _ in range(r.randrange(60)))
        want = brute(text, ranks)
        assert all(bpe.encode(text, *multilingual_vocabulary(), long).tolist() == want for long in (1, 2, 5, 20, 1 << 16))


def test_cuts_of_long_texts_change_nothing():
    by_pattern, _ = bpe.encodings(*multilingual_vocabulary())
    for text in (prose(1, 60_000), "é" * 200_000, "日本語。" * 50_000, ("x" * 70_000 + " " * 3) * 4, " " * 300_000 + "x", "a \n" * 90_000, "=" * 200_000):
        assert bpe.encode(text, *multilingual_vocabulary()).tolist() == by_pattern.encode_ordinary(text)
    assert max(len(p) for one, p in bpe.matches_apart(prose(1, 100_000), 1000) if not one) < 1100


def test_very_long_white_space_is_one_match():
    run = "\n" * 1_500_000
    by_pattern, whole = bpe.encodings(*multilingual_vocabulary())
    assert bpe.encode("a" + run + " b", *multilingual_vocabulary()).tolist() == [
        *by_pattern.encode_ordinary("a"), *whole.encode_ordinary(run), *by_pattern.encode_ordinary(" b")]


def test_round_trip_of_odd_documents(spark, ranks):
    texts = odd_texts() + ["<|endoftext|> a"]
    docs = documents(spark, texts + texts[:2], [*range(len(texts)), 0, None])
    vocabulary = multilingual_vocabulary()
    out = bpe.decoded(bpe.encoded(docs, *vocabulary), *vocabulary).collect()
    assert len(out) == len(texts) + 2 and set(out[0].asDict()) == {*docs.columns, "ids", "bytes"} - {"text"}
    for r in out:
        if r.doc_id:
            text = texts[r.doc_id]
            assert bytes(r.bytes) == text.encode()
            if len(text) < 5000:
                assert np.frombuffer(r.ids, "<u4").tolist() == brute(text, ranks)
        else:
            assert bytes(r.bytes) == bytes(r.ids) == b""
    assert bpe.encoded(documents(spark, []), *vocabulary).count() == 0
    broken = spark.range(1).select("id", F.unhex(F.lit("61FF62")).cast("string").alias("text"))
    assert bytes(bpe.decoded(bpe.encoded(broken, *vocabulary), *vocabulary).first().bytes) == "a�b".encode()
    # An id may end inside a character.
    assert bpe.decoded(bpe.encoded(documents(spark, ["\U0001f600"]), *vocabulary).selectExpr("substring(ids, 1, 4) AS ids"), *vocabulary).first().bytes


def test_query(spark, ranks):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = QUERIES["op11_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if len(text) < 3000:
            ids = np.array(brute(text, ranks), "<u4")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
