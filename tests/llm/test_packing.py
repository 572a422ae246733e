import os
import random
import zlib

import numpy as np
import pytest
from snapscope.llm import packing
from snapscope.llm.queries import vocabulary

from tests.llm.cases import documents, odd_texts, prose


def check_plan(histogram, capacity):
    runs = packing.plan(histogram, capacity)
    bins, ranks = {}, {}
    for length, rank, count, first, offset in runs:
        ranks.setdefault(length, []).extend(range(rank, rank + count))
        for k in range(count):
            bins.setdefault(first + k, []).append((offset, length))
    assert {n: len(r) for n, r in ranks.items()} == histogram and all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_plans_are_gapless_whole_and_small():
    r = random.Random(2)
    for _ in range(30):
        histogram = {n: r.randrange(1, 60) for n in r.sample(range(1, 65), r.randrange(1, 40))}
        bins = check_plan(histogram, 64)
        least = max(-(-sum(n * c for n, c in histogram.items()) // 64), sum(c for n, c in histogram.items() if n > 32))
        assert least <= bins <= least * 1.23 + 1
    assert check_plan({1024: 5_000_000 // 1024}, 1024) and len(packing.plan({3: 10**9, 700: 10**9, 324: 10**6}, 1024)) < 2000


def test_ids_are_those_of_the_tokenizers_library(spark):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    other = Tokenizer.from_file(os.path.splitext(vocabulary())[0] + ".json")
    other.encode_special_tokens = True
    encode = packing.encoder(vocabulary())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for text in [r.text for r in rows] + [t or "" for t in odd_texts()] + ["<|endoftext|> a", "don't we'll\u00a0x  \n\n y \u200b\U0001f600"]:
        assert list(other.encode(text, add_special_tokens=False).ids) == encode(text)


def test_pieces_of_odd_documents(spark):
    texts = odd_texts() + [prose(k, 5) for k in range(200)]
    out = packing.pack_documents(documents(spark, texts + texts[:3], list(range(len(texts))) + [0, 0, None]), vocabulary(), 64).collect()
    encode = packing.encoder(vocabulary())
    sequences, by_doc = {}, {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 64
    for i, text in enumerate(texts):
        if i:
            n, pieces = len(encode(text or "")) + 1, sorted(by_doc[i])
            assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(x for _, _, x in pieces) == n
            assert all(x == 64 for _, _, x in pieces[1:]) and [s for _, s, _ in pieces] == [sum(x for _, _, x in pieces[:k]) for k in range(len(pieces))]
    assert len(by_doc[0]) == 3 and len(by_doc[None]) == 1
    assert packing.pack_documents(documents(spark, []), vocabulary()).count() == 0


def test_markers_in_a_text_get_the_ids_of_the_tokenizers_library(spark):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    other = Tokenizer.from_file(os.path.splitext(vocabulary())[0] + ".json")
    texts = ["x <|endoftext|> a", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b <|endoftext|", "<|fim_prefix|> <|ENDOFTEXT|>", *(t or "" for t in odd_texts())]
    got = {r.doc_id: r for r in packing.tokenised(documents(spark, texts), vocabulary(), 1 << 20).collect()}
    for i, text in enumerate(texts):
        ids = [*other.encode(text, add_special_tokens=False).ids, packing.END]
        assert (got[i].length, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
