import hashlib
import random

import numpy as np
import pytest
from snapscope.llm import suffix_dedup

from tests.llm.cases import documents, odd_texts, prose


def brute(texts):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for s in range(len(t) - 199):
            seen[t[s : s + 200]] = seen.get(t[s : s + 200], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def shared_texts():
    r = random.Random(5)
    passage, line = prose(70, 60), "All of this line is common to many texts and is long enough for an anchor of its own. "
    texts = [prose(k, 50) + passage[r.randrange(60) :] + prose(k + 50, 40) for k in range(12)]
    texts += [prose(100 + k, 30) + line + prose(200 + k, 30) for k in range(25)]
    base = prose(300, 150).split()
    for k in range(20):
        words = list(base)
        for _ in range(8):
            words[r.randrange(len(words))] = f"z{r.randrange(999)}"
        texts.append(" ".join(words))
    return texts + ["ab" * 300, "x" * 199, "x" * 200, "x" * 201, "y" * 200, prose(400, 40) + " " + prose(400, 40)]


@pytest.mark.parametrize("many", [5000, 3])
def test_agrees_with_brute_force(spark, monkeypatch, many):
    # The small bound sends anchors with four contexts or more the way of those with very many.
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    texts = shared_texts() + odd_texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_rows_ids_and_nulls(spark):
    a, b = prose(1, 80), prose(2, 80)
    docs = documents(spark, [a, a, b, b[:150], None], [1, 1, None, None, None])
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.removal_report(docs).collect())
    assert got == sorted([(len(a), len(a))] * 2 + [(len(b), 0), (150, 0), (0, 0)])
    assert suffix_dedup.removal_report(docs.limit(0)).count() == 0


def test_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "PLACE", np.uint64((1 << 11) - 1))
    parts = list(suffix_dedup.parts_of(prose(9, 2000).encode()))
    text = prose(9, 2000).encode()
    starts = [at + s for at, part in parts for s in range(len(part) - 199)]
    assert starts == list(range(len(text) - 199)) and all(len(p) <= 1 << 11 for _, p in parts)
    found = [(at + a, at + b) for at, part in parts for _, _, _, a, b in zip(*suffix_dedup.anchors([part]))]
    assert [s for a, b in found for s in range(a, b + 1)] == starts


def test_stage_keeps_columns_and_cuts_texts(spark):
    p = prose(8, 60)
    docs = documents(spark, ["head " + p, p + " tail", "é" * 300, "free of it"])
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    assert out[0].text == "head " and out[1].text == " tail" and out[3].text == "free of it" and out[0].spans == "a"


def test_equal_hashes_of_unequal_bytes_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    a, b = b"a" * 200, b"b" * 200
    assert suffix_dedup.repeated_windows([(0, 1, a), (0, 1, b), (0, 1, a)], [0, 0, 0]).tolist() == [True, False, True]


def test_one_anchor_with_more_bytes_than_a_part():
    texts = [bytes([97 + k % 7]) * 200 + b"%07d" % k for k in range(6000)]
    marks = suffix_dedup.repeated_windows([(0, 1, t) for t in texts], [0] * len(texts))
    assert marks.all() and sum(map(len, texts)) > suffix_dedup.PART
