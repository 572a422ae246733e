import hashlib
import math
import zlib

import pytest
from snapscope.llm import importance

from tests.llm.cases import documents, odd_texts, prose


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if "a" <= c <= "z" or "0" <= c <= "9" or ord(c) > 127:
            word += c
        elif "A" <= c <= "Z":
            word += c.lower()
        elif word:
            out.append(word)
            word = ""
    return out


def brute(docs, target, grams=1, buckets=10_000, least=20, percent=10):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, grams + 1) for k in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text):
                counts[b] += 1
    all_s, all_t, rows = sum(s), sum(t), []
    for doc_id, text in docs:
        found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    ranks = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault(r[:4], []).append(k + 1)
    out = [(*r[:4], (ranks.get(r[:4]) or [None]).pop(0) if r[4] and ranks.get(r[:4]) else None) for r in rows]
    return sorted(out, key=str)


@pytest.mark.parametrize("grams, buckets", [(1, 10_000), (2, 50)])
def test_rows_of_odd_documents(spark, grams, buckets):
    texts = odd_texts() + [prose(k, 15 + k % 12, 40) for k in range(120)]
    ids = [*range(len(texts))]
    # One id and text a third of all rows, an id with unlike texts, a null id.
    texts, ids = texts + [prose(500, 30, 40)] * 70 + [prose(501, 30, 40), prose(502, 31, 40), prose(503, 40, 40)], ids + [9000] * 70 + [9001, 9001, None]
    target = [prose(k, 25, 20) for k in range(9)] + [None, "", "one"]
    frame, aim = documents(spark, texts, ids), documents(spark, target)
    for percent in (0, 35, 100):
        got = importance.resampled(frame, aim, grams, buckets, percent=percent).drop("n_words").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(list(zip(ids, texts)), target, grams, buckets, percent=percent)


def test_empty_tables(spark):
    nothing, some = documents(spark, []), documents(spark, [prose(k, 30) for k in range(20)])
    assert importance.resampled(nothing, some).count() == 0
    drawn = importance.resampled(some, nothing).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in drawn) == [1, 2]
    assert importance.resampled(documents(spark, [None, ""]), nothing).where("rank IS NULL AND n_features = 0 AND weight = 0").count() == 2


def test_bisection(spark):
    values = [-5, -5, -5, 0, 7, 7, 10**12]
    rows = spark.createDataFrame([(v,) for v in values], "x long")
    for wanted in range(1, 8):
        assert importance.least_reaching(rows, "x", wanted) == sorted(values)[wanted - 1]
    assert importance.least_reaching(rows, "x", 8) is None
