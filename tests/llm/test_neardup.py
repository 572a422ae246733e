import random

import numpy as np
import pytest
from snapscope.llm import neardup
from snapscope.llm.components import components

from tests.llm.cases import documents, odd_texts, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, width, percent=80):
    sets = []
    for t in texts:
        w = (t or "").translate(LOWER).encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(n, rate, seed=1):
    r = random.Random(seed)
    base = prose(seed, 160).split()
    out = []
    for _ in range(n):
        words = list(base)
        for k in range(len(words)):
            if r.random() < rate * r.random():
                words[k] = f"z{r.randrange(9999)}"
        out.append(" ".join(words[: len(words) - r.randrange(20)]))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_agrees_with_brute_force(spark, width):
    line = "this line of several words is in every one of these texts "
    texts = odd_texts() + near_copies(50, 0.08) + near_copies(20, 0.02, 2) + [line + prose(500 + k, 12) for k in range(30)] + ["One two", "one TWO", "one two three", "Ä b", "ä b"]
    got = {r.doc_id: r for r in neardup.near_duplicates(documents(spark, texts), width).collect()}
    for i, (n, smallest) in enumerate(brute(texts, width)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, smallest, smallest == i)


def test_blocks_and_hot_lists_lose_no_link(spark, monkeypatch):
    for name, value in (("HOT_LIST", 8), ("LIST_BLOCK", 7), ("SET_BLOCK", 6), ("SET_BLOCK_SHINGLES", 900)):
        monkeypatch.setattr(neardup, name, value)
    texts = near_copies(60, 0.1) + near_copies(30, 0.05, 3) + [prose(k, 40) for k in range(20)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts), 4).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute(texts, 4)]


def test_repeated_rows_null_ids_and_empty_table(spark):
    a, b = prose(1, 60), prose(2, 60)
    docs = documents(spark, [a, a, a, b, None, "", a], [5, 5, 3, None, None, 9, None])
    got = neardup.near_duplicates(docs, 4).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("5", "3", False)] * 2 + [("3", "3", True), ("None", "None", True), ("None", "None", True), ("9", "9", True), ("None", "3", False)])
    out = neardup.deduplicated(docs, 4)
    assert sorted(str(r.text)[:5] for r in out.collect()) == sorted([a[:5], b[:5], "None", ""]) and out.columns == docs.columns
    assert neardup.near_duplicates(docs.limit(0), 4).count() == 0
    twice = documents(spark, [b, b], [7, 7])
    assert neardup.deduplicated(twice, 5).count() == 1


def test_unlike_texts_of_one_id_are_told_apart(spark):
    x, y, z = prose(11, 60), prose(12, 60), prose(13, 60)
    near = near_copies(3, 0.01, 14)
    docs = documents(spark, [x, y, y, z, None, *near, None, None], [7, 7, 3, 7, 7, 8, 8, None, None, 7])
    texts = [r.text for r in neardup.deduplicated(docs, 4).collect()]
    assert sorted(t for t in texts if t and t not in near) == sorted([x, y, z]) and texts.count(None) == 3
    assert len([t for t in texts if t in near]) == 1
    assert sorted(r.text for r in neardup.deduplicated(documents(spark, [x, y], [7, 7]), 5).collect()) == sorted([x, y])
    assert neardup.deduplicated(documents(spark, near, [None] * 3), 4).count() == 1


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (-5, 300), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[202] == 200 and got[300] == -5


def test_overlaps_of_many_sets():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 9000, 1500).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = neardup.overlaps(sets)
    assert all(got[i, j] == want[i][j] for i in range(9) for j in range(9) if i != j)


def test_components_of_hot_nodes_chains_and_repeats(spark, monkeypatch):
    monkeypatch.setattr("snapscope.llm.common.HOT_ROWS", 20)
    r = random.Random(8)
    ids = [r.randrange(-(2**62), 2**62) for _ in range(900)]
    edges = [(ids[k], ids[k + 1]) for k in range(200)] + [(ids[300], ids[300 + k]) for k in range(150)] * 2 + [(ids[r.randrange(500, 900)], ids[r.randrange(500, 900)]) for _ in range(300)]
    r.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {x.node: x.root for x in components(frame).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(frame.limit(0)).count() == 0


def test_few_stages(spark):
    """The driver keeps plans and records of all stages, so their number is part of what the operator costs."""
    context = spark.sparkContext
    context.setJobGroup("near-duplicates", "counted")
    docs = documents(spark, [t for k in range(6) for t in near_copies(12, 0.01, k)] + [prose(100 + k, 90) for k in range(40)])
    neardup.near_duplicates(docs).collect()
    jobs = context.statusTracker().getJobIdsForGroup("near-duplicates")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 70
