import pytest

from snapscope.operators import content_diff, keys
from snapscope.operators.content_diff import (
    content_diff as diff_of, one_sided_rows, overview, overview_plan, overview_summary, report_order,
)


def frame(spark, rows, schema="id INT, valor STRING"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("a,b,want", [
    ([(1, "a"), (2, "b"), (3, "c")], [(3, "c"), (1, "a"), (2, "b")], (3, 3, 0)),
    ([(1, "a"), (2, "b"), (4, "x")], [(1, "a"), (3, "c"), (4, "y")], (3, 3, 4)),
    ([(1, "a"), (1, "a"), (2, "b")], [(1, "a"), (2, "b")], (3, 2, 0)),
    ([(None, None)], [(None, None)], (1, 1, 0)),
    ([], [], (0, 0, 0)),
])
def test_content_diff(spark, a, b, want):
    assert tuple(diff_of(frame(spark, a), frame(spark, b)).first()) == want


def test_no_common_columns(spark):
    a, b = frame(spark, [(1, "a")]), frame(spark, [(1, "a")], "outro INT, descricao STRING")
    assert tuple(diff_of(a, b).first()) == (0, 0, -1)


def test_counter_names_may_be_data(spark):
    a, b = frame(spark, [(1, "x")], "rows_a INT, n_a STRING"), frame(spark, [(1, "y")], "rows_a INT, n_a STRING")
    assert tuple(diff_of(a, b).first()) == (1, 1, 2)
    assert sorted(r.side for r in one_sided_rows(a, b).collect()) == ["a", "b"]


def test_overview(spark):
    items_a, items_b = frame(spark, [(1, "x"), (2, "y")]), frame(spark, [(1, "x"), (2, "z")])
    a = {"items": items_a, "same": items_a, "other": items_a, "broken": items_a, "only_a": items_a}
    b = {"items": items_b, "same": items_a, "other": frame(spark, [(1,)], "q INT"), "broken": None}
    rows = {r.table_name: r for r in overview(spark, a, b).collect()}
    assert list(rows) == ["items", "same", "other", "broken"]
    assert (rows["items"].status, rows["items"].diff_count, rows["items"].row_count_a) == ("diff", 2, 2)
    assert (rows["other"].status, rows["other"].diff_count, rows["other"].row_count_b) == ("no_key", -1, 1)
    assert rows["broken"].status == "error" and rows["broken"].error
    assert overview_summary(overview(spark, a, b)).first().asDict() == {
        "total_tables": 4, "same_tables": 1, "diff_tables": 1, "no_key_tables": 1, "error_tables": 1}
    assert [r.table_name for r in report_order(overview(spark, a, b)).collect()] == ["items", "broken", "other"]
    few = overview_plan(a, b, ["items", "items", "  items  ", ""]).collect()
    assert [r.table_name for r in few] == ["items"]
    assert content_diff.overview_tables(a, b, ["nope"]) == []


def test_key_scores():
    assert keys.by_key_score(["valor", "RTUNO", "id"]) == ["RTUNO", "id", "valor"]
    assert keys.key_name_score("X_ID") == 1000 - 60 + 200


def test_infer_keys(spark):
    schema = "RTUNO INT, PNTNO INT, valor STRING"
    a = spark.createDataFrame([(1, 10, "a"), (1, 20, "x"), (2, 10, "foo")], schema)
    b = spark.createDataFrame([(1, 10, "a"), (1, 20, "y"), (3, 10, "bar")], schema)
    # `valor` alone is unique on both sides and single columns come before pairs.
    assert keys.infer_keys(a, b) == ["valor"]
    assert keys.infer_keys(a, b, ["RTUNO", "PNTNO"]) == ["RTUNO", "PNTNO"]
    nulls = spark.createDataFrame([(None, 1, "q"), (1, 2, "q")], schema)
    assert keys.infer_keys(nulls, nulls, ["RTUNO", "valor"]) == ["RTUNO"]
    assert keys.infer_keys(a.limit(0), b, ["RTUNO", "valor"]) == ["RTUNO"]
    double = a.union(a)
    assert keys.infer_keys(double, double, ["valor", "PNTNO"]) == ["PNTNO"]
    with pytest.raises(ValueError):
        keys.infer_keys(a, b, [])


def test_minimal_keys_are_those_of_brute_force(spark, monkeypatch):
    import random
    from itertools import combinations

    monkeypatch.setattr(keys, "SAMPLED", 20)
    monkeypatch.setattr(keys, "PER_PASS", 2)
    r = random.Random(11)
    names = ["a", "b.c", "ID", "No", "v"]
    for case in range(4):
        sides = [[(k if case else k // 2, r.choice([None, 1, 2, 3]), r.choice([None, k % 13]), float(k // 7), r.choice("xyz")) for k in range(60)] for _ in "ab"]
        frames = [spark.createDataFrame(rows, "a INT, `b.c` INT, ID INT, No DOUBLE, v STRING").repartition(3) for rows in sides]

        def unique(key):
            places = [names.index(c) for c in key]
            return all(len({tuple(row[p] for p in places) for row in rows}) == len(rows) for rows in sides)

        want = []
        for n in (1, 2, 3):
            level = combinations(keys.by_key_score(names), n)
            want += [list(c) for c in level if not any(set(k) <= set(c) for k in want) and unique(c)]
        assert keys.minimal_keys(*frames) == want
        pairs = [k for k in want if len(k) < 3]
        assert keys.infer_keys_checked(*frames) == ((pairs[0], True) if pairs else (["ID"], False))
    with pytest.raises(ValueError):
        keys.minimal_keys(*frames, columns=[])


def test_guess_keys():
    guess = keys.guess_keys
    assert guess(["a", "Id"]) == ["Id"] and guess(["a", "x_id", "y_ID"]) == ["x_id"] and guess(["a"]) == []
    assert guess(["pntno", "rtuno"], "ranger_sostat", "single_suffix") == ["rtuno", "pntno"]
    assert guess(["x_id", "y_id"], "t", "single_suffix") == [] and guess(["x_id"], "t", "single_suffix") == ["x_id"]
    assert guess(["a", "b"], strategy="id_or_first") == ["a"]
    assert guess(["inhpro", "pntno", "id"], strategy="preferred") == ["id", "pntno"] and guess(["q"], strategy="preferred") == ["q"]
