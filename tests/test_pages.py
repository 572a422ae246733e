import random

import pytest

from snapscope.operators import pages as p
from snapscope.operators.diff import diff_order, keyed_diff


def test_pages_of_a_stored_table(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice([None, 1, 1, 1, 2, 5]), r.choice(["x", "y", None]), k) for k in range(700)]
    df = spark.createDataFrame(rows, "a INT, `b.c` STRING, n INT").repartition(6)
    stored = p.store_pages(df, ["a", "n"], str(tmp_path / "t"))
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    assert stored.total == 700
    for offset, limit in ((0, 10), (333, 40), (695, 50), (0, 700), (700, 5)):
        got = [tuple(x) for x in p.rows_at(stored, offset, limit).collect()]
        assert got == [(*w, offset + k) for k, w in enumerate(want[offset : offset + limit])]
    again = p.read_pages(spark, str(tmp_path / "t"))
    assert p.page_of(again, 999, 300).page == 3 and p.page_of(again, 3, 300).rows.count() == 100
    for bad in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            p.rows_at(stored, *bad)
    with pytest.raises(ValueError):
        p.page_of(stored, 0)
    nothing = p.store_pages(df.limit(0), ["a"], str(tmp_path / "e"))
    assert nothing.total == 0 and p.page_of(nothing, 5, 10).rows.count() == 0 and p.page_of(nothing, 5, 10).page == 1


def test_a_walk_meets_every_row_of_a_diff_once(spark, tmp_path):
    a = spark.createDataFrame([(k % 9 if k % 10 else None, "same" if k % 3 else f"v{k}") for k in range(60)], "k INT, v STRING")
    b = spark.createDataFrame([(k % 11, "same") for k in range(40)], "k INT, v STRING")
    rows = keyed_diff(a, b, ["k"]).rows
    stored = p.store_diff(rows, str(tmp_path / "d"))
    walked = [x for k in range(-(-stored.total // 7)) for x in p.page_of(stored, k + 1, 7).rows.drop("position").collect()]
    assert [str(x) for x in walked] == [str(x) for x in rows.orderBy(*diff_order(rows)).collect()]
