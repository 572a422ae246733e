"""Rows with a NULL key part that pass through the join: the same diff, without a union behind its pairs."""

import pytest
from snapscope.operators import diff
from tests.test_stored_index import plan

TYPES = [None, ["changed", "removed"], ["changed", "added"], ["added", "removed"], ["changed"], ["removed"], ["added"]]


@pytest.fixture(scope="module")
def sides(spark):
    a = [(k, p, v) for k in (1, 2, 3, None) for p in ("x", None) for v in (1, 1, 2, None)] + [(5, "x", 7)]
    b = [(k, p, v) for k in (2, 3, 4, None) for p in ("x", "y", None) for v in (1, 3, 3)] + [(5, "x", 7), (5, "x", 8)]
    return tuple(spark.createDataFrame(rows, "k INT, p STRING, v INT").repartition(3) for rows in (a, b))


@pytest.mark.parametrize("keys", [["k"], ["k", "p"]], ids=len)
@pytest.mark.parametrize("more", [{}, {"include_same": True}, {"weighted": True}, {"unique_keys": True}], ids=str)
def test_the_same_rows_with_null_keys_joined(sides, keys, more):
    for types in TYPES:
        given = {"change_types": types, "hot_rows": 3, **more}
        plain, joined = (sorted(map(str, diff.keyed_diff(*sides, keys, ["v"], nulls_joined=n, **given).rows.collect())) for n in (False, True))
        assert plain and joined == plain


def test_no_union_behind_the_pairs(sides):
    plain, joined = (plan(diff.keyed_diff(*sides, ["k"], ["v"], hot_rows=3, nulls_joined=n).rows).split("SortMergeJoin")[0] for n in (False, True))
    assert "Union" in plain and "Union" not in joined
