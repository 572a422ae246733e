"""Weighted diffs and signals from counts of values, held against all pairs."""

import random

import pytest

from snapscope.operators import crowded
from snapscope.operators import signals as s
from snapscope.operators.diff import diff_page, expanded, keyed_diff, summary_of

SCHEMA = "k INT, name STRING, n INT, x DOUBLE, stacon STRING"


def made(seed, n):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, 3, None, 5 + seed]), r.choice(["a", "b", "", " ", None]), r.choice([None, 1, 2, 7]), r.choice([0.0, -0.0, 1.5, float("nan"), None, -4.0]), r.choice(["ON", "OFF", None]))
            for _ in range(n)]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(made(1, 60), SCHEMA), spark.createDataFrame(made(2, 50), SCHEMA)


@pytest.fixture(scope="module")
def both(sides):
    return keyed_diff(*sides, ["k"]).rows.persist(), keyed_diff(*sides, ["k"], weighted=True).rows.persist()


def rows_of(df):
    # Grouped rows have one zero, whatever its sign.
    return sorted(str(r).replace("=-0.0", "=0.0") for r in df.collect())


def test_weights_stand_for_pairs(both, sides):
    pairs, weighted = both
    assert weighted.count() < pairs.count() == weighted.selectExpr("sum(weight)").first()[0]
    assert rows_of(expanded(weighted).select(*pairs.columns)) == rows_of(pairs)
    for kinds in (["changed"], ["added"], ["removed"], ["changed", "removed"]):
        narrow = keyed_diff(*sides, ["k"], change_types=kinds, weighted=True, hot_rows=5).rows
        assert rows_of(expanded(narrow).select(*pairs.columns)) == rows_of(keyed_diff(*sides, ["k"], change_types=kinds).rows)
    assert diff_page(weighted, 1, 7).rows.count() == 7


def test_signals_count_by_weight(both):
    pairs, weighted = both
    for signal in (
        s.column_changes, s.first_key_per_column, s.null_transitions, s.change_patterns, s.state_transitions, s.transition_risk, s.family_counts, s.family_risk, s.key_quality,
        s.highlights, lambda r: s.family_counts(r, ["name"], unknown="?"), lambda r: s.risk_by_key(s.risk_rows(r)), s.export_anomalies, lambda r: s.null_transitions(r, "b"),
    ):
        assert rows_of(signal(pairs)) == rows_of(signal(weighted))
    drifts = [[(r.column_name, r.drift_count, pytest.approx(r.sum_abs_delta), r.max_signed_delta) for r in s.numeric_drift(x).collect()] for x in both]
    assert drifts[0] == drifts[1]
    summary = summary_of(pairs)
    assert rows_of(s.signal_counts(pairs, summary)) == rows_of(s.signal_counts(weighted, summary))


def test_counts_of_values_give_the_signals_of_all_pairs(sides, both):
    pairs, _ = both
    counts = crowded.value_counts(*sides, ["k"]).persist()
    assert rows_of(crowded.column_changes(counts)) == rows_of(s.column_changes(pairs))
    for side in ("a", "b"):
        assert rows_of(crowded.null_transitions(counts, side)) == rows_of(s.null_transitions(pairs, side))
        want = [(r.column_name, r.drift_count, pytest.approx(r.sum_abs_delta), r.max_abs_delta, r.max_signed_delta) for r in s.numeric_drift(pairs, side).collect()]
        assert [tuple(r) for r in crowded.numeric_drift(counts, side).collect()] == want
    assert crowded.column_changes(crowded.value_counts(sides[0].limit(0), sides[1], ["k"])).count() == 0
