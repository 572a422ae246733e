"""Counts of values form a text per distinct value at most."""

import datetime as dt

from snapscope.operators import crowded


def test_values_are_grouped_before_they_become_text(spark):
    schema = "k INT, n INT, x DOUBLE, t TIMESTAMP, m STRING, l ARRAY<INT>"
    day = dt.datetime(2024, 1, 2)
    a = spark.createDataFrame([(1, 1, 0.0, day, "u", [1]), (1, 1, -0.0, day, " ", [1]), (2, None, float("nan"), None, None, None), (None, 9, 9.0, day, "z", [9])], schema)
    b = spark.createDataFrame([(1, 1, 0.0, day, "u", [2]), (2, 3, None, day, "", [1])], schema)
    counts = crowded.value_counts(a, b, ["k"])
    got = {(r.k0, r.column_name, r.value, r.blank, r.number): (r.n_a, r.n_b) for r in counts.collect()}
    assert len(got) == counts.count()
    assert got[(1, "x", "0.0", False, 0.0)] == (2, 1) and got[(1, "n", "1", False, 1.0)] == (2, 1) and got[(1, "l", "[1]", False, None)] == (2, 0)
    assert got[(2, "x", "NaN", False, None)] == (1, 0) and got[(2, "t", None, True, None)] == (1, 0) and got[(1, "m", " ", True, None)] == (1, 0)
    whole = crowded.column_changes(crowded.value_counts(a.select("k", "n", "x"), b.select("k", "n", "x"), ["k"]))
    assert " as string)" not in whole._jdf.queryExecution().optimizedPlan().toString()
