"""Drift of a diff takes no row or text per cell."""

from pyspark.sql import functions as F
from snapscope.operators import signals as s
from snapscope.operators.diff import keyed_diff


def test_drift_takes_no_row_per_cell(spark):
    schema = "k INT, x DOUBLE, y STRING, z DECIMAL(9,2)"
    a = spark.createDataFrame([(1, 5.0, "1,5", None), (2, 1.0, "q", None), (3, None, "2", None), (4, -3.0, "1", None)], schema)
    b = spark.createDataFrame([(1, 2.0, "1.5", None), (2, 4.0, "7", None), (3, 3.0, "9", None), (4, -3.0, "1", None)], schema)
    rows = keyed_diff(a, b, ["k"]).rows
    drift = s.numeric_drift(rows)
    assert [tuple(r) for r in drift.collect()] == [("y", 1, 7.0, 7.0, -7.0), ("x", 2, 6.0, 3.0, 3.0)]
    assert [r.max_signed_delta for r in s.numeric_drift(rows, "b").collect()] == [7.0, 3.0]
    assert "Generate" not in drift._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    assert s.numeric_drift(rows.where(F.lit(False))).count() == 0
