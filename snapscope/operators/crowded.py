"""Signals per column of keys that hold very many rows, without forming a pair.

All rows of a key on one side meet all of it on the other, so what the pairs say about a column follows from how often each value
occurs per key and side: as many pairs differ as there are, less those of equal values; a blank meets every filled
value; and the absolute differences of two sets of numbers add up from the ranks of their values. The work grows with the
cells of the input, whatever number of pairs they stand for; only a pair's columns taken together need the pairs (a weighted diff).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.numbers import finite_number
from snapscope.functions.text import is_blank
from snapscope.operators.diff import _any_null, _sides, diff_spec
from snapscope.operators.positions import with_prefix_sums
from snapscope.operators.signals import EMPTIED, FILLED, _top

# Types whose equal values have one text, and unlike ones (but for instants) unlike texts.
PLAIN = (T.IntegralType, T.FractionalType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType, T.TimestampType)


def value_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None) -> DataFrame:
    """(k0.., column_name, value, blank, number, n_a, n_b): rows per distinct value of each compared column and key, NULL keys left out."""
    spec = diff_spec(a, b, keys, compare)
    left, right, names = _sides(a, b, spec)

    kinds = [(left.schema[f"a{i}"].dataType, right.schema[f"b{i}"].dataType) for i in range(len(spec.compare))]
    others = [i for i, (x, y) in enumerate(kinds) if x != y or not _is_plain(x)]
    counted = [_counted_typed(left, right, names, i, c) for i, c in enumerate(spec.compare) if i not in others]
    if others or not counted:
        counted.append(_counted_as_text(left, right, names, {i: spec.compare[i] for i in others}))
    return reduce(DataFrame.unionAll, counted)


def _is_plain(kind: T.DataType) -> bool:
    # A text of a collation of its own may equal unlike ones.
    return isinstance(kind, PLAIN) and (not isinstance(kind, T.StringType) or kind == T.StringType())


def _cell(value: Column, kind: T.DataType) -> list[Column]:
    if kind.typeName() in ("float", "double"):
        value = F.when(value == 0, F.lit(0.0)).otherwise(value)  # one zero
    return [value.cast("string").alias("value"), is_blank(value, kind).alias("blank"), finite_number(value, kind).alias("number")]


def _counted_typed(left: DataFrame, right: DataFrame, names: list[str], i: int, column: str) -> DataFrame:
    """Counts of one column, grouped as the values are: a text, if any, is formed per distinct value, not per row."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        marks = [F.lit(int(tag == t)).cast("bigint").alias(f"in_{t}") for t in ("a", "b")]
        return df.filter(~_any_null(names)).select(*names, F.col(f"{tag}{i}").alias("v"), *marks)

    kind = left.schema[f"a{i}"].dataType
    per_value = side(left, "a").unionAll(side(right, "b")).groupBy(*names, "v").agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"))
    cells = per_value.select(*names, F.lit(column).alias("column_name"), *_cell(F.col("v"), kind), "n_a", "n_b")
    if not isinstance(kind, T.TimestampType):
        return cells
    # Two instants may have one text, where clocks are put back.
    return cells.groupBy(*names, "column_name", "value", "blank", "number").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


def _counted_as_text(left: DataFrame, right: DataFrame, names: list[str], columns: dict[int, str]) -> DataFrame:
    """Counts of columns whose values are compared as text."""
    def cells(df: DataFrame, tag: str) -> DataFrame:
        made = [F.struct(F.lit(c).alias("column_name"), *_cell(F.col(f"{tag}{i}"), df.schema[f"{tag}{i}"].dataType)) for i, c in columns.items()]
        none = F.array().cast("array<struct<column_name:string,value:string,blank:boolean,number:double>>")
        counted = [F.lit(int(tag == t)).cast("bigint").alias(f"in_{t}") for t in ("a", "b")]
        return df.filter(~_any_null(names)).select(*names, F.inline(F.array(*made) if made else none)).select("*", *counted)

    both = cells(left, "a").unionAll(cells(right, "b"))
    return both.groupBy(*names, "column_name", "value", "blank", "number").agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"))


def _names(counts: DataFrame) -> list[str]:
    return [c for c in counts.columns if c not in ("column_name", "value", "blank", "number", "n_a", "n_b")]


def column_changes(counts: DataFrame, top: int | None = 12) -> DataFrame:
    """Changed pairs per column, most changed first; `counts` as `value_counts` gives them."""
    per_key = counts.groupBy(*_names(counts), "column_name").agg(
        (F.sum("n_a") * F.sum("n_b") - F.sum(F.col("n_a") * F.col("n_b"))).alias("n"))
    changes = per_key.groupBy("column_name").agg(F.sum("n").alias("changes")).filter("changes > 0")
    return _top(changes, top, F.col("changes").desc(), F.col("column_name"))


def null_transitions(counts: DataFrame, new_side: str = "a", top: int | None = 8) -> DataFrame:
    """How many pairs go from empty to filled or back, per column."""
    old_side = "b" if new_side == "a" else "a"

    def rows(side: str, blank: bool):
        return F.sum(F.when(F.col("blank") == F.lit(blank), F.col(f"n_{side}")).otherwise(0))

    per_key = counts.groupBy(*_names(counts), "column_name").agg(
        (rows(old_side, True) * rows(new_side, False)).alias("filled"), (rows(old_side, False) * rows(new_side, True)).alias("emptied"))
    sums = per_key.groupBy("column_name").agg(F.sum("filled").alias("filled"), F.sum("emptied").alias("emptied"))
    kinds = F.array(F.struct(F.lit(FILLED).alias("direction"), F.col("filled").alias("transitions")),
                    F.struct(F.lit(EMPTIED).alias("direction"), F.col("emptied").alias("transitions")))
    found = sums.select("column_name", F.inline(kinds)).filter("transitions > 0")
    return _top(found, top, F.col("transitions").desc(), F.col("column_name"), F.col("direction"))


def numeric_drift(counts: DataFrame, new_side: str = "a", top: int | None = 8) -> DataFrame:
    """Numeric change per column over all pairs: count, sum and maximum of the absolute change, signed change at the maximum.

    Of every pair of unlike numbers the larger adds itself and the smaller takes itself off, so a value counts once for each
    row of the other side below it and minus once for each above; the rows below come from prefix sums over ranges of values.
    """
    names = _names(counts)
    group = [*names, "column_name"]
    numbers = counts.filter("number IS NOT NULL").groupBy(*group, "number").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    below = with_prefix_sums(numbers, ["number"], group, {"below_a": "n_a", "below_b": "n_b"})

    def edge(pick, side: str):
        return pick(F.when(F.col(f"n_{side}") > 0, F.col("number")))

    old_side = "b" if new_side == "a" else "a"
    # A value's rows of one side, times the other side's rows below it less those above it: two terms of which the second
    # needs the group's total, which is known only after the sum, so it is summed apart.
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    per_key = below.groupBy(*group).agg(
        F.sum("n_a").alias("all_a"), F.sum("n_b").alias("all_b"), F.sum(F.col("n_a") * F.col("n_b")).alias("equal"),
        F.sum(F.col("number") * (n_a * (2 * F.col("below_b") + F.col("n_b")) + n_b * (2 * F.col("below_a") + F.col("n_a")))).alias("known"),
        F.sum(F.col("number") * n_a).alias("sum_a"), F.sum(F.col("number") * n_b).alias("sum_b"),
        (edge(F.max, new_side) - edge(F.min, old_side)).alias("up"), (edge(F.min, new_side) - edge(F.max, old_side)).alias("down"),
    ).filter("all_a > 0 AND all_b > 0")
    drift = per_key.select(
        "column_name", (F.col("all_a") * F.col("all_b") - F.col("equal")).alias("n"),
        (F.col("known") - F.col("sum_a") * F.col("all_b") - F.col("sum_b") * F.col("all_a")).alias("total"),
        F.greatest(F.struct(F.abs("up"), F.col("up").alias("d")), F.struct(F.abs("down"), F.col("down").alias("d"))).alias("most"),
    ).filter("n > 0")
    stats = drift.groupBy("column_name").agg(F.sum("n").alias("drift_count"), F.sum("total").alias("sum_abs_delta"), F.max("most").alias("most")).select(
        "column_name", "drift_count", "sum_abs_delta", F.abs("most.d").alias("max_abs_delta"), F.col("most.d").alias("max_signed_delta"))
    return _top(stats, top, F.col("sum_abs_delta").desc(), F.col("column_name"))
