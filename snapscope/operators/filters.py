"""`COL=VAL` conditions: parsed on the driver, applied as typed comparisons that never fail on odd text."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.names import col

Condition = tuple[str, object]


def parse_conditions(text: str) -> list[Condition]:
    """`A=1,B="x,y",C=2.5` -> typed conditions. Quoted values stay text; others become int or float if they parse."""
    out: list[Condition] = []
    for part in next(csv.reader([text or ""], skipinitialspace=True), []):
        name, sign, value = part.partition("=")
        if not sign:
            raise ValueError(f"bad condition, expected COLUMN=VALUE: {part}")
        name, value = name.strip(), value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            out.append((name, value[1:-1]))
        else:
            out.append((name, _typed(value)))
    return out


def _typed(text: str) -> object:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def equals_value(value: Column, data_type: T.DataType, wanted: object) -> Column:
    """Typed equality: NULL equals NULL, numbers by value where both sides are numbers, else by text.

    A number column against a number stays a bare comparison, so it reaches the file scan.
    """
    if wanted is None:
        return value.isNull()
    if isinstance(wanted, bool):
        return F.coalesce(value.cast("boolean") == F.lit(wanted), F.lit(False))
    is_number = isinstance(data_type, T.NumericType)
    if isinstance(wanted, (int, float)):
        if is_number:
            fits = isinstance(wanted, float) or -(2**63) <= wanted < 2**63
            return value == F.lit(wanted) if fits else F.lit(False)
        if isinstance(data_type, T.StringType):
            as_number = value.try_cast("double") == F.lit(float(wanted))
            return F.coalesce(as_number, F.lit(False)) | (value == F.lit(str(wanted)))
        return value.cast("string") == F.lit(str(wanted))
    if is_number:
        number = _typed(str(wanted))
        return equals_value(value, data_type, number) if not isinstance(number, str) else F.lit(False)
    return value.cast("string") == F.lit(str(wanted))


def resolve(df: DataFrame, name: str) -> str | None:
    """The column of that name, ignoring case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def missing_columns(df: DataFrame, conditions: Sequence[Condition]) -> list[str]:
    return [name for name, _ in conditions if resolve(df, name) is None]


def matches(df: DataFrame, conditions: Sequence[Condition]) -> Column:
    """All conditions hold."""
    absent = missing_columns(df, conditions)
    if absent:
        raise ValueError("columns not in the table: " + ", ".join(absent))
    tests = []
    for name, wanted in conditions:
        own = resolve(df, name)
        tests.append(equals_value(col(own), df.schema[own].dataType, wanted))
    return reduce(lambda x, y: x & y, tests)
