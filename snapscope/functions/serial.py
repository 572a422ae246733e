"""JSON-ready forms of typed values: rows as JSON text, canonical values for comparing copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.names import col
from snapscope.functions.numbers import significant_text

KEEP_NULLS = {"ignoreNullFields": "false"}


def iso_time(value: Column) -> Column:
    """`2024-01-31T08:00:00`, with microseconds only when there are any."""
    # The text of a time has as many digits of its fraction as it takes.
    text = F.translate(value.cast("string"), " ", "T")
    exact = F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(F.substring_index(text, ".", -1), 6, "0"))
    return F.when(text.contains("."), exact).otherwise(text)


def json_ready(value: Column, data_type: T.DataType) -> Column:
    """Value as it should appear in JSON: decimals as doubles, times in ISO form, bytes as text."""
    if isinstance(data_type, T.DecimalType):
        return value.cast("double")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return iso_time(value)
    if isinstance(data_type, T.DateType):
        return value.cast("string")
    if isinstance(data_type, T.BinaryType):
        return F.make_valid_utf8(value.cast("string"))
    if isinstance(data_type, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return value.cast("string")
    return value


def fields_json(fields: Sequence[tuple[str, Column, T.DataType]]) -> Column:
    """Named values as one JSON object, NULL fields kept."""
    return F.to_json(F.struct(*[json_ready(value, kind).alias(name) for name, value, kind in fields]), KEEP_NULLS)


def row_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The whole row as one JSON object, NULL fields kept."""
    return fields_json([(n, col(n), df.schema[n].dataType) for n in columns or df.columns])


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a single `row_json` column."""
    return df.select(row_json(df).alias("row_json"))


def canonical_value(value: Column, data_type: T.DataType) -> Column:
    """Text that is equal for equal values in both stores: bytes as hex, booleans as 0/1, doubles to 15 digits."""
    if isinstance(data_type, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(data_type, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        number = value.cast("double")
        return (
            F.when(F.isnan(number), "NaN")
            .when(number == float("inf"), "Infinity")
            .when(number == float("-inf"), "-Infinity")
            .otherwise(significant_text(number, 15))
        )
    if isinstance(data_type, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(value)))
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def canonical_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row as JSON of its canonical values, in column order."""
    names = list(columns or df.columns)
    fields = [canonical_value(col(n), df.schema[n].dataType).alias(n) for n in names]
    return F.to_json(F.struct(*fields), KEEP_NULLS)


def flatten_nested(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text with sorted map keys, binary columns as hex."""
    out = []
    for field in df.schema.fields:
        value = col(field.name)
        if isinstance(field.dataType, T.BinaryType):
            value = F.lower(F.hex(value))
        elif isinstance(field.dataType, T.MapType):
            value = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))), KEEP_NULLS)
        elif isinstance(field.dataType, T.StructType):
            names = sorted(field.dataType.names)
            picked = F.struct(*[value.getField(n).alias(n) for n in names])
            value = F.when(value.isNotNull(), F.to_json(picked, KEEP_NULLS))
        elif isinstance(field.dataType, T.ArrayType):
            value = F.to_json(value, KEEP_NULLS)
        out.append(value.alias(field.name))
    return df.select(*out)
