"""Number expressions: tolerant parsing of numbers kept as text, and readable number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.names import column_key
from snapscope.functions.text import strip

# Wrappers left behind by row dumps, and spellings of a float.
ONE_TUPLE = r"^\(\s*'?([^']+?)'?\s*,\s*\)$"
DECIMAL_CALL = r"^Decimal\(\s*'([^']+)'\s*\)$"
FLOAT_TEXT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
PLAIN_FLOAT_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPECIAL_FLOAT_TEXT = r"(?i)^[+-]?(inf|infinity|nan)$"
# Columns always shown as whole numbers.
INTEGER_DISPLAY_COLUMNS = ["RTUNO", "PNTNO", "UNIQID"]


def _is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def as_text(value: Column, data_type: T.DataType) -> Column:
    """Text of any value; bytes are read as UTF-8, nested values become JSON."""
    if isinstance(data_type, T.BinaryType):
        return F.make_valid_utf8(value.cast("string"))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def unwrap(text: Column) -> Column:
    """`('x',)` -> x and `Decimal('x')` -> x, one layer of each."""
    opened = F.regexp_replace(strip(text), ONE_TUPLE, "$1")
    return strip(F.regexp_replace(opened, DECIMAL_CALL, "$1"))


def digits_only(bare: Column) -> Column:
    """Text as a float is spelt: without `%` and blanks, a decimal comma as a point."""
    comma_only = bare.contains(",") & ~bare.contains(".")
    return F.translate(F.when(comma_only, F.translate(bare, ",", ".")).otherwise(bare), "% ", "")


def float_of(text: Column) -> Column:
    """Double of a float spelling, NULL for anything else."""
    plain = F.when(text.rlike(FLOAT_TEXT), F.translate(text, "_", "").try_cast("double"))
    word = F.when(
        text.rlike(SPECIAL_FLOAT_TEXT),
        F.when(F.lower(text).contains("nan"), F.lit(float("nan")))
        .when(text.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf"))),
    )
    return F.coalesce(plain, word)


def parse_number(value: Column, data_type: T.DataType = T.StringType()) -> Column:
    """Double of a value, NULL when it is no number.

    Text may carry wrappers, `%`, blanks and a decimal comma. Booleans and dates are not numbers.
    """
    if _is_number(data_type):
        return value.cast("double")
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return float_of(digits_only(unwrap(as_text(value, data_type))))
    return F.lit(None).cast("double")


def finite_number(value: Column, data_type: T.DataType = T.StringType()) -> Column:
    """Finite double of a number or of text with a decimal comma or point, else NULL."""
    if _is_number(data_type):
        number = value.cast("double")
    elif isinstance(data_type, T.StringType):
        text = F.replace(strip(value), F.lit(","), F.lit("."))
        number = F.when(text.rlike(PLAIN_FLOAT_TEXT), text.try_cast("double"))
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def _drop_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def significant_text(number: Column, digits: int) -> Column:
    """`digits` significant digits without trailing zeros; exponent form outside 1e-4 .. 10^digits."""
    scientific = F.format_string(f"%.{digits - 1}e", number)
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).try_cast("int")
    fixed = _drop_zeros(scientific.try_cast("decimal(38,18)").cast("string"))
    mantissa = _drop_zeros(F.regexp_extract(scientific, r"^(.*)e", 1))
    exponent_form = F.concat(mantissa, F.regexp_extract(scientific, r"(e[+-]\d+)$", 1))
    text = F.when((exponent >= -4) & (exponent < digits), fixed).otherwise(exponent_form)
    return F.when(number.isNotNull(), text)


def _special_text(number: Column) -> Column:
    return (
        F.when(F.isnan(number), "nan")
        .when(number == float("inf"), "inf")
        .when(number == float("-inf"), "-inf")
    )


def _whole_text(number: Column) -> Column:
    small = F.abs(number) < 9e18
    rounded = F.bround(number, 0)
    return F.when(small, rounded.try_cast("bigint").cast("string")).otherwise(
        rounded.try_cast("decimal(38,0)").cast("string")
    )


def nice_number(number: Column) -> Column:
    """119.0 -> 119, 119.50 -> 119.5; twelve significant digits."""
    whole = F.abs(number - F.bround(number, 0)) < 1e-12
    shortest = number.cast("string")
    # Up to twelve digits and no exponent: the shortest spelling is already the wanted one.
    is_short = (F.length(shortest) <= 13) & ~shortest.contains("E")
    return (
        F.when(F.isnan(number) | (F.abs(number) == float("inf")), _special_text(number))
        .when(whole, _whole_text(number))
        .when(is_short, shortest)
        .otherwise(significant_text(number, 12))
    )


def clean_value(value: Column, data_type: T.DataType = T.StringType()) -> Column:
    """The text under which equal values are counted together: numbers in one spelling, else trimmed text."""
    if _is_number(data_type):
        return nice_number(value.cast("double"))
    if isinstance(data_type, T.BooleanType):
        return value.cast("int").cast("string")
    text = as_text(value, data_type)
    number = nice_number(parse_number(value, data_type))
    return F.when(value.isNotNull(), F.coalesce(number, unwrap(text)))


def display_value(value: Column, data_type: T.DataType, name: str = "") -> Column:
    """Report text of a value: no trailing zeros, `105.` -> 105, NULL -> ''."""
    whole_only = column_key(name) in INTEGER_DISPLAY_COLUMNS
    if isinstance(data_type, T.BooleanType):
        text = value.cast("int").cast("string")
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        number = value.cast("double")
        rest = number.cast("string") if whole_only else significant_text(number, 15)
        text = F.coalesce(_special_text(number), F.when(number == F.bround(number, 0), _whole_text(number)), rest)
    elif isinstance(data_type, T.DecimalType):
        text = _drop_zeros(value.cast("string")) if data_type.scale else value.cast("string")
    elif _is_number(data_type):
        text = value.cast("string")
    else:
        bare = strip(as_text(value, data_type))
        text = F.when(bare.rlike(r"^-?\d+\.0*$"), F.regexp_replace(bare, r"^(-?)0*(\d+)\.0*$", "$1$2"))
        if not whole_only:
            text = F.coalesce(text, F.when(bare.rlike(r"^-?\d+\.\d+$"), _drop_zeros(bare)))
        text = F.coalesce(text, bare)
    return F.coalesce(text, F.lit(""))


def short_number(number: Column, decimals: int = 3) -> Column:
    """Whole numbers as integers, others with fixed decimals; NULL, NaN and infinities as ''."""
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    whole = F.abs(number - F.bround(number, 0)) < 1e-9
    text = F.when(whole, _whole_text(number)).otherwise(F.format_string(f"%.{decimals}f", F.bround(number, decimals)))
    return F.when(finite, text).otherwise("")


def size_text(n_bytes: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    size = n_bytes.cast("double")
    text = F.format_string("%.1fGB", F.bround(size / 1024**3, 1))
    for power, unit in ((2, "MB"), (1, "KB"), (0, "B")):
        scaled = F.format_string(f"%.1f{unit}", F.bround(size / 1024.0**power, 1))
        text = F.when(size < 1024.0 ** (power + 1), scaled).otherwise(text)
    return text


def megabytes_text(n_bytes: Column) -> Column:
    return F.format_string("%.2f MB", F.bround(n_bytes.cast("double") / 1024**2, 2))
