"""Looking at one table: filter, order, page, headline fields, report filters and natural order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.arguments import whole_number
from snapscope.functions.names import HEADLINE_FIELDS, col, column_key, display_order, known_name
from snapscope.functions.text import strip

# Bounds of a request for a page.
LIMIT_DEFAULT, LIMIT_MAX = 50, 1000


@dataclass(frozen=True)
class TablePage:
    rows: DataFrame
    total: int
    limit: int
    offset: int


@dataclass(frozen=True)
class PageArgs:
    """Arguments of `table_rows` and `table_page`."""

    column: str | None
    q: str | None
    sort: str | None
    order: str
    limit: int
    offset: int


def page_args(raw: Mapping[str, object]) -> PageArgs:
    """Check raw request values. The bounds are those of a request; the engine takes any page size."""
    order = str(raw.get("order") or "ASC").upper()
    return PageArgs(
        column=str(raw.get("col") or "") or None, q=str(raw.get("q") or "") or None, sort=str(raw.get("sort") or "") or None,
        order=order if order in ("ASC", "DESC") else "ASC",
        limit=whole_number(raw.get("limit", LIMIT_DEFAULT), "limit", 1, LIMIT_MAX),
        offset=whole_number(raw.get("offset", 0), "offset", 0),
    )


def contains_filter(df: DataFrame, column: str | None, q: str | None) -> DataFrame:
    """Rows whose text contains q, ignoring case; `%` and `_` in q are wildcards. No column or no q: all rows."""
    if not column or not q:
        return df
    known_name(column, df.columns)
    return df.filter(col(column).cast("string").ilike("%" + q.replace("\\", "\\\\") + "%"))


def order_by(df: DataFrame, column: str | None, order: str = "ASC") -> DataFrame:
    """Order by one column with NULLs last; all other columns break ties, so pages are stable."""
    if not column:
        return df
    known_name(column, df.columns)
    down = str(order).upper() == "DESC"
    first = col(column).desc_nulls_last() if down else col(column).asc_nulls_last()
    sortable = [f.name for f in df.schema.fields if f.name != column and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.orderBy(first, *[col(c).asc_nulls_last() for c in sortable])


def table_rows(
    df: DataFrame, column: str | None = None, q: str | None = None, sort: str | None = None, order: str = "ASC",
    limit: int = LIMIT_DEFAULT, offset: int = 0,
) -> DataFrame:
    """One page, as a lazy plan: the filter is pushed to the scan and only the page's rows are kept while sorting."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return order_by(contains_filter(df, column, q), sort, order).offset(offset).limit(limit)


def table_page(
    df: DataFrame, column: str | None = None, q: str | None = None, sort: str | None = None, order: str = "ASC",
    limit: int = LIMIT_DEFAULT, offset: int = 0,
) -> TablePage:
    """A page and the number of rows that pass the filter."""
    page = table_rows(df, column, q, sort, order, limit, offset)
    return TablePage(page, contains_filter(df, column, q).count(), limit, offset)


def for_display(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in display_order(df.sparkSession, df.columns)])


def headline(df: DataFrame, most: int = 4) -> Column:
    """The first few non-blank fields of the preferred names, as an array of (name, value)."""
    by_key = {column_key(c): c for c in df.columns}
    chosen = [by_key[k] for k in HEADLINE_FIELDS if k in by_key]
    pairs = [
        F.when(col(c).cast("string") != "", F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("value")))
        for c in chosen
    ]
    if not pairs:
        return F.array().cast("array<struct<name:string,value:string>>")
    return F.slice(F.array_compact(F.array(*pairs)), 1, most)


# --- report rows -------------------------------------------------------------------------------


def _side_has(rows: DataFrame, column: str, term: str) -> Column:
    known_name(column, rows.schema["a"].dataType.names)
    sides = [F.lower(F.coalesce(F.col(s).getField(column).cast("string"), F.lit(""))) for s in ("a", "b")]
    return reduce(lambda x, y: x | y, [s.contains(term.lower()) for s in sides])


def report_filter(
    rows: DataFrame, per_column: Mapping[str, str] | None = None, column: str | None = None, text: str | None = None,
    mode: str = "contains",
) -> DataFrame:
    """Diff rows whose old or new value contains every given text, and contains (or not) one more."""
    for name, term in (per_column or {}).items():
        if term.strip():
            rows = rows.filter(_side_has(rows, name, term.strip()))
    if column and text and text.strip():
        has = _side_has(rows, column, text.strip())
        rows = rows.filter(~has if mode == "not_contains" else has)
    return rows


def natural_order(value: Column, descending: bool = False) -> list[Column]:
    """Sort keys: numbers by value (a comma counts as a point), then text with digit runs by value, ignoring case."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    number = F.replace(strip(text), F.lit(","), F.lit(".")).try_cast("double")
    padded = F.regexp_replace(F.regexp_replace(F.lower(text), r"(\d+)", "00000000000000000000$1"), r"\d+(\d{20})(?!\d)", "$1")
    if descending:
        return [number.desc_nulls_first(), padded.desc(), text.desc()]
    return [number.asc_nulls_last(), padded.asc(), text.asc()]


def sort_report(rows: DataFrame, column: str, order: str = "asc") -> DataFrame:
    """Order diff rows by the newer value of a column (B, or A where B is missing)."""
    known_name(column, rows.schema["a"].dataType.names)
    has_b = F.col("change_type") != "removed"
    shown = F.when(has_b, F.col("b").getField(column).cast("string")).otherwise(F.col("a").getField(column).cast("string"))
    return rows.orderBy(*natural_order(shown, order.lower() == "desc"))


def merged_columns(frames: Sequence[DataFrame], most: int | None = None) -> DataFrame:
    """Rows of different shape under the union of their columns, in first-seen order."""
    merged = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    return merged.select(*[col(c) for c in merged.columns[:most]])
