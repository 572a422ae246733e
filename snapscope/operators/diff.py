"""Keyed diff of two versions of a table.

Rows are matched by equal key values; a key with a NULL part matches nothing. `added` means only in
B, `removed` only in A, `changed` that a compared column differs (NULL-safe). A key that repeats is
compared pair by pair, as a join does.

Shape of the plan: one full outer join on the keys. Rows with a NULL key part can match nothing, so
they bypass the join and cost no shuffle. Keys that repeat very often are found by a narrow count over
the key columns: the rows of their larger side are dealt out over SALTS parts of the key, and those of
the other side are copied to each part, so that no task gets a key's rows whole and every pair is
formed. `repeated_versions` describes such keys in the size of the input: their distinct versions with
the rows on either side, from which all pairs follow.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.arguments import whole_number
from snapscope.functions.names import col, common_columns, reject_case_clashes

CHANGE_TYPES = ("added", "removed", "changed")
# Keys with HOT_ROWS rows on a side are dealt out over SALTS parts; HOT_KEYS of them at most, the largest, so that
# their list stays small enough to send to every task. No other key can then hold more than 1/HOT_KEYS of the rows.
HOT_ROWS, HOT_KEYS, SALTS = 10_000, 2_000, 64


@dataclass(frozen=True)
class DiffSpec:
    keys: list[str]
    compare: list[str]


@dataclass(frozen=True)
class KeyedDiff:
    """`rows(change_type, key, a, b, changed_columns)`, complete however often keys repeat."""

    rows: DataFrame
    spec: DiffSpec


def _repeated(names: Sequence[str]) -> list[str]:
    return sorted({n for n in names if list(names).count(n) > 1})


def diff_spec(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None) -> DiffSpec:
    """Check the key and compare columns; compare everything common that is no key by default."""
    common = common_columns(a, b)
    reject_case_clashes(common)
    keys = list(keys)
    if not keys:
        raise ValueError("key columns are empty: name at least one")
    if _repeated(keys):
        raise ValueError("repeated key columns: " + ", ".join(_repeated(keys)))
    absent = sorted(set(keys) - set(common))
    if absent:
        raise ValueError("key columns not in both tables: " + ", ".join(absent))
    if compare is None:
        return DiffSpec(keys, [c for c in common if c not in keys])
    compare = list(compare)
    if _repeated(compare):
        raise ValueError("repeated compare columns: " + ", ".join(_repeated(compare)))
    absent = sorted(set(compare) - set(common))
    if absent:
        raise ValueError("compare columns not in both tables: " + ", ".join(absent))
    return DiffSpec(keys, compare)


_EXACT = "decimal(38,17)"
_BEYOND = 1e20


def _in_common(value: Column, own: T.DataType, their: T.DataType) -> Column:
    """A value in the type in which it can be compared with one of type `their`."""
    kinds = {type(own), type(their)}
    numbers = [isinstance(k, T.NumericType) for k in (own, their)]
    floats = (T.FloatType, T.DoubleType)
    if all(numbers):
        if isinstance(own, floats) == isinstance(their, floats):
            return value
        exact = F.when(F.abs(value) < _BEYOND, value).cast(_EXACT)
        if not isinstance(own, floats):
            return exact
        huge = F.lit("999999999999999999999").cast(_EXACT)
        return F.when(F.isnan(value) | (value >= _BEYOND), huge).when(value <= -_BEYOND, -huge).otherwise(exact)
    if kinds <= {T.DateType, T.TimestampType} or kinds <= {T.DateType, T.TimestampNTZType} or kinds <= {T.TimestampType, T.TimestampNTZType}:
        return value.cast("timestamp")
    if T.BooleanType in kinds and any(numbers):
        return _in_common(value.cast("int"), T.IntegerType(), their) if isinstance(own, T.BooleanType) else _in_common(value, own, T.IntegerType())
    if T.StringType in kinds and any(numbers):
        # Both as text, numbers in one spelling.
        text = value.cast("string")
        number = F.regexp_extract(F.trim(text), r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$", 0)
        parsed = F.when(number != "", number).cast("double") if isinstance(own, floats) or isinstance(their, floats) else None
        if parsed is not None:
            canonical = F.when(F.isnotnull(parsed), parsed.cast("string"))
        else:
            plain = F.regexp_replace(number, "^[+]", "")
            for pattern, kept in ((r"([.][0-9]*?)0+$", "$1"), ("[.]$", ""), ("^(-?)0+(?=[0-9])", "$1"), ("^(-?)[.]", "$10.")):
                plain = F.regexp_replace(plain, pattern, kept)
            canonical = F.when((number != "") & ~number.rlike("[eE]"), F.when(plain.isin("", "-", "-0"), "0").otherwise(plain))
        return F.coalesce(canonical, text)
    return value.cast("string")


def comparable(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames cut to the columns, with types that can be compared and grouped.

    Equal types stay, and pairs that Spark compares by value without loss. Dates meet timestamps as timestamps,
    booleans meet numbers as 1 and 0, whole numbers meet fractions as exact decimals (fractions beyond their range
    keep their sign and stand for the largest one, which no whole number is), texts that are numbers meet numbers as
    such and other texts stay what they are. Remaining pairs are compared as text. Maps become sorted entry lists.
    """

    def prepared(df: DataFrame, other: DataFrame) -> DataFrame:
        out = []
        for name in columns:
            own, their = df.schema[name].dataType, other.schema[name].dataType
            value = col(name)
            if isinstance(own, T.MapType):
                value = F.array_sort(F.map_entries(value))
            elif own != their:
                value = _in_common(value, own, their)
            out.append(value.alias(name))
        return df.select(*out)

    return prepared(a, b), prepared(b, a)


def _any_null(names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, [col(n).isNull() for n in names])


def _sides(a: DataFrame, b: DataFrame, spec: DiffSpec) -> tuple[DataFrame, DataFrame, list[str]]:
    """Positional names (k0.., a0.., b0..) so that no column name can collide."""
    a, b = comparable(a, b, list(dict.fromkeys(spec.keys + spec.compare)))
    keys = [f"k{i}" for i in range(len(spec.keys))]

    def side(df: DataFrame, tag: str) -> DataFrame:
        named = [col(k).alias(n) for k, n in zip(spec.keys, keys)]
        values = [col(c).alias(f"{tag}{i}") for i, c in enumerate(spec.compare)]
        return df.select(*named, *values, F.lit(True).alias(f"in_{tag}"))

    return side(a, "a"), side(b, "b"), keys


def compared_columns(a: Mapping[str, DataFrame], b: Mapping[str, DataFrame], table: str) -> list[str]:
    """Common columns of a table of two databases; the error names each side that lacks the table."""
    lacking = [side for side, tables in (("a", a), ("b", b)) if table not in tables]
    if lacking:
        raise ValueError(f"table {table} not found in: {', '.join(lacking)}")
    return common_columns(a[table], b[table])


def key_counts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per non-NULL key and side: reads the key columns only and combines before the shuffle."""
    a, b = comparable(a, b, keys)
    tagged = a.select("*", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionAll(
        b.select("*", F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    return (
        tagged.filter(~_any_null(keys))
        .groupBy(*[col(k) for k in keys])
        .agg(F.sum("in_a").alias("rows_a"), F.sum("in_b").alias("rows_b"))
    )


def repeated_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once on a side, with their row counts."""
    return key_counts(a, b, keys).filter((F.col("rows_a") > 1) | (F.col("rows_b") > 1))


def _padded(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of one side with NULLs for the other side's columns."""
    missing = [f for f in other.schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    if how == "left_anti":
        return _padded(left.join(right.select(*keys), keys, "left_anti"), right)
    return left.join(right, keys, how)


def _labelled(joined: DataFrame, spec: DiffSpec, keys: list[str]) -> DataFrame:
    n = len(spec.compare)
    differs = [~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(n)]
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    any_differs = reduce(lambda x, y: x | y, differs, F.lit(False))
    change = (
        F.when(F.col("in_a").isNull(), "added")
        .when(F.col("in_b").isNull(), "removed")
        .when(any_differs, "changed")
        .otherwise("same")
    )
    named = [F.when(both & d, F.lit(c)) for d, c in zip(differs, spec.compare)]
    changed = F.array_compact(F.array(*named)) if named else F.array()
    weight = (F.coalesce("rows_a", F.lit(1)) * F.coalesce("rows_b", F.lit(1))).alias("weight")
    return joined.select(
        change.alias("change_type"),
        F.struct(*[F.col(k).alias(c) for k, c in zip(keys, spec.keys)]).alias("key"),
        F.struct(*[F.col(f"a{i}").alias(c) for i, c in enumerate(spec.compare)]).alias("a"),
        F.struct(*[F.col(f"b{i}").alias(c) for i, c in enumerate(spec.compare)]).alias("b"),
        changed.cast("array<string>").alias("changed_columns"),
        *([weight] if "rows_a" in joined.columns else []),
    )


def _join_kind(types: set[str]) -> str:
    """The narrowest join that still yields the wanted change types."""
    if types == {"changed"}:
        return "inner"
    if types == {"removed"}:
        return "left_anti"
    if types == {"added"}:
        return "right_anti"
    if types == {"changed", "removed"}:
        return "left_outer"
    if types == {"changed", "added"}:
        return "right_outer"
    return "full_outer"


def _match(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
    columns = keys + [c for c in left.columns + right.columns if c not in keys]
    if kind == "right_anti":
        out = _joined(right, left, keys, "left_anti")
    else:
        out = _joined(left, right, keys, kind)
    return out.select(*columns)


def keyed_diff(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
    *,
    change_types: Sequence[str] | None = None,
    key_filter: Mapping[str, str] | None = None,
    changed_column: str | None = None,
    include_same: bool = False,
    unique_keys: bool = False,
    hot_rows: int = HOT_ROWS,
    weighted: bool = False,
    nulls_joined: bool = False,
) -> KeyedDiff:
    """Differences between A and B by key.

    A key that repeats gives one row per pair. With `weighted=True` equal rows of a side are counted together before they
    are matched, and a diff row stands for `weight` pairs; the signals count by it, and `expanded` gives the pairs.

    `unique_keys=True` promises that no key repeats (a declared or inferred key) and skips the count
    over the key columns. Filters on keys and change types narrow the inputs and the join itself.

    `nulls_joined=True` sends rows with a NULL key part through an outer join that keeps them, dealt out by the task they come
    from: where keys repeat so often that their pairs are most of the work, these then reach what follows without a union between.
    """
    spec = diff_spec(a, b, keys, compare)
    wanted = _checked_types(change_types)
    if changed_column is not None and changed_column not in spec.compare:
        raise ValueError(f"changed column is not compared: {changed_column}")
    if key_filter:
        a, b = (df.filter(key_text_filter(df, spec.keys, key_filter)) for df in (a, b))

    left, right, names = _sides(a, b, spec)
    if weighted:
        left, right = (df.groupBy(*df.columns).agg(F.count("*").alias(f"rows_{tag}")) for df, tag in ((left, "a"), (right, "b")))
    kind = "full_outer" if include_same else _join_kind(wanted)
    null_left, null_right = left.filter(_any_null(names)), right.filter(_any_null(names))
    joined = nulls_joined and not unique_keys and kind.endswith("_outer")
    # The sides whose rows an outer join keeps are those whose rows with a NULL key part are wanted.
    left = left if joined and kind in ("left_outer", "full_outer") else left.filter(~_any_null(names))
    right = right if joined and kind in ("right_outer", "full_outer") else right.filter(~_any_null(names))

    parts = [_match(left, right, names, kind) if unique_keys else _match_dealt(left, right, names, kind, hot_rows, joined)]
    order = parts[0].columns
    if not joined and (include_same or "removed" in wanted):
        parts.append(_padded(null_left, right).select(*order))
    if not joined and (include_same or "added" in wanted):
        parts.append(_padded(null_right, left).select(*order))

    rows = _labelled(reduce(DataFrame.unionAll, parts), spec, names)
    if not include_same:
        rows = rows.filter(F.col("change_type").isin(sorted(wanted)))
    if changed_column is not None:
        rows = rows.filter(
            (F.col("change_type") != "changed") | F.array_contains("changed_columns", changed_column)
        )
    return KeyedDiff(rows, spec)


def _hot_keys(left: DataFrame, right: DataFrame, names: list[str], hot_rows: int) -> DataFrame:
    """The largest keys with `hot_rows` rows or more on a side: which side is larger, and whether both have the key."""
    larger = F.greatest("rows_a", "rows_b")
    counts = key_counts(left.select(*names), right.select(*names), names).filter(larger >= hot_rows)
    most = counts.orderBy(larger.desc(), *names).limit(HOT_KEYS)
    return F.broadcast(
        most.select(
            *[F.col(n).alias(f"hot_{n}") for n in names],
            F.when(F.col("rows_a") >= F.col("rows_b"), "a").otherwise("b").alias("dealt"),
            (F.least("rows_a", "rows_b") > 0).alias("matched"),
        )
    )


def _match_dealt(left: DataFrame, right: DataFrame, names: list[str], kind: str, hot_rows: int, nulls: bool = False) -> DataFrame:
    hot = _hot_keys(left, right, names, hot_rows)
    condition = reduce(lambda x, y: x & y, [F.col(n) == F.col(f"hot_{n}") for n in names])
    flags = [f"hot_{n}" for n in names]

    def marked(df: DataFrame) -> DataFrame:
        return df.join(hot, condition, "left").drop(*flags)

    if kind.endswith("_anti"):
        # The hot keys are decided by their own list; only the others are joined, against distinct keys.
        rows, other = (left, right) if kind == "left_anti" else (right, left)
        known = marked(rows)
        alone = known.filter("matched IS NULL").drop("dealt", "matched").join(other.select(*names).distinct(), names, "left_anti")
        both = alone.unionAll(known.filter("NOT matched").drop("dealt", "matched").select(*alone.columns))
        columns = names + [c for c in left.columns + right.columns if c not in names]
        return _padded(both, other).select(*columns)

    def dealt(df: DataFrame, side: str) -> DataFrame:
        every = F.sequence(F.lit(0), F.lit(SALTS - 1))
        own = F.array(F.pmod(F.xxhash64(*[c for c in df.columns if c not in names] or names), F.lit(SALTS)).cast("int"))
        part = F.when(F.col("dealt") == side, own).when(F.col("matched"), every).otherwise(F.array(F.lit(0)))
        if nulls:
            df = df.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
            part = F.when(_any_null(names), F.array("task")).otherwise(part)
        return marked(df).withColumn("part", F.explode(part)).withColumnRenamed("matched", f"matched_{side}").drop("dealt", "task")

    joined = _match(dealt(left, "a"), dealt(right, "b"), [*names, "part"], kind)
    # A copied row has its match in the parts where there is one; what it meets nothing in is no row of the diff.
    lost = (F.col("in_a").isNull() & F.coalesce("matched_b", F.lit(False))) | (F.col("in_b").isNull() & F.coalesce("matched_a", F.lit(False)))
    return joined.filter(~lost).drop("part", "matched_a", "matched_b")


def expanded(rows: DataFrame) -> DataFrame:
    """The pairs of a weighted diff, each as a row of its own."""
    return rows.withColumn("weight", F.explode(F.sequence(F.lit(1), F.col("weight").cast("bigint")))).drop("weight")


def repeated_versions(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None) -> DataFrame:
    """`(key, version, rows_a, rows_b)` of the keys that occur twice or more on a side: linear in the input, whatever
    number of pairs they stand for. Keys with a NULL part match nothing and are left out."""
    spec = diff_spec(a, b, keys, compare)
    left, right, names = _sides(a, b, spec)
    versions = row_versions(left, right, names, len(spec.compare)).filter(~_any_null(names))
    often = versions.groupBy(*names).agg(F.sum("rows_a").alias("n_a"), F.sum("rows_b").alias("n_b"))
    often = often.filter("n_a > 1 OR n_b > 1").select(*names)
    return versions.join(often, names, "left_semi").select(
        F.struct(*[F.col(k).alias(c) for k, c in zip(names, spec.keys)]).alias("key"),
        F.struct(*[F.col(f"v{i}").alias(c) for i, c in enumerate(spec.compare)]).alias("version"),
        "rows_a",
        "rows_b",
    )


def row_versions(left: DataFrame, right: DataFrame, names: Sequence[str], n_values: int) -> DataFrame:
    """Distinct (key, values) with the number of rows on each side."""

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        values = [F.col(f"{tag}{i}").alias(f"v{i}") for i in range(n_values)]
        flags = [F.lit(int(tag == t)).alias(f"in_{t}") for t in ("a", "b")]
        return df.select(*names, *values, *flags)

    both = tagged(left, "a").unionAll(tagged(right, "b"))
    return both.groupBy(*names, *[f"v{i}" for i in range(n_values)]).agg(
        F.sum("in_a").alias("rows_a"), F.sum("in_b").alias("rows_b")
    )


def diff_summary(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None) -> DataFrame:
    """One row: rows_a, rows_b, keys_total, same_count, added_count, removed_count, changed_count.

    Counts joined pairs without joining: equal rows are counted together first, then per key. Both
    aggregations combine before their shuffle, so a key may hold any share of the rows.
    """
    spec = diff_spec(a, b, keys, compare)
    left, right, names = _sides(a, b, spec)
    versions = row_versions(left, right, names, len(spec.compare))
    per_key = versions.groupBy(*names).agg(
        F.sum("rows_a").alias("n_a"),
        F.sum("rows_b").alias("n_b"),
        F.sum(F.col("rows_a") * F.col("rows_b")).alias("equal_pairs"),
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    matched = ~_any_null(names) & (n_a > 0) & (n_b > 0)
    pairs = F.when(matched, n_a * n_b).otherwise(0)
    same = F.when(matched, F.col("equal_pairs")).otherwise(0)
    added = F.when(~matched, n_b).otherwise(0)
    removed = F.when(~matched, n_a).otherwise(0)

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)

    return per_key.agg(
        total(n_a, "rows_a"),
        total(n_b, "rows_b"),
        total(pairs + added + removed, "keys_total"),
        total(same, "same_count"),
        total(added, "added_count"),
        total(removed, "removed_count"),
        total(pairs - same, "changed_count"),
    )


def summary_of(classified: DataFrame) -> DataFrame:
    """The same counts from a diff that was built with `include_same=True` on unique keys: one pass, no join."""

    def count(kind: str) -> Column:
        return F.count_if(F.col("change_type") == kind)

    return classified.agg(
        (F.count("*") - count("added")).alias("rows_a"),
        (F.count("*") - count("removed")).alias("rows_b"),
        F.count("*").alias("keys_total"),
        count("same").alias("same_count"),
        count("added").alias("added_count"),
        count("removed").alias("removed_count"),
        count("changed").alias("changed_count"),
    )


# --- filters -----------------------------------------------------------------------------------


def _checked_types(change_types: Sequence[str] | None) -> set[str]:
    if change_types is None:
        return set(CHANGE_TYPES)
    wanted = {str(t).strip().lower() for t in change_types if str(t).strip()}
    if not wanted:
        raise ValueError("change types are empty")
    unknown = sorted(wanted - set(CHANGE_TYPES))
    if unknown:
        raise ValueError("unknown change types: " + ", ".join(unknown))
    return wanted


def parse_key_filter(text: str, keys: Sequence[str]) -> dict[str, str]:
    """`K1=v1,K2=v2` -> dict; every part needs a known key, once, with a value."""
    out: dict[str, str] = {}
    for part in next(csv.reader([text or ""], skipinitialspace=True), []):
        if not part.strip():
            continue
        name, sign, value = part.partition("=")
        name, value = name.strip(), value.strip()
        if not sign or not name or not value:
            raise ValueError(f"bad key filter, expected COLUMN=VALUE: {part.strip()}")
        if name not in keys:
            raise ValueError(f"key filter on a column that is no key: {name}")
        if name in out:
            raise ValueError(f"key filter names {name} twice")
        out[name] = value
    return out


def key_text_filter(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, str]) -> Column:
    """Key columns whose text equals the wanted text.

    For integers and strings this is written as a plain comparison, which reaches the file scan.
    """
    unknown = sorted(set(wanted) - set(keys))
    if unknown:
        raise ValueError("key filter on columns that are no keys: " + ", ".join(unknown))

    def equals(name: str, text: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            return col(name) == F.lit(text)
        if isinstance(kind, T.IntegralType):
            digits = text[1:] if text.startswith("-") else text
            canonical = digits.isdecimal() and str(int(text)) == text and abs(int(text)) < 2**63
            return col(name) == F.lit(int(text)) if canonical else F.lit(False)
        return col(name).cast("string") == F.lit(text)

    return reduce(lambda x, y: x & y, [equals(n, v) for n, v in wanted.items()], F.lit(True))


def filter_diff(
    rows: DataFrame,
    *,
    change_types: Sequence[str] | None = None,
    key_filter: Mapping[str, str] | None = None,
    changed_column: str | None = None,
) -> DataFrame:
    """The same filters on an existing (persisted, stored) diff. One-sided rows pass `changed_column`."""
    if change_types is not None:
        rows = rows.filter(F.col("change_type").isin(sorted(_checked_types(change_types))))
    if key_filter:
        known = rows.schema["key"].dataType.names
        unknown = sorted(set(key_filter) - set(known))
        if unknown:
            raise ValueError("key filter on columns that are no keys: " + ", ".join(unknown))
        for name, text in key_filter.items():
            rows = rows.filter(F.col("key").getField(name).cast("string") == F.lit(text))
    if changed_column is not None:
        if changed_column not in rows.schema["a"].dataType.names:
            raise ValueError(f"changed column is not compared: {changed_column}")
        rows = rows.filter(
            (F.col("change_type") != "changed") | F.array_contains("changed_columns", changed_column)
        )
    return rows


# --- order and pages ---------------------------------------------------------------------------


def diff_order(rows: DataFrame) -> list[Column]:
    """Keys with NULLs last, then change type, then the values so that repeated keys page the same way each time."""
    keys = [F.col("key").getField(k).asc_nulls_last() for k in rows.schema["key"].dataType.names]
    return keys + [F.col("change_type").asc(), F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last()]


def first_rows(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The diff in key order, cut to `limit` rows; totals come from `diff_summary` and stay complete."""
    ordered = rows.orderBy(*diff_order(rows))
    return ordered if limit is None else ordered.limit(limit)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    page: int
    page_size: int
    total_rows: int
    total_pages: int


# Bounds of a request for a page of a diff.
PAGE_SIZE_DEFAULT, PAGE_SIZE_MAX = 200, 1000


def page_request(raw: Mapping[str, object]) -> dict[str, int]:
    """Checked `page` and `page_size` of a request; `row_limit` stands for the page size where that is not given. The engine
    takes any page size."""
    size = next((raw[k] for k in ("page_size", "row_limit") if raw.get(k) not in (None, "")), PAGE_SIZE_DEFAULT)
    return {"page": whole_number(raw.get("page") or 1, "page", 1), "page_size": whole_number(size, "page_size", 1, PAGE_SIZE_MAX)}


def diff_page(rows: DataFrame, page: int = 1, page_size: int = 200) -> Page:
    """One page in key order; a page past the end becomes the last one.

    For walking through a very long diff use `diff_after`, which never skips rows it has to sort.
    """
    if page < 1:
        raise ValueError("page must be at least 1")
    if page_size < 1:
        raise ValueError("page size must be at least 1")
    total = rows.count()
    pages = max(1, -(-total // page_size))
    page = min(page, pages)
    chosen = rows.orderBy(*diff_order(rows)).offset((page - 1) * page_size).limit(page_size)
    return Page(chosen, page, page_size, total, pages)


def diff_after(rows: DataFrame, last_key: Mapping[str, object] | Row | None, page_size: int = 200) -> DataFrame:
    """The next rows in key order, however deep the page lies, with `copy`, the number of a row among equal ones.

    After the last row of a page (as a mapping or Row, with its `copy`) come the rows that follow it, so a walk meets
    every row once, repeated and NULL keys included. Given key columns alone, it starts with the first row past that key.
    """
    equal = Window.partitionBy("key", "change_type", "a", "b").orderBy(F.lit(0))
    rows = rows.withColumn("copy", F.row_number().over(equal))
    ordered = rows.orderBy(*diff_order(rows), "copy")
    if last_key is None:
        return ordered.limit(page_size)
    if hasattr(last_key, "asDict"):
        last_key = last_key.asDict()
    if "change_type" in last_key:
        return ordered.filter(_follows(rows, last_key)).limit(page_size)
    names = rows.schema["key"].dataType.names
    after, equal_so_far = F.lit(False), F.lit(True)
    for name in names:
        value, bound = F.col("key").getField(name), last_key[name]
        if bound is None:
            beyond, tied = F.lit(False), value.isNull()
        else:
            beyond, tied = value.isNull() | (value > F.lit(bound)), value.eqNullSafe(F.lit(bound))
        after, equal_so_far = after | (equal_so_far & beyond), equal_so_far & tied
    return ordered.filter(after).limit(page_size)


def _follows(rows: DataFrame, last: Mapping[str, object]) -> Column:
    """Rows after `last` in the order of `diff_order`, then by copy."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def literal(name: str) -> Column:
        return F.struct(*[F.lit(last[name][f.name]).cast(f.dataType).alias(f.name) for f in kinds[name].fields])

    steps = []
    for field in kinds["key"].fields:
        value, bound = F.col("key").getField(field.name), last["key"][field.name]
        if bound is None:
            steps.append((F.lit(False), value.isNull()))
        else:
            at = F.lit(bound).cast(field.dataType)
            steps.append((value.isNull() | (value > at), value.eqNullSafe(at)))
    steps.append((F.col("change_type") > F.lit(last["change_type"]), F.col("change_type") == F.lit(last["change_type"])))
    if kinds["a"].fields:
        steps += [(F.col(s) > literal(s), F.col(s).eqNullSafe(literal(s))) for s in ("a", "b")]
    steps.append((F.col("copy") > F.lit(last["copy"]), F.lit(False)))
    after, tied = F.lit(False), F.lit(True)
    for beyond, equal in steps:
        after, tied = after | (tied & F.coalesce(beyond, F.lit(False))), tied & equal
    return after


def flat_diff(rows: DataFrame, separator: str = ",") -> DataFrame:
    """Plain columns: `key_<k>`, `change_type`, `a_<c>`, `b_<c>`, `changed` (joined names); weight and position where rows have them."""
    keys = [F.col("key").getField(k).alias(f"key_{k}") for k in rows.schema["key"].dataType.names]
    pairs = [
        F.col(side).getField(c).alias(f"{side}_{c}") for c in rows.schema["a"].dataType.names for side in ("a", "b")
    ]
    extra = [c for c in ("weight", "position") if c in rows.columns]
    return rows.select(*keys, "change_type", *pairs, F.array_join("changed_columns", separator).alias("changed"), *extra)
