"""Keyless content diff of two tables and the overview of two whole databases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapscope.functions.names import col, common_columns, reject_case_clashes
from snapscope.operators.diff import comparable

OVERVIEW_SCHEMA = (
    "table_name STRING, status STRING, row_count_a BIGINT, row_count_b BIGINT, diff_count BIGINT, error STRING"
)
STATUSES = ("same", "diff", "no_key", "error")
NO_COMMON_COLUMNS = "tabela sem colunas em comum"


def content_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows over the common columns with their number of copies on each side, in one shuffle."""
    common = common_columns(a, b)
    reject_case_clashes(common)
    a, b = comparable(a, b, common)
    names = [f"v{i}" for i in range(len(common))]

    def tagged(df: DataFrame, in_a: int) -> DataFrame:
        values = [col(c).alias(n) for c, n in zip(common, names)]
        return df.select(*values, F.lit(in_a).alias("in_a"), F.lit(1 - in_a).alias("in_b"))

    both = tagged(a, 1).unionAll(tagged(b, 0))
    counted = both.groupBy(*names).agg(F.sum("in_a").alias("rows_a"), F.sum("in_b").alias("rows_b"))
    return counted.select(*[F.col(n).alias(c) for n, c in zip(names, common)], "rows_a", "rows_b")


def content_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row `rows_a, rows_b, diff_count`: how many distinct rows occur on one side only.

    Row order and copies do not matter. Without common columns the counts are 0 and the diff is -1.
    """
    if not common_columns(a, b):
        return a.sparkSession.range(1).selectExpr("0L AS rows_a", "0L AS rows_b", "-1L AS diff_count")
    versions = content_versions(a, b)
    # `rows_a` may also be the name of a data column, so the two counters are addressed by position.
    counts = versions.toDF(*[f"v{i}" for i in range(len(versions.columns) - 2)], "n_a", "n_b").select("n_a", "n_b")
    return counts.agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"),
        F.count_if((F.col("n_a") == 0) | (F.col("n_b") == 0)).alias("diff_count"),
    )


def one_sided_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows behind the count, with `side` telling where they occur."""
    versions = content_versions(a, b)
    names = versions.columns[:-2]
    flat = versions.toDF(*[f"v{i}" for i in range(len(names))], "n_a", "n_b")
    side = F.when(F.col("n_b") == 0, "a").when(F.col("n_a") == 0, "b")
    return flat.filter(side.isNotNull()).select(
        side.alias("side"), *[F.col(f"v{i}").alias(n) for i, n in enumerate(names)]
    )


def overview_tables(
    a: Mapping[str, DataFrame], b: Mapping[str, DataFrame], tables: Sequence[str] | None = None
) -> list[str]:
    """Common tables in the order of A; an allow-list is trimmed and de-duplicated."""
    common = [t for t in a if t in b]
    if tables is not None:
        wanted = {t.strip() for t in tables if t and t.strip()}
        common = [t for t in common if t in wanted]
    return common


def table_overview(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """The overview row of one table, as a lazy plan."""
    if common_columns(a, b):
        counts = content_diff(a, b)
        status = F.when(F.col("diff_count") == 0, "same").otherwise("diff")
    else:
        sides = a.select(F.lit(1).alias("in_a")).unionAll(b.select(F.lit(0)))
        counts = sides.agg(
            F.count_if(F.col("in_a") == 1).alias("rows_a"), F.count_if(F.col("in_a") == 0).alias("rows_b")
        ).withColumn("diff_count", F.lit(-1).cast("bigint"))
        status = F.lit("no_key")
    return counts.select(
        F.lit(name).alias("table_name"),
        status.alias("status"),
        F.col("rows_a").alias("row_count_a"),
        F.col("rows_b").alias("row_count_b"),
        "diff_count",
        F.when(status == "no_key", NO_COMMON_COLUMNS).alias("error"),
    )


def overview_plan(
    a: Mapping[str, DataFrame], b: Mapping[str, DataFrame], tables: Sequence[str] | None = None
) -> DataFrame:
    """All tables as one lazy plan. A table that cannot be read fails the whole plan; see `overview`."""
    names = overview_tables(a, b, tables)
    if not names:
        return next(iter(a.values())).sparkSession.createDataFrame([], OVERVIEW_SCHEMA)
    return reduce(DataFrame.unionAll, [table_overview(t, a[t], b[t]) for t in names])


def overview(
    spark: SparkSession,
    a: Mapping[str, DataFrame],
    b: Mapping[str, DataFrame],
    tables: Sequence[str] | None = None,
    parallel: int = 8,
) -> DataFrame:
    """One row per common table. Tables run side by side and a failing one becomes an `error` row.

    Only one result row per table reaches the driver.
    """

    def run(name: str) -> tuple:
        try:
            return tuple(table_overview(name, a[name], b[name]).first())
        except Exception as problem:
            return (name, "error", None, None, -1, str(problem))

    names = overview_tables(a, b, tables)
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return spark.createDataFrame(list(pool.map(run, names)), OVERVIEW_SCHEMA)


def overview_summary(rows: DataFrame) -> DataFrame:
    """Tables by status in one row; an unknown status counts as an error."""
    status = F.lower("status")
    known = status.isin("same", "diff", "no_key")
    return rows.agg(
        F.count("*").alias("total_tables"),
        F.count_if(status == "same").alias("same_tables"),
        F.count_if(status == "diff").alias("diff_tables"),
        F.count_if(status == "no_key").alias("no_key_tables"),
        F.count_if(F.coalesce(~known, F.lit(True))).alias("error_tables"),
    )


def report_order(rows: DataFrame) -> DataFrame:
    """Tables that are not equal: differing ones first, most differences first, then by name."""
    is_diff = F.col("status") == "diff"
    weight = F.when(is_diff, F.coalesce(F.col("diff_count"), F.lit(0))).otherwise(-1)
    return rows.filter(F.coalesce(F.col("status") != "same", F.lit(True))).orderBy(
        is_diff.desc_nulls_last(), weight.desc(), F.col("table_name")
    )
