"""Pages of a table or diff that is stored in its order.

Rows are range-partitioned by the order and written by part, each with its place in the part; the rows of each part are counted.
A page is found by running sums over the counts and opens the one or two parts that hold it, however deep it lies and however many rows
tie: no row is skipped, sorted or counted again. Position, page and walk come from the same stored rows, so they agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapscope.functions.names import col
from snapscope.operators.diff import Page, diff_order

# monotonically_increasing_id has the partition above these bits and the row within it below.
_ROW_BITS = 33
PART, PLACE = "_page_part", "_page_place"


@dataclass(frozen=True)
class StoredPages:
    """`rows` with their part and place; `starts(part, n, start)`, one line per part."""

    rows: DataFrame
    starts: DataFrame
    total: int


def store_pages(df: DataFrame, order: Sequence[Column | str], path: str) -> StoredPages:
    """Write the rows in their order; ties are put in an order that then stays."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = spread.withColumn("_at", F.monotonically_increasing_id()).select(
        *[col(c) for c in df.columns], F.shiftright("_at", _ROW_BITS).cast("int").alias(PART),
        F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(PLACE))
    numbered.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    # Its schema beside it, since a folder without rows tells none.
    df.sparkSession.createDataFrame([], numbered.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")
    rows = df.sparkSession.read.schema(numbered.schema).parquet(f"{path}/rows")
    counts = rows.groupBy(PART).agg(F.count("*").alias("n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts.select(PART, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).coalesce(1).write.mode("overwrite").parquet(f"{path}/starts")
    return read_pages(df.sparkSession, path)


def read_pages(spark: SparkSession, path: str) -> StoredPages:
    starts = spark.read.schema(f"{PART} INT, n BIGINT, start BIGINT").parquet(f"{path}/starts")
    kind = spark.read.parquet(f"{path}/kind").schema
    total = starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return StoredPages(spark.read.schema(kind).parquet(f"{path}/rows"), starts, total)


def rows_at(pages: StoredPages, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 with their `position`, in order. The lines of the parts they lie in are fetched, at most one per row wanted."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit at least 1")
    held = pages.starts.filter((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset) & (F.col("n") > 0)).collect()
    names = [c for c in pages.rows.columns if c not in (PART, PLACE)]
    start = F.lit(0).cast("bigint")
    for row in held:
        start = F.when(F.col(PART) == row[PART], row["start"]).otherwise(start)
    few = pages.rows.filter(F.col(PART).isin([row[PART] for row in held])).withColumn("position", start + F.col(PLACE))
    few = few.filter((F.col("position") >= offset) & (F.col("position") < offset + limit))
    return few.select(*[col(c) for c in names], "position").orderBy("position")


def page_of(pages: StoredPages, page: int = 1, page_size: int = 200) -> Page:
    """One page; a page past the end becomes the last one."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page size must be at least 1")
    last = max(1, -(-pages.total // page_size))
    page = min(page, last)
    return Page(rows_at(pages, (page - 1) * page_size, page_size), page, page_size, pages.total, last)


def store_diff(rows: DataFrame, path: str) -> StoredPages:
    """A diff in the order of its pages."""
    return store_pages(rows, diff_order(rows), path)
