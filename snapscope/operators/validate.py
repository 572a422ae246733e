"""Is a copy of a database faithful? Tables, columns, row counts, sampled rows, and all rows.

Rows are compared by the SHA-256 of their canonical form. One shuffle of digests counts the copies of every row on
both sides, which gives the row counts and decides on all rows. The sample is the rows of smallest digest: as good as
a random one, the same on both sides of a faithful copy, and found by a top-k without any order of the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapscope.functions.serial import canonical_row

SAMPLE_POINTS = 9
TABLE_SCHEMA = (
    "table_name STRING, status STRING, columns_ok BOOLEAN, rows_source BIGINT, rows_copy BIGINT, rows_ok BOOLEAN, "
    "sampled BIGINT, sample_hash_source STRING, sample_hash_copy STRING, first_mismatch BIGINT, content_ok BOOLEAN, issue STRING"
)


def digests(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(digest, canonical) of every row."""
    canonical = canonical_row(df, columns)
    return df.select(F.sha2(canonical, 256).alias("digest"), canonical.alias("canonical"))


def sampled_rows(df: DataFrame, points: int = SAMPLE_POINTS, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of smallest digest with their position in that order; equal rows stand next to each other."""
    few = digests(df, columns).orderBy("digest").limit(points)
    return few.withColumn("position", F.row_number().over(Window.orderBy("digest")) - 1)


def sample_check(source: DataFrame, copy: DataFrame, points: int = SAMPLE_POINTS) -> DataFrame:
    """One row: sampled, sample_hash_source, sample_hash_copy (SHA-256 over the sampled rows in order, one JSON line
    each), first_mismatch (the first position where they differ)."""
    left = sampled_rows(source, points, source.columns).select("position", F.col("canonical").alias("a"))
    right = sampled_rows(copy, points, source.columns).select("position", F.col("canonical").alias("b"))
    both = left.join(right, "position", "full_outer")

    def whole(side: str) -> Column:
        lines = F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("position", side))))
        return F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x[side], F.lit("\n"))), ""), 256)

    return both.agg(
        F.count("a").alias("sampled"), whole("a").alias("sample_hash_source"), whole("b").alias("sample_hash_copy"),
        F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("position"))).cast("bigint").alias("first_mismatch"),
    )


def digest_counts(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Digests with the number of rows that have them on each side."""
    tagged = digests(source, source.columns).select("digest", F.lit(1).alias("s"), F.lit(0).alias("c")).unionAll(
        digests(copy, source.columns).select("digest", F.lit(0), F.lit(1)))
    return tagged.groupBy("digest").agg(F.sum("s").alias("copies_source"), F.sum("c").alias("copies_copy"))


def row_differences(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Canonical rows whose number of copies differs between the two; texts are fetched for those only."""
    unlike = digest_counts(source, copy).filter("copies_source <> copies_copy")
    texts = digests(source, source.columns).unionAll(digests(copy, source.columns))
    found = texts.join(unlike, "digest").groupBy("digest", "copies_source", "copies_copy").agg(F.any_value("canonical").alias("canonical"))
    return found.select("canonical", "copies_source", "copies_copy")


def table_sets(source: Sequence[str], copy: Sequence[str]) -> dict[str, list[str]]:
    """Missing and extra tables."""
    return {"missing": sorted(set(source) - set(copy)), "extra": sorted(set(copy) - set(source))}


def validate_table(name: str, source: DataFrame, copy: DataFrame, sample: bool = True, full: bool = True) -> tuple:
    """Checks of one table as a row of `TABLE_SCHEMA`."""
    columns_ok = source.columns == copy.columns
    if not columns_ok:
        return (name, "failed", False, None, None, None, None, None, None, None, None, "columns differ")
    n_source, n_copy, unlike = digest_counts(source, copy).agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("copies_source", "copies_copy")], F.count_if(F.col("copies_source") != F.col("copies_copy"))
    ).first()
    rows_ok = n_source == n_copy
    issues = [] if rows_ok else [f"row count {n_source} != {n_copy}"]
    sampled, hash_source, hash_copy, mismatch, content_ok = None, None, None, None, None
    if rows_ok and sample and n_source:
        sampled, hash_source, hash_copy, mismatch = sample_check(source, copy).first()
        if hash_source != hash_copy:
            issues.append(f"sample differs at position {mismatch}")
    if rows_ok and full:
        content_ok = unlike == 0
        if not content_ok:
            issues.append(f"rows differ: {unlike}")
    status = "failed" if issues else "ok"
    return (name, status, columns_ok, n_source, n_copy, rows_ok, sampled, hash_source, hash_copy, mismatch, content_ok, "; ".join(issues) or None)


def validate_copy(
    spark: SparkSession, source: Mapping[str, DataFrame], copy: Mapping[str, DataFrame], sample: bool = True,
    full: bool = True, parallel: int = 4,
) -> DataFrame:
    """One row per table of either side; only result rows reach the driver."""

    def run(name: str) -> tuple:
        nothing = (None,) * 9
        if name not in copy:
            return (name, "failed", *nothing, "table missing in copy")
        if name not in source:
            return (name, "failed", *nothing, "extra table in copy")
        try:
            return validate_table(name, source[name], copy[name], sample, full)
        except Exception as problem:
            return (name, "failed", *nothing, str(problem).split("\n")[0])

    names = list(dict.fromkeys([*source, *copy]))
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return spark.createDataFrame(list(pool.map(run, names)), TABLE_SCHEMA)


def verdict(tables: DataFrame) -> DataFrame:
    """One row: ok only without any issue; a copy may become active only then."""
    return tables.agg(
        F.when(F.count_if(F.col("status") != "ok") == 0, "ok").otherwise("failed").alias("status"),
        F.count("*").alias("tables_checked"),
        F.count_if(F.col("status") == "ok").alias("tables_ok"),
        F.count_if(F.col("status") != "ok").alias("tables_failed"),
        F.coalesce(F.sum("rows_source"), F.lit(0)).alias("rows_source"),
        F.coalesce(F.sum("rows_copy"), F.lit(0)).alias("rows_copy"),
    )
