"""Writing results: CSV for spreadsheets, JSON, text. Each export is one distributed write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapscope.functions.names import col
from snapscope.functions.numbers import as_text
from snapscope.functions.serial import json_ready
from snapscope.functions.text import quoted_cell, semicolon_cell, spreadsheet_safe


def diff_csv_columns(rows: DataFrame) -> DataFrame:
    """The diff as `K_<key>`, `type`, `A_<c>`, `B_<c>`, every cell safe for a spreadsheet."""
    keys = [spreadsheet_safe(F.col("key").getField(k)).alias(f"K_{k}") for k in rows.schema["key"].dataType.names]
    cells = [
        spreadsheet_safe(F.col(side).getField(c)).alias(f"{side.upper()}_{c}")
        for c in rows.schema["a"].dataType.names
        for side in ("a", "b")
    ]
    return rows.select(*keys, F.col("change_type").alias("type"), *cells)


def diff_csv_lines(rows: DataFrame) -> DataFrame:
    """The same as finished `;` lines, for a text sink or a download."""
    keys = [semicolon_cell(F.col("key").getField(k)) for k in rows.schema["key"].dataType.names]
    cells = [semicolon_cell(F.col(s).getField(c)) for c in rows.schema["a"].dataType.names for s in ("a", "b")]
    return rows.select(F.concat_ws(";", *keys, semicolon_cell(F.col("change_type")), *cells).alias("line"))


def diff_csv_header(rows: DataFrame) -> str:
    cells = [f"{s}_{c}" for c in rows.schema["a"].dataType.names for s in ("A", "B")]
    return ";".join([f"K_{k}" for k in rows.schema["key"].dataType.names] + ["type"] + cells)


def _csv(df: DataFrame, path: str, sep: str, quote_all: bool = False) -> None:
    options = {"header": "true", "sep": sep, "quoteAll": str(quote_all).lower(), "escape": '"', "emptyValue": ""}
    df.write.mode("overwrite").options(**options).csv(path)


def write_diff_csv(rows: DataFrame, path: str) -> None:
    _csv(diff_csv_columns(rows), path, ";")


def write_table_csv(df: DataFrame, path: str) -> None:
    """A whole table, every cell quoted: one job, whatever its size."""
    flat = df.select(*[as_text(json_ready(col(f.name), f.dataType), f.dataType).alias(f.name) for f in df.schema.fields])
    _csv(flat.na.fill(""), path, ",", quote_all=True)


def table_csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[quoted_cell(col(c)) for c in df.columns]).alias("line"))


def write_results_csv(results: DataFrame, path: str) -> None:
    _csv(results.na.fill(""), path, ",", quote_all=True)


def write_diff_report(
    rows: DataFrame, summary: DataFrame, path: str, source: dict[str, str], filters: dict[str, str] | None = None
) -> None:
    """A JSON report in two parts: `rows` (one object per diff row) and a one-row `summary` with source and filters."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/rows")
    facts = [F.lit(v).alias(k) for k, v in source.items()]
    head = summary.select(
        F.lit("1.1").alias("report_version"), F.current_timestamp().alias("generated_at"),
        F.struct(*facts).alias("source"),
        F.to_json(F.create_map(*[F.lit(x) for item in (filters or {}).items() for x in item])).alias("filters"),
        F.struct("*").alias("summary"),
    )
    head.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/summary")


def write_profile(profile_rows: DataFrame, top_rows: DataFrame, path: str) -> None:
    """Profile as one CSV, top values in a folder per column."""
    _csv(profile_rows.coalesce(1), f"{path}/summary_by_column", ",")
    out = top_rows.select("coluna", "valor", "contagem").repartition("coluna").sortWithinPartitions(
        "coluna", F.col("contagem").desc(), "valor"
    )
    out.write.mode("overwrite").option("header", "true").partitionBy("coluna").csv(f"{path}/columns")


def write_global(summary: DataFrame, counts: DataFrame, path: str) -> None:
    _csv(summary.coalesce(1), f"{path}/global_summary", ",")
    counts.write.mode("overwrite").parquet(f"{path}/global_counts")


def write_track(ledger: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Track rows as CSV; the catalog bounds them, so one file is fine."""
    _csv(ledger.select(*(columns or ledger.columns)).orderBy("order_idx").coalesce(1), path, ",")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_run_report(items: DataFrame, totals: DataFrame, path: str) -> None:
    """Ingest report: items as JSON and CSV, totals as one JSON object."""
    items.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/items_json")
    _csv(items, f"{path}/items_csv", ",")
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/totals")
