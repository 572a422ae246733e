"""Loading snapshots into one store, with a ledger that makes every load repeatable.

The store keeps one parquet dataset per table, partitioned by snapshot date, so loading a snapshot
touches only its own partition and reading one date prunes the others. The ledger is an append-only
parquet dataset `(import_id, source_file, file_date, import_timestamp, table_name, row_count)`.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.names import col, collision_free_name, safe_table_name
from snapscope.functions.serial import flatten_nested
from snapscope.functions.text import NO_DATA_PHRASES, is_no_data_message
from snapscope.sources.catalog import REJECTED, read_snapshot

LEDGER_SCHEMA = (
    "import_id STRING, source_file STRING, file_date DATE, import_timestamp TIMESTAMP, table_name STRING, row_count BIGINT,"
    " rejected_count BIGINT"
)
DATE_COLUMN = "snapshot_date"


def dated_table_name(table: str, date: dt.date) -> str:
    return f"{table}_{date:%Y%m%d}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text under a safe name, nested values as JSON, bytes as hex."""
    flat = flatten_nested(df)
    names = [safe_table_name(c) for c in flat.columns]
    doubled = {n for n in names if names.count(n) > 1}
    if doubled:
        raise ValueError("column names collide once made safe: " + ", ".join(sorted(doubled)))
    return flat.select(*[col(c).cast("string").alias(n) for c, n in zip(flat.columns, names)])


@dataclass(frozen=True)
class TableLoad:
    table: str
    status: str  # loaded | kept | no_data | failed
    row_count: int = 0
    message: str = ""
    rejected: int = 0


@dataclass(frozen=True)
class SnapshotLoad:
    """Result of one snapshot: the verdict, its message and a line per table."""

    source: str
    ok: bool
    message: str
    tables: tuple[TableLoad, ...]


def ingest_snapshot(
    spark: SparkSession,
    source: str,
    tables: Mapping[str, DataFrame],
    store: str,
    file_date: dt.date | None = None,
    variant: str = "typed",
    allow_skips: bool = False,
    parallel: int = 4,
) -> SnapshotLoad:
    """Load all tables of a snapshot.

    typed  columns keep their types; the first load of a (table, date) wins and later ones are kept out
    text   every column as text under a safe name; a new load replaces the partition, empty tables are recorded

    Lines of a CSV file that don't fit its header (see `read_snapshot(rejects=True)`) are stored under `_rejected`, whole and as
    far as they could be read, and counted in the ledger. Two tables whose safe names are equal get names of their own.

    Without `allow_skips` one unreadable table fails the verdict; a table that merely has no data does not.
    """
    date = file_date or dt.date.today()
    ledger_path = f"{store}/_ledger"
    names = stored_names(source, tables, variant)
    wanted = spark.createDataFrame([(n, dated_table_name(s, date)) for n, s in names.items()], "name STRING, table_name STRING")
    fresh = {r["name"] for r in new_loads(wanted, read_ledger(spark, ledger_path)).collect()}

    def load(item: tuple[str, DataFrame]) -> TableLoad:
        name, df = item
        stored = names[name]
        if variant == "typed" and name not in fresh:
            return TableLoad(name, "kept")
        try:
            rejected = 0
            if REJECTED in df.columns:
                bad = f"{store}/_rejected/{stored}/{DATE_COLUMN}={date.isoformat()}"
                df.filter(F.col(REJECTED).isNotNull()).write.mode("overwrite").parquet(bad)
                rejected = spark.read.schema(f"{REJECTED} STRING").parquet(bad).count()
                df = df.filter(F.col(REJECTED).isNull()).drop(REJECTED)
            shaped = all_text(df) if variant == "text" else df
            path = f"{store}/{stored}/{DATE_COLUMN}={date.isoformat()}"
            # The partition is written whole, so a load that was cut short is simply written again.
            shaped.write.mode("overwrite").parquet(path)
            line = ledger_rows(source, F.lit(date), {stored: spark.read.schema(shaped.schema).parquet(path)}).first()
            rows = line["row_count"] if line else 0
        except Exception as problem:
            text = str(problem)
            empty = any(p in text.lower() for p in NO_DATA_PHRASES)
            return TableLoad(name, "no_data" if empty else "failed", 0, text)
        return TableLoad(name, "loaded" if rows or variant == "text" else "no_data", rows, rejected=rejected)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        loads = tuple(pool.map(load, tables.items()))
    now = dt.datetime.now()
    lines = [
        (str(uuid.uuid4()), source, date, now, dated_table_name(names[t.table], date), t.row_count, t.rejected)
        for t in loads
        if t.status in ("loaded", "no_data") and not t.message
    ]
    if lines:
        spark.createDataFrame(lines, LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(ledger_path)
    ok, message = load_verdict(loads, allow_skips)
    return SnapshotLoad(source, ok, message, loads)


def load_verdict(loads: Sequence[TableLoad], allow_skips: bool = False) -> tuple[bool, str]:
    """Strict: an unreadable table fails the load. All tables empty is a success; no table at all converted is not."""
    failed = [t for t in loads if t.status == "failed"]
    empty = [t for t in loads if t.status == "no_data"]
    good = [t for t in loads if t.status in ("loaded", "kept")]
    if failed and not allow_skips:
        samples = "; ".join(f"{t.table}: {t.message}" for t in failed)
        return False, f"strict mode: skipped {len(failed)}/{len(loads)} table(s). samples: {samples}"
    if loads and not good:
        if len(empty) == len(loads):
            return True, "all tables without data"
        return False, "strict mode: no tables converted"
    rejected = sum(t.rejected for t in loads)
    notes = [f"skipped={len(failed)}"] * bool(failed) + [f"rejected lines={rejected}"] * bool(rejected)
    return True, f"converted ({', '.join(notes)})" if notes else "converted"


def stored_names(source: str, tables: Iterable[str], variant: str = "typed") -> dict[str, str]:
    """The name each table is stored under; where safe names collide, each gets a digest of its own."""
    safe = {t: safe_table_name(t) if variant == "text" else t for t in tables}
    taken = Counter(n.lower() for n in safe.values())
    return {t: n if taken[n.lower()] == 1 else collision_free_name(n, source, t) for t, n in safe.items()}


def ingest_folder(spark: SparkSession, files: DataFrame, store: str, **options) -> list[SnapshotLoad]:
    """Every snapshot of a file catalog in name order; the driver only submits the writes."""
    names = files.groupBy("snapshot").agg(F.max("snapshot_date").alias("d")).orderBy("snapshot").collect()
    return [
        ingest_snapshot(spark, r.snapshot, read_snapshot(spark, files, r.snapshot, rejects=True), store, r.d, **options) for r in names
    ]


def ledger_rows(source: str, date: Column, tables: Mapping[str, DataFrame], by: str | None = None) -> DataFrame:
    """Ledger lines computed by Spark: per table (and snapshot column `by`) its dated name and row count."""
    def lines(name: str, df: DataFrame) -> DataFrame:
        when = date if by is None else col(by)
        counted = df.groupBy(when.alias("file_date")).agg(F.count("*").alias("row_count"))
        dated = F.concat(F.lit(f"{name}_"), F.date_format("file_date", "yyyyMMdd"))
        return counted.select(F.lit(source).alias("source_file"), "file_date", dated.alias("table_name"), "row_count")

    return reduce(DataFrame.unionByName, [lines(n, df) for n, df in tables.items()])


def new_loads(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Wanted ledger lines whose table is not in the ledger yet."""
    return wanted.join(ledger.select("table_name").distinct(), "table_name", "left_anti")


# --- reshaping of awkward sources --------------------------------------------------------------


def rows_from_lists(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column lists -> rows: shorter lists are filled with NULL, a scalar counts as a list of one."""
    names = list(columns or df.columns)
    rest = [c for c in df.columns if c not in names]
    lists = []
    for name in names:
        value = col(name)
        if not isinstance(df.schema[name].dataType, T.ArrayType):
            value = F.when(value.isNotNull(), F.array(value))
        lists.append(F.coalesce(value, F.array().cast(_list_type(df, name))).alias(name))
    return df.select(*[col(c) for c in rest], F.inline(F.arrays_zip(*lists)))


def _list_type(df: DataFrame, name: str) -> T.DataType:
    kind = df.schema[name].dataType
    return kind if isinstance(kind, T.ArrayType) else T.ArrayType(kind)


def records_from_json(df: DataFrame, text: str, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """JSON lines of mixed shape -> named text fields.

    An object gives its fields (names starting with `_` are private and dropped), a list `col_0..n`,
    anything else `value`. `fields` names the wanted ones; `json_fields` finds them.
    """
    as_map = _json_map(col(text))
    return df.select(*[col(c) for c in keep], *[as_map.getItem(f).alias(f) for f in fields if not f.startswith("_")])


def json_fields(df: DataFrame, text: str) -> DataFrame:
    """The distinct field names of the mixed JSON lines (a narrow aggregation, combined early)."""
    return (
        df.select(F.explode(F.map_keys(_json_map(col(text)))).alias("field"))
        .filter(~F.col("field").startswith("_"))
        .groupBy("field")
        .agg(F.count("*").alias("row_count"))
    )


def _json_map(value: Column) -> Column:
    body = F.trim(value)
    as_object = F.from_json(body, "map<string,string>")
    as_list = F.from_json(body, "array<string>")
    listed = F.map_from_arrays(
        F.transform(F.sequence(F.lit(0), F.size(as_list) - 1), lambda i: F.concat(F.lit("col_"), i.cast("string"))), as_list
    )
    scalar = F.get_json_object(F.concat(F.lit('{"v":'), body, F.lit("}")), "$.v")
    return (
        F.when(body.startswith("{"), as_object)
        .when(body.startswith("[") & (F.size(as_list) > 0), listed)
        .when(body.startswith("["), F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("value"), F.coalesce(scalar, body)))
    )


# --- type classes on copy ----------------------------------------------------------------------


def type_class(data_type: T.DataType, target: str = "five") -> str:
    """Class of a type on copy. four: INTEGER REAL BLOB TEXT; five: BIGINT DOUBLE BLOB TIMESTAMP VARCHAR; six adds BOOLEAN."""
    whole = isinstance(data_type, T.IntegralType)
    broken = isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType))
    binary = isinstance(data_type, T.BinaryType)
    time = isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))
    if target == "four":
        return "INTEGER" if whole else "REAL" if broken else "BLOB" if binary else "TEXT"
    if target == "six" and isinstance(data_type, T.BooleanType):
        return "BOOLEAN"
    return "BIGINT" if whole else "DOUBLE" if broken else "BLOB" if binary else "TIMESTAMP" if time else "VARCHAR"


_CAST = {"INTEGER": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "TIMESTAMP": "timestamp",
         "BOOLEAN": "boolean", "VARCHAR": "string", "TEXT": "string", "BLOB": "binary"}


def coerced(df: DataFrame, target: str = "five") -> DataFrame:
    """Columns cast to their type class."""
    return df.select(*[col(f.name).cast(_CAST[type_class(f.dataType, target)]).alias(f.name) for f in df.schema.fields])


def copy_tables(tables: Mapping[str, DataFrame], target_path: str, kind: str = "parquet", classes: str = "five", **options) -> list[str]:
    """Copy every table to another store in a neutral type system; `kind` is any Spark writer (parquet, orc, csv, json, jdbc)."""
    done = []
    for name, df in tables.items():
        writer = coerced(df, classes).write.format(kind).mode("overwrite").options(**options)
        if kind == "jdbc":
            writer.option("dbtable", name).save()
        else:
            writer.save(f"{target_path}/{name}")
        done.append(name)
    return done


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """Store a version as a table bucketed by its keys: diffs of versions stored alike need no shuffle at all."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


# --- reports -----------------------------------------------------------------------------------


def source_id(relpath: Column) -> Column:
    """`<folders>_<stem>_<suffix>` in lower case with everything odd turned into `_`."""

    def cleaned(text: Column) -> Column:
        safe = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
        return F.when(safe == "", "db").otherwise(safe)

    folders = F.regexp_replace(F.regexp_replace(relpath, r"/?[^/]*$", ""), "/", "_")
    name = F.element_at(F.split(relpath, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    base = F.concat_ws("_", cleaned(stem), suffix)
    return F.when(folders != "", F.concat_ws("_", cleaned(folders), base)).otherwise(base)


def manifest(files: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per source with its id; `counts(path, table_count)` may add table counts, -1 where unknown."""
    rows = files.select(source_id(F.col("relpath")).alias("id"), "path", F.col("format").alias("source_suffix"), "size_bytes")
    if counts is None:
        return rows
    return rows.join(counts, "path", "left").withColumn("table_count", F.coalesce("table_count", F.lit(-1)))


def reliability(items: DataFrame) -> DataFrame:
    """Items with `reliability_ok`: both steps worked and the table counts agree."""
    ok = F.col("load_ok") & F.col("copy_ok") & (F.col("load_tables") >= 0) & (F.col("load_tables") == F.col("copy_tables"))
    return items.withColumn("reliability_ok", F.coalesce(ok, F.lit(False)))


def run_report(items: DataFrame) -> DataFrame:
    """Totals of an ingest run over `reliability` items."""
    return items.agg(
        F.count("*").alias("total_files"),
        F.count_if("reliability_ok").alias("reliability_ok"),
        F.count_if(~F.col("reliability_ok")).alias("reliability_fail"),
        F.count_if("load_ok").alias("load_ok"),
        F.count_if("copy_ok").alias("copy_ok"),
        F.round(F.coalesce(F.sum("load_seconds"), F.lit(0.0)), 3).alias("total_load_seconds"),
        F.round(F.coalesce(F.sum("copy_seconds"), F.lit(0.0)), 3).alias("total_copy_seconds"),
    )


def manifest_status(items: DataFrame) -> DataFrame:
    """Totals by source suffix, as (metric, value) rows."""
    totals = items.agg(
        F.count("*").alias("total_sources"), F.count_if("load_ok").alias("load_ok"), F.count_if("copy_ok").alias("copy_ok")
    ).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("total_sources", "load_ok", "copy_ok")])))
    suffixes = items.groupBy(F.lower(F.coalesce("source_suffix", F.lit(""))).alias("s")).agg(F.count("*").alias("value"))
    shown = F.when(F.col("s") == "", "(none)").otherwise(F.col("s"))
    return totals.unionByName(suffixes.select(F.concat(F.lit("suffix:"), shown).alias("metric"), "value"))


def first_failures(items: DataFrame, kind: str = "load", shown: int | None = None) -> DataFrame:
    """The failed items of a step in order, or the first `shown`; copies count only where the load worked."""
    failed = ~F.col(f"{kind}_ok")
    if kind == "copy":
        failed = F.col("load_ok") & failed
    ordered = items.filter(failed).orderBy("id")
    return (ordered if shown is None else ordered.limit(shown)).select("id", F.coalesce(f"{kind}_message", F.lit("failed")).alias("message"))


def classify_messages(loads: DataFrame) -> DataFrame:
    """Ledger of table loads `(table_name, message)` -> status ok / no_data / failed."""
    status = F.when(F.col("message").isNull() | (F.col("message") == ""), "ok").when(is_no_data_message(F.col("message")), "no_data")
    return loads.withColumn("status", status.otherwise("failed"))
