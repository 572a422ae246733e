"""What lies in a snapshot folder: files, snapshots and tables as DataFrames.

Layout: `<base>/.../<snapshot>/<table>.<ext>` or `<base>/.../<snapshot>/<table>/part-*.<ext>`; the
snapshot's date is in its name. Listings use the binary-file source without its content column, so
only file metadata is read, on any file system Spark can reach.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow.fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.dates import date_in_name
from snapscope.functions.names import col, user_tables

# Suffix -> format; the date that stands for "no date" when newest come first; bytes hashed per file.
FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "orc": "orc"}
NO_DATE = "1900-01-01"
HASHED_BYTES = 65536
READ_BYTES = 1 << 20
# Types that the texts of a CSV column may take, the narrowest first.
CSV_TYPES = ("INT", "BIGINT", "DOUBLE", "DATE", "TIMESTAMP", "BOOLEAN")
PREFERRED_FORMAT = "parquet"


def format_of(path: str) -> str | None:
    """Format by suffix, None when it is not supported."""
    return FORMATS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.(\w+)$", 1))


def _format(name: Column) -> Column:
    pairs = [F.lit(x) for item in FORMATS.items() for x in item]
    return F.create_map(*pairs).getItem(_suffix(name))


def _listing(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)


def _placed(df: DataFrame, base: str) -> DataFrame:
    """Add relpath, file_name, table_rel and snapshot, derived from the `path` column."""
    root = re.escape(base.rstrip("/").split("://")[-1].lstrip("/"))
    named = df.withColumn("relpath", F.regexp_replace("path", f"^.*?{root}/", ""))
    named = named.withColumn("file_name", F.element_at(F.split("relpath", "/"), -1))
    in_folder = F.col("file_name").rlike("^part-") & F.col("relpath").contains("/")
    # Part files belong to their folder, below which there may be partition folders like day=2024-01-01.
    folder = F.regexp_replace(F.regexp_replace("relpath", "/[^/]*$", ""), "(/[^/=]+=[^/]*)+$", "")
    named = named.withColumn("table_rel", F.when(in_folder, folder).otherwise(F.col("relpath")))
    above = F.regexp_replace("table_rel", "/[^/]*$", "")
    return named.withColumn("snapshot", F.when(F.col("table_rel").contains("/"), above).otherwise(F.col("file_name")))


def file_catalog(spark: SparkSession, base: str, date_rule: str = "loose") -> DataFrame:
    """Supported files below `base`: path, relpath, file_name, format, snapshot, table_name, table_path, snapshot_date,
    mtime, size_bytes.

    `table_path` is what to read: the file itself, or the folder around its part files.
    """
    listed = _placed(_listing(spark, base).select("path", "modificationTime", "length"), base)
    upto_table = F.length("path") - F.length("relpath") + F.length("table_rel")
    table_file = F.element_at(F.split("table_rel", "/"), -1)
    kind = _format(F.col("file_name"))
    return listed.filter(kind.isNotNull()).select(
        "path",
        "relpath",
        "file_name",
        kind.alias("format"),
        "snapshot",
        F.regexp_replace(table_file, r"\.\w+$", "").alias("table_name"),
        F.substring(F.col("path"), F.lit(1), upto_table).alias("table_path"),
        date_in_name(F.element_at(F.split("snapshot", "/"), -1), date_rule).alias("snapshot_date"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size_bytes"),
    )


def snapshots(files: DataFrame) -> DataFrame:
    """One row per snapshot with its date, newest file time, size, format and tables."""
    return files.groupBy("snapshot").agg(
        F.max("snapshot_date").alias("snapshot_date"),
        F.min("format").alias("format"),
        F.max("mtime").alias("mtime"),
        F.sum("size_bytes").alias("size_bytes"),
        F.array_sort(F.collect_set("table_name")).alias("tables"),
    )


def in_date_order(catalog: DataFrame, by: str = "name", name: str = "snapshot") -> DataFrame:
    """Catalog with `order_idx` from 0: by date in the name (undated last, then by name) or by file time.

    A catalog is a list of names, so numbering it in one place is fine.
    """
    if by == "name":
        order = [F.col("snapshot_date").asc_nulls_last(), F.lower(name), F.col(name)]
    elif by == "mtime":
        order = [F.col("mtime"), F.lower(name), F.col(name)]
    else:
        raise ValueError(f"unknown order: {by}")
    return catalog.withColumn("order_idx", F.row_number().over(Window.orderBy(*order)) - 1)


def newest_first(catalog: DataFrame, name: str = "snapshot") -> DataFrame:
    """Candidates for a comparison, newest first; undated ones count as very old."""
    dated = F.coalesce("snapshot_date", F.lit(NO_DATE).cast("date"))
    return catalog.orderBy(dated.desc(), F.col("mtime").desc(), F.lower(name).desc())


def suggest_two(catalog: DataFrame, preferred: str = PREFERRED_FORMAT, name: str = "snapshot") -> DataFrame:
    """The two newest snapshots of the preferred format when it has two, else the two newest at all."""
    dated = F.coalesce("snapshot_date", F.lit(NO_DATE).cast("date"))
    newest = [dated.desc(), F.col("mtime").desc(), F.lower(name).desc()]
    is_preferred = F.coalesce(F.col("format") == preferred, F.lit(False))
    enough = F.count_if(is_preferred).over(Window.partitionBy()) >= 2
    ranked = catalog.withColumn("use_preferred", enough)
    two = ranked.orderBy((F.col("use_preferred") & is_preferred).desc(), *newest).limit(2).drop("use_preferred")
    if two.count() < 2:
        raise ValueError("fewer than two snapshots")
    return two


def two_different(a: str, b: str) -> tuple[str, str]:
    """The two sources of a comparison; the same one twice is an error."""
    if a.rstrip("/") == b.rstrip("/"):
        raise ValueError("the two sources are the same")
    return a, b


def filter_catalog(catalog: DataFrame, term: str, name: str = "snapshot") -> DataFrame:
    """Keep entries whose name, format or date contains the term."""
    needle = term.strip().lower()
    text = F.lower(F.concat_ws(" ", col(name), "format", F.coalesce(F.col("snapshot_date").cast("string"), F.lit(""))))
    return catalog.filter(text.contains(needle)) if needle else catalog


def fingerprints(spark: SparkSession, base: str, n_bytes: int | None = None) -> DataFrame:
    """SHA-1 of each file, or with `n_bytes` (as `HASHED_BYTES`) the quick one of its first bytes, which alone are read then.

    Spark lists no empty files, so those are left out."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(quick_sha1=[_sha1(path, n_bytes) for path in batch.path])[["path", "quick_sha1"]]

    return _listing(spark, base).select("path").mapInPandas(hashed, "path STRING, quick_sha1 STRING")


def _sha1(path: str, n_bytes: int | None) -> str | None:
    if path.startswith("file:"):
        system, name = arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, name = arrow_fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as stream:
        digest, left, empty = hashlib.sha1(), n_bytes, True
        while left != 0 and (block := stream.read(READ_BYTES if left is None else min(left, READ_BYTES))):
            digest.update(block)
            empty, left = False, None if left is None else left - len(block)
    return None if empty else digest.hexdigest()


def flat_listing(files: DataFrame) -> DataFrame:
    """Files directly in the landing folder, by name."""
    return files.filter(~F.col("relpath").contains("/")).select(
        "file_name", "path", "format", "size_bytes", "mtime"
    ).orderBy(F.lower("file_name"), "file_name")


def folders_with_data(files: DataFrame) -> DataFrame:
    """Folders that hold a supported file, with the number of files."""
    folder = F.regexp_replace("relpath", r"/?[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def resolve_copies(raw: DataFrame, copies: DataFrame) -> DataFrame:
    """Raw sources with the ingested copy of the same stem (the newest one), NULL without a copy."""
    newest = copies.groupBy(F.lower(stem(F.col("file_name"))).alias("stem")).agg(F.max_by("path", "mtime").alias("copy_path"))
    named = raw.withColumn("stem", F.lower(stem(F.col("file_name"))))
    return named.join(newest, "stem", "left")


def has_copy(raw: DataFrame, copies: DataFrame) -> DataFrame:
    """Raw sources that already have a copy."""
    return resolve_copies(raw, copies).filter(F.col("copy_path").isNotNull()).select("stem").distinct()


def stale_sources(raw: DataFrame, copies: DataFrame) -> DataFrame:
    """Raw sources without a copy, or with a copy older than the source: what has to be rebuilt."""
    newest = copies.groupBy(F.lower(stem(F.col("file_name"))).alias("stem")).agg(F.max("mtime").alias("copy_mtime"))
    named = raw.withColumn("stem", F.lower(stem(F.col("file_name"))))
    return named.join(newest, "stem", "left").filter(
        F.col("copy_mtime").isNull() | (F.col("copy_mtime") < F.col("mtime"))
    )


# --- reading -----------------------------------------------------------------------------------


# Where a CSV table is read with `rejects`: the text of a line that doesn't fit the header, NULL for good lines.
REJECTED = "_rejected_line"


def read_table(spark: SparkSession, paths: Sequence[str], kind: str, schema: str | None = None, rejects: bool = False, **options) -> DataFrame:
    """One table from its files.

    CSV has a header. Its columns are read as text and take the narrowest type that all their values have, so no value
    is lost to a guess from a sample. A line with too few or too many fields keeps what it has; with `rejects` the
    column `_rejected_line` holds it whole.
    """
    if kind != "csv":
        reader = spark.read.format(FORMATS.get(kind, kind))
        return (reader if schema is None else reader.schema(schema)).options(**options).load(list(paths))
    # Without pruning a line counts as malformed or not whichever columns are asked for.
    reader = spark.read.format("csv").options(header="true", mode="PERMISSIVE", columnPruning="false", **options)
    texts = reader.load(list(paths)).schema if schema is None else T._parse_datatype_string(schema)
    wanted = T.StructType([T.StructField(f.name, T.StringType()) for f in texts.fields if f.name != REJECTED])
    rows = reader.schema(wanted.add(REJECTED, T.StringType())).option("columnNameOfCorruptRecord", REJECTED).load(list(paths))
    names = [c for c in rows.columns if c != REJECTED]
    if schema is not None:
        kinds = {f.name: f.dataType.simpleString() for f in texts.fields}
    else:
        kinds = _types_of_texts(rows.filter(F.col(REJECTED).isNull()), names)
    typed = [F.expr(f"try_cast({_quoted(c)} AS {kinds[c]})").alias(c) for c in names]
    return rows.select(*typed, *([REJECTED] if rejects else []))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _types_of_texts(rows: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """For each text column the first of CSV_TYPES that every value can be cast to, else STRING; one scan."""
    fits = [
        F.coalesce(F.bool_and(_col(c).isNull() | F.expr(f"try_cast({_quoted(c)} AS {kind})").isNotNull()), F.lit(True)).alias(f"{i}_{k}")
        for i, c in enumerate(names) for k, kind in enumerate(CSV_TYPES)
    ]
    some = [F.count(_col(c)).alias(f"n_{i}") for i, c in enumerate(names)]
    found = rows.agg(*fits, *some).first() if names else {}
    return {
        c: next((kind for k, kind in enumerate(CSV_TYPES) if found[f"{i}_{k}"] and found[f"n_{i}"]), "STRING") for i, c in enumerate(names)
    }


def _col(name: str) -> Column:
    return F.col(_quoted(name))


def _common_type(kinds: Sequence[T.DataType]) -> T.DataType:
    whole = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
    if all(k in whole for k in kinds):
        return max(kinds, key=whole.index)
    return T.DoubleType() if all(isinstance(k, T.NumericType) for k in kinds) else T.StringType()


def read_snapshot(spark: SparkSession, files: DataFrame, snapshot: str, rejects: bool = False) -> dict[str, DataFrame]:
    """All user tables of a snapshot by name; a table in several formats is united. Only names and paths are collected."""
    rows = (
        files.filter(F.col("snapshot") == snapshot)
        .groupBy("table_name", "format")
        .agg(F.array_sort(F.collect_set("table_path")).alias("paths"))
        .orderBy("table_name")
        .collect()
    )
    keep = set(user_tables(r.table_name for r in rows))
    parts: dict[str, list[DataFrame]] = {}
    for r in rows:
        if r.table_name in keep:
            parts.setdefault(r.table_name, []).append(read_table(spark, r.paths, r.format, rejects=rejects))
    return {name: union_versions(found) for name, found in parts.items()}


def read_across_snapshots(
    spark: SparkSession, base: str, tables: Sequence[str] | None = None, snapshot: str = "snapshot"
) -> dict[str, DataFrame]:
    """Each table over all snapshots below `base`, tagged with the snapshot; columns may come and go.

    A self-describing format is read in one scan with merged schemas, the snapshot taken from the file
    path. CSV files, whose columns go by position, and tables whose column types clash are read per
    snapshot; clashing columns become text.
    """
    rows = (
        file_catalog(spark, base)
        .groupBy("table_name", "format", "snapshot")
        .agg(F.array_sort(F.collect_set("table_path")).alias("paths"))
        .orderBy("table_name", "format", "snapshot")
        .collect()
    )
    keep = set(user_tables(r.table_name for r in rows))
    grouped: dict[str, dict[str, list]] = {}
    for r in rows:
        if r.table_name in keep and (tables is None or r.table_name in tables):
            grouped.setdefault(r.table_name, {}).setdefault(r.format, []).append(r)
    out = {}
    for name, by_format in grouped.items():
        parts: list[DataFrame] = []
        for kind, found in by_format.items():
            whole = _one_scan(spark, base, kind, [p for r in found for p in r.paths], snapshot)
            parts += [whole] if whole is not None else [
                read_table(spark, r.paths, kind).select(F.lit(r.snapshot).alias(snapshot), "*") for r in found
            ]
        out[name] = union_versions(parts)
    return out


def _one_scan(spark: SparkSession, base: str, kind: str, paths: Sequence[str], snapshot: str) -> DataFrame | None:
    if kind == "csv":
        return None
    try:
        df = read_table(spark, paths, kind, mergeSchema="true")
    except Exception as problem:
        if "CANNOT_MERGE_SCHEMAS" not in str(problem):
            raise
        return None
    # The hidden path column is escaped like a URL, where a plus sign stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    data = F.struct(*[col(c) for c in df.columns]).alias("data")
    return _placed(df.select(data, path.alias("path")), base).select(F.col("snapshot").alias(snapshot), "data.*")


def union_versions(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name over frames with different columns. Integers of different width take the widest, integers and
    fractions become DOUBLE; other conflicting types become text."""
    kinds: dict[str, dict[str, T.DataType]] = {}
    for df in parts:
        for field in df.schema.fields:
            kinds.setdefault(field.name, {})[field.dataType.simpleString()] = field.dataType
    common = {name: _common_type(list(found.values())) for name, found in kinds.items() if len(found) > 1}
    even = [df.select(*[col(c).cast(common[c]).alias(c) if c in common else col(c) for c in df.columns]) for df in parts]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), even)


def presence(tables: Mapping[str, Mapping[str, DataFrame]], spark: SparkSession, snapshot: str = "snapshot") -> DataFrame:
    """Which snapshot holds which table with which columns (schemas only)."""
    rows = [(s, t, df.columns) for s, found in tables.items() for t, df in found.items()]
    return spark.createDataFrame(rows, f"{snapshot} STRING, table_name STRING, columns ARRAY<STRING>")
