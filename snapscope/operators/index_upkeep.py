"""Keeping a stored row index in step with the files it was made from.

A log beside the index says which source files it holds and which of its parts count. An update compares the folder's
listing with the log before any row is read: only files that are new (or changed: a file is its path, size and time) are
read, and become a part of their own; files that are gone are only noted. A version of the log is published as one file,
after its parts are complete, so what a broken update leaves is never read, and the next one does its work again.

A part has its rows once, with their copies; a row that came from one place names its file, and of the others a second narrow table tells
how many copies came from which file. Readers
fold the parts and take off the copies of files that are gone, which concerns the tables of these files only. `compact_index`
stores the result as a single part, which is then read as it lies, without a shuffle. Where rows are stored, those that occur
once are not moved; their ids are not stored but computed from them.

One update or compaction runs at a time. Of two that publish the same version the one with the smaller attempt name counts,
the other's is ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapscope.functions.names import is_user_table
from snapscope.operators.text_index import INDEX_SCHEMA, folded, index_rows, row_id, told_apart

LOG_SCHEMA = (
    "kind STRING, table_name STRING, name STRING, size BIGINT, modified TIMESTAMP, file_key BIGINT, in_part STRING, alive BOOLEAN, "
    "v INT, attempt STRING"
)
LINE = ["kind", "table_name", "name", "size", "modified", "file_key", "in_part", "alive"]
COLUMNS = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
STORED_SCHEMA = INDEX_SCHEMA.replace("row_id STRING, ", "") + ", file_key BIGINT, part STRING"
PLACES_SCHEMA = "row_id STRING, file_key BIGINT, copies BIGINT, part STRING, table_name STRING"


@dataclass(frozen=True)
class Update:
    """What an update did: the files it read, how many were gone, and the version it published (None: nothing to do)."""

    read: tuple[str, ...]
    gone: int
    version: int | None


def _file_key(table: Column) -> Column:
    meta = F.col("_metadata")
    return F.xxhash64(table, meta["file_path"], meta["file_size"], meta["file_modification_time"])


def listing(spark: SparkSession, sources: Mapping[str, str]) -> DataFrame:
    """(table_name, name, size, modified, file_key) of every file of the tables' folders; contents aren't read."""
    parts = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
            F.lit(table).alias("table_name"), F.col("path").alias("name"), F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"), _file_key(F.lit(table)).alias("file_key"),
        )
        for table, path in sources.items()
        if is_user_table(table)
    ]
    if not parts:
        raise ValueError("no user tables")
    return reduce(DataFrame.unionAll, parts)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all versions of the log; none where there is no index yet."""
    try:
        lines = spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)
    taken = lines.groupBy("v").agg(F.min("attempt").alias("attempt"))
    return lines.join(taken, ["v", "attempt"], "left_semi")


def _latest(log: DataFrame) -> DataFrame:
    """The last line about each file and part."""
    last = log.groupBy("kind", "name", "file_key").agg(F.max_by(F.struct(*LINE), "v").alias("line"))
    return last.select("line.*")


def indexed_files(spark: SparkSession, path: str) -> DataFrame:
    """The files the index holds, from the log alone."""
    return _latest(read_log(spark, path)).where("kind = 'file' AND alive").select("table_name", "name", "size", "modified", "file_key", "in_part")


def _publish(log: DataFrame, lines: DataFrame, path: str) -> int:
    version = (log.agg(F.max("v")).first()[0] or 0) + 1
    # One file: its name appears when it is complete.
    lines.select(*LINE).coalesce(1).write.mode("error").parquet(f"{path}/log/v={version}/attempt={uuid.uuid4().hex}")
    return version


def _part_line(spark: SparkSession, part: str, alive: bool = True) -> DataFrame:
    return spark.range(1).select(
        F.lit("part").alias("kind"), F.lit(None).cast("string").alias("table_name"), F.lit(part).alias("name"), F.lit(None).cast("bigint").alias("size"),
        F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("bigint").alias("file_key"), F.lit(part).alias("in_part"), F.lit(alive).alias("alive"),
    )


def _file_lines(files: DataFrame, part: Column, alive: bool) -> DataFrame:
    return files.select(F.lit("file").alias("kind"), "table_name", "name", "size", "modified", "file_key", part.alias("in_part"), F.lit(alive).alias("alive"))


def _rows_of(spark: SparkSession, table: str, source: str, files: list[str], kind: str, schema: str | None) -> DataFrame:
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if not any(f.endswith(source.rstrip("/")) for f in files):
        reader = reader.option("basePath", source)  # values in folder names stay columns
    rows = index_rows(table, reader.load([re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]))
    return rows.select("*", _file_key(F.lit(table)).alias("file_key"))


def _store(df: DataFrame, path: str) -> None:
    df.write.partitionBy("table_name").option("compression", "zstd").parquet(path)


def update_index(
    spark: SparkSession, sources: Mapping[str, str], path: str, kind: str = "parquet", schemas: Mapping[str, str] | None = None
) -> Update:
    """Bring the index at `path` in step with the files of all tables; a table that isn't named any more is gone.

    The names of the new files pass through the driver, as they do in any read that names them. Their rows are formed three
    times: without texts for the count that tells repeated rows and for the places, and once for the rows.
    """
    log = read_log(spark, path)
    now, known = listing(spark, sources), _latest(log).where("kind = 'file' AND alive")
    new = now.join(known, "file_key", "left_anti")
    gone = known.join(now, "file_key", "left_anti")
    files: dict[str, list[str]] = {}
    for line in new.select("table_name", "name").orderBy("table_name", "name").collect():
        files.setdefault(line.table_name, []).append(line.name)
    lost = gone.count()
    lines = _file_lines(gone, F.col("in_part"), False)
    if files:
        part = uuid.uuid4().hex
        rows = reduce(DataFrame.unionByName, [_rows_of(spark, t, sources[t], f, kind, (schemas or {}).get(t)) for t, f in files.items()])
        once, more = told_apart(rows)
        _store(once.unionByName(_without_file(folded(more.drop("file_key")))).drop("row_id"), f"{path}/rows/part={part}")
        _store(more.groupBy("table_name", "row_id", "file_key").agg(F.sum("copies").alias("copies")), f"{path}/places/part={part}")
        lines = lines.unionByName(_file_lines(new, F.lit(part), True)).unionByName(_part_line(spark, part))
    elif not lost:
        return Update((), 0, None)
    return Update(tuple(f for names in files.values() for f in names), lost, _publish(log, lines, path))


def _parts(state: DataFrame) -> list[str]:
    """Names of the parts that count: one for each update since the last compaction."""
    return sorted(r.name for r in state.where("kind = 'part' AND alive").select("name").collect())


def _gone_keys(state: DataFrame, parts: list[str]) -> DataFrame:
    return state.where(F.expr("kind = 'file' AND NOT alive") & F.col("in_part").isin(parts)).select("table_name", "file_key")


def _rows(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    stored = spark.read.schema(STORED_SCHEMA).parquet(f"{path}/rows").where(F.col("part").isin(parts))
    return stored.withColumn("row_id", row_id(F.col("table_name"), F.col("row_json"))).select(*COLUMNS, "file_key")


def _places(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """The places of rows that don't name their file."""
    return spark.read.schema(PLACES_SCHEMA).parquet(f"{path}/places").where(F.col("part").isin(parts)).drop("part")


def _named_places(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("file_key").isNotNull()).select("row_id", "file_key", "copies", "table_name")


def _without_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file_key", F.lit(None).cast("bigint"))


def _whole_and_less(spark: SparkSession, path: str, state: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Stored rows of tables without gone files; rows of the others, without the copies from these; and the names of the others."""
    rows = _rows(spark, path, parts)
    gone = _gone_keys(state, parts)
    tables = [r.table_name for r in gone.select("table_name").distinct().collect()]
    if not tables:
        return rows, None, []
    less = F.col("table_name").isin(tables)
    places = _places(spark, path, parts).unionByName(_named_places(rows)).where(less)
    off = places.join(gone, ["table_name", "file_key"], "left_semi").select("table_name", "row_id", (-F.col("copies")).alias("copies"))
    rest = [c for c in COLUMNS if c not in ("table_name", "row_id", "copies")]
    both = rows.where(less).drop("file_key").unionByName(off, allowMissingColumns=True).groupBy("table_name", "row_id").agg(
        *(F.any_value(c, F.lit(True)).alias(c) for c in rest), F.sum("copies").alias("copies"))
    return rows.where(~less), both.where("copies > 0").select(*COLUMNS), tables


def _current(spark: SparkSession, path: str, state: DataFrame, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], INDEX_SCHEMA)
    whole, less, _ = _whole_and_less(spark, path, state, parts)
    whole = whole.select(*COLUMNS)
    whole = folded(whole) if len(parts) > 1 else whole
    return whole if less is None else whole.unionByName(less)


def current_index(spark: SparkSession, path: str) -> DataFrame:
    """The index as of the last version, equal rows once with their copies."""
    state = _latest(read_log(spark, path))
    return _current(spark, path, state, _parts(state))


def compact_index(spark: SparkSession, path: str) -> int | None:
    """Store the index as one part; None where it is one already."""
    log = read_log(spark, path)
    state = _latest(log)
    parts = _parts(state)
    gone = _gone_keys(state, parts)
    if len(parts) < 2 and gone.isEmpty():
        return None
    part = uuid.uuid4().hex
    whole, less, tables = _whole_and_less(spark, path, state, parts)
    places = _places(spark, path, parts)
    if len(parts) > 1:
        whole, more = told_apart(whole)
        whole = whole.unionByName(_without_file(folded(more.drop("file_key"))))
        places = places.unionByName(_named_places(more))
    if less is not None:
        whole = whole.unionByName(_without_file(less))
        places = places.unionByName(_named_places(_rows(spark, path, parts).where(F.col("table_name").isin(tables))))
    _store(whole.drop("row_id"), f"{path}/rows/part={part}")
    _store(places.join(gone, ["table_name", "file_key"], "left_anti"), f"{path}/places/part={part}")
    lines = _file_lines(state.where("kind = 'file' AND alive"), F.lit(part), True).unionByName(_part_line(spark, part))
    return _publish(log, reduce(DataFrame.unionByName, [_part_line(spark, p, False) for p in parts], lines), path)
