"""One record through a dated sequence of snapshots.

Each table is a single frame over all snapshots with a snapshot column (a partition column when
stored), so a search is one filtered scan per table, whatever the number of snapshots; the filter and
the wanted snapshots reach the scan. `catalog(order_idx, <snapshot>, ...)` lists the snapshots.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.names import col
from snapscope.functions.serial import row_json
from snapscope.operators.filters import Condition, equals_value, matches, missing_columns, resolve
from snapscope.session import settled

# Error texts, and column names tried when the key column is not known.
NO_TABLE, NO_COLUMN = "TABELA AUSENTE", "COLUNA AUSENTE"
# So many snapshot names are sent to every task; more are joined by shuffle.
MANY_SNAPSHOTS = 10_000
KEY_GUESSES = ["id", "code", "codigo", "cod", "codigo_id", "pk", "codigo_pk", "record_id", "key", "uid"]


def _sample(df: DataFrame, snapshot: str, show: Sequence[str] | None) -> Column:
    shown = [c for c in df.columns if c != snapshot]
    if show:
        picked = [resolve(df, c) for c in show]
        shown = [c for c in picked if c is not None] or shown
    return row_json(df, shown)


def table_matches(
    df: DataFrame, conditions: Sequence[Condition], snapshot: str, show: Sequence[str] | None = None
) -> DataFrame:
    """Per snapshot with a match: the number of matching rows and one sample (the smallest as text)."""
    return (
        df.filter(matches(df, conditions))
        .select(col(snapshot).alias(snapshot), _sample(df, snapshot, show).alias("row"))
        .groupBy(col(snapshot))
        .agg(F.count("*").alias("match_count"), F.min("row").alias("sample"))
    )


def _limited(catalog: DataFrame, most: int | None) -> DataFrame:
    return catalog if most is None else catalog.orderBy("order_idx").limit(most)


def _within(df: DataFrame, chosen: DataFrame, snapshot: str, most: int | None) -> DataFrame:
    """Rows of the chosen snapshots. At most `most` names are sent, and they prune a snapshot partition column."""
    if most is None:
        return df
    names = chosen.select(col(snapshot)).distinct()
    names = F.broadcast(names) if most <= MANY_SNAPSHOTS else names
    return df.join(names, snapshot, "left_semi").select(*[col(c) for c in df.columns])


def find_record(
    catalog: DataFrame,
    tables: Mapping[str, DataFrame],
    conditions: Sequence[Condition],
    snapshot: str = "snapshot",
    table: str | None = None,
    show: Sequence[str] | None = None,
    max_snapshots: int | None = None,
    presence: DataFrame | None = None,
) -> DataFrame:
    """One row per snapshot: found, table_name, match_count, sample, error.

    The first table with a match, in the order of `tables`, wins. A table without the wanted columns
    is an error of the snapshot unless another one matches. `presence(<snapshot>, table_name,
    columns)` tells which snapshot holds which table; without it every table counts as present.
    """
    if not conditions:
        raise ValueError("no condition given")
    chosen = _limited(catalog, max_snapshots)
    order = [table] if table is not None else list(tables)
    usable = [t for t in order if t in tables and not missing_columns(tables[t], conditions)]
    wanted = [name for name, _ in conditions]
    if presence is not None:
        errors = _presence_errors(chosen, presence, order, wanted, snapshot, table)
    elif table is not None and table not in tables:
        errors = chosen.select(col(snapshot), F.lit(NO_TABLE).alias("problem"))
    elif not usable:
        errors = chosen.select(col(snapshot), F.lit(NO_COLUMN).alias("problem"))
    else:
        errors = chosen.select(col(snapshot), F.lit(None).cast("string").alias("problem"))
    within = {t: _within(tables[t], chosen, snapshot, max_snapshots) for t in usable}
    found = _first_table(within, usable, conditions, snapshot, show)
    joined = chosen.join(errors, snapshot, "left")
    if found is None:
        joined = joined.selectExpr("*", "CAST(NULL AS STRING) table_name", "CAST(NULL AS BIGINT) match_count", "CAST(NULL AS STRING) sample")
    else:
        joined = joined.join(found, snapshot, "left")
    is_found = F.col("table_name").isNotNull()
    return joined.select(
        *[col(c) for c in catalog.columns],
        is_found.alias("found"),
        "table_name",
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
        "sample",
        F.when(~is_found, F.col("problem")).alias("error"),
    )


def _message(problem: Exception) -> str:
    """The error condition where the problem has one, else its first line."""
    named = problem.getCondition() if isinstance(problem, PySparkException) else None
    return named or next((line for line in str(problem).splitlines() if line.strip()), type(problem).__name__).strip()


def find_record_past_errors(
    catalog: DataFrame,
    tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
    conditions: Sequence[Condition],
    snapshot: str = "snapshot",
    show: Sequence[str] | None = None,
    max_snapshots: int | None = None,
    most_errors: int | None = 3,
) -> DataFrame:
    """Like `find_record`, but a table that can't be read is an error of its own and later tables still win.

    Each table is searched by a job of its own, whose result, a row per snapshot with a match, is stored; where it fails, its
    snapshots are searched one by one, so that only broken ones are lost. A table may be given as a function that opens it.
    Of a snapshot without a match, `error` joins the first `most_errors` messages `table: problem` in the order of the tables.
    """
    if not conditions:
        raise ValueError("no condition given")
    chosen = settled(_limited(catalog, max_snapshots))
    spark, kind = chosen.sparkSession, chosen.schema[snapshot].dataType
    hits, failed, fits = [], [], False
    for place, (name, table) in enumerate(tables.items()):

        def search(df: DataFrame, place: int = place, name: str = name) -> DataFrame:
            found = table_matches(df, conditions, snapshot, show)
            hit = F.struct(F.lit(place).alias("place"), F.lit(name).alias("table_name"), "match_count", "sample").alias("hit")
            return settled(found.select(col(snapshot), hit))

        try:
            df = table() if callable(table) else table
            if missing_columns(df, conditions):
                continue
            fits = True
            df = _within(df, chosen, snapshot, max_snapshots)
        except (PySparkException, Py4JJavaError) as problem:
            failed.append((None, place, name, _message(problem)))
            continue
        try:
            hits.append(search(df))
        except (PySparkException, Py4JJavaError):
            for row in chosen.select(col(snapshot).alias("s")).toLocalIterator():
                try:
                    hits.append(search(df.filter(col(snapshot).eqNullSafe(F.lit(row["s"])))))
                except (PySparkException, Py4JJavaError) as problem:
                    failed.append((row["s"], place, name, _message(problem)))
    # One row per broken table, or per broken snapshot of it.
    known = spark.createDataFrame([(place, name, message, s, s is None) for s, place, name, message in failed],
                                  T.StructType([T.StructField("place", T.IntegerType()), T.StructField("table_name", T.StringType()), T.StructField("message", T.StringType()),
                                                T.StructField("_s", kind), T.StructField("_all", T.BooleanType())]))
    problems = chosen.select(col(snapshot)).join(F.broadcast(known), F.col("_all") | (F.col("_s") == col(snapshot)))
    errors = joined_errors(problems, snapshot, most_errors)
    joined = chosen.join(errors, snapshot, "left")
    if hits:
        best = reduce(DataFrame.unionByName, hits).groupBy(col(snapshot)).agg(F.min("hit").alias("hit"))
        joined = joined.join(best, snapshot, "left")
    else:
        joined = joined.withColumn("hit", F.lit(None).cast("struct<place: int, table_name: string, match_count: bigint, sample: string>"))
    is_found = F.col("hit").isNotNull()
    problem = F.coalesce(F.col("error"), F.lit(None if fits or failed else NO_COLUMN).cast("string"))
    return joined.select(
        *[col(c) for c in catalog.columns], is_found.alias("found"), "hit.table_name", F.coalesce("hit.match_count", F.lit(0)).alias("match_count"),
        "hit.sample", F.when(~is_found, problem).alias("error"),
    )


def _first_table(tables, usable, conditions, snapshot, show) -> DataFrame | None:
    hits = [
        table_matches(tables[t], conditions, snapshot, show).select(
            col(snapshot), F.struct(F.lit(i).alias("place"), F.lit(t).alias("table_name"), "match_count", "sample").alias("hit")
        )
        for i, t in enumerate(usable)
    ]
    if not hits:
        return None
    best = reduce(DataFrame.unionByName, hits).groupBy(col(snapshot)).agg(F.min("hit").alias("hit"))
    return best.select(col(snapshot), "hit.table_name", "hit.match_count", "hit.sample")


def _presence_errors(chosen, presence, order, wanted, snapshot, table) -> DataFrame:
    """Per snapshot: TABELA AUSENTE for a named table it lacks, COLUNA AUSENTE when no table has all columns."""
    known = F.transform(F.col("columns"), F.lower)
    has_all = F.size(F.array_except(F.array(*[F.lit(w.lower()) for w in wanted]), known)) == 0
    flags = (
        presence.filter(F.col("table_name").isin(order))
        .groupBy(col(snapshot))
        .agg(F.count("*").alias("n_tables"), F.max(has_all).alias("any_fits"))
    )
    lacks_table = F.lit(table is not None) & F.col("n_tables").isNull()
    problem = F.when(lacks_table, NO_TABLE).when(~F.coalesce("any_fits", F.lit(False)), NO_COLUMN)
    return chosen.select(col(snapshot)).join(flags, snapshot, "left").select(col(snapshot), problem.alias("problem"))


def joined_errors(errors: DataFrame, snapshot: str, most: int | None = None) -> DataFrame:
    """Per snapshot the `table: message` texts (or the first `most` of them) as one, from (snapshot, place, table_name, message) rows."""
    texts = F.struct("place", F.concat("table_name", F.lit(": "), "message").alias("text"))
    first = Window.partitionBy(col(snapshot)).orderBy("place")
    few = errors if most is None else errors.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most)
    return few.groupBy(col(snapshot)).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(texts)), lambda t: t["text"]), "; ").alias("error")
    )


def track_limits(catalog: DataFrame, max_snapshots: int | None = None) -> DataFrame:
    """total_files, files_scanned, limit_reached; without a limit all are scanned."""
    most = F.count("*") if max_snapshots is None else F.lit(max_snapshots)
    return catalog.agg(
        F.count("*").alias("total_files"),
        F.least(F.count("*"), most).alias("files_scanned"),
        (F.count("*") > most).alias("limit_reached"),
    )


def find_value(
    catalog: DataFrame,
    tables: Mapping[str, DataFrame],
    value: str,
    snapshot: str = "snapshot",
    column: str | None = None,
    all_columns: bool = False,
    table_like: str | None = None,
    show: Sequence[str] | None = None,
    max_snapshots: int | None = None,
) -> DataFrame:
    """Find a value whose column is not known: likely key columns in order, then optionally all others.

    Per snapshot the first table with a hit wins, and in it the first column. The value is tried as
    text and as a number.
    """
    chosen = _limited(catalog, max_snapshots)
    guesses = ([column] if column else []) + KEY_GUESSES
    hits = []
    for place, (name, df) in enumerate(tables.items()):
        if table_like is not None and table_like.lower() not in name.lower():
            continue
        data = [c for c in df.columns if c != snapshot]
        own = [next((c for c in data if c.lower() == g.lower()), None) for g in guesses]
        order = list(dict.fromkeys([c for c in own if c] + (data if all_columns else [])))
        if order:
            within = _within(df, chosen, snapshot, max_snapshots)
            hits.append(_value_hits(within, name, place, order, value, snapshot, show))
    if not hits:
        return chosen.selectExpr("*", "false found", "CAST(NULL AS STRING) table_name", "CAST(NULL AS STRING) column_name", "0L match_count", "CAST(NULL AS STRING) sample")
    best = reduce(DataFrame.unionByName, hits).groupBy(col(snapshot)).agg(F.min("hit").alias("hit"))
    return chosen.join(best, snapshot, "left").select(
        *[col(c) for c in catalog.columns],
        F.col("hit").isNotNull().alias("found"),
        F.col("hit.table_name").alias("table_name"),
        F.col("hit.column_name").alias("column_name"),
        F.coalesce("hit.match_count", F.lit(0)).alias("match_count"),
        F.col("hit.sample").alias("sample"),
    )


def _value_hits(df, table, place, columns, value, snapshot, show) -> DataFrame:
    def hit(name: str) -> Column:
        kind = df.schema[name].dataType
        texts = [equals_value(col(name), kind, value)]
        for parse in (int, float):
            try:
                texts.append(equals_value(col(name), kind, parse(value)))
            except ValueError:
                pass
        return F.coalesce(reduce(lambda x, y: x | y, texts), F.lit(False))

    where = {c: hit(c) for c in columns}
    marks = F.array_compact(
        F.array(*[F.when(h, F.struct(F.lit(i).alias("col_place"), F.lit(c).alias("column_name"))) for i, (c, h) in enumerate(where.items())])
    )
    rows = df.filter(reduce(lambda x, y: x | y, where.values())).select(
        col(snapshot), _sample(df, snapshot, show).alias("row"), F.explode(marks).alias("mark")
    )
    counts = rows.groupBy(col(snapshot), "mark").agg(F.count("*").alias("match_count"), F.min("row").alias("sample"))
    best = F.struct(
        F.lit(place).alias("place"), F.lit(table).alias("table_name"), F.col("mark.col_place").alias("col_place"),
        F.col("mark.column_name").alias("column_name"), "match_count", "sample",
    )
    return counts.select(col(snapshot), best.alias("hit"))


def presence_timeline(track: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """One row: first and last snapshot with the record, the absent neighbours, and the two messages.

    `track` has one row per snapshot, which the catalog bounds.
    """
    name = col(snapshot).cast("string")
    bounds = track.agg(
        F.min(F.when(F.col("found"), F.col("order_idx"))).alias("first_idx"),
        F.max(F.when(F.col("found"), F.col("order_idx"))).alias("last_idx"),
        F.count_if("found").alias("found_count"),
        F.count("*").alias("snapshot_count"),
    )
    rows = track.select(F.lit(1).alias("one"), "order_idx", name.alias("name"), "found")
    # One row, so it can be sent everywhere.
    rows = rows.join(F.broadcast(bounds.withColumn("one", F.lit(1))), "one")
    here = F.col("order_idx")
    summary = rows.agg(
        F.max("found_count").alias("found_count"),
        F.max("snapshot_count").alias("snapshot_count"),
        F.max(F.when(here == F.col("first_idx"), F.col("name"))).alias("first_found"),
        F.max_by("name", F.when(here < F.col("first_idx"), here)).alias("absent_before"),
        F.max(F.when(here == F.col("last_idx"), F.col("name"))).alias("last_found"),
        F.min_by("name", F.when(here > F.col("last_idx"), here)).alias("absent_after"),
    )
    never = F.coalesce(F.col("found_count") == 0, F.lit(True))
    return summary.select(
        "*",
        F.when(never, "never").when(F.col("absent_before").isNull(), "from_start").otherwise("appeared").alias("appearance"),
        F.when(never, "never").when(F.col("absent_after").isNull(), "still_present").otherwise("disappeared").alias("disappearance"),
    )


def track_ledger(track: DataFrame, files: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Track rows with the file facts of their snapshot: path, mtime, size_kb, quick_sha1."""
    return track.join(files.select(col(snapshot), "path", "mtime", "size_kb", "quick_sha1"), snapshot, "left").select(
        "path", "mtime", "size_kb", "quick_sha1", "found", F.col("table_name").alias("table"),
        F.col("match_count").alias("count"), "sample", "error", "order_idx",
    )


def found_summary(track: DataFrame) -> DataFrame:
    return track.agg(F.count_if("found").alias("found_in"), F.count("*").alias("snapshots"))
