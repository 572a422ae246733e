"""Row index for text search over many tables: one row per source row with its normalised text.

`row_id` is derived from the table name and the row itself, so it is the same in every run and on
every cluster. A running row number would need a global order; `row_offset` is only filled when the
caller names order columns. Equal rows share a `row_id` and are told apart by `copies`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.names import col, is_user_table
from snapscope.functions.numbers import as_text
from snapscope.functions.serial import fields_json, json_ready
from snapscope.functions.text import normalize_text
from snapscope.operators.keys import guess_keys
from snapscope.operators.positions import with_positions
from snapscope.session import parts_by_size, settled, shuffled_by_size, shuffles_dropped

# Bytes of an index whose offsets one task forms, and ranges of ids to a part, which even out how many rows it gets.
OFFSET_BYTES, RANGES = 8 << 20, 4
# Keys of rows that occur more than once, up to so many are sent to all tasks.
REPEATED_SENT = 1_000_000
INDEX_SCHEMA = (
    "table_name STRING, pk_col STRING, pk_value STRING, row_id STRING, content_norm STRING, row_json STRING, copies BIGINT"
)
# A named value of a row with its type.
Field = tuple[str, Column, T.DataType]
# Types whose values a file keeps as they are, and what the text of a value of some types can hold, without capitals.
KEPT_TYPES = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BinaryType, T.DateType,
    T.TimestampType, T.TimestampNTZType,
)
SIGNS_OF = [
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType), "0123456789"),
    ((T.FloatType, T.DoubleType, T.DecimalType), "0123456789einfinitynan"), ((T.BooleanType,), "truefalse"),
]


def fields_of(df: DataFrame) -> list[Field]:
    return [(n, col(n), df.schema[n].dataType) for n in df.columns]


def joined_text(fields: Sequence[Field], columns: Sequence[str] | None = None) -> Column:
    """The values of a row as one text, as they are; of some columns in the order named."""
    known = {name: as_text(value, kind) for name, value, kind in fields}
    return F.concat_ws(" ", *[known[n] for n in (known if columns is None else columns)])


def row_id(table: Column, as_json: Column) -> Column:
    """The id of a row, from its table and itself. Never NULL; said so, or a join on it would compute it a second time just to test that."""
    return F.coalesce(F.sha2(F.concat(table, F.lit("\n"), as_json), 256), F.lit(""))


def index_rows(
    table: str, df: DataFrame, strategy: str = "id_or_suffix", searched: Sequence[str] | None = None
) -> DataFrame:
    """Index rows of one table; a plain projection, no shuffle. `searched` limits the text to some columns."""
    return df.select(*row_columns(table, fields_of(df), strategy, searched), F.lit(1).cast("bigint").alias("copies"))


def row_columns(
    table: str, fields: Sequence[Field], strategy: str = "id_or_suffix", searched: Sequence[str] | None = None
) -> list[Column]:
    """The columns of an index row but its copies."""
    key = guess_keys([name for name, _, _ in fields], table, strategy)[:1]
    pk = next((json_ready(value, kind).cast("string") for name, value, kind in fields if [name] == key), F.lit(None).cast("string"))
    as_json = fields_json(fields)
    return [
        F.lit(table).alias("table_name"),
        F.lit(key[0] if key else None).cast("string").alias("pk_col"),
        pk.alias("pk_value"),
        row_id(F.lit(table), as_json).alias("row_id"),
        normalize_text(joined_text(fields, searched)).alias("content_norm"),
        as_json.alias("row_json"),
    ]


def build_index(
    tables: Mapping[str, DataFrame], strategy: str = "id_or_suffix", searched: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Index rows of every user table, in one plan without a shuffle; equal rows appear as often as they occur."""
    parts = [
        index_rows(name, df, strategy, None if searched is None else searched.get(name))
        for name, df in tables.items()
        if is_user_table(name)
    ]
    if not parts:
        raise ValueError("no user tables")
    return reduce(DataFrame.unionByName, parts)


def folded(index: DataFrame) -> DataFrame:
    """Equal rows as one row with their number in `copies`."""
    rest = [c for c in index.columns if c not in ("row_id", "copies")]
    return index.groupBy("row_id").agg(
        *[F.any_value(c).alias(c) for c in rest], F.sum("copies").alias("copies")
    ).select(*index.columns)


def may_hold(df: DataFrame, tokens: Sequence[str], mode: str = "any", columns: Sequence[str] | None = None) -> Column | None:
    """Whether the index text of a row can hold any (or all) of the tokens, from its columns as they are: of texts of plain signs it
    tells exactly, all others can. None where the tokens themselves aren't plain."""
    return fields_may_hold([(n, col(n), df.schema[n].dataType) for n in (df.columns if columns is None else columns)], tokens, mode)


def fields_may_hold(fields: Sequence[Field], tokens: Sequence[str], mode: str = "any") -> Column | None:
    """As `may_hold`, of named values. A number or a time is not read for a token with signs that it can't have."""
    if not tokens or not all(t.isascii() and t.isalnum() for t in tokens):
        return None
    texts = [(F.lower(as_text(value, kind)), _signs(kind)) for _, value, kind in fields]
    either = lambda parts: reduce(lambda x, y: x | y, parts, F.lit(False))
    held = [either([text.contains(t) for text, signs in texts if signs is None or set(t.lower()) <= signs]) for t in tokens]
    either_or_both = either(held) if mode == "any" else reduce(lambda x, y: x & y, held)
    return either([either_or_both, *[~plain_text(as_text(value, kind)) for _, value, kind in fields if _signs(kind) is None]])


def _signs(kind: T.DataType) -> frozenset[str] | None:
    """The letters and digits that the text of a value can hold; None: any."""
    return next((frozenset(signs) for kinds, signs in SIGNS_OF if isinstance(kind, kinds)), None)


def plain_text(text: Column) -> Column:
    """Whether a text has plain signs only: as many bytes as signs, and none of them broken."""
    return (F.octet_length(text) == F.length(text)) & F.is_valid_utf8(text)


@dataclass(frozen=True)
class Repeated:
    """Hashes (`_key`) that occur more than once; `found` is their number, or REPEATED_SENT + 1 where there are more of them."""

    keys: DataFrame
    found: int

    def told_apart(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """Rows whose hash occurs once, and the others. With more than REPEATED_SENT repeated hashes all rows are among the others."""
        if self.found == 0:
            return rows, rows.limit(0)
        if self.found > REPEATED_SENT:
            return rows.limit(0), rows
        keyed = rows.withColumn("_key", key)
        once, more = (keyed.join(F.broadcast(self.keys), "_key", how).drop("_key") for how in ("left_anti", "left_semi"))
        return once, more


def repeated_hashes(keys: DataFrame, sources: Sequence[DataFrame]) -> Repeated:
    """Hashes in `_key` that occur more than once, counted at once. `sources`: what the hashes are formed from."""
    with shuffles_dropped(keys.sparkSession), shuffled_by_size(keys.sparkSession, sources):
        repeated = settled(keys.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").select("_key"))
    return Repeated(repeated, repeated.limit(REPEATED_SENT + 1).count())


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id occurs once, and the others: by a count over hashes of the ids, made at once. With more than REPEATED_SENT
    repeated hashes all rows are among the others."""
    key = F.xxhash64("row_id")
    return repeated_hashes(rows.select(key.alias("_key")), [rows]).told_apart(rows, key)


def text_counts(index: DataFrame) -> DataFrame:
    """(table_name, row_count, copies, texts): rows, copies and different texts of each table. A text whose hash occurs once is one; only the
    others are moved to be compared."""
    key = F.xxhash64("table_name", "content_norm")
    once, more = repeated_hashes(index.select(key.alias("_key")), [index]).told_apart(index, key)
    alone = once.groupBy("table_name").agg(F.count("*").alias("row_count"), F.sum("copies").alias("copies"), F.count("content_norm").alias("texts"))
    compared = more.groupBy("table_name").agg(F.count("*").alias("row_count"), F.sum("copies").alias("copies"), F.count_distinct("content_norm").alias("texts"))
    return alone.unionByName(compared).groupBy("table_name").agg(*[F.sum(c).alias(c) for c in ("row_count", "copies", "texts")])


def values_hash(table: str, fields: Sequence[Field]) -> Column:
    """A hash of a row of kept types from its values, without its JSON: rows of one id have one hash."""

    def value_of(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.TimestampType):
            return value.cast("timestamp_ntz")  # two times of one text, where clocks are set back
        if isinstance(kind, T.StringType):
            return F.make_valid_utf8(value)
        if isinstance(kind, T.ArrayType):
            return F.to_json(F.struct(value))
        return value if isinstance(kind, T.TimestampNTZType) else json_ready(value, kind)

    return F.xxhash64(F.lit(table), *[value_of(value, kind) for _, value, kind in fields])


def kept_as_values(df: DataFrame) -> bool:
    """Whether a file keeps the values of all columns, so that the JSON and the text of a row can be formed from it."""
    plain = lambda kind: isinstance(kind, KEPT_TYPES) or kind == T.StringType()
    times = (T.DecimalType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return all(
        plain(f.dataType) or isinstance(f.dataType, T.ArrayType) and plain(f.dataType.elementType) and not isinstance(f.dataType.elementType, times)
        for f in df.schema.fields
    )


def folded_apart(index: DataFrame) -> DataFrame:
    """As `folded`, but rows that occur once stay where they are; only the others are moved."""
    once, more = told_apart(index)
    return once.unionByName(folded(more))


def with_row_offset(index: DataFrame, order: Sequence[str]) -> DataFrame:
    """Position of each row within its table by the named order; equal rows should be folded first.

    Without an order rows stand by their ids. These are digests, whose first signs deal them out evenly in their order, so rows are moved once,
    with the bytes of their digests, and nothing is sampled or stored. Ids of any other kind keep their places among them.
    """
    if order:
        return with_positions(index, [*order, "row_id"], ["table_name"], "copies", "row_offset")
    parts = parts_by_size(index.sparkSession, [index], OFFSET_BYTES)
    digest = F.col("row_id").rlike("^[0-9a-f]{64}$")
    others = [c for c in index.columns if c != "row_id"]
    sent = index.select(
        *[col(c) for c in others], _range_of(F.col("row_id"), RANGES * parts).alias("_part"),
        F.when(digest, F.unhex("row_id")).alias("_digest"), F.when(~digest, F.col("row_id")).alias("_id"),
    ).repartition(parts, "_part")
    # Ids are asked for here too, so that both readers want the same columns and the rows are sent once.
    sizes = sent.groupBy("_part", "table_name").agg(F.sum(F.when(F.coalesce(F.hex("_digest"), "_id").isNotNull(), F.col("copies"))).alias("n"))
    earlier = Window.partitionBy("table_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "table_name", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    placed = sent.withColumn("row_id", F.coalesce("_id", F.lower(F.hex("_digest")))).drop("_digest", "_id")
    before = Window.partitionBy("_part", "table_name").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    # A row of `starts` for each range and table.
    offset = (F.col("_start") + F.col("_inside")).cast("bigint").alias("row_offset")
    return inside.join(F.broadcast(starts), ["_part", "table_name"]).select(*[col(c) for c in index.columns], offset)


def _range_of(text: Column, ranges: int) -> Column:
    """The number of a text's range, in the order of texts: by its first four signs as a hexadecimal number. What is none is put between those that
    stand before and behind it."""
    first = F.substring(text, 1, 4)
    near = first
    for signs, end in (("\\x00-/", "0000"), (":-`", "9fff"), ("g-\\x{10FFFF}", "ffff")):
        near = F.regexp_replace(near, f"(?s)[{signs}].*", end)
    number = F.conv(F.when(first.rlike("^[0-9a-f]{4}$"), first).otherwise(F.rpad(near, 4, "0")), 16, 10).cast("bigint")
    # Never NULL, and said so, or a join by it would form the ids a second time just to test that.
    return F.coalesce(F.floor(number * ranges / F.lit(1 << 16)).cast("int"), F.lit(0))


# --- stored index ------------------------------------------------------------------------------


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored index, or None when there is none yet."""
    try:
        return spark.read.schema(INDEX_SCHEMA).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def missing_rows(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Index rows not stored yet; a row stored in fewer copies comes back with the number still missing."""
    have = stored.groupBy("table_name", "row_id").agg(F.sum("copies").alias("have"))
    still = F.col("copies") - F.coalesce("have", F.lit(0))
    return (
        wanted.join(have, ["table_name", "row_id"], "left")
        .withColumn("copies", still)
        .filter("copies > 0")
        .select(*wanted.columns)
    )


def write_index(tables: Mapping[str, DataFrame], path: str, rebuild: bool = False) -> None:
    """Write the index partitioned by table: rebuilt from scratch, or only the rows still missing."""
    index = folded(build_index(tables))
    stored = None if rebuild else read_index(index.sparkSession, path)
    if stored is None:
        index.write.mode("overwrite").partitionBy("table_name").parquet(path)
        return
    missing_rows(index, stored).write.mode("append").partitionBy("table_name").parquet(path)


def index_progress(tables: Mapping[str, DataFrame], index: DataFrame) -> DataFrame:
    """Tables with fewer indexed rows than rows: total, indexed, missing. Most missing first."""
    totals = reduce(
        DataFrame.unionAll,
        [df.agg(F.count("*").alias("total_rows")).select(F.lit(n).alias("table_name"), "total_rows")
         for n, df in tables.items() if is_user_table(n)],
    )
    done = index.groupBy("table_name").agg(F.sum("copies").alias("indexed_rows"))
    indexed = F.coalesce("indexed_rows", F.lit(0))
    return (
        totals.join(done, "table_name", "left")
        .select("table_name", "total_rows", indexed.alias("indexed_rows"), (F.col("total_rows") - indexed).alias("missing_rows"))
        .filter(F.col("missing_rows") > 0)
        .orderBy(F.col("missing_rows").desc(), "table_name")
    )


def index_statistics(index: DataFrame, top: int = 50) -> DataFrame:
    """Indexed rows per table, largest first."""
    return (
        index.groupBy("table_name").agg(F.sum("copies").alias("indexed_rows"))
        .orderBy(F.col("indexed_rows").desc(), "table_name").limit(top)
    )
