"""Posting lists over the row index: which rows hold which three signs in a row.

Rows are stored where they are formed, numbered by task and place, and cut into blocks of PART_ROWS numbers; only rows that
occur more than once are moved, to be folded. A task deals its blocks out in turn over OPEN_PARTS parts of its own, whose files
it holds open together, so that its rows need no sort, which would spill them. Rows of a table whose values a file keeps as they are, are stored as
these values, table by table; their ids, texts and JSON are formed when they are read, and only for rows that are wanted. Of other rows, and of those
given as index rows, the JSON is stored, the id is computed from it, and so is
the text where the JSON tells it (`told`): this is tested row by row when it is stored, and every other text is kept. Lists are stored beside
them: (gram, block, n, gaps), the places of some rows of a block of BLOCK numbers, each as its distance from the one before in as few
bytes as it takes. Lists stay in the task that read their rows and are sorted there, so that the pages of a gram are found by their
bounds and a gram that every other row holds is spread over all files; and the number of rows of each gram is stored. A few keys
open a few partitions of the rows.

A search token holds no blank, so it lies inside one word; its grams are looked up, rarest first, and the rows on all of the lists are the only
ones that can hold it. They are then tested like all others. Tokens of fewer than three signs, and tokens so common
that reading the rows is cheaper than looking them up, are searched by reading the rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.names import is_user_table
from snapscope.functions.text import normalize_text
from snapscope.operators.text_index import (
    INDEX_SCHEMA, Field, Repeated, build_index, fields_may_hold, fields_of, folded_apart, joined_text, kept_as_values, may_hold, plain_text,
    repeated_hashes, row_columns, row_id, values_hash,
)
from snapscope.session import files_open

GRAM = 3
# Rows of one file of the stored rows, and how many keys are sent to all tasks at most.
PART_ROWS, KEYS_SENT = 20_000, 200_000
# Partitions of the stored rows that one task writes, and how hard files of index rows, and those of values and lists, are pressed: the latter get no
# smaller by more.
OPEN_PARTS, PRESSED, PRESSED_VALUES = 32, 9, 3
# Lists up to so many times as long as the shortest of a token are intersected with it.
WORTH = 16
# Row numbers of one list, fewer than a short integer holds; signs cut up at a time.
BLOCK, SIGNS = 1 << 15, 1 << 20
# What a row has as JSON beside its text: names and NULLs, escapes, the T within a time and the zeros at the end of its fraction.
NO_TEXT = (
    r'"(?<=[{,]")[^"\\]*+":(?:null(?=[,}]))?|\\(?:u[0-9A-Fa-f]{4}|.)'
    r"|T(?<=\d{4}-\d\d-\d\dT)(?=\d\d:\d\d:\d\d)|0++(?!\d)(?<=\d\d:\d\d:\d\d\.\d{2,6})"
)
STORED_SCHEMA = INDEX_SCHEMA.replace("row_id STRING, ", "") + ", told BOOLEAN, row_key BIGINT, part BIGINT"
TABLES_TYPE = "ARRAY<STRUCT<name: STRING, schema: STRING>>"
ABOUT_SCHEMA = f"parts INT, part_rows INT, given BOOLEAN, tables {TABLES_TYPE}"
LISTS_SCHEMA = "gram STRING, block BIGINT, n INT, gaps BINARY"
# Row numbers of a table stored by its values begin at its own number times this; so many such tables have numbers, others are stored as index rows.
TABLE_KEYS, NUMBERED = 1 << 52, 2047
# Letters and digits by their place in the order of signs, for each byte of a plain text; capitals as small letters, 0 for what ends a word.
PLAIN_SIGNS = b"0123456789abcdefghijklmnopqrstuvwxyz"
SIGN_OF = np.array([PLAIN_SIGNS.find(bytes([b]).lower()) + 1 for b in range(256)], np.uint16)
BASE = len(PLAIN_SIGNS) + 1


@dataclass(frozen=True)
class StoredTable:
    """The rows of a table as they are stored: their values (c0, c1, ...) with copies, row_key and part."""

    name: str
    schema: T.StructType
    stored: DataFrame

    @property
    def fields(self) -> list[Field]:
        return [(f.name, F.col(f"c{i}"), f.dataType) for i, f in enumerate(self.schema.fields)]

    def formed(self, stored: DataFrame) -> DataFrame:
        """Index rows of some of the stored rows."""
        return stored.select(*row_columns(self.name, self.fields), "copies", "row_key", "part")


@dataclass(frozen=True)
class PostingIndex:
    """A stored index with posting lists. `keys_sent` bounds what a lookup may send to all tasks. `given` has the rows that are stored as
    index rows, `tables` the others."""

    rows: DataFrame
    lists: DataFrame
    counts: DataFrame
    parts: int
    part_rows: int = PART_ROWS
    keys_sent: int = KEYS_SENT
    given: DataFrame | None = None
    tables: tuple[StoredTable, ...] = ()


def token_grams(token: str) -> list[str]:
    return sorted({token[i : i + GRAM] for i in range(len(token) - GRAM + 1)})


def _lists(keys: np.ndarray, texts: list[str]) -> pa.RecordBatch:
    """The lists of some rows: each distinct run of three signs without a blank, with the places of its rows by block."""
    signs = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    first, second, third = signs[:-2], signs[1:-1], signs[2:]
    whole = (first != 32) & (second != 32) & (third != 32)
    found, which = np.unique((first[whole] << 42) | (second[whole] << 21) | third[whole], return_inverse=True)
    which, row = np.divmod(np.unique(which * len(texts) + row[:-2][whole]), len(texts))
    three = np.stack([found >> 42, (found >> 21) & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype("<u4")
    return _by_block(keys, which, row, lambda some: pa.array(three.view("<U3").ravel().tolist(), pa.string()).take(pa.array(some)))


def _plain_lists(keys: np.ndarray, signs: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """As `_lists`, of texts of plain signs as they are: their bytes one after another, and where each ends."""
    sign = SIGN_OF[signs]
    within = sign > 0
    whole = within[:-2] & within[1:-1] & within[2:]
    for before in (1, 2):
        whole[np.clip(ends[:-1] - before, 0, len(whole) - 1)[(ends[:-1] >= before) & (ends[:-1] - before < len(whole))]] = False
    at = np.flatnonzero(whole)
    gram = (sign[:-2] * BASE + sign[1:-1])[at].astype(np.uint32) * BASE + sign[2:][at]
    row = np.repeat(np.arange(len(ends), dtype=np.uint32), np.diff(ends, prepend=0))[at]
    bits = max(int(len(ends) - 1).bit_length(), 1)
    # Gram and row in one number, of four bytes where that does.
    both = (gram << bits | row) if BASE**3 << bits <= 1 << 32 else (gram.astype(np.uint64) << bits | row)
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    letters = np.frombuffer(b" " + PLAIN_SIGNS, "S1")

    def text_of(some: np.ndarray) -> pa.Array:
        three = np.stack([letters[some // BASE**2], letters[some // BASE % BASE], letters[some % BASE]], axis=1)
        return pa.array(three.view("S3").ravel().astype("<U3").tolist(), pa.string())

    return _by_block(keys, (both >> bits).astype(np.int32), (both & ((1 << bits) - 1)).astype(np.int32), text_of)


def _by_block(keys: np.ndarray, which: np.ndarray, row: np.ndarray, text_of: Callable[[np.ndarray], pa.Array]) -> pa.RecordBatch:
    """Lists of grams told by number, from pairs of gram and row in their order."""
    block, place = keys // BLOCK, (keys % BLOCK).astype(np.int16)
    new = np.append(True, which[1:] != which[:-1])[: len(which)]
    if len(block) and block[0] != block[-1]:
        held = block[row]
        new[1:] |= held[1:] != held[:-1]
    starts = np.flatnonzero(new)
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(place[row]))
    return pa.RecordBatch.from_arrays([text_of(which[starts]), pa.array(block[row[starts]]), places], names=["gram", "block", "places"])


def _packed(made: pa.RecordBatch) -> pa.RecordBatch:
    """Lists with the gaps between their places: seven bits a byte, the low ones first, all bytes of a gap but its last with the high bit."""
    places = made.column("places")
    starts, flat = places.offsets.to_numpy(), places.values.to_numpy()
    gaps = np.diff(flat, prepend=flat.dtype.type(0))
    gaps[starts[:-1]] = flat[starts[:-1]]
    long = np.flatnonzero(gaps >= 1 << 7)
    sizes = np.ones(len(gaps), np.int64)
    sizes[long] += 1 + (gaps[long] >= 1 << 14)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    signs = np.empty(ends[-1], np.uint8)
    signs[ends[:-1]] = gaps & 127 | (gaps >= 1 << 7) * np.int16(128)
    for k in (1, 2):
        signs[ends[long] + k] = gaps[long] >> 7 * k & 127 | (gaps[long] >= 1 << 7 * (k + 1) if k < 2 else 0) * np.int16(128)
        long = long[gaps[long] >= 1 << 14]
    buffers = [None, pa.py_buffer(ends[starts].astype(np.int32)), pa.py_buffer(signs)]
    packed = pa.Array.from_buffers(pa.binary(), made.num_rows, buffers)
    n = pa.array(np.diff(starts).astype(np.int32))
    return pa.RecordBatch.from_arrays([made.column("gram"), made.column("block"), n, packed], names=["gram", "block", "n", "gaps"])


def _unpacked(blocks: np.ndarray, counts: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The row numbers of packed lists, one list after another."""
    last = np.flatnonzero(signs < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    sizes = last - starts + 1
    within = np.arange(len(signs)) - np.repeat(starts, sizes)
    sums = np.cumsum(np.add.reduceat((signs & 127).astype(np.int64) << 7 * within, starts))
    before = np.concatenate([[0], sums])[np.cumsum(counts) - counts]
    return sums + np.repeat(blocks * BLOCK - before, counts)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, row_key) for each place of packed lists, some SIGNS of them at a time."""
    for batch in batches:
        counts = batch.column("n").to_numpy().astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(counts) // SIGNS)) + 1).tolist(), len(counts)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                some = batch.slice(start, end - start)
                signs = np.frombuffer(b"".join(some.column("gaps").to_pylist()), np.uint8)
                keys = _unpacked(some.column("block").to_numpy(), counts[start:end], signs)
                grams = some.column("gram").take(pa.array(np.repeat(np.arange(end - start), counts[start:end])))
                yield pa.RecordBatch.from_arrays([grams, pa.array(keys)], names=["gram", "row_key"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have SIGNS of text, since long lists take less than many short ones; rows in their order."""

    def in_order(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        # Files are read in any order; gaps need the places of a list in theirs.
        keys = np.concatenate([b.column("row_key").to_numpy() for b in some])
        order = pa.array(np.argsort(keys, kind="stable"))
        texts = pa.concat_arrays([b.column("content_norm").cast(pa.large_string()) for b in some])
        return pa.RecordBatch.from_arrays([pa.array(keys).take(order), texts.take(order)], names=["row_key", "content_norm"])

    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.column("content_norm").nbytes
        if size >= SIGNS:
            yield in_order(some)
            some, size = [], 0
    if some:
        yield in_order(some)


def _lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the rows, some SIGNS of text at a time. Texts of plain signs may come as they are, others as index rows have them."""
    for batch in _gathered(batches):
        keys, texts = batch.column("row_key").to_numpy(), batch.column("content_norm")
        _, ends, signs = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        signs = np.frombuffer(signs or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        plain = np.ones(len(texts), bool)
        if len(signs) and signs.max() >= 128:
            strange = np.concatenate([[0], np.cumsum(signs >= 128)])[ends]
            plain = strange[1:] == strange[:-1]
        cuts = [0, *(np.flatnonzero(np.diff((ends[1:] + np.arange(len(texts))) // SIGNS)) + 1).tolist(), len(texts)]
        for start, end in zip(cuts, cuts[1:]):
            if end == start:
                continue
            here = plain[start:end]
            made = []
            if here.all():
                made.append(_plain_lists(keys[start:end], signs[ends[start] : ends[end]], ends[start + 1 : end + 1] - ends[start]))
            else:
                of_signs = np.repeat(here, np.diff(ends[start : end + 1]))
                made.append(_plain_lists(keys[start:end][here], signs[ends[start] : ends[end]][of_signs], np.cumsum(np.diff(ends[start : end + 1])[here])))
                made.append(_lists(keys[start:end][~here], texts.slice(start, end - start).filter(pa.array(~here)).to_pylist()))
            yield from (_packed(m) for m in made if m.num_rows)


def lists_of_rows(rows: DataFrame) -> DataFrame:
    """The lists of stored rows, sorted in each task and moved nowhere."""
    return rows.select("row_key", "content_norm").mapInArrow(_lists_of, LISTS_SCHEMA).sortWithinPartitions("gram", "block")


def text_told(as_json: Column) -> Column:
    """The text of a row as far as the row itself tells it: what is left of its JSON without names, escapes and the marks of times. Each word
    of it stands in the JSON as it is, but for accents and capitals."""
    # What is left is bound, so that it is formed once.
    return F.transform(F.array(F.regexp_replace(as_json, NO_TEXT, " ")), normalize_text)[0]


def write_postings(index: DataFrame | Mapping[str, DataFrame], path: str, part_rows: int = PART_ROWS) -> PostingIndex:
    """Store index rows, or those of tables, with their posting lists; equal rows are folded into one with their copies."""
    if isinstance(index, DataFrame):
        spark, given, tables = index.sparkSession, index, {}
    else:
        users = {name: df for name, df in index.items() if is_user_table(name)}
        if not users:
            raise ValueError("no user tables")
        spark = next(iter(users.values())).sparkSession
        tables = dict([(name, df) for name, df in users.items() if kept_as_values(df)][:NUMBERED])
        others = {name: df for name, df in users.items() if name not in tables}
        given = build_index(others) if others else None
    if given is not None:
        _write_given(given, f"{path}/rows", part_rows)
    if tables:
        _write_tables(spark, tables, path, part_rows)
    stored = _stored(spark, path, given is not None, [(name, _kept_schema(df)) for name, df in tables.items()])
    listed = [*([stored[0].select("row_key", "content_norm")] if given is not None else []), *[_listed_text(t) for t in stored[1]]]
    lists_of_rows(reduce(DataFrame.unionByName, listed)).write.mode("overwrite").options(**_pressed(PRESSED_VALUES)).parquet(f"{path}/lists")
    counted = spark.read.schema(LISTS_SCHEMA).parquet(f"{path}/lists").groupBy("gram").agg(F.sum("n").alias("n"))
    counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")
    numbered = reduce(DataFrame.unionByName, [rows.select("part") for rows in [*([stored[0]] if given is not None else []), *[t.stored for t in stored[1]]]])
    about = numbered.agg(
        F.count_distinct("part").cast("int").alias("parts"), F.lit(part_rows).alias("part_rows"), F.lit(given is not None).alias("given"),
        F.array(*[F.struct(F.lit(t.name).alias("name"), F.lit(t.schema.json()).alias("schema")) for t in stored[1]]).cast(TABLES_TYPE).alias("tables"),
    )
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return read_postings(spark, path)


def _pressed(level: int) -> dict[str, object]:
    return {"compression": "zstd", "parquet.compression.codec.zstd.level": level}


def _write_given(index: DataFrame, path: str, part_rows: int) -> None:
    keyed = folded_apart(index).drop("row_id").withColumn("row_key", F.monotonically_increasing_id())
    keyed = keyed.withColumn("told", F.coalesce(F.col("content_norm") == text_told(F.col("row_json")), F.lit(False)))
    keyed = keyed.withColumn("content_norm", F.when(~F.col("told"), F.col("content_norm")))
    _write_rows(keyed, path, part_rows, PRESSED)


def _write_rows(keyed: DataFrame, path: str, part_rows: int, level: int) -> None:
    with files_open(keyed.sparkSession, OPEN_PARTS):
        placed = keyed.withColumn("part", _part(part_rows))
        placed.write.mode("overwrite").partitionBy("part").options(**_pressed(level), maxRecordsPerFile=part_rows).parquet(path)


def _write_tables(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, part_rows: int) -> None:
    """Rows of tables as their values. What tells repeated rows is a hash of the values; ids are formed only for these."""
    hashes = {name: values_hash(name, fields_of(df)) for name, df in tables.items()}
    keys = reduce(DataFrame.unionByName, [df.select(hashes[name].alias("_key")) for name, df in tables.items()])
    repeated = repeated_hashes(keys, list(tables.values()))
    for number, (name, df) in enumerate(tables.items(), 1):
        schema = _kept_schema(df)
        values = df.select(*[value.cast(f.dataType).alias(f"c{i}") for i, ((_, value, _), f) in enumerate(zip(fields_of(df), schema.fields))], hashes[name].alias("_hash"))
        rows = _folded_values(StoredTable(name, schema, values), repeated).withColumn("row_key", F.lit(number * TABLE_KEYS) + F.monotonically_increasing_id())
        _write_rows(rows, f"{path}/values/{number}", part_rows, PRESSED_VALUES)


def _folded_values(table: StoredTable, repeated: Repeated) -> DataFrame:
    """Equal rows as one row with their number in `copies`; those that occur once stay where they are."""
    once, more = repeated.told_apart(table.stored, F.col("_hash"))
    names = [f"c{i}" for i in range(len(table.schema.fields))]
    same = row_columns(table.name, table.fields)[3]
    both = more.groupBy(same.alias("_id")).agg(F.any_value(F.struct(*names)).alias("_row"), F.count("*").alias("copies"))
    return once.select(*names, F.lit(1).cast("bigint").alias("copies")).unionByName(both.select("_row.*", "copies"))


def _kept_schema(df: DataFrame) -> T.StructType:
    """The types stored: times as the text of a row shows them, which is the same in every session."""
    return T.StructType([T.StructField(f.name, T.TimestampNTZType() if f.dataType == T.TimestampType() else f.dataType) for f in df.schema.fields])


def _listed_text(table: StoredTable) -> DataFrame:
    """(row_key, content_norm) for lists: a text of plain signs as it is, any other as index rows have it."""
    joined = table.stored.select("row_key", joined_text(table.fields).alias("text"))
    return joined.select("row_key", F.when(plain_text(F.col("text")), F.col("text")).otherwise(normalize_text(F.col("text"))).alias("content_norm"))


def _part(part_rows: int) -> Column:
    """The part of a row, from its number: the task is in the bits above the lower 33, the place in its rows below."""
    return F.expr(f"shiftright(row_key, 33) * {OPEN_PARTS} + ((row_key & {(1 << 33) - 1}) div {part_rows}) % {OPEN_PARTS}")


def _stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with their texts."""
    text = F.when(F.col("told"), text_told(F.col("row_json"))).otherwise(F.col("content_norm"))
    return spark.read.schema(STORED_SCHEMA).parquet(f"{path}/rows").withColumn("content_norm", text)


def _stored(spark: SparkSession, path: str, given: bool, tables: Sequence[tuple[str, T.StructType]]) -> tuple[DataFrame | None, list[StoredTable]]:
    """The rows stored as index rows, and the tables stored by their values."""
    stored = []
    for number, (name, schema) in enumerate(tables, 1):
        kept = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
        for column in ("copies", "row_key", "part"):
            kept = kept.add(column, T.LongType())
        stored.append(StoredTable(name, schema, spark.read.schema(kept).parquet(f"{path}/values/{number}")))
    return (_stored_rows(spark, path) if given else None), stored


def read_postings(spark: SparkSession, path: str, keys_sent: int = KEYS_SENT) -> PostingIndex:
    about = spark.read.schema(ABOUT_SCHEMA).parquet(f"{path}/about").first()
    given, tables = _stored(spark, path, about["given"], [(t["name"], T.StructType.fromJson(json.loads(t["schema"]))) for t in about["tables"]])
    if given is not None:
        given = given.withColumn("row_id", row_id(F.col("table_name"), F.col("row_json")))
    return PostingIndex(
        _one_frame([*([given] if given is not None else []), *[t.formed(t.stored) for t in tables]]),
        spark.read.schema(LISTS_SCHEMA).parquet(f"{path}/lists"), spark.read.schema("gram STRING, n BIGINT").parquet(f"{path}/counts"),
        about["parts"], about["part_rows"], keys_sent, given, tuple(tables),
    )


def _one_frame(frames: Sequence[DataFrame]) -> DataFrame:
    return frames[0] if len(frames) == 1 else reduce(DataFrame.unionByName, [f.drop("told") for f in frames])


def _worthwhile(index: PostingIndex, tokens: Sequence[str]) -> dict[str, tuple[int, list[str]]]:
    """For each token the length of its shortest list, and the grams whose lists are worth reading. One row per gram of the query is fetched."""
    wanted = sorted({g for t in tokens for g in token_grams(t)})
    found = {r["gram"]: r["n"] for r in index.counts.filter(F.col("gram").isin(wanted)).collect()}
    out = {}
    for token in tokens:
        lengths = {g: found.get(g, 0) for g in token_grams(token)}
        least = min(lengths.values())
        out[token] = least, [g for g, n in lengths.items() if n <= WORTH * max(least, 1)]
    return out


def candidate_keys(index: PostingIndex, tokens: Sequence[str], mode: str = "any") -> DataFrame | None:
    """(row_key, part) of the rows that can hold any (or all) of the tokens; None where reading all rows is the way."""
    long = [t for t in tokens if len(t) >= GRAM]
    if not long or (mode == "any" and len(long) < len(tokens)):
        return None
    known = _worthwhile(index, long)
    if mode == "any":
        most = sum(n for n, _ in known.values())
    else:
        most = min(n for n, _ in known.values())
        # The other tokens' lists are read only where they are not much longer than the shortest.
        known = {t: v for t, v in known.items() if v[0] <= WORTH * max(most, 1)}
    if most > index.keys_sent:
        return None
    wanted = sorted({g for _, gs in known.values() for g in gs})
    per_token = [F.sum(F.col("gram").isin(gs).cast("int")) == len(gs) for _, gs in known.values()]
    both = (lambda x, y: x | y) if mode == "any" else (lambda x, y: x & y)
    held = index.lists.filter(F.col("gram").isin(wanted)).mapInArrow(_keys_of, "gram STRING, row_key BIGINT")
    keys = held.groupBy("row_key").agg(reduce(both, per_token).alias("may_hold"))
    return keys.filter("may_hold").select("row_key", _part(index.part_rows).alias("part"))


def narrowed(index: PostingIndex, tokens: Sequence[str], mode: str = "any") -> DataFrame:
    """The stored rows that can hold the tokens: those of the looked-up keys, whose number is bounded by the lengths of the lists before they
    are sent out, or all of them but those whose JSON tells their text and can't hold the tokens."""
    keys = candidate_keys(index, tokens, mode)

    def of(rows: DataFrame, likely: Column | None) -> DataFrame:
        if keys is not None:
            return rows.join(F.broadcast(keys), ["part", "row_key"], "left_semi")
        return rows if likely is None else rows.filter(likely)

    frames = []
    if index.given is not None:
        likely = may_hold(index.given, tokens, mode, ["row_json"])
        frames.append(of(index.given, None if likely is None else ~F.col("told") | likely))
    # Ids, texts and JSON are formed for the rows that are left.
    frames += [t.formed(of(t.stored, fields_may_hold(t.fields, tokens, mode))) for t in index.tables]
    return _one_frame(frames)
