"""Best-fit packing planned on the length histogram.

Documents are tokenised once into pieces of at most `capacity` tokens, which are stored. Best-fit decreasing then
runs on the counts of each length, not on pieces: bins of equal remaining room form one group, and a step places one
length into a whole group. The plan has runs (length, first rank, count, first sequence, offset); its size depends
on the number of lengths, never on the number of pieces. A piece takes its place by its rank among those of its
length; ranks come from counts by (length, part) and a row number within each part, so a length that a third of all
pieces share is still spread over PARTS tasks.

Ids are those that the tokenizers library gives by default: the markers of special tokens in a text get their own id.

Defined results: null text is empty and has the closing id only; every row is packed, repeated rows and ids as often
as they occur; an empty table gives no row.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches, stored

CAPACITY = 1024
END = 2
PARTS = 64

# Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of the tokenizers file that lies beside a vocabulary file, and their ids."""
    with open(os.path.splitext(vocabulary)[0] + ".json", encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def encoder(vocabulary: str, added: dict[str, int] | None = None):
    """Text to ids by a vocabulary file of base64 tokens and ranks. Added tokens in a text get their ids; others are ordinary text."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added or {})
    return partial(encoding.encode, allowed_special="all") if added else encoding.encode_ordinary


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenised(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, added_tokens(vocabulary))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], dtype="<u4")
                doc_id = doc_id.as_py()
                rows += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES_ARROW)], schema=PIECES_ARROW)

    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) of best-fit decreasing over counts.

    A bin takes pieces of the length at hand until no further one fits, as best fit would fill it.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # groups (first sequence, count) by room left
    runs, opened = [], 0

    def fill(length: int, rank: int, first: int, bins: int, each: int, left: int) -> int:
        """Puts `each` pieces into each of `bins` sequences with `left` room; the next rank."""
        for k in range(each):
            runs.append((length, rank + k * bins, bins, first, capacity - left + k * length))
        room[left - each * length].append((first, bins))
        return rank + each * bins

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            left = next((r for r in range(length, capacity + 1) if room[r]), None)
            if left is None:
                left = capacity
                first, bins = opened, -(-(count - rank) // (capacity // length))
                opened += bins
            else:
                first, bins = room[left].pop()
            each = left // length
            full = min(bins, (count - rank) // each)
            if full:
                rank = fill(length, rank, first, full, each, left)
            if full < bins:
                first, bins = first + full, bins - full
                if count > rank:
                    rank = fill(length, rank, first, 1, count - rank, left)
                    first, bins = first + 1, bins - 1
                if bins:
                    room[left].append((first, bins))
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with sequence_id and offset."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int")
    pieces = pieces.withColumn("_part", part)
    counts = pieces.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most capacity * PARTS lines, whatever the input.
    bases = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"), "n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(histogram, capacity))
    lengths, ranks, firsts, offsets = (np.array([r[k] for r in runs], dtype=np.int64) for k in (0, 1, 3, 4))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(lengths * (1 << 40) + ranks, length * (1 << 40) + rank, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])], names=["sequence_id", "offset"])

    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("_row", F.row_number().over(within)).join(F.broadcast(bases.drop("n")), ["length", "_part"])
    placed = ranked.withColumn("_place", place("length", F.col("_base") + F.col("_row") - 1))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(tokenised(docs, vocabulary, capacity), "pieces"), capacity)
