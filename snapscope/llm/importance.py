"""Importance resampling towards a target: documents whose words are likelier in the benchmark are drawn more often.

Features are the runs of 1 to `grams` consecutive words, hashed into `buckets` by CRC-32. Their counts over all texts
of both sides give each bucket a gain, the log ratio of the smoothed shares in thousandths; an array of gains
scores a document in one pass. Gumbel noise from a hash of the id turns the highest scores into a weighted sample without
replacement. Scores are stored; the cutoff is found by bisection: exact count jobs over the stored scores narrow
down the score, then the id among those that tie at it. Only the drawn rows are then ordered, range-partitioned, for their ranks.

Nothing but counts and one row per bucket reaches the driver.

Defined results: null or wordless texts have no features and weight 0; documents of fewer than `least_words` words
are never drawn; a null doc_id is hashed as the empty text and comes first among ties; rows of one score and id are told apart by
n_features, equal rows by nothing: as many are drawn as fit. An empty target or table gives gains from what there is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches, stored
from snapscope.llm.decontaminate import words
from snapscope.operators.positions import with_positions

BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
# Thresholds that one counting job tries at a time.
TRIED = 1023


def features(text: bytes, grams: int = GRAMS) -> Iterator[bytes]:
    """All runs of 1 to `grams` consecutive words, joined by a blank."""
    found = words(text)
    for n in range(1, grams + 1):
        if n == 1:
            yield from found
        else:
            yield from map(b" ".join, zip(*(islice(found, k, None) for k in range(n))))


def hashed(text: bytes | None, grams: int, buckets: int) -> np.ndarray:
    return np.fromiter(map(crc32, features(text or b"", grams)), dtype=np.int64) % buckets


def bucket_counts(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs in all texts; each task hands on one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts += np.bincount(hashed(text, grams, buckets), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    bounded_batches(docs)
    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the counts of both sides: one row per bucket comes to the driver."""
    s, t = [0] * buckets, [0] * buckets
    for counts, side in ((s, source), (t, target)):
        for row in side.collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = sum(s), sum(t)
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * (all_s + buckets) / ((a + 1.0) * (all_t + buckets)))) for a, b in zip(s, t)], dtype=np.int64
    )


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(gain: np.ndarray, grams: int = GRAMS, seed: int = SEED) -> Column:
    """struct(n_features, n_words, weight, score) of the columns text and doc_id."""
    buckets = len(gain)

    @F.arrow_udf("struct<n_features: long, n_words: long, weight: long, score: long>")
    def run(texts: pa.Array, ids: pa.Array) -> pa.Array:
        rows = []
        for text, doc_id in zip(texts.cast(pa.binary()).to_pylist(), ids.to_pylist()):
            found = hashed(text, grams, buckets)
            n_words = len(found) if grams == 1 else len(words(text or b""))
            weight = int(gain[found].sum())
            rows.append((len(found), n_words, weight, weight + noise(doc_id, seed)))
        names = ["n_features", "n_words", "weight", "score"]
        columns = zip(*rows) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run("text", "doc_id")


def scored(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every document, stored."""
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets), buckets)
    frame = docs.select("doc_id", "text").select("doc_id", weighed(gain, grams, seed).alias("_w"))
    return stored(frame.select("doc_id", "_w.n_features", "_w.n_words", "_w.weight", "_w.score"), "scores")


def least_reaching(rows: DataFrame, value: str, wanted: int) -> int | None:
    """The least x such that at least `wanted` rows have value <= x, by bisection; None if there are not so many.

    A counting job tries TRIED thresholds at once and leaves one gap between two of them.
    """
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < wanted:
        return None
    low, below = low - 1, 0  # `below` rows lie at low or below, fewer than wanted
    while high - low > 1:
        step = -(-(high - low) // (TRIED + 1))
        # A bigint beside a decimal literal, so that the distance of two numbers can't overflow.
        gap = F.floor((F.col(value).cast("decimal(20,0)") - F.expr(f"{low + 1}BD")) / F.expr(f"{step}BD")).cast("int")
        inside = rows.where((F.col(value) > F.expr(f"{low}BD")) & (F.col(value) <= F.expr(f"{high}BD")))
        for k, count in sorted(inside.groupBy(gap.alias("gap")).count().collect()):
            if below + count >= wanted:
                low, high = low + k * step, min(high, low + (k + 1) * step)
                break
            below += count
    return high


def drawn(scores: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scores with `rank`: 1, 2, ... for the drawn rows, by falling score and rising doc_id, else null."""
    # The smallest come first: negated scores, and ids with null below all.
    ordered = scores.withColumn("_least", -F.col("score")).withColumn("_id", F.col("doc_id").cast("long"))
    able = F.col("n_words") >= least_words
    wanted = percent * ordered.where(able).count() // 100
    columns = scores.columns
    if wanted == 0:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    cutoff = least_reaching(ordered.where(able), "_least", wanted)
    tied = ordered.where(able & (F.col("_least") == cutoff))
    before, nulls = ordered.where(able).agg(F.count(F.when(F.col("_least") < cutoff, 1)), F.count(F.when((F.col("_least") == cutoff) & F.col("_id").isNull(), 1))).first()
    last_id = least_reaching(tied.where("_id IS NOT NULL"), "_id", wanted - before - nulls) if wanted > before + nulls else None
    ties = F.col("_id").isNull() if last_id is None else F.col("_id").isNull() | (F.col("_id") <= last_id)
    chosen = able & ((F.col("_least") < cutoff) | ((F.col("_least") == cutoff) & ties))
    # Only copies of the last (score, id) can be too many: they are cut off by rank. The row number keeps copies apart,
    # so that they are spread by the range partitioning like all others.
    numbered = ordered.where(chosen).withColumn("_row", F.monotonically_increasing_id())
    ranks = with_positions(numbered, ["_least", "_id", "n_features", "_row"], name="rank")
    place = F.when(F.col("rank") < wanted, F.col("rank") + 1)
    return ranks.select(*columns, place.alias("rank")).unionByName(ordered.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(
    docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) of every document."""
    return drawn(scored(docs, target, grams, buckets, seed), least_words, percent)
