"""Language identification by Bayesian fusion of four kinds of evidence.

Text: character trigrams, hashed to BUCKETS, with a model per language counted over all documents; the evidence of
a text is its mean log likelihood times at most FULL trigrams, as neighbouring trigrams aren't independent.
Declaration: P(declared | language), from the page's lang attribute. Address: P(suffix | language). Host: a prior
smoothed from host to domain to all pages, each level with SMOOTH pseudo-rows of the one above. The last three are
grouped counts of what the text alone says, less the row's own contribution.

All languages are modelled. Counts of the text model are summed in each task before they are shuffled, and stored; the
model is BUCKETS numbers a language and is sent to the tasks in blocks of LANGUAGE_BLOCK languages, one pass over the
stored trigrams for each block after the first. Hosts with many pages are dealt out by join_small_groups.

Defined results: null or empty html has no text evidence; no lang attribute and no host are values like others;
repeated rows and ids are judged row by row; without documents that name a language, the language is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches, few_files, join_small_groups, stored
from snapscope.llm.extract import main_text
from snapscope.llm.url_filter import host_of

BUCKETS = 1 << 14
LANGUAGE_BLOCK = 200
FULL = 60
SMOOTH = 4.0

_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the text in lower case, white space as one blank."""
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "ignore"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def text_counts(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """All languages of (text, lang), and their stored counts (k, bucket, n); k is the place of a language."""
    named = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    languages = sorted(r["lang"] for r in named.select("lang").distinct().collect())
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}

        def summed() -> Iterator[pa.RecordBatch]:
            for k, counts in totals.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["k", "bucket", "n"])
            totals.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                k = place[lang.as_py()]
                if k not in totals and len(totals) >= LANGUAGE_BLOCK:
                    yield from summed()
                totals.setdefault(k, np.zeros(BUCKETS, np.int64))[:] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        yield from summed()

    counts = named.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    return languages, stored(few_files(counts), "trigram-counts")


def text_model(counts: DataFrame, first: int, end: int) -> np.ndarray:
    """Log probabilities (languages, BUCKETS) of the languages from `first` up to `end`."""
    table = np.zeros((end - first, BUCKETS))
    for row in counts.where(F.col("k").between(first, end - 1)).toLocalIterator():
        table[row["k"] - first, row["bucket"]] = row["n"]
    table += 0.5
    return np.log(table / table.sum(axis=1, keepdims=True))


def _logs(model: np.ndarray, at: np.ndarray, times: np.ndarray, full: int) -> list[float]:
    n = int(times.sum())
    return (model[:, at] @ times * (min(n, full) / n)).tolist() if n else [0.0] * len(model)


def text_evidence(html: str, model: np.ndarray, more: bool = False, full: int = FULL) -> Column:
    """declared, n (trigrams) and the log likelihood of each language for a column of html; `more` keeps the distinct trigrams and their times."""

    def of(pages: pa.Array) -> pa.Array:
        declared, sizes, logs, kept = [], [], [], ([], [])
        for page in pages:
            page = page.as_py() or ""
            found = _DECLARED.search(page)
            declared.append(found.group(1).lower() if found else "")
            at, times = np.unique(trigrams(main_text(page)), return_counts=True)
            sizes.append(int(times.sum()))
            logs.append(_logs(model, at, times, full))
            for values, own in zip(kept, (at, times)):
                values.append(own if more else None)
        columns = [pa.array(declared, pa.string()), pa.array(sizes, pa.int64()), pa.array(logs, pa.list_(pa.float64())), *(pa.array(v, pa.list_(pa.int64())) for v in kept)]
        return pa.StructArray.from_arrays(columns, names=["declared", "n", "logs", "at", "times"])

    return F.arrow_udf(of, "struct<declared: string, n: long, logs: array<double>, at: array<long>, times: array<long>>")(html)


def further_evidence(model: np.ndarray, full: int = FULL) -> Column:
    """The log likelihoods of one more block of languages, from the trigrams that are kept."""

    def of(at: pa.Array, times: pa.Array) -> pa.Array:
        return pa.array([_logs(model, a.values.to_numpy(), t.values.to_numpy(), full) for a, t in zip(at, times)], pa.list_(pa.float64()))

    return F.arrow_udf(of, "array<double>")("at", "times")


def _with_counts(rows: DataFrame, base: DataFrame, key: str, n_languages: int) -> DataFrame:
    """rows with of_<key>, counted over the stored rows `base`: how many rows of the same key each language has by the text alone, without the row itself."""
    sizes = base.groupBy(key, "guess").agg(F.count("*").alias("_n"))
    known = F.map_from_entries(F.collect_list(F.when(F.col("guess").isNotNull(), F.struct("guess", "_n"))))
    facts = sizes.groupBy(key).agg(F.sum("_n").alias("_rows"), known.alias("_known"))
    every = F.transform(F.sequence(F.lit(0), F.lit(n_languages - 1)), lambda k: F.coalesce(F.try_element_at("_known", k), F.lit(0).cast("long")))
    facts = facts.select(key, "_rows", every.alias(f"of_{key}"))
    own = F.transform(f"of_{key}", lambda n, k: n - F.when(k == F.col("guess"), 1).otherwise(0))
    return join_small_groups(rows, facts, [key], "_rows", F.xxhash64("page_id", "logs")).withColumn(f"of_{key}", own)


def identify(pages: DataFrame, docs: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host) of every page."""
    bounded_batches(pages)
    languages, counts = text_counts(docs)
    n = len(languages)
    host = host_of(F.col("url"))
    if not n:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), F.lit("").alias("declared"), host.alias("host"))
    blocks = [(first, min(first + LANGUAGE_BLOCK, n)) for first in range(0, n, LANGUAGE_BLOCK)]
    rows = pages.select("page_id", host.alias("host"), text_evidence("html", text_model(counts, *blocks[0]), len(blocks) > 1).alias("e")).select("page_id", "host", "e.*")
    for block in blocks[1:]:
        rows = stored(rows, "page-trigrams")
        rows = rows.withColumn("logs", F.concat("logs", further_evidence(text_model(counts, *block))))
    rows = rows.select(
        "page_id", "host", F.regexp_extract("host", r"([^.:]*)(?::\d*)?$", 1).alias("suffix"), F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1).alias("domain"),
        "declared", "logs", F.when(F.col("n") > 0, F.array_position("logs", F.array_max("logs")) - 1).cast("int").alias("guess"),
    )
    base = rows = stored(rows, "page-evidence")
    totals = {r["guess"]: r["count"] for r in rows.groupBy("guess").count().collect()}
    share = [totals.get(k, 0) + 1 for k in range(n)]
    overall = F.array(*(F.lit(x / sum(share)) for x in share))
    of_language = F.array(*(F.lit(float(x)) for x in share))
    for key in ("declared", "suffix", "domain", "host"):
        rows = _with_counts(rows, base, key, n)

    def smoothed(counts: str, above: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda c, p: (c + smooth * p) / (size + smooth))

    def given(counts: str) -> Column:
        """log P(value | language)"""
        return F.zip_with(counts, of_language, lambda c, t: F.log((F.coalesce(c, F.lit(0)) + 0.1) / (t + 1)))

    prior = smoothed("of_host", smoothed("of_domain", overall))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add(F.col("logs"), F.transform(prior, lambda p: F.log(p))), add(given("of_declared"), given("of_suffix")))
    fused = rows.withColumn("score", score).withColumn("best", F.array_max("score"))
    names = F.array(*map(F.lit, languages))
    return fused.select(
        "page_id", F.get(names, (F.array_position("score", F.col("best")) - 1).cast("int")).alias("lang"),
        (1 / F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("best")))).alias("confidence"),
        F.get(names, F.col("guess")).alias("text_lang"), "declared", "host",
    )
