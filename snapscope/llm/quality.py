"""Quality rules: fixed base limits, then robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics. Center and covariance of each language and source are minimum-
covariance-determinant estimates: from a start of medians and deviations, each concentration step re-estimates them
from the share SHARE of rows nearest by Mahalanobis distance, until the determinant falls by less than the share FALL.
A step is one aggregation over all rows: moments by group and distance bin, so that the nearest share is a prefix of a
group's bins, the last one by its part (no sampling, at most BINS lines a group). The step that ends a group's search
has the distances under its final estimate; that is scaled so that their median is that of a normal vector, and never
down. Determinants have a least value by FLOORS, so the search ends.

Every group is estimated, however small: PRIOR rows with the medians and deviations of its language are counted in at
each step (and in the scale), so that a group of n rows has the weight SHARE * n / (SHARE * n + PRIOR) against its
language, without a size at which anything changes. Being the same in all steps, they leave the determinant falling.
With 40 of them a row alone in its group can still be found far from its language.
Rows beyond CUTOFF * (1 + SLACK / rows of the language) are rejected: what few rows say is trusted less.

Defined results: null text has no words and fails the base rule; null language and source are groups of their own;
repeated rows and ids are judged row by row; empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches, few_files, join_small_groups, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SHARE = 0.75
FALL = 1e-3
BINS, BINS_PER_UNIT = 400, 16
PRIOR, SLACK = 40, 30
# Fixed values for six dimensions: the median and the 0.999 quantile of chi-square.
DIM, CHI2_MEDIAN, CUTOFF = 6, 5.348, 22.458
# And the variance of the nearest three quarters (SHARE), as a part of that of all.
NEAREST_VARIANCE = 0.733
# Least standard deviation of each statistic, so that a group without any variation keeps a scale.
FLOORS = (0.10, 0.07, 0.05, 0.05, 0.05, 0.10)

_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))
_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_BLANKS = " \t\n\x0b\x0c\r"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = "struct<" + ", ".join(f"{c}: long" for c in BASE) + ", x: array<double>>"


def repeated_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more."""
    seen: dict = {}
    twice = bytearray(len(words))
    for at, window in enumerate(zip(words, words[1:], words[2:])):
        first = seen.setdefault(window, at)
        if first != at:
            twice[first : first + 3] = twice[at : at + 3] = b"\1\1\1"
    return sum(twice)


def statistics(text: str) -> tuple[list[int], list[float]]:
    """Base counts, and the transformed vector. Ratios are over counts plus a constant: short texts say little."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.encode().split()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    marks = len(raw) - len(raw.translate(None, _PUNCTUATION))
    vector = [
        math.log((chars + 60) / (n + 10)), math.log1p(symbols / (n + 20)), dup_lines / (len(lines) + 10), repeats / (n + 50),
        upper / (letters + 100), math.log1p(marks / (n + 20)),
    ]
    return [n, chars, symbols, dup_lines, repeats], vector


def _features(texts: pa.Array) -> pa.Array:
    rows = [statistics(t.as_py() or "") for t in texts]
    base = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(BASE))]
    return pa.StructArray.from_arrays([*base, pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=[*BASE, "x"])


def features(text: str) -> Column:
    """Base counts and vector of a text column."""
    return F.arrow_udf(_features, FEATURES)(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _distance2() -> Column:
    """Squared Mahalanobis distance of x from center, by the rows of the whitening matrix."""
    away = [F.get("x", F.lit(i)) - F.get("center", F.lit(i)) for i in range(DIM)]
    rows = [sum((F.get("whiten", F.lit(i * DIM + j)) * away[j] for j in range(i + 1)), F.lit(0.0)) for i in range(DIM)]
    return sum((r * r for r in rows), F.lit(0.0))


GROUP = ["g_lang", "g_source"]
MODEL = "g_lang string, g_source string, g_rows long, lang_rows long, prior array<double>, prior_var array<double>, center array<double>, whiten array<double>, logdet double, scale double, fell boolean"


def _quantile(counts: np.ndarray, share: float) -> float:
    """The place in bins, as a real number, below which that share of the rows lies."""
    ends = np.cumsum(counts)
    at = int(np.searchsorted(ends, share * ends[-1]))
    return at + 1 - (ends[at] - share * ends[-1]) / counts[at]


def _concentrated(key: tuple, bins: pa.Table, model: pa.Table) -> pa.Table:
    """Center and covariance from the nearest bins that hold SHARE of the group, and its language's rows, or the former ones, scaled, if the determinant doesn't fall."""
    bins, former = bins.sort_by("bin"), model.to_pylist()[0]
    counts = bins["n"].to_numpy()
    part = np.clip(_quantile(counts, SHARE) - np.arange(len(counts)), 0, 1)
    prior, prior_var = former["prior"], former["prior_var"]
    n = (part * counts).sum() + PRIOR
    center = np.array([(part * bins[f"s{i}"].to_numpy()).sum() + PRIOR * prior[i] for i in range(DIM)]) / n
    cov = np.empty((DIM, DIM))
    for i in range(DIM):
        for j in range(i + 1):
            added = PRIOR * (prior[i] * prior[j] + (prior_var[i] if i == j else 0))
            cov[i, j] = cov[j, i] = ((part * bins[f"s{i}_{j}"].to_numpy()).sum() + added) / n - center[i] * center[j]
    values, vectors = np.linalg.eigh(cov)
    root = np.linalg.cholesky((vectors * np.maximum(values, 0)) @ vectors.T + np.diag(np.square(FLOORS)))
    logdet = 2 * float(np.log(np.diag(root)).sum())
    if logdet < former["logdet"] - FALL:
        new = {"center": center.tolist(), "whiten": np.linalg.inv(root).ravel().tolist(), "logdet": logdet, "scale": 1.0, "fell": True}
    else:
        middle = _quantile(counts, 0.5)
        d = (bins["bin"].to_numpy()[int(middle)] + middle % 1) / BINS_PER_UNIT
        rows = counts.sum()
        new = {"scale": max(1.0, (rows * d * d / CHI2_MEDIAN + PRIOR / NEAREST_VARIANCE) / (rows + PRIOR)), "fell": False}
    return pa.Table.from_pylist([former | new], model.schema)


NULL = "\x00null"


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"g_lang": F.coalesce("lang", F.lit(NULL)), "g_source": F.coalesce("source", F.lit(NULL))})


def start(rows: DataFrame) -> DataFrame:
    """Medians and deviations of each language and source, drawn to those of the language as far as the group is small."""
    values = rows.select(*GROUP, *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(DIM)))
    middle = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIM)]
    sets = values.groupingSets([[F.col(c) for c in GROUP], [F.col("g_lang")]], *GROUP).agg(F.count("*").alias("g_rows"), F.grouping_id().alias("_of"), *middle)
    center = F.array(*(F.get(f"q{i}", F.lit(1)) for i in range(DIM)))
    var = F.array(*(F.pow((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, 2) + F.lit(FLOORS[i] ** 2) for i in range(DIM)))
    found = stored(few_files(sets.select(*GROUP, "_of", "g_rows", center.alias("center"), var.alias("var"))), "mcd-quartiles")
    language = found.where("_of > 0").select("g_lang", F.col("g_rows").alias("lang_rows"), F.col("center").alias("prior"), F.col("var").alias("_var"))
    weight = F.col("g_rows") / (F.col("g_rows") + PRIOR)
    drawn = [F.get("center", F.lit(i)) * weight + F.get("prior", F.lit(i)) * (1 - weight) for i in range(DIM)]
    sd = [F.sqrt(F.get("var", F.lit(i)) * weight + F.get("_var", F.lit(i)) * (1 - weight)) for i in range(DIM)]
    return found.where("_of = 0").join(language, "g_lang").select(
        *GROUP, "g_rows", "lang_rows", "prior", F.transform("_var", lambda v: v * NEAREST_VARIANCE).alias("prior_var"), F.array(*drawn).alias("center"),
        F.array(*(1 / sd[i] if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM))).alias("whiten"),
        F.lit(math.inf).alias("logdet"), F.lit(1.0).alias("scale"), F.lit(True).alias("fell"),
    )


def estimate(rows: DataFrame) -> DataFrame:
    """The model of each group of rows (g_lang, g_source, x); stored."""
    model = stored(few_files(start(rows)), "mcd-start")
    x = [F.get("x", F.lit(i)) for i in range(DIM)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(DIM)] + [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(DIM) for j in range(i + 1)]
    # Groups whose determinant has stopped falling are set aside; the others' rows are met again.
    ended, searched, step = [], True, 0
    while searched:
        near = join_small_groups(rows, model.select(*GROUP, "g_rows", "center", "whiten"), GROUP, "g_rows", F.xxhash64("x")).where("center IS NOT NULL")
        bins = near.withColumn("bin", F.least(F.floor(F.sqrt(_distance2()) * BINS_PER_UNIT), F.lit(BINS)).cast("int"))
        moments = bins.groupBy(*GROUP, "bin").agg(F.count("*").alias("n"), *sums)
        seen = Observation()
        found = moments.groupBy(*GROUP).cogroup(model.groupBy(*GROUP)).applyInArrow(_concentrated, MODEL)
        found = stored(few_files(found).observe(seen, F.count_if(F.col("fell")).alias("falling")), f"mcd-{step}")
        ended.append(found.where("NOT fell"))
        model, searched, step = found.where("fell"), seen.get["falling"] > 0, step + 1
    model = reduce(DataFrame.union, ended)
    return model.select(*GROUP, "g_rows", "lang_rows", "center", F.transform("whiten", lambda w: w / F.sqrt("scale")).alias("whiten"))


def judged(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (lang, source, base counts, x) with distance2, base_failed and kept."""
    far = join_small_groups(keyed(rows), model, GROUP, "g_rows", F.xxhash64("x"))
    far = far.withColumn("distance2", _distance2()).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return far.withColumn("kept", ~F.col("base_failed") & (F.col("distance2") <= CUTOFF * (1 + SLACK / F.col("lang_rows"))))


def fitted(rows: DataFrame) -> DataFrame:
    """Model of stored rows (lang, source, x)."""
    return estimate(keyed(rows).select(*GROUP, "x"))


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, distance2) of every document."""
    bounded_batches(docs)
    rows = stored(docs.select("doc_id", "lang", "source", features("text").alias("f")).select("doc_id", "lang", "source", "f.*"), "quality")
    return judged(rows, fitted(rows)).select("doc_id", *BASE, "base_failed", "kept", "distance2")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    bounded_batches(docs)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "lang", "source", features("text").alias("_f")).select("_doc", "lang", "source", "_f.*")
    model = fitted(stored(rows.select("lang", "source", "x"), "quality"))
    return judged(rows, model).where("kept").select("_doc.*")
