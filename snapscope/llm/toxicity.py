"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The labelled rows are split by crc32(doc_id) mod 5: 0 is held out; 1 and 2 give the lexicon, 3 the trees, 4 the
calibration, so that no step sees what an earlier one has fitted. At most MAX_LABELLED of them are used, those of
smallest hash. The lexicon holds words and word beginnings by the log odds of occurring in toxic texts, at most
MAX_LEXICON of them, and so is small enough to send to every task. Labels, language, source and id are no features.

Defined results: null and empty texts get all-zero features and the score of those; rows without a label are scored
like others; without labels of both classes every score is the share of toxic labels (0 without any); repeated rows
and ids are scored row by row; a null id is held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches, stored

MAX_LABELLED = 20_000
MAX_LEXICON = 5_000
MIN_SUPPORT = 2
PREFIXES = (4, 5)
STRONG = 2.0
NEAR = 5
TREES, DEPTH = 16, 3

# Second person in the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes ti tus vosotros".split())
# Signs that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasii")

_EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|/\\%&#$*+=-_~`^…«»“”‘’"
_SPELLED = re.compile(r"[^\W\d_][@$!*|0-9][^\W\d_]|\b\w(?: \w){3,}\b")
_CAPS = bytes(range(0x41, 0x5B))
_ALPHA = _CAPS + bytes(range(0x61, 0x7B))

N_FEATURES = 10


def tokens(text: str) -> list[str]:
    return [w for w in (t.strip(_EDGE) for t in text.lower().split()) if w]


def entries(word: str) -> list[str]:
    """What the lexicon may know a word by: itself, and its beginnings."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def lexicon_features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = tokens(text)
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    whole = list(map(lexicon.get, words))
    best: list[tuple[int, float]] = []
    begun: list[tuple[int, float]] = []
    hidden = 0
    for at, word in enumerate(words):
        w = whole[at]
        if w is not None:
            best.append((at, w))
        for k in PREFIXES:
            w = lexicon.get("^" + word[:k]) if len(word) >= k else None
            if w is not None:
                begun.append((at, w))
        if whole[at] is None and not word.isalpha():
            plain = word.translate(LEET)
            hidden += plain != word and plain in lexicon
    strong = [at for at, w in best if w >= STRONG]
    people = [at for at, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if people and strong:
        spots = set(strong)
        near = sum(any(at + d in spots for d in range(-NEAR, NEAR + 1)) for at in people)
    raw = text.encode()
    letters = len(raw) - len(raw.translate(None, _ALPHA))
    return [
        max((w for _, w in best), default=0.0),
        sum(w for _, w in best) / n,
        math.log1p(len(strong)),
        max((w for _, w in begun), default=0.0),
        sum(w for _, w in begun) / n,
        math.log1p(sum(w >= STRONG for _, w in begun)),
        near / n,
        (len(raw) - len(raw.translate(None, _CAPS))) / (letters + 1),
        (text.count("!") + text.count("?")) / n,
        (hidden + sum(1 for _ in _SPELLED.finditer(text))) / n,
    ]


def features(text: str, lexicon: dict[str, float]) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([lexicon_features(t.as_py() or "", lexicon) for t in texts], pa.list_(pa.float64()))

    return F.arrow_udf(of, "array<double>")(text)


def remainder(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def learned_lexicon(texts: DataFrame) -> dict[str, float]:
    """Entries by their smoothed log odds, from (text, toxic); counted in each task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1)):
                seen = {e for w in set(tokens(text.as_py() or "")) for e in entries(w)}
                (toxic if label.as_py() else clean).update(seen)
            every = list(toxic | clean)
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), pa.array([toxic[e] for e in every], pa.int64()), pa.array([clean[e] for e in every], pa.int64())],
                names=["entry", "toxic", "clean"],
            )

    rows, bad = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = texts.select("text", "toxic").mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (rows - bad + 1))
    # Discounted by its own spread, so that chance occurrences don't enter.
    safe = odds - F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    known = counts.where(F.col("toxic") >= MIN_SUPPORT).withColumn("odds", odds).withColumn("safe", safe).where("safe > 0")
    return {r["entry"]: r["odds"] for r in known.orderBy(F.col("safe").desc(), "entry").limit(MAX_LEXICON).collect()}


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    bounded_batches(docs)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", remainder("doc_id")).where("fold > 0")
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic", "fold"), "labelled")
    lexicon = learned_lexicon(texts.where("fold <= 2"))
    train = stored(texts.where("fold > 2").select("toxic", "fold", features("text", lexicon).alias("x")), "toxicity-features")
    train = train.select(F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("x").alias("features"))
    rows = docs.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), features("text", lexicon).alias("x"))
    classes = {(r["fold"], r["label"]): r["count"] for r in train.groupBy("fold", "label").count().collect()}
    if any((fold, label) not in classes for fold in (3, 4) for label in (0.0, 1.0)):
        share = sum(n for (_, label), n in classes.items() if label) / max(1, sum(classes.values()))
        return rows.select("doc_id", "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=2, seed=7).fit(train.where("fold = 3"))
    odds = vector_to_array("rawPrediction")[1].alias("odds")
    calibrated = IsotonicRegression(featuresCol="odds", predictionCol="score").fit(trees.transform(train.where("fold = 4")).select("label", odds))
    out = trees.transform(rows.select("doc_id", "held_out", array_to_vector("x").alias("features"))).select("doc_id", "held_out", odds)
    return calibrated.transform(out).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
