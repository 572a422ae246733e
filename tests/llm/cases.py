"""Small tables with what data may hold: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, node long, spans string, items string, x string, g_lang string, _part int"


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}{chr(97 + r.randrange(26))}" for _ in range(n))


def documents(spark: SparkSession, texts: list, ids: list | None = None, lang: str | None = "en", source: str | None = "s") -> DataFrame:
    """Columns beyond those of documents carry names that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 1, 2, "a", "b", "c", "d", 3) for i, t in zip(ids, texts)], DOCS)


def odd_texts() -> list:
    """Null, empty, blank, one word, ties, repeats, a very long one, signs of several bytes."""
    a, b = prose(1, 300), prose(2, 300)
    return [None, "", " \n\t ", "word", a, a, b, a + " " + prose(3, 20), prose(4, 60_000, 5000), "é" * 500 + " ü " + "日本" * 200, b.upper(), "same line\n" * 80]
