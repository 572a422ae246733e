"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text longer than LONG characters is cut at safe boundaries first, so that no call gets more than about LONG
characters where the text allows it. A boundary is safe where the split pattern can't match across it, whatever
stands around it: after a letter or a digit before a sign or white space, and around a run of white space as the
pattern takes it (all of the run but its last character, if something follows). The matches, and so the ids, are
those of the whole text. A run of LONG white characters or more is one match and goes to the library as one piece:
its pattern engine gives up on very long runs. Decoding joins the bytes of the ids, so ids that end inside a
character are decoded like all others.

Ids are stored flat, as little-endian unsigned 32-bit integers. Markers of special tokens are ordinary text.

Defined results: null text is empty, an empty text has no ids; bytes that are no UTF-8 are read as U+FFFD; every row
stands for itself, repeated ones too; an empty table gives no row; further columns are kept as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches

LONG = 1 << 16
# After a character that is a letter or a digit in any version of Unicode, before one that is neither in any.
_LETTER = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0410-\u044F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"
_BOUNDARY = regex.compile(rf"(?<=[{_LETTER}0-9])(?=[\x00-/:-@\[-`{{-\x7F\u3001\u3002\uFF0C])")
_RUN = regex.compile(r"\s{%d,}" % LONG)


@lru_cache(maxsize=4)
def encodings(ranks: str, pattern: str):
    """The encoding of a rank file of base64 tokens, and one that takes a whole text as one match."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    made = [tiktoken.Encoding(name, pat_str=p, mergeable_ranks=table, special_tokens={}) for name, p in (("text", pattern), ("piece", r"(?s:.)+"))]
    return made[0], made[1]


def cut(text: str, long: int = LONG) -> Iterator[str]:
    """The text in parts of about `long` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > long:
        boundary = next(_BOUNDARY.finditer(text, at + long), None)
        if boundary is None:
            break
        yield text[at : boundary.start()]
        at = boundary.start()
    yield text[at:]


def matches_apart(text: str, long: int = LONG) -> Iterator[tuple[bool, str]]:
    """(one match, part) for all parts of the text; parts that aren't one match are to be split by the pattern."""
    at = 0
    for run in (_RUN if long == LONG else regex.compile(r"\s{%d,}" % long)).finditer(text):
        end = run.end() - (run.end() < len(text))
        if run.start() > at:
            yield from ((False, part) for part in cut(text[at : run.start()], long))
        yield True, text[run.start() : end]
        at = end
    if at < len(text):
        yield from ((False, part) for part in cut(text[at:], long))


def encode(text: str, ranks: str, pattern: str, long: int = LONG) -> np.ndarray:
    """The ids of one text."""
    by_pattern, whole = encodings(ranks, pattern)
    if len(text) <= long:
        return np.array(by_pattern.encode_ordinary(text), dtype="<u4")
    parts = [(whole if one else by_pattern).encode_ordinary(part) for one, part in matches_apart(text, long)]
    return np.concatenate([np.array(ids, dtype="<u4") for ids in parts])


def ids_of(text: str | Column, ranks: str, pattern: str) -> Column:
    """A column of flat ids for a column of text."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        return pa.array([encode((t.as_py() or b"").decode("utf-8", "replace"), ranks, pattern).tobytes() for t in raw], pa.binary())

    return run(text)


def bytes_of(ids: str | Column, ranks: str, pattern: str) -> Column:
    """A column of the bytes that flat ids stand for; null for null."""

    @F.arrow_udf("binary")
    def run(flat: pa.Array) -> pa.Array:
        decode = encodings(ranks, pattern)[0].decode_bytes
        return pa.array([None if f is None else decode(np.frombuffer(f, dtype="<u4").tolist()) for f in flat.to_pylist()], pa.binary())

    return run(ids)


def encoded(docs: DataFrame, ranks: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with the flat ids of a text column in place of that column."""
    bounded_batches(docs)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, name)]
    return docs.select(*kept, ids_of(text, ranks, pattern).alias(name))


def decoded(frame: DataFrame, ranks: str, pattern: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """frame with the bytes of a column of flat ids beside it."""
    bounded_batches(frame)
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if c != name], bytes_of(ids, ranks, pattern).alias(name))
