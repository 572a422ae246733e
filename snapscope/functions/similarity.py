"""Token-set similarity of a text to a query, 0 to 100.

Set algebra on the tokens and the length arithmetic are built-in expressions. The longest common
subsequence of the two leftover strings is bounded first, by contained words, lengths and counts of signs; only rows
whose score the bounds leave open need it. It is then a fold over bits in the JVM; only for queries of more than
PLACES signs it runs in an Arrow batch function.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence_length(pattern: str, text: str) -> int:
    """Length of the longest common subsequence, with the pattern held as the bits of one integer."""
    places: dict[str, int] = {}
    for i, char in enumerate(pattern):
        places[char] = places.get(char, 0) | (1 << i)
    everything = (1 << len(pattern)) - 1
    unmatched = everything
    for char in text:
        hits = unmatched & places.get(char, 0)
        if hits:
            unmatched = ((unmatched + hits) | (unmatched - hits)) & everything
            if not unmatched:
                break
    return len(pattern) - unmatched.bit_count()


@F.pandas_udf(T.IntegerType())
def _subsequence(left: pd.Series, right: pd.Series) -> pd.Series:
    lengths = [None if x is None else common_subsequence_length(*sorted((x, y), key=len)) for x, y in zip(left, right)]
    return pd.Series(lengths, dtype="Int32")


# A query whose words take up to so many places is matched in the JVM, its places being the bits of one long.
PLACES = 60


def _places(words: Sequence[str]) -> dict[str, int]:
    """For each sign of the words joined by blanks, the bits of its places."""
    places: dict[str, int] = {}
    for i, sign in enumerate(" ".join(words)):
        places[sign] = places.get(sign, 0) | (1 << i)
    return places


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _open_places(words: Sequence[str], left: Sequence[str]) -> str:
    """SQL for the bits of the words that are left over, each with the blank before it unless it is the first of them."""
    bits, at = ["0L"], 0
    for k, word in enumerate(words):
        own = ((1 << len(word)) - 1) << at
        bits.append(f"IF({left[k]}, {own}L" + (f" + IF({' OR '.join(left[:k])}, {1 << (at - 1)}L, 0L)" if at else "") + ", 0L)")
        at += len(word) + 1
    return " + ".join(bits)


def _subsequence_in_places(words: Sequence[str], text: str) -> Column:
    """Length of the longest common subsequence of the words' open places (`_bits`) and a text: one fold over those signs of the
    text that the words have at all."""
    places, n = _places(words), len(" ".join(words))
    everything = f"{(1 << n) - 1}L"
    known = "map(" + ", ".join(f"{_quoted(sign)}, {at}L" for sign, at in places.items()) + ")"
    others = "[^" + re.escape("".join(sorted(places))) + "]"
    masks = f"transform(filter(split(regexp_replace({text}, {_quoted(others)}, ''), ''), c -> c <> ''), c -> coalesce({known}[c], 0L) & _bits)"
    return F.expr(f"{n} - bit_count(aggregate({masks}, {everything}, (u, m) -> ((u + (u & m)) | (u - (u & m))) & {everything}))")


def _ratio(common: str) -> str:
    """SQL for the best of the three ratios, given the common subsequence of the leftovers."""
    prefix = "_shared + IF(_shared > 0, 1, 0)"
    leftovers = f"100D * (1 - (_len_query + _len_text - 2 * {common}) / ({prefix} + _len_query + {prefix} + _len_text))"
    by_query, by_text = (f"100D * (1 - (1 + {n}) / (_shared + {prefix} + {n}))" for n in ("_len_query", "_len_text"))
    return (
        f"CASE WHEN _nothing THEN 0D WHEN _shared > 0 AND (_len_query = 0 OR _len_text = 0) THEN 100D "
        f"WHEN _shared = 0 THEN {leftovers} ELSE greatest({leftovers}, {by_query}, {by_text}) END"
    )


def computed_once(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Add columns (expressions or SQL) that later filters and projections read as values: behind a generator of one row the
    optimizer doesn't copy their expressions into each place that uses them."""
    made = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*made))))


STAGED = ["_nothing", "_shared", "_len_query", "_len_text", "_least", "_most", "_bits", "_rest_query", "_rest_text"]


def with_common_bounds(df: DataFrame, query_tokens: Sequence[str], text: str, whole_scores: bool = False) -> DataFrame:
    """Stage the ratio: what it needs, with bounds of the leftovers' common subsequence (`_least`, `_most`).

    A query word inside the leftovers of the text is common to both; no more can be common than the shorter of
    them, nor, sign by sign, than the rarer side holds. The leftovers themselves stay only where the bounds leave the
    ratio open (with `whole_scores`, the whole number it is cut to); elsewhere both bounds give it.
    """
    words = sorted(set(query_tokens))
    value = f"`{text.replace('`', '``')}`"
    listed = "array(" + ", ".join(map(_quoted, words)) + ")" if words else "cast(array() AS array<string>)"
    whole = [f"contains(concat(' ', {value}, ' '), {_quoted(f' {t} ')})" for t in words]
    left = [f"NOT {hit}" for hit in whole]
    staged = computed_once(
        df,
        _nothing=f"{value} = '' OR {str(not words).lower()}",
        _shared="length(concat_ws(' ', " + ", ".join([f"IF({hit}, {_quoted(t)}, NULL)" for hit, t in zip(whole, words)] or ["''"]) + "))",
        _rest_query="concat_ws(' ', " + ", ".join([f"IF({hit}, {_quoted(t)}, NULL)" for hit, t in zip(left, words)] or ["''"]) + ")",
        # Distinct leftover words; their length needs no order, so they are sorted only where it matters.
        _rest_text=f"array_join(array_except(split({value}, ' '), {listed}), ' ')",
        _bits=_open_places(words, left) if len(" ".join(words)) <= PLACES else "cast(NULL AS BIGINT)",
    )
    staged = computed_once(
        staged, _len_query="length(_rest_query)", _len_text="length(_rest_text)", _least="0", _most="least(length(_rest_query), length(_rest_text))")
    low, high = _ratio("_least"), _ratio("_most")
    is_open = f"floor({low}) < floor({high})" if whole_scores else f"{low} < {high}"
    # Leftovers go where nothing is open any more.
    staged = staged.withColumn("_rest_text", F.expr(f"IF({is_open}, _rest_text, NULL)"))
    inside = [f"IF(contains(concat(' ', _rest_query, ' '), {_quoted(f' {t} ')}) AND contains(_rest_text, {_quoted(t)}), {len(t)}, 0)" for t in words]
    rarer = [
        f"least(length(_rest_query) - length(replace(_rest_query, {s}, '')), length(_rest_text) - length(replace(_rest_text, {s}, '')))"
        for s in map(_quoted, sorted(set(" ".join(words))))
    ]
    least = f"IF(_rest_text IS NULL, _least, greatest(0, {', '.join(inside or ['0'])}))"
    most = f"IF(_rest_text IS NULL, _most, least(_most, {' + '.join(rarer or ['0'])}))"
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in staged.columns if c not in ("_least", "_most")]
    staged = staged.select(*kept, F.expr(f"inline(array(struct({least} AS _least, {most} AS _most)))"))
    return staged.withColumn("_rest_text", F.expr(f"IF({is_open}, _rest_text, NULL)"))


def ratio_bounds() -> tuple[Column, Column]:
    """Lower and upper bound of the ratio of a staged row."""
    return F.expr(_ratio("_least")), F.expr(_ratio("_most"))


def with_exact_ratio(staged: DataFrame, query_tokens: Sequence[str], name: str) -> DataFrame:
    """Add the ratio of staged rows: by their bounds where these agree, else with the common subsequence of the leftovers."""
    words = sorted(set(query_tokens))
    ordered = "array_join(sort_array(split(_rest_text, ' ')), ' ')"
    if not words:
        common = F.lit(0)
    elif len(" ".join(words)) <= PLACES:
        common = _subsequence_in_places(words, ordered)
    else:
        common = _subsequence(F.expr("IF(_rest_text IS NULL, NULL, _rest_query)"), F.expr(ordered))
    found = computed_once(staged, _common=F.when(F.col("_rest_text").isNull(), F.col("_most")).otherwise(common))
    return found.withColumn(name, F.expr(_ratio("_common"))).drop("_common")


def with_token_set_ratio(df: DataFrame, query_tokens: Sequence[str], text: str, name: str = "ratio") -> DataFrame:
    """Add the best of three ratios: leftovers against each other, and the shared part against each side.

    `text` names a column of normalised text, tokens separated by one blank.
    """
    staged = with_exact_ratio(with_common_bounds(df, query_tokens, text), query_tokens, name)
    return staged.drop(*STAGED)
