"""Key columns: inferred from the data, or guessed from the names.

Inference goes level by level, single columns first; a set of columns that holds a known key is no candidate any more. The
candidates of a level are tested together. First on samples of their tuples, not of rows: of each candidate those tuples are
counted whose hash falls into one of many classes, all copies of them, in one pass over both sides. A candidate with a
repeated tuple there is refuted for good. What is left is counted exactly, several candidates in one pass by grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapscope.functions.names import col, common_columns

# Name parts that speak for a key, best first, and the domain table with a known key.
KEY_HINTS = ["INHPRO", "ITEMNB", "RTUNO", "PNTNO", "UNIQID", "OID", "ID", "KEY", "COD", "NO", "NB"]
KEY_SUFFIXES = ("ID", "NO", "NB")
DOMAIN_KEYS = {"RANGER_SOSTAT": ["RTUNO", "PNTNO"]}
PREFERRED_KEYS = ["ID", "RTUNO", "PNTNO", "ITEMNB", "INHPRO"]
# Tuples of a candidate in its sample, about; candidates sampled and candidates counted exactly in one pass.
SAMPLED, PER_SAMPLE, PER_PASS = 10_000, 200, 6


def key_name_score(name: str) -> int:
    text = name.upper()
    points = sum(1000 - 10 * i for i, hint in enumerate(KEY_HINTS) if hint in text)
    return points + (200 if text.endswith(KEY_SUFFIXES) else 0)


def by_key_score(columns: Sequence[str]) -> list[str]:
    return sorted(columns, key=lambda c: (-key_name_score(c), c))


def _next_level(columns: Sequence[str], width: int, known: Sequence[Sequence[str]]) -> list[list[str]]:
    """Sets of `width` columns that hold no known key, the best-named first: the order they are tried in."""
    return [list(c) for c in combinations(by_key_score(columns), width) if not any(set(k) <= set(c) for k in known)]


def sampled_repeats(a: DataFrame, b: DataFrame, candidates: Sequence[Sequence[str]], classes: int) -> set[int]:
    """Positions of the candidates of which a sampled tuple occurs twice on a side. NULL counts as a value.

    Tuples go by two 64-bit hashes; one in `classes` is counted, with all its copies.
    """
    columns = list(dict.fromkeys(c for key in candidates for c in key))

    def side(df: DataFrame, tag: int) -> DataFrame:
        hashes = [F.struct(F.lit(i).alias("candidate"), F.xxhash64(*[col(c) for c in key]).alias("h"), F.hash(*[col(c) for c in key], F.lit(i)).alias("g"))
                  for i, key in enumerate(candidates)]
        taken = F.filter(F.array(*hashes), lambda x: F.pmod(x["h"], F.lit(classes)) == 0) if classes > 1 else F.array(*hashes)
        return df.select(*[col(c) for c in columns]).select(F.lit(tag).alias("side"), F.inline(taken))

    counts = side(a, 0).unionAll(side(b, 1)).groupBy("side", "candidate", "h", "g").agg(F.count("*").alias("copies"))
    return {r["candidate"] for r in counts.filter("copies > 1").select("candidate").distinct().collect()}


def unique_among(df: DataFrame, candidates: Sequence[Sequence[str]]) -> list[bool]:
    """For each candidate, exactly: no tuple occurs twice. All are counted in one pass; an empty table has no unique key."""
    columns = list(dict.fromkeys(c for key in candidates for c in key))
    place = {c: f"c{i}" for i, c in enumerate(columns)}
    plain = df.select(*[col(c).alias(n) for c, n in place.items()])
    sets = [[F.col(place[c]) for c in key] for key in candidates]
    counts = plain.groupingSets(sets, *[F.col(n) for n in place.values()]).agg(F.grouping_id().alias("gid"), F.count("*").alias("copies"))
    worst = {r["gid"]: r["worst"] for r in counts.groupBy("gid").agg(F.max("copies").alias("worst")).collect()}
    gids = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in key) for key in candidates]
    return [worst.get(g) == 1 for g in gids]


def is_unique(df: DataFrame, key: Sequence[str]) -> bool:
    """Exact: no tuple occurs twice. An empty table has no unique key."""
    return unique_among(df, [key])[0]


def _keys_of_level(a: DataFrame, b: DataFrame, candidates: list[list[str]], rows: int, only_first: bool) -> list[list[str]]:
    """The candidates that are unique on both sides (or the first of them), in order."""
    found = []
    for start in range(0, len(candidates), PER_SAMPLE):
        some = candidates[start : start + PER_SAMPLE]
        refuted = sampled_repeats(a, b, some, max(1, rows // SAMPLED))
        left = [key for i, key in enumerate(some) if i not in refuted]
        for at in range(0, len(left), PER_PASS):
            few = left[at : at + PER_PASS]
            in_a = unique_among(a, few)
            few = [key for key, good in zip(few, in_a) if good]
            found += [key for key, good in zip(few, unique_among(b, few)) if good] if few else []
            if found and only_first:
                return found[:1]
    return found


def minimal_keys(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, width: int = 3, only_first: bool = False) -> list[list[str]]:
    """Sets of up to `width` columns that are unique on both sides while no part of them is, best-named first within a width."""
    columns = list(columns) if columns is not None else common_columns(a, b)
    if not columns:
        raise ValueError("no common columns")
    sizes = [df.count() for df in (a, b)]
    found: list[list[str]] = []
    if min(sizes) == 0:
        return found
    for n in range(1, min(width, len(columns)) + 1):
        found += _keys_of_level(a, b, _next_level(columns, n, found), max(sizes), only_first)
        if found and only_first:
            break
    return found


def infer_keys(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """First candidate unique on both sides, else the best-named column."""
    return infer_keys_checked(a, b, columns)[0]


def infer_keys_checked(
    a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None
) -> tuple[list[str], bool]:
    """The key, of all columns and all pairs of them, and whether it is unique on both sides."""
    found = minimal_keys(a, b, columns, width=2, only_first=True)
    if found:
        return found[0], True
    columns = list(columns) if columns is not None else common_columns(a, b)
    return by_key_score(columns)[:1], False


def key_evidence(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct tuples and repeated tuples of a key on each side (NULL counts as a value)."""
    names = [f"k{i}" for i in range(len(key))]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.lit(tag).alias("side"), *[col(c).alias(n) for c, n in zip(key, names)])

    counts = side(a, "a").unionByName(side(b, "b")).groupBy("side", *names).agg(F.count("*").alias("copies"))
    return counts.groupBy("side").agg(
        F.lit(",".join(key)).alias("key_columns"),
        F.sum("copies").alias("total_rows"),
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("copies") > 1).alias("repeated_keys"),
        (F.max("copies") == 1).alias("is_unique"),
    )


def guess_keys(columns: Sequence[str], table: str = "", strategy: str = "id_or_suffix") -> list[str]:
    """Key by column names alone.

    id_or_suffix  `id`, else the first `*_id`, else none
    single_suffix the key of a known table, else `ID`, else the only `*_id`, else none
    id_or_first   `id`, else the first column
    preferred     up to two of the preferred names, else the first column
    """
    columns = list(columns)
    by_upper = {c.upper(): c for c in reversed(columns)}
    exact = [by_upper["ID"]] if "ID" in by_upper else []
    suffixed = [c for c in columns if c.upper().endswith("_ID")]
    if strategy == "id_or_suffix":
        return exact or suffixed[:1]
    if strategy == "single_suffix":
        domain = DOMAIN_KEYS.get(table.upper(), [])
        if domain and all(k in by_upper for k in domain):
            return [by_upper[k] for k in domain]
        return exact or (suffixed if len(suffixed) == 1 else [])
    if strategy == "id_or_first":
        return exact or columns[:1]
    if strategy == "preferred":
        named = [by_upper[k] for k in PREFERRED_KEYS if k in by_upper]
        return named[:2] or columns[:1]
    raise ValueError(f"unknown strategy: {strategy}")
