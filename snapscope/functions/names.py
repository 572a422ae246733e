"""Names of tables and columns: quoting, exact matching, safe names, display order.

Everything here works on schemas (a handful of strings on the driver), never on rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column-name hints that raise or lower a column in displays.
DISPLAY_FIRST = [
    "INHPRO", "ITEMNB", "RTUNO", "PNTNO", "PNTNAM", "SUBNAM", "BITBYT", "UNIQID", "PNLNAM",
    "PNLNDX", "MEASID", "PHISID", "STACON", "PRIORT", "PSEUDO", "SOETYP", "SOEHIS", "NORMST",
    "OVROPT", "OID", "CLASS", "DEVNAM", "LPTYPE", "PDESCR",
]
COLUMN_GROUPS = [
    ("IDENTIFICACAO", ["INH", "ITEM", "PNL", "PNT", "RTU", "SUB", "UNIQ", "NAME", "NOME", "COD"]),
    ("STATUS", ["STAT", "STACON", "NORMST", "SOEHIS", "PRIORT", "CLASS"]),
    ("TIPO_E_HIERARQUIA", ["PSEUDO", "SOETYP", "ACRONM", "MEASID", "PHISID", "BITBYT"]),
    ("LOCAL", ["HWADR", "HW", "SITE", "AREA", "REGIAO", "REGION"]),
]
OTHER_GROUP = "OUTROS"
WIDE_NAME_PARTS = ["DESC", "TEXT", "NOTE", "MSG", "COMM", "NAM"]
HEADLINE_FIELDS = [
    "PNTNAM", "SUBNAM", "PNLNAM", "ITEMNB", "PNTNO", "RTUNO", "INHPRO", "STACON", "NORMST",
]
# Tables that belong to the store, not to the user.
SYSTEM_TABLES = ["_fulltext"]
SYSTEM_PREFIXES = ["msys", "sqlite_", "duckdb_"]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str, side: str | None = None) -> Column:
    """Column by its exact name, whatever characters the name holds."""
    return F.col(quoted(name) if side is None else f"{side}.{quoted(name)}")


def known_name(name: str, known: Iterable[str], what: str = "column") -> str:
    """Exact, case-sensitive match against the known names."""
    if name in list(known):
        return name
    raise ValueError(f"unknown {what}: {name}")


def reject_case_clashes(columns: Sequence[str]) -> None:
    """Spark resolves names ignoring case, so a frame with `Id` and `id` cannot be addressed safely."""
    seen: dict[str, str] = {}
    for name in columns:
        other = seen.setdefault(name.lower(), name)
        if other != name:
            raise ValueError(f"columns differ only by case: {other}, {name}")


def is_user_table(name: str) -> bool:
    low = name.lower()
    return low not in SYSTEM_TABLES and not low.startswith(tuple(SYSTEM_PREFIXES))


def user_tables(names: Iterable[str]) -> list[str]:
    """Trimmed, de-duplicated user tables in their given order."""
    trimmed = (str(n).strip() for n in names)
    return [n for n in dict.fromkeys(trimmed) if n and is_user_table(n)]


def common_tables(a: Iterable[str], b: Iterable[str]) -> list[str]:
    return sorted(set(a) & set(b))


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns present on both sides, in the order of side A."""
    right = set(b.columns)
    return [c for c in a.columns if c in right]


def safe_table_name(name: str) -> str:
    safe = re.sub(r"[^a-zA-Z0-9_]", "_", name)
    return "T_" + safe if safe[:1].isdigit() else safe


def collision_free_name(base: str, source: str, table: str, date: str | None = None) -> str:
    """`<base>_<8 hex digits of sha1(source:table)>[_<date>]`: distinct sources never share a name."""
    digest = hashlib.sha1(f"{source}:{table}".encode()).hexdigest()[:8]
    return f"{base}_{digest}" if date is None else f"{base}_{digest}_{date}"


def cache_name(path: str) -> str:
    """Name of a derived copy: the safe file name and 12 hex digits of sha1(path)."""
    safe = re.sub(r"[^A-Za-z0-9._-]+", "_", path.rsplit("/", 1)[-1].strip()).strip("._")
    return f"{safe or 'source'}__{hashlib.sha1(path.encode()).hexdigest()[:12]}"


def column_key(name: str) -> str:
    return re.sub(r"[^A-Z0-9]", "", str(name).upper())


def column_catalog(spark: SparkSession, tables: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per column of the given tables: table_name, position, column_name, score, column_group, is_wide.

    The score orders a display, known names first. The group is the first whose parts occur in the name.
    """
    rows = [(t, i, c) for t, columns in tables.items() for i, c in enumerate(columns)]
    named = spark.createDataFrame(rows, "table_name STRING, position INT, column_name STRING")
    key = F.regexp_replace(F.upper("column_name"), "[^A-Z0-9]", "")

    def holds(parts: Sequence[str]) -> Column:
        return reduce(lambda x, y: x | y, [key.contains(p) for p in parts])

    def bonus(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    place = F.array_position(F.array(*map(F.lit, DISPLAY_FIRST)), key)
    score = (
        1000 - F.col("position")
        + F.when(place > 0, 8020 - 20 * place).otherwise(0)
        + bonus(key.rlike("(ID|NO|NB)$") | key.contains("KEY"), 400)
        + bonus(holds(["NAM", "DESC", "TEXT"]), 300)
        + bonus(holds(["STAT", "TYPE", "FLAG"]), 160)
    )
    group = F.coalesce(*[F.when(holds(parts), name) for name, parts in COLUMN_GROUPS], F.lit(OTHER_GROUP))
    return named.select("*", score.cast("int").alias("score"), group.alias("column_group"), holds(WIDE_NAME_PARTS).alias("is_wide"))


def display_order(spark: SparkSession, columns: Sequence[str]) -> list[str]:
    """Columns by display score; ties keep their schema order."""
    ranked = column_catalog(spark, {"": columns}).orderBy(F.col("score").desc(), "position")
    return [r.column_name for r in ranked.select("column_name").collect()]


def pinned_columns(columns: Sequence[str]) -> list[str]:
    return list(columns[:2])
