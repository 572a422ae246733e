"""Dates hidden in names. Impossible dates (month 13, 31 November) are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where day, month and year stand in a name.
LOOSE_YMD = r"(\d{4})[-_]? ?(\d{2})[-_]? ?(\d{2})"
ISO_PREFIX = r"^(\d{4})-(\d{2})-(\d{2})"
SEPARATED = [(r"(\d{2})[_-](\d{2})[_-](\d{4})", "dmy"), (r"(\d{4})[_-](\d{2})[_-](\d{2})", "ymd")]
COMPACT = [(r"(\d{2})(\d{2})(\d{4})", "dmy"), (r"(\d{4})(\d{2})(\d{2})", "ymd")]
STRICT_SEPARATED = [
    (r"(\d{2})_(\d{2})_(\d{4})", "dmy"), (r"(\d{4})_(\d{2})_(\d{2})", "ymd"),
    (r"(\d{2})-(\d{2})-(\d{4})", "dmy"), (r"(\d{4})-(\d{2})-(\d{2})", "ymd"),
]
PLAUSIBLE_YEARS = (1900, 2100)


def _date(text: Column, pattern: str, order: str = "ymd") -> Column:
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    iso = F.concat_ws("-", *(parts if order == "ymd" else parts[::-1]))
    return F.try_to_date(F.when(parts[0] != "", iso), "yyyy-MM-dd")


def date_in_name(name: Column, rule: str = "loose") -> Column:
    """Date of a file or folder name.

    loose      year, month, day with or without separators, anywhere
    prefix     ISO date at the start
    any        day or year first; separated forms win over compact ones, plausible years over others
    separated  day or year first, with `_` or `-` throughout
    """
    if rule == "loose":
        return _date(name, LOOSE_YMD)
    if rule == "prefix":
        return _date(F.trim(name), ISO_PREFIX)
    if rule == "separated":
        return F.coalesce(*[_date(name, p, o) for p, o in STRICT_SEPARATED])
    if rule == "any":
        compact = [_date(name, p, o) for p, o in COMPACT]
        plausible = [F.when(F.year(d).between(*PLAUSIBLE_YEARS), d) for d in compact]
        return F.coalesce(*[_date(name, p, o) for p, o in SEPARATED], *plausible, *compact)
    raise ValueError(f"unknown date rule: {rule}")
