"""Text expressions: normalisation, blanks, JSON text, highlighting, CSV cells."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings of on and off, and messages that mean "the table is empty".
TRUE_WORDS = ["1", "true", "t", "yes", "on", "ativado", "sim", "s", "v"]
FALSE_WORDS = ["0", "false", "f", "no", "off", "desativado", "nao", "n"]
NO_DATA_PHRASES = [
    "has no data", "no data", "sem dados", "tabela vazia", "table empty", "no rows",
    "contains no records", "0 rows",
]


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Every precomposed character whose base is one letter, and that letter.

    Derived from the Unicode decomposition rule rather than listed. Hangul syllables have several
    base characters and stay composed.
    """
    accented, base = [], []
    for point in range(0xC0, min(0x10000, sys.maxunicode)):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        kept = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(kept) == 1 and kept[0] != char:
            accented.append(char)
            base.append(kept[0])
    return "".join(accented), "".join(base)


def strip_accents(value: Column) -> Column:
    accented, base = _folding()
    return F.regexp_replace(F.translate(value, accented, base), r"\p{Mn}+", "")


def normalize_text(value: Column) -> Column:
    """Accents removed, lower case, everything but letters and digits turned into single spaces.

    Plain ASCII text takes the short way.
    """
    text = F.coalesce(value.cast("string"), F.lit(""))
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    folded = F.regexp_replace(F.lower(strip_accents(text)), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(plain))


def normalize_query(text: str) -> str:
    """The same rule for the one query string on the driver."""
    decomposed = unicodedata.normalize("NFD", text)
    bare = "".join(c for c in decomposed if unicodedata.category(c) != "Mn").lower()
    bare = unicodedata.normalize("NFC", bare)
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in bare).split())


def strip(value: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def is_blank(value: Column, data_type: T.DataType | None = None) -> Column:
    """NULL, or a string of white space only."""
    if data_type is not None and not isinstance(data_type, T.StringType):
        return value.isNull()
    return value.isNull() | (strip(value.cast("string")) == "")


def first_non_blank(*values: Column) -> Column:
    """Text of the first value that is neither NULL nor white space, else ''."""
    texts = [v.cast("string") for v in values]
    kept = [F.when(strip(t) != "", t) for t in texts]
    return F.coalesce(*kept, F.lit(""))


def json_text(value: Column) -> Column:
    """One value as JSON text: NULL -> null, 'x' -> "x", 5 -> 5."""
    as_list = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return as_list.substr(F.lit(2), F.length(as_list) - 2)


def short_value(value: Column, limit: int = 80) -> Column:
    text = json_text(value)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def column_key(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))


def flag(value: Column) -> Column:
    """TRUE / FALSE for the accepted spellings, NULL for anything else."""
    word = F.lower(strip(value.cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def is_no_data_message(value: Column) -> Column:
    pattern = "|".join(re.escape(p) for p in NO_DATA_PHRASES)
    return F.coalesce(F.lower(value).rlike(pattern), F.lit(False))


def highlight(value: Column, tokens: Sequence[str], open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    """Wrap every occurrence of a token, longer tokens first, ignoring case."""
    words = sorted({t for t in tokens if t}, key=lambda t: (-len(t), t))
    text = F.coalesce(value.cast("string"), F.lit(""))
    if not words:
        return text
    pattern = "(?iu)(" + "|".join(re.escape(w) for w in words) + ")"
    return F.regexp_replace(text, pattern, f"{open_tag}$1{close_tag}")


def spreadsheet_safe(value: Column) -> Column:
    """Text that a spreadsheet will not run as a formula: a leading = + - @ gets an apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"(?U)^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def semicolon_cell(value: Column) -> Column:
    """Cell of a `;` file: formula-safe, quoted only when it has to be."""
    text = spreadsheet_safe(value)
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[";\\n\\r]'), doubled).otherwise(text)


def quoted_cell(value: Column) -> Column:
    """Cell that is always quoted."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
