"""Text column expressions: missing tokens, whitespace cleaning, match keys.

All are JVM-side ``Column -> Column`` builders, so they stay inside codegen.
"""
from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens that count as "no value" after strip + case-fold.
MISSING_TOKENS = ["", "nan", "none", "null", "na", "n/a", "missing", "not specified", "-"]

# Whitespace as Python's str.strip() sees it: every code point whose isspace() is
# true (derived by rule, 29 characters). Stripping uses Spark's non-regex btrim.
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
# runs of whitespace inside the text (Unicode-aware class)
_RUN_WS = r"(?U)\s+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Remove leading and trailing whitespace like Python's ``str.strip()``
    (Spark's one-argument ``trim`` only drops spaces)."""
    return F.btrim(_c(col).cast("string"), F.lit(WHITESPACE))


@lru_cache(maxsize=1)
def _folds() -> str:
    """Characters whose case folding is not their lower case, as one JSON map (by rule)."""
    return json.dumps({c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c.lower()})


def casefold(col) -> Column:
    """Full Unicode case folding, as Python's ``casefold``. ASCII texts are only lowered;
    others are folded character by character (so a final sigma is a sigma)."""
    c = _c(col)
    table = F.from_json(F.lit(_folds()), "map<string,string>")  # a constant: parsed once
    folded = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), F.lower(x))), "")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(folded)


def is_missing(col) -> Column:
    """True when the value is NULL or one of the missing tokens (never NULL itself)."""
    c = _c(col)
    return F.coalesce(c.isNull() | casefold(strip_ws(c)).isin(MISSING_TOKENS), F.lit(True))


def is_missing_any(col, dtype: str) -> Column:
    """Missing test for a column of any type: numbers are missing when NULL or NaN."""
    c = _c(col)
    if dtype in ("double", "float"):
        return c.isNull() | F.isnan(c)
    if dtype == "string":
        return is_missing(c)
    return c.isNull()


def clean_stripped(stripped: Column) -> Column:
    """``clean_text`` of a text that is stripped already."""
    return F.when(~F.coalesce(casefold(stripped).isin(MISSING_TOKENS), F.lit(True)), F.regexp_replace(stripped, _RUN_WS, " "))


def key_of_clean(cleaned: Column) -> Column:
    """``match_key`` of a cleaned text."""
    return F.regexp_replace(casefold(cleaned), "[^a-z0-9]+", "")


def clean_text(col) -> Column:
    """Missing -> NULL, otherwise strip and collapse inner whitespace runs to one space."""
    c = _c(col)
    return F.when(~is_missing(c), F.regexp_replace(strip_ws(c), _RUN_WS, " "))


def match_key(col) -> Column:
    """Dictionary key: case-folded, stripped, every character outside a-z0-9 removed."""
    return F.regexp_replace(casefold(strip_ws(_c(col))), "[^a-z0-9]+", "")


def blank_to_null(col) -> Column:
    """Strip; an empty result becomes NULL (form fields)."""
    s = strip_ws(_c(col))
    return F.when(s != "", s)


def contains_folded(col, needle: str) -> Column:
    """Not missing and containing ``needle`` after case-folding; never NULL."""
    c = _c(col)
    return F.coalesce(~is_missing(c) & casefold(strip_ws(c)).contains(needle.lower()), F.lit(False))
