"""Numeric column expressions: guarded parsing, finiteness, clipping, safe division."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip_ws

# A plain decimal or scientific literal. Spark's cast would also take "1d", "nan",
# "Infinity"; the guard refuses them, so they become missing as in a coercing parse.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                  T.DoubleType, T.DecimalType)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def finite(col) -> Column:
    """NaN and +/-inf -> NULL (the package never stores non-finite doubles).

    abs(x) < inf is false for NaN (NaN sorts above every number) and for +/-inf.
    """
    c = _c(col).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


# A cast to double takes exactly the plain literals among the texts of these characters
# (what is left out are letters as in "1d", "nan", "0x1p3", and signs that no number has).
# Trimming them leaves nothing of such a text, several times cheaper than a pattern.
_OF_NUMBERS = "0123456789eE+-. \t\n\x0b\f\r"


def scan_number(col) -> Column:
    """Text -> double, NULL when the text is not a plain number; an overflow gives an
    infinity. Put it in a projection of its own below ``finite``."""
    s = _c(col).cast("string")
    return F.when(F.btrim(s, F.lit(_OF_NUMBERS)) == "", s.try_cast("double"))


def parse_number(col) -> Column:
    """Text -> double, NULL when the text is not a plain number or overflows."""
    return finite(scan_number(col))


def to_number(col, dtype: T.DataType) -> Column:
    """Coerce a column of known Spark type to a finite double."""
    if isinstance(dtype, T.StringType):
        return parse_number(col)
    if isinstance(dtype, _NUMERIC_TYPES):
        return finite(_c(col))
    if isinstance(dtype, T.BooleanType):
        return _c(col).cast("double")
    return parse_number(_c(col).cast("string"))


def num(df: DataFrame, name: str) -> Column:
    """Numeric read that tolerates an absent column (typed NULL)."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    return to_number(F.col("`" + name.replace("`", "``") + "`"), df.schema[name].dataType)


def clip0(col) -> Column:
    """Clip below at 0 while keeping NULL (``greatest`` would turn NULL into 0)."""
    c = _c(col)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def safe_div(a, b) -> Column:
    """Division that yields NULL instead of an error or inf."""
    return finite(F.try_divide(_c(a), _c(b)))


def parse_user_number(col) -> tuple[Column, Column]:
    """Form parsing: strip, drop thousands commas, blank -> NULL.

    Returns ``(value, invalid)``: invalid is true for text that is neither blank
    nor a number; the value is NULL then.
    """
    s = F.regexp_replace(strip_ws(_c(col).cast("string")), ",", "")
    blank = s.isNull() | (s == "")
    value = F.when(~blank & s.rlike(NUMBER_PATTERN), s.try_cast("double"))
    value = finite(value)
    invalid = ~blank & value.isNull()
    return value, invalid


def clamp0(col) -> Column:
    """max(x, 0) for reporting; NULL stays NULL."""
    return clip0(col)


def format_g(col, digits: int = 4) -> Column:
    """Python-style ``{:,.<digits>g}`` text of a double, "Not specified" when missing.

    Java's %g keeps trailing zeros and never switches to plain notation the way
    Python's general format does, so the two cases are built explicitly.
    """
    x = _c(col).cast("double")
    ax = F.abs(x)
    exp10 = F.floor(F.log10(ax))
    # exponent after rounding to `digits` significant digits (9.9996 -> 10.00)
    # half-to-even like Python's formatting
    rounded = F.bround(ax / F.pow(F.lit(10.0), exp10), digits - 1)
    exp_adj = F.when(rounded >= 10, exp10 + 1).otherwise(exp10)
    sci = (exp_adj < -4) | (exp_adj >= digits)
    # plain notation only for exponents -4 .. digits-1, so decimals is 0 .. digits+3
    decimals = F.greatest(F.lit(0), F.lit(digits - 1) - exp_adj).cast("int")
    plain = F.lit(None).cast("string")
    for d in range(digits + 4, -1, -1):
        plain = F.when(decimals == d, F.format_number(x, d)).otherwise(plain)  # with separators
    plain = F.regexp_replace(plain, r"(\.\d*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", "")
    mant = F.bround(x / F.pow(F.lit(10.0), exp_adj), digits - 1)
    mant_txt = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits - 1}f", mant),
                                                 r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exp_txt = F.concat(F.when(exp_adj < 0, F.lit("e-")).otherwise(F.lit("e+")),
                       F.lpad(F.abs(exp_adj).cast("int").cast("string"), 2, "0"))
    text = F.when(x == 0, F.lit("0")).when(sci, F.concat(mant_txt, exp_txt)).otherwise(plain)
    return F.when(x.isNull() | F.isnan(x), F.lit("Not specified")).otherwise(text)
