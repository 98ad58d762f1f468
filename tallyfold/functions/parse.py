"""Text -> number with the strictness of the reference's parsers (F1, F2).

A bare Spark cast is too lenient: it trims blanks (``' 1'``), accepts Java
suffixes (``'1d'``, ``'1f'``) and turns ``'1e400'`` into infinity. Each parser is
therefore a regex guard plus ``try_cast``, all JVM-side expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings.
INT_PATTERN = r"^[+-]?[0-9]+$"
DECIMAL_FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
HEX_FLOAT_PATTERN = r"^[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+$"
POS_INF_SPELLINGS = ("inf", "+inf", "infinity", "+infinity")
NEG_INF_SPELLINGS = ("-inf", "-infinity")
NAN_SPELLING = "nan"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_int(text: str | Column) -> Column:
    """base-10 int64; NULL when malformed or out of range."""
    t = _c(text)
    return F.when(t.rlike(INT_PATTERN), t.try_cast("bigint"))


def parse_float(text: str | Column) -> Column:
    """float64; NULL when malformed or when a finite literal overflows.

    Decimal and hexadecimal (with ``p`` exponent) literals are accepted, and the
    spellings Inf / Infinity (optional sign) and NaN in any case.
    """
    t = _c(text)
    low = F.lower(t)
    parsed = t.try_cast("double")
    finite_literal = t.rlike(DECIMAL_FLOAT_PATTERN) | t.rlike(HEX_FLOAT_PATTERN)
    return (
        F.when(low.isin(*POS_INF_SPELLINGS), F.lit(float("inf")))
        .when(low.isin(*NEG_INF_SPELLINGS), F.lit(float("-inf")))
        .when(low == NAN_SPELLING, F.lit(float("nan")))
        .when(finite_literal & ~F.isnan(parsed) & (F.abs(parsed) != F.lit(float("inf"))), parsed)
    )
