"""Database error classification as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SQLSTATEs worth a retry (connection loss, transaction rollback,
# serialization failure, deadlock, cannot connect now). Everything else, unknown
# codes and NULL included, is not retried.
RETRYABLE_SQLSTATES = ("08000", "08003", "08006", "40000", "40001", "40P01", "57P03")
RETRYABLE = "retryable"
NON_RETRYABLE = "non_retryable"


def classify_sqlstate(sqlstate: str | Column) -> Column:
    """``retryable`` or ``non_retryable`` (the default)."""
    s = F.col(sqlstate) if isinstance(sqlstate, str) else sqlstate
    return F.when(s.isin(*RETRYABLE_SQLSTATES), F.lit(RETRYABLE)).otherwise(F.lit(NON_RETRYABLE))
