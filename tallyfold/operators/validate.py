"""Record validation (P3, P4, P6), all-or-nothing batches (P5) and outcomes.

Validation is one ``CASE`` chain: the first failing rule names the error, NULL
means valid. Batch rejection never collects a batch: the bad batch ids come from a
partial/final aggregate and are removed with a ``left_anti`` join (AQE turns it
into a broadcast when the runtime size of the bad-id side allows, and splits a
skewed batch otherwise).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.model import (
    DEFAULT_RULES,
    ERR_BAD_JSON,
    ERR_BAD_VALUE,
    ERR_EMPTY_ID,
    ERR_EMPTY_TYPE,
    ERR_INVALID_TYPE,
    ERR_NO_VALUE,
    ERR_NON_FINITE,
    ERR_NOT_FOUND,
    METRIC_TYPES,
    RULE_ID,
    RULE_TYPE,
    RULE_VALUE,
)


def _checks(rule: str, m) -> list[tuple[Column, str]]:
    id_, type_ = m("id"), m("type")
    if rule == RULE_ID:
        return [(id_.isNull() | (id_ == ""), ERR_EMPTY_ID)]
    if rule == RULE_TYPE:
        return [
            (type_.isNull() | (type_ == ""), ERR_EMPTY_TYPE),
            (~type_.isin(*METRIC_TYPES), ERR_INVALID_TYPE),
        ]
    if rule == RULE_VALUE:
        return [(m("value").isNull() & m("delta").isNull(), ERR_NO_VALUE)]
    raise ValueError(f"unknown field for validation: {rule!r}")


def validation_error(rules: Sequence[str] = DEFAULT_RULES, metric: Column | None = None) -> Column:
    """First failing rule, checked in the given order; NULL when valid.

    Checks the row's ``id, type, delta, value`` columns, or the fields of the
    struct ``metric`` (e.g. an array element inside ``transform``). An unknown
    rule name raises on the driver before any job runs.
    """
    m = F.col if metric is None else (lambda name: metric[name])
    checks = [c for rule in (rules or DEFAULT_RULES) for c in _checks(rule, m)]
    expr = None
    for cond, message in checks:
        expr = F.when(cond, F.lit(message)) if expr is None else expr.when(cond, F.lit(message))
    return expr


def validate(df: DataFrame, rules: Sequence[str] = DEFAULT_RULES) -> DataFrame:
    """Add an ``error`` column (NULL for valid rows)."""
    return df.withColumn("error", validation_error(rules))


def type_gate(df: DataFrame) -> DataFrame:
    """Only counter and gauge rows reach a fold."""
    return df.filter(F.col("type").isin(*METRIC_TYPES))


def bad_batches(validated: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Distinct ids of batches holding at least one invalid row."""
    return validated.filter(F.col("error").isNotNull()).select(batch).distinct()


def accept_batches(validated: DataFrame, batch: str = "batch_id") -> DataFrame:
    """P5: keep only rows of batches without any invalid row (the ``error`` column is dropped).

    Rows without a batch id are one batch of their own.
    """
    bad = bad_batches(validated, batch).select(F.col(batch).alias("_bad_batch"))
    return validated.join(bad, F.col(batch).eqNullSafe(F.col("_bad_batch")), "left_anti").drop("error")


def first_errors(validated: DataFrame, batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """P5 report: per rejected batch, the first error by position and the number of bad rows."""
    return (
        validated.filter(F.col("error").isNotNull())
        .groupBy(batch)
        .agg(
            F.min(pos).alias("first_pos"),
            F.min_by("error", pos).alias("error"),
            F.count(F.lit(1)).alias("n_bad"),
        )
    )


# Request kinds of P7.
BATCH_UPDATE = "batch_update"
JSON_UPDATE = "json_update"
PATH_UPDATE = "path_update"
JSON_LOOKUP = "json_lookup"
VALUE_LOOKUP = "value_lookup"
REQUEST_KINDS = (BATCH_UPDATE, JSON_UPDATE, PATH_UPDATE, JSON_LOOKUP, VALUE_LOOKUP)

# HTTP status per request kind and error (table 2.2.1 of the survey).
# The two 200 answers of the reference for unexpected lookup errors are defects; 500 here.
_STATUS = {
    BATCH_UPDATE: {ERR_EMPTY_ID: 400, ERR_EMPTY_TYPE: 400, ERR_INVALID_TYPE: 400, ERR_NO_VALUE: 400,
                   ERR_BAD_JSON: 400, ERR_BAD_VALUE: 400, ERR_NON_FINITE: 400},
    JSON_UPDATE: {ERR_EMPTY_ID: 400, ERR_EMPTY_TYPE: 400, ERR_INVALID_TYPE: 400, ERR_NO_VALUE: 400,
                  ERR_BAD_JSON: 400, ERR_BAD_VALUE: 400, ERR_NON_FINITE: 400},
    PATH_UPDATE: {ERR_EMPTY_ID: 404, ERR_EMPTY_TYPE: 400, ERR_INVALID_TYPE: 400, ERR_NO_VALUE: 400,
                  ERR_BAD_VALUE: 400, ERR_NON_FINITE: 400, ERR_NOT_FOUND: 404},
    JSON_LOOKUP: {ERR_EMPTY_ID: 404, ERR_EMPTY_TYPE: 404, ERR_INVALID_TYPE: 404, ERR_BAD_JSON: 400,
                  ERR_NOT_FOUND: 404},
    VALUE_LOOKUP: {ERR_EMPTY_ID: 404, ERR_EMPTY_TYPE: 400, ERR_INVALID_TYPE: 400, ERR_NOT_FOUND: 404},
}


def status_code(kind: str, error: str | Column = "error") -> Column:
    """HTTP-style outcome of a request row: 200 when ``error`` is NULL, else by table."""
    if kind not in _STATUS:
        raise ValueError(f"unknown request kind {kind!r}")
    err = F.col(error) if isinstance(error, str) else error
    expr = F.when(err.isNull(), F.lit(200))
    for message, code in _STATUS[kind].items():
        expr = expr.when(err == message, F.lit(code))
    return expr.otherwise(F.lit(500))
