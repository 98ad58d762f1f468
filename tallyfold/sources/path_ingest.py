"""Path-form updates ``/update/{type}/{id}/{value}`` -> typed metric rows (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.parse import parse_float, parse_int
from tallyfold.model import COUNTER, ERR_BAD_VALUE, ERR_NON_FINITE, ERR_NOT_FOUND, GAUGE, RULE_ID, RULE_TYPE
from tallyfold.operators.validate import PATH_UPDATE, status_code, validation_error

ROUTE_SEGMENT = "update"
VALUE_ROUTE_SEGMENT = "value"


def ingest_paths(requests: DataFrame, path: str = "path") -> DataFrame:
    """Parse each request path; add ``id, type, delta, value, error, status``.

    A path with another shape than ``/update/a/b/c`` is not routed (404). Then the
    key rules (id before type), then the value text: an empty or malformed text,
    or a non-finite gauge (JSON cannot carry it later), is rejected (400).
    """
    parts = F.split(F.col(path), "/", -1)
    routed = (F.size(parts) == 5) & (F.element_at(parts, 1) == "") & (F.element_at(parts, 2) == ROUTE_SEGMENT)
    typed = requests.select(
        "*",
        routed.alias("_routed"),
        F.when(routed, F.element_at(parts, 3)).alias("type"),
        F.when(routed, F.element_at(parts, 4)).alias("id"),
        F.when(routed, F.element_at(parts, 5)).alias("_text"),
    )
    delta = F.when(F.col("type") == COUNTER, parse_int("_text"))
    value = F.when(F.col("type") == GAUGE, parse_float("_text"))
    typed = typed.withColumn("delta", delta).withColumn("value", value)
    finite = ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    error = (
        F.when(~F.col("_routed"), F.lit(ERR_NOT_FOUND))
        .otherwise(
            F.coalesce(
                validation_error([RULE_ID, RULE_TYPE]),
                F.when(F.col("delta").isNull() & F.col("value").isNull(), F.lit(ERR_BAD_VALUE)),
                F.when(F.col("value").isNotNull() & ~finite, F.lit(ERR_NON_FINITE)),
            )
        )
    )
    out = typed.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.select(
        *requests.columns,
        "id",
        "type",
        F.when(ok, F.col("delta")).alias("delta"),
        F.when(ok, F.col("value")).alias("value"),
        "error",
        status_code(PATH_UPDATE, "error").alias("status"),
    )


def lookup_paths(requests: DataFrame, path: str = "path") -> DataFrame:
    """P2 requests ``/value/{type}/{id}`` -> ``id, type`` and ``error`` (not routed: not found).

    Feed the result to ``lookup.value_lookup``, which adds the key rules, the
    text and the status.
    """
    parts = F.split(F.col(path), "/", -1)
    routed = (F.size(parts) == 4) & (F.element_at(parts, 1) == "") & (F.element_at(parts, 2) == VALUE_ROUTE_SEGMENT)
    return requests.select(
        "*",
        F.when(routed, F.element_at(parts, 4)).alias("id"),
        F.when(routed, F.element_at(parts, 3)).alias("type"),
        F.when(~routed, F.lit(ERR_NOT_FOUND)).alias("error"),
    )
