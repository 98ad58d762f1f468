"""Metric data model: one shared schema and the fixed values of the domain.

A metric row is ``(id, type, delta, value)``: ``delta`` is a 64-bit integer for
counters, ``value`` a 64-bit float for gauges. Both are nullable and null is kept
distinct from zero everywhere (never ``coalesce(x, 0)`` a metric field).

Order is never implicit in Spark, so every update carries ``seq`` (BIGINT, unique,
rising in apply order). State is keyed by ``(id, type)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for matching results)
# ---------------------------------------------------------------------------
COUNTER = "counter"
GAUGE = "gauge"
METRIC_TYPES = (COUNTER, GAUGE)

# Validation errors, in the order the rules are checked.
ERR_EMPTY_ID = "metric name (id) is empty"
ERR_EMPTY_TYPE = "metric type is empty"
ERR_INVALID_TYPE = "metric type is not valid"
ERR_NO_VALUE = "metric has no value"
# Rule names accepted by the field-subset validator; "value" covers value and delta.
RULE_ID = "id"
RULE_TYPE = "type"
RULE_VALUE = "value"
DEFAULT_RULES = (RULE_ID, RULE_TYPE, RULE_VALUE)

# Errors raised by ingest/lookup steps (ours; the reference uses Go errors here).
ERR_BAD_VALUE = "metric value is not parseable"
ERR_NOT_FOUND = "metric is not found"
ERR_BAD_JSON = "invalid JSON was passed"
ERR_NON_FINITE = "metric value is not finite"

# Prefix of per-CPU gauges produced from an indexed array sample.
CPU_METRIC_PREFIX = "CPUutilization"
# Counter that reports the number of polls in a report interval.
POLL_COUNT_ID = "PollCount"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
KEY = ["id", "type"]

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("type", T.StringType(), True),
        T.StructField("delta", T.LongType(), True),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("hash", T.StringType(), True),
    ]
)
METRIC_STRUCT_DDL = "STRUCT<id: STRING, type: STRING, delta: BIGINT, value: DOUBLE, hash: STRING>"
METRIC_ARRAY_DDL = f"ARRAY<{METRIC_STRUCT_DDL}>"

STATE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("type", T.StringType(), True),
        T.StructField("delta", T.LongType(), True),
        T.StructField("value", T.DoubleType(), True),
    ]
)
STATE_COLUMNS = ["id", "type", "delta", "value"]
UPDATE_COLUMNS = ["seq", "id", "type", "delta", "value"]
