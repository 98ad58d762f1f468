"""Samples -> metric rows: wide rows to long metrics (S10), indexed arrays to
numbered gauges (S11).

Both are narrow transformations (``unpivot`` is one Expand, ``posexplode`` one
Generate): no shuffle, one scan of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.model import COUNTER, CPU_METRIC_PREFIX, GAUGE


def wide_to_long(
    samples: DataFrame,
    ids: Sequence[str],
    gauges: Sequence[str],
    counters: Sequence[str] = (),
) -> DataFrame:
    """One metric row per sample column: gauges carry ``value`` (as double),
    counters ``delta`` (as bigint). The metric id is the column name."""
    ids = list(ids)
    metric_cols = list(gauges) + list(counters)

    def as_metric(c: str, kind: str):
        d = F.col(c).cast("bigint") if kind == COUNTER else F.lit(None).cast("bigint")
        v = F.col(c).cast("double") if kind == GAUGE else F.lit(None).cast("double")
        return F.struct(F.lit(kind).alias("type"), d.alias("delta"), v.alias("value")).alias(c)

    wide = samples.select(
        *ids, *[as_metric(c, GAUGE) for c in gauges], *[as_metric(c, COUNTER) for c in counters]
    )
    long = wide.unpivot(ids, metric_cols, "id", "_m")
    return long.select(*ids, "id", "_m.type", "_m.delta", "_m.value")


def indexed_gauges(samples: DataFrame, ids: Sequence[str], array_col: str, prefix: str = CPU_METRIC_PREFIX) -> DataFrame:
    """Array element ``i`` -> gauge ``{prefix}{i}`` (0-based)."""
    ids = list(ids)
    exploded = samples.select(*ids, F.posexplode(array_col).alias("_pos", "_v"))
    return exploded.select(
        *ids,
        F.concat(F.lit(prefix), F.col("_pos").cast("string")).alias("id"),
        F.lit(GAUGE).alias("type"),
        F.col("_v").cast("double").alias("value"),
    )
