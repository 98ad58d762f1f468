"""Report windows (T2), polls per report (A5), listing (S13), count (A4) and
path-form export (S14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import format_float, format_int, value_text
from tallyfold.model import COUNTER, GAUGE, KEY, POLL_COUNT_ID
from tallyfold.operators.fold import last_by_seq, null_propagating_sum

# Listing line and export errors.
LISTING_FORMAT = "ID: %s Type: %s Value: %s"
ERR_EXPORT_NO_DELTA = "no metric's data has been passed: field Delta is nil"
ERR_EXPORT_NO_VALUE = "no metric's data has been passed: field Value in nil"
ERR_EXPORT_TYPE = "error occurred during route construction"
DEFAULT_ROUTE = "/update"
WINDOW_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def window_start(ts: str | Column, every: str) -> Column:
    """Start of the tumbling report window of ``ts`` (a timestamp, epoch aligned)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.window(t, every).start


def window_text(col: str | Column = "window_start") -> Column:
    """A window start as ``yyyy-MM-dd HH:mm:ss`` text; applied last, on few rows."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, WINDOW_TEXT_FORMAT)


def with_report_window(df: DataFrame, every: str, ts: str = "ts", name: str = "window_start") -> DataFrame:
    return df.withColumn(name, window_start(ts, every))


def report_fold(samples: DataFrame, every: str, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """T2 + A5: per report window and metric, the number of polls and the folded metric."""
    w = with_report_window(samples, every, ts)
    folded = w.groupBy("window_start", *KEY).agg(
        F.count(F.lit(1)).alias("polls"),
        null_propagating_sum("delta").alias("delta"),
        last_by_seq("value", seq).alias("value"),
    )
    return folded.withColumn("window_start", window_text())


def poll_counts(samples: DataFrame, every: str, ts: str = "ts") -> DataFrame:
    """A5: one ``PollCount`` counter per report window: the number of samples in it."""
    w = with_report_window(samples, every, ts)
    return w.groupBy("window_start").agg(F.countDistinct(ts).alias("delta")).select(
        window_text().alias("window_start"),
        F.lit(POLL_COUNT_ID).alias("id"),
        F.lit(COUNTER).alias("type"),
        "delta",
    )


def listing(state: DataFrame) -> DataFrame:
    """One ``ID: .. Type: .. Value: ..`` line per metric (unordered)."""
    return state.select("id", "type", F.format_string(LISTING_FORMAT, "id", "type", value_text()).alias("line"))


def metric_count(state: DataFrame) -> DataFrame:
    """A4: number of metrics in the state."""
    return state.agg(F.count(F.lit(1)).alias("total"))


def export_path(route: str = DEFAULT_ROUTE) -> tuple[Column, Column]:
    """``{route}/{type}/{id}/{value}`` and the error when it cannot be built.

    Returns ``(path, error)``; ``path`` is NULL exactly when ``error`` is set.
    """
    t, d, v = F.col("type"), F.col("delta"), F.col("value")
    error = (
        F.when((t == COUNTER) & d.isNull(), F.lit(ERR_EXPORT_NO_DELTA))
        .when((t == GAUGE) & v.isNull(), F.lit(ERR_EXPORT_NO_VALUE))
        .when(~t.isin(COUNTER, GAUGE) | t.isNull(), F.lit(ERR_EXPORT_TYPE))
    )
    text = F.when(t == COUNTER, format_int(d)).otherwise(format_float(v))
    path = F.when(error.isNull(), F.concat_ws("/", F.lit(route), t, F.col("id"), text))
    return path, error
