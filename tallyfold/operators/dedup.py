"""Keep-last per key (W2) and latest sample per report window (A6), in one pass each.

The last row of a key is the largest struct of (order, all other columns): one aggregate, in which every
task first keeps one row a key of its own, so a hot key is one row a task before any
shuffle, and no row is joined back. Ties are settled by the other columns, and a null order
comes before all others, so every key keeps exactly one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: Sequence[str], order: str | Sequence[str] = "seq") -> DataFrame:
    """The row with the highest ``order`` (one or more columns) per key; all columns kept, key columns first.

    Of rows with equal order the one with the larger other columns, compared in their order, is
    kept. Columns must have an order (no maps).
    """
    key, order = list(key), [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in key and c not in order]
    last = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in df.columns if c not in key])


def latest_sample(samples: DataFrame, window: str, ts: str = "ts", id_col: str = "id", order: str = "seq") -> DataFrame:
    """What a report carries: only the newest sample of the window, last row per id.

    Unlike latest-per-id, an id missing from the newest sample is not reported. The samples are read
    once: what remains is a row per window and id, and of these the window's newest.
    """
    last = keep_last(samples, [window, id_col], [ts, order])
    newest = last.groupBy(F.col(window).alias("_window")).agg(F.max(ts).alias("_newest"))
    on = F.col(window).eqNullSafe(F.col("_window")) & F.col(ts).eqNullSafe(F.col("_newest"))
    return last.join(newest, on, "left_semi")


def latest_wide_sample(samples: DataFrame, window: str, ts: str = "ts", order: str = "seq") -> DataFrame:
    """A6 where a row is a whole sample, with a column per metric: the newest row of each window, before any unpivot."""
    return keep_last(samples, [window], [ts, order])
