"""Metric folds: counter accumulate (A1), gauge last-write-wins (A2), batch fold (A3),
upsert merge of state and updates (J1) and the type-conflict report (A7).

All folds are plain ``groupBy().agg()`` over fixed-width buffers (sum, count,
max_by(double, bigint)), so Spark runs them as partial + final HashAggregate: a hot
metric id is combined map-side and never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.model import COUNTER, GAUGE, KEY


OVERFLOW_FINAL = "final"
OVERFLOW_WRAP = "wrap"
_TWO_63 = 2**63


def exact_sum(col: str | Column) -> Column:
    """Sum of int64 values in ``decimal(38,0)``: the same whatever the order of partial sums."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast("decimal(20,0)"))


def null_propagating_sum(col: str | Column, overflow: str = OVERFLOW_FINAL) -> Column:
    """A1: sum that is NULL as soon as one input is NULL (SQL ``a + NULL`` rule).

    ``sum`` skips nulls, so compare the non-null count with the row count. The sum is
    exact, so partitioning and the order of partial sums never matter.
    ``overflow``:

    * ``final`` (default, and the rule of every fold here): raises only when the
      total does not fit in int64;
    * ``wrap``: the total modulo 2**64 as a signed int64 (in-memory Go counters).
    """
    c = F.col(col) if isinstance(col, str) else col
    no_null = F.count(c) == F.count(F.lit(1))
    exact = exact_sum(c).cast("decimal(38,0)")
    if overflow == OVERFLOW_FINAL:
        return F.when(no_null, exact.cast("bigint"))
    if overflow == OVERFLOW_WRAP:
        two63 = F.lit(str(_TWO_63)).cast("decimal(38,0)")
        wrapped = F.pmod(exact + two63, two63 * 2) - two63
        return F.when(no_null, wrapped.cast("bigint"))
    raise ValueError(f"unknown overflow mode {overflow!r}")


def last_by_seq(col: str, seq: str = "seq") -> Column:
    """A2: value of the row with the highest ``seq``; a NULL there is the result."""
    return F.max_by(F.col(col), F.col(seq))


def fold_updates(
    updates: DataFrame, key: Sequence[str] = KEY, seq: str = "seq", overflow: str = OVERFLOW_FINAL
) -> DataFrame:
    """A3: fold an ordered, mixed batch of updates into one row per key.

    Both value columns fold whatever the type (database rule): ``delta`` by
    null-propagating sum, ``value`` by last write. ``seq`` is the last applied
    update, kept so that a later merge does not depend on batch arrival order.
    """
    return updates.groupBy(*key).agg(
        null_propagating_sum("delta", overflow).alias("delta"),
        last_by_seq("value", seq).alias("value"),
        F.max(seq).alias("seq"),
    )


def merge_folded(state: DataFrame, folded: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Upsert already-folded updates into state (both one row per key).

    Key in both: ``delta = s.delta + u.delta`` (NULL-propagating), ``value`` of the
    later write (the update's, unless the state carries a higher ``seq``). Key on
    one side: that side's row. Side presence uses a marker column, never
    ``value IS NULL`` (a NULL value is a legal last write). A state without a
    ``seq`` column (e.g. a restored snapshot) counts as older than any update.
    """
    key = list(key)
    s_seq = F.col("seq") if "seq" in state.columns else F.lit(None).cast("bigint")
    s = state.select(
        *key,
        F.col("delta").alias("_s_delta"),
        F.col("value").alias("_s_value"),
        s_seq.alias("_s_seq"),
        F.lit(True).alias("_s_in"),
    )
    u = folded.select(
        *key,
        F.col("delta").alias("_u_delta"),
        F.col("value").alias("_u_value"),
        F.col("seq").alias("_u_seq"),
        F.lit(True).alias("_u_in"),
    )
    j = s.join(u, key, "full_outer")
    s_in = F.coalesce(F.col("_s_in"), F.lit(False))
    u_in = F.coalesce(F.col("_u_in"), F.lit(False))
    return j.select(
        *key,
        *_merge_rows(F.col("_s_delta"), F.col("_s_value"), F.col("_s_seq"),
                     F.col("_u_delta"), F.col("_u_value"), F.col("_u_seq"), s_in, u_in),
    )


# Order given to a state row without ``seq`` (e.g. a restored snapshot): oldest.
SEQ_UNKNOWN = -(1 << 63)


def fold_states(rows: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """J1 as one aggregate: fold rows that are themselves folds (a state and any
    number of later folded batches). Because the fold is associative (sum with
    NULL propagation, last write by ``seq``), this equals merging them one after
    the other with ``merge_folded``; it needs no join and is combined map-side.
    A row without ``seq`` counts as older than every row that has one.
    """
    order = F.coalesce(F.col("seq"), F.lit(SEQ_UNKNOWN))
    return rows.groupBy(*key).agg(
        null_propagating_sum("delta").alias("delta"),
        F.max_by(F.col("value"), order).alias("value"),
        F.max("seq").alias("seq"),
    )


def _merge_rows(s_delta, s_value, s_seq, u_delta, u_value, u_seq, s_in, u_in) -> list[Column]:
    u_later = u_in & (~s_in | s_seq.isNull() | (u_seq > s_seq))
    return [
        F.when(s_in & u_in, (s_delta.cast("decimal(20,0)") + u_delta.cast("decimal(20,0)")).cast("bigint")).when(u_in, u_delta).otherwise(s_delta).alias("delta"),
        F.when(u_later, u_value).otherwise(s_value).alias("value"),
        F.when(u_later, u_seq).otherwise(s_seq).alias("seq"),
    ]


def upsert(state: DataFrame, updates: DataFrame, key: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """Pre-aggregate the updates (map-side combined), then one full outer join.

    Both sides leave their aggregates partitioned by the key, so the join adds no
    exchange; there is one plan, whatever the sizes.
    """
    return merge_folded(state, fold_updates(updates, key, seq), key)


def type_conflicts(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Ids written with both types, and the type of the first write.

    The in-memory store keys by id only, so there the first writer fixes the
    type; the database keeps two rows. Fixed-width aggregates only.
    """
    is_c = F.col("type") == COUNTER
    is_g = F.col("type") == GAUGE
    agg = updates.groupBy("id").agg(
        F.count(F.when(is_c, 1)).alias("n_counter"),
        F.count(F.when(is_g, 1)).alias("n_gauge"),
        F.min(F.when(is_c, F.col(seq))).alias("_first_c"),
        F.min(F.when(is_g, F.col(seq))).alias("_first_g"),
    )
    return agg.filter((F.col("n_counter") > 0) & (F.col("n_gauge") > 0)).select(
        "id",
        F.when(F.col("_first_c") < F.col("_first_g"), F.lit(COUNTER)).otherwise(F.lit(GAUGE)).alias("first_type"),
        "n_counter",
        "n_gauge",
    )


def fold_by_id(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """A7 as a state: the in-memory store, keyed by id alone (``id, type, delta, value, seq``).

    The first write makes the metric as it is and fixes its type. A later counter adds its delta, a
    later gauge replaces the value, whatever the type of the metric. Where the in-memory
    store fails (a counter without a delta, or one onto a metric without) the update
    changes nothing. Fixed-width aggregates only, so one hash aggregate a side of the exchange.
    Updates of an id have different ``seq``.
    """
    is_c, is_g = F.col("type") == COUNTER, F.col("type") == GAUGE
    agg = updates.filter(is_c | is_g).groupBy("id").agg(
        F.min_by(is_c, F.col(seq)).alias("_counter"),
        F.min_by("delta", seq).alias("_delta"),
        F.min_by("value", seq).alias("_value"),
        exact_sum(F.when(is_c, F.col("delta"))).alias("_sum"),
        F.count(F.when(is_g, 1)).alias("_gauges"),
        F.max_by(F.when(is_g, F.col("value")), F.when(is_g, F.col(seq))).alias("_last"),
        F.max(seq).alias("seq"),
    )
    wide = "decimal(38,0)"
    # The first write is in the sum already if it is a counter.
    first = F.when(F.col("_counter"), F.lit(0)).otherwise(F.col("_delta")).cast(wide)
    total = F.coalesce(F.col("_sum").cast(wide), F.lit(0).cast(wide)) + first
    return agg.select(
        "id",
        F.when(F.col("_counter"), F.lit(COUNTER)).otherwise(F.lit(GAUGE)).alias("type"),
        F.when(F.col("_delta").isNotNull(), total.cast(wide).cast("bigint")).alias("delta"),
        F.when(F.col("_gauges") > 0, F.col("_last")).otherwise(F.col("_value")).alias("value"),
        "seq",
    )


def duplicate_keys(state: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Key uniqueness is a check, not a Spark constraint: the keys that occur
    more than once, with their row count (empty for a valid state)."""
    return state.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
