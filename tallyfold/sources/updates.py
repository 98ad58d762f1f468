"""Metric updates derived from the driver's ``events`` table.

Every fixture here is a projection of ``events`` (no made-up rows), so its size
grows with the table. Rules are those of FIXTURES.md section 3 and are mirrored
one to one by the DuckDB oracle in ``tallyfold.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.sign import hmac_sha256_hex
from tallyfold.model import COUNTER, GAUGE

# ---------------------------------------------------------------------------
# Fixed values of the derived fixtures
# ---------------------------------------------------------------------------
COUNTER_EVENT_TYPES = ("click", "view", "signup")
BATCH_SIZE = 100
# Path-form value texts, cycled by seq (F1/F2 edge cases).
PATH_TEXTS = (
    "5", "+5", "-7", "1.5", " 1", "1d", "0x10", "1e3", "1e400",
    "9223372036854775807", "9223372036854775808", "NaN", "Inf", "",
    "abc", "-inf", ".5", "5.",
)
# SQLSTATE codes cycled by event id: the retryable ones, some others, an unknown one.
SQLSTATE_CODES = (
    "08000", "08003", "08006", "40000", "40001", "40P01", "57P03",
    "22000", "23505", "42P01", "XX999",
)
SIGNING_KEY = "tallyfold-test-key"


def updates_from_events(events: DataFrame) -> DataFrame:
    """``events`` -> metric updates ``seq, ts, id, type, delta, value`` (clean)."""
    is_counter = F.col("event_type").isin(*COUNTER_EVENT_TYPES)
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string")).alias("id"),
        F.when(is_counter, F.lit(COUNTER)).otherwise(F.lit(GAUGE)).alias("type"),
        F.when(is_counter, F.get_json_object("props", "$.k").try_cast("bigint")).alias("delta"),
        F.when(~is_counter, F.col("value")).alias("value"),
    )


def _every(n: int) -> Column:
    return F.col("seq") % F.lit(n) == 0


def dirty_updates(updates: DataFrame) -> DataFrame:
    """Updates with request batches and injected defects (first matching rule wins).

    Adds ``batch_id`` (seq div 100) and ``pos`` (seq mod 100). ``counter``/``gauge``
    in the delta/value rules refer to the clean type.
    """
    was_counter = F.col("type") == COUNTER
    was_gauge = F.col("type") == GAUGE
    null_long = F.lit(None).cast("bigint")
    null_double = F.lit(None).cast("double")
    return updates.select(
        F.col("seq"),
        F.col("ts"),
        F.expr(f"seq div {BATCH_SIZE}").alias("batch_id"),
        (F.col("seq") % BATCH_SIZE).alias("pos"),
        F.when(_every(997), F.lit("")).when(_every(59), F.lit("shared")).otherwise(F.col("id")).alias("id"),
        F.when(_every(887), F.lit("")).when(_every(883), F.lit("histogram")).otherwise(F.col("type")).alias("type"),
        F.when(_every(881), null_long)
        .when(was_counter & _every(61), null_long)
        .when(was_gauge & _every(67), F.lit(9).cast("bigint"))
        .otherwise(F.col("delta"))
        .alias("delta"),
        F.when(_every(881), null_double)
        .when(was_counter & _every(61), F.lit(1.5))
        .when(was_gauge & _every(67), null_double)
        .otherwise(F.col("value"))
        .alias("value"),
    )


def path_requests(dirty: DataFrame) -> DataFrame:
    """Path-form update requests ``/update/{type}/{id}/{text}`` from the dirty updates."""
    texts = F.array(*[F.lit(t) for t in PATH_TEXTS])
    text = F.element_at(texts, (F.col("seq") % len(PATH_TEXTS) + 1).cast("int"))
    return dirty.select(
        "seq",
        F.concat(F.lit("/update/"), F.col("type"), F.lit("/"), F.col("id"), F.lit("/"), text).alias("path"),
    )


def sqlstate_rows(events: DataFrame) -> DataFrame:
    """One database error code per event (every 12th is null)."""
    codes = F.array(*[F.lit(c) for c in SQLSTATE_CODES])
    n = len(SQLSTATE_CODES) + 1
    slot = (F.col("event_id") % n).cast("int")
    return events.select(
        "event_id",
        F.when(slot < len(SQLSTATE_CODES), F.element_at(codes, slot + 1)).alias("sqlstate"),
    )


def lookup_requests(dirty: DataFrame) -> DataFrame:
    """Lookup requests: every dirty update's key, every third one with the other type."""
    flip = (F.col("seq") % 3 == 0) & F.col("type").isin(COUNTER, GAUGE)
    other = F.when(F.col("type") == COUNTER, F.lit(GAUGE)).otherwise(F.lit(COUNTER))
    return dirty.select(
        F.col("seq").alias("request_id"),
        F.col("id"),
        F.when(flip, other).otherwise(F.col("type")).alias("type"),
    )


def signed_requests(events: DataFrame, key: str = SIGNING_KEY) -> DataFrame:
    """Signed bodies: ``body = props`` with its HMAC; every 70th signature is empty,
    every 50th (otherwise) is a plain SHA-256 without the key, i.e. wrong."""
    eid = F.col("event_id")
    return events.select(
        "event_id",
        F.col("props").alias("body"),
        F.when(eid % 70 == 0, F.lit(""))
        .when(eid % 50 == 0, F.sha2(F.col("props").cast("binary"), 256))
        .otherwise(hmac_sha256_hex("props", key))
        .alias("signature"),
    )


def path_texts(dirty: DataFrame) -> DataFrame:
    """The value text of every path request, for the F1/F2 parsers."""
    texts = F.array(*[F.lit(t) for t in PATH_TEXTS])
    return dirty.select("seq", F.element_at(texts, (F.col("seq") % len(PATH_TEXTS) + 1).cast("int")).alias("text"))
