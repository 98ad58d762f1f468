"""Lookups against metric state: point (P1), value text (P2) and bulk.

Bulk lookups are a ``left`` join on (id, type). We force no strategy: AQE sees the
runtime bytes of the state side and broadcasts it only when it is under
``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise it stays a sort-merge
join whose skewed request partitions (many requests for one hot key) AQE splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import metric_json, value_text
from tallyfold.model import ERR_NOT_FOUND, KEY, RULE_ID, RULE_TYPE
from tallyfold.operators.validate import JSON_LOOKUP, VALUE_LOOKUP, status_code, validation_error


def lookup_one(state: DataFrame, id_: str, type_: str) -> DataFrame:
    """The state row of one key (0 or 1 rows). On a parquet state table the
    equality filters reach the scan as pushed filters."""
    return state.filter((F.col("id") == F.lit(id_)) & (F.col("type") == F.lit(type_)))


def lookup(requests: DataFrame, state: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Every request with the found state row (NULLs and ``found = false`` on a miss)."""
    key = list(key)
    out = requests.join(state.select(*key, "delta", "value", F.lit(True).alias("found")), key, "left")
    return out.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


#: Bits of the filter of requested keys: 4 MB, whatever the number of requests.
FILTER_BITS = 1 << 25
_BITMAP_BITS = 8 * 4096  # of one bitmap of Spark's bitmap functions


def requested(state: DataFrame, requests: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The state rows that some request may ask for, picked in the state's own scan.

    The requests' keys are hashed into a bitmap of fixed size, each task its own bits first; it is
    broadcast to the state, and a row whose bit is not set goes no further. No row that is asked for is
    lost; a few others stay, so a join must follow. With many times more requests than
    bits nothing is left out, and nothing is lost but the look at the bitmap.
    """
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    part, bit = F.call_function("div", slot, F.lit(_BITMAP_BITS)), (slot % _BITMAP_BITS).cast("bigint")
    marks = requests.select(part.alias("_part"), bit.alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.call_function("div", F.col("_bit"), F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")) % 2 == 1
    placed = state.select(*state.columns, part.alias("_part"), bit.alias("_bit"))
    return placed.join(F.broadcast(marks), "_part").filter(asked).select(*state.columns)


def lookup_misses(requests: DataFrame, state: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """J2 misses only (``left_anti``)."""
    return requests.join(state.select(*key), list(key), "left_anti")


def value_lookup(requests: DataFrame, state: DataFrame, kind: str = VALUE_LOOKUP) -> DataFrame:
    """P2 + P7: per request the value text and the outcome.

    The key rules (id, then type) run first; a valid key that is not in the state
    is ``not found``. ``text`` is the F5 text of the found row, NULL otherwise.
    """
    return _lookup_text(requests, state, value_text(), kind)


def json_lookup(requests: DataFrame, state: DataFrame) -> DataFrame:
    """P7 JSON lookup: per request the found metric as JSON (F7) in ``text`` and the
    outcome (invalid keys answer 404 here, as not found does). Requests may carry
    an ``error`` from decoding their body (``decode_single_bodies``): 400."""
    return _lookup_text(requests, state, metric_json(), JSON_LOOKUP)


def _lookup_text(requests: DataFrame, state: DataFrame, text: Column, kind: str) -> DataFrame:
    checked = requests.withColumn("_key_error", validation_error([RULE_ID, RULE_TYPE]))
    # Formatted once per state key, not once per request.
    texts = state.select(*KEY, text.alias("_text"), F.lit(True).alias("found"))
    joined = checked.join(texts, list(KEY), "left")
    joined = joined.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))
    # An earlier stage may already have refused the request (decode or routing error).
    prior = F.col("error") if "error" in requests.columns else F.lit(None).cast("string")
    error = F.coalesce(prior, F.col("_key_error"), F.when(~F.col("found"), F.lit(ERR_NOT_FOUND)))
    ok = F.col("found") & F.col("_key_error").isNull() & prior.isNull()
    return joined.select(
        *[c for c in requests.columns if c != "error"],
        "found",
        F.when(ok, F.col("_text")).alias("text"),
        error.alias("error"),
        status_code(kind, error).alias("status"),
    )
