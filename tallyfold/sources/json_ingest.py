"""JSON update bodies -> metric rows (S1, S2, F9) and update files.

A body is one request: a JSON array of metrics (batch) or one metric object. It is
parsed once, into ordered entries of VARIANT, and every element's own five
fields are then checked by their JSON types: ``"delta": 1.5`` or ``"5"``, a lone
object where an array is expected, and a number that leaves the double's range (``1e400``) are refused
(``from_json`` to the metric type would silently turn them into NULLs). Any mismatch
rejects the whole body, as a decode error does.
As the reference's decoder does it: field names match case-insensitively, of a
field given twice the last one wins (a ``null`` leaves a text field as it was), unknown fields are
ignored whatever they hold, a batch body ``null`` is an empty batch, a ``null``
element or single body is a metric without fields, and what follows the first JSON value is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.text import metric_json
from tallyfold.model import ERR_BAD_JSON, METRIC_ARRAY_DDL, METRIC_SCHEMA
from tallyfold.operators.validate import BATCH_UPDATE, status_code, validation_error

# The metric's JSON field names.
FIELD_NAMES = ("id", "type", "delta", "value", "hash")

_ENTRIES_DDL = "map<string,variant>"
# Single quotes are no JSON; NaN and Infinity neither.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# JSON types (as named by schema_of_variant) of each field.
_TEXT_TYPES = r"^(STRING|VOID)$"
_FIELD_TYPES = {
    "id": _TEXT_TYPES,
    "type": _TEXT_TYPES,
    "hash": _TEXT_TYPES,
    "delta": r"^(BIGINT|VOID)$",
    "value": r"^(BIGINT|DOUBLE|VOID|DECIMAL\(\d+,\d+\))$",
}


def _field(entries: Column, name: str) -> Column:
    """The values given to one field of an element, in order."""
    return F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == name), lambda e: e["value"])


def _all_of_type(values: Column, pattern: str) -> Column:
    return F.forall(values, lambda v: F.schema_of_variant(v).rlike(pattern))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _metric(element: Column) -> Column:
    """One element (ordered entries; NULL for ``null``) as ``(ok, metric)``."""
    entries = F.coalesce(F.map_entries(element), F.array().cast("array<struct<key:string,value:variant>>"))
    given = {name: _field(entries, name) for name in FIELD_NAMES}

    def text(name: str) -> Column:
        named = F.filter(given[name], lambda v: F.schema_of_variant(v) == "STRING")
        return F.try_variant_get(_last(named), "$", "string").alias(name)

    number = F.try_variant_get(_last(given["value"]), "$", "double")
    ok = F.forall(given["value"], lambda v: F.coalesce(F.abs(F.try_variant_get(v, "$", "double")) < float("inf"), F.lit(True)))
    for name, pattern in _FIELD_TYPES.items():
        ok = ok & _all_of_type(given[name], pattern)
    metric = F.struct(text("id"), text("type"), F.try_variant_get(_last(given["delta"]), "$", "bigint").alias("delta"), number.alias("value"), text("hash"))
    return F.struct(ok.alias("ok"), metric.alias("metric"))


def _decode(bodies: DataFrame, body: str, array: bool) -> DataFrame:
    """Adds ``_decoded`` (the metrics of the body) and ``decode_error``."""
    text = F.col(body)
    null_body = text.rlike(r"^\s*null\b")
    if array:
        entries = F.from_json(text, f"array<{_ENTRIES_DDL}>", _STRICT)
    else:
        one = F.from_json(text, _ENTRIES_DDL, _STRICT)
        entries = F.when(one.isNotNull(), F.array(one))
    parsed = bodies.withColumn("_elements", F.transform(entries, _metric))
    shape = text.rlike(r"^\s*\[" if array else r"^\s*\{")
    good = shape & F.col("_elements").isNotNull() & F.forall("_elements", lambda e: e["ok"])
    metrics = F.transform("_elements", lambda e: e["metric"]).cast(METRIC_ARRAY_DDL)
    none = F.array().cast(METRIC_ARRAY_DDL)
    empty = none if array else F.array(F.lit(None)).cast(METRIC_ARRAY_DDL)
    ok = F.coalesce(null_body | good, F.lit(False))
    result = F.struct(F.when(null_body, empty).when(good, metrics).alias("metrics"), F.when(~ok, F.lit(ERR_BAD_JSON)).alias("error"))
    # One row for each body; a generator, so that no later filter or projection parses it again.
    once = parsed.select(*bodies.columns, F.explode(F.array(result)).alias("_result"))
    return once.select(*bodies.columns, F.col("_result.metrics").alias("_decoded"), F.col("_result.error").alias("decode_error"))


def decode_batch_bodies(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Add ``metrics`` (array of metric structs) and ``decode_error`` per body."""
    return _decode(bodies, body, array=True).withColumnRenamed("_decoded", "metrics")


def explode_batches(decoded: DataFrame, keep: list[str]) -> DataFrame:
    """One row per metric of each decodable body: ``keep`` columns, ``pos`` and the metric.

    Rejected bodies produce no rows (report them from ``decode_error``).
    """
    return decoded.filter(F.col("decode_error").isNull()).select(
        *keep, F.posexplode("metrics").alias("pos", "_m")
    ).select(*keep, F.col("pos").cast("bigint").alias("pos"), "_m.id", "_m.type", "_m.delta", "_m.value", "_m.hash")


def decode_single_bodies(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One metric object per body -> ``id, type, delta, value, hash`` + ``decode_error``."""
    dec = _decode(bodies, body, array=False).withColumn("_m", F.try_element_at("_decoded", F.lit(1)))
    return dec.select(*bodies.columns, "_m.id", "_m.type", "_m.delta", "_m.value", "_m.hash", "decode_error")


def first_record_error(metrics: str | Column = "metrics") -> Column:
    """P3 inside a body: the error of the first invalid record of the array (NULL if
    all are valid), computed on the array itself; no explode, no join."""
    arr = F.col(metrics) if isinstance(metrics, str) else metrics
    errors = F.transform(arr, lambda m: validation_error(metric=m))
    return F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1))


def batch_outcomes(decoded: DataFrame, batch: str = "batch_id") -> DataFrame:
    """P5 + P7 per request body: the first error (decode error, else the first invalid
    record by position) and the status. A body is one row, so all-or-nothing is a
    row-level predicate: no explode, no join, nothing collected."""
    error = F.coalesce(F.col("decode_error"), first_record_error("metrics"))
    return decoded.select(batch, error.alias("error"), status_code(BATCH_UPDATE, error).alias("status"))


def accepted_updates(decoded: DataFrame, batch: str = "batch_id") -> DataFrame:
    """S1 -> P3 -> P5: the metric rows of bodies that decode and hold only valid
    records. Bodies are judged whole, before exploding, in one pass."""
    ok = F.col("decode_error").isNull() & first_record_error("metrics").isNull()
    return explode_batches(decoded.filter(ok), [batch])


def batch_bodies(rows: DataFrame, batch: str = "batch_id", pos: str = "pos", single_object: bool = False) -> DataFrame:
    """Encode request bodies: per batch a JSON array of its metrics in ``pos`` order.

    The batch is one request, bounded by the sender; this is the inverse of S1. With
    ``single_object`` a batch of one metric is that metric's object, as an agent signs it.
    """
    elems = rows.select(batch, F.struct(F.col(pos).alias("p"), metric_json().alias("j")).alias("e"))
    grouped = elems.groupBy(batch).agg(F.array_sort(F.collect_list("e")).alias("es"))
    body = F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["j"]), ","), F.lit("]"))
    if single_object:
        body = F.when(F.size("es") == 1, F.element_at("es", 1)["j"]).otherwise(body)
    return grouped.select(batch, body.alias("body"))


def read_update_files(spark: SparkSession, path: str) -> DataFrame:
    """S1/S12 over files: each file is one request body (gzip is decompressed by
    the reader). Returns the decoded bodies with the file name as ``source``.

    A compressed or single-document JSON file is not splittable, so inputs should
    come as many medium files; each file is read by one task.
    """
    raw = spark.read.option("wholetext", "true").text(path)
    bodies = raw.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("body"))
    return decode_batch_bodies(bodies)


def read_update_lines(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows from JSON-lines files (``.json.gz`` is decompressed by the
    reader; gzip files are not splittable, so many medium files parallelise best)."""
    return spark.read.schema(METRIC_SCHEMA).json(path)


def write_update_files(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write metric rows as (gzip) JSON lines, unset fields omitted."""
    rows.select("id", "type", "delta", "value").write.mode("errorifexists").option(
        "compression", compression
    ).json(path)
