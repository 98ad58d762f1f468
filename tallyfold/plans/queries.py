"""Registered queries: each takes ``(spark, sf_dir)`` and returns a lazy DataFrame.

Every query reads the driver tables (or data Spark derives from them) in full;
none filters rows to make a check cheaper. Column names equal those of the
matching oracle in ``tallyfold.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import errors, parse, sign, text
from tallyfold.model import STATE_COLUMNS, UPDATE_COLUMNS
from tallyfold.operators import dedup, fold, lookup, report, running, validate
from tallyfold.session import scratch_path
from tallyfold.sources import json_ingest, path_ingest, samples, snapshot, tables, updates as upd
from tallyfold.streaming import fold_stream, requests, results_store

# Time split used by the merge/seeded queries: earlier rows form the prior state.
SPLIT_TS = "2024-01-16 00:00:00"
# Batch bodies of ``json_strict_outcome``, in turn.
STRICT_BODIES = [
    '[{"id":"a","type":"counter","delta":1}]',
    '[{"id":"a","type":"gauge","value":1e400}]',
    '[{"id":"a","type":"gauge","value":-1e999}]',
    '[{"id":"a","type":"counter","delta":2,"meta":{"id":5},"tags":[{"value":"x"}]}]',
    "null",
    "[]",
    '[{"ID":"a","id":"b","TYPE":"counter","Delta":3}]',
    '[{"id":"a","type":"counter","delta":4,"delta":5}]',
    '{"id":"a","type":"counter","delta":1}',
    '[{"id":"a","type":"counter","delta":1.5}]',
    '[{"id":"a","type":"counter","delta":"5"}]',
    '[{"id":5,"type":"counter","delta":1}]',
    '[{"id":"a","type":"counter","delta":9223372036854775808}]',
    '[{"id":"a","type":"counter","delta":-9223372036854775808}]',
    '[{"id":"a","type":"counter","delta":1}',
    "[null]",
    '[{"id":"a","type":"counter","delta":1},{"id":"b","type":"gauge"}]',
    '[{"id":"c","type":"counter","delta":6}] tail',
    "",
]
# Report intervals: events are reported daily, lineitem samples weekly.
EVENT_REPORT_EVERY = "1 day"
LINEITEM_REPORT_EVERY = "7 days"
# Factors of ``gauge_text_wide``: powers of ten, and one that makes integers beyond 2**53.
WIDE_SCALES = [float(f"1e{k}") for k in range(-300, 301, 25)]
WIDE_INTEGER = 45_035_996_273_704_960.0
# Distance between the order values of ``running_sparse``.
SPARSE_STEP = 1_000_003
# Rows of one array file of ``snapshot_array_restore``.
SNAPSHOT_ROWS = 1000
# Buckets of a state by key.
BUCKETS = 16
# Arrival of the replayed requests: seconds since 1970, and from one run of the stream to the next.
REPLAY_EPOCH, REPLAY_GAP = 1_704_067_200, 60
# How long a report window waits for late updates.
LATE_BY = "1 day"
# The point lookup of P1.
LOOKUP_ID, LOOKUP_TYPE = "click_8", "counter"
# Lineitem as agent samples: sample id columns, gauge columns, counter columns.
LINEITEM_IDS = ["l_orderkey", "l_linenumber"]
LINEITEM_GAUGES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_COUNTERS = ["l_partkey"]

Query = Callable[[SparkSession, str], DataFrame]


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upd.updates_from_events(tables.table(spark, sf_dir, "events"))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upd.dirty_updates(_updates(spark, sf_dir))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.type_gate(_dirty(spark, sf_dir))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(_dirty(spark, sf_dir))


def _shuffle_partitions(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except ValueError:  # a non-numeric setting: Spark's own default
        return 200


def _before(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz"))


def _after(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))


def q_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates derived from events (the fixture every other query builds on)."""
    return _updates(spark, sf_dir).select(*UPDATE_COLUMNS)


def q_metric_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A2 + A3: the fold of all clean updates."""
    return fold.fold_updates(_updates(spark, sf_dir)).select(*STATE_COLUMNS)


def q_metric_state_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 + A1 + A2 + A3 on the dirty updates (NULL deltas and NULL last values)."""
    return fold.fold_updates(_gated(spark, sf_dir)).select(*STATE_COLUMNS)


def q_accepted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: validate -> reject bad batches -> fold (read -> P3 -> P5 -> A3)."""
    return fold.fold_updates(validate.accept_batches(_validated(spark, sf_dir))).select(*STATE_COLUMNS)


def q_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the earlier half merged with the later half (shuffled full outer join)."""
    u = _updates(spark, sf_dir)
    state = fold.fold_updates(_before(u))
    return fold.upsert(state, _after(u)).select(*STATE_COLUMNS)


def q_upsert_merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 as one aggregate over (state, folded batch): the merge-on-read form."""
    g = _gated(spark, sf_dir)
    state = fold.fold_updates(_before(g))
    return fold.fold_states(state.unionByName(fold.fold_updates(_after(g)))).select(*STATE_COLUMNS)


def q_upsert_merge_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on the dirty updates (NULL propagation across the merge)."""
    g = _gated(spark, sf_dir)
    state = fold.fold_updates(_before(g))
    return fold.upsert(state, _after(g)).select(*STATE_COLUMNS)


def q_upsert_merge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on a state in buckets by key: only the updates are shuffled."""
    root, g = scratch_path(spark, "buckets"), _gated(spark, sf_dir)
    snapshot.publish_buckets(fold.fold_updates(_before(g)), root, BUCKETS)
    return fold.upsert(snapshot.bucketed_state(spark, root, BUCKETS), _after(g)).select(*STATE_COLUMNS)


def q_id_store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 as a state: the fold by id alone, the first writer's type, on the dirty updates (ids with both types)."""
    return fold.fold_by_id(_gated(spark, sf_dir)).select(*STATE_COLUMNS)


def q_id_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 + A7: every lookup request against the store by id; a metric asked for by the other type is not found."""
    return lookup.value_lookup(_requests(spark, sf_dir), fold.fold_by_id(_gated(spark, sf_dir)).select(*STATE_COLUMNS))


def q_restore_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S6 + J1 + S13, a server's life: a snapshot of array files is restored (last copy of a key), later updates
    are folded onto it, and the metrics are listed."""
    path = scratch_path(spark, "serve")
    u = _updates(spark, sf_dir)
    label = F.lpad(F.expr(f"seq div {SNAPSHOT_ROWS}").cast("string"), 20, "0")
    snapshot.write_snapshot_arrays(_before(u).withColumn("file", label), path, "file", "seq")
    restored = snapshot.restore_state(spark, path, snapshot.ARRAY_FORMAT)
    return report.listing(fold.upsert(restored, _after(u)))


def q_running_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row as it stands after each update (skew-safe bucketed window)."""
    return running.running_result(_gated(spark, sf_dir))


def q_running_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 seeded with the prior state (the state before the later half)."""
    g = _gated(spark, sf_dir)
    state = fold.fold_updates(_before(g))
    return running.running_result(_after(g), state=state)


def q_running_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 where the order column is sparse: rows spread over all levels of the prefix tree."""
    g = _gated(spark, sf_dir)
    return running.running_result(g.withColumn("seq", F.col("seq") * SPARSE_STEP))


def q_metric_state_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1's overflow rule: deltas near 2**63 whose partial sums leave int64 and whose totals do not.

    The same fold with each key's rows in one partition, in seven and where they lie, as a merge of
    two halves, and as a fold of their states; every form must give the same state.
    """
    u = _updates(spark, sf_dir).filter(F.col("type") == "counter")
    step = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    big = F.lit(2**63 - 1)
    three = u.select("id", "type", "value", "seq", "delta", step).select(
        (F.col("seq") * 3 + F.col("k")).alias("seq"),
        "id",
        "type",
        F.when(F.col("k") == 0, big).when(F.col("k") == 2, -big).otherwise(F.col("delta")).alias("delta"),
        "value",
        (F.col("seq") % 2 == 0).alias("early"),
    )
    # A sum is a key's own, so a key in one partition is one partial sum, whatever other keys lie elsewhere.
    n = max(7, _shuffle_partitions(spark))
    forms = {
        "one": fold.fold_updates(three.repartition("id", "type")),
        "seven": fold.fold_updates(three.repartition(n, "id", "type", F.pmod("seq", F.lit(7)))),
        "spread": fold.fold_updates(three),
        "merged": fold.upsert(fold.fold_updates(three.filter("early")), three.filter("not early")),
        "states": fold.fold_states(fold.fold_updates(three.filter("early")).unionByName(fold.fold_updates(three.filter("not early")))),
    }
    out = None
    for name, df in forms.items():
        one = df.select(F.lit(name).alias("form"), *STATE_COLUMNS)
        out = one if out is None else out.unionByName(one)
    return out


def q_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once, with their rows."""
    return fold.duplicate_keys(_gated(spark, sf_dir))


def q_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written with both types and the type of their first write."""
    return fold.type_conflicts(_gated(spark, sf_dir))


def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing rule of every update."""
    return _validated(spark, sf_dir).select("seq", "batch_id", "pos", "id", "type", "error")


def q_validate_key_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the id and type rules, in that order."""
    return validate.validate(_dirty(spark, sf_dir), ["id", "type"]).select("seq", "error")


def q_batch_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: rows of batches without any invalid record."""
    return validate.accept_batches(_validated(spark, sf_dir)).select(
        "seq", "batch_id", "pos", "id", "type", "delta", "value"
    )


def q_batch_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 report: first error and number of bad rows per rejected batch."""
    return validate.first_errors(_validated(spark, sf_dir))


def q_json_update_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 for single JSON updates: the status of every dirty update request."""
    v = _validated(spark, sf_dir)
    return v.select("seq", validate.status_code(validate.JSON_UPDATE, "error").alias("status"))


def q_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last row per (batch, id)."""
    d = _dirty(spark, sf_dir).select("batch_id", "id", "seq", "type", "delta", "value")
    return dedup.keep_last(d, ["batch_id", "id"], "seq")


def q_report_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + A5: per daily report window and metric, polls and the folded metric."""
    return report.report_fold(_updates(spark, sf_dir), EVENT_REPORT_EVERY)


def q_report_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the PollCount counter per report window."""
    return report.poll_counts(_updates(spark, sf_dir), EVENT_REPORT_EVERY)


def q_latest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sample of each daily window, last row per id."""
    u = report.with_report_window(_updates(spark, sf_dir), EVENT_REPORT_EVERY)
    last = dedup.latest_sample(u.select("window_start", "ts", "seq", *STATE_COLUMNS), "window_start")
    return last.drop("ts").withColumn("window_start", report.window_text())


def _lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.table(spark, sf_dir, "lineitem")
    return samples.wide_to_long(
        li.select(*LINEITEM_IDS, "l_shipdate", *LINEITEM_GAUGES, *LINEITEM_COUNTERS),
        [*LINEITEM_IDS, "l_shipdate"],
        LINEITEM_GAUGES,
        LINEITEM_COUNTERS,
    )


def _latest_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.table(spark, sf_dir, "lineitem").select(
        report.window_start("l_shipdate", LINEITEM_REPORT_EVERY).alias("window_start"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        *LINEITEM_GAUGES,
        *LINEITEM_COUNTERS,
    )
    newest = dedup.latest_wide_sample(li, "window_start")
    return samples.wide_to_long(newest, ["window_start", "seq"], LINEITEM_GAUGES, LINEITEM_COUNTERS).select("window_start", "id", "seq", "type", "delta", "value")


def q_latest_sample_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 on wide samples: pick the newest samples per window on the wide rows, then
    unpivot only those (the unpivot multiplies rows; the filter comes first)."""
    return _latest_wide(spark, sf_dir).withColumn("window_start", report.window_text())


def q_agent_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent's report path: per report window the latest sample's metrics
    (S10 + A6) as one JSON array body (F7, ordered by id) and its signature (F8)."""
    last = _latest_wide(spark, sf_dir).withColumn("window_start", report.window_text())
    bodies = json_ingest.batch_bodies(last, batch="window_start", pos="id", single_object=True)
    return bodies.select("window_start", "body", sign.hmac_sha256_hex("body", upd.SIGNING_KEY).alias("signature"))


def q_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows as samples, one metric row per column."""
    return _lineitem_samples(spark, sf_dir).drop("l_shipdate")


def q_cpu_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding arrays as CPUutilization{i} gauges."""
    return samples.indexed_gauges(tables.table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")


def q_hmac_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: HMAC-SHA256 of every event's props."""
    ev = tables.table(spark, sf_dir, "events")
    return ev.select("event_id", sign.hmac_sha256_hex("props", upd.SIGNING_KEY).alias("signature"))


def q_hmac_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature check with correct, wrong and empty signatures."""
    req = upd.signed_requests(tables.table(spark, sf_dir, "events"))
    return req.select("event_id", sign.signature_ok("body", "signature", upd.SIGNING_KEY).alias("accepted"))


def q_parse_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + F2: strict int/float parsing of the path-form value texts."""
    t = upd.path_texts(_dirty(spark, sf_dir))
    return t.select("seq", "text", parse.parse_int("text").alias("as_int"), parse.parse_float("text").alias("as_float"))


def q_path_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + P7: path-form updates to typed rows with status codes."""
    return path_ingest.ingest_paths(upd.path_requests(_dirty(spark, sf_dir)))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upd.lookup_requests(_dirty(spark, sf_dir))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_updates(_updates(spark, sf_dir)).select(*STATE_COLUMNS)


def q_lookup_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + P2 + P7: value text and status for every lookup request (shuffled join)."""
    return lookup.value_lookup(_requests(spark, sf_dir), _state(spark, sf_dir))


def q_lookup_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 with a filter of the requested keys: what the state holds of the metrics that refused updates named.

    Refused updates are few, so few rows of the published state leave its scan.
    """
    root = scratch_path(spark, "lookup-rejected")
    snapshot.publish_state(_state(spark, sf_dir), root)
    refused = _validated(spark, sf_dir).filter(F.col("error").isNotNull()).select(F.col("seq").alias("request_id"), "id", "type")
    return lookup.value_lookup(refused, lookup.requested(snapshot.base_state(spark, root).select(*STATE_COLUMNS), refused))


def q_value_path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 in path form: ``/value/{type}/{id}`` for every lookup request -> text and status."""
    req = _requests(spark, sf_dir).select(
        "request_id", F.concat(F.lit("/value/"), F.col("type"), F.lit("/"), F.col("id")).alias("path")
    )
    return lookup.value_lookup(path_ingest.lookup_paths(req), _state(spark, sf_dir))


def q_json_lookup_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 JSON lookup from request bodies: strict decode (400 when refused), then lookup."""
    req = _requests(spark, sf_dir)
    bodies = req.select(
        "request_id",
        # Every 13th body is cut short: a decode error.
        F.when(F.col("request_id") % 13 == 0, F.lit('{"id":')).otherwise(
            F.to_json(F.struct("id", "type"))
        ).alias("body"),
    )
    dec = json_ingest.decode_single_bodies(bodies).select(
        "request_id", "id", "type", F.col("decode_error").alias("error")
    )
    return lookup.json_lookup(dec, _state(spark, sf_dir))


def q_lookup_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 JSON lookup: the found metric as JSON and the status."""
    return lookup.json_lookup(_requests(spark, sf_dir), _state(spark, sf_dir))


def q_lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose key is not in the state."""
    return lookup.lookup_misses(_requests(spark, sf_dir), _state(spark, sf_dir))


def q_lookup_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key's state row."""
    return lookup.lookup_one(_state(spark, sf_dir), LOOKUP_ID, LOOKUP_TYPE)


def q_lookup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 on published state: the key filters reach the scan of the base."""
    root = scratch_path(spark, "lookup-state")
    snapshot.publish_state(_state(spark, sf_dir), root)
    return lookup.lookup_one(snapshot.base_state(spark, root), LOOKUP_ID, LOOKUP_TYPE).select(*STATE_COLUMNS)


def q_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing line of every metric."""
    return report.listing(_state(spark, sf_dir))


def q_metric_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: number of metrics."""
    return report.metric_count(_state(spark, sf_dir))


def q_path_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-form export of the dirty state, with errors."""
    st = fold.fold_updates(_gated(spark, sf_dir)).select(*STATE_COLUMNS)
    path, error = report.export_path()
    return st.select("id", "type", path.alias("path"), error.alias("error"))


def q_value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 + F4 + F5: typed value text of the dirty state."""
    st = fold.fold_updates(_gated(spark, sf_dir)).select(*STATE_COLUMNS)
    return st.select("id", "type", text.value_text().alias("text"))


def q_gauge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shortest float text of lineitem's double columns."""
    li = tables.table(spark, sf_dir, "lineitem")
    return li.select(
        *LINEITEM_IDS,
        *[text.format_float(c).alias(f"{c}_text") for c in LINEITEM_GAUGES],
    )


def q_gauge_text_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 over the whole range: values times powers of ten, and integers from 2**53 to 2**63."""
    li = tables.table(spark, sf_dir, "lineitem")
    scale = F.element_at(F.array(*[F.lit(x) for x in WIDE_SCALES]), (F.col("l_orderkey") % len(WIDE_SCALES) + 1).cast("int"))
    return li.select(
        *LINEITEM_IDS,
        text.format_float(F.col("l_extendedprice").cast("double") * scale).alias("scaled"),
        text.format_float(F.col("l_partkey").cast("double") * F.lit(WIDE_INTEGER) + F.col("l_orderkey").cast("double")).alias("whole"),
    )


def q_debug_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """debug text (half-even) of the state."""
    return _state(spark, sf_dir).select("id", "type", text.debug_text().alias("line"))


def q_metric_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the dirty state as JSON text."""
    st = fold.fold_updates(_gated(spark, sf_dir)).select(*STATE_COLUMNS)
    return st.select("id", "type", text.metric_json().alias("json"))


def q_json_single_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + F9: single-metric JSON bodies (F7 output) decoded back."""
    d = _dirty(spark, sf_dir)
    bodies = d.select("seq", text.metric_json().alias("body"))
    dec = json_ingest.decode_single_bodies(bodies)
    return dec.select("seq", "id", "type", "delta", "value", "decode_error")


def q_json_batch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + F9: per-batch JSON array bodies decoded back into rows."""
    bodies = json_ingest.batch_bodies(_dirty(spark, sf_dir))
    rows = json_ingest.explode_batches(json_ingest.decode_batch_bodies(bodies), ["batch_id"])
    return rows.select(
        (F.col("batch_id") * upd.BATCH_SIZE + F.col("pos")).alias("seq"),
        "batch_id",
        "pos",
        "id",
        "type",
        "delta",
        "value",
    )


def q_json_strict_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hard bodies, one form per update in turn, and what becomes of them."""
    forms = F.array(*[F.lit(b) for b in STRICT_BODIES])
    form = (F.col("seq") % len(STRICT_BODIES)).cast("int")
    bodies = _updates(spark, sf_dir).select(F.col("seq").alias("batch_id"), form.alias("form"), F.element_at(forms, form + 1).alias("body"))
    decoded = json_ingest.decode_batch_bodies(bodies)
    outcome = json_ingest.batch_outcomes(decoded, "batch_id")
    shown = decoded.select("batch_id", "form", F.transform("metrics", lambda m: m["id"]).alias("ids"), F.transform("metrics", lambda m: m["delta"]).alias("deltas"))
    return shown.join(outcome, "batch_id").select(
        "batch_id", "form", "error", "status", F.array_join("ids", ",", "-").alias("ids"), F.array_join(F.transform("deltas", lambda d: d.cast("string")), ",", "-").alias("deltas")
    )


def q_json_update_saved_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + P3 + W1 + F7 + P7: each single-metric body, its status, and the row as saved, as JSON."""
    bodies = _dirty(spark, sf_dir).select("seq", text.metric_json().alias("body"))
    decoded = json_ingest.decode_single_bodies(bodies)
    error = F.coalesce("decode_error", validate.validation_error())
    judged = decoded.select("seq", "id", "type", "delta", "value", error.alias("error"))
    saved = running.running_result(judged.filter(F.col("error").isNull())).select(F.col("seq").alias("_seq"), text.metric_json().alias("saved"))
    return judged.join(saved, F.col("seq") == F.col("_seq"), "left").select(
        "seq", "error", validate.status_code(validate.JSON_UPDATE, "error").alias("status"), "saved"
    )


def _batch_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_ingest.decode_batch_bodies(json_ingest.batch_bodies(_dirty(spark, sf_dir)))


def q_batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + P7 per JSON batch body: first error and status."""
    return json_ingest.batch_outcomes(_batch_decoded(spark, sf_dir))


def q_json_pipeline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies -> strict decode -> validate -> reject bad batches -> fold."""
    rows = json_ingest.accepted_updates(_batch_decoded(spark, sf_dir))
    rows = rows.withColumn("seq", F.col("batch_id") * upd.BATCH_SIZE + F.col("pos"))
    return fold.fold_updates(rows).select(*STATE_COLUMNS)


def q_signed_pipeline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole request path: signature check (P8) -> strict decode (S1) -> validate
    -> reject bad batches (P5) -> fold (A3). Every 7th body carries a wrong signature."""
    bodies = json_ingest.batch_bodies(_dirty(spark, sf_dir))
    good = sign.hmac_sha256_hex("body", upd.SIGNING_KEY)
    signed = bodies.withColumn(
        "signature", F.when(F.col("batch_id") % 7 == 0, F.sha2(F.col("body").cast("binary"), 256)).otherwise(good)
    )
    trusted = signed.filter(sign.signature_ok("body", "signature", upd.SIGNING_KEY))
    rows = json_ingest.accepted_updates(json_ingest.decode_batch_bodies(trusted))
    rows = rows.withColumn("seq", F.col("batch_id") * upd.BATCH_SIZE + F.col("pos"))
    return fold.fold_updates(rows).select(*STATE_COLUMNS)


def q_gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates written as gzip JSON lines and read back (unset fields omitted)."""
    path = scratch_path(spark, "gzip")
    json_ingest.write_update_files(_updates(spark, sf_dir), path, "gzip")
    return json_ingest.read_update_lines(spark, path).select(*STATE_COLUMNS)


def q_stream_fold_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold as a streaming aggregation in update mode (Spark's state store);
    every micro-batch's changed rows go to a folder of their own, the last per key wins."""
    root = scratch_path(spark, "stream-agg")
    stream = _stream_source(spark, _updates(spark, sf_dir).select(*UPDATE_COLUMNS), root)
    out = f"{root}/emitted"
    q = (
        fold_stream.stream_fold(stream)
        .writeStream.outputMode("update")
        .foreachBatch(lambda df, bid: df.withColumn("batch_id", F.lit(bid)).write.mode("overwrite").parquet(f"{out}/batch={bid}"))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    emitted = spark.read.parquet(out)
    # A key is emitted at most once per micro-batch: its row from the latest batch is current.
    return dedup.keep_last(emitted.select(*STATE_COLUMNS, "batch_id"), ["id", "type"], "batch_id").select(
        *STATE_COLUMNS
    )


def q_sqlstate_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retryable or not for every error code."""
    s = upd.sqlstate_rows(tables.table(spark, sf_dir, "events"))
    return s.select("event_id", "sqlstate", errors.classify_sqlstate("sqlstate").alias("class"))


def q_snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 -> S4 -> S6: write the state as a JSON snapshot, restore it."""
    path = scratch_path(spark, "snapshot")
    snapshot.write_snapshot_json(_state(spark, sf_dir), path)
    return snapshot.restore_state(spark, path)


def q_snapshot_array_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S6 with array files that repeat keys: the last copy of a key wins."""
    path = scratch_path(spark, "snapshot-arrays")
    label = F.lpad(F.expr(f"seq div {SNAPSHOT_ROWS}").cast("string"), 20, "0")
    snapshot.write_snapshot_arrays(_updates(spark, sf_dir).withColumn("file", label), path, "file", "seq")
    return snapshot.restore_state(spark, path, snapshot.ARRAY_FORMAT)


def _stream_source(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Rows as files in a folder, read back as a stream in about four micro-batches.

    One file per shuffle partition (range-partitioned by seq), so the write is as
    parallel as the session and no task carries a fixed share.
    """
    n = _shuffle_partitions(spark)
    rows.repartitionByRange(n, "seq").write.parquet(f"{root}/source")
    per_batch = max(1, -(-n // 4))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(f"{root}/source")


def q_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State from a base and two streams with checkpoints of their own, every
    micro-batch applied twice (a replay), then rebased into a new root and read there."""
    root = scratch_path(spark, "stream")
    u = _updates(spark, sf_dir)
    snapshot.publish_state(fold.fold_updates(_before(u)), f"{root}/state")
    late = _after(u).select(*UPDATE_COLUMNS)
    for k in (0, 1):
        own = f"{root}/stream{k}"
        stream = _stream_source(spark, late.filter(F.col("seq") % 2 == k), own)

        def twice(batch: DataFrame, batch_id: int, checkpoint: str = f"{own}/checkpoint") -> None:
            source = fold_stream.source_id(batch.sparkSession, checkpoint)
            for _ in range(2):
                fold_stream.apply_batch(batch, batch_id, f"{root}/state", source)

        sink = stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{own}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    snapshot.rebase(spark, f"{root}/state", f"{root}/rebased")
    return snapshot.read_state(spark, f"{root}/rebased").select(*STATE_COLUMNS)


def q_stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the updates as a stream; the row as it stands after each of them.

    They arrive in four parts in apply order, and the stream restarts for each.
    """
    root = scratch_path(spark, "stream-results")
    u = _updates(spark, sf_dir).select(*UPDATE_COLUMNS)
    first, last = u.agg(F.min("seq"), F.max("seq")).first()
    quarter = F.floor((F.col("seq") - first) * 4 / (last - first + 1))
    for k in range(4):
        u.filter(quarter == k).write.mode("append").parquet(f"{root}/source")
        stream = spark.readStream.schema(u.schema).parquet(f"{root}/source")
        fold_stream.start_state_stream(
            stream, f"{root}/state", f"{root}/checkpoint", {"availableNow": True}, results_root=f"{root}/results"
        ).awaitTermination()
    return spark.read.parquet(f"{root}/results").select("seq", *STATE_COLUMNS)


def _in_parts(spark: SparkSession, rows: DataFrame, part: str, n_parts: int, root: str, start) -> None:
    """Rows as a stream in parts: each part is appended to the source, and ``start(stream)`` runs over what is new."""
    given = rows.drop(part)
    for k in range(n_parts):
        rows.filter(F.col(part) == k).drop(part).write.mode("append").parquet(f"{root}/source")
        start(spark.readStream.schema(given.schema).parquet(f"{root}/source")).awaitTermination()


def q_stream_results_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 from the state store: the row as it stands after each update, in four runs of one stream."""
    root = scratch_path(spark, "stream-store")
    u = _updates(spark, sf_dir).select(*UPDATE_COLUMNS)
    first, last = u.agg(F.min("seq"), F.max("seq")).first()
    rows = u.withColumn("part", F.floor((F.col("seq") - first) * 4 / (last - first + 1)))
    start = lambda s: results_store.start_result_stream(s, f"{root}/results", f"{root}/checkpoint", trigger={"availableNow": True})
    _in_parts(spark, rows, "part", 4, root, start)
    return spark.read.parquet(f"{root}/results").select("seq", *STATE_COLUMNS)


def q_request_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + T1: request bodies as a stream in which every 7th comes again, in the next run of the stream; each counts once."""
    root = scratch_path(spark, "replay")
    bodies = json_ingest.batch_bodies(_dirty(spark, sf_dir))
    last = bodies.agg(F.max("batch_id")).first()[0] or 0
    half = F.when(F.col("batch_id") * 2 > last, 1).otherwise(0)
    sent = F.array(F.lit(0), F.lit(1))
    again = F.explode(F.when(F.col("batch_id") % 7 == 0, sent).otherwise(F.slice(sent, 1, 1)))
    arrived = bodies.withColumn("again", again).withColumn("part", half + F.col("again"))
    received = F.timestamp_seconds(REPLAY_EPOCH + REPLAY_GAP * F.col("part"))
    rows = arrived.select(F.concat(F.lit("r"), F.col("batch_id")).alias("request_id"), received.alias("received"), "batch_id", "body", "part")
    start = lambda s: requests.start_request_stream(s, f"{root}/state", f"{root}/checkpoint", "batch_id", upd.BATCH_SIZE, trigger={"availableNow": True})
    _in_parts(spark, rows, "part", 3, root, start)
    return snapshot.read_state(spark, f"{root}/state").select(*STATE_COLUMNS)


def q_report_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 with a watermark: daily windows, each emitted once and then forgotten; every 13th update comes
    a quarter of the time too late, and counts only if its window has not passed the watermark."""
    root = scratch_path(spark, "report-late")
    u = _updates(spark, sf_dir).select("ts", *UPDATE_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = u.agg(F.min("seq"), F.max("seq")).first()
    quarter = F.floor((F.col("seq") - first) * 4 / (last - first + 1))
    rows = u.withColumn("part", quarter + F.when(F.col("seq") % 13 == 0, 1).otherwise(0))

    def start(stream: DataFrame):
        report_ = fold_stream.stream_report(stream, EVENT_REPORT_EVERY, watermark=LATE_BY)
        out = report_.writeStream.outputMode("append").format("parquet").option("path", f"{root}/emitted")
        return out.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()

    _in_parts(spark, rows, "part", 5, root, start)
    emitted = spark.read.parquet(f"{root}/emitted")
    return emitted.select(report.window_text(F.col("window.start")).alias("window_start"), "id", "type", "polls", "delta", "value")


def q_report_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 live: daily report windows as a streaming aggregation in update mode; the
    latest emission of each window and metric."""
    root = scratch_path(spark, "report-live")
    rows = _updates(spark, sf_dir).select("ts", *UPDATE_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp"))
    emitted = f"{root}/emitted"
    live = fold_stream.stream_report(_stream_source(spark, rows, root), EVENT_REPORT_EVERY)
    live.writeStream.outputMode("update").foreachBatch(
        lambda df, bid: df.withColumn("batch_id", F.lit(bid)).write.mode("overwrite").parquet(f"{emitted}/batch={bid}")
    ).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(emitted).select(
        report.window_text(F.col("window.start")).alias("window_start"), "id", "type", "polls", "delta", "value", "batch_id"
    )
    return dedup.keep_last(out, ["window_start", "id", "type"], "batch_id").drop("batch_id")


QUERIES: dict[str, Query] = {
    "updates": q_updates,
    "metric_state": q_metric_state,
    "metric_state_dirty": q_metric_state_dirty,
    "metric_state_large": q_metric_state_large,
    "accepted_state": q_accepted_state,
    "upsert_merge": q_upsert_merge,
    "upsert_merge_dirty": q_upsert_merge_dirty,
    "upsert_merge_union": q_upsert_merge_union,
    "upsert_merge_buckets": q_upsert_merge_buckets,
    "id_store_state": q_id_store_state,
    "id_store_lookup": q_id_store_lookup,
    "restore_serve": q_restore_serve,
    "running_result": q_running_result,
    "running_seeded": q_running_seeded,
    "running_sparse": q_running_sparse,
    "type_conflicts": q_type_conflicts,
    "duplicate_keys": q_duplicate_keys,
    "validate": q_validate,
    "validate_key_only": q_validate_key_only,
    "batch_accept": q_batch_accept,
    "batch_first_error": q_batch_first_error,
    "json_update_outcome": q_json_update_outcome,
    "keep_last": q_keep_last,
    "report_window": q_report_window,
    "report_polls": q_report_polls,
    "latest_sample": q_latest_sample,
    "latest_sample_wide": q_latest_sample_wide,
    "agent_reports": q_agent_reports,
    "wide_to_long": q_wide_to_long,
    "cpu_explode": q_cpu_explode,
    "hmac_sign": q_hmac_sign,
    "hmac_check": q_hmac_check,
    "parse_value": q_parse_value,
    "path_ingest": q_path_ingest,
    "lookup_bulk": q_lookup_bulk,
    "lookup_rejected": q_lookup_rejected,
    "lookup_json": q_lookup_json,
    "value_path_lookup": q_value_path_lookup,
    "json_lookup_bodies": q_json_lookup_bodies,
    "lookup_miss": q_lookup_miss,
    "lookup_one": q_lookup_one,
    "lookup_state": q_lookup_state,
    "listing": q_listing,
    "metric_count": q_metric_count,
    "path_export": q_path_export,
    "value_text": q_value_text,
    "gauge_text": q_gauge_text,
    "gauge_text_wide": q_gauge_text_wide,
    "debug_text": q_debug_text,
    "metric_json": q_metric_json,
    "json_single_ingest": q_json_single_ingest,
    "json_batch_ingest": q_json_batch_ingest,
    "json_strict_outcome": q_json_strict_outcome,
    "json_update_saved_row": q_json_update_saved_row,
    "batch_outcome": q_batch_outcome,
    "json_pipeline_state": q_json_pipeline_state,
    "signed_pipeline_state": q_signed_pipeline_state,
    "gzip_roundtrip": q_gzip_roundtrip,
    "stream_fold_update": q_stream_fold_update,
    "sqlstate_class": q_sqlstate_class,
    "snapshot_roundtrip": q_snapshot_roundtrip,
    "snapshot_array_restore": q_snapshot_array_restore,
    "stream_state": q_stream_state,
    "stream_results": q_stream_results,
    "stream_results_store": q_stream_results_store,
    "request_replay": q_request_replay,
    "report_live": q_report_live,
    "report_late": q_report_late,
}
