"""JSON ingest (S1, S2, F9), samples (S10, S11), snapshots and versioned state."""

import os

import pytest
from conftest import rows

from tallyfold.operators import fold, lookup
from tallyfold.sources import json_ingest, samples, snapshot


def test_strict_batch_decode(spark):
    bodies = [
        (1, '[{"id":"a","type":"counter","delta":5},{"id":"b","type":"gauge","value":1.5}]'),
        (2, '[{"id":"a","type":"counter","delta":1.5}]'),
        (3, '{"id":"a","type":"gauge","value":2}'),
        (4, '[{"id":"a","type":"counter","delta":"5"}]'),
        (5, "[]"),
        (6, "not json"),
        (7, '[{"id":5,"type":"gauge","value":1}]'),
        (8, '[{"id":"a","type":"gauge","value":1e2,"hash":"h"}]'),
    ]
    df = spark.createDataFrame(bodies, "batch_id BIGINT, body STRING")
    dec = json_ingest.decode_batch_bodies(df)
    errs = dict(rows(dec, "batch_id", "decode_error"))
    assert {k for k, v in errs.items() if v is None} == {1, 5, 8}
    out = rows(json_ingest.explode_batches(dec, ["batch_id"]), "batch_id", "pos", "id", "delta", "value")
    assert out == [(1, 0, "a", 5, None), (1, 1, "b", None, 1.5), (8, 0, "a", None, 100.0)]


def test_single_decode(spark):
    df = spark.createDataFrame([('{"id":"a","type":"gauge","value":2}',), ('[{"id":"a"}]',)], "body STRING")
    out = json_ingest.decode_single_bodies(df).collect()
    assert (out[0].id, out[0].value, out[0].decode_error) == ("a", 2.0, None)
    assert out[1].decode_error is not None


def test_wide_to_long_and_indexed(spark):
    df = spark.createDataFrame([(1, 2.5, 7, [0.5, 1.0])], "sample BIGINT, Alloc DOUBLE, PollCount BIGINT, cpu ARRAY<DOUBLE>")
    long = rows(samples.wide_to_long(df, ["sample"], ["Alloc"], ["PollCount"]), "id", "type", "delta", "value")
    assert long == [("Alloc", "gauge", None, 2.5), ("PollCount", "counter", 7, None)]
    cpu = rows(samples.indexed_gauges(df, ["sample"], "cpu"), "id", "value")
    assert cpu == [("CPUutilization0", 0.5), ("CPUutilization1", 1.0)]


def _local(path):
    return path.removeprefix("file:")


def _write(path, text):
    path = _local(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_snapshot_read_edge_files(spark, scratch):
    base = scratch("snap")
    arr = snapshot.ARRAY_FORMAT
    assert snapshot.read_snapshot_json(spark, f"{base}/missing", arr).count() == 0
    _write(f"{base}/empty/metrics.log", "")
    assert snapshot.read_snapshot_json(spark, f"{base}/empty", arr).count() == 0
    _write(f"{base}/null/metrics.log", "null")
    assert snapshot.read_snapshot_json(spark, f"{base}/null", arr).count() == 0
    _write(f"{base}/dup/metrics.log",
           '[{"id":"a","type":"counter","delta":1},{"id":"b","type":"gauge","value":2},{"id":"a","type":"counter","delta":5}]')
    restored = rows(snapshot.restore_state(spark, f"{base}/dup", arr), "id", "type", "delta", "value")
    assert restored == [("a", "counter", 5, None), ("b", "gauge", None, 2.0)]
    _write(f"{base}/lines/part-0.json", '{"id":"a","type":"counter","delta":1}\n{"id":"a","type":"counter","delta":7}\n')
    assert rows(snapshot.restore_state(spark, f"{base}/lines"), "id", "delta") == [("a", 7)]
    _write(f"{base}/bad/metrics.log", '[{"id":"a",')
    with pytest.raises(Exception, match="malformed snapshot"):
        snapshot.read_snapshot_json(spark, f"{base}/bad", arr).collect()


def test_snapshot_json_roundtrip_gzip(spark, scratch):
    state = spark.createDataFrame([("a", "counter", 3, None), ("b", "gauge", None, 0.25)],
                                  "id STRING, type STRING, delta BIGINT, value DOUBLE")
    path = scratch("json")
    snapshot.write_snapshot_json(state, path)
    assert rows(snapshot.restore_state(spark, path)) == rows(state)
    gz = scratch("gz")
    json_ingest.write_update_files(state, gz, "gzip")
    assert any(n.endswith(".json.gz") for n in os.listdir(_local(gz)))
    assert rows(spark.read.schema("id STRING, type STRING, delta BIGINT, value DOUBLE").json(gz)) == rows(state)


def test_state_base_batches_and_lookup(spark, scratch):
    root = scratch("state")
    assert snapshot.read_state(spark, root).count() == 0
    u = spark.createDataFrame([(1, "a", "counter", 2, None), (2, "b", "gauge", None, 1.0)],
                              "seq BIGINT, id STRING, type STRING, delta BIGINT, value DOUBLE")
    snapshot.publish_state(fold.fold_updates(u), root)
    with pytest.raises(Exception, match="(?i)exists"):
        snapshot.publish_state(fold.fold_updates(u), root)
    for source, batch in (("s1", 0), ("s1", 1), ("s1", 1), ("s2", 0)):  # one replay
        snapshot.write_batch(u, root, source, batch)
    assert rows(snapshot.read_state(spark, root), "id", "delta", "value") == [("a", 8, None), ("b", None, 1.0)]
    one = lookup.lookup_one(snapshot.base_state(spark, root), "a", "counter")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(id,a)" in plan
    assert rows(one, "delta") == [(2,)]
    with pytest.raises(ValueError):
        snapshot.write_batch(u, root, "a/b", 0)


def test_rebase_counts_each_batch_once(spark, scratch):
    old, new, newer = scratch("old"), scratch("new"), scratch("newer")
    u = spark.createDataFrame([(1, "a", "counter", 1, None)], "seq BIGINT, id STRING, type STRING, delta BIGINT, value DOUBLE")
    for batch in range(3):
        snapshot.write_batch(u, old, "s", batch)
    snapshot.rebase(spark, old, new)
    snapshot.write_batch(u, new, "s", 2)  # a replay of what the base holds
    snapshot.write_batch(u, new, "s", 3)
    snapshot.write_batch(u, new, "other", 0)
    assert snapshot.read_state(spark, new).first().delta == 5
    snapshot.rebase(spark, new, newer)
    snapshot.write_batch(u, newer, "s", 3)
    assert snapshot.read_state(spark, newer).first().delta == 5
    # Each file of a base holds a key range: ranges do not overlap.
    many = spark.range(400).selectExpr("id AS seq", "concat('m', id % 50) AS id", "'counter' AS type", "1L AS delta", "CAST(NULL AS DOUBLE) AS value")
    snapshot.publish_state(fold.fold_updates(many), scratch("x") + "/r")


def test_array_files_restore_the_last_copy(spark, scratch):
    data = [(i, f"m{i % 7}", "counter", i, None) for i in range(100)]
    u = spark.createDataFrame(data, "seq BIGINT, id STRING, type STRING, delta BIGINT, value DOUBLE")
    path = scratch("arrays")
    snapshot.write_snapshot_arrays(u.selectExpr("*", "lpad(seq div 9, 5, '0') AS file"), path, "file", "seq")
    got = dict(rows(snapshot.restore_state(spark, path, snapshot.ARRAY_FORMAT), "id", "delta"))
    assert got == {f"m{k}": max(i for i in range(100) if i % 7 == k) for k in range(7)}


def test_files_of_one_name_are_ordered_by_path(spark, scratch):
    base = _local(scratch("paths"))
    for folder, delta in (("a", 1), ("b", 2)):
        os.makedirs(f"{base}/{folder}")
        _write(f"{base}/{folder}/part.json", '{"id":"m","type":"counter","delta":%d}' % delta)
    assert snapshot.restore_state(spark, f"{base}/*").first().delta == 2


def test_a_cluster_must_name_its_folder(spark):
    from tallyfold import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_batches_without_an_id_are_judged_too(spark):
    from tallyfold.operators import validate

    df = spark.createDataFrame([(None, "a", "counter", 1, None), (None, "", "counter", 1, None), (1, "b", "counter", 1, None)],
                               "batch_id BIGINT, id STRING, type STRING, delta BIGINT, value DOUBLE")
    assert rows(validate.accept_batches(validate.validate(df)), "id") == [("b",)]


def test_single_metric_bodies_are_objects(spark):
    df = spark.createDataFrame([(1, 0, "a", "counter", 1, None), (2, 0, "a", "counter", 1, None), (2, 1, "b", "gauge", None, 2.0)],
                               "batch_id BIGINT, pos BIGINT, id STRING, type STRING, delta BIGINT, value DOUBLE")
    got = dict(rows(json_ingest.batch_bodies(df, single_object=True)))
    a = '{"id":"a","type":"counter","delta":1}'
    assert got == {1: a, 2: f'[{a},{{"id":"b","type":"gauge","value":2}}]'}


def test_case_insensitive_keys_and_outcomes(spark):
    bodies = [
        (1, '[{"ID":"a","Type":"counter","DELTA":5},{"id":"b","type":"gauge","Value":1.5}]'),
        (2, '[{"id":"","type":"counter","delta":1}]'),
        (3, '[{"id":"c","type":"counter","delta":"x"}]'),
    ]
    dec = json_ingest.decode_batch_bodies(spark.createDataFrame(bodies, "batch_id BIGINT, body STRING"))
    out = rows(json_ingest.batch_outcomes(dec), "batch_id", "status")
    assert out == [(1, 200), (2, 400), (3, 400)]
    acc = rows(json_ingest.accepted_updates(dec), "batch_id", "pos", "id", "type", "delta", "value")
    assert acc == [(1, 0, "a", "counter", 5, None), (1, 1, "b", "gauge", None, 1.5)]


def test_read_update_files(spark, scratch):
    import gzip

    base = _local(scratch("files"))
    os.makedirs(base)
    with gzip.open(f"{base}/0001.json.gz", "wt") as fh:
        fh.write('[{"id":"a","type":"counter","delta":2},{"id":"a","type":"counter","delta":3}]')
    _write(f"{base}/0002.json", '[{"id":"g","type":"gauge","value":0.5}]')
    _write(f"{base}/0003.json", '{"id":"g","type":"gauge","value":0.5}')
    dec = json_ingest.read_update_files(spark, base)
    errs = dict(rows(dec, "source", "decode_error"))
    assert errs == {"0001.json.gz": None, "0002.json": None, "0003.json": "invalid JSON was passed"}
    got = rows(json_ingest.explode_batches(dec, ["source"]), "source", "pos", "id", "delta", "value")
    assert got == [("0001.json.gz", 0, "a", 2, None), ("0001.json.gz", 1, "a", 3, None), ("0002.json", 0, "g", None, 0.5)]


def test_first_record_error_order_and_null_elements(spark):
    bodies = [
        (1, '[{"id":"a","type":"counter","delta":1},{"id":"","type":"gauge","value":1},{"id":"b","type":"x","delta":1}]'),
        (2, '[null]'),
        (3, '[]'),
        (4, '[{"id":"a","type":"gauge"}]'),
    ]
    dec = json_ingest.decode_batch_bodies(spark.createDataFrame(bodies, "batch_id BIGINT, body STRING"))
    out = dict(rows(json_ingest.batch_outcomes(dec), "batch_id", "error"))
    assert out == {1: "metric name (id) is empty", 2: "metric name (id) is empty", 3: None, 4: "metric has no value"}
    assert json_ingest.accepted_updates(dec).count() == 0


def test_fields_given_twice(spark):
    bodies = ['[{"id":"a","type":"counter","delta":1,"delta":7}]', '[{"id":"a","ID":"b","id":null,"type":"counter","delta":1}]',
              '[{"id":"a","type":"counter","delta":1,"DELTA":"x"}]']
    df = spark.createDataFrame(list(enumerate(bodies)), "batch_id BIGINT, body STRING")
    got = rows(json_ingest.explode_batches(json_ingest.decode_batch_bodies(df), ["batch_id"]), "batch_id", "id", "delta")
    assert got == [(0, "a", 7), (1, "b", 1)]
