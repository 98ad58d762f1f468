"""Parsing (F1, F2), path ingest (S3), validation and outcomes (P3-P7), signing."""

import hashlib
import hmac

import pytest
from conftest import rows

from tallyfold.functions import errors, parse, sign
from tallyfold.operators import validate
from tallyfold.sources import path_ingest


def test_reference_path_cases(spark):
    reqs = spark.createDataFrame(
        [(1, "/update/counter/someMetric/527"), (2, "/update/gauge/Alloc/9999999"), (3, "/update/gauge/9999999"),
         (4, "/update/otherType/Alloc/9999999"), (5, "/update/otherType/Alloc/wrongValue"),
         (6, "/update/counter//5"), (7, "/update/gauge/a/NaN"), (8, "/update/counter/a/1.5"), (9, "/update/gauge/a/")],
        "seq BIGINT, path STRING",
    )
    out = {r.seq: r for r in path_ingest.ingest_paths(reqs).collect()}
    assert [out[i].status for i in range(1, 10)] == [200, 200, 404, 400, 400, 404, 400, 400, 400]
    assert (out[1].id, out[1].type, out[1].delta, out[1].value) == ("someMetric", "counter", 527, None)
    assert (out[2].id, out[2].type, out[2].delta, out[2].value) == ("Alloc", "gauge", None, 9999999.0)


def test_parse_literals(spark):
    texts = ["5", "+5", "-7", "1.5", " 1", "1d", "0x10", "1e3", "1e400", "9223372036854775807",
             "9223372036854775808", "NaN", "Inf", "", "abc", "-inf", ".5", "5.", "0x1p-2", "Infinity", "+nan"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = df.select("t", parse.parse_int("t").alias("i"), parse.parse_float("t").alias("f")).collect()
    ints = {r.t: r.i for r in got}
    floats = {r.t: r.f for r in got}
    assert ints == {"5": 5, "+5": 5, "-7": -7, "1.5": None, " 1": None, "1d": None, "0x10": None, "1e3": None,
                    "1e400": None, "9223372036854775807": 9223372036854775807, "9223372036854775808": None,
                    "NaN": None, "Inf": None, "": None, "abc": None, "-inf": None, ".5": None, "5.": None,
                    "0x1p-2": None, "Infinity": None, "+nan": None}
    assert floats["1e3"] == 1000.0 and floats[".5"] == 0.5 and floats["5."] == 5.0 and floats["0x1p-2"] == 0.25
    assert floats["Inf"] == float("inf") and floats["-inf"] == float("-inf") and floats["Infinity"] == float("inf")
    assert floats["NaN"] != floats["NaN"]  # NaN
    for bad in [" 1", "1d", "0x10", "1e400", "", "abc", "+nan"]:
        assert floats[bad] is None, bad


def test_validation_order_and_subset(spark):
    df = spark.createDataFrame(
        [(1, "", "", None, None), (2, "a", "", None, None), (3, "a", "hist", None, None), (4, "a", "gauge", None, None),
         (5, "a", "counter", None, 1.5), (6, None, "gauge", None, 1.0)],
        "seq BIGINT, id STRING, type STRING, delta BIGINT, value DOUBLE",
    )
    full = dict(rows(validate.validate(df), "seq", "error"))
    assert full == {1: "metric name (id) is empty", 2: "metric type is empty", 3: "metric type is not valid",
                    4: "metric has no value", 5: None, 6: "metric name (id) is empty"}
    types_first = dict(rows(validate.validate(df, ["type", "id"]), "seq", "error"))
    assert types_first[1] == "metric type is empty" and types_first[4] is None
    with pytest.raises(ValueError):
        validate.validation_error(["name"])


def test_batch_all_or_nothing(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, "a", "counter", 1, None), (2, 0, 1, "", "counter", 1, None), (3, 1, 0, "b", "gauge", None, 2.0),
         (4, 1, 1, "b", "gauge", None, 3.0), (5, 2, 0, "c", "histogram", 1, None), (6, 2, 1, "c", "counter", None, None)],
        "seq BIGINT, batch_id BIGINT, pos BIGINT, id STRING, type STRING, delta BIGINT, value DOUBLE",
    )
    v = validate.validate(df)
    assert [r.seq for r in validate.accept_batches(v).orderBy("seq").collect()] == [3, 4]
    first = {r.batch_id: (r.first_pos, r.error, r.n_bad) for r in validate.first_errors(v).collect()}
    assert first == {0: (1, "metric name (id) is empty", 1), 2: (0, "metric type is not valid", 2)}


def test_status_codes(spark):
    df = spark.createDataFrame([("metric type is empty",), (None,), ("metric is not found",), ("boom",)], "error STRING")
    out = [r[0] for r in df.select(validate.status_code(validate.JSON_LOOKUP)).collect()]
    assert out == [404, 200, 404, 500]
    out = [r[0] for r in df.select(validate.status_code(validate.VALUE_LOOKUP)).collect()]
    assert out == [400, 200, 404, 500]


@pytest.mark.parametrize("key", ["k", "secret-key", "x" * 100])
def test_hmac_matches_python(spark, key):
    bodies = ['{"k": 1}', "", "[{\"id\":\"a\"}]", "päyload"]
    df = spark.createDataFrame([(b,) for b in bodies], "b STRING")
    got = [r[0] for r in df.select(sign.hmac_sha256_hex("b", key)).collect()]
    assert got == [hmac.new(key.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]


def test_signature_check(spark):
    good = hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("body", good), ("body", "00"), ("body", ""), ("body", None)], "b STRING, s STRING")
    assert [r[0] for r in df.select(sign.signature_ok("b", "s", "k")).collect()] == [True, False, True, True]
    assert [r[0] for r in df.select(sign.signature_ok("b", "s", None)).collect()] == [True] * 4


def test_sqlstate_classes(spark):
    df = spark.createDataFrame([("40P01",), ("08006",), ("23505",), ("XX999",), (None,)], "s STRING")
    got = [r[0] for r in df.select(errors.classify_sqlstate("s")).collect()]
    assert got == ["retryable", "retryable", "non_retryable", "non_retryable", "non_retryable"]
