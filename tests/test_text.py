"""Text of values (F3-F7), listing and path export."""

from conftest import rows, shortest_plain

from tallyfold.functions import text
from tallyfold.operators import report


def fmt(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    return [r[0] for r in df.select(text.format_float("v")).collect()]


def test_reference_value_texts(spark):
    assert fmt(spark, [10.0, 123.229]) == ["10", "123.229"]


def test_edge_value_texts(spark):
    values = [1747530766378014200.0, 1e21, 1e-7, -0.0, 5e-324, float("inf"), float("-inf"), float("nan"),
              0.0, 1.5e-5, 0.002, 12345678.9, -2.5, 2.0**60]
    expected = ["1747530766378014200", "1000000000000000000000", "0.0000001", "-0", "0." + "0" * 323 + "5",
                "+Inf", "-Inf", "NaN", "0", "0.000015", "0.002", "12345678.9", "-2.5", "1152921504606847000"]
    assert fmt(spark, values) == expected


def test_shortest_digits_random(spark):
    import random

    rnd = random.Random(7)
    vals = [rnd.uniform(-1e6, 1e6) for _ in range(300)] + [rnd.random() * 10 ** rnd.randint(-12, 25) for _ in range(300)]
    got = fmt(spark, vals)
    assert got == [shortest_plain(v) for v in vals]


def test_wide_texts_against_python(spark):
    """Every exponent, subnormals, powers of two and ten, and integers around 2**53 to 2**63."""
    import random
    import struct

    rnd = random.Random(11)
    vals = [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(3000)]
    vals += [float(rnd.randrange(2**53, 2**63)) for _ in range(1500)] + [10.0**k for k in range(-323, 309)] + [2.0**k for k in range(-1074, 1024)]
    vals += [struct.unpack("<d", struct.pack("<Q", k))[0] for k in (*range(1, 200), *(rnd.getrandbits(52) for _ in range(300)))]
    vals = [v for v in vals if v == v and abs(v) != float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i INT, v DOUBLE")
    got = df.select("i", text.format_float("v").alias("f"), text.json_float("v").alias("j"), text.round_half_even_text("v").alias("r")).orderBy("i").collect()
    assert [r.f for r in got] == [shortest_plain(v) for v in vals]
    assert [float(r.j) for r in got] == vals
    assert [r.r for r in got] == [f"{v:.0f}" for v in vals]


def test_line_separators_are_escaped(spark):
    df = spark.createDataFrame([("a\u2028b\u2029c", "gauge", None, 1.0)], "id STRING, type STRING, delta BIGINT, value DOUBLE")
    assert df.select(text.metric_json().alias("j")).first().j == '{"id":"a\\u2028b\\u2029c","type":"gauge","value":1}'


def test_value_text_and_debug(spark):
    df = spark.createDataFrame(
        [("a", "counter", 527, None), ("b", "gauge", None, 2.5), ("c", "gauge", None, None), ("d", "other", 1, 1.0)],
        "id STRING, type STRING, delta BIGINT, value DOUBLE",
    )
    out = rows(df.select("id", text.value_text().alias("t"), text.debug_text().alias("d")))
    assert out == [
        ("a", "527", "{ID: a, MType: counter, Delta: 527}"),
        ("b", "2.5", "{ID: b, MType: gauge, Value: 2}"),
        ("c", "", None),
        ("d", "", "{ID: d, MType: other, Delta: 1}"),
    ]


def test_metric_json(spark):
    df = spark.createDataFrame(
        [("a<&>", "counter", 5, None), ("g", "gauge", None, 1e21), ("h", "gauge", None, 1.5e-7),
         ("n", "gauge", None, float("nan")), ("z", "gauge", None, 10.0)],
        "id STRING, type STRING, delta BIGINT, value DOUBLE",
    )
    out = dict((r[0], r[1]) for r in df.select("id", text.metric_json().alias("j")).collect())
    assert out["a<&>"] == '{"id":"a\\u003c\\u0026\\u003e","type":"counter","delta":5}'
    assert out["g"] == '{"id":"g","type":"gauge","value":1e+21}'
    assert out["h"] == '{"id":"h","type":"gauge","value":1.5e-7}'
    assert out["n"] is None
    assert out["z"] == '{"id":"z","type":"gauge","value":10}'


def test_path_export_reference_cases(spark):
    df = spark.createDataFrame(
        [("someMetric", "counter", 527, None), ("someMetric", "gauge", None, 12779.105),
         ("someMetric", "gauge", None, 575962.373), ("someMetric", "gauge", None, 369111.063),
         ("x", "counter", None, 1.0), ("y", "gauge", None, None), ("z", "hist", 1, 1.0)],
        "id STRING, type STRING, delta BIGINT, value DOUBLE",
    )
    path, error = report.export_path()
    out = [(r.path, r.error is not None) for r in df.select(path.alias("path"), error.alias("error")).collect()]
    assert out[:4] == [("/update/counter/someMetric/527", False), ("/update/gauge/someMetric/12779.105", False),
                       ("/update/gauge/someMetric/575962.373", False), ("/update/gauge/someMetric/369111.063", False)]
    assert out[4:] == [(None, True)] * 3


def test_listing_and_count(spark):
    df = spark.createDataFrame([("a", "counter", 3, None), ("b", "gauge", None, 0.5)],
                               "id STRING, type STRING, delta BIGINT, value DOUBLE")
    assert rows(report.listing(df), "line") == [("ID: a Type: counter Value: 3",), ("ID: b Type: gauge Value: 0.5",)]
    assert report.metric_count(df).collect()[0].total == 2


def test_debug_rounding(spark):
    vals = [0.5, 1.5, 2.5, -0.4, -2.5, 1747530766378014200.0, 3.7]
    df = spark.createDataFrame([(v,) for v in vals], "v DOUBLE")
    got = [r[0] for r in df.select(text.round_half_even_text("v")).collect()]
    assert got == ["0", "2", "2", "-0", "-2", "1747530766378014208", "4"]
