"""Property tests against brute force: the fold, the per-update results and the
merge against a sequential simulation of the database upsert; float text against
Python's shortest digits."""

import math
import struct

from conftest import UPDATE_DDL, shortest_plain
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyfold.functions import text
from tallyfold.operators import fold, running

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

update = st.tuples(
    st.sampled_from(["a", "b", "c"]),
    st.sampled_from(["counter", "gauge"]),
    st.one_of(st.none(), st.integers(-1000, 1000)),
    st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)),
)


def sequential(updates):
    """The upsert applied one row at a time: insert as is, else
    ``delta = old + new`` (NULL if either is NULL) and ``value = new``."""
    state, results = {}, []
    for seq, id_, type_, delta, value in updates:
        key = (id_, type_)
        if key not in state:
            state[key] = (delta, value)
        else:
            old = state[key][0]
            state[key] = (None if old is None or delta is None else old + delta, value)
        results.append((seq, id_, type_) + state[key])
    return state, results


@SETTINGS
@given(st.lists(update, min_size=0, max_size=40), st.integers(0, 40))
def test_fold_merge_and_running_match_sequential_upserts(spark, rows_, split):
    data = [(i, *u) for i, u in enumerate(rows_)]
    df = spark.createDataFrame(data, UPDATE_DDL)
    state, results = sequential(data)
    folded = {(r.id, r.type): (r.delta, r.value) for r in fold.fold_updates(df).collect()}
    assert folded == state
    merged = fold.upsert(fold.fold_updates(df.filter(f"seq < {split}")), df.filter(f"seq >= {split}"))
    assert {(r.id, r.type): (r.delta, r.value) for r in merged.collect()} == state
    # Sparse order values: the rows spread over all levels of the prefix tree.
    sparse = df.withColumn("seq", df.seq * (2**47 + 2**33 + 2**17 + 1) - 2**50)
    got = sorted(tuple(r) for r in running.running_result(sparse).select("seq", "id", "type", "delta", "value").collect())
    assert got == sorted((s * (2**47 + 2**33 + 2**17 + 1) - 2**50, *rest) for s, *rest in results)


def go_format(v: float) -> str:
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    return shortest_plain(v)


@SETTINGS
@given(st.lists(st.one_of(st.floats(allow_nan=True, allow_infinity=True),
                          st.integers(0, 2**64 - 1).map(lambda b: struct.unpack("<d", struct.pack("<Q", b))[0])),
                min_size=1, max_size=60))
def test_float_text_is_shortest_plain(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = [r[0] for r in df.select(text.format_float("v")).collect()]
    assert got == [go_format(v) for v in values]


DECIMAL_LITERAL = r"[+-]?([0-9]{1,25}(\.[0-9]{0,25})?|\.[0-9]{1,25})([eE][+-]?[0-9]{1,3})?"
HEX_LITERAL = r"[+-]?0[xX][0-9a-fA-F]{1,15}(\.[0-9a-fA-F]{0,8})?[pP][+-]?[0-9]{1,3}"


def python_parse(t: str):
    v = float.fromhex(t) if "x" in t.lower() else float(t)
    return None if math.isinf(v) else v


@SETTINGS
@given(st.lists(st.one_of(st.from_regex(DECIMAL_LITERAL, fullmatch=True), st.from_regex(HEX_LITERAL, fullmatch=True)),
                min_size=1, max_size=60))
def test_float_parse_matches_correct_rounding(spark, texts):
    from tallyfold.functions import parse

    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in df.select(parse.parse_float("t")).collect()]
    assert got == [python_parse(t) for t in texts]
