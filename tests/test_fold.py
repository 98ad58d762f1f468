"""Fold semantics (A1-A3, J1, W1, A7) on hand-written edge rows."""

import pytest
from conftest import UPDATE_DDL, rows
from pyspark.sql import functions as F

from tallyfold.operators import fold, running


def upd(spark, data):
    return spark.createDataFrame(data, UPDATE_DDL)


def state_of(df):
    return {(r.id, r.type): (r.delta, r.value) for r in df.collect()}


def test_counter_sums_and_running_result(spark):
    u = upd(spark, [(1, "c", "counter", 5, None), (2, "c", "counter", 7, None), (3, "c", "counter", -2, None)])
    assert state_of(fold.fold_updates(u)) == {("c", "counter"): (12 - 2, None)}
    assert rows(running.running_result(u), "seq", "delta") == [(1, 5), (2, 12), (3, 10)]


def test_gauge_last_write_wins_zero_and_null(spark):
    zero = upd(spark, [(1, "g", "gauge", None, 1.5), (2, "g", "gauge", None, 0.0)])
    assert state_of(fold.fold_updates(zero)) == {("g", "gauge"): (None, 0.0)}
    null = upd(spark, [(1, "g", "gauge", None, 1.5), (2, "g", "gauge", None, None)])
    assert state_of(fold.fold_updates(null)) == {("g", "gauge"): (None, None)}


def test_null_delta_propagates(spark):
    u = upd(spark, [(1, "c", "counter", 5, None), (2, "c", "counter", None, 1.5), (3, "c", "counter", 4, None)])
    assert state_of(fold.fold_updates(u)) == {("c", "counter"): (None, None)}
    assert rows(running.running_result(u), "seq", "delta") == [(1, 5), (2, None), (3, None)]


def test_same_id_two_types_two_rows(spark):
    u = upd(spark, [(1, "x", "counter", 1, None), (2, "x", "gauge", None, 2.0), (3, "y", "gauge", None, 1.0)])
    assert len(fold.fold_updates(u).collect()) == 3
    assert rows(fold.type_conflicts(u), "id", "first_type", "n_counter", "n_gauge") == [("x", "counter", 1, 1)]


def test_counter_overflow_raises(spark):
    u = upd(spark, [(1, "c", "counter", 9223372036854775807, None), (2, "c", "counter", 1, None)])
    for form in (fold.fold_updates(u), fold.upsert(fold.fold_updates(u.filter("seq = 1")), u.filter("seq = 2")),
                 running.running_result(u)):
        with pytest.raises(Exception, match="(?i)overflow|cannot be represented|out of range"):
            form.collect()


def test_empty_batch_and_repeated_key(spark):
    empty = upd(spark, [])
    assert fold.fold_updates(empty).count() == 0
    rep = upd(spark, [(i, "k", "counter", 1, None) for i in range(50)])
    assert state_of(fold.fold_updates(rep)) == {("k", "counter"): (50, None)}


def test_merge_equals_single_fold(spark):
    data = [(i, f"m{i % 7}", "counter" if i % 3 else "gauge", i if i % 3 else None, None if i % 3 else i / 4)
            for i in range(200)]
    data += [(300, "m1", "counter", None, None)]
    u = upd(spark, data)
    full = state_of(fold.fold_updates(u))
    early, late = u.filter("seq < 120"), u.filter("seq >= 120")
    merged = state_of(fold.upsert(fold.fold_updates(early), late))
    assert merged == full
    # Merge order does not matter for gauges: the later seq wins.
    reverse = state_of(fold.upsert(fold.fold_updates(late), early))
    assert reverse == full


def test_upsert_into_state_without_seq(spark):
    state = spark.createDataFrame([("c", "counter", 10, None), ("g", "gauge", None, 1.0)],
                                  "id STRING, type STRING, delta BIGINT, value DOUBLE")
    u = upd(spark, [(1, "c", "counter", 5, None), (2, "g", "gauge", None, 2.0), (3, "n", "counter", 1, None)])
    assert state_of(fold.upsert(state, u)) == {
        ("c", "counter"): (15, None), ("g", "gauge"): (None, 2.0), ("n", "counter"): (1, None)}


def test_running_result_seeded_and_skewed(spark):
    """W1 with a hot key spread over many seq buckets equals the plain window."""
    n = 3000
    data = [(i, "hot" if i % 5 else f"k{i % 11}", "counter", None if i in (700, 2900) else i % 13, None)
            for i in range(n)]
    u = upd(spark, data)
    from pyspark.sql import Window

    w = Window.partitionBy("id", "type").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = u.select(
        "seq", "id", "type",
        F.when(F.count(F.when(F.col("delta").isNull(), 1)).over(w) == 0, F.sum("delta").over(w)).alias("delta"),
        "value",
    )
    bucketed = running.running_result(u)
    assert rows(bucketed) == rows(plain.select(*bucketed.columns))
    state = fold.fold_updates(u.filter("seq < 1000"))
    seeded = running.running_result(u.filter("seq >= 1000"), state=state)
    assert rows(seeded) == rows(plain.filter("seq >= 1000").select(*seeded.columns))


def test_a_hot_key_crosses_partition_borders(spark):
    """With 8 range partitions left as they are, a key of two thirds of all rows lies in several of them."""
    data = [(i * (1 if i < 900 else 2**40), "hot" if i % 3 else f"k{i % 40:02d}", "counter", None if i == 1100 else 2**62 - i, None) for i in range(1200)]
    u = upd(spark, data)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        parts = u.repartitionByRange("id", "type", "seq").select("id", F.spark_partition_id().alias("p")).filter("id = 'hot'").distinct().count()
        got = running.running_result(u.withColumn("delta", F.col("delta") % 1000)).collect()
        seeds = spark.createDataFrame([("hot", "counter", 7, None), ("k00", "counter", None, None), ("other", "counter", 1, None)], "id STRING, type STRING, delta BIGINT, value DOUBLE")
        seeded = running.running_result(u.withColumn("delta", F.col("delta") % 1000), state=seeds).collect()
    finally:
        spark.conf.unset(setting)
    assert parts > 2
    sums, want = {}, {}
    for seq, key, _, d, _ in data:
        old = sums.get(key, 0)
        sums[key] = None if d is None or old is None else old + d % 1000
        want[seq] = sums[key]
    assert {r.seq: r.delta for r in got} == want
    more = {"hot": 7, "k00": None}
    ids = {row[0]: row[1] for row in data}
    assert {r.seq: r.delta for r in seeded} == {
        q: None if w is None or more.get(ids[q], 0) is None else w + more.get(ids[q], 0) for q, w in want.items()
    }


def test_equal_order_values_have_an_order(spark):
    u = upd(spark, [(1, "a", "counter", 5, None), (1, "a", "counter", 2, 1.0), (None, "a", "counter", 1, None)])
    assert rows(running.running_result(u), "seq", "delta") == [(1, 3), (1, 8), (None, 1)]


def test_sparse_order(spark):
    """A hot key with sparse order values."""
    data = [(i * 1_000_000_007 - 10**12, "hot", "counter", None if i == 450 else i, None) for i in range(500)]
    got = {r.seq: r.delta for r in running.running_result(upd(spark, data)).collect()}
    total = 0
    for seq, _, _, d, _ in data:
        total = None if d is None or total is None else total + d
        assert got[seq] == total


def test_rows_without_key_or_value_stay(spark):
    u = upd(spark, [(1, None, "counter", 1, None), (2, None, "counter", 2, None), (3, "a", None, None, 2.0)])
    got = {(r.seq, r.id, r.type, r.delta, r.value) for r in running.running_result(u).collect()}
    assert got == {(1, None, "counter", 1, None), (2, None, "counter", 3, None), (3, "a", None, None, 2.0)}


def test_partial_sums_may_leave_int64(spark):
    """One rule for every form: only the total has to fit."""
    big = 2**63 - 1
    u = upd(spark, [(1, "c", "counter", big, None), (2, "c", "counter", 5, None), (3, "c", "counter", -10, None)])
    want = {("c", "counter"): (big - 5, None)}
    for n in (1, 3, 8):
        assert state_of(fold.fold_updates(u.repartition(n, "seq"))) == want
    halves = fold.fold_updates(u.filter("seq = 1")), fold.fold_updates(u.filter("seq > 1"))
    assert state_of(fold.fold_states(halves[0].unionByName(halves[1]))) == want
    assert state_of(fold.merge_folded(*halves)) == want
    last = running.running_result(u.filter("seq > 1"), state=halves[0]).filter("seq = 3")
    with pytest.raises(Exception, match="(?i)overflow|cannot be represented|out of range"):
        running.running_result(u).collect()  # the result after update 2 does not fit
    assert last.count() == 1


def test_fold_states_equals_sequential_merges(spark):
    data = [(i, f"m{i % 6}", "counter" if i % 2 else "gauge", None if i in (33, 71) else i, i / 3) for i in range(120)]
    u = upd(spark, data)
    parts = [fold.fold_updates(u.filter(f"seq >= {lo} AND seq < {lo + 40}")) for lo in (0, 40, 80)]
    seq_merge = fold.merge_folded(fold.merge_folded(parts[0], parts[1]), parts[2])
    one_agg = fold.fold_states(parts[2].unionByName(parts[0]).unionByName(parts[1]))
    assert state_of(one_agg) == state_of(seq_merge) == state_of(fold.fold_updates(u))
    restored = spark.createDataFrame([("m1", "counter", 1000, 9.0, None)],
                                     "id STRING, type STRING, delta BIGINT, value DOUBLE, seq BIGINT")
    merged = state_of(fold.fold_states(restored.unionByName(parts[0])))
    assert merged[("m1", "counter")] == state_of(fold.merge_folded(restored, parts[0]))[("m1", "counter")]


def test_overflow_modes(spark):
    big = 9223372036854775807
    u = upd(spark, [(1, "c", "counter", big, None), (2, "c", "counter", 1, None), (3, "c", "counter", -5, None)])
    assert state_of(fold.fold_updates(u, overflow="final")) == {("c", "counter"): (big - 4, None)}
    wrap = upd(spark, [(1, "c", "counter", big, None), (2, "c", "counter", 1, None)])
    assert state_of(fold.fold_updates(wrap, overflow="wrap")) == {("c", "counter"): (-(2**63), None)}
    with pytest.raises(Exception, match="(?i)overflow|cannot be represented|out of range"):
        fold.fold_updates(wrap, overflow="final").collect()
    p = fold.fold_updates(u, overflow="final")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in p and "SortAggregate" not in p


def test_duplicate_keys_check(spark):
    u = upd(spark, [(1, "a", "counter", 1, None), (2, "a", "counter", 2, None), (3, "b", "gauge", None, 1.0)])
    assert fold.duplicate_keys(fold.fold_updates(u)).count() == 0
    assert rows(fold.duplicate_keys(u), "id", "rows") == [("a", 2)]


def test_keep_last_defines_ties_and_null_order(spark):
    from tallyfold.operators import dedup

    u = upd(spark, [(1, "a", "counter", 5, None), (1, "a", "gauge", 2, 1.0), (None, "b", "counter", 1, None), (None, "b", "counter", 2, None), (3, None, "gauge", 1, None)])
    assert rows(dedup.keep_last(u, ["id"], "seq"), "id", "seq", "type", "delta") == [("a", 1, "gauge", 2), ("b", None, "counter", 2), (None, 3, "gauge", 1)]
    assert dedup.keep_last(u, ["id"], "seq").columns == ["id", "seq", "type", "delta", "value"]


def test_latest_sample_drops_ids_that_are_gone(spark):
    from tallyfold.operators import dedup

    data = [(1, 10, "x", 1), (1, 20, "y", 2), (1, 20, "y", 3), (2, 5, "x", 4), (None, 1, "x", 5), (None, 2, "z", 6)]
    df = spark.createDataFrame(data, "w INT, ts INT, id STRING, seq INT")
    assert rows(dedup.latest_sample(df, "w"), "w", "id", "seq") == [(1, "y", 3), (2, "x", 4), (None, "z", 6)]


def test_store_by_id_against_a_sequential_one(spark):
    import random

    rng, data = random.Random(5), []
    for i in range(400):
        kind = rng.choice(["counter", "gauge"])
        data.append((i, f"m{rng.randrange(40)}", kind, rng.choice([None, rng.randrange(9), rng.randrange(9)]), rng.choice([None, rng.random()])))
    store = {}
    for _, id_, kind, delta, value in data:
        if id_ not in store:
            store[id_] = [kind, delta, value]
        elif kind == "gauge":
            store[id_][2] = value
        elif delta is not None and store[id_][1] is not None:
            store[id_][1] += delta
    got = {r.id: [r.type, r.delta, r.value] for r in fold.fold_by_id(upd(spark, data).repartition(5)).collect()}
    assert got == store
