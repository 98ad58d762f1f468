"""Plan shape: partial aggregation, pruned scans, bounded windows, no Python in folds."""

from conftest import SF_SMALL

from tallyfold.plans import queries as q


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_is_partial_hash_aggregate(spark):
    p = plan(q.q_metric_state(spark, SF_SMALL))
    assert "HashAggregate" in p and "partial_sum" in p and "partial_max_by" in p
    assert "SortAggregate" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(q.q_metric_state(spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double,props:string>" in p


def test_running_result_scans_once_and_deals_rows_twice(spark):
    df = q.q_running_result(spark, SF_SMALL)
    initial = plan(df)
    # Range partitioning, (partition, key), and the totals by key; both readers of the pieces share the first two.
    assert "BroadcastExchange" in initial and "strategy=" not in initial
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and final.count("Exchange rangepartitioning") == 1
    # The totals have no rows of a second piece here, so no exchange of theirs is left to count.
    assert final.count("Exchange hashpartitioning(_part") == 1 and final.count("Exchange hashpartitioning(_k_id") <= 1
    assert "LeftSemi" in plan(q.q_running_seeded(spark, SF_SMALL))


def test_state_is_picked_before_it_is_folded_and_not_dealt_by_source(spark, scratch):
    from pyspark.sql import functions as F

    from tallyfold.operators import fold, running
    from tallyfold.plans import queries
    from tallyfold.sources import snapshot

    root, u = scratch("root"), queries._updates(spark, SF_SMALL)
    snapshot.publish_state(fold.fold_updates(u.filter("seq % 2 = 0")), root)
    for n in range(3):
        snapshot.write_batch(u.filter(f"seq % 6 = {2 * n + 1}"), root, "s", n)
    batch = u.filter("seq % 50 = 1")
    keys = F.broadcast(batch.select("id", "type").distinct())
    p = plan(running.running_result(batch, state=snapshot.state_before(spark, root, "s", 2, keys), picked=True))
    assert "source" not in p.replace("source=s", "")
    # The semi join reads the folders themselves, below the aggregate that folds them.
    fold_at = p.index("partial_sum(cast(delta")
    assert "BroadcastHashJoin" in p[fold_at:] and "LeftSemi" in p[fold_at:]
    assert "hashpartitioning(source" not in plan(snapshot.read_state(spark, root))


def test_batch_rejection_is_anti_join(spark):
    p = plan(q.q_accepted_state(spark, SF_SMALL))
    assert "LeftAnti" in p


def test_no_python_in_core_paths(spark):
    for name in ("metric_state", "upsert_merge", "upsert_merge_union", "running_result", "accepted_state",
                 "keep_last", "path_ingest", "hmac_check", "report_window", "wide_to_long"):
        p = plan(getattr(q, f"q_{name}")(spark, SF_SMALL))
        assert "EvalPython" not in p, name


def test_keep_last_and_latest_sample_read_once(spark):
    for name in ("keep_last", "latest_sample_wide"):
        p = plan(getattr(q, f"q_{name}")(spark, SF_SMALL))
        assert "Join" not in p and p.count("FileScan") == 1 and "partial_max" in p and "Window" not in p, name
    # The window's newest time is found among the last rows of each id, not among all rows.
    p = plan(q.q_latest_sample(spark, SF_SMALL))
    assert "LeftSemi" in p and "Window [" not in p and p.index("partial_max(struct(ts") > p.index("LeftSemi")


def test_texts_stay_in_the_jvm(spark):
    for name in ("debug_text", "gauge_text", "gauge_text_wide", "value_text", "metric_json", "listing", "path_export", "lookup_bulk", "lookup_json",
                 "json_batch_ingest", "agent_reports"):
        assert "EvalPython" not in plan(getattr(q, f"q_{name}")(spark, SF_SMALL)), name


def test_point_lookup_filters_reach_the_published_scan(spark):
    p = plan(q.q_lookup_state(spark, SF_SMALL))
    assert "EqualTo(id,click_8)" in p and "EqualTo(type,counter)" in p


def test_no_forced_broadcast(spark):
    for name in ("upsert_merge", "lookup_bulk", "accepted_state", "running_seeded"):
        assert "strategy=broadcast" not in getattr(q, f"q_{name}")(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString(), name


def test_a_merge_into_buckets_moves_the_updates_only(spark):
    p = plan(q.q_upsert_merge_buckets(spark, SF_SMALL))
    lines = p[p.index("FullOuter"):].splitlines()
    first, second = [i for i, line in enumerate(lines) if "FileScan" in line]
    assert "Bucketed: true" in lines[first] and "Bucketed: true" not in lines[second]
    assert not any("Exchange" in line for line in lines[:first])
    # The updates are folded by Spark's own number of partitions, and their few rows a key dealt to the buckets.
    assert sum("Exchange" in line for line in lines[first:second]) == 2


def test_an_id_that_is_absent_reads_no_row_group(spark, scratch):
    """The id lies inside of the range of the file's ids, so only the Bloom filter can tell."""
    from pyspark.sql import functions as F

    from tallyfold.operators import lookup
    from tallyfold.sources import snapshot

    root = scratch("bloom")
    ids = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("id"), F.lit("counter").alias("type"), F.col("id").alias("delta"), F.lit(None).cast("double").alias("value"))
    snapshot.publish_state(ids, root)

    def rows_read(id_: str) -> tuple[int, int]:
        df = lookup.lookup_one(snapshot.base_state(spark, root), id_, "counter")
        found, executed = len(df.collect()), df._jdf.queryExecution().executedPlan()
        scans = executed.collectLeaves()
        return found, scans.apply(0).metrics().apply("numOutputRows").value()

    some = ids.first().id
    assert rows_read(some)[0] == 1 and rows_read(some)[1] > 0
    assert rows_read("7" + "0" * 39) == (0, 0)


def test_the_store_by_id_is_one_hash_aggregate(spark):
    p = plan(q.q_id_store_state(spark, SF_SMALL))
    assert "HashAggregate" in p and "SortAggregate" not in p and "ObjectHashAggregate" not in p and p.count("Exchange") == 1


def test_only_requested_state_rows_leave_the_scan(spark, scratch):
    from pyspark.sql import functions as F

    from tallyfold.operators import lookup
    from tallyfold.sources import snapshot

    root = scratch("requested")
    state = spark.range(20000).select(F.concat(F.lit("m"), "id").alias("id"), F.lit("counter").alias("type"), F.col("id").alias("delta"), F.lit(None).cast("double").alias("value"))
    snapshot.publish_state(state.unionByName(spark.createDataFrame([(None, "counter", 1, None)], "id STRING, type STRING, delta BIGINT, value DOUBLE")), root)
    base = snapshot.base_state(spark, root)
    asked = spark.createDataFrame([(i, f"m{i * 37}", "counter") for i in range(100)] + [(900, None, "counter"), (901, "m1", "gauge")], "request_id INT, id STRING, type STRING")
    kept = lookup.requested(base, asked)
    ids = {r.id for r in kept.collect()}
    assert {f"m{i * 37}" for i in range(100)} | {None} <= ids and len(ids) < 120 and kept.columns == base.columns
    assert lookup.requested(base, asked.filter("id = 'none'")).count() == 0
    p = plan(lookup.lookup(asked, kept.select("id", "type", "delta", "value")))
    # The bitmap is broadcast to the scan; the join by key comes above it.
    at = p.index("FileScan parquet")
    assert "bitmap_construct_agg" in p and "Exchange hashpartitioning(id" not in p[p.index("_bits"):at]
    got = lookup.lookup(asked, kept.select("id", "type", "delta", "value")).filter("found").count()
    assert got == 100


def test_large_deltas_are_folded_in_every_form_and_by_many_tasks(spark):
    df = q.q_metric_state_large(spark, SF_SMALL)
    by_form = {}
    for r in df.collect():
        by_form.setdefault(r.form, set()).add((r.id, r.type, r.delta, r.value))
    assert set(by_form) == {"one", "seven", "spread", "merged", "states"}
    assert len({frozenset(v) for v in by_form.values()}) == 1
    p = plan(df)
    # A key's rows lie in one partition or in seven, and no partition holds all keys.
    assert "REPARTITION_BY_COL" in p and "REPARTITION_BY_NUM" in p and "Coalesce" not in p and "SinglePartition" not in p
