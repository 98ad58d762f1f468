import numpy as np
from tallyfold.llm.top_k import search_block, pivot_distances, choose_pivots, top_k

DDL = "vec_id long, embedding array<float>, score string, id int"


def brute(rows, k=5, every=50):
    vs = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    out = set()
    for q, x in vs:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in vs if j != q)[:k]
            out |= {(q, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def test_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], DDL)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, lambda i: i % 50 == 0).collect()}
    assert got == brute(rows)


def test_elimination_skips_candidates():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (20, 8))
    x = centres[rng.integers(0, 20, 4000)] + rng.integers(-3, 4, (4000, 8))
    p = choose_pivots(x[:500])
    d = pivot_distances(x, p)
    found, evaluated = search_block(np.arange(4000), x, d, np.arange(3), x[:3], d[:3], 5)
    for q in range(3):
        s = x @ x[q]
        best = sorted((-int(v), i) for i, v in enumerate(s) if i != q)[:5]
        assert [(f[1], f[2]) for f in found if f[0] == q] == [(i, -v) for v, i in best]
    assert evaluated < 3 * 4000


def test_long_vectors_close_together_are_exact(spark):
    """Components far beyond 2^31 whose differences decide: no bound may cut a neighbour off."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(2**13 + x / 64)) for x in rng.integers(-40, 40, 4)]) for i in range(150)]
    rows += [(200 + i, [float(np.float32(2**23 * s)), 1.0, float(i), 0.0]) for i, s in enumerate((1, -1, 1, 1, -1))]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], DDL)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, lambda i: i % 50 == 0).collect()}
    assert got == brute(rows)


def test_results_are_merged_over_many_blocks(spark, monkeypatch):
    from tallyfold.llm import top_k as module

    monkeypatch.setattr(module, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(module, "QUERY_BLOCK", 2)
    monkeypatch.setattr(module, "MERGED_BLOCKS", 3)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(400)]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], DDL)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, lambda i: i % 50 == 0).collect()} == brute(rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0], "a", 1), (1, [2.0], "a", 1), (1, [2.0], "a", 1), (2, None, "a", 1), (3, [], "a", 1), (4, [nan, 1.0], "a", 1)]
    data += [(5, [inf], "a", 1), (6, [None, 1.0], "a", 1), (None, [1.0, 1.0], "a", 1), (50, None, "a", 1)]
    got = top_k(spark.createDataFrame(data, DDL), lambda i: i % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512)]
    assert top_k(spark.createDataFrame([], DDL), lambda i: i % 50 == 0).count() == 0


def test_what_tasks_send_to_the_driver_does_not_grow_with_the_tasks(spark):
    """Each task once sent its own 2000 vectors of the pivots' sample."""
    df = spark.range(20000).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> float((xxhash64(id, i) % 1000) / 1000)) AS embedding")
    conf = spark.sparkContext._jsc.sc().conf()
    was = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")
    try:
        got = top_k(df, lambda i: i % 5000 == 0).collect()
    finally:
        conf.set("spark.driver.maxResultSize", was)
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(np.int64) for r in df.collect()}
    ids, m = np.array(list(x)), np.array(list(x.values()))
    want = set()
    for i in range(0, 20000, 5000):
        found = sorted((-int(s), int(j)) for s, j in zip(m @ x[i], ids) if j != i)[:5]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    assert {tuple(r) for r in got} == want


def test_rows_that_go_to_every_block_stay_small(spark):
    from tallyfold.llm.top_k import _packed, _unpacked, integer_vectors

    rows = [(i, [float(i % 7)] * (1 + i % 3) + [2.0**20 * (i % 50 == 0), 2.0**30 * (i % 40 == 0)], "s", 1) for i in range(300)]
    packs = _packed(integer_vectors(spark.createDataFrame(rows, DDL).coalesce(1)), 5, 16).collect()
    assert max(len(p.vectors) for p in packs) <= 8 * 5 * 16 and min(len(p.vectors) for p in packs) <= 4 * 5 * 16
    ids, x = _unpacked([tuple(map(memoryview, map(bytes, p))) for p in packs], 5)
    want = {i: [int(256 * c) for c in v] + [0] * (5 - len(v)) for i, v, *_ in rows}
    assert dict(zip(ids.tolist(), x.tolist(), strict=True)) == want


def test_blocks_of_mixed_sizes_ties_and_repeated_ids_are_exact():
    rng = np.random.default_rng(9)
    for big in (2**10, 2**25, 2**29):
        x = np.where(rng.random((300, 1)) < 0.2, rng.integers(-big, big, (300, 6)), rng.integers(-3, 4, (300, 6)))
        ids, asks = rng.integers(0, 200, 300), np.arange(0, 300, 9)
        p = choose_pivots(x[:100])
        d = pivot_distances(x, p)
        found, _ = search_block(ids, x, d, ids[asks], x[asks], d[asks], 4)
        want = []
        for i in asks:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(x[i], y)), int(j)) for j, y in zip(ids, x) if j != ids[i])[:4]
            want += [(int(ids[i]), j, -s) for s, j in scored]
        assert found == want
    x = np.array([[2**40, 0], [2**40, 1], [-(2**40), 1]])
    try:
        search_block(np.arange(3), x, pivot_distances(x, x), np.arange(1), x[:1], pivot_distances(x[:1], x), 1)
        raise AssertionError("a score beyond a long was returned")
    except OverflowError:
        pass
