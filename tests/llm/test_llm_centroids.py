"""Centroid clustering: exact rounds against brute force, the intervals, wide components, defined cases."""

import hashlib

import numpy as np
import pytest

from tallyfold.llm import centroids as C

DDL = "vec_id long, embedding array<double>, cluster string, distance int, ID int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], DDL)


def brute(rows, dim, k=16, rounds=3, scale=64):
    vs = [(i, [C.integer(x, scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and abs(x) < float("inf") for x in v)]
    order = sorted(vs, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in vs]
        groups = [[v for (_, v), a in zip(vs, at) if a == j] for j in range(len(c))]
        c = [[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(groups, c)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in vs), key=repr), c


def got(found):
    return sorted(((r.id, r.cluster, r.distance) for r in found.collect()), key=repr)


@pytest.mark.parametrize("spread", [0.01, 1.0, 50.0])
def test_matches_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5) * spread]) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(300)]  # repeated vectors and ids: ties
    found, cs = C.clustered(table(spark, rows), dim=5, bits=4)
    want, want_cs = brute(rows, 5)
    assert cs == want_cs and got(found) == want


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(100, [3e9, 0.0, 1.0]), (101, [-3e9, 2.0, 1.0]), (102, [3e9, 1.0, 1.0]), (103, [1e300, 0.0, 0.0]), (104, [1.7e308, 0.0, 0.0])]
    found, cs = C.clustered(table(spark, rows), dim=3, k=4)
    want, want_cs = brute(rows, 3, k=4)
    assert cs == want_cs
    assert got(found) == [(i, c, d if d < 2**63 else None) for i, c, d in want]


def test_intervals_hold_the_distances_and_spare_fetches():
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, (12, 16))
    x = centres[rng.integers(0, 12, 2000)] + rng.integers(-9, 10, (2000, 16))
    borders = C.cell_borders(x[:300].astype(float), 5)
    block = C.block_rows(list(range(2000)), x.tolist(), borders, 5)
    assert (C.unpack_cells(block["cells"], 2000, 16, 5) < 32).all() and len(block["cells"]) == 2000 * 10
    lower, upper = C.intervals(block, centres, borders, 5)
    exact = ((x[:, None, :] - centres[None]) ** 2).sum(2) - (x * x).sum(1)[:, None]
    assert (lower <= exact).all() and (exact <= upper).all()
    nearest, fetched = C.assign_block(block, centres.tolist(), borders, 5)
    assert (nearest == exact.argmin(1)).all() and fetched < 200


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, 0.5]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, -0.01])]
    found, cs = C.clustered(table(spark, rows), dim=2)
    want, want_cs = brute(rows, 2)
    assert cs == want_cs and got(found) == want and len(want) == 4
    found, cs = C.clustered(table(spark, []), dim=2)
    assert found.count() == 0 and cs == []


def test_query_on_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = C.op11_centroids(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0
