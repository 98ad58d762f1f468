import random

from helpers_llm import by_id, documents, words

from pyspark.sql import functions as F

from tallyfold.llm import near_dup
from tallyfold.llm.common import HOT_SHARE, hot_keys, split_join
from tallyfold.llm.components import components
from tallyfold.llm.near_dup import near_duplicates
from tallyfold.llm.shingles import words_of


def brute(rows, size=5):
    sets = {}
    for i, t in rows:
        w = words_of(t or "")
        sets.setdefault(i, []).append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i in ids:
        for s in sets[i]:
            for g in s:
                index.setdefault(g, set()).add(i)
    pairs = {(i, j) for g in index.values() for i in g for j in g if i < j} if len(ids) < 500 else None
    for i, j in pairs:
        for s in sets[i]:
            for t in sets[j]:
                if s and t and 100 * len(s & t) >= 75 * len(s | t):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i][0]), find(i)) for i in ids}


def corpus():
    """Groups around the threshold, chains, exact copies, a passage that many share."""
    rng, rows, n = random.Random(5), [], 0
    passage = words(60, 99)
    for g in range(12):
        base = words(120, g)
        for c in range(10):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    for g in range(40):
        rows.append((n, " ".join(passage + words(rng.randint(5, 60), 1000 + g))))
        n += 1
    chain = words(200, 7)
    for step in range(12):  # each is near its neighbour, the ends are far apart
        rows.append((n, " ".join(chain[step * 5 : step * 5 + 100])))
        n += 1
    rows += [(n + k, "One two\tthree  FOUR five six seven") for k in range(5)] + [(n + 5, "one two"), (n + 6, "ONE two"), (n + 7, "two one")]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = by_id(near_duplicates(documents(spark, rows, extra=["id", "digest", "component_id"])))
    want = brute(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_blocks_find_what_centres_miss(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SKETCH_BLOCK", 4)
    monkeypatch.setattr(near_dup, "SET_BLOCK", 3)
    rows = corpus()
    got = by_id(near_duplicates(documents(spark, rows)))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in brute(rows).items()}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")]
    out = near_duplicates(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out], key=repr)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (None, 2, None, True), (9, 2, 4, False)], key=repr
    )


def test_one_row_of_each_class_is_kept(spark):
    """Repeated rows, rows without an id and near copies; extra columns stay with their row."""
    base = words(60, 4)
    near = [*base[:30], "changed", *base[31:]]
    rows = [(5, " ".join(base))] * 3 + [(7, " ".join(near)), (None, " ".join(base)), (None, " ".join(near)), (None, " ".join(near))]
    rows += [(None, "no id at all here now")] * 4 + [(None, "No ID at all HERE now"), (8, "b c d e f g"), (8, "B C d e f g"), (8, "other words of the same id"), (9, None), (9, None), (10, ""), (None, None)]
    docs = documents(spark, rows, extra=["Doc_ID2", "c1", "__key", "count"])
    got = near_dup.kept_documents(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text.lower() if r.text else r.text) for r in got.collect()), key=repr)
    want = [(5, " ".join(base)), (None, "no id at all here now"), (8, "b c d e f g"), (8, "other words of the same id"), (9, None), (10, ""), (None, None)]
    assert kept == sorted(want, key=repr)


def test_kept_rows_are_those_of_the_classes(spark):
    rows = corpus()
    docs = documents(spark, rows)
    kept = sorted(r.doc_id for r in near_duplicates(docs).collect() if r.kept)
    assert sorted(r.doc_id for r in near_dup.kept_documents(docs).collect()) == kept


def test_empty_and_long(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    long = " ".join(words(60_000, 3))
    got = by_id(near_duplicates(documents(spark, [(1, long), (2, long + " tail")])))
    assert got[2]["component_id"] == 1


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 100), (200, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 103: 100}


def test_hot_keys_are_split_and_lose_nothing(spark):
    """One key with a third of the rows, one with many, the rest with few; unmatched and null keys."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 30 == 1, -2).when(F.col("id") % 1000 == 2, None).otherwise(F.col("id") % 9000).alias("key"), "id"
    )
    counts = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("k"))
    values = counts.filter("key % 7 != 0").select("key", (F.col("key") * 10).alias("value"))
    hot = hot_keys(counts, "key", "k", 60_000)
    parts = {r["key"]: r["__parts"] for r in hot.collect()}
    size = 60_000 // HOT_SHARE + 1
    assert parts[-1] == 20_000 // size and parts[-2] == 2_000 // size
    assert len(parts) < HOT_SHARE and sum(parts.values()) < 2 * HOT_SHARE
    for how in ("inner", "left"):
        got = split_join(rows, values, ["key"], F.col("id"), hot, how)
        want = rows.join(values, "key", how)
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_digest_and_an_id_that_many_rows_share(spark):
    """Copies under many ids, rows repeated under one id, and rows without words."""
    base = words(40, 11)
    near = " ".join([*base[:20], "other", *base[21:]])
    rows = [(i, " ".join(base)) for i in range(300)] + [(1000, near)] * 200 + [(2000 + i, None) for i in range(200)] + [(None, " ")] * 50
    got = near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    linked = near_dup._similar(len(_shingles(base) & _shingles(near.split())), 36, 36)
    want = sorted([(i, 36, 0) for i in range(300)] + [(1000, 36, 0 if linked else 1000)] * 200 + [(2000 + i, 0, 2000 + i) for i in range(200)] + [(None, 0, None)] * 50, key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want


def _shingles(w):
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_stars_are_left_as_they_are(spark, monkeypatch):
    """Links that are stars already need no round, and what is settled is not run through once more."""
    from tallyfold.llm import components as module

    rounds = []
    monkeypatch.setattr(module, "staged", lambda df, name, f=module.staged: (rounds.append(name), f(df, name))[1])
    stars = [(1, 5), (6, 1), (1, 1), (2, 9), (9, 2)]
    found = {r.node: r.component for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert found == {1: 1, 5: 1, 6: 1, 2: 2, 9: 2} and rounds.count("star") == 0
    # A node under two others, and one that is above one and under another.
    found = {r.node: r.component for r in components(spark.createDataFrame([(3, 7), (4, 7), (20, 21), (21, 22)], "a long, b long")).collect()}
    assert found == {3: 3, 4: 3, 7: 3, 20: 20, 21: 20, 22: 20}
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0
