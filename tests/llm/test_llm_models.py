"""Toxicity and quality: exact marginals, held-out accuracy, defined cases; the pipeline against its parts."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from helpers_llm import by_id, documents, words
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import quality, toxicity
from tallyfold.llm.near_dup import near_duplicates
from tallyfold.llm.toxicity import Chain

SF = "/root/testdata/sf0.01"


def test_marginals_match_all_paths():
    trans = np.array([[0.3, -1.0], [0.2, 0.9]])
    chain = Chain({"=bad": 3.0, "wors": 1.5, "=ok": -1.0}, -2.0, trans, np.zeros(3))
    for seed in range(20):
        rng = random.Random(seed)
        w = [rng.choice(["bad", "worse", "ok", "x", "y", "zz"]) for _ in range(rng.randint(1, 9))]
        total, toxic = 0.0, [0.0] * len(w)
        for path in itertools.product((0, 1), repeat=len(w)):
            s, prev = 0.0, 0
            for word, y in zip(w, path, strict=True):
                s += trans[prev, y] + y * (-2.0 + chain.gain(word))
                prev = y
            total += math.exp(s)
            for i, y in enumerate(path):
                toxic[i] += y * math.exp(s)
        at, p = chain.marginals(w)
        assert at == [i for i, x in enumerate(w) if chain.gain(x)]
        assert p == pytest.approx([toxic[i] / total for i in at])


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    k, n, width = 3, 4, toxicity.WINDOW
    labels = rng.integers(0, 2, (n, width))
    valid = np.arange(width)[None, :] < np.array([width, 5, 1, 20])[:, None]
    labels = labels * valid
    where = np.nonzero(valid.ravel())[0][::2]
    which = rng.integers(0, k, len(where))
    theta = rng.normal(size=k + 5) * 0.5

    def likelihood(t):
        emit = np.bincount(where, weights=t[which], minlength=n * width).reshape(n, width) + t[k]
        trans, out = t[k + 1 :].reshape(2, 2), 0.0
        for r in range(n):
            a, prev, own = np.array([1.0, 0.0]), 0, 0.0
            for c in range(int(valid[r].sum())):
                a = (a @ np.exp(trans)) * np.array([1.0, np.exp(emit[r, c])])
                own += trans[prev, labels[r, c]] + labels[r, c] * emit[r, c]
                prev = labels[r, c]
            out += own - np.log(a.sum())
        return out

    grad = toxicity._gradient(theta, k, where, which, labels, valid)
    for i in range(len(theta)):
        d = np.zeros_like(theta)
        d[i] = 1e-5
        assert grad[i] == pytest.approx((likelihood(theta + d) - likelihood(theta - d)) / 2e-5, abs=1e-4)


def labelled(n=400):
    """Clean and toxic texts: insults with changing ends, set into plain words."""
    rng, rows, marks = random.Random(9), [], []
    for d in range(n):
        w = words(rng.randint(5, 120), d)
        toxic = d % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumpf", "schlomp", "blaargh"]) + rng.choice(["", "en", "ich", "ta"]))
        rows.append((d, " ".join(w)))
        marks.append((d, 1, int(toxic)))
    return rows, marks


LABEL_DDL = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    rows, marks = labelled()
    rows += [(1000, None), (1001, ""), (1002, "grumpf " * 50_000), (1003, "plain " * 50_000), (None, "a grumpfen b"), (1, rows[1][1])]
    got = toxicity.toxicity(documents(spark, rows, extra=["score", "toxic"]), spark.createDataFrame(marks, LABEL_DDL)).collect()
    assert len(got) == len(rows)
    truth = {d: t for d, _, t in marks}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    other = {r.doc_id: r for r in got}
    assert [other[i].predicted for i in (1000, 1001, 1002, 1003, None)] == [0, 0, 1, 0, 1]
    assert other[None].spans == "2:10"


def test_spans_where_lower_case_is_longer():
    chain = Chain({"=bad": 9.0}, -2.0, np.zeros((2, 2)), np.array([-6.0, 6.0, 3.0]))
    text = "\u0130\u0130 x BAD y \u0130 bad"
    assert [text[s:e] for s, e in chain.document(text)[1]] == ["BAD", "bad"]


def test_few_labels_find_most_held_out_toxic_rows(spark):
    """Some eight toxic rows to learn from, each root in fewer than ten contexts."""
    rows, marks = labelled(56)
    got = toxicity.toxicity(documents(spark, rows), spark.createDataFrame(marks, LABEL_DDL)).filter("held_out").collect()
    truth = {d: t for d, _, t in marks}
    toxic = [r for r in got if truth[r.doc_id]]
    assert len(toxic) >= 4 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert not any(r.predicted for r in got if not truth[r.doc_id])


def test_labels_of_held_out_rows_are_never_read(spark):
    rows, marks = labelled(200)
    docs = documents(spark, rows)
    flipped = [(d, q, 1 - t) if zlib.crc32(str(d).encode()) % 3 == 1 else (d, q, t) for d, q, t in marks]
    a, b = (by_id(toxicity.toxicity(docs, spark.createDataFrame(m, LABEL_DDL))) for m in (marks, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    assert [r.score for r in toxicity.toxicity(docs, spark.createDataFrame([], LABEL_DDL)).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(documents(spark, []), spark.createDataFrame([], LABEL_DDL)).count() == 0


@pytest.mark.parametrize("op,label,threshold", [("op3_toxicity", "toxic", 0.95), ("op10_quality", "quality", 0.95)])
def test_held_out_accuracy_on_the_tables(spark, op, label, threshold):
    query = {"op3_toxicity": toxicity.op3_toxicity, "op10_quality": quality.op10_quality}[op]
    got = by_id(query(spark, SF))
    marks = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [int(got[r.doc_id]["predicted" if label == "toxic" else "kept"]) == r[label] for r in marks]
    assert len(right) > 50 and np.mean(right) >= threshold


def test_site_posteriors_by_hand(spark):
    rows = [("a", "x", 1.0)] * 30 + [("a", "y", 0.0)] * 10 + [("b", "x", 0.0)] * 40 + [("c", "z", 1.0)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    assert mean == pytest.approx(31 / 81)
    hosts = {"a": (40, 30.0), "b": (40, 0.0), "c": (1, 1.0)}
    spread = sum(n * (s / n - mean) ** 2 for n, s in hosts.values())
    k = quality.prior_strength(mean, 3, 81, 3201, spread)
    host = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
    paths = {("a", "x"): (30, 30.0), ("a", "y"): (10, 0.0), ("b", "x"): (40, 0.0), ("c", "z"): (1, 1.0)}
    k2 = quality.prior_strength(mean, 4, 81, 2601, sum(n * (s / n - host[h]) ** 2 for (h, _), (n, s) in paths.items()))
    got = {(r.host, r.path): r.site for r in sites.collect()}
    assert got == pytest.approx({(h, p): (s + k2 * host[h]) / (n + k2) for (h, p), (n, s) in paths.items()})
    assert abs(got[("c", "z")] - mean) < abs(1.0 - mean)  # one document says little


def test_sparse_groups_fall_back_to_the_level_above():
    assert quality.prior_strength(0.5, 1, 10, 100, 0.0) == 1e9
    assert quality.prior_strength(0.5, 10, 100, 1000, 0.1) == 1e9
    assert quality.prior_strength(0.5, 10, 1000, 100_000, 200.0) < 10


def junk(d):
    return " | ".join(words(30, d)) + " %%% ***"


def test_quality_defined_cases(spark):
    rows = [(d, junk(d) if d % 3 == 0 else " ".join(words(40, d)) + ".", f"h{d % 5}") for d in range(150)]
    marks = [(d, int(d % 3 != 0), 0) for d in range(150)]
    rows += [(200, None, None), (201, "", "h1"), (None, "some plain words", "h1"), (202, "a b " * 100_000, "h1"), (1, rows[1][1], "h1")]
    docs, labels = documents(spark, rows, extra=["odds", "site", "host"]), spark.createDataFrame(marks, LABEL_DDL)
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 150)
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([r.doc_id for r in got if r.kept], key=repr)
    none = spark.createDataFrame([], LABEL_DDL)
    assert quality.kept_documents(docs, none).count() == len(rows)
    assert quality.quality(documents(spark, []), labels).count() == 0


def test_pipeline_is_its_parts_and_keeps_clean_documents(spark):
    import hashlib

    import public_tokenizers

    from tallyfold.llm import byte_bpe, decontaminate, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = by_id(corpus_pipeline.run(spark, SF))
    good = {r.doc_id for r in quality.op10_quality(spark, SF).collect() if r.kept}
    first = docs.filter(docs.doc_id.isin(good))
    one = {r.doc_id for r in near_duplicates(first).collect() if r.kept}
    second = first.filter(first.doc_id.isin(one))
    leaks = {r.doc_id for r in decontaminate.overlaps(second, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    third = second.filter(~second.doc_id.isin(leaks))
    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    want = {}
    spans = {r.doc_id: sorted((s.start, s.stop) for s in r.spans if s.verdict == "live") for r in secrets.secret_spans(third).collect()}
    for r in third.collect():
        text, at, out = r.text, 0, ""
        for s, e in spans[r.doc_id]:
            out += text[at:s] + "<secret>" if s >= at else ""
            at = max(at, e)
        ids = bpe.encode(out + text[at:])
        want[r.doc_id] = {"doc_id": r.doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256((out + text[at:]).encode()).hexdigest()}
    assert got == want


def test_stages_return_the_columns_and_survive_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x y z", "a"), (3, "one two three", "a"), (3, "one two three", "a"), (4, "password=abcdefgh12", "a")]
    for extra in ((), ("digest", "hits", "spans", "__id"), ("text", "doc_id", "TEXT", "source")):
        docs = documents(spark, rows, extra=extra)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert {r.doc_id for r in out.collect()} <= {1, 2, 3, 4, None}
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_paths_by_broadcast_and_in_parts_agree(spark):
    """Two thirds of the rows in one path: dealt to parts they have the values that a broadcast gives them, nulls included."""
    rows = [(k, "hot" if k % 3 else f"h{k % 50}", None if k % 7 == 0 else "p") for k in range(30_000)]
    docs = spark.createDataFrame([*rows, (-1, "new", "p")], "id long, host string, path string")
    host, path = quality._key(F.col("host")), quality._key(F.col("path"))
    sites = docs.filter("id >= 0").groupBy(host.alias("host"), path.alias("path")).agg(F.count("*").alias("n"), F.avg("id").alias("site"))
    few, many = (sorted(quality.with_site(docs, host, path, sites, limit).collect(), key=lambda r: r.id) for limit in (1000, 0))
    assert few == many and len(few) == 30_001 and few[0]["__site"] is None and few[1]["__site"] is not None
