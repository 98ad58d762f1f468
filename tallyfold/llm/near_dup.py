"""MinHash near-duplicates: bands, signature and full-set checks, components.

1. Every text becomes its set of word shingles, 128 universal hash minima, a
   one-byte sketch of each, and a key per band. Texts with equal words collapse to
   one node (the smallest id), so a large group of copies costs one node.
2. Nodes that share a band key meet at the smallest of them, the centre. One edge per
   (centre, node), however many bands agree: linear, never all pairs of a bucket.
3. Edges pass the signature check, then the full sets decide.
4. Components by alternating large-star and small-star.
5. What the centre did not link may still link with others: for centres whose nodes
   lie in several components, blocks of nodes meet pairwise, only across components,
   first on sketches; nodes left with a possible partner meet once more on full
   sets. A task holds two blocks and returns a spanning forest, never the pairs.
6. Components again with the links found in 5.

Misses: a pair of similarity 0.75 shares no band with probability 5e-6; the
signature check at four standard deviations loses as little. Documents are
linked by full sets only.

Defined cases: null, empty and blank texts have no shingles, n_shingles 0, and link
with nothing; a row without id takes no part, is kept and has no component;
repeated rows and texts given twice under one id share one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import by_position, columns, documents, filter_slot, hot_keys, id_filter, in_filter, salted_join, small_batches, split_join, staged, texts_of
from tallyfold.llm.components import components
from tallyfold.llm.shingles import MinHash, forget, shingle_set, sketch, words_of

BANDS, ROWS = 32, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIMILARITY_PERCENT = 75
#: Of equal sketch bytes; 0.75 less four standard deviations of 128 minima.
SKETCH_LEAST = 0.59
SKETCH_BLOCK = 512
SET_BLOCK = 256
#: Shingles of one block, so that long texts make smaller blocks.
SET_BLOCK_SHINGLES = 400_000


def signatures(docs: DataFrame) -> DataFrame:
    """``id, digest, n, sketch, bands`` per row; digest is of the words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(BANDS, ROWS)
        for b in small_batches(batches):
            digest, n, sk, bands = [], [], [], []
            for text in texts_of(b.column(1)):
                words = words_of(text)
                shingles = shingle_set(words)
                digest.append(xxhash.xxh3_128_digest("\n".join(words).encode("utf-8", "surrogatepass")))
                n.append(len(shingles))
                minima = minhash.minima(shingles) if len(shingles) else None
                sk.append(None if minima is None else sketch(minima))
                bands.append(None if minima is None else minhash.band_keys(minima))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(sk, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "digest", "n", "sketch", "bands"],
            )
        forget()

    return docs.mapInArrow(run, "id long, digest binary, n long, sketch binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, digest, shingles`` (little-endian 64-bit) of the nodes in ``wanted`` (id, digest).

    A fixed-size filter of ids spares the other texts the shuffle; the join is exact.
    Of rows that repeat an id and its words, a task passes one on.
    """
    bits = id_filter(F.col("id"), wanted)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int | None, bytes]] = set()
        for b in small_batches(batches):
            b = b.filter(pa.array(in_filter(shared.value, b.column(2).to_numpy())))
            ids, digests, sets = [], [], []
            for i, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                words = words_of(text)
                digest = xxhash.xxh3_128_digest("\n".join(words).encode("utf-8", "surrogatepass"))
                if (i, digest) not in seen:
                    seen.add((i, digest))
                    ids.append(i)
                    digests.append(digest)
                    sets.append(shingle_set(words).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["id", "digest", "shingles"])
        forget()

    rows = docs.select("id", "text", filter_slot(F.col("id")).alias("slot")).mapInArrow(run, "id long, digest binary, shingles binary")
    return rows.join(wanted, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])


def _similar(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int):
    return 100 * common >= SIMILARITY_PERCENT * (n + m - common)


def _centre_edges(nodes: DataFrame) -> DataFrame:
    """``c, id``: nodes that share a band key with a smaller node c, the smallest there."""
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("last"), F.count("*").alias("k")).filter("c < last").select("key", "c", "k")
    least = staged(least, "band-keys")
    hot = hot_keys(least, "key", "k", nodes.count() * BANDS)
    return split_join(keyed, least.select("key", "c"), ["key"], F.col("id"), hot).filter("id != c").select("c", "id").distinct()


def _sketches_pass(pairs: DataFrame) -> DataFrame:
    """Pairs (c, id, c_sketch, id_sketch, c_n, id_n) whose signatures allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
            n, m = (b.column(k).to_numpy() for k in (4, 5))
            ok = ((x == y).mean(axis=1) >= SKETCH_LEAST) & (100 * np.minimum(n, m) >= SIMILARITY_PERCENT * np.maximum(n, m))
            yield b.filter(pa.array(ok)).select(["c", "id", "c_digest", "id_digest"])

    out = pairs.select("c", "id", "c_sketch", "id_sketch", "c_n", "id_n", "c_digest", "id_digest")
    return out.mapInArrow(run, "c long, id long, c_digest binary, id_digest binary")


def _full_sets_agree(pairs: DataFrame) -> DataFrame:
    """Pairs (c, id, c_set, id_set) that the full sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                keep.append(bool(_similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
            yield b.filter(pa.array(keep, pa.bool_())).select(["c", "id"])

    return pairs.select("c", "id", "c_set", "id_set").mapInArrow(run, "c long, id long")


def _blocks(members: DataFrame, per_block: int, weight: Column, block_weight: int) -> DataFrame:
    """Deal every member (c, id, digest, comp, main, n, ...) to the block pairs that it belongs to.

    ``main`` members lie in the centre's component and meet only the others; the
    others meet everybody. Adds ``job`` and ``left`` (its side of the pair).
    """
    side = lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    heavy = lambda flag: F.sum(F.when(flag, weight).otherwise(0))
    count = lambda flag: F.greatest(F.ceil(side(flag) / per_block), F.ceil(heavy(flag) / block_weight), F.lit(1)).cast("int")
    sizes = members.groupBy("c").agg(count(F.col("main")).alias("n_main"), count(~F.col("main")).alias("n_rest"))
    m = salted_join(members, sizes, ["c"], ["id", "digest"])
    own = F.pmod(F.xxhash64("id", "digest"), F.when(F.col("main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    m = m.withColumn("own", own)
    mains = F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left")))
    as_main = F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("n_rest") - 1),
        lambda k: F.struct((F.col("n_main") + F.least(F.col("own"), k)).alias("i"), F.greatest(F.col("own"), k).alias("j"), (F.col("own") < k).alias("left")),
    )
    deals = F.when(F.col("main"), as_main).otherwise(F.concat(mains, pairs))
    return m.withColumn("deal", F.explode(deals)).select(
        *[c for c in members.columns], F.struct("c", F.col("deal.i").alias("i"), F.col("deal.j").alias("j")).alias("job"), F.col("deal.left").alias("left")
    )


def _cross(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs differ in component and are near enough in set size."""
    return (x[:, None] != y[None, :]) & (100 * np.minimum.outer(n, m) >= SIMILARITY_PERCENT * np.maximum.outer(n, m))


def _possible_members(group) -> np.ndarray:
    """Positions of the rows of one block pair with a partner that the sketches allow."""
    left = group["left"].to_numpy()
    inside = not left.any()
    a = np.arange(len(group)) if inside else np.nonzero(left)[0]
    b = a if inside else np.nonzero(~left)[0]
    sk = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(len(group), -1)
    comp, n = group["comp"].to_numpy(), group["n"].to_numpy()
    possible = np.zeros(len(group), dtype=bool)
    for at in range(0, len(a), 64):
        p = a[at : at + 64]
        ok = _cross(comp[p], comp[b], n[p], n[b])
        ok &= (sk[p][:, None, :] == sk[b][None, :, :]).mean(axis=2) >= SKETCH_LEAST
        possible[p] |= ok.any(axis=1)
        possible[b] |= ok.any(axis=0)
    return np.nonzero(possible)[0]


def common_counts(sets_a: list[np.ndarray], sets_b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets, by products of incidence matrices."""
    flat_a, flat_b = (np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (sets_a, sets_b))
    vocab = np.intersect1d(flat_a, flat_b)  # what only one side has cannot be common
    out = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)

    def entries(sets):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(vocab, flat), max(0, len(vocab) - 1))
        hit = vocab[col] == flat if len(vocab) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(col[hit], kind="stable")
        return rows[hit][order], col[hit][order]

    (ra, ca), (rb, cb) = entries(sets_a), entries(sets_b)
    for at in range(0, len(vocab), width):
        sides = []
        for r, c, k in ((ra, ca, len(sets_a)), (rb, cb, len(sets_b))):
            lo, hi = np.searchsorted(c, [at, at + width])
            m = np.zeros((k, width), dtype=np.float32)
            m[r[lo:hi], c[lo:hi] - at] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _forest(group) -> list[tuple[int, int]]:
    """Links across components in one block pair, as a spanning forest."""
    left = group["left"].to_numpy()
    inside = not left.any()
    a = np.arange(len(group)) if inside else np.nonzero(left)[0]
    b = a if inside else np.nonzero(~left)[0]
    sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
    comp, ids = group["comp"].to_numpy(), group["id"].to_numpy()
    n = np.array([len(s) for s in sets])
    common = common_counts([sets[i] for i in a], [sets[i] for i in b])
    linked = _cross(comp[a], comp[b], n[a], n[b]) & _similar(common, n[a][:, None], n[b][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(linked):
        p, q = find(int(comp[a[i]])), find(int(comp[b[j]]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(ids[a[i]]), int(ids[b[j]])))
    return out


def _rest_links(docs: DataFrame, nodes: DataFrame, edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Links that the centres did not show, between different components under one centre."""
    import pandas as pd

    members = edges.unionByName(edges.select("c", F.col("c").alias("id")).distinct())
    named = members.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("c", "id", F.coalesce("component", "id").alias("comp"))
    named = staged(named, "members")
    # Two nodes alone, the centre and another, have been compared already.
    c_comp = F.max(F.when(F.col("c") == F.col("id"), F.col("comp")))
    split = named.groupBy("c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), c_comp.alias("c_comp"))
    split = split.filter("lo < hi and k > 2").select("c", "c_comp")
    open_members = salted_join(named, split, ["c"], ["id"]).select("c", "id", "comp", (F.col("comp") == F.col("c_comp")).alias("main"))
    with_sketch = open_members.join(nodes.select("id", "digest", "n", "sketch"), "id")
    dealt = _blocks(with_sketch, SKETCH_BLOCK, F.lit(0), 1)

    def possible(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[_possible_members(group)][["c", "id", "digest", "comp", "main", "n"]]

    left_over = dealt.groupBy("job").applyInPandas(possible, "c long, id long, digest binary, comp long, main boolean, n long").distinct()
    left_over = staged(left_over, "left-over")
    sets = shingle_sets(docs, left_over.select("id", "digest").distinct())
    jobs = _blocks(left_over, SET_BLOCK, F.col("n"), SET_BLOCK_SHINGLES).join(sets, ["id", "digest"])

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(group), columns=["a", "b"], dtype="int64")

    return jobs.groupBy("job").applyInPandas(forest, "a long, b long")


def _classes(docs: DataFrame) -> DataFrame:
    """``id, n, digest, component`` per row of ``docs`` (id, text); digest is null where a row takes no part."""
    signed = staged(signatures(docs), "signatures")
    nodes = signed.filter("id is not null and n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "sketch", "bands")).alias("s"), F.count("*").alias("copies"))
    nodes = staged(nodes.select("s.id", "digest", "s.n", "s.sketch", "s.bands", "copies"), "nodes")
    edges = staged(_centre_edges(nodes), "centre-edges")
    hot_centres = staged(hot_keys(edges.groupBy("c").agg(F.count("*").alias("k")), "c", "k", edges.count()), "hot-centres")
    c, i = (nodes.select(*[F.col(x).alias("id" if k == "id" and x == "id" else "c" if x == "id" else f"{k}_{x}") for x in ("id", "digest", "n", "sketch")]) for k in ("c", "id"))
    passed = staged(_sketches_pass(split_join(edges.join(i, "id"), c, ["c"], F.col("id"), hot_centres)), "possible-pairs")
    wanted = passed.select(F.col("c").alias("id"), F.col("c_digest").alias("digest")).union(passed.select("id", "id_digest")).distinct()
    sets = staged(shingle_sets(docs, wanted), "sets")
    pairs = passed.join(sets.select("id", F.col("digest").alias("id_digest"), F.col("shingles").alias("id_set")), ["id", "id_digest"])
    centre_sets = sets.select(F.col("id").alias("c"), F.col("digest").alias("c_digest"), F.col("shingles").alias("c_set"))
    pairs = split_join(pairs, centre_sets, ["c", "c_digest"], F.col("id"), hot_centres)
    links = staged(_full_sets_agree(pairs).select(F.col("c").alias("a"), F.col("id").alias("b")), "centre-links")
    found = components(links)
    more = staged(_rest_links(docs, nodes, edges, found), "rest-links")
    if not more.isEmpty():
        by_star = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(by_star.unionByName(more))
    classes = nodes.select("id", "digest").join(found.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("digest", F.coalesce("component", "id").alias("component"))
    rows = signed.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest"))
    # Rows without a digest meet nothing; rows of a digest that many share are told apart by their places in the written table.
    hot = hot_keys(nodes, "digest", "copies", signed.count())
    found = split_join(rows.filter("digest is not null"), classes, ["digest"], F.monotonically_increasing_id(), hot, "left")
    alone = rows.filter("digest is null").withColumn("component", F.lit(None).cast("bigint"))
    return found.unionByName(alone).select("id", "n", "digest", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``."""
    out = _classes(columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Keys of rows without an id begin here, above all ids, so that a row with an id is kept before one without.
_OWN_KEYS = 1 << 62
#: Keys of rows to leave out, or to look at again, that are broadcast: some 30 MB.
KEYS_IN_MEMORY = 1_000_000


def _few(keys: DataFrame) -> DataFrame:
    """Written keys, to be broadcast if they are few: then no text is shuffled to find their rows."""
    return F.broadcast(keys) if keys.count() <= KEYS_IN_MEMORY else keys


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, of the smallest id; all columns stay.

    A row without an id takes part under a key of its own, and is kept only where its class
    has no row with an id. Of rows that repeat the id and the words of a kept one, one
    stays. An id that stands for different texts keeps one row of each of them.
    """
    rows, where = by_position(docs)
    id_, text = where[id_col], where[text_col]
    # Rows without an id are written once with their keys; the others are their own.
    own = staged(rows.filter(F.col(id_).isNull()).withColumn("__key", F.monotonically_increasing_id() + _OWN_KEYS), "rows-without-id")
    keyed = rows.filter(F.col(id_).isNotNull()).withColumn("__key", F.col(id_).cast("bigint")).unionByName(own)
    found = staged(_classes(keyed.select(F.col("__key").alias("id"), F.col(text).alias("text"))).drop("n"), "classes")
    kept = F.col("id") == F.col("component")
    gone = found.filter(~kept).select(F.col("id").alias("__gone")).distinct()
    again = found.filter(kept).groupBy("id", F.coalesce("digest", F.lit(b""))).count().filter("count > 1").select(F.col("id").alias("__gone")).distinct()
    again = staged(again, "repeated-ids")
    out = staged(gone.unionByName(again).distinct(), "rows-to-leave-out")
    once = keyed.join(_few(out), F.col("__key") == F.col("__gone"), "left_anti").drop("__key")
    words = F.array_join(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    repeated = keyed.join(_few(again), F.col("__key") == F.col("__gone"), "left_semi").withColumn("__words", F.md5(words.cast("binary")))
    one = repeated.groupBy("__key", "__words").agg(F.first(F.struct(*rows.columns)).alias("r")).select("r.*")
    return once.unionByName(one).toDF(*docs.columns)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``."""
    return near_duplicates(documents(spark, sf_dir))
