"""Centroid clustering over a vector approximation file (VA-file).

Components become integers, floor(scale x). Every vector is also kept as a few-bit cell number
per dimension, where the cells' borders are quantiles of a bounded sample (they decide
speed, never results). An assignment reads the cells first: per centroid a lookup table
(dimension, cell) holds the least and the largest part that a component of that cell can
add to sum(c * c - 2 x c), the squared distance less the vector's own norm, which is the same for
all centroids. The sums over the dimensions are an interval around each centroid's distance. Where
one interval lies below all others the vector is decided; only for the others the full vector is
fetched, and exact distances to the centroids whose intervals overlap decide (ties: the smaller number).

A round is one pass of tasks over blocks of vectors, which carry cells and full vectors side
by side, so nothing is shuffled. Tasks return, per centroid and dimension, the
sum of their vectors' components in parts of 18 digits, which Spark adds up: centroids
are exact floors of exact means, and what reaches the driver does not grow with the data.

Defined cases: vectors that are null, of another length, or hold null or non-finite components
take no part; rows that repeat a vector or an id, also a null id, are vectors of their own (as
starting centroids null ids come last, equal ids in the order of their vectors); fewer vectors than centroids
give fewer centroids; an empty centroid stays where it was. Components of any size are exact;
a distance or inertia that does not fit in a long is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import columns, documents, staged

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Bits of a cell number.
BITS = 6
#: Vectors that the cells' borders come from.
SAMPLE = 2000
BLOCK = 2048
#: Below this size of a component 64 squared differences fit in a long; blocks with larger ones use Python's integers.
NARROW = 1 << 27
_LIMB = 10**18
_BLOCK_DDL = "ids array<long>, cells binary, low binary, high binary, vectors binary, wide boolean"


def integer(x: float, scale: int) -> int:
    """floor(scale * x), exact for every finite double."""
    y = x * scale
    return math.floor(y) if abs(y) < 2.0**1023 else math.floor(x) * scale


def take_part(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``id, v`` (array of double) of the rows that take part."""
    r = columns(rows, id=id_col, v=vector_col).select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return r.filter(F.col("v").isNotNull() & (F.size("v") == dim) & fine)


def first_centroids(vectors: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``1:<id>``."""
    named = vectors.select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "v")
    least = named.orderBy(F.col("h").asc_nulls_last(), F.transform("v", lambda x: F.floor(x * scale)), "v").limit(k).collect()
    return [[integer(x, scale) for x in r.v] for r in least]


def cell_borders(sample: np.ndarray, bits: int) -> np.ndarray:
    """Per dimension the 2**bits - 1 inner borders: cell i holds the integers from border i - 1 up to below border i."""
    at = np.arange(1, 1 << bits) / (1 << bits)
    if not len(sample):
        return np.zeros((sample.shape[1], len(at)), dtype=np.int64)
    return np.ceil(np.quantile(sample, at, axis=0)).T.astype(np.int64)


def pack_cells(cells: np.ndarray, bits: int) -> bytes:
    return np.packbits(((cells[:, :, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(len(cells), -1), axis=1).tobytes()


def unpack_cells(data: bytes, n: int, dim: int, bits: int) -> np.ndarray:
    rows = np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(n, -1), axis=1, count=dim * bits)
    return (rows.reshape(n, dim, bits).astype(np.int64) << np.arange(bits)).sum(2)


def block_rows(ids: list, vectors: list[list[int]], borders: np.ndarray, bits: int) -> dict:
    """One block: the approximations, and the vectors themselves."""
    dim = len(borders)
    wide = any(abs(x) >= NARROW for v in vectors for x in v)
    if wide:
        return {"ids": ids, "wide": True, "vectors": ";".join(",".join(map(str, v)) for v in vectors).encode()} | {c: b"" for c in ("cells", "low", "high")}
    m = np.array(vectors, dtype=np.int64).reshape(-1, dim)
    cells = np.stack([np.searchsorted(borders[d], m[:, d], side="right") for d in range(dim)], axis=1)
    kept = {"low": m.min(0), "high": m.max(0), "vectors": m.astype("<i4")}
    return {"ids": ids, "cells": pack_cells(cells, bits), "wide": False} | {c: a.tobytes() for c, a in kept.items()}


def full_vectors(block: dict, dim: int) -> np.ndarray:
    if block["wide"]:
        return np.array([[int(x) for x in v.split(",")] for v in block["vectors"].decode().split(";")], dtype=object)
    return np.frombuffer(block["vectors"], dtype="<i4").reshape(-1, dim).astype(np.int64)


def intervals(block: dict, centroids: np.ndarray, borders: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance, less the vector's norm, of every vector to every centroid (below NARROW), from the cells."""
    n, dim = len(block["ids"]), len(borders)
    cells = unpack_cells(block["cells"], n, dim, bits)
    low, high = (np.frombuffer(block[c], dtype=np.int64) for c in ("low", "high"))
    lower, upper = np.zeros((n, len(centroids)), dtype=np.int64), np.zeros((n, len(centroids)), dtype=np.int64)
    for d in range(dim):
        # The outer cells end where the block's own components do.
        least = np.maximum(np.concatenate([[low[d]], borders[d]]), low[d])
        most = np.minimum(np.concatenate([borders[d] - 1, [high[d]]]), high[d])
        c = centroids[:, d]
        ends = [c * c - 2 * e[:, None] * c for e in (least, most)]
        lower += np.minimum(*ends)[cells[:, d]]
        upper += np.maximum(*ends)[cells[:, d]]
    return lower, upper


def assign_block(block: dict, centroids: list[list[int]], borders: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """The nearest centroid of every vector of a block, and how many full vectors were fetched for it."""
    n, dim = len(block["ids"]), len(borders)
    narrow = [] if block["wide"] else [j for j, c in enumerate(centroids) if all(abs(x) < NARROW for x in c)]
    wide = sorted(set(range(len(centroids))) - set(narrow))
    nearest, fetched = np.zeros(n, dtype=np.int64), 0
    if narrow:
        c = np.array([centroids[j] for j in narrow], dtype=np.int64)
        lower, upper = intervals(block, c, borders, bits)
        near = lower <= upper.min(axis=1)[:, None]
        at = near.argmax(axis=1)  # decided where no other interval overlaps
        open_ = np.flatnonzero(near.sum(axis=1) > 1)
        if len(open_):
            x = full_vectors(block, dim)[open_]
            exact = np.where(near[open_], (c * c).sum(1)[None, :] - 2 * x @ c.T, np.iinfo(np.int64).max)
            at[open_] = exact.argmin(axis=1)
        nearest, fetched = np.array(narrow)[at], len(open_)
    if wide:
        # Python's integers for what does not fit: such vectors, and such centroids beside the best of the others.
        x, c = full_vectors(block, dim).astype(object), np.array(centroids, dtype=object)
        for i in range(n):
            tried = [int(nearest[i]), *wide] if narrow else wide
            nearest[i] = min(tried, key=lambda j: (((x[i] - c[j]) ** 2).sum(), j))
        fetched = n
    return nearest, fetched


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """A whole number in parts that add up: (place, part), each part of 18 digits."""
    sign, left, at = (1 if total >= 0 else -1), abs(total), 0
    while left:
        left, part = divmod(left, _LIMB)
        yield at, sign * part
        at += 1


def _whole(parts) -> int:
    return sum(int(p) * _LIMB**at for at, p in parts)


def _records(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def moved(blocks: DataFrame, centroids: list[list[int]], borders: np.ndarray, bits: int) -> list[list[int]]:
    """One round: all vectors assigned, then every centroid the floor of its vectors' mean."""
    dim, now = len(borders), blocks.sparkSession.sparkContext.broadcast((centroids, borders))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cell_ends = now.value
        total, count = np.zeros((len(c), dim), dtype=object), np.zeros(len(c), dtype=np.int64)
        for b in batches:
            for block in _records(b):
                nearest, _ = assign_block(block, c, cell_ends, bits)
                x = full_vectors(block, dim)
                for j in np.unique(nearest):
                    total[j] += x[nearest == j].sum(axis=0)
                count += np.bincount(nearest, minlength=len(c))
        # Dimension -1 holds the counts.
        out = [(j, d, at, part) for j in range(len(c)) for d in range(-1, dim) for at, part in _limbs(int(count[j]) if d < 0 else int(total[j][d]))]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["c", "d", "at", "part"])

    parts = blocks.mapInArrow(sums, "c long, d long, at long, part long")
    rows = parts.groupBy("c", "d", "at").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")).collect()
    found: dict[tuple[int, int], list] = {}
    for r in rows:
        found.setdefault((r.c, r.d), []).append((r["at"], r.part))
    n = [_whole(found.get((j, -1), ())) for j in range(len(centroids))]
    return [[_whole(found.get((j, d), ())) // n[j] for d in range(dim)] if n[j] else old for j, old in enumerate(centroids)]


def clustered(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, bits: int = BITS
) -> tuple[DataFrame, list[list[int]]]:
    """``id, cluster, distance`` (squared) of every vector that takes part, and the centroids after the last round."""
    spark = rows.sparkSession
    vectors = take_part(rows, id_col, vector_col, dim)
    centroids = first_centroids(vectors, k, scale)
    if not centroids:
        return spark.createDataFrame([], "id long, cluster int, distance long"), []
    some = vectors.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect()
    limit = float(NARROW)
    borders = cell_borders(np.array([[min(max(x * scale, -limit), limit) for x in r.v] for r in some]).reshape(-1, dim), bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("cells", "low", "high", "vectors")), ("wide", pa.bool_())])
        ids, held = [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block_rows(ids, held, borders, bits)], schema=schema)

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append([integer(x, scale) for x in v])
                if len(ids) == BLOCK:
                    yield block()
                    ids, held = [], []
        if ids:
            yield block()

    blocks = staged(vectors.mapInArrow(pack, _BLOCK_DDL), "va-file")
    for _ in range(rounds):
        centroids = moved(blocks, centroids, borders, bits)
    now = spark.sparkContext.broadcast((centroids, borders))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cell_ends = now.value
        for b in batches:
            for block in _records(b):
                nearest, _ = assign_block(block, c, cell_ends, bits)
                x = full_vectors(block, dim)
                own = np.array(c, dtype=x.dtype if all(abs(v) < NARROW for j in c for v in j) else object)[nearest]
                exact = [int(d) for d in ((x - own) ** 2).sum(axis=1)]
                fits = [d if d < 2**63 else None for d in exact]
                yield pa.RecordBatch.from_arrays([pa.array(block["ids"], pa.int64()), pa.array(nearest, pa.int32()), pa.array(fits, pa.int64())], ["id", "cluster", "distance"])

    return blocks.mapInArrow(assign, "id long, cluster int, distance long"), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings in 16 clusters after three rounds, with inertias and the centroids' digests."""
    found, centroids = clustered(documents(spark, sf_dir, "embeddings"))
    found = staged(found, "clusters")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    # A sum that lacks a distance is unknown, as the distance is.
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), whole).alias("s")).collect()
    of_cluster = {r.cluster: None if r.s is None else int(r.s) for r in sums}
    total = None if None in of_cluster.values() else sum(of_cluster.values())

    def as_long(n: int | None):
        return F.lit(n if n is not None and n < 2**63 else None).cast("bigint")

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    at = F.col("cluster") + 1
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        F.element_at(F.array(*[as_long(of_cluster.get(j)) for j in range(max(1, len(centroids)))]), at).alias("cluster_inertia"),
        as_long(total).alias("inertia"),
        F.element_at(F.array(*[F.lit(d) for d in digests]), at).alias("centroid_sha256"),
    )
