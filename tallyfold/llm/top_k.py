"""Exact top-k inner products by pivot-table elimination.

The distances of every vector to many pivots are computed once a task, and candidates that lie alike are
put in groups. For a query, the triangle inequality turns a group's distances into a lower bound of its
distance to each of them (the largest over all pivots), and with the norms into an upper bound of the inner
product. A query's best group comes first; then each group is evaluated, in exact integers, for the queries whose
k-th score found its bound still reaches: the answer is exact, whatever the pivots.

Work is dealt as blocks of candidates: a task holds one of them, meets the queries a block at a time, and
returns k rows a query, which are merged in two steps, so no list grows with the number of blocks.
The driver gets two counts and the pivots, whatever the data.

Components become floor(256 x). Defined cases: vectors that are null, empty or hold null
or non-finite components take no part; missing components of a shorter vector count as 0;
rows that repeat id and vector are one, an id with several vectors asks with each of
them and the answers are merged; fewer than k candidates give fewer rows; ties go to the smaller id. Large components are
exact too, in Python's integers; only a score that does not fit in a long is refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import columns, documents, staged

PIVOTS = 48
#: Rows that pivots are chosen from, in one task: 2000 vectors.
PIVOT_SAMPLE = 2000
#: Vectors of a block at most; blocks of long vectors hold fewer (BLOCK_VALUES components).
CANDIDATE_BLOCK = 1 << 18
BLOCK_VALUES = 1 << 24
QUERY_BLOCK = 2048
SCALE = 256
#: Least rows of a candidate block, where smaller blocks keep more cores busy.
LEAST_BLOCK = 1024
#: Components of a shuffled row, which is as many vectors as have them.
PACK_VALUES = 1024
#: Blocks whose results are merged first.
MERGED_BLOCKS = 256
_LARGEST = 1 << 62
_LEAST_LONG, _MOST_LONG = -(1 << 63), (1 << 63) - 1
#: Pivot distances are kept in 32 bits; what their rounding may make up.
_ROUNDING = 1e-6


def integer_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v`` (array of long) of the rows that take part."""
    r = columns(rows, id=id_col, v=vector_col).select(F.col("id").cast("bigint").alias("id"), "v")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    r = r.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    return r.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("v"))


def choose_pivots(vectors: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Far-apart pivots: each next one has the largest least distance to those before."""
    if not len(vectors):
        return np.zeros((0, 0))
    x, chosen = vectors.astype(np.float64), [0]
    least = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    # By differences: no digits are lost where vectors are long and close to each other.
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1)) if len(pivots) else np.zeros((len(x), 0))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of ``dim`` components."""
    lengths, values = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim), dtype=np.int64)
    out[np.arange(dim) < lengths[:, None]] = values
    if out.size and (out.max() >= _LARGEST or out.min() <= -_LARGEST):
        raise OverflowError("components this large have no score in a long")
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.sqrt((x[at : at + 8192].astype(np.float64) ** 2).sum(1)) for at in range(0, len(x), 8192))])


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """``pivot_distances`` in 32 bits, some rows at a time."""
    out = np.zeros((len(x), len(pivots)), dtype=np.float32)
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = pivot_distances(x[at : at + 8192], pivots)
    return out


class Candidates:
    """A block of candidates in groups that lie alike."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, to_pivots: np.ndarray):
        n, size = len(ids), min(max(len(ids) // 256, 64), 1024)
        nearest = to_pivots.argmin(1) if to_pivots.shape[1] else np.zeros(n, dtype=np.int64)
        distance = to_pivots[np.arange(n), nearest] if to_pivots.shape[1] else np.zeros(n)
        order = np.lexsort((ids, distance, nearest))  # equal vectors by id: of ties the first group has the winners
        self.ids, self.x = ids[order], x[order]
        self.groups = [(at, min(n, at + size)) for at in range(0, n, size)]
        lengths = _lengths(self.x)
        self.longest = np.array([lengths[a:b].max() for a, b in self.groups])
        self.least, self.most = (
            np.array([f(to_pivots[order[a:b]], axis=0) for a, b in self.groups], dtype=np.float64).reshape(len(self.groups), -1) for f in (np.min, np.max)
        )

    def bounds(self, lengths: np.ndarray, to_pivots: np.ndarray) -> np.ndarray:
        """No inner product of a query (row) with one of a group (column) is above."""
        lower = np.zeros((len(lengths), len(self.groups)))
        # Less the rounding of the distances and the norms.
        for p in range(to_pivots.shape[1]):
            d = to_pivots[:, p, None].astype(np.float64)
            np.maximum(lower, self.least[:, p] * (1 - _ROUNDING) - d * (1 + _ROUNDING), out=lower)
            np.maximum(lower, d * (1 - _ROUNDING) - self.most[:, p] * (1 + _ROUNDING), out=lower)
        lower = np.maximum(0, lower - 1e-3)
        apart = (self.longest**2 + lengths[:, None] ** 2) * (1 + 1e-9) / 2 - lower**2 * (1 - 1e-9) / 2
        return np.minimum(apart, self.longest * lengths[:, None] * (1 + 1e-9)) + 0.5

    def search(self, q_ids: np.ndarray, q: np.ndarray, to_pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query ids, candidate ids and scores of the best k a query; and the evaluations made."""
        best, lengths = _Best(q_ids, k), _lengths(q)
        if not len(q) or not self.groups:
            return *best.rows(), 0
        upper, single, evaluated = self.bounds(lengths, to_pivots), q.astype(np.float32), 0
        first = upper.argmax(1)

        def meet(g: int, rows: np.ndarray) -> int:
            a, b = self.groups[g]
            # Sums below 2^24 are exact in 32 bits, below 2^53 in 64, in any order: none is above the product of the lengths.
            reach = self.longest[g] * lengths[rows] * (1 + 1e-6)
            kinds = ((np.float32, reach < 2**24), (np.float64, (reach >= 2**24) & (reach < 2**53)), (object, reach >= 2**53))
            for kind, fits in kinds:
                if len(r := rows[fits]):
                    asked = single[r] if kind is np.float32 else q[r].astype(kind)
                    best.offer(r, self.ids[a:b], asked @ self.x[a:b].astype(kind).T)
            return len(rows) * (b - a)

        for g in np.unique(first):
            evaluated += meet(g, np.flatnonzero(first == g))
        for g in np.argsort(-upper.max(axis=0), kind="stable"):
            # Only where the bound reaches the k-th score.
            rows = np.flatnonzero((upper[:, g] >= best.edge()) & (first != g))
            if len(rows):
                evaluated += meet(g, rows)
        return *best.rows(), evaluated


class _Best:
    """The k best found so far of each query of a block."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k, m = q_ids, k, len(q_ids)
        self.found = np.zeros(m, dtype=np.int64)
        self.ids, self.scores = np.zeros((m, k), dtype=np.int64), np.zeros((m, k), dtype=np.int64)
        self.over = np.zeros((m, k), dtype=bool)  # the score does not fit in a long

    def edge(self) -> np.ndarray:
        return np.where(self.found == self.k, self.scores[:, -1].astype(np.float64), -np.inf)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of queries (``rows``) with candidates (``ids``)."""
        full = self.found[rows] == self.k
        if not full.all():
            self._offer_all(rows[~full], ids, scores[~full])
            if not full.any():
                return
            rows, scores = rows[full], scores[full]
        last = self.scores[rows, -1].astype(scores.dtype)
        some = np.flatnonzero(scores.max(axis=1) >= last)
        at, c = np.nonzero(scores[some] >= last[some, None])
        self._merge(rows[some[at]], ids[c], scores[some[at], c])

    def _offer_all(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores[ids == self.q_ids[rows, None]] = -np.inf
        if (n := scores.shape[1]) > self.k:
            edge = (np.sort(scores, axis=1) if scores.dtype == object else np.partition(scores, n - self.k, axis=1))[:, n - self.k, None]
            at, c = np.nonzero((scores >= edge) & (scores > -np.inf))
        else:
            at, c = np.nonzero(scores > -np.inf)
        self._merge(rows[at], ids[c], scores[at, c])

    def _merge(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        over = np.zeros(len(scores), dtype=bool)
        if scores.dtype == object:
            over = ((scores > _MOST_LONG) | (scores < _LEAST_LONG)).astype(bool)
            scores = np.minimum(np.maximum(scores, _LEAST_LONG), _MOST_LONG)
        scores = scores.astype(np.int64)
        # Of those that tie with the last found only smaller ids matter.
        new = (ids != self.q_ids[q]) & ((self.found[q] < self.k) | (scores > self.scores[q, -1]) | (ids < self.ids[q, -1]))
        if not new.any():
            return
        q, ids, scores, over = q[new], ids[new], scores[new], over[new]
        u = np.unique(q)
        row, col = np.nonzero(np.arange(self.k) < self.found[u, None])
        row = u[row]
        q, ids, scores, over = (np.concatenate(x) for x in ((row, q), (self.ids[row, col], ids), (self.scores[row, col], scores), (self.over[row, col], over)))
        order = np.lexsort((ids, ~scores, q))  # ~s falls as s grows, also at the ends of a long
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, rank = order[rank < self.k], q[rank < self.k], rank[rank < self.k]
        self.ids[q, rank], self.scores[q, rank], self.over[q, rank] = ids[order], scores[order], over[order]
        np.maximum.at(self.found, q, rank + 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = np.arange(self.k) < self.found[:, None]
        if self.over[there].any():
            raise OverflowError("a score does not fit in a long")
        return np.repeat(self.q_ids, self.found), self.ids[there], self.scores[there]


def search_block(ids, x, to_pivots, q_ids, q, q_to_pivots, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query id, candidate id, score) of the best k of one block a query; and the evaluations made."""
    *found, evaluated = Candidates(ids, x, to_pivots).search(q_ids, q, q_to_pivots, k)
    return list(zip(*(c.tolist() for c in found), strict=True)), evaluated


def _packed(rows: DataFrame, dim: int, limit: int) -> DataFrame:
    """Up to ``limit`` vectors a row: ids and vectors as bytes, in as few as hold the components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, m = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            out: list[tuple[bytes, bytes]] = []
            for at in range(0, len(ids), limit):
                v = m[at : at + limit]
                most = max(v.max(initial=0), -v.min(initial=0))
                kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
                out.append((ids[at : at + limit].astype("<i8").tobytes(), v.astype(kind).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["ids", "vectors"])

    return rows.select("id", "v").mapInArrow(pack, "ids binary, vectors binary")


def _unpacked(packs: list[tuple[pa.Buffer, pa.Buffer]], dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.frombuffer(i, dtype="<i8") for i, _ in packs]
    vectors = [np.frombuffer(v, dtype=f"<i{memoryview(v).nbytes // (len(i) * dim)}").reshape(len(i), dim) for i, (_, v) in zip(ids, packs, strict=True)]
    return np.concatenate(ids), np.concatenate(vectors)


def _pivots(vectors: DataFrame, n: int, dim: int, pivots: int) -> np.ndarray:
    """The pivots, chosen on an executor from a bounded sample: they change speed, never results.

    Before the least hashes are taken, all but some four times as many rows are left out: a task's share of them does not grow with the tasks.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_matrix(b.column(0), dim) for b in batches if b.num_rows]
        if found:
            for p in choose_pivots(np.concatenate(found), pivots):
                yield pa.RecordBatch.from_arrays([pa.array([p.astype("<f8").tobytes()], pa.binary())], ["pivot"])

    digest = F.xxhash64("id", "v")
    some = vectors.filter(F.pmod(digest, F.lit(max(1, n // (4 * PIVOT_SAMPLE)))) == 0)
    chosen = some.orderBy(digest).limit(PIVOT_SAMPLE).select("v").mapInArrow(choose, "pivot binary").collect()
    return np.array([np.frombuffer(r.pivot, dtype="<f8") for r in chosen]).reshape(len(chosen), dim)


def top_k(rows: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every row that ``is_query`` (a condition on ``id``) picks."""
    spark = rows.sparkSession
    vectors = staged(integer_vectors(rows, id_col=id_col, vector_col=vector_col).dropDuplicates(["id", "v"]), "vectors")
    n, longest = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = longest or 0
    table = spark.sparkContext.broadcast(_pivots(vectors, n, dim, pivots))
    block = min(CANDIDATE_BLOCK, max(1, BLOCK_VALUES // max(1, dim)))
    n_parts = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    pack = max(1, min(PACK_VALUES // max(1, dim), n // (256 * n_parts)))
    candidates, queries = _packed(vectors, dim, pack), _packed(vectors.filter(is_query(F.col("id"))), dim, pack)
    # The stated queries against all rows: a part has its candidates, then all queries.
    dealt = candidates.select(F.pmod(F.xxhash64("ids"), F.lit(n_parts)).cast("int").alias("part"), F.lit(0).alias("asks"), "ids", "vectors")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.lit(1).alias("asks"), "ids", "vectors")
    jobs = dealt.unionAll(asked).repartitionById(n_parts, "part").sortWithinPartitions("part", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, block, waiting, n_waiting = None, [], None, [], 0

        def answer() -> pa.RecordBatch:
            q_ids, q = _unpacked(waiting, dim)
            *found, _ = block.search(q_ids, q, _to_pivots(q, table.value), k)
            bucket = np.full(len(found[0]), part // MERGED_BLOCKS, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*found, bucket)], ["query_id", "vec_id", "score", "bucket"])

        for b in batches:
            for p, asks, ids, vectors in zip(*b.columns, strict=True):
                if p.as_py() != part:
                    if waiting and block:
                        yield answer()
                    part, held, block, waiting, n_waiting = p.as_py(), [], None, [], 0
                row = ids.as_buffer(), vectors.as_buffer()
                if not asks.as_py():
                    held.append(row)
                    continue
                if held:
                    of, x = _unpacked(held, dim)
                    held, block = [], Candidates(of, x, _to_pivots(x, table.value))
                waiting.append(row)
                n_waiting += row[0].size // 8
                if n_waiting >= QUERY_BLOCK:
                    if block:
                        yield answer()
                    waiting, n_waiting = [], 0
        if waiting and block:
            yield answer()

    part = jobs.mapInArrow(search, "query_id long, vec_id long, score long, bucket long")

    def leading(rows: DataFrame, *key: str) -> DataFrame:
        best = rows.groupBy(*key).agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("found"))
        out = best.select(*key, F.posexplode(F.slice(F.array_sort("found"), 1, k)).alias("pos", "f"))
        return out.select(*key, (F.col("pos") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))

    # k rows per query and block: first among some blocks, then over all.
    return leading(leading(part, "query_id", "bucket"), "query_id")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every 50th embedding."""
    return top_k(documents(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
