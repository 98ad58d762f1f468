"""Benchmark decontamination by spaced seeds.

A mask selects some positions of a window of words and ignores the others; the
hash of the selected words finds an overlap even where ignored words were
replaced. Seeds of the documents are joined with seeds of the benchmark; around
each hit the two texts are laid side by side on the hit's diagonal. An overlap is any
stretch of it that is long and equal enough; the best one, matches against
substitutions, is reported where it is such a stretch, else the longest that is.

Only documents that may hold a benchmark seed leave the scan: a Bloom filter of the
benchmark's seeds, of fixed size whatever the benchmark's, spares the others the
shuffle. It has no false negatives, and the join after it is exact.

Defined cases: null and empty texts overlap with nothing, as do benchmark items
without words or id; items shorter than MIN_WORDS must be met whole, and those
shorter than the shortest mask are sought as one run of all their words; repeated rows and
items are reported once; a null document id is reported as null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import by_position, columns, documents, salted_join, small_batches, staged, texts_of
from tallyfold.llm.shingles import forget, hashes_of

# Fixed masks: 1 selects a word, 0 ignores it.
MASKS = ["110111", "1101011", "1110010111"]
MIN_WORDS = 12
#: Least share of matching words in a reported stretch.
IDENTITY = 0.8
MATCH, SUBSTITUTION = 1, -2
FILTER_BITS = 1 << 25
_BITMAP = 8 * 4096
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    return hashes_of(_WORD.findall(text.lower()))


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the selected words of every window; the mask is part of it."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        s = np.full(n, np.uint64(xxhash.xxh64_intdigest(mask)), dtype=np.uint64)
        for j, c in enumerate(mask):
            if c == "1":
                s = (s ^ (s >> np.uint64(29))) * _MIX + h[j : j + n]
        return s ^ (s >> np.uint64(32))


def masks_for(lengths: set[int]) -> list[str]:
    """The fixed masks, and a full one for each length of an item too short for any of them."""
    shortest = min(map(len, MASKS))
    return MASKS + ["1" * n for n in sorted(lengths) if 0 < n < shortest]


def _slots(s: np.ndarray) -> list[np.ndarray]:
    """Three filter positions of each seed."""
    low = np.uint64(FILTER_BITS - 1)
    with np.errstate(over="ignore"):
        return [(v & low).astype(np.int64) for v in (s, s >> np.uint64(39), (s * _MIX) >> np.uint64(37))]


def benchmark_seeds(items: DataFrame, short: list[str]) -> DataFrame:
    """``seed, item_id, item_pos, slots`` of all benchmark windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                h = word_hashes(text)
                for mask in MASKS + [m for m in short if len(m) == len(h)]:
                    s = seeds(h, mask)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(s.view(np.int64)),
                            pa.array([item] * len(s), pa.string()),
                            pa.array(np.arange(len(s)), pa.int32()),
                            pa.array([list(x) for x in zip(*(v.tolist() for v in _slots(s)), strict=True)], pa.list_(pa.int32())),
                        ],
                        ["seed", "item_id", "item_pos", "slots"],
                    )

    return items.mapInArrow(run, "seed long, item_id string, item_pos int, slots array<int>")


def _filter(bench: DataFrame) -> np.ndarray:
    """The Bloom filter of all benchmark seeds; at most FILTER_BITS / 8 bytes reach the driver."""
    parts = (
        bench.select(F.explode("slots").alias("slot"))
        .groupBy((F.col("slot") / _BITMAP).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg((F.col("slot") % _BITMAP).cast("bigint")).alias("bits"))
    )
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        out[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def suspects(docs: DataFrame, bench: DataFrame, masks: list[str]) -> DataFrame:
    """``doc_id, text_hash, words (hashes), hits [(pos, seed)]`` of the documents that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(bench))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        hit_type = pa.list_(pa.struct([("pos", pa.int32()), ("seed", pa.int64())]))
        for b in small_batches(batches):
            texts = texts_of(b.column(1))
            each = [word_hashes(t) for t in texts]
            ends = np.cumsum([len(h) for h in each])
            flat = np.concatenate([*each, np.zeros(0, np.uint64)])
            found: dict[int, list] = {}
            for mask in masks:
                s = seeds(flat, mask)
                at = np.arange(len(s))
                for slot in range(3):
                    x = _slots(s)[slot]
                    ok = (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
                    s, at = s[ok], at[ok]
                doc = np.searchsorted(ends, at, side="right")
                inside = at + len(mask) <= ends[doc] if len(at) else np.zeros(0, dtype=bool)
                for d, p, v in zip(doc[inside].tolist(), at[inside].tolist(), s[inside].view(np.int64).tolist(), strict=True):
                    found.setdefault(d, []).append({"pos": p - int(ends[d] - len(each[d])), "seed": v})
            rows = sorted(found)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows)),
                        b.column(2).take(pa.array(rows)),
                        pa.array([each[d].tobytes() for d in rows], pa.binary()),
                        pa.array([found[d] for d in rows], hit_type),
                    ],
                    ["doc_id", "text_hash", "words", "hits"],
                )
        forget()

    schema = "doc_id long, text_hash long, words binary, hits array<struct<pos:int,seed:long>>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def best_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first, last + 1, matches) in words of the item: the best stretch on one diagonal."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return None
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    total = np.concatenate([[0], np.cumsum(np.where(same, MATCH, SUBSTITUTION))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    if end <= start:
        return None
    return lo + start, lo + end, int(same[start:end].sum())


def longest_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """As ``best_stretch``: the longest stretch of at least min(MIN_WORDS, item) words with identity IDENTITY, if there is any.

    At scores 1 - IDENTITY and -IDENTITY (as integers) these are the ranges of non-negative sum.
    Of the longest, different words at the ends are left out as far as it stays long enough.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    need = min(MIN_WORDS, len(item))
    if need <= 0 or hi - lo < need:
        return None
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    per_cent = round(100 * IDENTITY)
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - per_cent, -per_cent))])
    low = np.minimum.accumulate(total)
    # The first place with a total no higher than that of each end.
    first = np.searchsorted(-low, -total, side="left")
    end = int(np.argmax(np.arange(len(total)) - first))
    start = int(first[end])
    if end - start < need:
        return None
    while end - start > need and not same[end - 1]:
        end -= 1
    while end - start > need and not same[start]:
        start += 1
    return lo + start, lo + end, int(same[start:end].sum())


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """The stretch to report of one diagonal, if any of its stretches is long and equal enough."""
    s = best_stretch(doc, item, diagonal)
    if s and s[1] - s[0] >= min(MIN_WORDS, len(item)) and s[2] >= IDENTITY * (s[1] - s[0]):
        return s
    return longest_stretch(doc, item, diagonal)


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``doc_id, text_hash, item_id, doc_start, doc_end, item_start, item_end, matched`` (in words), the best one per document and item."""
    docs = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    items = columns(benchmark, item_id=item_col, text=text_col).filter("item_id is not null").select(F.col("item_id").cast("string"), "text").distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [word_hashes(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in h], pa.binary()), pa.array([len(x) for x in h], pa.int32())], ["item_id", "item_words", "n"])

    measured = staged(items.mapInArrow(measure, "item_id string, item_words binary, n int"), "benchmark-words")
    shortest = min(map(len, MASKS))
    lengths = {r.n for r in measured.filter(F.col("n").between(1, shortest - 1)).select("n").distinct().collect()}  # a few numbers
    masks = masks_for(lengths)
    bench = staged(benchmark_seeds(items, masks[len(MASKS) :]), "benchmark-seeds")
    held = staged(suspects(docs, bench, masks).dropDuplicates(["doc_id", "text_hash"]), "suspects")
    hits = held.select("doc_id", "text_hash", F.explode("hits").alias("h")).select("doc_id", "text_hash", F.col("h.pos").alias("pos"), F.col("h.seed").alias("seed"))
    # A seed, or an item, may be that of a third of all documents: its rows are dealt to several parts.
    on = salted_join(hits, bench.select("seed", "item_id", "item_pos"), ["seed"], ["doc_id", "text_hash", "pos"])
    on = on.select("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    # All diagonals of a document and an item in one row, so that their words are there once.
    on = on.groupBy("doc_id", "text_hash", "item_id").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    key = lambda d: F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text_hash")
    sides = on.withColumn("k", key(on)).join(held.select(key(held).alias("k"), "words"), "k")
    sides = salted_join(sides, measured, ["item_id"], ["doc_id", "text_hash"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for r, (d, item, diagonals) in enumerate(zip(b.column(4), b.column(5), b.column(3).to_pylist(), strict=True)):
                item, words = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (item, d))
                for diagonal in diagonals:
                    s = overlap(words, item, diagonal)
                    if s:
                        keep.append(r)
                        out.append((s[0] + diagonal, s[1] + diagonal, *s))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            rows = [b.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*rows, *(pa.array(c, pa.int32()) for c in cols)], names)

    names = ["doc_id", "text_hash", "item_id", "doc_start", "doc_end", "item_start", "item_end", "matched"]
    schema = "doc_id long, text_hash long, item_id string, " + ", ".join(f"{n} int" for n in names[3:])
    seen = sides.select("doc_id", "text_hash", "item_id", "diagonals", "words", "item_words").mapInArrow(verify, schema)
    best = F.max(F.struct("matched", (-F.col("doc_start")).alias("first"), "doc_end", "item_start", "item_end")).alias("s")
    return seen.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", (-F.col("s.first")).alias("doc_start"), "s.doc_end", "s.item_start", "s.item_end", "s.matched"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows that overlap with a benchmark item; all columns stay."""
    bad = staged(overlaps(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col), "overlaps")
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows, where = by_position(docs)
    text = F.coalesce(F.col(where[text_col]), F.lit(""))
    same = F.col(where[id_col]).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    return rows.join(bad, same, "left_anti").toDF(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in ``documents``: one row per document and item."""
    found = overlaps(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item_id").cast("long").alias("item_id"), "doc_start", "doc_end", "item_start", "item_end", "matched")
