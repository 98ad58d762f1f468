"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import scratch_path

#: Buckets of a fixed-size id filter (bits). Its broadcast is 4 MB whatever the data.
FILTER_BITS = 1 << 25
_BITS_PER_BITMAP = 8 * 4096
#: A key of more than this part of all rows is split: one in HOT_SHARE.
HOT_SHARE = 8192


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names that cannot clash, and where each of its names went (the first of equal ones)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    where = dict(zip(reversed([c.lower() for c in df.columns]), reversed(names), strict=True))
    return df.toDF(*names), where | dict(zip(reversed(df.columns), reversed(names), strict=True))


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the columns used, under our own names: extra or clashing columns cannot interfere."""
    renamed, where = by_position(df)
    return renamed.select(*[F.col(where[src]).alias(dst) for dst, src in named.items()])


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path: local, HDFS, S3 or GCS, as Arrow knows them."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: what a task makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def places_in(text: str, lower: str) -> Callable[[int, int], tuple[int, int]]:
    """Where a span of ``lower``, the lower case of ``text``, lies in ``text`` (a few letters have a longer lower case)."""
    if len(lower) == len(text):
        return lambda start, end: (start, end)
    ends = np.cumsum([len(c.lower()) for c in text])
    return lambda start, end: (int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, end, side="left")) + 1)


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str], salts: int = 16) -> DataFrame:
    """Inner join of many ``rows`` with one row ``per_key``; a key's rows are dealt to ``salts`` parts.

    For keys that may hold a third of all rows. The other side is small: it is repeated ``salts`` times.
    """
    parts = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return dealt.join(parts, [*keys, "__salt"]).drop("__salt")


def hot_keys(per_key: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``key, __parts`` of the keys that hold more than 1 / HOT_SHARE of all ``total`` rows; ``weight`` is a key's number of rows.

    They are fewer than HOT_SHARE whatever the data, and their parts of at most that share fewer than twice as many.
    """
    size = total // HOT_SHARE + 1
    return per_key.filter(F.col(weight) > size).select(key, F.ceil(F.col(weight) / size).cast("int").alias("__parts"))


def split_join(rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: Column, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join of many ``rows`` with one row ``per_key``; rows of a hot key (of ``hot_keys``, by ``keys[0]``) go to its parts.

    Only the rows of hot keys on the other side are repeated. ``how`` is inner or left.
    """
    hot = F.broadcast(hot)
    part = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__parts")).cast("int"), F.lit(0))
    dealt = rows.join(hot, keys[0], "left").withColumn("__part", part).drop("__parts")
    copies = per_key.join(hot, keys[0], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__part"], how).drop("__part")


def id_filter(ids: Column, df: DataFrame) -> np.ndarray:
    """A fixed-size hashed bitmap of the ids of ``df`` (one-sided: no false negatives).

    Built by Spark's bitmap aggregates; what reaches the driver is FILTER_BITS / 8
    bytes at most, however many ids there are. An exact join must follow.
    """
    slot = F.pmod(F.xxhash64(ids), F.lit(FILTER_BITS))
    parts = (
        df.select(slot.alias("slot"))
        .groupBy((F.col("slot") / _BITS_PER_BITMAP).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg((F.col("slot") % _BITS_PER_BITMAP).cast("bigint")).alias("bits"))
    )
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        out[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """True where the filter may hold the slot (see ``filter_slot``)."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def filter_slot(ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(FILTER_BITS))
