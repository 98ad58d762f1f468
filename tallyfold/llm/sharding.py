"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a number u in (0, 1), the first 52 bits of a SHA-256 of both, and
the score -weight / ln(u). A record goes to the shard with the highest score (ties: the
smaller number). The score of a pair depends on nothing else, so one more shard
takes records only into itself, a lost shard gives only its own away, and a shard gets
its share of the weights. Nothing is fitted, counted or gathered: the shard is an
expression of the row, and rows are written into the shards' folders by the tasks
that read them, without a shuffle.

``numbered`` gives each record its slot in the shard, gapless from 0. Records that agree in
all columns are counted, not moved one by one, and numbered by ranges: they are dealt to
buckets by a hash of the whole record, a window counts inside of a bucket, and the
buckets' totals give where each of them begins. So no window holds a shard, and a
record that a third of all rows repeat is one row until its slots are listed.

Defined cases: a null key is a key of its own; records with equal keys meet in one shard,
equal texts under different keys need not; a null text is empty in size and checksum; repeated
rows take one slot each; a shard of weight 0 gets nothing; an empty table gives no rows. Only
the key columns are read by name, all others are written as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import columns, documents
from tallyfold.session import scratch_path

SHARDS = 8
#: Hex digits of the SHA-256 that make u: 52 bits, which a double holds exactly.
DIGITS = 13
#: Distinct records that one bucket of the numbering has on average.
BUCKET_ROWS = 1 << 15
#: Slots that one row lists at once.
RANGE_ROWS = 1 << 14
LAW = "key"


def key_text(*keys: str) -> Column:
    """The key columns as one text; null and the empty text differ, and so do ("a", "bc") and ("ab", "c")."""
    return F.concat(*[F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys])


def _score(key: Column, shard: Column, weight: Column) -> Column:
    digest = F.sha2(F.concat(key, F.lit("@"), shard.cast("string")).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -weight / F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key (text) among ``len(weights)`` shards."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("a shard's weight is 0 or more, and one of them is not 0")
    scored = [F.struct(_score(key, F.lit(s), F.lit(float(w))).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*scored))["shard"]).cast("int")


def sharded(rows: DataFrame, keys: Sequence[str], weights: Sequence[float], *, name: str = "shard") -> DataFrame:
    """``rows`` with the shard of each; ``name`` must be new."""
    return rows.withColumn(name, shard_of(key_text(*keys), weights))


def write_shards(rows: DataFrame, path: str, shard: str = "shard") -> None:
    """Write rows into a folder per shard, each task its own files: no shuffle, so no shard or key is hot."""
    rows.write.partitionBy(shard).parquet(path)


def numbered(records: DataFrame, shard: str = "shard", *, bucket_rows: int = BUCKET_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``records`` and the ``slot`` of each in its shard, by the order of a hash of all columns, then of the columns.

    The columns must have an order (no maps): give the narrow columns that identify a record.
    """
    cols = records.columns
    # The bucket comes from the record's hash, so buckets are even whatever the keys are.
    whole = F.sha2(key_text(*cols).cast("binary"), 256)
    place = F.conv(F.substring(whole, 1, DIGITS), 16, 10).cast("bigint")
    groups = records.withColumn("_place", place).groupBy(*cols, "_place").agg(F.count(F.lit(1)).alias("_n"))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("_rows") / bucket_rows)).cast("bigint")
    counts = records.agg(F.count(F.lit(1)).alias("_rows")).select(n_buckets.alias("_buckets"))
    bits = 16**DIGITS
    # The product of a 52-bit place and the number of buckets needs a decimal.
    groups = groups.join(F.broadcast(counts)).withColumn(
        "_bucket", F.floor(F.col("_place").cast("decimal(20,0)") * F.col("_buckets").cast("decimal(12,0)") / F.lit(bits).cast("decimal(20,0)")).cast("bigint")
    ).drop("_buckets")
    inside = Window.partitionBy(shard, "_bucket").orderBy("_place", *cols).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    totals = groups.groupBy(F.col(shard).alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum("_n").alias("_total"))
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_s", "_b", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    begins = groups.join(offsets, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    begins = begins.select(*cols, "_n", (F.col("_offset") + F.col("_before")).alias("_begin"))
    # A record's slots: ranges first, dealt to all tasks, then each range is listed.
    ranges = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / range_rows)))
    ranged = begins.select(*cols, "_begin", "_n", ranges.alias("_range"))
    first = F.col("_begin") + F.col("_range") * range_rows
    last = F.least(first + (range_rows - 1), F.col("_begin") + F.col("_n") - 1)
    return ranged.select(*cols, F.explode(F.sequence(first, last)).alias("slot"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written into eight equal shards by their id; then, read from the shards' files, each record's slot."""
    docs = columns(documents(spark, sf_dir), doc_id="doc_id", text="text")
    path = scratch_path(spark, "shards")
    grown = sharded(docs, ["doc_id"], [1.0] * (SHARDS + 1), name="grown_shard")
    write_shards(sharded(grown, ["doc_id"], [1.0] * SHARDS), path)
    read = spark.read.schema("doc_id long, text string, grown_shard int, shard int").parquet(path)
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    records = read.select("doc_id", (F.octet_length(bytes_).cast("bigint") + 1).alias("size"), F.crc32(bytes_).alias("text_crc32"), "shard", "grown_shard")
    return numbered(records).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
