"""T4 from a state store: the row as it stands after each update, on a stream.

Each key's running total is one row of a streaming aggregate in Spark's state store (RocksDB),
checkpointed with the stream. A micro-batch asks the store once per key and stores the new total once;
no folder of an earlier batch is read, and no Python runs. The stream's output is the batch's own
rows beside the totals of their keys after the batch (update mode gives those that moved). A total less
the batch's own rows is the total before it; the rows' order inside of the batch is
the prefix scan of W1 (``operators.running``), which spreads a hot key over tasks.

The store goes back to a batch's start when the batch is replayed, and its folder of results
is overwritten: every update is answered once, with the same row.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.model import KEY
from tallyfold.operators.fold import exact_sum
from tallyfold.operators.running import running_result
from tallyfold.streaming.fold_stream import source_id

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEED_DDL = "id STRING, type STRING, delta BIGINT"
_WIDE = "decimal(38,0)"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB: on disk, not on the executors' heap."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


def _totals(rows: DataFrame) -> DataFrame:
    """Per key the exact sum of all deltas (it may leave int64 on the way), and the counts of rows and of null deltas."""
    return rows.groupBy(*KEY).agg(
        F.coalesce(exact_sum("delta").cast(_WIDE), F.lit(0).cast(_WIDE)).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("delta").isNull(), 1)).alias("nulls"),
    )


def with_totals(updates: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """A stream of updates (``n`` is null), and of their keys' totals after the micro-batch; for update mode.

    ``seed``: a stream of the state (``id, type, delta``) that the totals begin with, all of it in the first micro-batch.
    """
    rows = updates.select("seq", *KEY, "delta", "value")
    counted = rows.select(*KEY, "delta")
    totals = _totals(counted if seed is None else counted.unionByName(seed.select(*KEY, "delta")))
    return rows.unionByName(totals, allowMissingColumns=True)


def answered(rows: DataFrame) -> DataFrame:
    """The results of one micro-batch of ``with_totals``."""
    own = F.col("n").isNull()
    count = lambda c: F.count(F.when(c, 1))
    # The store's row of a key is one, so its largest values are its values.
    keys = rows.groupBy(*KEY).agg(
        (F.max("total") - F.coalesce(exact_sum(F.when(own, F.col("delta"))), F.lit(0).cast("decimal(20,0)"))).cast(_WIDE).alias("before"),
        (F.max("n") - count(own)).alias("earlier"),
        (F.max("nulls") - count(own & F.col("delta").isNull())).alias("nulls"),
        count(own).alias("here"),
    )
    # A seeded key that has no update here is not asked for.
    before = keys.filter("earlier > 0 and here > 0").select(*KEY, F.when(F.col("nulls") == 0, F.col("before")).alias("delta"))
    return running_result(rows.filter(own), state=before, picked=True)


def _seed_stream(spark: SparkSession, seed: DataFrame | None, checkpoint: str) -> DataFrame:
    """The seed (or none) as a stream of its own; it is written once, beside a new checkpoint's files."""
    path = f"{checkpoint}/seed"
    try:
        source_id(spark, checkpoint)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        seed = spark.createDataFrame([], _SEED_DDL) if seed is None else seed
        seed.select(*KEY, F.col("delta").cast("bigint").alias("delta")).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(_SEED_DDL).parquet(path)


def start_result_stream(
    updates: DataFrame, results_root: str, checkpoint: str, seed: DataFrame | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Start the stream that writes every update's result, a folder per micro-batch.

    ``seed``: the state (``id, type, delta``) that a new checkpoint begins with; an old one has its own.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            source = source_id(batch.sparkSession, checkpoint)
            answered(rows).write.mode("overwrite").parquet(f"{results_root}/source={source}/batch_id={int(batch_id)}")
        finally:
            rows.unpersist()

    totals = with_totals(updates, _seed_stream(updates.sparkSession, seed, checkpoint))
    writer = totals.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    with rocksdb(updates.sparkSession):
        return writer.start()
