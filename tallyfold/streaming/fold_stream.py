"""Continuous metric folds on Structured Streaming.

``stream_report`` is the live report window (T2). The fold comes in two forms:

* ``stream_fold``: the fold as a streaming aggregation (``outputMode("update")``);
  Spark keeps per-key state in its state store and checkpoints it.
* ``start_state_stream``: a stateless stream whose ``foreachBatch`` folds each
  micro-batch into a folder of its own (``tallyfold.sources.snapshot``), optionally
  with the per-update results (W1) of that batch. The folder is named by the
  stream's source id and the batch id and overwritten on a replay, so a batch
  counts once; the source id is the checkpoint's own, so neither a second stream nor a fresh
  checkpoint can meet another's batches. State lives in these folders, not in
  the state store, and ordinary batch jobs restore, read and rebase it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.model import KEY, STATE_COLUMNS
from tallyfold.operators.fold import fold_updates, last_by_seq, null_propagating_sum
from tallyfold.operators.running import running_result
from tallyfold.sources.snapshot import compact, state_before, write_batch

#: Distinct keys of a micro-batch that are broadcast to pick their rows of the state: some 50 MB.
KEYS_IN_MEMORY = 500_000


def stream_fold(updates: DataFrame) -> DataFrame:
    """Streaming fold, one row per key, emitted in update mode."""
    return fold_updates(updates).select(*STATE_COLUMNS, "seq")


def stream_report(updates: DataFrame, every: str, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """T2 live: per tumbling report window and metric, polls and the folded metric.

    Without ``watermark`` run it in ``update`` mode (window rows are re-emitted as
    they change; window state is kept). With ``watermark`` (e.g. ``"10 seconds"``)
    ``append`` mode emits each window once, after the watermark passes it, and
    Spark drops the window's state: bounded state for an endless stream.
    """
    src = updates.withWatermark(ts, watermark) if watermark else updates
    return src.groupBy(F.window(ts, every).alias("window"), *KEY).agg(
        F.count(F.lit(1)).alias("polls"),
        null_propagating_sum("delta").alias("delta"),
        last_by_seq("value").alias("value"),
        F.max("seq").alias("seq"),
    )


def source_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave a stream when it made its checkpoint; it lasts as long as that."""
    return spark.read.json(f"{checkpoint}/metadata").select("id").first().id


def apply_batch(batch: DataFrame, batch_id: int, state_root: str, source: str, results_root: str | None = None, fan: int | None = None) -> None:
    """Fold one micro-batch of a source into its folder under the state root.

    The write is proportional to the batch, not to the state. With ``results_root``
    the per-update results are written too, from the state before this batch: only
    the batch's own keys of it are used, picked before the state is folded. Where they
    are few (KEYS_IN_MEMORY, counted) they are broadcast, so that no state row is shuffled but theirs.
    With ``fan`` the folders of earlier batches are compacted along the way.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        if results_root is not None:
            keys = batch.select(*KEY).distinct()
            keys = F.broadcast(keys) if keys.count() <= KEYS_IN_MEMORY else keys
            before = state_before(spark, state_root, source, batch_id, keys)
            out = f"{results_root}/source={source}/batch_id={int(batch_id)}"
            running_result(batch, state=before, picked=True).write.mode("overwrite").parquet(out)
        write_batch(batch, state_root, source, batch_id)
        if fan is not None and batch_id % fan == fan - 1:
            compact(spark, state_root, source, batch_id, fan)
    finally:
        batch.unpersist()


def start_state_stream(
    updates: DataFrame,
    state_root: str,
    checkpoint: str,
    trigger: dict | None = None,
    results_root: str | None = None,
    fan: int | None = None,
) -> StreamingQuery:
    """Start the upsert stream. ``trigger`` is passed to ``DataStreamWriter.trigger``
    (e.g. ``{"processingTime": "5 seconds"}`` or ``{"availableNow": True}``). With ``fan``
    every so many batches the state's folders are compacted (``snapshot.compact``)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, state_root, source_id(batch.sparkSession, checkpoint), results_root, fan)

    writer = updates.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
