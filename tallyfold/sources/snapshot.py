"""Metric state on shared storage: state folders (S5, S7, S8, S9, T3), JSON snapshot
files (S4) and restore (S6).

Layout under a state root (HDFS/S3/local, whatever the cluster shares)::

    root/base/                                  one whole state, written once (parquet)
    root/included/                              per source, the last batch that the base holds
    root/batch/source=<s>/first=<a>/last=<b>/   the folded micro-batches a to b (parquet)

The state is the fold of all of it: the fold is associative and ordered by ``seq``, so
neither the order of folders nor their number matters. A micro-batch writes only its
own folder (first = last) and overwrites it when it is replayed, so it counts once; no log is
needed for that. Batch ids belong to a source (a stream's checkpoint), so a second
stream, or a fresh checkpoint, gets folders of its own. ``rebase`` folds a root
into the base of a new root, as an ordinary batch job beside the stream.

``compact`` folds neighbouring folders into one of their whole range, while the stream
runs. A reader takes the folders that no other finished folder of their source contains, so
a range counts once before, during and after, and a batch that is replayed
into a folder of its own is covered already. A covered folder is removed by the next call
but one that finds it, so a job that listed it before has time to read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.model import KEY, STATE_COLUMNS, STATE_SCHEMA
from tallyfold.operators.fold import fold_states, fold_updates
from tallyfold.operators.running import of_keys
from tallyfold.sources.json_ingest import batch_bodies

STATE_WITH_SEQ_DDL = "id STRING, type STRING, delta BIGINT, value DOUBLE, seq BIGINT"
_INCLUDED_DDL = "source STRING, upto BIGINT"
#: Folders of one size that ``compact`` folds into one; also the ratio of the sizes.
FAN = 16
_COVERED = "_covered"


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (e.getCondition() or "")


def _folder(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A folder's rows; none if it does not exist yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], ddl)


def _with_seq(df: DataFrame) -> DataFrame:
    cols = [c for c in (*STATE_COLUMNS, "seq") if c in df.columns]
    out = df.select(*cols)
    return out if "seq" in cols else out.withColumn("seq", F.lit(None).cast("bigint"))


class Range(NamedTuple):
    """A folder of one source's batches ``first`` to ``last``."""

    source: str
    first: int
    last: int

    def path(self, root: str) -> str:
        return f"{root}/batch/source={self.source}/first={self.first}/last={self.last}"

    def holds(self, other: Range) -> bool:
        return self != other and self.source == other.source and self.first <= other.first and other.last <= self.last


def _storage(spark: SparkSession, path: str):
    """The storage of a path, as Spark's own readers and writers see it, and the path there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def finished_ranges(spark: SparkSession, root: str) -> list[Range]:
    """All finished folders under ``root``; there are few, as ``compact`` bounds their number."""
    fs, pattern = _storage(spark, f"{root}/batch/source=*/first=*/last=*/_SUCCESS")
    out = []
    for status in fs.globStatus(pattern) or []:
        names = status.getPath().toString().split("/")[-4:-1]
        source, first, last = (n.split("=", 1)[1] for n in names)
        out.append(Range(source, int(first), int(last)))
    return sorted(out)


def cover(ranges: Sequence[Range]) -> list[Range]:
    """The ranges that no other one contains. Ranges of a source contain each other or are apart."""
    out: list[Range] = []
    for r in sorted(ranges, key=lambda r: (r.source, r.first, -r.last)):
        if not (out and out[-1].holds(r)):
            out.append(r)
    return out


def _included(spark: SparkSession, root: str) -> dict[str, int]:
    """Per source (a stream), the last batch that the base holds: one small row each."""
    return {r.source: r.upto for r in _folder(spark, f"{root}/included", _INCLUDED_DDL).collect()}


def _read_ranges(spark: SparkSession, root: str, ranges: Sequence[Range]) -> DataFrame:
    if not ranges:
        return spark.createDataFrame([], STATE_WITH_SEQ_DDL)
    return spark.read.schema(STATE_WITH_SEQ_DDL).parquet(*[r.path(root) for r in ranges])


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The state under ``root`` (``id, type, delta, value, seq``); empty if there is none.

    One aggregate over the base and the folders that it does not hold yet, which are chosen by
    their names: no row is joined or shuffled by its source.
    """
    return _folded(spark, root, lambda r: True)


def _folded(spark: SparkSession, root: str, wanted: Callable[[Range], bool], keys: DataFrame | None = None) -> DataFrame:
    included = _included(spark, root)
    pending = [r for r in cover([r for r in finished_ranges(spark, root) if wanted(r)]) if r.last > included.get(r.source, -1)]
    rows = base_state(spark, root).unionByName(_read_ranges(spark, root, pending))
    if keys is not None:
        rows = of_keys(rows, keys)
    return fold_states(rows).select(*STATE_COLUMNS, "seq")


def publish_state(state: DataFrame, root: str) -> None:
    """Write ``state`` as the base of a root. A base is written once: a second call fails.

    Rows are range-partitioned and sorted by key, so each file holds a key range and
    a point lookup (P1) on the base skips whole files and row groups. Ids that are random inside of
    a file's range are told apart by a Bloom filter of the ids of each row group.
    """
    rows = _with_seq(state).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    rows.write.mode("errorifexists").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{root}/base")


def publish_buckets(state: DataFrame, root: str, buckets: int) -> None:
    """S5/S9 for J1: write ``state`` as the base of a root in ``buckets`` by key, sorted, for merges that move the updates only.

    The folder's name carries the number of buckets. One task writes one bucket, so a bucket is one file.
    """
    name = f"tallyfold_{uuid.uuid4().hex}"
    rows = _with_seq(state)
    rows.repartition(buckets, *KEY).write.mode("errorifexists").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", f"{root}/buckets-{buckets}").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # an external table: its files stay


def bucketed_state(spark: SparkSession, root: str, buckets: int) -> DataFrame:
    """The state that ``publish_buckets`` wrote, known to Spark as partitioned and sorted by key."""
    name = f"tallyfold_{uuid.uuid4().hex}"
    by = ", ".join(KEY)
    spark.sql(f"CREATE TABLE {name} ({STATE_WITH_SEQ_DDL}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{root}/buckets-{buckets}'")
    state = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return state


def base_state(spark: SparkSession, root: str) -> DataFrame:
    """The base alone: filters on the key reach its scan."""
    return _folder(spark, f"{root}/base", STATE_WITH_SEQ_DDL)


def write_batch(updates: DataFrame, root: str, source: str, batch: int) -> None:
    """Fold one batch of updates into its own folder; a replay overwrites it with the same rows."""
    if not source or "/" in source:
        raise ValueError(f"not a source id: {source!r}")
    _with_seq(fold_updates(updates)).write.mode("overwrite").parquet(Range(source, int(batch), int(batch)).path(root))


def state_before(spark: SparkSession, root: str, source: str, batch: int, keys: DataFrame | None = None) -> DataFrame:
    """The state as it stood before one batch of a source, also when that batch is replayed.

    ``keys``: only the rows of these keys, chosen before anything is folded or shuffled.
    """
    return _folded(spark, root, lambda r: not (r.source == source and r.last >= batch), keys)


def _next_fold(ranges: Sequence[Range], fan: int) -> list[Range] | None:
    """``fan`` neighbouring ranges of equal size, the smallest size first; None if there are none."""
    size = lambda r: r.last - r.first + 1
    for n in sorted({size(r) for r in ranges}):
        run: list[Range] = []
        for r in ranges:
            together = run and size(r) == n and run[-1].last + 1 == r.first
            run = [*run, r] if together else [r] if size(r) == n else []
            if len(run) == fan:
                return run
    return None


def compact(spark: SparkSession, root: str, source: str, before: int, fan: int = FAN) -> list[Range]:
    """Fold a source's finished folders of batches below ``before``; returns the ranges written.

    It runs beside the stream, or in its sink with ``before`` the batch at hand, which alone may
    still be replayed. Each fold joins ``fan`` neighbours of one size, so a batch is folded once a
    size, and at most ``fan`` - 1 folders of each size remain, besides covered ones that wait for removal.
    One call at a time for a source.
    """
    if fan < 2:
        raise ValueError("a fold joins two folders at least")
    written, based = [], _included(spark, root).get(source, -1)
    while True:
        finished = [r for r in finished_ranges(spark, root) if r.source == source]
        run = _next_fold([r for r in cover(finished) if based < r.first and r.last < before], fan)
        if run is None:
            break
        whole = Range(source, run[0].first, run[-1].last)
        fold_states(_read_ranges(spark, root, run)).select(*STATE_COLUMNS, "seq").write.mode("overwrite").parquet(whole.path(root))
        written.append(whole)
    _remove_covered(spark, root, finished)
    return written


def _remove_covered(spark: SparkSession, root: str, finished: Sequence[Range]) -> None:
    """Mark the covered folders, and remove those that an earlier call has marked."""
    kept = set(cover(finished))
    for r in finished:
        if r in kept:
            continue
        fs, folder = _storage(spark, r.path(root))
        _, mark = _storage(spark, f"{r.path(root)}/{_COVERED}")
        if fs.exists(mark):
            fs.delete(folder, True)
        else:
            fs.create(mark).close()


def rebase(spark: SparkSession, root: str, new_root: str) -> None:
    """Fold everything under ``root`` into the base of ``new_root``, a batch job of its own.

    ``new_root`` remembers the last batch of each source that its base holds: a stream
    that moves there with its checkpoint may replay them without counting twice.
    Run it while no stream writes to ``root``.
    """
    upto = _included(spark, root)
    for r in finished_ranges(spark, root):
        upto[r.source] = max(r.last, upto.get(r.source, -1))
    publish_state(read_state(spark, root), new_root)
    spark.createDataFrame(sorted(upto.items()), _INCLUDED_DDL).write.mode("errorifexists").parquet(f"{new_root}/included")


# Snapshot file formats: one JSON array per file (the reference's snapshot file)
# or JSON lines (what Spark's JSON writer produces; splittable).
ARRAY_FORMAT = "array"
LINES_FORMAT = "lines"
_SNAPSHOT_DDL = "id STRING, type STRING, delta BIGINT, value DOUBLE, hash STRING, _corrupt_record STRING"


def _snapshot_rows(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """Snapshot records with their file and position; None when the path is missing.

    The JSON reader streams each file (an array document is parsed element by
    element, not held as one string). Records are ordered by the file's whole path, the
    start of the block in it, and their place in the block. A file holding ``null``
    contributes no rows; a malformed file fails the job.
    """
    if fmt not in (ARRAY_FORMAT, LINES_FORMAT):
        raise ValueError(f"unknown snapshot format {fmt!r}")
    try:
        raw = (
            spark.read.schema(_SNAPSHOT_DDL)
            .option("multiLine", fmt == ARRAY_FORMAT)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path)
        )
    except AnalysisException as e:
        if not _missing(e):
            raise
        return None
    rows = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),  # rises inside a block
    )
    corrupt = F.col("_corrupt_record")
    malformed = corrupt.isNotNull() & (F.trim(corrupt) != "null")
    # Records with neither id nor type (an empty object) carry nothing to restore.
    present = corrupt.isNull() & (F.col("id").isNotNull() | F.col("type").isNotNull())
    keep = F.when(malformed, F.raise_error(F.concat(F.lit("malformed snapshot file: "), F.col("_file")))).otherwise(
        present
    )
    return rows.filter(keep.cast("boolean")).drop("_corrupt_record")


def read_snapshot_json(spark: SparkSession, path: str, fmt: str = LINES_FORMAT) -> DataFrame:
    """A JSON snapshot -> state rows. A missing path or an empty file gives no
    rows; a file holding ``null`` gives no rows either."""
    rows = _snapshot_rows(spark, path, fmt)
    if rows is None:
        return spark.createDataFrame([], STATE_SCHEMA)
    return rows.select(*STATE_COLUMNS)


def restore_state(spark: SparkSession, path: str, fmt: str = LINES_FORMAT, key: Sequence[str] = KEY) -> DataFrame:
    """Snapshot as initial state; a repeated key keeps its last copy (replace,
    not sum; by file path, then position). The result has no ``seq``: any later
    update counts as newer."""
    rows = _snapshot_rows(spark, path, fmt)
    if rows is None:
        return spark.createDataFrame([], STATE_SCHEMA)
    rest = [c for c in STATE_COLUMNS if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_file", "_block", "_pos")).alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*STATE_COLUMNS)


def write_snapshot_json(state: DataFrame, path: str) -> None:
    """S5 in JSON: the state as JSON lines (NULL fields omitted), into a new folder."""
    state.select(*STATE_COLUMNS).write.mode("errorifexists").json(path)


def write_snapshot_arrays(rows: DataFrame, path: str, label: str, order: str) -> None:
    """S5 as the reference's file form: one JSON array per file, one file per ``label``.

    ``label`` is text whose order is the order of the files; a file is one snapshot of
    bounded size, its records ordered by ``order``.
    """
    bodies = batch_bodies(rows, batch=label, pos=order).repartition(label)
    bodies.select(label, F.col("body").alias("value")).write.mode("errorifexists").partitionBy(label).text(path)
