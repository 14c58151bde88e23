"""Shared helpers: the cluster's shared folder, materialised intermediate tables, bounded Arrow slices."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that the Python side of an operator holds in numpy form at once.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch: documents are long, and JVM and Python both hold a batch.
BATCH_ROWS = 1000
try:  # glibc's: gives freed memory back to the system
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):
    _trim = None
_made: list[tuple[SparkSession, str]] = []
#: What this Python worker keeps between tasks of one operator, to be let go when another one runs.
kept_between_tasks: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where it is unset and the master is
    local; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/clausegraph-shared"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; deleted when the driver ends, or earlier by :func:`discard`."""
    path = f"{shared_dir(spark).rstrip('/')}/clausegraph/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _made:
        try:
            discard(spark, path)
        except Exception:  # the JVM may have ended first
            return


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches at ``BATCH_ROWS`` rows at most for this session, unless it is set lower."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def let_go(keep: Callable[[], None] | None = None) -> None:
    """In a task: drops what other operators keep in this worker (not what ``keep`` would), and gives back to the system what
    Arrow and the C library hold unused."""
    for drop in kept_between_tasks:
        if drop is not keep:
            drop()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more; what was made from them is written itself."""
    for table in tables:
        discard(table.sparkSession, table.scratch_path)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written with a number by row, and the name of that column. A scan numbered anew may be split otherwise (splits
    follow the executors alive), so whoever finds rows again by number reads this table."""
    column = free_name(docs, "row_id")
    return materialise(docs.select("*", F.monotonically_increasing_id().alias(column)), name, compression="zstd"), column


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; for a plain scan the bytes of its files. Starts no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target_bytes: int = 16 << 20) -> int:
    """Partitions of about ``target_bytes`` of input, at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, least, -(-input_bytes(df) // target_bytes))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose ``column`` holds at most ``limit`` bytes each, or one row."""
    n = batch.num_rows
    if n == 0:
        return
    values = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(text_lengths(values))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until ``column`` holds ``limit`` bytes, then cut by :func:`slices`."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(text_lengths(batch.column(batch.schema.get_field_index(column))).sum())
        if size >= limit:
            yield from slices(pa.concat_batches(held), column, limit)
            held, size = [], 0
    if held:
        yield from slices(pa.concat_batches(held), column, limit)


def text_lengths(values: pa.Array) -> np.ndarray:
    """Bytes of each value, 0 for null."""
    offsets = text_buffer(values)[1]
    return np.diff(offsets)


def text_buffer(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array as one uint8 array, and int64 offsets into it; nulls are empty."""
    if values.null_count:
        values = values.fill_null(b"" if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else "")
    large = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    raw = values.buffers()
    if len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], dtype=np.int64 if large else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"
