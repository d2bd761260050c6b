"""Intermediate tables in the folder that driver and executors share, and the columns and memory of tasks.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost executor then costs its running
tasks only. Where the setting is absent a session of local mode uses a folder of our own, as in tests; on a cluster that is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK_DIR = "/tmp/checkpoints/corpusloom"
BATCH_BYTES = 4 << 20  # of an Arrow batch
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or FALLBACK_DIR).rstrip("/")


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and return it read back, so that nothing above it is ever recomputed; rows of one value of ``by`` have files of their own."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lower this session's limit for the bytes of an Arrow batch, if it is higher: a batch is held several times over by a task and its Python worker."""
    now = spark.conf.get(_BATCH).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here delete their shuffle files when they end; nothing may be read from them later."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def drop_stage(*tables: DataFrame, part: str = "") -> None:
    """Delete the files of tables that stage() returned and that nobody reads any more, or those of one ``part`` ("column=value")."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not path.endswith(part):
                continue
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def plain(docs: DataFrame, *names: str) -> DataFrame:
    """These columns alone, found by their exact names whatever else the table has (dots, other case, names used inside an operator)."""
    return numbered(docs).select(*[F.col(f"c{docs.columns.index(n)}").alias(n) for n in names])


def numbered(docs: DataFrame) -> DataFrame:
    """The table with columns c0, c1, ... in place of its own names."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def reuse() -> None:
    """Let this process keep up to 64 MB of freed memory, for work that makes and frees the same arrays over and over, until release()."""
    if _LIBC is not None:
        _LIBC.mallopt(_MMAP_THRESHOLD, 32 << 20)
        _LIBC.mallopt(_TRIM_THRESHOLD, 64 << 20)


def release() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1  # of mallopt
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim, _LIBC.mallopt
except (OSError, AttributeError):  # another C library
    _LIBC = None


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as a task that leaves no freed memory with its worker, which lives on."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def frugal_group(run: Callable) -> Callable:
    """As frugal(), for a function of a group."""
    if run.__code__.co_argcount == 2:

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return run(left, right)
            finally:
                release()

        return both

    def one(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            release()

    return one


def by_bytes(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def input_chunks(spark: SparkSession, df: DataFrame, chunk_bytes: int) -> int:
    """A partition count that grows with the input: its planned size over ``chunk_bytes``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(size // chunk_bytes + 1, 200_000)) if size < 1 << 60 else floor
