"""What the operators of this subpackage share: sessions, scratch tables, workers' state."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import shutil
import sys
import tempfile
import threading
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT: dict[str, str] = {}
_OPEN = threading.local()


class Scratch:
    """The scratch tables of one owner: those that its thread writes inside the with block. They stay until release(), as results are lazy."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _OPEN.owners = [*getattr(_OPEN, "owners", []), self]
        return self

    def __exit__(self, *_) -> None:
        _OPEN.owners = _OPEN.owners[:-1]

    def release(self) -> None:
        while self.paths:
            delete_path(self.spark, self.paths.pop())


def worker_state() -> types.ModuleType:
    """A module of this Python process that outlives the single task; caches in it are bounded by their owners."""
    if "_refloom_worker_state" not in sys.modules:
        _give_memory_back()
    return sys.modules.setdefault("_refloom_worker_state", types.ModuleType("_refloom_worker_state"))


def _give_memory_back() -> None:
    """Have the C library return freed blocks of 4 MB and more at once; a reused worker else keeps its largest task's memory."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def give_back_freed() -> None:
    """Return what this process has freed to the system."""
    gc.collect()
    _release()


#: Bytes that a worker may grow by before it returns what it has freed: between batches, and at a task's end.
GROWN, LEFT = 32 << 20, 8 << 20


def _resident() -> int:
    """Bytes of memory that this process has; 0 where that can't be read."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return 0


def hand_back(grown: int) -> None:
    """Return what this worker has freed, if it has grown by so many bytes since it last did. Looking costs microseconds, returning milliseconds."""
    state, now = worker_state().__dict__, _resident()
    if now >= state.get("resident", 0) + grown:
        _release()
        state["resident"] = _resident()
    else:
        state["resident"] = min(now, state.get("resident", now))


def lean(run: Callable) -> Callable:
    """run, a function of mapInArrow, in a worker that returns what it frees. Arrow's pool and the C library else keep a task's peak for as long as the worker is reused, whatever runs in it then."""

    @functools.wraps(run)
    def task(batches):
        def read():
            for b in batches:
                yield b
                del b
                hand_back(GROWN)

        try:
            yield from run(read())
        finally:
            hand_back(LEFT)

    return task


def small_batches(spark: SparkSession, mb: int = 4, rows: int = 2000) -> None:
    """Bound what one Arrow batch may hold, so a worker's memory depends neither on row count nor on row length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one where none is named, which only a local master allows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _ROOT:
        folder = tempfile.mkdtemp(prefix="refloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _ROOT[key] = "file://" + folder
    return _ROOT[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It belongs to the innermost Scratch that is open; without one it stays as long as the folder."""
    path = f"{shared_root(spark)}/refloom-{name}-{uuid.uuid4().hex}"
    for owner in getattr(_OPEN, "owners", [])[-1:]:
        owner.paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once to the shared folder: its lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Hashes of heavy keys that are looked for, rows from which a key is heavy, and parts that its rows are dealt over.
HEAVY_KEYS, HEAVY_ROWS, SPREAD = 256, 1000, 64


def heavy_keys(df: DataFrame, key: str) -> list[int]:
    """Hashes of the keys with most rows: HEAVY_KEYS at most, each with HEAVY_ROWS rows at least; any other key has a smaller share than one part in HEAVY_KEYS."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return [r.h for r in counts.where(F.col("n") >= HEAVY_ROWS).orderBy(F.desc("n"), "h").limit(HEAVY_KEYS).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for a key. The rows of a heavy key of left are dealt over SPREAD parts, each of which gets a copy of right's row."""
    heavy = heavy_keys(left, key)
    if not heavy:
        return left.join(right, key, how)
    is_heavy = F.xxhash64(key).isin(heavy)
    salt = F.when(is_heavy, F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)).cast("int")).otherwise(0)
    copies = F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", copies), [key, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
