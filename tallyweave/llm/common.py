"""Shared helpers: the folder all executors see, lineage cuts, and Arrow row mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handled at once in Python; long texts make larger slices needless.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    if not getattr(shared_dir, "own", None):
        own = tempfile.mkdtemp(prefix="tallyweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared_dir.own = "file://" + own
    return shared_dir.own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a table made by :func:`stored` that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished queries early: its cleaner follows garbage collection.

    Only disk space depends on it, and only until the next collection.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Caches that stay in a Python worker from task to task.
_caches: list = []


def cached(cache):
    """Registers a worker's cache, so that tasks of other operators can empty it."""
    _caches.append(cache)
    return cache


def lean() -> None:
    """Empties this worker's caches: workers are used again by operators that need none of them."""
    for cache in _caches:
        cache.cache_clear()


def give_back() -> None:
    """Returns freed memory to the system: idle workers would hold it beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    batch = None
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        batch = None  # else it would stay until the task has ended
        give_back()


def map_rows(df: DataFrame, columns: list[str], fields: list[T.StructField], start: Callable[[], Callable[..., list[list]]]) -> DataFrame:
    """Appends columns computed in Python, keeping every row and column of ``df``.

    ``start`` runs once a task and returns a function from the lists of ``columns`` to the
    lists of the new columns. A column of ``df`` with the name of a new one is replaced.
    """
    names = [f.name for f in fields]
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        work, kinds = start(), [to_arrow_type(f.dataType) for f in fields]
        for b in slices(batches):
            given = [b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]
            made = [pa.array(x, k) for x, k in zip(work(*given), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + made, [*keep, *names])

    return df.mapInArrow(run, schema)


def crc_mod(column, modulus: int):
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
