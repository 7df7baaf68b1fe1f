"""Materialised intermediates in the folder that the whole cluster shares.

Every cut of lineage is a Parquet table below ``spark.checkpoint.dir``: a lost
executor costs a re-read, never a recomputation of what was already written.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, or a folder of our own in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="tessella-"))


#: Bytes of a batch between the JVM and a Python worker: whole documents are large rows.
BATCH_BYTES = 8 << 20


def document_batches(spark: SparkSession) -> None:
    """Bound the batches of this session, unless it asks for still smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("b").lstrip("-").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _give_back() -> None:
    """Return what this Python worker has freed to the system: workers are reused, and idle ones keep it else."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving its memory back at the end of the task."""

    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        _give_back()

    return task


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one: all its tables, and nothing else."""
    return f"{shared_root(spark)}/tessella-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once and return a reader of the files; ``.source_path`` is theirs."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.source_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "source_path", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all tables of this application. Results read some of them, so this is the caller's to do, when all results are written."""
    _delete(spark, own_folder(spark))
