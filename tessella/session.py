"""Ships this package to the executors of a session, and names folders that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one (``spark.checkpoint.dir``); in local mode without it, one of our own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _OWN:
            _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="tessella-")
        root = "file://" + _OWN[sc.applicationId]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read again: what several later steps or rounds use, and lost executors don't repeat.

    Its files are far smaller than its rows in memory, so Spark must not choose by them to broadcast it: joins with it shuffle.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows``, about ``each`` in one.

    Spark merges shuffled partitions by their compressed bytes, which say little of rows that compress well or are multiplied afterwards: what a
    task holds would grow with the input. A number that is given to ``repartition`` stays.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def ship(spark: SparkSession) -> None:
    """Executors import the package from wherever the driver runs it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-ship-"), "tessella.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessella", os.path.relpath(full, here)))
    sc.addPyFile(path)
