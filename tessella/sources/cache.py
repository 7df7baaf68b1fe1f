"""Stage outputs kept by content: a table is built once for each hash of its inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_of(stage: str, inputs: dict) -> str:
    """SHA-256 of the stage's name and its inputs in canonical JSON."""
    return hashlib.sha256(json.dumps([stage, inputs], sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of a table's files; contents stay on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def cached(spark: SparkSession, root: str, stage: str, inputs: dict, build: Callable[[], DataFrame], verify: bool = False) -> DataFrame:
    """The stage's table, read if its files are complete, else built and written.

    Spark's committer leaves ``_SUCCESS`` only behind a complete write; anything else is built again. With
    ``verify`` the files must also have the hashes noted beside the table when it was written.
    """
    path = f"{root.rstrip('/')}/{stage}/{key_of(stage, inputs)}"
    notes = f"{path}.sha256"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    good = fs.exists(fs_path(f"{path}/_SUCCESS"))
    if good and verify:
        good = fs.exists(fs_path(f"{notes}/_SUCCESS"))
        if good:
            noted, now = spark.read.schema("name string, sha256 string").json(notes), _hashes(spark, path)
            good = noted.exceptAll(now).isEmpty() and now.exceptAll(noted).isEmpty()
    if not good:
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        if verify:
            _hashes(spark, path).write.mode("overwrite").json(notes)
    return spark.read.parquet(path)
