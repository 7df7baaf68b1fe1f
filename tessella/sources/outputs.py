"""The set of tables that an analysis leaves, and arrays as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import write_csv, write_json, write_table


def write_analysis(root: str, clips: DataFrame, videos: DataFrame, intervals: DataFrame, objects: DataFrame, tracks: DataFrame, heat: DataFrame | None = None) -> None:
    """Timeline and scores as CSV, intervals and results as JSON lines, clips and heat maps as Parquet; every table in a total order of its keys."""
    write_table(clips, f"{root}/clips", clips.columns, ["video_id", "clip_id"])
    write_csv(clips.orderBy("video_id", "clip_id"), f"{root}/timeline", ["video_id", "clip_id", "risk_score", "coverage", "confidence"])
    write_csv(objects.orderBy("video_id", "object_id"), f"{root}/object_scores", objects.columns)
    write_csv(tracks.orderBy("video_id", "track_id"), f"{root}/track_scores", tracks.columns)
    write_json(intervals, f"{root}/suspicious")
    write_json(videos, f"{root}/result")
    if heat is not None:
        write_table(heat, f"{root}/heatmaps", ["video_id", "frame", "row", "col", "value"], ["video_id", "frame", "row", "col"])


def array_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each array: its length, content hash and little-endian doubles, for stores of binary columns."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raw = [None if v is None else np.array([np.nan if x is None else x for x in v], "<f8").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if r is None else len(r) // 8 for r in raw], pa.int64()), pa.array([None if r is None else hashlib.sha256(r).hexdigest() for r in raw]), pa.array(raw, pa.binary())], names=[key, "length", "sha256", "payload"])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(column).cast("array<double>")).mapInArrow(run, f"{key} {kind}, length long, sha256 string, payload binary")


def read_arrays(rows: DataFrame, key: str) -> DataFrame:
    """(key, values) of :func:`array_rows`; a payload that doesn't match its hash is an error."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = []
            for raw, digest in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if raw is not None and hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError("an array doesn't match its hash")
                values.append(None if raw is None else np.frombuffer(raw, "<f8").tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=[key, "values"])

    return rows.select(key, "payload", "sha256").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, values array<double>")
