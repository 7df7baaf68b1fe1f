"""Tracks of boxes on a stream: the batch operator's association with state for each video.

A box's event time is its frame's. Frames may arrive in any order within the watermark's delay; a frame waits in the video's
state until the watermark has passed it (a timer says so), then it takes its step, in order of frames. State holds
the waiting frames, the tracks seen in the last ``max_gap`` frames and a counter; what is older has ended, so state is
bounded by the delay and the gap, not by the video. Videos share buckets, so that calls of the state and steps in Python are
as many as buckets, not as videos. A restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators import sequential
from tessella.operators.sequential import carry_frames

BOX = ["label", "x1", "y1", "x2", "y2", "width", "height"]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of videos, where the caller doesn't know how many boxes will come.
BUCKETS = 1024


def _pack(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_pandas()


class _Association(StatefulProcessor):
    """State of one video, or of a bucket of videos that their rows name. With ``spans`` it gives a row for each track that has ended, otherwise one for each box.

    Waiting boxes, tracks and counters are Arrow tables that a call appends or rewrites as a whole, and one timer stands for all boxes of a call: a bucket
    takes a few calls of the state store in a micro-batch, however many videos and boxes it has.
    """

    def __init__(self, max_gap: int, spans: bool):
        self.max_gap, self.spans = max_gap, spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "boxes binary")
        self.tracks = handle.getValueState("tracks", "boxes binary")
        self.following = handle.getValueState("following", "counters binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [pdf.assign(video_id=pdf.get("video_id", key[0])) for pdf in rows]
        if came:
            boxes = pd.concat(came, ignore_index=True)
            self.waiting.appendList([(_pack(boxes[["video_id", "frame_index", "box_id", *BOX]]),)])
            self.handle.registerTimer(max(int(boxes["ms"].min()), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def _step(self, held: pd.DataFrame | None, ready: pd.DataFrame) -> pd.DataFrame:
        """``held`` and ``ready`` by video and frame, each row with its track, the track's first frame and its boxes; ``new`` rows are the ready ones."""
        ready = ready.assign(track=-1, first=ready["frame_index"], boxes=1, new=True)
        rows = ready if held is None else pd.concat([held.assign(new=False), ready], ignore_index=True)
        old = self.following.get()
        counters = _unpack(old[0]) if old else pd.DataFrame({"video_id": rows["video_id"].iloc[:0], "following": np.zeros(0, np.int64)})
        code, videos = pd.factorize(pd.concat([rows["video_id"], counters["video_id"]], ignore_index=True), use_na_sentinel=False)
        following = np.zeros(len(videos), np.int64)
        following[code[len(rows) :]] = counters["following"]
        rows = rows.assign(video=code[: len(rows)]).sort_values(["video", "frame_index", "box_id", "track"], ignore_index=True)
        # One video after the other, further apart than a track can reach.
        video, frame = rows["video"].to_numpy(), rows["frame_index"].to_numpy()
        begin = np.flatnonzero(np.diff(video, prepend=-1))
        width = frame[np.append(begin[1:], len(rows)) - 1] - frame[begin] + self.max_gap + 1
        place = frame + (np.cumsum(width) - width - frame[begin])[video]
        free = int(rows["track"].max()) + 1
        track, before, _ = carry_frames(place, rows, rows["track"].to_numpy(), free, self.max_gap)
        # New tracks were counted through all videos: each video counts its own.
        started = np.bincount(video[rows["new"].to_numpy() & (before < 0)], minlength=len(videos))
        track = np.where(track < free, track, track - free + (following - (np.cumsum(started) - started))[video])
        self.following.update((_pack(pd.DataFrame({"video_id": videos, "following": following + started})),))
        rows = rows.assign(track=track)
        by = rows.groupby(["video", "track"], sort=False)
        return rows.assign(first=by["first"].transform("min"), boxes=by["boxes"].transform("sum"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed: a first timer serves the later ones too.
        upto = timerValues.getCurrentWatermarkInMs() // 1000 - 1
        old = self.tracks.get()
        now, ready = _unpack(old[0]) if old else None, False
        waiting = [_unpack(r[0]) for r in self.waiting.get()]
        if waiting:
            # A box that came twice counts once.
            boxes = pd.concat(waiting, ignore_index=True).drop_duplicates(["video_id", "frame_index", "box_id"], keep="last")
            passed = boxes["frame_index"] <= upto
            ready, later = bool(passed.any()), boxes[~passed]
            if ready:
                rows = self._step(now, boxes[passed])
                now = rows.drop_duplicates(["video", "track"], keep="last").drop(columns=["video", "new"]).assign(box_id=-1)
                if len(later):
                    self.waiting.put([(_pack(later),)])
                    self.handle.registerTimer((int(later["frame_index"].min()) + 1) * 1000)
                else:
                    self.waiting.clear()
                if not self.spans:
                    yield rows.loc[rows["new"], ["video_id", "frame_index", "box_id", "track"]]
        if now is None:
            return
        # Tracks end when frames beyond their gap have passed, even if the video has none of them.
        over = upto - now["frame_index"] > self.max_gap
        live, ended = now[~over], now[over]
        if ready or len(ended):
            if len(live):
                self.tracks.update((_pack(live),))
            else:
                self.tracks.clear()
        if self.spans and len(live):
            self.handle.registerTimer((int(live["frame_index"].min()) + self.max_gap + 2) * 1000)
        if self.spans and len(ended):
            yield ended[["video_id", "track", "first", "frame_index", "boxes"]].rename(columns={"first": "first_frame", "frame_index": "last_frame"})

    def close(self) -> None:
        pass


def _stateful(boxes: DataFrame, late: int, max_gap: int, spans: bool, schema: str, buckets: int) -> DataFrame:
    # Frame 0 is at second 1: the watermark begins at 0, and what isn't above it is late.
    second = F.col("frame_index").cast("long") + 1
    timed = boxes.withColumn("ts", F.timestamp_seconds(second)).withColumn("ms", second * 1000).withWatermark("ts", f"{late} seconds")
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int").alias("bucket")
    # Ids travel as text: among integers pandas has no NULL.
    rows = timed.select(bucket, F.col("video_id").cast("string").alias("video_id"), F.col("frame_index").cast("long").alias("frame_index"), F.col("box_id").cast("long").alias("box_id"), *BOX, "ms", "ts")
    # Spark also loads the processor in a process beside the driver that knows neither its path nor the shipped package: its code travels with it.
    modules = [sys.modules[__name__], sequential]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        out = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Association(max_gap, spans), outputStructType=f"video_id string, {schema}", outputMode="Append", timeMode="EventTime")
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)
    return out.withColumn("video_id", F.col("video_id").cast(dict(boxes.dtypes)["video_id"]))


def track_boxes(boxes: DataFrame, late: int, max_gap: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """video_id, frame_index, box_id, track of a stream of boxes (the columns of ``sequential.associate``).

    Frames are seconds of event time; ``late`` is the greatest number of frames by which rows arrive too early or late. Rows
    beyond it are dropped, as watermarks do; a box that comes twice counts once. Videos share ``buckets`` of state, each of which a task
    holds at once: a checkpoint keeps their number.
    """
    return _stateful(boxes, late, max_gap, False, "frame_index long, box_id long, track long", buckets)


def track_spans(boxes: DataFrame, late: int, max_gap: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """video_id, track, first_frame, last_frame, boxes of every track, once it has ended; ``buckets`` as in :func:`track_boxes`."""
    return _stateful(boxes, late, max_gap, True, "track long, first_frame long, last_frame long, boxes long", buckets)


def rocks(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; a session that names its own keeps it."""
    if spark.conf.get(STORE, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)
