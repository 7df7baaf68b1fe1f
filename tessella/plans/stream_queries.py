"""Streaming mirrors run to the end of the files, and the recurrent head."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import fusion, recurrent
from tessella.session import new_folder, parts
from tessella.streaming import tracks
from tessella.streaming import windows as streaming

from .adapters import evidence, table
from .registry import query, r
from .table_queries import video_boxes


def _stream(spark, sf):
    batch = table(spark, sf, "events")
    # A file source reads folders; the table is one file or a folder of files.
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf}/events.parquet*")


@query("stream_windows", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, {r('sum(value)')} AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    path = new_folder(spark, "stream-windows")
    return streaming.run_complete(spark, streaming.tumbling(_stream(spark, sf), "1 hour"), f"{path}/table", f"{path}/state")


@query("stream_sessions", """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    path = new_folder(spark, "stream-sessions")
    return streaming.run_complete(spark, streaming.sessions(_stream(spark, sf), "30 minutes"), f"{path}/table", f"{path}/state")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_dedup(spark, sf):
    path = new_folder(spark, "stream-dedup")
    # Events of a file arrive in any order, so lateness covers the table's own span, which bounds the state.
    span = table(spark, sf, "events").select(F.max("ts").cast("timestamp").cast("long") - F.min("ts").cast("timestamp").cast("long")).first()[0] or 0
    out = streaming.deduplicate(_stream(spark, sf), ["event_id"], late=f"{span + 60} seconds").select("event_id", "user_id", "event_type")
    return streaming.run_once(spark, out, f"{path}/table", f"{path}/state")


def unique_boxes(spark, sf):
    """The first box of each id in a frame: a stream takes a box that comes twice once."""
    rest = ["label", "x1", "y1", "x2", "y2", "width", "height"]
    keys = ["video_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("box_id").cast("long").alias("box_id")]
    return video_boxes(spark, sf).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("b")).select("video_id", "frame_index", "box_id", "b.*")


#: Boxes in a partition of a stream's state, and buckets of videos in one.
STATE_ROWS, STATE_BUCKETS = 500_000, 16


def _track_stream(spark, sf, path):
    """The boxes as a stream of files out of order by up to three frames, and a last row that moves the watermark past them; their number."""
    boxes = unique_boxes(spark, sf)
    late = F.pmod(F.xxhash64("video_id", "frame_index", "box_id"), F.lit(4))
    boxes.withColumn("_file", F.floor((F.col("frame_index") + late) / 9).cast("int")).write.partitionBy("_file").parquet(f"{path}/dealt")
    files = spark.sparkContext.defaultParallelism
    dealt = spark.read.schema(boxes.withColumn("_file", F.lit(0)).schema).parquet(f"{path}/dealt")
    for i in range(4):  # 32 frames, four parts in order of time, each by all tasks: a micro-batch takes as many files as a part has
        dealt.where(F.col("_file") == i).drop("_file").repartition(files).write.mode("append").parquet(f"{path}/source")
    last = dealt.drop("_file").limit(1).withColumn("video_id", F.lit(-1).cast("long")).withColumn("frame_index", F.lit(10**6).cast("long"))
    last.coalesce(1).write.mode("append").parquet(f"{path}/source")
    return spark.readStream.schema(boxes.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/source"), dealt.count()


def _tracked(spark, sf, name, build):
    """``build`` run over the stream of boxes, with state in as many partitions and buckets as the boxes need."""
    path = new_folder(spark, name)
    tracks.rocks(spark)
    stream, rows = _track_stream(spark, sf, path)
    n = parts(spark, rows, STATE_ROWS)
    return streaming.run_once(spark, build(stream, late=16, buckets=n * STATE_BUCKETS), f"{path}/table", f"{path}/state", partitions=n).where("video_id >= 0")


@query("stream_tracks")
def stream_tracks(spark, sf):
    """Tracks of a stream of boxes: what ``sequential.associate`` gives for them, with state for buckets of videos."""
    return _tracked(spark, sf, "stream-tracks", tracks.track_boxes)


@query("stream_track_spans")
def stream_track_spans(spark, sf):
    """Each track's first and last frame and boxes, once it has ended."""
    return _tracked(spark, sf, "stream-track-spans", tracks.track_spans)


def _risk_sequences(spark, sf):
    """A video's clips as steps of twelve channels; it is risky if an above-average share of its events are errors, which its channels only show by what is missing."""
    rows = evidence(spark, sf)
    steps = fusion.channel_matrix(rows).withColumn("step", F.substring("clip_id", 2, 10).cast("int")).withColumnRenamed("video_id", "sequence_id")
    mean = rows.agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))).first()[0] or 0.0
    labels = rows.groupBy("video_id").agg((F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)) > mean).cast("int").alias("label")).withColumnRenamed("video_id", "sequence_id")
    part = F.pmod(F.xxhash64("sequence_id"), F.lit(10))
    fold = F.when(part < 6, "train").when(part < 8, "validation").otherwise("test")
    return steps.join(labels, "sequence_id").withColumn("fold", fold)


@query("risk_head")
def risk_head(spark, sf):
    """The recurrent head: trained on one fold of the videos, its epoch chosen on another, probabilities of all."""
    packed = recurrent.pack_sequences(_risk_sequences(spark, sf), fusion.CHANNELS, {"value": "_value", "confidence": "_confidence"})
    head = recurrent.train(packed, recurrent.Shape(len(fusion.CHANNELS), 16), new_folder(spark, "risk-head"), epochs=12, rate=0.03)
    return recurrent.score(packed, head).select(F.col("sequence_id").alias("video_id"), "fold", "label", "probability", "predicted")
