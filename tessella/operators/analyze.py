"""From observed points to a report of every video: gates, residuals, evidence, fusion, suspicious clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import log_interval_distance

from . import contract, fusion, residuals
from .gates import semantic_gate

#: The channels that tracks of points can give, their level, and reasons of missing ones.
LEVEL = {"semantic_metric_prior": "object", "semantic_metric_temporal": "track", "dynamic_reprojection": "point", "track_3d_continuity": "point", "direction_consistency": "point", "relative_velocity": "point"}
FEW, INVALID = "insufficient_history", "invalid_current_3d_point"
KEY = ["video_id", "point_id", "frame_index"]


def point_evidence(points: DataFrame, clip: int = 8) -> DataFrame:
    """Evidence rows of all six channels for every observed point.

    Points: video_id, point_id, frame_index, p, scale (the object's size), low, high (its prior's interval, NULL: none), quality, point_valid, and what
    :func:`gates.semantic_gate` reads. The size channels pass that gate, the motion channels need a valid point; a channel without enough history, or with a value that
    isn't finite, is unavailable with a reason. ``clip`` frames make a clip; rows are numbered by frame, point and channel.
    """
    c = F.col
    by = Window.partitionBy("video_id", "point_id").orderBy("frame_index")
    rows = semantic_gate(points).withColumnRenamed("reason", "gate")
    rows = residuals.continuity(residuals.velocity_prediction(rows)).withColumn("_before", F.lag("scale").over(by))
    rows = rows.join(residuals.direction_change(points), KEY).join(residuals.speed_change(points).select(*KEY, "peer_gap"), KEY)
    moved = F.when(~c("point_valid"), INVALID).otherwise("")
    history = lambda value: F.when((moved == "") & value.isNull(), FEW).otherwise(moved)

    def channel(name: str, value: Column, reason: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(LEVEL[name]).alias("level"), value.alias("value"), reason.alias("reason"))

    prior = F.when(c("low").isNotNull() & (c("scale") > 0), log_interval_distance(c("scale"), c("low"), c("high")))
    change = F.when((c("scale") > 0) & (c("_before") > 0), F.abs(F.ln("scale") - F.ln("_before")))
    channels = F.array(
        channel("semantic_metric_prior", prior, F.when(c("gate") != "", c("gate")).when(c("low").isNull(), "missing_category_metric_prior").otherwise("")),
        channel("semantic_metric_temporal", change, F.when(c("gate") != "", c("gate")).when(c("_before").isNull(), FEW).otherwise("")),
        channel("dynamic_reprojection", c("error"), history(c("error"))),
        channel("track_3d_continuity", c("normalized"), history(c("normalized"))),
        channel("direction_consistency", c("direction_change"), history(c("direction_change"))),
        channel("relative_velocity", c("peer_gap"), history(c("peer_gap"))),
    )
    long = rows.select(*KEY, "quality", F.posexplode(channels).alias("_i", "x")).select(*KEY, "_i", "x.*", c("quality").alias("confidence"))
    long = long.withColumn("ok", c("reason") == "")
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index", "point_id", "_i")) - 1
    long = long.withColumn("row_idx", place.cast("int")).withColumn("clip_no", F.floor(c("frame_index") / clip).cast("int"))
    long = long.withColumn("clip_id", F.concat(F.lit("c"), c("clip_no").cast("string"))).withColumn("object_id", F.lit(None).cast("string")).withColumn("track_id", F.concat(F.lit("t"), c("point_id").cast("string")))
    return contract.observe(long).drop("ok", "value", "_i", "point_id")


def report(evidence: DataFrame, suspicious: float = 0.5) -> DataFrame:
    """video_id, risk_score, clips, scored_clips, suspicious_clips, top_clip, top_channel, coverage of every video with evidence.

    The top clip has the greatest risk (the first of equals); the top channel adds the most to the risks of all clips.
    """
    clips = fusion.fuse_clips(evidence)
    videos = fusion.fuse_videos(clips)
    best = F.min_by("clip_id", F.when(F.col("risk_score").isNotNull(), F.struct((-F.col("risk_score")).alias("r"), F.col("clip_id"))))
    marks = clips.groupBy("video_id").agg(F.count_if(F.col("risk_score") > suspicious).alias("suspicious_clips"), best.alias("top_clip"), F.avg("coverage").alias("coverage"))
    parts = fusion.contributions(evidence).groupBy("video_id", "name").agg(F.round(F.sum("contribution"), 9).alias("s"))
    top = parts.groupBy("video_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "name")).alias("m")).select("video_id", F.col("m.name").alias("top_channel"))
    return videos.join(marks, "video_id").join(top, "video_id", "left").select("video_id", "risk_score", "clips", "scored_clips", "suspicious_clips", "top_clip", "top_channel", "coverage")
