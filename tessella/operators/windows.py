"""Clip windows, scene sessions, moving medians and gaps-and-islands.

Frame positions are integers; every window is partitioned by video (or group), so
the work of one video stays together and videos spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import array_median


def sliding_clips(videos: DataFrame, length: int, stride: int) -> DataFrame:
    """Clips of ``length`` frames every ``stride``, and one that ends at the last frame.

    ``videos``: video_id, n_frames. Clips below two frames are dropped; clip_ordinal counts from 0.
    """
    last = F.greatest(F.col("n_frames") - length, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    out = videos.where("n_frames >= 2").select("video_id", "n_frames", F.posexplode(F.array_sort(starts.cast("array<int>"))).alias("clip_ordinal", "start_frame"))
    out = out.withColumn("end_frame", F.least(F.col("start_frame") + length, F.col("n_frames")).cast("int") - 1)
    return out.where("end_frame > start_frame").select("video_id", "clip_ordinal", "start_frame", "end_frame")


def tumbling_clips(frames: DataFrame, length: int) -> DataFrame:
    """clip_ordinal and position of every frame: consecutive windows without overlap."""
    return frames.withColumn("clip_ordinal", F.floor(F.col("frame_index") / length).cast("int")).withColumn("position", (F.col("frame_index") % length).cast("int"))


def owned_frames(videos: DataFrame, length: int, stride: int) -> DataFrame:
    """The one clip that owns each frame: the nearest centre, the lower clip on ties."""
    clips = sliding_clips(videos, length, stride)
    rows = clips.withColumn("frame_index", F.explode(F.sequence("start_frame", "end_frame")))
    centre = (F.col("start_frame") + F.col("end_frame")) / 2
    near = rows.groupBy("video_id", "frame_index").agg(F.min_by("clip_ordinal", F.struct(F.abs(F.col("frame_index") - centre), F.col("clip_ordinal"))).alias("owner_clip"), F.count(F.lit(1)).alias("candidates"))
    return near


def scene_clips(scenes: DataFrame, length: int, stride: int) -> DataFrame:
    """:func:`sliding_clips` inside every scene, so that no clip crosses a cut; ordinals run through the video.

    Scenes: video_id, start_frame, end_frame (both belong to it). Clips below two frames are dropped.
    """
    end = F.col("end_frame") + 1
    last = F.greatest(end - length, F.col("start_frame"))
    starts = F.array_sort(F.array_distinct(F.concat(F.sequence(F.col("start_frame"), last, F.lit(stride)), F.array(last))))
    out = scenes.select("video_id", end.alias("_end"), F.explode(starts).alias("start_frame"))
    out = out.withColumn("end_frame", F.least(F.col("start_frame") + length, F.col("_end")) - 1).where("end_frame > start_frame")
    ordinal = F.row_number().over(Window.partitionBy("video_id").orderBy("start_frame")) - 1
    return out.select("video_id", ordinal.alias("clip_ordinal"), "start_frame", "end_frame")


def scene_windows(scenes: DataFrame, length: int, stride: int, left: int, right: int, least: int) -> DataFrame:
    """Windows of every scene of at least ``least`` frames, with context on both sides inside the scene.

    Scenes: video_id, scene, start_frame, end_frame. Gives clip_ordinal (in the video), core and visible frames, the core's middle.
    """
    length_of = F.col("end_frame") - F.col("start_frame") + 1
    last = F.greatest(F.col("end_frame") - length + 1, F.col("start_frame"))
    starts = F.array_sort(F.array_distinct(F.concat(F.sequence(F.col("start_frame"), last, F.lit(stride)), F.array(last))))
    out = scenes.where(length_of >= least).select("video_id", "scene", F.col("start_frame").alias("_a"), F.col("end_frame").alias("_b"), F.explode(starts).alias("core_start"))
    out = out.withColumn("core_end", F.least(F.col("core_start") + length - 1, F.col("_b")))
    out = out.withColumn("start_frame", F.greatest(F.col("core_start") - left, F.col("_a"))).withColumn("end_frame", F.least(F.col("core_end") + right, F.col("_b")))
    out = out.withColumn("reference_frame", F.floor((F.col("core_start") + F.col("core_end")) / 2))
    ordinal = F.row_number().over(Window.partitionBy("video_id").orderBy("core_start")) - 1
    return out.select("video_id", "scene", ordinal.alias("clip_ordinal"), "core_start", "core_end", "start_frame", "end_frame", "reference_frame")


def window_members(windows: DataFrame) -> DataFrame:
    """Every visible frame of every window, and whether that window owns it: the nearest visible middle, the earlier window on ties."""
    rows = windows.select("video_id", "scene", "clip_ordinal", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_index"), ((F.col("start_frame") + F.col("end_frame")) / 2).alias("_c"))
    rank = F.row_number().over(Window.partitionBy("video_id", "frame_index").orderBy(F.abs(F.col("frame_index") - F.col("_c")), "clip_ordinal"))
    owned = rank == 1
    return rows.select("video_id", "scene", "clip_ordinal", "frame_index", owned.alias("is_owned"), (~owned).alias("is_context"))


def uniform_sample(videos: DataFrame, requested: int) -> DataFrame:
    """``requested`` frame indices from first to last, evenly: floor(i (n - 1) / (r - 1)). A video with fewer frames
    gives one row without a frame, and the reason."""
    enough = F.col("n_frames") >= requested
    positions = F.when(enough, F.sequence(F.lit(0), F.lit(requested - 1))).otherwise(F.array(F.lit(None).cast("int")))
    rows = videos.select("video_id", "n_frames", F.explode(positions).alias("position"))
    reason = F.when(F.col("position").isNull(), "INSUFFICIENT_UNIQUE_FRAMES").otherwise("")
    return rows.select("video_id", "position", F.expr(f"CAST(position * (n_frames - 1) DIV {max(1, requested - 1)} AS INT)").alias("frame_index"), reason.alias("reason"))


def scene_segments(frames: DataFrame, key: str, threshold: float) -> DataFrame:
    """Sessions: a new scene where the signature jumps by the threshold or more."""
    by = Window.partitionBy(key).orderBy("frame_index")
    cut = (F.abs(F.col("signature") - F.lag("signature").over(by)) >= threshold).cast("int")
    scene = F.sum(F.coalesce(cut, F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("scene", scene).groupBy(key, "scene").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.count(F.lit(1)).alias("frames"))


def moving_median(series: DataFrame, key: str, width: int) -> DataFrame:
    """Causal median of the last ``width`` rows, missing ones left out."""
    by = Window.partitionBy(key).orderBy("frame_index").rowsBetween(1 - width, 0)
    return series.withColumn("smoothed", array_median(F.collect_list("score").over(by)))


def islands(rows: DataFrame, key: str, start: str, end: str, max_gap: int) -> DataFrame:
    """``island``: rows join while start - (greatest end so far) - 1 <= max_gap."""
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach - 1 > max_gap), 1).otherwise(0)
    marked = rows.withColumn("_reach", reach).withColumn("_new", new)
    return marked.withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def threshold_intervals(series: DataFrame, key: str, threshold: float, width: int = 3, max_gap: int = 1, minimum: int = 2) -> DataFrame:
    """Intervals where the smoothed score reaches the threshold."""
    high = moving_median(series, key, width).where(F.col("smoothed") >= threshold)
    grouped = islands(high.withColumn("_end", F.col("frame_index")), key, "frame_index", "_end", max_gap)
    out = grouped.groupBy(key, "island").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.avg("smoothed").alias("score"), F.avg("quality").alias("quality"), F.count(F.lit(1)).alias("valid_frames"))
    span = F.col("end_frame") - F.col("start_frame") + 1
    return out.where(span >= minimum).select(key, "start_frame", "end_frame", "score", "quality", "valid_frames", (span - F.col("valid_frames")).alias("missing_frames"))


def merge_suspicious(clips: DataFrame, threshold: float, max_gap: int = 1) -> DataFrame:
    """Clips whose risk reaches the threshold, merged over small gaps in temporal order."""
    chosen = clips.where(F.col("risk_score") >= threshold)
    grouped = islands(chosen, "video_id", "start_frame", "end_frame", max_gap)
    return grouped.groupBy("video_id", "island").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.max("risk_score").alias("risk_score"), F.count(F.lit(1)).alias("clips")).drop("island")


def merge_intervals(intervals: DataFrame, key: str, max_gap: int) -> DataFrame:
    """Merge intervals over gaps: scores and qualities weigh by valid frames, gaps count as missing."""
    grouped = islands(intervals, key, "start_frame", "end_frame", max_gap)
    gap = F.when((F.col("_reach").isNotNull()) & (F.col("start_frame") - F.col("_reach") - 1 <= max_gap), F.greatest(F.col("start_frame") - F.col("_reach") - 1, F.lit(0))).otherwise(0)
    n = F.greatest(F.sum("valid_frames"), F.lit(1))
    return (
        grouped.withColumn("_gap", gap)
        .groupBy(key, "island")
        .agg(
            F.min("start_frame").alias("start_frame"),
            F.max("end_frame").alias("end_frame"),
            (F.sum(F.col("score") * F.col("valid_frames")) / n).alias("score"),
            (F.sum(F.col("quality") * F.col("valid_frames")) / n).alias("quality"),
            F.sum("valid_frames").alias("valid_frames"),
            F.sum(F.col("missing_frames") + F.col("_gap")).alias("missing_frames"),
        )
        .drop("island")
    )


def interval_iou(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Share of frames that both interval sets cover among those that either covers; 1 if neither does."""
    frames = lambda df, flag: df.select(key, F.explode(F.sequence("start_frame", "end_frame")).alias("frame")).distinct().withColumn(flag, F.lit(1))
    both = frames(left, "l").join(frames(right, "r"), [key, "frame"], "full_outer")
    return both.groupBy(key).agg((F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()) / F.count(F.lit(1))).alias("iou"))


def first_per_frame(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each frame of a group: the first by ``order``."""
    by = Window.partitionBy(key, "frame_index").orderBy(order)
    return rows.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def forward_fill(rows: DataFrame, key: str, column: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(by))
