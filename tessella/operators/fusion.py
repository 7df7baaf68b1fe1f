"""Missing-aware fusion of residual evidence.

Evidence rows carry video_id, clip_id, row_idx, name, level, frame_index,
object_id, track_id, normalized_value, confidence, valid. Invalid rows lower coverage
only; they never enter a mean. One shuffle key, (video_id, clip_id), serves all
levels below the clip, so the three roll-ups reuse a partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import TINY, weighted

CLIP = ["video_id", "clip_id"]
CHANNELS = [  # fixed values, in their frozen order
    "semantic_metric_prior",
    "semantic_metric_temporal",
    "dynamic_reprojection",
    "track_3d_continuity",
    "direction_consistency",
    "relative_velocity",
    "point_reprojection",
    "boundary_reprojection",
    "depth_reprojection",
    "relation",
    "occlusion",
    "reappearance",
]


def entity_columns(df: DataFrame) -> DataFrame:
    """``entity``: who a row speaks of (object, else track, else its name), ``frame``: -1 without one."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return df.withColumn("entity", F.coalesce(blank("object_id"), blank("track_id"), F.col("name"))).withColumn("frame", F.coalesce("frame_index", F.lit(-1)))


def _by_clip(evidence: DataFrame) -> DataFrame:
    """One exchange by clip; every roll-up, window and join below keeps to it."""
    return evidence.repartition(*CLIP)


def fuse_clips(evidence: DataFrame) -> DataFrame:
    """risk_score, coverage, confidence of every clip; NULL risk and confidence 0 without valid rows.

    Invalid rows travel along as counts, so values and coverage come from one pass.
    """
    ok = F.col("valid")
    entities = (
        entity_columns(_by_clip(evidence))
        .groupBy(*CLIP, "frame", "level", "entity")
        .agg(weighted(F.when(ok, F.col("normalized_value")), "confidence").alias("score"), F.avg(F.when(ok, F.col("confidence"))).alias("conf"), F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid_rows"))
    )
    up = [weighted("score", "conf").alias("score"), F.avg("conf").alias("conf"), F.sum("rows").alias("rows"), F.sum("valid_rows").alias("valid_rows")]
    clips = entities.groupBy(*CLIP, "frame").agg(*up).groupBy(*CLIP).agg(*up)
    return clips.select(*CLIP, F.col("score").alias("risk_score"), (F.col("valid_rows") / F.col("rows")).alias("coverage"), F.coalesce(F.col("conf") * F.col("valid_rows") / F.col("rows"), F.lit(0.0)).alias("confidence"))


def fuse_videos(clips: DataFrame) -> DataFrame:
    """Confidence-weighted mean of the clips that have a risk."""
    return clips.groupBy("video_id").agg(weighted("risk_score", "confidence").alias("risk_score"), F.count(F.lit(1)).alias("clips"), F.count("risk_score").alias("scored_clips"))


def contributions(evidence: DataFrame) -> DataFrame:
    """Each valid row's share of its clip's risk; shares of a clip add up to the risk.

    Entity and frame weights come from windows instead of joins: an entity of n rows
    adds 1/n of its weight with each of them, so sums over rows are sums over entities.
    """
    rows = entity_columns(_by_clip(evidence).where("valid"))
    floor = lambda c: F.greatest(c, F.lit(TINY))
    entity, frame, clip = Window.partitionBy(*CLIP, "frame", "level", "entity"), Window.partitionBy(*CLIP, "frame"), Window.partitionBy(*CLIP)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(entity)).withColumn("_c", F.avg("confidence").over(entity)).withColumn("_w", floor(F.col("confidence")) / F.sum(floor(F.col("confidence"))).over(entity))
    each = lambda c: F.col(c) / F.col("_n")
    rows = rows.withColumn("_e", floor(F.col("_c"))).withColumn("_es", F.sum(each("_e")).over(frame)).withColumn("_fn", F.count(F.lit(1)).over(frame)).withColumn("_fc", F.sum(each("_c")).over(frame) / F.sum(F.lit(1.0) / F.col("_n")).over(frame))
    rows = rows.withColumn("_f", floor(F.col("_fc"))).withColumn("_fs", F.sum(F.col("_f") / F.col("_fn")).over(clip))
    share = F.col("normalized_value") * F.col("_w") * F.col("_e") / F.col("_es") * F.col("_f") / F.col("_fs")
    return rows.select(*CLIP, "row_idx", "name", share.alias("contribution"))


def dominant(shares: DataFrame) -> DataFrame:
    """Name of the row that contributes most; the first one on ties."""
    top = F.max_by("name", F.struct(F.round("contribution", 12), -F.col("row_idx")))
    return shares.groupBy(*CLIP).agg(top.alias("dominant_residual"))


def entity_scores(evidence: DataFrame, key: str) -> DataFrame:
    """Per video and object (or track): greatest clip score, a clip's being the weighted mean of its valid rows."""
    rows = evidence.where(F.col(key).isNotNull() & (F.col(key) != ""))
    clips = rows.where("valid").groupBy(*CLIP, key).agg(weighted("normalized_value", "confidence").alias("score"))
    return clips.groupBy("video_id", key).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("clips"))


def channel_matrix(evidence: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """A row for each clip: mean value (NULL if absent), availability and mean confidence (0 if absent) of every channel."""
    here = lambda c: F.col("valid") & (F.col("name") == c)
    columns: list[Column] = []
    for c in channels:
        value = F.avg(F.when(here(c), F.col("normalized_value")))
        columns += [value.alias(f"{c}_value"), (F.count_if(here(c)) > 0).alias(f"{c}_available"), F.coalesce(F.avg(F.when(here(c), F.col("confidence"))), F.lit(0.0)).alias(f"{c}_confidence")]
    return evidence.groupBy(*CLIP).agg(*columns)


def video_risk_mix(clips: DataFrame, w_mean: float = 0.5, w_max: float = 0.3, w_top: float = 0.2, top: int = 3) -> DataFrame:
    """Weighted mix of mean, maximum and mean of the greatest ``top`` clip risks."""
    ranked = clips.where("risk_score IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("risk_score"), "clip_id")))
    agg = ranked.groupBy("video_id").agg(F.avg("risk_score").alias("mean"), F.max("risk_score").alias("most"), F.avg(F.when(F.col("_r") <= top, F.col("risk_score"))).alias("head"))
    return agg.select("video_id", (w_mean * F.col("mean") + w_max * F.col("most") + w_top * F.col("head")).alias("risk"))


def _stats(df: DataFrame, value: str, by: list[str], aggs: list[Column]) -> DataFrame:
    return df.join(df.groupBy(*by).agg(*aggs), by)


def minmax(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(v - min) / (max - min) in every group; 0 in a constant one."""
    joined = _stats(df, value, by, [F.min(value).alias("_lo"), F.max(value).alias("_hi")])
    return joined.withColumn("normalized", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def zscore(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(v - mean) / population deviation in every group; 0 in a constant one."""
    joined = _stats(df, value, by, [F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")])
    return joined.withColumn("normalized", F.when(F.col("_s") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))).drop("_m", "_s")


def heatmap(points: DataFrame) -> DataFrame:
    """Greatest value of every pixel; points round half to even. Columns video_id, frame, x, y, value."""
    return points.groupBy("video_id", "frame", F.rint("x").cast("int").alias("col"), F.rint("y").cast("int").alias("row")).agg(F.max("value").alias("value"))


def video_report(videos: DataFrame, intervals: DataFrame, objects: DataFrame, tracks: DataFrame, top: int = 3) -> DataFrame:
    """One row for each video: its fused scores, its suspicious intervals in order, and its worst objects and tracks.

    Videos: video_id and more. Intervals: video_id, start_frame, end_frame, risk_score. Objects and tracks: video_id, an id, score.
    """
    spans = intervals.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "risk_score"))).alias("intervals"))

    def worst(scores: DataFrame, key: str, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), key))
        rows = scores.withColumn("_r", rank).where(F.col("_r") <= top)
        ranked = F.array_sort(F.collect_list(F.struct("_r", key, "score")))
        return rows.groupBy("video_id").agg(F.transform(ranked, lambda x: F.struct(x[key].alias("id"), x["score"].alias("score"))).alias(name))

    out = videos.join(spans, "video_id", "left").join(worst(objects, "object_id", "objects"), "video_id", "left").join(worst(tracks, "track_id", "tracks"), "video_id", "left")
    kinds = dict(out.dtypes)
    return out.select(*[F.coalesce(c, F.array().cast(kinds[c])).alias(c) if c in ("intervals", "objects", "tracks") else F.col(c) for c in out.columns])
