"""Temporal and geometric residuals of tracks, objects and scales.

Track rows: video_id, point_id, frame_index, p (struct x, y, z), scale. Windows run
over (video_id, point_id) in frame order; nothing reads the target or a later frame
to predict it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.stats import array_median

TRACK = ["video_id", "point_id"]


def _by():
    return Window.partitionBy(*TRACK).orderBy("frame_index")


def velocity_prediction(tracks: DataFrame) -> DataFrame:
    """Constant velocity from the two rows before: p2 + (p2 - p1) dt / dh, and its distance from what was seen."""
    out = tracks
    for i in (1, 2):
        out = out.withColumn(f"_p{i}", F.lag("p", i).over(_by())).withColumn(f"_f{i}", F.lag("frame_index", i).over(_by()))
    r = (F.col("frame_index") - F.col("_f1")) / (F.col("_f1") - F.col("_f2"))
    ahead = lambda c: F.col(f"_p1.{c}") + (F.col(f"_p1.{c}") - F.col(f"_p2.{c}")) * r
    predicted = F.when(F.col("_p2").isNotNull(), G.point(ahead("x"), ahead("y"), ahead("z")))
    out = out.withColumn("predicted", predicted)
    return out.withColumn("error", F.when(F.col("predicted").isNotNull(), G.distance(F.col("p"), F.col("predicted")))).drop("_p1", "_p2", "_f1", "_f2")


def continuity(tracks: DataFrame) -> DataFrame:
    """Second difference |x_t - 2 x_{t-1} + x_{t-2}| and its ratio to the object's scale; rows before the third are missing."""
    a, b = F.lag("p", 1).over(_by()), F.lag("p", 2).over(_by())
    out = tracks.withColumn("_a", a).withColumn("_b", b)
    second = lambda c: F.col(f"p.{c}") - 2 * F.col(f"_a.{c}") + F.col(f"_b.{c}")
    raw = F.when(F.col("_b").isNotNull(), F.sqrt(second("x") ** 2 + second("y") ** 2 + second("z") ** 2))
    return out.withColumn("raw", raw).withColumn("normalized", F.when(F.col("scale") > 0, F.col("raw") / F.col("scale"))).drop("_a", "_b")


def _steps(tracks: DataFrame) -> DataFrame:
    out = tracks.withColumn("_q", F.lag("p").over(_by())).withColumn("dt", F.col("frame_index") - F.lag("frame_index").over(_by()))
    for c in "xyz":
        out = out.withColumn(f"d{c}", F.col(f"p.{c}") - F.col(f"_q.{c}"))
    return out.withColumn("step", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)).drop("_q")


def direction_change(tracks: DataFrame, least: float = 1e-6) -> DataFrame:
    """1 - cos between a step and the one before; missing when either is nearly still."""
    s = _steps(tracks)
    before = {c: F.lag(c).over(_by()) for c in ("dx", "dy", "dz", "step")}
    out = s.select("*", *[v.alias(f"_{k}") for k, v in before.items()])
    cos = (F.col("dx") * F.col("_dx") + F.col("dy") * F.col("_dy") + F.col("dz") * F.col("_dz")) / (F.col("step") * F.col("_step"))
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))
    moved = (F.col("step") > least) & (F.col("_step") > least)
    return out.withColumn("direction_change", F.when(moved, 1 - cos)).select(*TRACK, "frame_index", "direction_change")


def speed_change(tracks: DataFrame) -> DataFrame:
    """Speed in scales a frame, its change, and its distance from the median of the other points of the object."""
    s = _steps(tracks).withColumn("speed", F.when((F.col("scale") > 0) & (F.col("dt") > 0), F.col("step") / (F.col("dt") * F.col("scale"))))
    s = s.withColumn("speed_change", F.abs(F.col("speed") - F.lag("speed").over(_by())))
    peers = s.groupBy("video_id", "frame_index").agg(F.collect_list(F.struct("point_id", "speed")).alias("all"))
    joined = s.join(peers, ["video_id", "frame_index"])
    others = F.transform(F.filter("all", lambda x: x["point_id"] != F.col("point_id")), lambda x: x["speed"])
    median = array_median(others)
    return joined.withColumn("peer_gap", F.abs(F.col("speed") - median)).select(*TRACK, "frame_index", "speed", "speed_change", "peer_gap")


def depth_transitions(rows: DataFrame, max_gap: int = 1, tolerance: float = 0.1, eps: float = 1e-6) -> DataFrame:
    """Change of ln(relative depth) + ln(projected size) of a track over a small frame gap, beyond a tolerance.

    Rows: video_id, track_id, frame_index, depth, reference, size, confidence.
    """
    by = Window.partitionBy("video_id", "track_id").orderBy("frame_index")
    g = F.ln(F.col("depth") / F.col("reference") + eps) + F.ln(F.col("size") + eps)
    out = rows.withColumn("g", g).withColumn("gap", F.col("frame_index") - F.lag("frame_index").over(by))
    out = out.withColumn("_g", F.lag("g").over(by)).withColumn("_c", F.lag("confidence").over(by))
    ok = F.col("gap").between(1, max_gap)
    out = out.withColumn("residual", F.when(ok, F.greatest(F.lit(0.0), F.abs(F.col("g") - F.col("_g")) - tolerance)))
    return out.withColumn("weight", F.when(ok, F.sqrt(F.col("confidence") * F.col("_c")))).select("video_id", "track_id", "frame_index", "gap", "residual", "weight")


def track_summary(transitions: DataFrame, top: int = 3) -> DataFrame:
    """Mean, maximum, mean of the greatest three, and share of valid transitions of every track (0 when empty: legacy)."""
    by = Window.partitionBy("video_id", "track_id").orderBy(F.desc_nulls_last("residual"), "frame_index")
    ranked = transitions.withColumn("_r", F.row_number().over(by))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return ranked.groupBy("video_id", "track_id").agg(
        z(F.avg("residual")).alias("mean"), z(F.max("residual")).alias("max"), z(F.avg(F.when(F.col("_r") <= top, F.col("residual")))).alias("top_mean"), (F.count("residual") / F.count(F.lit(1))).alias("valid_ratio")
    )


def size_history(rows: DataFrame, keep: int = 5) -> DataFrame:
    """|ln(size) - ln(median of the last five earlier sizes of the same axis)| and the lower of both confidences.

    Rows: video_id, track_id, frame_index, size, axis, confidence. Without comparable
    history the reason says whether any earlier row exists.
    """
    track = Window.partitionBy("video_id", "track_id").orderBy("frame_index")
    # Earlier rows of the same axis are a window of their own, so no frame holds more than ``keep`` of them.
    axis = Window.partitionBy("video_id", "track_id", "axis").orderBy("frame_index").rowsBetween(-keep, -1)
    out = rows.withColumn("_i", F.row_number().over(track)).withColumn("_sizes", F.collect_list("size").over(axis)).withColumn("_confs", F.collect_list("confidence").over(axis))
    have = F.size("_sizes") > 0
    return out.select(
        "video_id",
        "track_id",
        "frame_index",
        F.when(have, F.abs(F.ln("size") - F.ln(array_median(F.col("_sizes"))))).alias("residual"),
        F.when(have, F.least("confidence", array_median(F.col("_confs")))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(have, "").when(F.col("_i") > 1, "no_comparable_axis_history").otherwise("no_track_history").alias("reason"),
    )


def prefix_poses(poses: DataFrame) -> DataFrame:
    """Product of all poses of a clip up to each frame, NULL from the first missing one on; confidence is the running minimum.

    Rows: video_id, frame_index, pose (16 doubles), confidence; video_id may be a clip's id. Each
    group's poses are collected once and folded in order by a higher-order function, on the JVM.
    """
    unit = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    frames = F.array_sort(F.collect_list(F.struct("frame_index", "pose", "confidence")))
    step = "struct<frame_index:%s,pose_to_first:array<double>,chain_confidence:double>" % dict(poses.dtypes)["frame_index"]
    start = F.struct(unit.alias("chain"), F.lit(1.0).alias("least"), F.array().cast(f"array<{step}>").alias("out"))

    def fold(acc, x):
        chain = F.when(acc["chain"].isNotNull() & x["pose"].isNotNull(), G.matmul4(x["pose"], acc["chain"]))
        least = F.least(acc["least"], x["confidence"])
        row = F.struct(x["frame_index"].alias("frame_index"), chain.alias("pose_to_first"), F.when(chain.isNotNull(), least).otherwise(F.lit(0.0)).alias("chain_confidence"))
        return F.struct(chain.alias("chain"), least.alias("least"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = poses.groupBy("video_id").agg(frames.alias("_all"))
    return folded.select("video_id", F.explode(F.aggregate("_all", start, fold, lambda acc: acc["out"])).alias("r")).select("video_id", "r.*")


def d2_reprojection(rows: DataFrame) -> DataFrame:
    """Gate, then pixel error over the diagonal and relative depth error.

    Rows: predicted (struct x, y, z) in the target camera, fx, fy, cx, cy, width, height,
    seen_u, seen_v, seen_z and whatever else passes through.
    """
    uv = G.project(F.col("predicted"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    r = rows.withColumn("_uv", uv)
    tau = F.greatest(F.lit(0.10), 0.10 * F.col("seen_z"))
    delta = F.col("predicted.z") - F.col("seen_z")
    outside = (F.col("_uv.u") < 0) | (F.col("_uv.v") < 0) | (F.col("_uv.u") >= F.col("width")) | (F.col("_uv.v") >= F.col("height"))
    state = (
        F.when(F.col("predicted").isNull(), "point_missing")
        .when(F.col("predicted.z") <= 0, "behind_camera")
        .when(outside, "out_of_frame")
        .when(F.col("seen_u").isNull() | F.col("seen_v").isNull(), "no_correspondence")
        .when(F.col("seen_z").isNull(), "depth_missing")
        .when(delta > tau, "occluded")
        .when(delta < -tau, "depth_conflict")
        .otherwise("visible")
    )
    r = r.withColumn("state", state)
    ok = F.col("state") == "visible"
    pixel = F.sqrt((F.col("_uv.u") - F.col("seen_u")) ** 2 + (F.col("_uv.v") - F.col("seen_v")) ** 2) / F.sqrt(F.col("width") ** 2 + F.col("height") ** 2)
    return r.withColumn("pixel_error", F.when(ok, pixel)).withColumn("depth_error", F.when(ok, F.abs(delta) / F.col("seen_z"))).drop("_uv")


def object_d2(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median over an object of its points' error, or boundary error where there is none."""
    return rows.groupBy(*keys).agg(F.median(F.coalesce("point_error", "boundary_error")).alias("residual"))


def surface_extent(points: DataFrame, keys: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Quantile extents, median centre and covariances of the points of a surface (columns x, y, z)."""
    q = lambda c, p: F.percentile(c, p)
    return points.groupBy(*keys).agg(
        *[(q(c, high) - q(c, low)).alias(f"extent_{c}") for c in "xyz"],
        *[F.median(c).alias(f"centre_{c}") for c in "xyz"],
        F.covar_samp("x", "y").alias("cov_xy"),
        F.covar_samp("x", "z").alias("cov_xz"),
        F.covar_samp("y", "z").alias("cov_yz"),
        F.count(F.lit(1)).alias("points"),
    )


def principal_axis2(points: DataFrame, keys: list[str], dominance: float = 1.25) -> DataFrame:
    """Principal axis of 2-D points in closed form; NULL angle unless the first eigenvalue dominates."""
    m = points.groupBy(*keys).agg(F.covar_samp("x", "x").alias("a"), F.covar_samp("x", "y").alias("b"), F.covar_samp("y", "y").alias("c"))
    half = F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    mid = (F.col("a") + F.col("c")) / 2
    m = m.withColumn("major", mid + half).withColumn("minor", F.greatest(mid - half, F.lit(0.0)))
    ok = F.col("major") >= dominance * F.greatest("minor", F.lit(1e-12))
    return m.select(*keys, "major", "minor", F.when(ok, 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))).alias("angle"))
