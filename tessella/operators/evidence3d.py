"""Scale over time and between objects, depth at boundaries, directions, supports and intersections.

Histories are windows of a track; pairs are joined inside a frame (or an object); pixels
meet their neighbours by equality joins. What can't be judged gives a reason, not a zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.stats import array_median, interval_distance, without_nan

from .residuals import d2_reprojection
from .visibility import first_rule

DOMAIN = ["mode", "unit", "provider", "definition", "intrinsics"]


def temporal_scale(rows: DataFrame, track: list[str], least: int = 2, window: int = 5, max_gap: int | None = None, min_quality: float = 0.0, previous_only: bool = False) -> DataFrame:
    """|ln size - ln reference| of an object against its own track, with reason, confidence and uncertainty.

    The reference is the median of the last ``window`` usable earlier sizes of the same dimension (or the last one,
    ``previous_only``). Rows: track, frame_index, dimension, size, mode (metric, relative_local), unit, provider, definition,
    intrinsics, quality, observable, observable_reason, provider_status, scene_cut, continuity, truncated,
    out_of_frame, occlusion, pose, mask_stable, alignment.

    An earlier row in another domain (mode and unit, provider, definition, intrinsics) fails the row, the earliest such
    row naming the reason: it is the track's first row of the dimension, or the first that differs from that. NaN and infinities are NULL.
    """
    c, rows = F.col, without_nan(rows, infinite=True)
    heavy = c("occlusion").isin("heavy_occlusion", "fully_occluded")
    gates = first_rule(
        (~c("observable") | c("size").isNull(), F.coalesce(F.nullif(c("observable_reason"), F.lit("")), F.lit("dimension_not_observable"))),
        (c("provider_status") == "provider_failed", "scale_provider_failed"),
        (c("provider_status") != "ok", "scale_provider_not_ready"),
        (c("quality").isNull() | (c("quality") < min_quality), "current_scale_quality_below_threshold"),
        (c("scene_cut"), "scene_cut_boundary"),
        (~c("continuity").isin("continuous", "recovered_verified"), "track_interruption_or_id_switch"),
        (c("truncated") | c("out_of_frame"), "current_object_truncated_or_out_of_frame"),
        (heavy, "current_object_occluded"),
        (~c("pose").isin("stable", "compatible"), "object_pose_change_not_compatible"),
        (~c("mask_stable"), "unstable_object_mask"),
        ((c("mode") == "relative_local") & ~c("alignment").isin("aligned", "relative_shared_clip"), "relative_depth_scale_not_locally_aligned"),
    ).otherwise("")
    usable = c("observable") & c("size").isNotNull() & (c("provider_status") == "ok") & (c("quality") >= min_quality) & ~c("truncated") & ~c("out_of_frame") & c("mask_stable") & ~heavy & ~c("scene_cut")
    by = Window.partitionBy(*track, "dimension").orderBy("frame_index")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_gate", gates).withColumn("_domain", F.struct(*DOMAIN)).withColumn("_usable", F.coalesce(usable, F.lit(False)))
    out = out.withColumn("_first", F.first("_domain").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    odd = F.first(F.when(c("_domain") != c("_first"), c("_domain")), ignorenulls=True)
    out = out.withColumn("_odd", odd.over(before)).withColumn("_has", F.count(F.lit(1)).over(before))
    other = F.when(c("_has") == 0, None).when(c("_first") != c("_domain"), c("_first")).otherwise(c("_odd"))
    out = out.withColumn("_other", other)
    differs = lambda name: c(f"_other.{name}") != c(name)
    changed = first_rule(
        (differs("mode") | differs("unit"), "scale_domain_or_unit_changed"),
        (differs("provider"), "depth_provider_changed"),
        (differs("definition"), "depth_definition_changed"),
        (differs("intrinsics"), "camera_intrinsics_changed"),
    ).otherwise("")
    # The number of usable rows before, plus one: usable rows have their own place, others that of the next one.
    out = out.withColumn("_at", F.coalesce(F.sum(c("_usable").cast("int")).over(before), F.lit(0)) + 1)
    keep = 1 if previous_only else window
    recent = Window.partitionBy(*track, "dimension").orderBy("_at").rangeBetween(-keep, -1)
    out = out.withColumn("_recent", F.collect_list(F.when(c("_usable"), F.struct("frame_index", "size", "quality"))).over(recent))
    sizes, qualities = F.transform("_recent", lambda x: x["size"]), F.transform("_recent", lambda x: x["quality"])
    out = out.withColumn("_reference", array_median(sizes))
    gap = c("frame_index") - F.array_max(F.transform("_recent", lambda x: x["frame_index"]))
    enough = c("_at") - 1 >= (1 if previous_only else least)
    reason = F.when(c("_gate") != "", c("_gate")).when(c("_other").isNotNull() & (changed != ""), changed)
    if max_gap is not None:
        reason = reason.when(gap > max_gap, "track_history_frame_gap_too_large")
    out = out.withColumn("reason", reason.when(~enough, "insufficient_valid_scale_history").otherwise(""))
    ok = c("reason") == ""
    spread = array_median(F.transform("_recent", lambda x: F.abs(F.ln(x["size"]) - F.ln(c("_reference")))))
    out = out.withColumn("residual", F.when(ok, F.abs(F.ln("size") - F.ln("_reference"))))
    out = out.withColumn("confidence", F.when(ok, F.least("quality", array_median(qualities))).otherwise(F.lit(0.0))).withColumn("uncertainty", F.when(ok, spread))
    return out.withColumn("history", F.when(ok, c("_at") - 1)).drop(*[x for x in out.columns if x.startswith("_")])


def aligned_scale_depth(objects: DataFrame, frame: str, depth_mode: str = "real_depth_invert", applicability: bool = False) -> DataFrame:
    """Depth ratio of every pair of a frame against the interval that priors and projected measurements allow, dimension by dimension.

    Objects: frame, object_id, label, depth, measured, measured_valid, gate_passed, prior_status (NULL: none), prior_available,
    low, high, group (of comparable dimensions), applicability_reason ('' passes, NULL: not judged; only persons and cups).
    """
    c = F.col
    columns = ["object_id", "label", "depth", "measured", "measured_valid", "gate_passed", "prior_status", "prior_available", "low", "high", "group", "applicability_reason"]
    side = lambda s: objects.select(frame, *[c(x).alias(f"{x}_{s}") for x in columns])
    pairs = side("a").join(side("b"), frame).where("object_id_a < object_id_b")

    def prior(s: str) -> list[tuple[Column, str]]:
        status = c(f"prior_status_{s}")
        return [
            (status.isNull(), f"missing_prior_{s}"),
            (status == "pose_sensitive", f"pose_sensitive_prior_{s}"),
            (status.isin("unsupported", "insufficient_source") | ~c(f"prior_available_{s}"), f"unsupported_prior_{s}"),
        ]

    no_depth = lambda s: c(f"depth_{s}").isNull() | F.isnan(f"depth_{s}") | (c(f"depth_{s}") <= 0) | (c(f"depth_{s}") == float("inf"))
    rules = [(F.lit(depth_mode != "real_depth_invert"), "invalid_depth_mode"), (no_depth("a"), "invalid_depth_a"), (no_depth("b"), "invalid_depth_b"), *prior("a"), *prior("b")]
    rules += [(~c(f"measured_valid_{s}"), f"invalid_projected_measurement_{s}") for s in "ab"]
    rules += [(c("group_a") != c("group_b"), "incompatible_projected_dimensions")]
    rules += [(~c(f"gate_passed_{s}"), f"observation_gate_failed_{s}") for s in "ab"]
    if applicability:
        for label, unjudged in (("person", "person_insufficient_keypoints"), ("cup", "cup_measurement_not_applicable")):
            for s in "ab":
                why = F.coalesce(c(f"applicability_reason_{s}"), F.lit(unjudged))
                rules.append(((c(f"label_{s}") == label) & (why != ""), why))
    reason = first_rule(*rules).otherwise("")
    ratio, scale = c("depth_a") / c("depth_b"), c("measured_b") / c("measured_a")
    low, high = c("low_a") / c("high_b") * scale, c("high_a") / c("low_b") * scale
    out = pairs.withColumn("reason", reason)
    ok = c("reason") == ""
    depths = ~no_depth("a") & ~no_depth("b")
    return out.select(
        frame, c("object_id_a").alias("object_a"), c("object_id_b").alias("object_b"), F.when(depths, ratio).alias("depth_ratio"), F.when(ok, low).alias("low"), F.when(ok, high).alias("high"),
        F.when(ok, interval_distance(ratio, low, high)).alias("rsd_ratio"), F.when(ok, interval_distance(F.ln(ratio), F.ln(low), F.ln(high))).alias("rsd_log"),
        F.when(ok, F.when((c("prior_status_a") == "strict_high") & (c("prior_status_b") == "strict_high"), "strict_high").otherwise("conditional_physical")).alias("tier"), "reason",
    )


def boundary_pairs(mask: DataFrame, keys: list[str], height: int, width: int, most: int = 512) -> DataFrame:
    """(keys, row, col, outer_row, outer_col): contour pixels of a mask and the first pixel beside each that lies outside.

    Mask: keys, row, col (distinct). Neighbours are the eight around, in reading order, inside the image. Of more than ``most``
    contour pixels evenly spaced ones stay (the spacing is the operator's own sampling).
    """
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc)])
    near = mask.withColumn("_n", F.explode(around)).select(*keys, "row", "col", F.col("_n.i").alias("_i"), (F.col("row") + F.col("_n.dr")).alias("outer_row"), (F.col("col") + F.col("_n.dc")).alias("outer_col"))
    near = near.where(F.col("outer_row").between(0, height - 1) & F.col("outer_col").between(0, width - 1))
    inside = mask.select(*keys, F.col("row").alias("outer_row"), F.col("col").alias("outer_col")).hint("merge")  # masks grow with their frames
    outer = near.join(inside, [*keys, "outer_row", "outer_col"], "left_anti")
    first = outer.groupBy(*keys, "row", "col").agg(F.min_by(F.struct("outer_row", "outer_col"), "_i").alias("o"))
    by = Window.partitionBy(*keys)
    ranked = first.withColumn("_r", F.row_number().over(by.orderBy("row", "col")) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    # Rank r is one of the evenly spaced ones if the first step that reaches it lands on it.
    spaced = F.expr(f"_r = ((_r * {most - 1} + _n - 2) DIV greatest(_n - 1, 1)) * (_n - 1) DIV {most - 1}")
    return ranked.where((F.col("_n") <= most) | spaced).select(*keys, "row", "col", "o.outer_row", "o.outer_col")


def boundary_depth(pairs: DataFrame, depth: DataFrame, frame: list[str], keys: list[str], min_jump: float = 0.03, source_quality: float = 1.0) -> DataFrame:
    """Share of an object's contour where depth jumps against the prevailing direction, with its quality.

    Pairs: what :func:`boundary_pairs` gives. Depth: frame, row, col, z (NULL, not above 0 or not finite: missing). ``source_quality``: 1 for a mask, 0.3 for
    a box. Objects without any pair don't appear; without any depth they get a reason.
    """
    good = depth.where((F.col("z") > 0) & (F.col("z") < float("inf")))
    # A depth map grows with its frames, though its size looks small where it is made by explode: it is never broadcast.
    at = lambda r, c, z: good.select(*frame, F.col("row").alias(r), F.col("col").alias(c), F.col("z").alias(z)).hint("merge")
    rows = pairs.join(at("row", "col", "_in"), [*frame, "row", "col"], "left").join(at("outer_row", "outer_col", "_out"), [*frame, "outer_row", "outer_col"], "left")
    jump = (F.col("_out") - F.col("_in")) / F.greatest("_out", "_in", F.lit(1e-12))
    rows = rows.withColumn("_j", jump)
    large = F.abs("_j") >= min_jump
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.count("_j").alias("valid_pairs"), F.median(F.abs("_j")).alias("median_jump"), F.avg(F.abs("_j")).alias("mean_jump"), F.signum(F.median(F.when(large, F.col("_j")))).alias("direction"),
        F.count_if(large).alias("_aligned"), *[F.count_if(large & (F.signum("_j") != i)).alias(f"_not{i}") for i in (-1, 0, 1)],
    )
    against = F.when(F.col("direction") < 0, F.col("_not-1")).when(F.col("direction") > 0, F.col("_not1")).when(F.col("direction") == 0, F.col("_not0"))
    out = agg.withColumn("_against", against)
    some = F.col("valid_pairs") > 0
    contrast = F.least(F.lit(1.0), F.col("median_jump") / max(min_jump, 1e-12))
    return out.select(
        *keys, "pairs", "valid_pairs", F.when(some, F.coalesce("_against", F.lit(0)) / F.col("valid_pairs")).alias("residual"), F.when(some, F.col("_aligned") / F.col("valid_pairs")).alias("aligned"), "mean_jump", "median_jump",
        F.when(some, F.coalesce("direction", F.lit(0.0))).alias("direction"), F.when(some, source_quality * F.col("valid_pairs") / F.col("pairs") * contrast).otherwise(F.lit(0.0)).alias("quality"), F.when(some, "").otherwise("missing_depth_at_boundary").alias("reason"),
    )


def boundary_reprojection(rows: DataFrame) -> DataFrame:
    """Error of boundary correspondences: the source pixel goes back to space by its depth, through the pose and into the target.

    Rows: source_u, source_v, source_z, pose (16, target from source), fx, fy, cx, cy, width, height, seen_u, seen_v, seen_z.
    Adds predicted, state, boundary_error (over the diagonal, visible points only).
    """
    k = [F.col(x) for x in ("fx", "fy", "cx", "cy")]
    source = G.back_project(F.col("source_u"), F.col("source_v"), F.col("source_z"), *k)
    moved = F.when(F.col("source_z").isNotNull() & F.col("pose").isNotNull(), G.transform(F.col("_s"), F.col("pose")))
    out = d2_reprojection(rows.withColumn("_s", source).withColumn("predicted", moved).drop("_s"))
    state = F.when(F.col("pose").isNull() | F.col("source_z").isNull(), "metric_depth_intrinsics_or_pose_unavailable").otherwise(F.col("state"))
    return out.withColumn("state", state).withColumnRenamed("pixel_error", "boundary_error").drop("depth_error")


def dynamic_reprojection(rows: DataFrame) -> DataFrame:
    """What a point's distance from its prediction says: evidence_type, diagnostic (error over the diagonal), residual, quality, reason.

    Rows: what :func:`gates.reprojection_gate` judged (with its reason), previous and motion (structs x, y, z), pose (16, current from previous), fx, fy, cx,
    cy, width, height, seen_u, seen_v, background, previous_quality, tracking_confidence. Only a motion prediction from history makes a
    residual; background is quality assurance, and a foreground moved by the camera alone a diagnosis.
    """
    c = F.col
    pose = lambda i: F.get("pose", F.lit(i))
    turned = lambda i: pose(4 * i) * c("previous.x") + pose(4 * i + 1) * c("previous.y") + pose(4 * i + 2) * c("previous.z")
    by_camera = F.when(c("mode") == "static_camera_3d", c("previous")).when(c("mode") == "rotation_compensated", G.point(turned(0), turned(1), turned(2))).otherwise(G.transform(c("previous"), c("pose")))
    out = rows.withColumn("_p", F.when(c("reason") == "", F.when(c("predicted"), c("motion")).otherwise(by_camera)))
    out = out.withColumn("_uv", G.project(c("_p"), c("fx"), c("fy"), c("cx"), c("cy")))
    out = out.withColumn("reason", F.when((c("reason") == "") & c("_uv").isNull(), "predicted_point_not_projectable").otherwise(c("reason")))
    ok = c("reason") == ""
    error = F.sqrt((c("_uv.u") - c("seen_u")) ** 2 + (c("_uv.v") - c("seen_v")) ** 2) / F.sqrt(c("width") ** 2 + c("height") ** 2)
    kind = F.when(~ok, "missing").when(c("predicted"), "dynamic_reprojection_residual").when(c("background"), "background_reprojection_quality").otherwise("camera_compensated_motion_diagnostic")
    out = out.withColumn("evidence_type", kind).withColumn("diagnostic", F.when(ok, error))
    out = out.withColumn("residual", F.when(ok & c("predicted"), c("diagnostic"))).withColumn("quality", F.when(ok, F.least("previous_quality", "tracking_confidence")).otherwise(F.lit(0.0)))
    why = F.when(c("reason") != "", c("reason")).when(c("predicted"), "").when(c("background"), "background_reprojection_is_geometry_qa").otherwise("foreground_motion_model_unavailable")
    return out.withColumn("reason", why).drop("_p", "_uv")


def _turn(a: Column, b: Column, least: float) -> Column:
    dot = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
    na, nb = (F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]) for v in (a, b))
    return F.when((na > least) & (nb > least), 1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / (na * nb))))


def direction_evidence(tracks: DataFrame, neighbours: DataFrame, group: list[str], least: float = 1e-6) -> DataFrame:
    """1 - cos of a point's step against its own step before, the median step of the object's other points, and that of its neighbours.

    Tracks: group (object), point_id, frame_index, p. Neighbours: point_id, neighbours (array of point_id). A step
    goes from a point's previous row to this one; others count if they have both of these frames. Rows from a point's third on.

    The median without the point itself follows from its rank and the few steps in the middle of all, so no point meets all others;
    neighbours meet by point, a row each.
    """
    c = F.col
    by = Window.partitionBy(*group, "point_id").orderBy("frame_index")
    step = lambda a, b: F.struct(*[(a[x] - b[x]).alias(x) for x in "xyz"])
    own = tracks.select(*group, "point_id", "frame_index", "p", F.lag("p").over(by).alias("_1"), F.lag("p", 2).over(by).alias("_2"), F.lag("frame_index").over(by).alias("_f1")).where("_f1 IS NOT NULL")
    own = own.withColumn("_step", step(c("p"), c("_1"))).withColumn("_before", F.when(c("_2").isNotNull(), step(c("_1"), c("_2"))))
    spans = own.select(*group, "frame_index", "_f1").distinct()
    now = tracks.select(*group, "frame_index", c("point_id").alias("_q"), c("p").alias("_now"))
    then = tracks.select(*group, c("frame_index").alias("_f1"), c("point_id").alias("_q"), c("p").alias("_then"))
    span = [*group, "frame_index", "_f1"]
    moves = spans.join(now, [*group, "frame_index"]).join(then, [*group, "_f1", "_q"]).select(*span, "_q", step(c("_now"), c("_then")).alias("_d"))
    # Each coordinate's order, and the steps around the middle.
    moves = moves.withColumns({f"_r{x}": F.row_number().over(Window.partitionBy(*span).orderBy(f"_d.{x}", "_q")) - 1 for x in "xyz"})
    moves = moves.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*span)))
    low, high = F.floor((c("_n") - 2) / 2), F.floor((c("_n") - 1) / 2)
    at = lambda x, place: F.max(F.when(c(f"_r{x}") == place, c(f"_d.{x}")))
    centre = moves.groupBy(*span).agg(*[at(x, place).alias(f"_{x}{name}") for x in "xyz" for name, place in (("a", low), ("b", low + 1), ("c", high), ("d", high + 1))])
    ranked = moves.join(centre, span)
    others = lambda x: F.when(c("_n") > 1, (F.when(low < c(f"_r{x}"), c(f"_{x}a")).otherwise(c(f"_{x}b")) + F.when(high < c(f"_r{x}"), c(f"_{x}c")).otherwise(c(f"_{x}d"))) / 2)
    ranked = ranked.select(*span, c("_q").alias("point_id"), F.struct(*[others(x).alias(x) for x in "xyz"]).alias("_others"))
    rows = own.where("_2 IS NOT NULL")
    near = rows.select(*span, "point_id").join(neighbours.select("point_id", F.explode("neighbours").alias("_q")), "point_id").where(c("_q") != c("point_id"))
    near = near.join(moves.select(*span, "_q", "_d"), [*span, "_q"])
    near = near.groupBy(*span, "point_id").agg(F.struct(*[F.median(f"_d.{x}").alias(x) for x in "xyz"]).alias("_local"))
    out = rows.join(ranked, [*span, "point_id"]).join(near, [*span, "point_id"], "left")
    result = out.select(*group, "point_id", "frame_index", _turn(c("_step"), c("_before"), least).alias("own"), _turn(c("_step"), c("_others"), least).alias("object_median"), _turn(c("_step"), c("_local"), least).alias("neighbour"))
    return result.withColumn("reason", F.when(c("own").isNull(), "direction_undefined_for_near_static_displacement").otherwise(""))


def object_dynamics(rows: DataFrame, keys: list[str], trim: float = 0.10, top: int = 3) -> DataFrame:
    """Median, trimmed mean and top-k mean of an object's valid point and edge evidence, valid shares, worst points and edges.

    Rows: keys, kind (point, edge), item_id, value, quality, valid. Without valid evidence the values are NULL, with a reason.
    """
    valid = F.col("valid")
    by = Window.partitionBy(*keys, "valid")
    ranked = rows.withColumn("_r", F.row_number().over(by.orderBy("value", "kind", "item_id"))).withColumn("_n", F.count(F.lit(1)).over(by))
    ranked = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "valid", "kind").orderBy(F.desc("value"), "item_id")))
    cut = F.floor(F.col("_n") * trim)
    kept = F.when(F.col("_n") > 2 * cut, F.col("_r").between(cut + 1, F.col("_n") - cut)).otherwise(True)
    share = lambda kind: F.coalesce(F.count_if(valid & (F.col("kind") == kind)) / F.nullif(F.count_if(F.col("kind") == kind), F.lit(0)), F.lit(0.0))
    worst = lambda kind: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(valid & (F.col("kind") == kind) & (F.col("_k") <= top), F.struct("_k", F.col("item_id").cast("string").alias("id"))))), lambda x: x["id"]))
    return ranked.groupBy(*keys).agg(
        F.median(F.when(valid, F.col("value"))).alias("median"), F.avg(F.when(valid & kept, F.col("value"))).alias("trimmed_mean"), F.avg(F.when(valid & (F.col("_r") > F.col("_n") - top), F.col("value"))).alias("topk_mean"),
        share("point").alias("valid_point_ratio"), share("edge").alias("valid_edge_ratio"), worst("point").alias("top_points"), worst("edge").alias("top_edges"), F.coalesce(F.avg(F.when(valid, F.col("quality"))), F.lit(0.0)).alias("quality"),
        F.when(F.count_if(valid) == 0, "no_valid_dynamic_evidence").otherwise("").alias("reason"),
    )


def predict_support(masks: DataFrame, frames: DataFrame, keys: list[str], target: int, height: int, width: int) -> DataFrame:
    """Where an object's mask should be in frame ``target``: its last mask moved on at the speed of the last two.

    Masks: keys, frame_index, row, col. Frames: keys, frame_index, confidence, legacy (a box only), for every valid mask.
    Gives predicted_area, support_area, in_frame_ratio, shift_u, shift_v, quality, reason; the warp is nearest-neighbour.
    """
    c = F.col
    past = frames.where(c("frame_index") < target)
    ranked = past.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("frame_index")))).where("_r <= 2")
    centre = masks.groupBy(*keys, "frame_index").agg(F.avg("col").alias("u"), F.avg("row").alias("v"), F.count(F.lit(1)).alias("area"))
    two = ranked.join(centre, [*keys, "frame_index"])
    pick = lambda r, x: F.max(F.when(c("_r") == r, c(x)))
    last = two.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"), *[pick(r, x).alias(f"_{x}{r}") for r in (1, 2) for x in ("frame_index", "u", "v", "area")], F.min("confidence").alias("_q"), F.max(c("legacy").cast("int")).alias("_l"))
    ahead = (F.lit(target) - c("_frame_index1")) / (c("_frame_index1") - c("_frame_index2"))
    last = last.withColumn("shift_u", (c("_u1") - c("_u2")) * ahead).withColumn("shift_v", (c("_v1") - c("_v2")) * ahead)
    pixels = masks.join(last.where("_have = 2").select(*keys, c("_frame_index1").alias("frame_index"), "shift_u", "shift_v"), [*keys, "frame_index"])
    moved = pixels.where(F.ceil(c("col") + c("shift_u") - 0.5).between(0, width - 1) & F.ceil(c("row") + c("shift_v") - 0.5).between(0, height - 1))
    support = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("support_area"))
    out = last.join(support, keys, "left").withColumn("support_area", F.coalesce("support_area", F.lit(0)))
    reason = F.when(c("_have") < 2, "insufficient_mask_history").when(c("support_area") == 0, "predicted_support_outside_frame").otherwise("")
    out = out.withColumn("reason", reason)
    ok = c("reason") == ""
    quality = F.when(c("_l") == 1, F.least("_q", F.lit(0.25))).otherwise(c("_q"))
    return out.select(*keys, F.when(ok, c("_area1")).alias("predicted_area"), F.when(ok, c("support_area")).alias("support_area"), F.when(ok, F.least(F.lit(1.0), c("support_area") / c("_area1"))).alias("in_frame_ratio"), "shift_u", "shift_v", F.when(ok, quality).otherwise(F.lit(0.0)).alias("quality"), "reason")


def spatial_intersection(points: DataFrame, frame: list[str], least: int = 3) -> DataFrame:
    """How much two objects of a frame seem to share space: overlap of their boxes, nearness of their sparse points, a centre inside.

    Points: frame, object_id, x, y, z, scale_status, object_scale, object_quality (the same on all points of an object; the points are sparse).
    """
    c = F.col
    of = points.groupBy(*frame, "object_id").agg(*[f(x).alias(f"{n}{x}") for x in "xyz" for n, f in (("lo_", F.min), ("hi_", F.max), ("c_", F.median))], F.count(F.lit(1)).alias("n"), F.first("scale_status").alias("status"), F.first("object_scale").alias("size"), F.first("object_quality").alias("q"))
    names = [x for x in of.columns if x not in frame]
    side = lambda s: of.select(*frame, *[c(x).alias(f"{x}_{s}") for x in names])
    pairs = side("a").join(side("b"), frame).where("object_id_a < object_id_b")
    xyz = lambda s: points.select(*frame, c("object_id").alias(f"object_id_{s}"), F.struct("x", "y", "z").alias(f"_p{s}"))
    near = xyz("a").join(xyz("b"), frame).where("object_id_a < object_id_b").groupBy(*frame, "object_id_a", "object_id_b").agg(F.min(G.distance(c("_pa"), c("_pb"))).alias("_near"))
    out = pairs.join(near, [*frame, "object_id_a", "object_id_b"])
    overlap, va, vb, a_in, b_in = F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(True)
    for x in "xyz":
        overlap = overlap * F.greatest(F.lit(0.0), F.least(f"hi_{x}_a", f"hi_{x}_b") - F.greatest(f"lo_{x}_a", f"lo_{x}_b"))
        va, vb = va * (c(f"hi_{x}_a") - c(f"lo_{x}_a")), vb * (c(f"hi_{x}_b") - c(f"lo_{x}_b"))
        a_in, b_in = a_in & c(f"c_{x}_a").between(c(f"lo_{x}_b"), c(f"hi_{x}_b")), b_in & c(f"c_{x}_b").between(c(f"lo_{x}_a"), c(f"hi_{x}_a"))
    small = F.least(va, vb)
    ratio = F.when(small > 1e-12, overlap / small).otherwise(F.lit(0.0))
    nearness = 1 - F.least(F.lit(1.0), c("_near") / F.greatest("size_a", "size_b", F.lit(1e-12)))
    value = F.least(F.lit(1.0), F.greatest(ratio, nearness, (a_in | b_in).cast("double"), F.lit(0.0)))
    few = (F.least("n_a", "n_b") < least) | (F.least("q_a", "q_b") <= 0)
    reason = F.when(few, "insufficient_3d_spatial_evidence").when(c("status_a") != c("status_b"), "incompatible_scale_domains").otherwise("")
    out = out.withColumn("reason", reason)
    ok = c("reason") == ""
    return out.select(*frame, c("object_id_a").alias("a"), c("object_id_b").alias("b"), F.when(ok, ratio).alias("overlap_ratio"), F.when(ok, c("_near")).alias("min_distance"), F.when(ok, value).alias("diagnostic"), F.when(ok, F.least("q_a", "q_b") * 0.5).otherwise(F.lit(0.0)).alias("quality"), "reason")


def clip_depth_summary(transitions: DataFrame, clips: DataFrame, top: int = 3) -> DataFrame:
    """Tracks, valid transitions, mean, maximum, top-k mean and weighted mean of the depth transitions inside a clip (0 when empty: legacy).

    Transitions: video_id, track_id, frame_index, gap, residual, weight. Clips: video_id, clip_ordinal, start_frame, end_frame; both
    frames of a transition must lie in the clip.
    """
    first = F.col("frame_index") - F.col("gap")
    rows = clips.join(transitions.where("gap IS NOT NULL"), "video_id", "left").where(F.col("gap").isNull() | ((first >= F.col("start_frame")) & (F.col("frame_index") <= F.col("end_frame"))))
    by = Window.partitionBy("video_id", "clip_ordinal").orderBy(F.desc_nulls_last("residual"), "frame_index", "track_id")
    rows = rows.withColumn("_r", F.row_number().over(by))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    agg = rows.groupBy("video_id", "clip_ordinal").agg(F.count_distinct("track_id").alias("tracks"), F.count("residual").alias("transitions"), F.avg("residual").alias("mean"), F.max("residual").alias("max"), F.avg(F.when(F.col("_r") <= top, F.col("residual"))).alias("top_mean"), F.avg(F.col("residual") * F.col("weight")).alias("weighted"))
    out = clips.select("video_id", "clip_ordinal").join(agg, ["video_id", "clip_ordinal"], "left")
    return out.select("video_id", "clip_ordinal", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("tracks", "transitions")], *[z(x).alias(x) for x in ("mean", "max", "top_mean", "weighted")])
