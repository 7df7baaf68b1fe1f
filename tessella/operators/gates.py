"""Gates: ordered rules give the first reason that blocks a row, or all the checks it fails.

A gate is a list of (reason, condition). Order is meaning: the first true condition
names the reason, an empty reason means passed. Conditions are columns, so a gate
is one CASE inside code generation, and unknown (NULL) conditions don't block. NaN is
no number: a comparison with it is unknown too (infinities compare).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import without_nan

Rules = list[tuple[str, Column]]


def first_reason(rules: Rules, otherwise: str = "") -> Column:
    out = F.lit(otherwise)
    for reason, condition in reversed(rules):
        out = F.when(condition, F.lit(reason)).otherwise(out)
    return out


def failed_checks(checks: Rules) -> Column:
    """Names of all checks that aren't true, in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())


def semantic_gate(rows: DataFrame, max_occlusion: float = 0.5, min_mask_quality: float = 0.5, min_depth_coverage: float = 0.3) -> DataFrame:
    """Columns has_mask, mask_support, occlusion, mask_quality, track_stable, surface_valid, depth_coverage -> reason."""
    c, rows = F.col, without_nan(rows)
    return rows.withColumn(
        "reason",
        first_reason(
            [
                ("instance_mask_unavailable", ~c("has_mask")),
                ("mask_support_invalid", ~c("mask_support")),
                ("severe_object_occlusion", c("occlusion") > max_occlusion),
                ("insufficient_mask_quality", c("mask_quality") < min_mask_quality),
                ("unstable_track_identity", ~c("track_stable")),
                ("metric_object_surface_unavailable", ~c("surface_valid")),
                ("insufficient_valid_metric_depth_ratio", c("depth_coverage") < min_depth_coverage),
            ]
        ),
    )


def prior_gate(rows: DataFrame, min_depth_coverage: float = 0.3) -> DataFrame:
    """On top of ``reason``: columns category, has_prior, unsupported, minimum_observability, depth_coverage -> prior_reason."""
    c, rows = F.col, without_nan(rows)
    rule = first_reason(
        [
            ("PERSON_POSE_PROVIDER_MISSING", c("has_prior") & (c("category") == "person")),
            ("category_too_broad_without_subtype", ~c("has_prior") & c("unsupported")),
            ("missing_category_metric_prior", ~c("has_prior")),
        ],
        "",
    )
    late = F.when((c("reason") == "") & (c("depth_coverage") < F.greatest(F.lit(min_depth_coverage), c("minimum_observability"))), "insufficient_valid_metric_depth_ratio").otherwise(c("reason"))
    return rows.withColumn("prior_reason", F.when(rule != "", rule).otherwise(late))


#: Geometry modes.
GEOMETRY_MODES = ("static_camera_3d", "rotation_compensated", "full_se3_3d")


def reprojection_gate(rows: DataFrame) -> DataFrame:
    """Why a point can't be compared with its prediction, in order ('' if it can).

    Columns mode, same_point, same_track, previous_valid, current_valid, independent, generated, predicted (whether a motion prediction is
    there), predicted_finite, has_history_model, history (frames), newest_history, model_type, support (how many points), frame_index.
    A prediction must come from at least two earlier frames and a named model, unless it states nothing of the kind.
    """
    c = F.col
    stated = (c("model_type") != "") | (c("history") > 0) | (c("support") > 0)
    return rows.withColumn(
        "reason",
        first_reason(
            [
                ("dynamic_geometry_unavailable", c("mode") == "unavailable"),
                ("point_id_mismatch", ~c("same_point")),
                ("object_track_id_mismatch", ~c("same_track")),
                ("invalid_previous_3d_point", ~c("previous_valid")),
                ("missing_current_2d_observation", ~c("current_valid")),
                ("current_observation_not_independent", ~c("independent")),
                ("same_source_projection_loop", c("generated")),
                ("invalid_motion_prediction", c("predicted") & ~c("predicted_finite")),
                ("motion_prediction_without_history", c("predicted") & ~c("has_history_model")),
                ("insufficient_motion_history", c("predicted") & stated & (c("history") < 2)),
                ("motion_prediction_uses_current_frame", c("predicted") & stated & (c("newest_history") >= c("frame_index"))),
                ("missing_motion_model_type", c("predicted") & stated & (F.trim("model_type") == "")),
                ("unsupported_geometry_mode", ~c("predicted") & ~c("mode").isin(*GEOMETRY_MODES)),
            ]
        ),
    )


#: Joints that a person's height needs.
JOINTS = tuple(f"{side}_{joint}" for joint in ("shoulder", "hip", "knee", "ankle") for side in ("left", "right"))


def person_height(
    rows: DataFrame, detection: float = 0.30, keypoint: float = 0.35, mean: float = 0.45, margin: float = 0.01, tilt: float = 35.0, leg: float = 0.32, offset: float = 0.30, span: tuple[float, float] = (0.62, 1.20)
) -> DataFrame:
    """Whether a box shows a whole upright person, and if not why not (``applicability``), and the torso's tilt in degrees.

    Columns x1, y1, x2, y2, width, height, confidence, provider_ok, points (array of name, x, y, confidence, valid).
    """
    c, rows = F.col, without_nan(rows)
    seen = F.filter("points", lambda p: p["valid"] & (p["confidence"] >= keypoint))
    out = rows.withColumn("_seen", seen)
    joints = F.filter("points", lambda p: p["name"].isin(*JOINTS))
    total = F.aggregate(joints, F.lit(0.0), lambda a, p: a + p["confidence"])
    out = out.withColumn("_mean", F.when(F.size(joints) > 0, total / F.size(joints)).otherwise(F.lit(0.0)))
    for name in JOINTS:
        out = out.withColumn(f"_{name}", F.get(F.filter("_seen", _named(name)), F.lit(0)))
    there = lambda name: c(f"_{name}").isNotNull()
    middle = lambda part, x: F.coalesce((c(f"_left_{part}")[x] + c(f"_right_{part}")[x]) / 2, c(f"_left_{part}")[x], c(f"_right_{part}")[x])
    dx, dy = middle("hip", "x") - middle("shoulder", "x"), middle("hip", "y") - middle("shoulder", "y")
    out = out.withColumn("torso_tilt", F.when(F.sqrt(dx * dx + dy * dy) > 1e-8, F.degrees(F.atan2(F.abs(dx), F.abs(dy)))))
    w, h = c("x2") - c("x1"), c("y2") - c("y1")

    def standing(side: str) -> Column:
        hip, knee, ankle = (c(f"_{side}_{part}") for part in ("hip", "knee", "ankle"))
        return F.coalesce((hip["y"] < knee["y"]) & (knee["y"] < ankle["y"]) & ((ankle["y"] - hip["y"]) / h >= leg) & (F.abs(ankle["x"] - hip["x"]) / h <= offset), F.lit(False))

    edge = lambda size: F.greatest(F.lit(2.0), size * margin)
    touch = (c("x1") <= edge(c("width"))) | (c("y1") <= edge(c("height"))) | (c("x2") >= c("width") - edge(c("width"))) | (c("y2") >= c("height") - edge(c("height")))
    whole_leg = lambda side: there(f"{side}_hip") & there(f"{side}_knee") & there(f"{side}_ankle")
    enough = (there("left_shoulder") | there("right_shoulder")) & (whole_leg("left") | whole_leg("right"))
    ys = F.transform("_seen", lambda p: p["y"])
    reach = (F.array_max(ys) - F.array_min(ys)) / h
    rules = [
        ("unresolved_pose", ~F.coalesce((w > 0) & (h > 0) & (c("width") > 0) & (c("height") > 0), F.lit(False))),
        ("boundary_truncated", touch),
        ("insufficient_keypoints", ~c("provider_ok") | (F.size("points") < 1)),
        ("low_keypoint_confidence", c("_mean") < mean),
        ("insufficient_keypoints", ~enough),
        ("sitting_or_bending", ~F.coalesce(c("torso_tilt") <= tilt, F.lit(False)) | ~(standing("left") | standing("right"))),
        ("incomplete_body", ~F.coalesce(reach.between(*span), F.lit(False))),
    ]
    out = out.withColumn("applicability", first_reason(rules, "applicable_upright_full_body"))
    out = out.withColumn("applicable", (c("applicability") == "applicable_upright_full_body") & F.coalesce(c("confidence") >= detection, F.lit(False)))
    return out.drop("_seen", "_mean", *[f"_{n}" for n in JOINTS])


def _named(name: str):
    return lambda p: p["name"] == name


def physical_gate(rows: DataFrame, confidence: float = 0.3, min_side: float = 8.0, aspect: tuple[float, float] = (0.1, 10.0), margin_px: float = 2.0, margin_ratio: float = 0.005, area: tuple[float, float] = (0.0005, 0.9)) -> DataFrame:
    """All failed checks of a box, whether it passes, and the share of passed checks (no probability).

    Columns measured, confidence, depth, x1, y1, x2, y2, width, height, mask_area.
    """
    c, rows = F.col, without_nan(rows)
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    box = (w > 0) & (h > 0)
    mx, my = F.greatest(F.lit(margin_px), margin_ratio * c("width")), F.greatest(F.lit(margin_px), margin_ratio * c("height"))
    checks = [
        ("projected_measurement_valid", c("measured")),
        ("detection_confidence", c("confidence") >= confidence),
        ("valid_depth", c("depth") > 0),
        ("bbox_valid", box),
        ("minimum_bbox_dimensions", box & (w >= min_side) & (h >= min_side)),
        ("aspect_ratio_range", box & (w / F.when(box, h)).between(*aspect)),
        ("not_truncated_at_frame_boundary", box & (c("x1") > mx) & (c("y1") > my) & (c("x2") < c("width") - mx) & (c("y2") < c("height") - my)),
        ("projected_area_ratio", (c("mask_area") / (c("width") * c("height"))).between(*area)),
    ]
    out = rows.withColumn("failed", failed_checks(checks))
    return out.withColumn("passed", F.size("failed") == 0).withColumn("gate_score", (F.lit(len(checks)) - F.size("failed")) / F.lit(float(len(checks))))


def size_observability(rows: DataFrame) -> DataFrame:
    """Which of height, width, length and depth extent of an object can be measured.

    Columns truncated, out_of_frame, contacts (array), category, pose, occlusion, pointcloud.
    """
    c, rows = F.col, without_nan(rows)
    cut = c("truncated") | (c("out_of_frame") > 0.1)
    vertical = F.arrays_overlap("contacts", F.array(F.lit("top"), F.lit("bottom")))
    sideways = F.arrays_overlap("contacts", F.array(F.lit("left"), F.lit("right")))
    turned = c("pose").isin("oblique", "foreshortened", "unresolved")
    bent = (c("category") == "person") & c("pose").isin("sitting", "bending", "kneeling")
    return rows.withColumn("height_ok", ~cut & ~vertical & ~bent).withColumn("width_ok", ~cut & ~sideways & ~turned).withColumn("length_ok", ~cut & ~sideways & ~turned).withColumn("depth_ok", ~cut & (c("occlusion") <= 0.5) & c("pointcloud"))


def motion_regime(rows: DataFrame, points: int = 12, matches: int = 8, still: float = 0.5, still_p90: float = 1.0, homography: float = 0.65, essential: float = 0.5, parallax: float = 1.5) -> DataFrame:
    """Camera motion by eight ordered rules over background measurements.

    Columns scene_cut, candidates, background, matched, flow, flow_p90, homography, essential, parallax.
    """
    c, rows = F.col, without_nan(rows)
    rules = [
        ("scene_cut", c("scene_cut")),
        ("low_texture", c("candidates") < points),
        ("insufficient_background", c("background") < points),
        ("insufficient_background", c("matched") < matches),
        ("static_camera", (c("flow") <= still) & (c("flow_p90") <= still_p90)),
        ("rotation_dominant", (c("homography") >= homography) & (c("parallax").isNull() | (c("parallax") <= parallax) | (c("essential") < essential))),
        ("general_se3", c("essential") >= essential),
    ]
    out = rows.withColumn("regime", first_reason(rules, "degenerate_geometry"))
    return out.withColumn("regime_valid", F.col("regime").isin("static_camera", "rotation_dominant", "general_se3"))


MODES = ["static", "low_motion", "object_motion", "camera_motion", "mixed_motion", "motion_unreliable"]


def clip_observability(rows: DataFrame, least_quality: float = 0.5, still: float = 0.5, low: float = 1.5, camera: float = 2.0, objects: float = 2.0) -> DataFrame:
    """Columns provider_failed, scene_cut, quality, background_motion, object_motion (NULL unmeasured) -> mode."""
    c, rows = F.col, without_nan(rows)
    b, o = F.coalesce("background_motion", F.lit(0.0)), F.coalesce("object_motion", F.lit(0.0))
    both = c("background_motion").isNotNull() & c("object_motion").isNotNull()
    rules = [
        ("motion_unreliable", c("provider_failed") | c("scene_cut") | (c("quality") < least_quality) | (c("background_motion").isNull() & c("object_motion").isNull())),
        ("static", both & (b <= still) & (o <= still)),
        ("low_motion", (b <= low) & (o <= low)),
        ("object_motion", (b <= low) & (o >= objects)),
        ("camera_motion", (b >= camera) & (o < objects)),
        ("mixed_motion", (b >= camera) & (o >= objects)),
    ]
    return rows.withColumn("mode", first_reason(rules, "low_motion"))


def clip_geometry(rows: DataFrame, still: float = 1.5, rotation: float = 20.0) -> DataFrame:
    """Columns motion, tracked, inliers, aligned -> geometry and its quality; motion without support stays unavailable."""
    rows = without_nan(rows)
    clip = lambda n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(n)))
    t, i, a, m = clip("tracked"), clip("inliers"), clip("aligned"), F.col("motion")
    rules = [
        ("insufficient_sequence_depth_alignment", a < 0.6),
        ("insufficient_independent_point_tracking", (t < 0.5) | m.isNull()),
        ("static_camera_3d", m <= still),
        ("rotation_compensated", (m <= rotation) & (i >= 0.65)),
    ]
    out = rows.withColumn("geometry", first_reason(rules, "full_se3_not_observationally_supported"))
    quality = F.when(F.col("geometry") == "static_camera_3d", F.least(a, t, F.greatest(F.lit(0.0), 1 - m / still))).when(F.col("geometry") == "rotation_compensated", F.least(a, t, i)).otherwise(F.lit(0.0))
    return out.withColumn("geometry_quality", quality)


#: Branches that a clip without motion still offers, that need a pose, that need an event.
STATIC_BRANCHES = ["semantic_metric", "semantic_temporal", "static_depth", "static_boundary"]
POSE_BRANCHES = ["reprojection", "relation"]
EVENT_BRANCHES = ["occlusion"]


def route_branches(clips: DataFrame, branches: list[str]) -> DataFrame:
    """Status and reason of every branch of a clip. Columns mode, has_pose, event. The branches are a fixed handful."""
    rows = clips.withColumn("branch", F.explode(F.array(*[F.lit(b) for b in branches])))
    c, b = F.col, F.col("branch")
    moving = c("mode").isin("object_motion", "camera_motion", "mixed_motion")
    rules = [
        ("not_applicable_no_event", b.isin(EVENT_BRANCHES) & ~c("event")),
        ("dynamic_branch_not_applicable_to_static_or_low_motion", c("mode").isin("static", "low_motion") & ~b.isin(STATIC_BRANCHES)),
        ("motion_observability_unreliable", (c("mode") == "motion_unreliable") & ~b.isin(STATIC_BRANCHES)),
        ("pose_unavailable_for_pose_compensated_branch", moving & ~c("has_pose") & b.isin(POSE_BRANCHES)),
    ]
    out = rows.withColumn("route_reason", first_reason(rules))
    status = F.when(F.col("route_reason") == "", "enabled").when(F.col("route_reason").isin(rules[0][0], rules[1][0]), "not_applicable").otherwise("blocked_by_input")
    return out.withColumn("status", status)


def route_scale(objects: DataFrame, pairs: DataFrame, key: str, policy: str = "fallback_only") -> DataFrame:
    """The scale evidence of every object: metric, else temporal, else its best pair.

    Objects: key, metric, temporal (NULL: unavailable). Pairs: key, value, ord. Under
    ``fallback_only`` the pairs of objects that have better evidence leave before the
    pairs are ranked; ``disabled`` never looks at pairs; ``always`` also reports them for an audit.
    """
    if policy not in ("disabled", "fallback_only", "audit_only", "fallback_and_audit", "always"):
        raise ValueError(policy)
    need = objects.where("metric IS NULL AND temporal IS NULL").select(key) if policy == "fallback_only" else objects.select(key)
    pool = pairs.join(need, key, "left_semi") if policy != "disabled" else pairs.limit(0)
    best = pool.where("value IS NOT NULL").groupBy(key).agg(F.min_by("value", "ord").alias("pair"))
    out = objects.join(best, key, "left")
    use = F.col("metric").isNull() & F.col("temporal").isNull() & F.col("pair").isNotNull() & F.lit(policy in ("fallback_only", "fallback_and_audit", "always"))
    branch = F.when(F.col("metric").isNotNull(), "metric").when(F.col("temporal").isNotNull(), "temporal").when(use, "pair").otherwise("none")
    return out.withColumn("branch", branch).withColumn("scale", F.when(F.col("branch") == "metric", F.col("metric")).when(F.col("branch") == "temporal", F.col("temporal")).when(use, F.col("pair"))).withColumn("audited", F.col("pair").isNotNull() & (F.col("branch") != "pair"))


def validate_event(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Columns formal_mask, history, area_change, occluder, depth_order, scene_cut, quality -> failed, status."""
    c, rows = F.col, without_nan(rows)
    checks = [("formal_instance_mask", c("formal_mask")), ("history_prediction", c("history")), ("visible_area_change", c("area_change")), ("candidate_occluder", c("occluder")), ("depth_order", c("depth_order")), ("no_scene_cut", ~c("scene_cut")), ("tracking_quality", c("quality") >= least)]
    out = rows.withColumn("failed", failed_checks(checks))
    seen = F.arrays_overlap("failed", F.array(F.lit("formal_instance_mask"), F.lit("history_prediction"), F.lit("tracking_quality")))
    return out.withColumn("status", F.when(F.size("failed") == 0, "available").when(seen, "observation_missing").otherwise("not_applicable"))


def evidence_use(rows: DataFrame) -> DataFrame:
    """Whether a row may count for training, evaluation and quality control. Columns eligibility."""
    e = F.col("eligibility")
    return rows.withColumn("for_training", e == "eligible").withColumn("for_evaluation", e.isin("eligible", "partial")).withColumn("for_quality", e.isin("eligible", "partial", "provider_failure"))


def readiness(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """A joint gate over ratios: ``blocking`` are those below their limit."""
    rows = without_nan(rows)
    return rows.withColumn("blocking", failed_checks([(n, F.col(n) >= v) for n, v in limits.items()])).withColumn("ready", F.size("blocking") == 0)
