"""Queries for gates, pooling and lineage. Measurements derive from event_id: m(p) = (p * event_id mod 100) / 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.stats import array_median
from tessella.operators import evidence3d, fusion, gates, governance, lineage, pooling
from tessella.operators.branches import BRANCHES
from tessella.session import parts
from tessella.sources import records as sources

from .adapters import EV, RE, evidence, records, table
from .registry import odd, query, r


def _e(spark, sf):
    return table(spark, sf, "events")


def m(p):
    return (F.col("event_id") * p % 100) / 100.0


def s(p):
    return f"((event_id * {p}) % 100 / 100.0::DOUBLE)"


def mo(p):
    """As :func:`m`, with NaN and NULL in some rows."""
    return F.expr(odd(f"(event_id * {p} % 100) / 100.0D", f"(event_id + {p})", False, infinite=False))


def so(p):
    return f"({odd(s(p), f'(event_id + {p})', True, infinite=False)})"


def K():  # noqa: N802  a column needs a session, so none is made at import
    return F.col("event_id")


@query("semantic_gate", f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'instance_mask_unavailable' WHEN event_id % 13 = 0 THEN 'mask_support_invalid' WHEN {so(3)} > 0.5 THEN 'severe_object_occlusion'
  WHEN {so(7)} < 0.5 THEN 'insufficient_mask_quality' WHEN event_id % 17 = 0 THEN 'unstable_track_identity' WHEN event_id % 19 = 0 THEN 'metric_object_surface_unavailable' WHEN {so(11)} < 0.3 THEN 'insufficient_valid_metric_depth_ratio' ELSE '' END AS reason FROM events""")
def semantic_gate(spark, sf):
    return gates.semantic_gate(_gate_rows(spark, sf)).select("event_id", "reason")


def _gate_rows(spark, sf):
    return _e(spark, sf).select(
        "event_id", (K() % 11 != 0).alias("has_mask"), (K() % 13 != 0).alias("mask_support"), mo(3).alias("occlusion"), mo(7).alias("mask_quality"), (K() % 17 != 0).alias("track_stable"), (K() % 19 != 0).alias("surface_valid"), mo(11).alias("depth_coverage"),
        F.when(K() % 5 == 0, "person").otherwise("bottle").alias("category"), (K() % 4 != 0).alias("has_prior"), (K() % 8 == 0).alias("unsupported"), F.lit(0.6).alias("minimum_observability"),
    )


@query("prior_gate", f"""WITH g AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'instance_mask_unavailable' WHEN event_id % 13 = 0 THEN 'mask_support_invalid' WHEN {so(3)} > 0.5 THEN 'severe_object_occlusion'
  WHEN {so(7)} < 0.5 THEN 'insufficient_mask_quality' WHEN event_id % 17 = 0 THEN 'unstable_track_identity' WHEN event_id % 19 = 0 THEN 'metric_object_surface_unavailable' WHEN {so(11)} < 0.3 THEN 'insufficient_valid_metric_depth_ratio' ELSE '' END AS reason, {so(11)} AS c FROM events)
  SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 5 = 0 THEN 'PERSON_POSE_PROVIDER_MISSING' WHEN event_id % 8 = 0 THEN 'category_too_broad_without_subtype' WHEN event_id % 4 = 0 THEN 'missing_category_metric_prior'
    WHEN reason = '' AND c < 0.6 THEN 'insufficient_valid_metric_depth_ratio' ELSE reason END AS prior_reason FROM g""")
def prior_gate(spark, sf):
    return gates.prior_gate(gates.semantic_gate(_gate_rows(spark, sf))).select("event_id", "prior_reason")


#: The same expressions in both engines.
GATE = {
    "mode": "CASE event_id % 9 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'odd' WHEN 2 THEN 'rotation_compensated' WHEN 3 THEN 'full_se3_3d' ELSE 'static_camera_3d' END",
    "same_point": "event_id % 31 <> 0",
    "same_track": "event_id % 29 <> 0",
    "previous_valid": "event_id % 23 <> 0",
    "current_valid": "event_id % 19 <> 0",
    "independent": "event_id % 17 <> 0",
    "generated": "event_id % 37 = 0",
    "predicted": "event_id % 2 = 0",
    "predicted_finite": "event_id % 41 <> 0",
    "has_history_model": "event_id % 43 <> 0",
    "history": "CAST(event_id % 7 AS INT)",
    "newest_history": "CAST(event_id % 10 AS INT)",
    "model_type": "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE 'constant_velocity' END",
    "support": "CAST(event_id % 3 AS INT)",
    "frame_index": "CAST(event_id % 8 + 2 AS INT)",
    "background": "event_id % 4 = 1",
}
GATE_SQL = f"""WITH g AS (SELECT event_id, {', '.join(f'{x} AS {k}' for k, x in GATE.items())} FROM events), h AS (SELECT *, model_type <> '' OR history > 0 OR support > 0 AS stated FROM g),
 rr AS (SELECT *, CASE WHEN mode = 'unavailable' THEN 'dynamic_geometry_unavailable' WHEN NOT same_point THEN 'point_id_mismatch' WHEN NOT same_track THEN 'object_track_id_mismatch' WHEN NOT previous_valid THEN 'invalid_previous_3d_point' WHEN NOT current_valid THEN 'missing_current_2d_observation'
  WHEN NOT independent THEN 'current_observation_not_independent' WHEN generated THEN 'same_source_projection_loop' WHEN predicted THEN CASE WHEN NOT predicted_finite THEN 'invalid_motion_prediction' WHEN NOT has_history_model THEN 'motion_prediction_without_history'
   WHEN stated AND history < 2 THEN 'insufficient_motion_history' WHEN stated AND newest_history >= frame_index THEN 'motion_prediction_uses_current_frame' WHEN stated AND trim(model_type) = '' THEN 'missing_motion_model_type' ELSE '' END
  WHEN mode NOT IN ('static_camera_3d', 'rotation_compensated', 'full_se3_3d') THEN 'unsupported_geometry_mode' ELSE '' END AS reason FROM h)
"""


def _gated(spark, sf):
    return gates.reprojection_gate(_e(spark, sf).select("event_id", *[F.expr(x).alias(k) for k, x in GATE.items()]))


@query("reprojection_gate", GATE_SQL + "SELECT event_id, reason FROM rr")
def reprojection_gate(spark, sf):
    return _gated(spark, sf).select("event_id", "reason")


TURN = [0.0, -1.0, 0.0, 0.1, 1.0, 0.0, 0.0, -0.2, 0.0, 0.0, 1.0, 0.4, 0.0, 0.0, 0.0, 1.0]


@query("dynamic_reprojection", GATE_SQL + f""", v AS (SELECT *, {s(3)} - 0.5 AS x, {s(7)} - 0.5 AS y, {s(11)} * 2 - 0.3 AS z, {s(13)} - 0.5 AS mx, {s(17)} - 0.5 AS my, {s(19)} * 3 - 0.2 AS mz, {s(23)} * 32 AS su, {s(29)} * 32 AS sv, {s(31)} AS pq, {s(37)} AS tc FROM rr),
 p AS (SELECT *, CASE WHEN predicted THEN mx WHEN mode = 'static_camera_3d' THEN x WHEN mode = 'rotation_compensated' THEN -y ELSE -y + 0.1::DOUBLE END AS px, CASE WHEN predicted THEN my WHEN mode = 'static_camera_3d' THEN y WHEN mode = 'rotation_compensated' THEN x ELSE x - 0.2::DOUBLE END AS py, CASE WHEN predicted THEN mz WHEN mode = 'full_se3_3d' THEN z + 0.4::DOUBLE ELSE z END AS pz FROM v),
 q AS (SELECT *, CASE WHEN reason <> '' THEN reason WHEN pz <= 0 THEN 'predicted_point_not_projectable' ELSE '' END AS r2 FROM p), e AS (SELECT *, sqrt(pow(20 * px / pz + 16 - su, 2) + pow(20 * py / pz + 16 - sv, 2)) / sqrt(2048) AS err FROM q)
 SELECT event_id, CASE WHEN r2 <> '' THEN 'missing' WHEN predicted THEN 'dynamic_reprojection_residual' WHEN background THEN 'background_reprojection_quality' ELSE 'camera_compensated_motion_diagnostic' END AS evidence_type, {r("CASE WHEN r2 = '' THEN err END")} AS diagnostic, {r("CASE WHEN r2 = '' AND predicted THEN err END")} AS residual,
  {r("CASE WHEN r2 = '' THEN least(pq, tc) ELSE 0 END")} AS quality, CASE WHEN r2 <> '' THEN r2 WHEN predicted THEN '' WHEN background THEN 'background_reprojection_is_geometry_qa' ELSE 'foreground_motion_model_unavailable' END AS reason FROM e""")
def dynamic_reprojection(spark, sf):
    rows = _gated(spark, sf).select(
        "*", G.point(m(3) - 0.5, m(7) - 0.5, m(11) * 2 - 0.3).alias("previous"), G.point(m(13) - 0.5, m(17) - 0.5, m(19) * 3 - 0.2).alias("motion"), F.array(*[F.lit(x) for x in TURN]).alias("pose"), F.lit(20.0).alias("fx"), F.lit(20.0).alias("fy"), F.lit(16.0).alias("cx"), F.lit(16.0).alias("cy"),
        F.lit(32.0).alias("width"), F.lit(32.0).alias("height"), (m(23) * 32).alias("seen_u"), (m(29) * 32).alias("seen_v"), m(31).alias("previous_quality"), m(37).alias("tracking_confidence"),
    )
    return evidence3d.dynamic_reprojection(rows).select("event_id", "evidence_type", "diagnostic", "residual", "quality", "reason")


#: Height of every joint in a standing body, as a share of the box.
BODY = {"shoulder": 0.15, "hip": 0.5, "knee": 0.72, "ankle": 0.95}
PERSON = {"x1": "CAST(event_id % 60 AS DOUBLE)", "y1": "CAST(event_id % 21 + 1 AS DOUBLE)", "x2": "CAST(event_id % 60 + 20 + event_id % 30 AS DOUBLE)", "y2": "CAST(event_id % 21 + 40 + event_id % 41 AS DOUBLE)", "confidence": "CAST((event_id * 7) % 100 AS DOUBLE) / 100", "provider_ok": "event_id % 26 <> 0"}
JOINT = {
    name: {
        "x": f"x1 + (x2 - x1) * ({0.4 if name.startswith('left') else 0.6} + CAST((event_id * {i + 3}) % 17 - 8 AS DOUBLE) / {30 if name.endswith('shoulder') else 60})",
        "y": f"y1 + (y2 - y1) * (CASE WHEN event_id % 9 = 0 THEN 0.55 ELSE {BODY[name.split('_')[1]]} END + CAST((event_id * {i + 5}) % 13 - 6 AS DOUBLE) / 150)",
        "confidence": f"CAST((event_id * {2 * i + 3}) % 100 AS DOUBLE) / 125 + 0.2",
        "valid": f"(event_id + {i}) % 15 <> 0",
    }
    for i, name in enumerate(gates.JOINTS)
}


def _person_sql() -> str:
    points = ", ".join(f"{{'name': '{n}', 'x': ({j['x']})::DOUBLE, 'y': ({j['y']})::DOUBLE, 'c': ({j['confidence']})::DOUBLE, 'valid': {j['valid']}}}" for n, j in JOINT.items())
    pick = ", ".join(f"list_filter(seen, lambda p: p.name = '{n}')[1] AS {n}" for n in JOINT)
    mid = lambda part, x: f"coalesce((left_{part}.{x} + right_{part}.{x}) / 2, left_{part}.{x}, right_{part}.{x})"
    stand = lambda d: f"coalesce({d}_hip.y < {d}_knee.y AND {d}_knee.y < {d}_ankle.y AND ({d}_ankle.y - {d}_hip.y) / (y2 - y1) >= 0.32::DOUBLE AND abs({d}_ankle.x - {d}_hip.x) / (y2 - y1) <= 0.30::DOUBLE, false)"
    return f"""WITH b AS (SELECT event_id, {', '.join(f'{x} AS {k}' for k, x in PERSON.items())} FROM events), k AS (SELECT *, [{points}] AS pts FROM b), v AS (SELECT *, list_filter(pts, lambda p: p.valid AND p.c >= 0.35::DOUBLE) AS seen, list_sum(list_transform(pts, lambda p: p.c)) / 8 AS mc FROM k),
 j AS (SELECT *, {pick} FROM v), d AS (SELECT *, {mid('hip', 'x')} - {mid('shoulder', 'x')} AS dx, {mid('hip', 'y')} - {mid('shoulder', 'y')} AS dy FROM j), t AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-8 THEN degrees(atan2(abs(dx), abs(dy))) END AS tilt, (list_max(list_transform(seen, lambda p: p.y)) - list_min(list_transform(seen, lambda p: p.y))) / (y2 - y1) AS reach FROM d),
 a AS (SELECT *, CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'unresolved_pose' WHEN x1 <= 2 OR y1 <= 2 OR x2 >= 98 OR y2 >= 98 THEN 'boundary_truncated' WHEN NOT provider_ok THEN 'insufficient_keypoints' WHEN mc < 0.45::DOUBLE THEN 'low_keypoint_confidence'
  WHEN NOT ((left_shoulder IS NOT NULL OR right_shoulder IS NOT NULL) AND ((left_hip IS NOT NULL AND left_knee IS NOT NULL AND left_ankle IS NOT NULL) OR (right_hip IS NOT NULL AND right_knee IS NOT NULL AND right_ankle IS NOT NULL))) THEN 'insufficient_keypoints'
  WHEN NOT coalesce(tilt <= 35, false) OR NOT ({stand('left')} OR {stand('right')}) THEN 'sitting_or_bending' WHEN NOT coalesce(reach BETWEEN 0.62::DOUBLE AND 1.2::DOUBLE, false) THEN 'incomplete_body' ELSE 'applicable_upright_full_body' END AS applicability FROM t)
"""


@query("person_height_gate", _person_sql() + f"SELECT event_id, applicability, applicability = 'applicable_upright_full_body' AND confidence >= 0.3::DOUBLE AS applicable, {r('tilt')} AS torso_tilt FROM a")
def person_height_gate(spark, sf):
    rows = _e(spark, sf).select("event_id", *[F.expr(x).alias(k) for k, x in PERSON.items()])
    joint = lambda n, j: F.struct(F.lit(n).alias("name"), *[F.expr(f"CAST({j[x]} AS DOUBLE)").alias(x) for x in ("x", "y", "confidence")], F.expr(j["valid"]).alias("valid"))
    rows = rows.withColumn("points", F.array(*[joint(n, j) for n, j in JOINT.items()])).withColumn("width", F.lit(100.0)).withColumn("height", F.lit(100.0))
    return gates.person_height(rows).select("event_id", "applicability", "applicable", "torso_tilt")


PHYS = """WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber <> 5 AS measured, l_tax * 10 AS confidence, l_quantity - 3 AS depth, (l_partkey % 100)::DOUBLE AS x1, (l_suppkey % 50)::DOUBLE AS y1, (l_partkey % 100)::DOUBLE + l_quantity - 2 AS x2, (l_suppkey % 50)::DOUBLE + l_quantity / 2 AS y2, l_extendedprice / 10 AS mask_area FROM lineitem),
  c AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM b),
  f AS (SELECT l_orderkey, l_linenumber, [CASE WHEN NOT measured THEN 'projected_measurement_valid' END, CASE WHEN NOT confidence >= 0.3 THEN 'detection_confidence' END, CASE WHEN NOT depth > 0 THEN 'valid_depth' END, CASE WHEN NOT (w > 0 AND h > 0) THEN 'bbox_valid' END,
    CASE WHEN NOT (w > 0 AND h > 0 AND w >= 8 AND h >= 8) THEN 'minimum_bbox_dimensions' END, CASE WHEN NOT (w > 0 AND h > 0 AND w / h BETWEEN 0.1 AND 10) THEN 'aspect_ratio_range' END,
    CASE WHEN NOT (w > 0 AND h > 0 AND x1 > 2 AND y1 > 2 AND x2 < 158 AND y2 < 88) THEN 'not_truncated_at_frame_boundary' END, CASE WHEN NOT mask_area / 14400 BETWEEN 0.0005 AND 0.9 THEN 'projected_area_ratio' END] AS l FROM c)
"""


@query("physical_gate", PHYS + f"SELECT l_orderkey, l_linenumber, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') AS failed, len(list_filter(l, lambda x: x IS NOT NULL)) = 0 AS passed, {r('(8 - len(list_filter(l, lambda x: x IS NOT NULL))) / 8')} AS gate_score FROM f")
def physical_gate(spark, sf):
    q = F.col("l_quantity").cast("double")
    x1, y1 = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") != 5).alias("measured"), (F.col("l_tax") * 10).alias("confidence"), (q - 3).alias("depth"), x1.alias("x1"), y1.alias("y1"), (x1 + q - 2).alias("x2"), (y1 + q / 2).alias("y2"), F.lit(160.0).alias("width"), F.lit(90.0).alias("height"), (F.col("l_extendedprice") / 10).alias("mask_area"))
    return gates.physical_gate(rows).select("l_orderkey", "l_linenumber", F.array_join("failed", ",").alias("failed"), "passed", "gate_score")


@query("size_observability", f"""WITH x AS (SELECT *, event_id % 23 = 0 OR {so(3)} / 5 > 0.1 AS cut, event_id % 4 IN (0, 1) AS sideways, event_id % 4 IN (0, 2) AS vertical, event_id % 5 = 0 AS turned, event_id % 3 = 0 AND event_id % 7 = 1 AS bent FROM events)
  SELECT event_id, NOT cut AND NOT vertical AND NOT bent AS height_ok, NOT cut AND NOT sideways AND NOT turned AS width_ok, NOT cut AND NOT sideways AND NOT turned AS length_ok, NOT cut AND {so(7)} <= 0.5 AND event_id % 2 = 0 AS depth_ok FROM x""")
def size_observability(spark, sf):
    contacts = F.filter(F.array(F.when(K() % 4 <= 1, "left"), F.when((K() % 4).isin(0, 2), "top")), lambda x: x.isNotNull())
    pose = F.when(K() % 5 == 0, "oblique").when(K() % 7 == 1, "sitting").otherwise("upright")
    rows = _e(spark, sf).select("event_id", (K() % 23 == 0).alias("truncated"), (mo(3) / 5).alias("out_of_frame"), contacts.alias("contacts"), F.when(K() % 3 == 0, "person").otherwise("cup").alias("category"), pose.alias("pose"), mo(7).alias("occlusion"), (K() % 2 == 0).alias("pointcloud"), (K() % 5 != 0).alias("_p"))
    out = gates.size_observability(rows)
    # A pose column holds one value: an oblique person isn't also sitting.
    return out.select("event_id", (F.col("height_ok") & ~((K() % 5 == 0) & (K() % 3 == 0) & (K() % 7 == 1))).alias("height_ok"), "width_ok", "length_ok", "depth_ok")


@query("motion_regime", f"""SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'scene_cut' WHEN event_id % 60 < 12 THEN 'low_texture' WHEN event_id % 45 < 12 THEN 'insufficient_background' WHEN event_id % 30 < 8 THEN 'insufficient_background'
  WHEN {so(3)} <= 0.5 AND {so(7)} * 2 <= 1 THEN 'static_camera' WHEN {so(11)} >= 0.65 AND (event_id % 3 = 0 OR {so(13)} IS NULL OR {so(13)} * 3 <= 1.5 OR {so(17)} < 0.5) THEN 'rotation_dominant' WHEN {so(17)} >= 0.5 THEN 'general_se3' ELSE 'degenerate_geometry' END AS regime FROM events""")
def motion_regime(spark, sf):
    rows = _e(spark, sf).select("event_id", (K() % 41 == 0).alias("scene_cut"), (K() % 60).alias("candidates"), (K() % 45).alias("background"), (K() % 30).alias("matched"), mo(3).alias("flow"), (mo(7) * 2).alias("flow_p90"), mo(11).alias("homography"), mo(17).alias("essential"), F.when(K() % 3 != 0, mo(13) * 3).alias("parallax"))
    return gates.motion_regime(rows).select("event_id", "regime")


OBS = f"""WITH o AS (SELECT event_id, event_id % 37 = 0 AS pf, event_id % 41 = 0 AS cut, {so(3)} * 2 AS q, CASE WHEN event_id % 6 <> 0 THEN {so(7)} * 4 END AS b, CASE WHEN event_id % 9 <> 0 THEN {so(11)} * 4 END AS o FROM events),
  c AS (SELECT *, CASE WHEN pf OR cut OR q < 0.5 OR b IS NULL AND o IS NULL THEN 'motion_unreliable' WHEN b <= 0.5 AND o <= 0.5 THEN 'static' WHEN coalesce(b, 0) <= 1.5 AND coalesce(o, 0) <= 1.5 THEN 'low_motion'
    WHEN coalesce(b, 0) <= 1.5 AND coalesce(o, 0) >= 2 THEN 'object_motion' WHEN coalesce(b, 0) >= 2 AND coalesce(o, 0) < 2 THEN 'camera_motion' WHEN coalesce(b, 0) >= 2 AND coalesce(o, 0) >= 2 THEN 'mixed_motion' ELSE 'low_motion' END AS mode FROM o)
"""


def _modes(spark, sf):
    rows = _e(spark, sf).select("event_id", (K() % 37 == 0).alias("provider_failed"), (K() % 41 == 0).alias("scene_cut"), (mo(3) * 2).alias("quality"), F.when(K() % 6 != 0, mo(7) * 4).alias("background_motion"), F.when(K() % 9 != 0, mo(11) * 4).alias("object_motion"), (K() % 3 != 0).alias("has_pose"), (K() % 4 == 0).alias("event"))
    return gates.clip_observability(rows)


@query("clip_observability", OBS + "SELECT event_id, mode FROM c")
def clip_observability(spark, sf):
    return _modes(spark, sf).select("event_id", "mode")


@query("branch_routing", OBS + f""", r AS (SELECT event_id, branch, CASE WHEN branch = 'occlusion' AND event_id % 4 <> 0 THEN 'not_applicable_no_event'
    WHEN mode IN ('static', 'low_motion') AND branch NOT IN ('semantic_metric', 'semantic_temporal', 'static_depth', 'static_boundary') THEN 'dynamic_branch_not_applicable_to_static_or_low_motion'
    WHEN mode = 'motion_unreliable' AND branch NOT IN ('semantic_metric', 'semantic_temporal', 'static_depth', 'static_boundary') THEN 'motion_observability_unreliable'
    WHEN mode IN ('object_motion', 'camera_motion', 'mixed_motion') AND event_id % 3 = 0 AND branch IN ('reprojection', 'relation') THEN 'pose_unavailable_for_pose_compensated_branch' ELSE '' END AS route_reason
  FROM c, (SELECT unnest({BRANCHES!r}) AS branch))
  SELECT event_id, branch, route_reason, CASE WHEN route_reason = '' THEN 'enabled' WHEN route_reason IN ('not_applicable_no_event', 'dynamic_branch_not_applicable_to_static_or_low_motion') THEN 'not_applicable' ELSE 'blocked_by_input' END AS status FROM r""")
def branch_routing(spark, sf):
    return gates.route_branches(_modes(spark, sf), BRANCHES).select("event_id", "branch", "route_reason", "status")


@query("clip_geometry", f"""WITH g AS (SELECT event_id, {s(3)} * 30 AS mo, {s(7)} * 1.2 AS t, {s(11)} * 1.2 AS i, {s(13)} * 1.2 AS a FROM events), h AS (SELECT event_id, CASE WHEN event_id % 31 <> 0 THEN mo END AS mo, least(t, 1) AS t, least(i, 1) AS i, least(a, 1) AS a FROM g),
  c AS (SELECT *, CASE WHEN a < 0.6 THEN 'insufficient_sequence_depth_alignment' WHEN t < 0.5 OR mo IS NULL THEN 'insufficient_independent_point_tracking' WHEN mo <= 1.5 THEN 'static_camera_3d' WHEN mo <= 20 AND i >= 0.65 THEN 'rotation_compensated' ELSE 'full_se3_not_observationally_supported' END AS geometry FROM h)
  SELECT event_id, geometry, {r("CASE geometry WHEN 'static_camera_3d' THEN least(a, t, greatest(0, 1 - mo / 1.5)) WHEN 'rotation_compensated' THEN least(a, t, i) ELSE 0 END")} AS geometry_quality FROM c""")
def clip_geometry(spark, sf):
    rows = _e(spark, sf).select("event_id", F.when(K() % 31 != 0, m(3) * 30).alias("motion"), (m(7) * 1.2).alias("tracked"), (m(11) * 1.2).alias("inliers"), (m(13) * 1.2).alias("aligned"))
    return gates.clip_geometry(rows).select("event_id", "geometry", "geometry_quality")


@query("scale_router", f"""WITH o AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {s(3)} END AS me, CASE WHEN event_id % 4 = 0 THEN {s(7)} END AS te FROM events),
  p AS (SELECT event_id, min_by(v, k) AS pair FROM (SELECT event_id, CASE WHEN (event_id + k) % 3 <> 0 AND event_id % 5 <> 0 THEN {s(11)} + k END AS v, k FROM events, (SELECT unnest([0, 1, 2]) AS k)) WHERE v IS NOT NULL AND event_id % 3 <> 0 AND event_id % 4 <> 0 GROUP BY ALL)
  SELECT event_id, CASE WHEN me IS NOT NULL THEN 'metric' WHEN te IS NOT NULL THEN 'temporal' WHEN pair IS NOT NULL THEN 'pair' ELSE 'none' END AS branch, {r('coalesce(me, te, pair)')} AS scale FROM o LEFT JOIN p USING (event_id)""")
def scale_router(spark, sf):
    o = _e(spark, sf).select("event_id", F.when(K() % 3 == 0, m(3)).alias("metric"), F.when(K() % 4 == 0, m(7)).alias("temporal"))
    p = _e(spark, sf).select("event_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("ord")).withColumn("value", F.when(((K() + F.col("ord")) % 3 != 0) & (K() % 5 != 0), m(11) + F.col("ord")))
    return gates.route_scale(o, p, "event_id").select("event_id", "branch", "scale")


@query("event_validation", f"""WITH f AS (SELECT event_id, list_filter([CASE WHEN event_id % 7 = 0 THEN 'formal_instance_mask' END, CASE WHEN event_id % 5 = 0 THEN 'history_prediction' END, CASE WHEN event_id % 3 = 0 THEN 'visible_area_change' END, CASE WHEN event_id % 11 = 0 THEN 'candidate_occluder' END, CASE WHEN event_id % 4 = 0 THEN 'depth_order' END,
    CASE WHEN event_id % 41 = 0 THEN 'no_scene_cut' END, CASE WHEN {s(3)} < 0.5 THEN 'tracking_quality' END], lambda x: x IS NOT NULL) AS l FROM events)
  SELECT event_id, array_to_string(l, ',') AS failed, CASE WHEN len(l) = 0 THEN 'available' WHEN list_has_any(l, ['formal_instance_mask', 'history_prediction', 'tracking_quality']) THEN 'observation_missing' ELSE 'not_applicable' END AS status FROM f""")
def event_validation(spark, sf):
    rows = _e(spark, sf).select("event_id", (K() % 7 != 0).alias("formal_mask"), (K() % 5 != 0).alias("history"), (K() % 3 != 0).alias("area_change"), (K() % 11 != 0).alias("occluder"), (K() % 4 != 0).alias("depth_order"), (K() % 41 == 0).alias("scene_cut"), m(3).alias("quality"))
    return gates.validate_event(rows).select("event_id", F.array_join("failed", ",").alias("failed"), "status")


@query("evidence_use", "SELECT event_type, count(*) FILTER (event_id % 4 = 0) AS training, count(*) FILTER (event_id % 4 IN (0, 1)) AS evaluation, count(*) FILTER (event_id % 4 IN (0, 1, 2)) AS quality FROM events GROUP BY ALL")
def evidence_use(spark, sf):
    e = F.when(K() % 4 == 0, "eligible").when(K() % 4 == 1, "partial").when(K() % 4 == 2, "provider_failure").otherwise("excluded")
    out = gates.evidence_use(_e(spark, sf).withColumn("eligibility", e))
    return out.groupBy("event_type").agg(F.count_if("for_training").alias("training"), F.count_if("for_evaluation").alias("evaluation"), F.count_if("for_quality").alias("quality"))


@query("dynamic_readiness", f"SELECT event_id, concat_ws(',', CASE WHEN {s(3)} < 0.5 THEN 'valid_ratio' END, CASE WHEN {s(7)} < 0.4 THEN 'connected_ratio' END, CASE WHEN {s(11)} < 0.3 THEN 'coverage' END) AS blocking, {s(3)} >= 0.5 AND {s(7)} >= 0.4 AND {s(11)} >= 0.3 AS ready FROM events")
def dynamic_readiness(spark, sf):
    rows = _e(spark, sf).select("event_id", m(3).alias("valid_ratio"), m(7).alias("connected_ratio"), m(11).alias("coverage"))
    return gates.readiness(rows, {"valid_ratio": 0.5, "connected_ratio": 0.4, "coverage": 0.3}).select("event_id", F.array_join("blocking", ",").alias("blocking"), "ready")


# --- pooling ----------------------------------------------------------------------------------------


def _strict(all_):
    live = "count(*) FILTER (valid) > 0" + (" AND count(*) FILTER (NOT valid) = 0" if all_ else "")
    return EV + f"SELECT video_id, clip_id, {r(f'CASE WHEN {live} THEN avg(raw_value) FILTER (valid) END')} AS value, {r(f'CASE WHEN {live} THEN avg(confidence) FILTER (valid) ELSE 0 END')} AS quality, count(*) FILTER (valid) AS valid_rows, count(*) FILTER (NOT valid) AS invalid_rows, CASE WHEN {live} THEN '' ELSE " + ("coalesce(min_by(reason, ord) FILTER (NOT valid), 'no_valid_evidence')" if all_ else "'no_valid_evidence'") + " END AS reason FROM ev GROUP BY ALL"


def _rows(spark, sf):
    return evidence(spark, sf).select("video_id", "clip_id", F.col("raw_value").alias("value"), F.col("confidence").alias("quality"), "valid", "reason", "ord")


@query("strict_aggregate", _strict(True))
def strict_aggregate(spark, sf):
    return pooling.strict_aggregate(_rows(spark, sf), ["video_id", "clip_id"])


@query("lenient_aggregate", _strict(False))
def lenient_aggregate(spark, sf):
    return pooling.strict_aggregate(_rows(spark, sf), ["video_id", "clip_id"], require_all=False)


W6 = {"semantic_metric_prior": 0.2, "point_reprojection": 0.3, "relation": 0.5}


@query("weighted_fields", EV + f", x AS (SELECT video_id, clip_id, {', '.join(f'avg(normalized_value) FILTER (valid AND name = {n!r}) AS {n}' for n in W6)} FROM ev GROUP BY ALL) SELECT video_id, clip_id, {r('CASE WHEN ' + ' + '.join(f'({n} IS NOT NULL)::INT' for n in W6) + ' > 0 THEN ' + ' + '.join(f'coalesce({n}, 0) * {w}' for n, w in W6.items()) + ' END')} AS score, {' + '.join(f'({n} IS NOT NULL)::INT' for n in W6)} AS fields FROM x")
def weighted_fields(spark, sf):
    mat = fusion.channel_matrix(evidence(spark, sf)).select("video_id", "clip_id", *[F.col(f"{n}_value").alias(n) for n in W6])
    return pooling.weighted_fields(mat, ["video_id", "clip_id"], W6, require_all=False)


KINDS = ["object_relative_distance", "depth_order", "bearing_relation", "local_rigidity"]


@query("relation_distances", f"""WITH b AS (SELECT vec_id, list_extract({KINDS!r}, (vec_id % 4 + 1)::INT) AS kind, list_transform(embedding[1:3], lambda x: CASE WHEN vec_id % 4 = 0 THEN abs(x::DOUBLE) ELSE x::DOUBLE END) AS p, list_transform(embedding[4:6], lambda x: CASE WHEN vec_id % 4 = 0 THEN abs(x::DOUBLE) ELSE x::DOUBLE END) AS q FROM embeddings)
  SELECT vec_id, kind, {r('''CASE kind WHEN 'object_relative_distance' THEN CASE WHEN list_min(p) > 0 AND list_min(q) > 0 THEN list_avg([abs(ln((q[i] + 1e-9) / (p[i] + 1e-9))) for i in [1, 2, 3]]) END
    WHEN 'depth_order' THEN CASE WHEN list_min([abs(x) for x in p]) > 1e-9 AND list_min([abs(x) for x in q]) > 1e-9 THEN list_avg([(sign(p[i]) <> sign(q[i]))::INT::DOUBLE for i in [1, 2, 3]]) END
    WHEN 'bearing_relation' THEN acos(least(1, greatest(-1, list_dot_product(p, q) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(q, q)))))) / pi() ELSE list_avg([abs(q[i] - p[i]) for i in [1, 2, 3]]) END''')} AS distance FROM b""")
def relation_distances(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.col("vec_id")
    part = lambda a: F.transform(F.slice("embedding", a, 3), lambda x: F.when(v % 4 == 0, F.abs(x.cast("double"))).otherwise(x.cast("double")))
    rows = e.select("vec_id", F.element_at(F.array(*[F.lit(k) for k in KINDS]), (v % 4 + 1).cast("int")).alias("kind"), part(1).alias("before"), part(4).alias("after"))
    return pooling.relation_distance(rows).select("vec_id", "kind", "distance")


@query("reappearance_cues", f"""WITH x AS (SELECT event_id, {s(3)} - 0.1 AS pe, {s(7)} AS d0, {s(11)} + 0.1 AS d1, {s(13)} + 0.1 AS s0, {s(17)} + 0.1 AS s1, {s(19)} - 0.2 AS st, {s(23)} - 0.2 AS mo, event_id % 9 <> 0 AS sid, event_id % 4 <> 0 AS ev FROM events),
  y AS (SELECT *, CASE WHEN NOT ev THEN 'not_applicable_no_event' WHEN least(d0, d1) <= 0 THEN 'reappearance_measurement_unavailable' WHEN least(s0, s1) <= 0 THEN 'reappearance_physical_scale_unavailable' WHEN NOT sid THEN 'reappearance_identity_inconsistent' ELSE '' END AS reason FROM x)
  SELECT event_id, {r("CASE WHEN reason = '' THEN (greatest(0, pe) + abs(ln((d1 + 1e-9) / (d0 + 1e-9))) + abs(ln((s1 + 1e-9) / (s0 + 1e-9))) + greatest(0, st) + greatest(0, mo)) / 6 END")} AS residual, reason FROM y""")
def reappearance_cues(spark, sf):
    rows = _e(spark, sf).select("event_id", (m(3) - 0.1).alias("position_error"), m(7).alias("depth0"), (m(11) + 0.1).alias("depth1"), (m(13) + 0.1).alias("scale0"), (m(17) + 0.1).alias("scale1"), (m(19) - 0.2).alias("structure"), (m(23) - 0.2).alias("motion"), (K() % 9 != 0).alias("same_id"), (K() % 4 != 0).alias("event"))
    return pooling.reappearance_cues(rows).select("event_id", "residual", "reason")


@query("interval_union_distance", f"SELECT event_id, {r('least(greatest(ln(0.5) - ln(v), 0, ln(v) - ln(1.0)), greatest(ln(3.0) - ln(v), 0, ln(v) - ln(4.0)))')} AS distance FROM (SELECT event_id, value / 50 AS v FROM events WHERE value > 0)")
def interval_union_distance(spark, sf):
    two = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in ((0.5, 1.0), (3.0, 4.0))])
    rows = _e(spark, sf).where("value > 0").select("event_id", (F.col("value") / 50).alias("value"), two.alias("intervals"))
    return pooling.interval_union_distance(rows).select("event_id", "distance")


@query("mask_completeness", f"""WITH p AS (SELECT DISTINCT l_orderkey, (l_partkey % 12)::INT AS "row", (l_suppkey % 12)::INT AS col FROM lineitem), j AS (SELECT o_orderkey, "row", col FROM orders LEFT JOIN p ON l_orderkey = o_orderkey),
  a AS (SELECT o_orderkey, count(col) AS area, count(*) FILTER (col >= 2 AND col < 8 AND "row" >= 2 AND "row" < 9) AS inner_ FROM j GROUP BY ALL)
  SELECT o_orderkey, {r('inner_ / 42')} AS completeness, {r('CASE WHEN area > 0 THEN (area - inner_) / area END')} AS spill FROM a""")
def mask_completeness(spark, sf):
    pixels = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 12).cast("int").alias("row"), (F.col("l_suppkey") % 12).cast("int").alias("col")).distinct()
    boxes = table(spark, sf, "orders").select("o_orderkey", F.lit(2).alias("x1"), F.lit(2).alias("y1"), F.lit(8).alias("x2"), F.lit(9).alias("y2"))
    return pooling.mask_completeness(pixels, boxes, ["o_orderkey"])


@query("coefficient_of_variation", f"SELECT user_id, {r('stddev_pop(value) / avg(value)')} AS cv, count(*) AS rows FROM events WHERE value > 0 GROUP BY ALL")
def coefficient_of_variation(spark, sf):
    return pooling.variation(_e(spark, sf), ["user_id"], "value")


@query("mask_point_pooling", f"""WITH p AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS point_id, round_even(l_quantity / 3, 0)::INT AS col, round_even(l_linenumber / 2.0, 0)::INT AS "row", l_discount AS v FROM lineitem),
  i AS (SELECT * FROM p WHERE (col + "row") % 3 = 0 AND col BETWEEN 0 AND 17 AND "row" BETWEEN 0 AND 4), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY v DESC, point_id) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM i)
  SELECT l_suppkey, {r('avg(v)')} AS residual, max(n) AS points FROM k WHERE rn <= greatest(1, ceil(n * 0.25::DOUBLE)) GROUP BY ALL""")
def mask_point_pooling(spark, sf):
    line = table(spark, sf, "lineitem")
    points = line.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), (F.col("l_quantity") / 3).alias("u"), (F.col("l_linenumber") / 2).alias("v"), F.col("l_discount").alias("residual"))
    grid = F.explode(F.array(*[F.struct(F.lit(y).alias("row"), F.lit(x).alias("col")) for x in range(18) for y in range(5) if (x + y) % 3 == 0]))
    mask = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), grid.alias("g")).select("l_suppkey", "g.*")
    return pooling.pool_points(points, mask, ["l_suppkey"])


@query("coverage_targets", "WITH t AS (SELECT * FROM (VALUES ('view', 10, 5000), ('click', 100000, 200000), ('missing', 1, 2)) v(name, minimum, target)), c AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY ALL) SELECT name, coalesce(n, 0) AS n, greatest(target - coalesce(n, 0), 0) AS gap, coalesce(n, 0) >= minimum AS met FROM t LEFT JOIN c USING (name)")
def coverage_targets(spark, sf):
    targets = spark.createDataFrame([("view", 10, 5000), ("click", 100000, 200000), ("missing", 1, 2)], "name string, minimum long, target long")
    return pooling.coverage_targets(_e(spark, sf).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")), targets)


@query("scene_cut_statistics", "WITH f AS (SELECT conv_id, turn, turn % 3 = 0 AS cut, length(text) % 5 AS o, min(turn) OVER (PARTITION BY conv_id) AS f0 FROM conversations) SELECT conv_id, count(*) AS frames, count(*) FILTER (cut AND turn > f0) AS cuts, coalesce(sum(o) FILTER (cut AND turn > f0), 0)::BIGINT AS objects_at_cuts FROM f GROUP BY ALL")
def scene_cut_statistics(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("frame_index"), (F.col("turn") % 3 == 0).alias("cut"), (F.length("text") % 5).alias("objects"))
    return pooling.scene_cut_statistics(rows, "conv_id")


@query("sequence_statistics", EV + f""", c AS (SELECT video_id, clip_id FROM ev GROUP BY ALL), g AS (SELECT video_id, clip_id, channel FROM c, (SELECT unnest({fusion.CHANNELS!r}) AS channel)), a AS (SELECT video_id, clip_id, name AS channel, avg(normalized_value) AS v, avg(confidence) AS q FROM ev WHERE valid GROUP BY ALL)
  SELECT channel, count(*) AS cells, count(v) AS available, {r('count(v) / count(*)')} AS availability, {r('avg(coalesce(q, 0))')} AS confidence, {r('avg(v)')} AS value FROM g LEFT JOIN a USING (video_id, clip_id, channel) GROUP BY ALL""")
def sequence_statistics(spark, sf):
    return pooling.sequence_statistics(fusion.channel_matrix(evidence(spark, sf)), fusion.CHANNELS)


@query("funnel_counters", EV + "SELECT count(*) AS rows, count(*) FILTER (valid) AS valid, count(DISTINCT track_id) AS tracks, count(DISTINCT object_id) AS objects, count(*) FILTER (reason = 'provider_failed') AS reason_provider_failed, count(*) FILTER (reason = 'scene_cut') AS reason_scene_cut FROM ev")
def funnel_counters(spark, sf):
    return pooling.funnel(evidence(spark, sf), ["provider_failed", "scene_cut"])


SUP = "WITH su AS (SELECT DISTINCT l_orderkey, l_linenumber AS o, ((l_partkey + k) % 40)::INT AS px, l_quantity AS depth FROM lineitem, (SELECT unnest(range(0, 6)) AS k))"


@query("occlusion_graph", SUP + " SELECT a.l_orderkey, a.o AS front, b.o AS back, count(*) AS overlap, min(a.depth) AS front_depth, min(b.depth) AS back_depth FROM su a JOIN su b ON a.l_orderkey = b.l_orderkey AND a.px = b.px AND (a.depth < b.depth OR a.depth = b.depth AND a.o < b.o) GROUP BY ALL")
def occlusion_graph(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("object_id"), F.col("l_quantity").alias("depth"), "l_partkey")
    line = line.repartition(parts(spark, line.count(), 100_000), "l_orderkey")  # before the lines become pixels
    rows = line.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    rows = rows.select("l_orderkey", "object_id", ((F.col("l_partkey") + F.col("k")) % 40).cast("int").alias("pixel"), "depth").distinct()
    return pooling.occlusion_pairs(rows, ["l_orderkey"])


@query("boundary_chamfer", f"""WITH l AS (SELECT l_orderkey AS k, (l_partkey % 30)::DOUBLE AS x, (l_suppkey % 20)::DOUBLE AS y FROM lineitem), q AS (SELECT l_orderkey AS k, (l_partkey % 29)::DOUBLE AS x, (l_suppkey % 19)::DOUBLE AS y FROM lineitem),
  p AS (SELECT l.k, l.x AS x0, l.y AS y0, q.x AS x1, q.y AS y1, sqrt(pow(l.x - q.x, 2) + pow(l.y - q.y, 2)) AS d FROM l JOIN q USING (k)),
  a AS (SELECT k, avg(d) AS a FROM (SELECT k, x0, y0, min(d) AS d FROM p GROUP BY ALL) GROUP BY ALL), b AS (SELECT k, avg(d) AS b FROM (SELECT k, x1, y1, min(d) AS d FROM p GROUP BY ALL) GROUP BY ALL)
  SELECT k, {r('(a + b) / 2 / 36')} AS distance FROM a JOIN b USING (k)""")
def boundary_chamfer(spark, sf):
    line = table(spark, sf, "lineitem")
    side = lambda a, b: line.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % a).cast("double").alias("x"), (F.col("l_suppkey") % b).cast("double").alias("y"))
    return pooling.chamfer(side(30, 20), side(29, 19), ["k"], 36.0)


@query("metric_size", f"SELECT p_partkey, {r('z')} AS size, {r('greatest(ln(lo) - ln(z), 0, ln(z) - ln(hi))')} AS residual FROM (SELECT p_partkey, p_size * (p_retailprice / 1000) / 20 AS z, 0.5::DOUBLE AS lo, 1.5::DOUBLE AS hi FROM part)")
def metric_size(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("pixels"), (F.col("p_retailprice") / 1000).alias("depth"), F.lit(20.0).alias("focal"), F.lit(0.5).alias("low"), F.lit(1.5).alias("high"))
    return pooling.metric_size(rows).select("p_partkey", "size", "residual")


HEAT = EV + """, h AS (SELECT video_id, clip_no AS frame, round_even(row_idx / 2, 0)::INT AS "row", round_even(raw_value * 3, 0)::INT AS col, max(normalized_value) AS value FROM ev WHERE valid GROUP BY ALL),
 k AS (SELECT i, j, exp(-(i * i + j * j) / 2.0::DOUBLE) AS w FROM range(-2, 3) a(i), range(-2, 3) b(j)), kn AS (SELECT i, j, w / (SELECT sum(w) FROM k) AS w FROM k),
 s AS (SELECT video_id, frame, "row" + i AS "row", col + j AS col, sum(value * w) AS value FROM h, kn GROUP BY ALL)
"""


@query("heatmap_smooth", HEAT + f"SELECT video_id, frame, \"row\"::INT AS \"row\", col::INT AS col, {r('CASE WHEN max(value) OVER w > 0 THEN value / max(value) OVER w ELSE 0 END')} AS value FROM s WINDOW w AS (PARTITION BY video_id, frame)")
def heatmap_smooth(spark, sf):
    e = evidence(spark, sf).where("valid")
    heat = fusion.heatmap(e.select("video_id", F.col("clip_no").alias("frame"), (F.col("raw_value") * 3).alias("x"), (F.col("row_idx") / 2).alias("y"), F.col("normalized_value").alias("value")))
    return pooling.smooth_heatmap(heat)


@query("frame_depth_reference", EV + f"SELECT video_id, clip_no AS frame, {r('coalesce(median(raw_value) FILTER (valid AND raw_value > 2), median(raw_value) FILTER (valid))')} AS reference FROM ev GROUP BY ALL")
def frame_depth_reference(spark, sf):
    e = evidence(spark, sf)
    return e.groupBy("video_id", F.col("clip_no").alias("frame")).agg(F.coalesce(F.median(F.when(F.col("valid") & (F.col("raw_value") > 2), F.col("raw_value"))), F.median(F.when(F.col("valid"), F.col("raw_value")))).alias("reference"))


@query("array_medians", f"SELECT vec_id, {r('list_median(list_transform(embedding[1:7], lambda x: x::DOUBLE))')} AS median FROM embeddings")
def array_medians(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", array_median(F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double"))).alias("median"))


# --- lineage -----------------------------------------------------------------------------------------

#: Stage and what it needs.
#: A part's size is a stage that needs half and a third of it.
ST = """WITH RECURSIVE e AS (SELECT DISTINCT 's' || p_size AS stage, 's' || (p_size // 2) AS needs FROM part WHERE p_size >= 2 UNION SELECT DISTINCT 's' || p_size, 's' || (p_size // 3) FROM part WHERE p_size >= 3),
 c(stage, ancestor) AS (SELECT * FROM e UNION SELECT c.stage, e.needs FROM c JOIN e ON c.ancestor = e.stage)"""


def _stage_edges(spark, sf):
    n = F.col("p_size")
    name = lambda x: F.concat(F.lit("s"), x.cast("int").cast("string"))
    of = lambda k: table(spark, sf, "part").where(n >= k).select(name(n).alias("stage"), name(F.floor(n / k)).alias("needs"))
    return of(2).unionByName(of(3)).distinct()


@query("stage_closure", ST + " SELECT * FROM c")
def stage_closure(spark, sf):
    return lineage.closure(_stage_edges(spark, sf))


@query("stage_descendants", ST + " SELECT stage FROM c WHERE ancestor = 's5'")
def stage_descendants(spark, sf):
    return lineage.descendants(_stage_edges(spark, sf), "s5")


@query("stage_plan", ST + ", w AS (SELECT max_by(stage, length(stage) * 1000 + substr(stage, 2)::INT) AS w FROM e), n AS (SELECT ancestor AS stage FROM c, w WHERE stage = w UNION SELECT w FROM w) SELECT n.stage, count(c.ancestor) AS position FROM n LEFT JOIN c USING (stage) GROUP BY ALL")
def stage_plan(spark, sf):
    """What the greatest stage needs."""
    edges = _stage_edges(spark, sf)
    greatest = edges.agg(F.max(F.struct(F.length("stage"), "stage")).alias("m")).first()["m"]
    return lineage.execution_plan(edges, edges.select("stage").distinct(), greatest["stage"] if greatest else "")


@query("protocol_leakage", RE + ", a AS (SELECT 'group_id' AS finding, group_id::VARCHAR AS value, split FROM re UNION ALL SELECT 'content_hash', content_hash, split FROM re) SELECT finding, value, count(DISTINCT split) AS splits, string_agg(DISTINCT split, ',' ORDER BY split) AS in_splits FROM a GROUP BY ALL HAVING count(DISTINCT split) > 1")
def protocol_leakage(spark, sf):
    return lineage.protocol_leakage(records(spark, sf), ["group_id", "content_hash"])


@query("eligibility_matrix", EV + f", g AS (SELECT DISTINCT video_id AS entity_id, b AS branch FROM ev, (SELECT unnest({BRANCHES!r}) AS b)), a AS (SELECT video_id AS entity_id, branch, count(*) AS rows, count(*) FILTER (valid) AS valid_rows FROM ev GROUP BY ALL) SELECT entity_id, branch, coalesce(rows, 0) AS rows, coalesce(valid_rows, 0) AS valid_rows, CASE WHEN coalesce(rows, 0) = 0 THEN 'no_observation' WHEN valid_rows < 1 THEN 'no_valid_evidence' ELSE 'eligible' END AS status FROM g LEFT JOIN a USING (entity_id, branch)")
def eligibility_matrix(spark, sf):
    e = evidence(spark, sf)
    rows = e.select(F.col("video_id").alias("entity_id"), "branch", "valid", "reason")
    return lineage.eligibility_matrix(e.select(F.col("video_id").alias("entity_id")).distinct(), rows, BRANCHES)


@query("inventory_join", """SELECT d.doc_id AS video_id, coalesce(l.toxic, CASE WHEN d.doc_id % 7 = 0 THEN 1 END)::INT AS label, CASE WHEN c.conv_id IS NOT NULL THEN c.conv_id::VARCHAR ELSE 'video:' || d.doc_id END AS group_id, CASE WHEN l.toxic IS NOT NULL THEN 'labels' WHEN d.doc_id % 7 = 0 THEN 'provenance' ELSE 'unknown' END AS label_source
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = d.doc_id""")
def inventory_join(spark, sf):
    videos = table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.when(F.col("doc_id") % 7 == 0, 1).alias("provenance_label"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("video_id"), F.col("toxic").cast("int").alias("label"))
    groups = table(spark, sf, "conversations").select(F.col("conv_id").alias("video_id"), F.col("conv_id").alias("group_id")).distinct()
    return lineage.inventory(videos, labels, groups)


@query("path_relocation", "WITH m AS (SELECT url, min(page_id) AS p FROM pages GROUP BY ALL) SELECT page_id, CASE WHEN p % 3 = 0 THEN '/data/' || p ELSE pages.url END AS url, pages.url AS original_url FROM pages JOIN m ON pages.url = m.url")
def path_relocation(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    # A mapping has one row for each original path.
    mapping = pages.groupBy(F.col("url").alias("original")).agg(F.min("page_id").alias("p")).select("original", F.when(F.col("p") % 3 == 0, F.concat(F.lit("/data/"), F.col("p").cast("string"))).alias("relocated"))
    return lineage.relocate(pages, mapping, "url").select("page_id", "url", "original_url")


@query("exclusion_summary", RE + ", x AS (SELECT unnest([CASE WHEN label IS NULL THEN 'unknown_label' END, CASE WHEN split = 'test' THEN 'held_out' END, CASE WHEN size < 50000 THEN 'too_small' END]) AS reason FROM re) SELECT reason, count(*) AS rows FROM x WHERE reason IS NOT NULL GROUP BY ALL")
def exclusion_summary(spark, sf):
    rules = {"unknown_label": F.col("label").isNull(), "held_out": F.col("split") == "test", "too_small": F.col("size") < 50000}
    return lineage.exclusion_summary(governance.exclusion_reasons(records(spark, sf), rules))


@query("availability_summary", f"WITH x AS (SELECT 'mask' AS modality, event_id % 3 AS n FROM events UNION ALL SELECT 'depth', event_id % 4 FROM events) SELECT modality, count(*) AS samples, count(*) FILTER (n > 0) AS available, {r('count(*) FILTER (n > 0) / count(*)')} AS ratio, sum(n)::BIGINT AS observations FROM x GROUP BY ALL")
def availability_summary(spark, sf):
    return lineage.availability_summary(_e(spark, sf).select((K() % 3).alias("mask"), (K() % 4).alias("depth")), ["mask", "depth"])


@query("pose_candidates", EV + ", f AS (SELECT video_id, row_idx, row_idx // 10 AS s FROM ev) SELECT a.video_id, a.row_idx AS source, b.row_idx AS target FROM f a JOIN f b ON a.video_id = b.video_id AND a.s = b.s AND b.row_idx - a.row_idx IN (1, 2, 4)")
def pose_candidates(spark, sf):
    return lineage.pose_candidates(evidence(spark, sf).select("video_id", F.col("row_idx").alias("frame_index"), F.floor(F.col("row_idx") / 10).alias("scene")))


@query("pose_graph")
def pose_graph(spark, sf):
    frames = evidence(spark, sf).select("video_id", F.col("row_idx").alias("frame_index"), F.lit(0).alias("scene"))
    edges = lineage.pose_candidates(frames).withColumn("quality", F.pmod(F.xxhash64("video_id", "source", "target"), F.lit(100)) / 100.0)
    return lineage.pose_graph(edges)


@query("endpoint_chains")
def endpoint_chains(spark, sf):
    seg = _e(spark, sf).select(F.col("user_id").alias("video_id"), (K() % 12).cast("int").alias("frame_index"), m(3).alias("u0"), m(7).alias("v0")).dropDuplicates(["video_id", "frame_index", "u0", "v0"])
    seg = seg.select("video_id", "frame_index", (F.col("u0") * 20).alias("u0"), (F.col("v0") * 20).alias("v0"), (F.col("u0") * 20 + 0.5).alias("u1"), (F.col("v0") * 20).alias("v1"))
    return lineage.link_endpoints(seg)


@query("prior_resolution", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 2.94::DOUBLE WHEN p_size % 3 = 1 THEN 1.5::DOUBLE END AS min_m, CASE WHEN p_size % 3 = 2 THEN 'missing_category' ELSE '' END AS prior_reason FROM part")
def prior_resolution(spark, sf):
    priors = spark.createDataFrame([("car", ["automobile"], 2.94, 4.92, "d1"), ("person", ["human"], 1.5, 1.99, "d2"), ("bottle", [], 0.137, 0.339, "d3")], "class_name string, aliases array<string>, min_m double, max_m double, derivation_id string")
    approved = spark.createDataFrame([("d1", "approved"), ("d2", "approved"), ("d3", "draft")], "derivation_id string, review_status string")
    objects = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "car").when(F.col("p_size") % 3 == 1, "human").otherwise("bottle").alias("label"))
    return sources.resolve_priors(objects, sources.load_priors(priors, approved)).select("p_partkey", "min_m", "prior_reason")
