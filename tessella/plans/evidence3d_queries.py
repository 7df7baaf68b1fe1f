"""Queries over scale histories, boundary depth, directions, supports, intersections, clip summaries and depth alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import alignment, evidence3d, pooling, relations, residuals

from .adapters import EV, OB, TR, evidence, objects, table, tracks
from .registry import odd, query, r

# --- scale -----------------------------------------------------------------------------------------

_SCALE = {
    "dimension": "CASE WHEN ord % 2 = 0 THEN 'height' ELSE 'width' END",
    "size": "CASE WHEN valid THEN raw_value + 0.5 END",
    "mode": "CASE WHEN row_idx > 55 AND ord % 9 = 0 THEN 'relative_local' ELSE 'metric' END",
    "unit": "CASE WHEN row_idx > 55 AND ord % 9 = 0 THEN 'relative_local_unit' ELSE 'meter' END",
    "provider": "CASE WHEN row_idx > 48 AND ord % 23 = 0 THEN 'p2' ELSE 'p1' END",
    "definition": "CASE WHEN row_idx > 52 AND ord % 29 = 0 THEN 'ray' ELSE 'z' END",
    "intrinsics": "CASE WHEN row_idx > 50 AND ord % 31 = 0 THEN 'k2' ELSE 'k1' END",
    "quality": "CAST((ord * 7) % 100 AS DOUBLE) / 100",
    "observable": "valid",
    "observable_reason": "reason",
    "provider_status": "CASE WHEN ord % 37 = 0 THEN 'provider_failed' WHEN ord % 41 = 0 THEN 'blocked' ELSE 'ok' END",
    "scene_cut": "ord % 43 = 0",
    "continuity": "CASE WHEN ord % 47 = 0 THEN 'interrupted' ELSE 'continuous' END",
    "truncated": "ord % 53 = 0",
    "out_of_frame": "ord % 59 = 0",
    "occlusion": "CASE WHEN ord % 19 = 0 THEN 'heavy_occlusion' ELSE 'none' END",
    "pose": "CASE WHEN ord % 61 = 0 THEN 'changed' ELSE 'stable' END",
    "mask_stable": "ord % 67 <> 0",
    "alignment": "CASE WHEN ord % 4 = 0 THEN 'aligned' ELSE 'unknown' END",
}


def _scale(sql):
    """Sizes and qualities are NaN, infinite or NULL in some rows."""
    return _SCALE | {"size": odd(_SCALE["size"], "(ord + 1)", sql), "quality": odd(_SCALE["quality"], "(ord + 2)", sql)}


SCALE = EV + f""", s AS (SELECT video_id, track_id, row_idx AS frame_index, {', '.join(f'{x} AS {k}' for k, x in _scale(True).items())} FROM ev WHERE track_id IS NOT NULL),
 u AS (SELECT *, coalesce(observable AND size IS NOT NULL AND provider_status = 'ok' AND quality >= 0.05 AND NOT truncated AND NOT out_of_frame AND mask_stable AND occlusion <> 'heavy_occlusion' AND NOT scene_cut, false) AS usable FROM s),
 h AS (SELECT *, list({{'f': frame_index, 's': size, 'q': quality, 'u': usable, 'm': mode || unit, 'p': provider, 'd': definition, 'k': intrinsics}}) OVER (PARTITION BY video_id, track_id, dimension ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS al FROM u),
 b AS (SELECT *, list_filter(coalesce(al, []), lambda x: x.m <> mode || unit OR x.p <> provider OR x.d <> definition OR x.k <> intrinsics)[1] AS bad, list_filter(coalesce(al, []), lambda x: x.u) AS good FROM h),
 l AS (SELECT *, good[greatest(1, len(good) - 4):] AS last FROM b),
 m AS (SELECT *, list_median(list_transform(last, lambda x: x.s)) AS ref, CASE WHEN NOT observable OR size IS NULL THEN reason0 WHEN provider_status = 'provider_failed' THEN 'scale_provider_failed' WHEN provider_status <> 'ok' THEN 'scale_provider_not_ready' WHEN quality IS NULL OR quality < 0.05 THEN 'current_scale_quality_below_threshold'
   WHEN scene_cut THEN 'scene_cut_boundary' WHEN continuity <> 'continuous' THEN 'track_interruption_or_id_switch' WHEN truncated OR out_of_frame THEN 'current_object_truncated_or_out_of_frame' WHEN occlusion = 'heavy_occlusion' THEN 'current_object_occluded'
   WHEN pose <> 'stable' THEN 'object_pose_change_not_compatible' WHEN NOT mask_stable THEN 'unstable_object_mask' WHEN mode = 'relative_local' AND alignment <> 'aligned' THEN 'relative_depth_scale_not_locally_aligned'
   WHEN bad IS NOT NULL THEN CASE WHEN bad.m <> mode || unit THEN 'scale_domain_or_unit_changed' WHEN bad.p <> provider THEN 'depth_provider_changed' WHEN bad.d <> definition THEN 'depth_definition_changed' ELSE 'camera_intrinsics_changed' END
   WHEN len(good) > 0 AND frame_index - last[-1].f > 20 THEN 'track_history_frame_gap_too_large' WHEN len(good) < 2 THEN 'insufficient_valid_scale_history' ELSE '' END AS reason FROM (SELECT *, coalesce(nullif(observable_reason, ''), 'dimension_not_observable') AS reason0 FROM l))
"""


@query("temporal_scale", SCALE + f"SELECT video_id, track_id, frame_index, reason, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN abs(ln(size) - ln(ref)) END')} AS residual, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN least(quality, list_median(list_transform(last, lambda x: x.q))) ELSE 0 END')} AS confidence, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN list_median(list_transform(last, lambda x: abs(ln(x.s) - ln(ref)))) END')} AS uncertainty, CASE WHEN reason = '' THEN len(good) END AS history FROM m")
def temporal_scale(spark, sf):
    rows = evidence(spark, sf).where("track_id IS NOT NULL").select("video_id", "track_id", F.col("row_idx").alias("frame_index"), *[F.expr(x).alias(k) for k, x in _scale(False).items()])
    out = evidence3d.temporal_scale(rows, ["video_id", "track_id"], max_gap=20, min_quality=0.05)
    return out.select("video_id", "track_id", "frame_index", "reason", "residual", "confidence", "uncertainty", "history")


_ALIGNED = {
    "label": "CASE object_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'cup' ELSE 'car' END",
    "d": "CASE WHEN (frame_id + object_id) % 13 = 0 THEN NULL WHEN (frame_id + object_id) % 17 = 0 THEN -depth ELSE depth END",
    "measured_valid": "(frame_id * 3 + object_id) % 11 <> 0",
    "gate_passed": "(frame_id * 5 + object_id) % 7 <> 0",
    "prior_status": "CASE (frame_id + 3 * object_id) % 12 WHEN 0 THEN NULL WHEN 1 THEN 'pose_sensitive' WHEN 2 THEN 'insufficient_source' WHEN 3 THEN 'conditional' ELSE 'strict_high' END",
    "prior_available": "(frame_id + object_id) % 19 <> 0",
    "grp": "CASE WHEN (frame_id * 7 + object_id) % 5 = 0 THEN 'horizontal' ELSE 'vertical' END",
    "applicability_reason": "CASE (frame_id * 11 + object_id) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'boundary' ELSE '' END",
}


def _aligned_skip() -> str:
    sides = lambda rule: " ".join(rule.replace("#", s) for s in "ab")
    prior = "WHEN #.prior_status IS NULL THEN 'missing_prior_#' WHEN #.prior_status = 'pose_sensitive' THEN 'pose_sensitive_prior_#' WHEN #.prior_status = 'insufficient_source' OR NOT #.prior_available THEN 'unsupported_prior_#'"
    person = "WHEN #.label = 'person' AND coalesce(#.applicability_reason, 'person_insufficient_keypoints') <> '' THEN coalesce(#.applicability_reason, 'person_insufficient_keypoints')"
    cup = "WHEN #.label = 'cup' AND coalesce(#.applicability_reason, 'cup_measurement_not_applicable') <> '' THEN coalesce(#.applicability_reason, 'cup_measurement_not_applicable')"
    return "CASE " + sides("WHEN #.d IS NULL OR #.d <= 0 THEN 'invalid_depth_#'") + " " + sides(prior) + " " + sides("WHEN NOT #.measured_valid THEN 'invalid_projected_measurement_#'") + " WHEN a.grp <> b.grp THEN 'incompatible_projected_dimensions' " + sides("WHEN NOT #.gate_passed THEN 'observation_gate_failed_#'") + " " + sides(person) + " " + sides(cup) + " ELSE '' END"


@query("rsd_aligned", OB + f""", oa AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in _ALIGNED.items())} FROM ob),
 p AS (SELECT a.frame_id, a.object_id AS object_a, b.object_id AS object_b, {_aligned_skip()} AS reason, CASE WHEN a.d > 0 AND b.d > 0 THEN a.d / b.d END AS depth_ratio, a.low / b.high * (b.projected / a.projected) AS low, a.high / b.low * (b.projected / a.projected) AS high, a.prior_status = 'strict_high' AND b.prior_status = 'strict_high' AS strict FROM oa a JOIN oa b ON a.frame_id = b.frame_id AND a.object_id < b.object_id)
 SELECT frame_id, object_a, object_b, {r('depth_ratio')} AS depth_ratio, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN low END')} AS low, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN high END')} AS high, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN greatest(low - depth_ratio, 0, depth_ratio - high) END')} AS rsd_ratio,
  {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN greatest(ln(low) - ln(depth_ratio), 0, ln(depth_ratio) - ln(high)) END')} AS rsd_log, CASE WHEN reason = '' THEN CASE WHEN strict THEN 'strict_high' ELSE 'conditional_physical' END END AS tier, reason FROM p""")
def rsd_aligned(spark, sf):
    o = objects(spark, sf).select("*", *[F.expr(x).alias(k) for k, x in _ALIGNED.items()])
    o = o.drop("depth").withColumnRenamed("d", "depth").withColumnRenamed("grp", "group").withColumnRenamed("projected", "measured")
    return evidence3d.aligned_scale_depth(o, "frame_id", applicability=True)


# --- boundaries ------------------------------------------------------------------------------------

SIDE = 24
MASK = f"""WITH m AS (SELECT DISTINCT l_suppkey AS object_id, (l_partkey % {SIDE})::INT AS "row", (l_orderkey % {SIDE})::INT AS col FROM lineitem WHERE l_partkey % {SIDE} > 1),
 dz AS (SELECT s AS object_id, a::INT AS "row", b::INT AS col, CASE WHEN (a + b) % 11 <> 0 THEN ((a * 7 + b * 13 + s) % 50) / 10.0::DOUBLE + 0.5 END AS z FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem), range({SIDE}) x(a), range({SIDE}) y(b)),
 nb AS (SELECT m.object_id, m."row", m.col, (dr + 1) * 3 + dc + 1 AS i, m."row" + dr AS orow, m.col + dc AS ocol FROM m, (VALUES (-1), (0), (1)) p(dr), (VALUES (-1), (0), (1)) q(dc) WHERE (dr <> 0 OR dc <> 0) AND m."row" + dr BETWEEN 0 AND {SIDE - 1} AND m.col + dc BETWEEN 0 AND {SIDE - 1}),
 f AS (SELECT object_id, "row", col, arg_min(orow, i) AS outer_row, arg_min(ocol, i) AS outer_col FROM nb WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.object_id = nb.object_id AND m."row" = nb.orow AND m.col = nb.ocol) GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY "row", col) - 1 AS rn, count(*) OVER (PARTITION BY object_id) AS n FROM f),
 bp AS (SELECT * FROM rk WHERE n <= 100 OR rn IN (SELECT i * (n - 1) // 99 FROM range(100) t(i)))
"""


def _mask(spark, sf):
    line = table(spark, sf, "lineitem").where(F.col("l_partkey") % SIDE > 1)
    return line.select(F.col("l_suppkey").alias("object_id"), (F.col("l_partkey") % SIDE).cast("int").alias("row"), (F.col("l_orderkey") % SIDE).cast("int").alias("col")).distinct()


def _depth(spark, sf):
    grid = F.sequence(F.lit(0), F.lit(SIDE - 1))
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("object_id")).distinct().select("object_id", F.explode(grid).alias("row")).select("object_id", "row", F.explode(grid).alias("col"))
    z = ((F.col("row") * 7 + F.col("col") * 13 + F.col("object_id")) % 50) / 10.0 + 0.5
    return d.withColumn("z", F.when((F.col("row") + F.col("col")) % 11 != 0, z))


@query("boundary_pairs", MASK + 'SELECT object_id, "row", col, outer_row, outer_col FROM bp')
def boundary_pairs(spark, sf):
    return evidence3d.boundary_pairs(_mask(spark, sf), ["object_id"], SIDE, SIDE, most=100)


@query("boundary_depth", MASK + f""", j AS (SELECT bp.object_id, (o.z - i.z) / greatest(o.z, i.z, 1e-12) AS j FROM bp JOIN dz i ON i.object_id = bp.object_id AND i."row" = bp."row" AND i.col = bp.col JOIN dz o ON o.object_id = bp.object_id AND o."row" = bp.outer_row AND o.col = bp.outer_col),
 g AS (SELECT object_id, count(*) AS pairs, count(j) AS vp, median(abs(j)) AS mj, avg(abs(j)) AS aj, sign(median(j) FILTER (abs(j) >= 0.03)) AS dir, count(*) FILTER (abs(j) >= 0.03) AS al FROM j GROUP BY ALL),
 a AS (SELECT j.object_id, count(*) AS ag FROM j JOIN g USING (object_id) WHERE abs(j) >= 0.03 AND sign(j) <> dir GROUP BY ALL)
 SELECT object_id, pairs, vp AS valid_pairs, {r('coalesce(ag, 0) / vp')} AS residual, {r('al / vp')} AS aligned, {r('aj')} AS mean_jump, {r('mj')} AS median_jump, coalesce(dir, 0)::DOUBLE AS direction, {r('vp / pairs * least(1, mj / 0.03::DOUBLE)')} AS quality, '' AS reason FROM g LEFT JOIN a USING (object_id)""")
def boundary_depth(spark, sf):
    pairs = evidence3d.boundary_pairs(_mask(spark, sf), ["object_id"], SIDE, SIDE, most=100)
    return evidence3d.boundary_depth(pairs, _depth(spark, sf), ["object_id"], ["object_id"])


_POSE = [0.0, -1.0, 0.0, 0.1, 1.0, 0.0, 0.0, -0.2, 0.0, 0.0, 1.0, 0.4, 0.0, 0.0, 0.0, 1.0]


@query("boundary_reprojection", TR + f""", s AS (SELECT *, abs(x) * 8 + 8 AS su, abs(y) * 8 + 8 AS sv, CASE WHEN vec_id % 13 <> 0 THEN scale + 1 END AS sz, vec_id % 17 <> 0 AS posed, CASE WHEN vec_id % 11 <> 0 THEN 16 + x * 4 END AS tu, 16 + y * 4 AS tv, CASE WHEN vec_id % 7 <> 0 THEN scale + 1.4::DOUBLE + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END * y END AS tz FROM tr),
 b AS (SELECT *, (su - 16) * sz / 20 AS bx, (sv - 16) * sz / 20 AS by_ FROM s), q AS (SELECT *, CASE WHEN posed THEN -by_ + 0.1::DOUBLE END AS qx, bx - 0.2::DOUBLE AS qy, sz + 0.4::DOUBLE AS qz FROM b),
 p AS (SELECT *, 20 * qx / qz + 16 AS u, 20 * qy / qz + 16 AS v, greatest(0.10, 0.10 * tz) AS tau FROM q),
 st AS (SELECT *, CASE WHEN NOT posed OR sz IS NULL THEN 'metric_depth_intrinsics_or_pose_unavailable' WHEN qz <= 0 THEN 'behind_camera' WHEN u < 0 OR v < 0 OR u >= 32 OR v >= 32 THEN 'out_of_frame' WHEN tu IS NULL THEN 'no_correspondence' WHEN tz IS NULL THEN 'depth_missing' WHEN qz - tz > tau THEN 'occluded' WHEN qz - tz < -tau THEN 'depth_conflict' ELSE 'visible' END AS state FROM p)
 SELECT vec_id, state, {r(chr(67) + 'ASE WHEN state = ' + repr('visible') + ' THEN sqrt(pow(u - tu, 2) + pow(v - tv, 2)) / sqrt(2048) END')} AS boundary_error FROM st""")
def boundary_reprojection(spark, sf):
    k = F.col("vec_id")
    rows = tracks(spark, sf).select(
        "vec_id", (F.abs("p.x") * 8 + 8).alias("source_u"), (F.abs("p.y") * 8 + 8).alias("source_v"), F.when(k % 13 != 0, F.col("scale") + 1).alias("source_z"), F.when(k % 17 != 0, F.array(*[F.lit(v) for v in _POSE])).alias("pose"),
        F.lit(20.0).alias("fx"), F.lit(20.0).alias("fy"), F.lit(16.0).alias("cx"), F.lit(16.0).alias("cy"), F.lit(32.0).alias("width"), F.lit(32.0).alias("height"),
        F.when(k % 11 != 0, 16 + F.col("p.x") * 4).alias("seen_u"), (16 + F.col("p.y") * 4).alias("seen_v"), F.when(k % 7 != 0, F.col("scale") + 1.4 + F.when(k % 5 == 0, 1).otherwise(0) * F.col("p.y")).alias("seen_z"),
    )
    return evidence3d.boundary_reprojection(rows).select("vec_id", "state", "boundary_error")


# --- tracks and objects ----------------------------------------------------------------------------


def _turn(ax, ay, az, bx, by, bz):
    na, nb = f"sqrt({ax} * {ax} + {ay} * {ay} + {az} * {az})", f"sqrt({bx} * {bx} + {by} * {by} + {bz} * {bz})"
    return f"CASE WHEN {na} > 1e-6 AND {nb} > 1e-6 THEN 1 - least(1, greatest(-1, ({ax} * {bx} + {ay} * {by} + {az} * {bz}) / ({na} * {nb}))) END"


@query("direction_evidence", TR + f""", st AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM tr WINDOW w AS (PARTITION BY video_id, point_id ORDER BY frame_index)),
 sq AS (SELECT *, lag(dx) OVER w AS ex, lag(dy) OVER w AS ey, lag(dz) OVER w AS ez FROM st WINDOW w AS (PARTITION BY video_id, point_id ORDER BY frame_index)),
 om AS (SELECT a.video_id, a.point_id, a.frame_index, median(b.dx) AS mx, median(b.dy) AS my, median(b.dz) AS mz, median(b.dx) FILTER (n) AS nx, median(b.dy) FILTER (n) AS ny, median(b.dz) FILTER (n) AS nz FROM sq a JOIN (SELECT * FROM st WHERE dx IS NOT NULL) b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.point_id <> b.point_id, LATERAL (SELECT b.point_id IN ((a.point_id + 1) % 4, (a.point_id + 2) % 4) AS n) GROUP BY ALL)
 SELECT video_id, point_id, frame_index, {r(_turn('dx', 'dy', 'dz', 'ex', 'ey', 'ez'))} AS own, {r(_turn('dx', 'dy', 'dz', 'mx', 'my', 'mz'))} AS object_median, {r(_turn('dx', 'dy', 'dz', 'nx', 'ny', 'nz'))} AS neighbour,
  CASE WHEN {_turn('dx', 'dy', 'dz', 'ex', 'ey', 'ez')} IS NULL THEN 'direction_undefined_for_near_static_displacement' ELSE '' END AS reason FROM sq LEFT JOIN om USING (video_id, point_id, frame_index) WHERE ex IS NOT NULL""")
def direction_evidence(spark, sf):
    near = spark.createDataFrame([(p, [(p + 1) % 4, (p + 2) % 4]) for p in range(4)], "point_id int, neighbours array<int>")
    return evidence3d.direction_evidence(tracks(spark, sf), near, ["video_id"])


@query("object_dynamics", EV + f""", d AS (SELECT video_id, coalesce(object_id, 'none') AS object_id, CASE WHEN ord % 3 = 0 THEN 'edge' ELSE 'point' END AS kind, ord AS item_id, raw_value AS value, confidence AS quality, valid AND ord % 11 <> 0 AS valid FROM ev),
 k AS (SELECT *, row_number() OVER (PARTITION BY video_id, object_id, valid ORDER BY value, kind, item_id) AS rn, count(*) OVER (PARTITION BY video_id, object_id, valid) AS n, row_number() OVER (PARTITION BY video_id, object_id, valid, kind ORDER BY value DESC, item_id) AS kr FROM d)
 SELECT video_id, object_id, {r('median(value) FILTER (valid)')} AS median, {r('avg(value) FILTER (valid AND (n <= 2 * floor(n * 0.1::DOUBLE) OR rn BETWEEN floor(n * 0.1::DOUBLE) + 1 AND n - floor(n * 0.1::DOUBLE)))')} AS trimmed_mean, {r('avg(value) FILTER (valid AND rn > n - 3)')} AS topk_mean,
  {r("coalesce(count(*) FILTER (valid AND kind = 'point') / nullif(count(*) FILTER (kind = 'point'), 0), 0)")} AS valid_point_ratio, {r("coalesce(count(*) FILTER (valid AND kind = 'edge') / nullif(count(*) FILTER (kind = 'edge'), 0), 0)")} AS valid_edge_ratio,
  coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY kr) FILTER (valid AND kind = 'point' AND kr <= 3), '') AS top_points, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY kr) FILTER (valid AND kind = 'edge' AND kr <= 3), '') AS top_edges,
  {r('coalesce(avg(quality) FILTER (valid), 0)')} AS quality, CASE WHEN count(*) FILTER (valid) = 0 THEN 'no_valid_dynamic_evidence' ELSE '' END AS reason FROM k GROUP BY ALL""")
def object_dynamics(spark, sf):
    k = F.col("ord")
    rows = evidence(spark, sf).select("video_id", F.coalesce("object_id", F.lit("none")).alias("object_id"), F.when(k % 3 == 0, "edge").otherwise("point").alias("kind"), k.alias("item_id"), F.col("raw_value").alias("value"), F.col("confidence").alias("quality"), (F.col("valid") & (k % 11 != 0)).alias("valid"))
    return evidence3d.object_dynamics(rows, ["video_id", "object_id"])


@query("support_prediction", """WITH m AS (SELECT DISTINCT l_suppkey AS video_id, l_linenumber AS object_id, (l_orderkey % 9)::INT AS frame_index, (l_partkey % 20)::INT AS "row", (l_quantity % 20)::INT AS col FROM lineitem),
 c AS (SELECT *, row_number() OVER (PARTITION BY video_id, object_id ORDER BY frame_index DESC) AS rn FROM (SELECT video_id, object_id, frame_index, avg(col) AS u, avg("row") AS v, count(*) AS area FROM m WHERE (video_id + object_id + frame_index) % 4 <> 0 GROUP BY ALL)),
 t AS (SELECT a.video_id, a.object_id, a.frame_index AS f1, a.area, b.video_id IS NOT NULL AS two, (a.u - b.u) * (10 - a.frame_index) / (a.frame_index - b.frame_index) AS su, (a.v - b.v) * (10 - a.frame_index) / (a.frame_index - b.frame_index) AS sv, least((a.frame_index * 7 % 10 + 1) / 10.0::DOUBLE, (b.frame_index * 7 % 10 + 1) / 10.0::DOUBLE) AS q, (a.frame_index % 5 = 0 OR b.frame_index % 5 = 0) AS lg
   FROM c a LEFT JOIN c b ON a.video_id = b.video_id AND a.object_id = b.object_id AND b.rn = 2 WHERE a.rn = 1),
 s AS (SELECT t.video_id, t.object_id, count(*) AS n FROM t JOIN m ON m.video_id = t.video_id AND m.object_id = t.object_id AND m.frame_index = t.f1 WHERE two AND ceil(col + su - 0.5) BETWEEN 0 AND 19 AND ceil("row" + sv - 0.5) BETWEEN 0 AND 19 GROUP BY ALL),
 x AS (SELECT t.*, coalesce(n, 0) AS n, CASE WHEN NOT two THEN 'insufficient_mask_history' WHEN coalesce(n, 0) = 0 THEN 'predicted_support_outside_frame' ELSE '' END AS reason FROM t LEFT JOIN s USING (video_id, object_id))
 SELECT video_id, object_id, CASE WHEN reason = '' THEN area END AS predicted_area, CASE WHEN reason = '' THEN n END AS support_area, """ + r("CASE WHEN reason = '' THEN least(1, n / area) END") + " AS in_frame_ratio, " + r("su") + " AS shift_u, " + r("sv") + " AS shift_v, " + r("CASE WHEN reason <> '' THEN 0 WHEN lg THEN least(q, 0.25) ELSE q END") + " AS quality, reason FROM x")
def support_prediction(spark, sf):
    c = F.col
    masks = table(spark, sf, "lineitem").select(c("l_suppkey").alias("video_id"), c("l_linenumber").alias("object_id"), (c("l_orderkey") % 9).cast("int").alias("frame_index"), (c("l_partkey") % 20).cast("int").alias("row"), (c("l_quantity") % 20).cast("int").alias("col")).distinct()
    frames = masks.select("video_id", "object_id", "frame_index").distinct().where((c("video_id") + c("object_id") + c("frame_index")) % 4 != 0)
    frames = frames.withColumn("confidence", (c("frame_index") * 7 % 10 + 1) / 10.0).withColumn("legacy", c("frame_index") % 5 == 0)
    return evidence3d.predict_support(masks, frames, ["video_id", "object_id"], 10, 20, 20)


@query("spatial_intersection", f"""WITH p AS (SELECT (l_orderkey // 16) AS frame_id, l_linenumber AS object_id, (l_partkey % 20) / 4.0::DOUBLE AS x, (l_suppkey % 20) / 4.0::DOUBLE AS y, l_quantity / 10.0::DOUBLE AS z FROM lineitem),
 o AS (SELECT frame_id, object_id, min(x) AS lx, max(x) AS hx, median(x) AS cx, min(y) AS ly, max(y) AS hy, median(y) AS cy, min(z) AS lz, max(z) AS hz, median(z) AS cz, count(*) AS n, 1.0::DOUBLE + object_id / 4.0::DOUBLE AS size, (object_id % 4) / 4.0::DOUBLE AS q, CASE WHEN (frame_id + object_id) % 5 = 0 THEN 'relative' ELSE 'metric' END AS st FROM p GROUP BY ALL),
 d AS (SELECT a.frame_id, a.object_id AS a, b.object_id AS b, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS near FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.object_id < b.object_id GROUP BY ALL),
 j AS (SELECT d.*, greatest(0, least(p.hx, q.hx) - greatest(p.lx, q.lx)) * greatest(0, least(p.hy, q.hy) - greatest(p.ly, q.ly)) * greatest(0, least(p.hz, q.hz) - greatest(p.lz, q.lz)) AS ov, least((p.hx - p.lx) * (p.hy - p.ly) * (p.hz - p.lz), (q.hx - q.lx) * (q.hy - q.ly) * (q.hz - q.lz)) AS sm,
   (p.cx BETWEEN q.lx AND q.hx AND p.cy BETWEEN q.ly AND q.hy AND p.cz BETWEEN q.lz AND q.hz) OR (q.cx BETWEEN p.lx AND p.hx AND q.cy BETWEEN p.ly AND p.hy AND q.cz BETWEEN p.lz AND p.hz) AS inside, greatest(p.size, q.size) AS size, least(p.q, q.q) AS qq,
   CASE WHEN least(p.n, q.n) < 3 OR least(p.q, q.q) <= 0 THEN 'insufficient_3d_spatial_evidence' WHEN p.st <> q.st THEN 'incompatible_scale_domains' ELSE '' END AS reason FROM d JOIN o p ON p.frame_id = d.frame_id AND p.object_id = d.a JOIN o q ON q.frame_id = d.frame_id AND q.object_id = d.b),
 v AS (SELECT *, CASE WHEN sm > 1e-12 THEN ov / sm ELSE 0 END AS ra FROM j)
 SELECT frame_id, a, b, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN ra END')} AS overlap_ratio, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN near END')} AS min_distance, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN least(1, greatest(ra, 1 - least(1, near / size), inside::INT, 0)) END')} AS diagnostic, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN qq / 2 ELSE 0 END')} AS quality, reason FROM v""")
def spatial_intersection(spark, sf):
    c = F.col
    p = table(spark, sf, "lineitem").select(F.floor(c("l_orderkey") / 16).alias("frame_id"), c("l_linenumber").alias("object_id"), (c("l_partkey") % 20 / 4.0).alias("x"), (c("l_suppkey") % 20 / 4.0).alias("y"), (c("l_quantity") / 10.0).alias("z"))
    p = p.withColumn("scale_status", F.when((c("frame_id") + c("object_id")) % 5 == 0, "relative").otherwise("metric")).withColumn("object_scale", 1.0 + c("object_id") / 4.0).withColumn("object_quality", c("object_id") % 4 / 4.0)
    return evidence3d.spatial_intersection(p, ["frame_id"])


@query("clip_depth_summary", EV + f""", dr AS (SELECT video_id, track_id, row_idx AS frame_index, ln((raw_value + 0.5) / 2.0 + 1e-6) + ln(confidence + 0.1 + 1e-6) AS g, confidence AS c FROM ev WHERE valid AND track_id IS NOT NULL),
 lg AS (SELECT *, frame_index - lag(frame_index) OVER w AS gap, lag(g) OVER w AS g0, lag(c) OVER w AS c0 FROM dr WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_index)),
 dt AS (SELECT video_id, track_id, frame_index, gap, CASE WHEN gap BETWEEN 1 AND 3 THEN greatest(0, abs(g - g0) - 0.1) END AS residual, CASE WHEN gap BETWEEN 1 AND 3 THEN sqrt(c * c0) END AS weight FROM lg WHERE gap IS NOT NULL),
 cl AS (SELECT video_id, unnest(range(0, n // 8 + 1)) AS clip_ordinal FROM (SELECT video_id, max(row_idx)::BIGINT AS n FROM ev GROUP BY ALL)),
 j AS (SELECT cl.*, dt.*, row_number() OVER (PARTITION BY cl.video_id, clip_ordinal ORDER BY residual DESC NULLS LAST, frame_index, track_id) AS rn FROM cl JOIN dt ON dt.video_id = cl.video_id AND frame_index - gap >= clip_ordinal * 8 AND frame_index <= clip_ordinal * 8 + 7),
 a AS (SELECT video_id, clip_ordinal, count(DISTINCT track_id) AS tracks, count(residual) AS n, avg(residual) AS mean, max(residual) AS mx, avg(residual) FILTER (rn <= 3) AS top, avg(residual * weight) AS w FROM j GROUP BY ALL)
 SELECT video_id, clip_ordinal, coalesce(tracks, 0) AS tracks, coalesce(n, 0) AS transitions, {r('coalesce(mean, 0)')} AS mean, {r('coalesce(mx, 0)')} AS max, {r('coalesce(top, 0)')} AS top_mean, {r('coalesce(w, 0)')} AS weighted FROM cl LEFT JOIN a USING (video_id, clip_ordinal)""")
def clip_depth_summary(spark, sf):
    from .evidence_queries import _depth_rows

    t = residuals.depth_transitions(_depth_rows(spark, sf), max_gap=3)
    clips = evidence(spark, sf).groupBy("video_id").agg(F.max("row_idx").alias("_n")).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / 8))).alias("clip_ordinal"))
    clips = clips.withColumn("start_frame", F.col("clip_ordinal") * 8).withColumn("end_frame", F.col("clip_ordinal") * 8 + 7)
    return evidence3d.clip_depth_summary(t, clips)


# --- depth alignment -------------------------------------------------------------------------------


def _depth_pairs(spark, sf):
    g = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, sf, "embeddings").where("label IS NOT NULL").select("vec_id", F.col("label").cast("long").alias("pair_id"), (F.abs(g(2)) + 0.1).alias("source"), g(5).alias("noise"))
    noise = F.when(F.col("vec_id") % 10 == 0, F.abs("noise") * 5).otherwise(F.col("noise") * 0.01)
    return e.select("pair_id", "source", (2 * F.col("source") + 0.5 + noise).alias("target"))


def _robust_sql(mode: str) -> str:
    """The robust fit as a recursion over rounds, a list of points a pair."""
    of = "1 / " if mode == "affine_inverse_depth" else ""
    a, b, ok = ("t0 / xx", "0.0::DOUBLE", "xx > 1e-12") if mode == "scale_only" else ("t / s", "my - t / s * mx", "s > 1e-12 * greatest(1, xx)")
    add = lambda e: f"list_sum(list_transform(h, lambda q: {e}))"
    return f"""SELECT * FROM (WITH RECURSIVE p AS (SELECT label::BIGINT AS pair_id, abs(embedding[3]::DOUBLE) + 0.1::DOUBLE AS s, 2 * (abs(embedding[3]::DOUBLE) + 0.1::DOUBLE) + 0.5 + CASE WHEN vec_id % 10 = 0 THEN abs(embedding[6]::DOUBLE) * 5 ELSE embedding[6]::DOUBLE * 0.01::DOUBLE END AS t FROM embeddings WHERE label IS NOT NULL),
 l AS MATERIALIZED (SELECT pair_id, list({{'x': {of}s, 'y': {of}t}} ORDER BY {of}s, {of}t) FILTER (s > 0 AND t > 0) AS pts FROM p GROUP BY pair_id),
 st AS (SELECT pair_id, pts, 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS m, 'inf'::DOUBLE AS reach, false AS fitted, false AS done FROM l WHERE len(pts) >= 12
  UNION ALL SELECT pair_id, pts, k + 1, CASE WHEN ok THEN na ELSE a END, CASE WHEN ok THEN nb ELSE b END, CASE WHEN ok THEN nm ELSE m END, CASE WHEN ok THEN nr ELSE reach END, fitted OR ok,
    NOT ok OR len(list_filter(pts, lambda q: (abs(q.y - na * q.x - nb - nm) <= nr) <> (abs(q.y - a * q.x - b - m) <= reach))) = 0 FROM
   (SELECT *, greatest(1e-8::DOUBLE, 1e-4::DOUBLE * list_median(list_transform(h, lambda q: abs(q.y))), 3.5::DOUBLE * 1.4826::DOUBLE * list_median(list_transform(off, lambda o: abs(o - nm)))) AS nr FROM
   (SELECT *, list_median(off) AS nm FROM (SELECT *, list_transform(h, lambda q: q.y - na * q.x - nb) AS off FROM
   (SELECT *, {a} AS na, {b} AS nb, coalesce(len(h) >= 12 AND {ok}, false) AS ok FROM
   (SELECT *, {add('(q.x - mx) * (q.x - mx)')} AS s, {add('(q.x - mx) * (q.y - my)')} AS t FROM
   (SELECT *, {add('q.x * q.x')} AS xx, {add('q.x * q.y')} AS t0, {add('q.x')} / len(h) AS mx, {add('q.y')} / len(h) AS my FROM
   (SELECT *, list_filter(pts, lambda q: abs(q.y - a * q.x - b - m) <= reach) AS h FROM st WHERE NOT done AND k < 8)))))))),
 f AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY k DESC) = 1),
 g AS (SELECT l.pair_id, len(l.pts) AS n, f.a, f.b, fitted, list_filter(l.pts, lambda q: abs(q.y - f.a * q.x - f.b - f.m) <= f.reach) AS h FROM l LEFT JOIN f USING (pair_id)),
 e AS (SELECT *, coalesce(fitted AND len(h) >= 12 AND a > 0, false) AS ok, sqrt({add('(q.y - a * q.x - b) * (q.y - a * q.x - b)')} / len(h)) AS err, greatest(list_median(list_transform(h, lambda q: abs(q.y))), 1e-12::DOUBLE) AS lvl FROM g)
 SELECT pair_id, {r('CASE WHEN ok THEN a END')} AS scale, {r('CASE WHEN ok THEN b END')} AS shift, n::BIGINT AS support, {r('CASE WHEN ok THEN len(h) / n END')} AS inlier_ratio, {r('CASE WHEN ok THEN err END')} AS error, {r('CASE WHEN ok THEN least(1, len(h) / n / (1 + err / lvl)) ELSE 0 END')} AS quality,
  CASE WHEN n < 12 THEN 'insufficient_background_depth_support' WHEN NOT ok THEN 'robust_depth_alignment_failed' ELSE '' END AS reason FROM e)"""


@query("depth_alignment", _robust_sql("affine_depth"))
def depth_alignment(spark, sf):
    return alignment.align_depth(_depth_pairs(spark, sf), "affine_depth")


def _shared_scale_sql() -> str:
    return f"""WITH p AS (SELECT label::BIGINT AS pair_id, abs(embedding[3]::DOUBLE) + 0.1::DOUBLE AS s, 2 * (abs(embedding[3]::DOUBLE) + 0.1::DOUBLE) + 0.5 + CASE WHEN vec_id % 10 = 0 THEN abs(embedding[6]::DOUBLE) * 5 ELSE embedding[6]::DOUBLE * 0.01::DOUBLE END AS t FROM embeddings WHERE label IS NOT NULL),
 a AS (SELECT pair_id, count(*) AS n, sqrt(avg(pow(t - s, 2))) AS e, greatest(median(abs(t)), 1e-12) AS ref FROM p WHERE s > 0 AND t > 0 GROUP BY ALL)
 SELECT pair_id, CASE WHEN n >= 12 THEN 1.0 END::DOUBLE AS scale, CASE WHEN n >= 12 THEN 0.0 END::DOUBLE AS shift, n AS support, CASE WHEN n >= 12 THEN 1.0 END::DOUBLE AS inlier_ratio, {r('CASE WHEN n >= 12 THEN e END')} AS error, {r('CASE WHEN n >= 12 THEN 1 / (1 + e / ref) ELSE 0 END')} AS quality, CASE WHEN n >= 12 THEN '' ELSE 'insufficient_background_depth_support' END AS reason FROM a"""


@query("depth_alignment_modes", " UNION ALL ".join(f"SELECT *, '{m}' AS mode FROM ({_robust_sql(m) if m != 'provider_shared_scale' else _shared_scale_sql()})" for m in alignment.MODES))
def depth_alignment_modes(spark, sf):
    pairs, out = _depth_pairs(spark, sf), None
    for mode in alignment.MODES:
        one = alignment.align_depth(pairs, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query("depth_alignment_shared", _shared_scale_sql())
def depth_alignment_shared(spark, sf):
    return alignment.align_depth(_depth_pairs(spark, sf), "provider_shared_scale")


@query("depth_alignment_sequence", EV + f""", t AS (SELECT video_id, row_idx::BIGINT AS frame_index, 1 + (ord % 7) / 20.0::DOUBLE AS a, (ord % 5) / 50.0::DOUBLE AS b, count(*) OVER (PARTITION BY video_id) AS n FROM ev)
 SELECT t.video_id, t.frame_index, 'affine_depth' AS mode, {r("CASE WHEN t.frame_index < 42 THEN t.a / o.a END")} AS scale, {r("CASE WHEN t.frame_index < 42 THEN (t.b - o.b) / o.a END")} AS shift, {r("CASE WHEN t.frame_index < 42 THEN 0.9 ELSE 0 END")} AS quality, {r("0")} AS inconsistency,
  CASE WHEN t.frame_index < 42 THEN '' ELSE 'depth_alignment_graph_disconnected' END AS reason FROM t JOIN t o ON o.video_id = t.video_id AND o.frame_index = 0 WHERE t.n > 1""")
def depth_alignment_sequence(spark, sf):
    """Edges between frames one and two apart, from the true scale and shift of both; poor ones from every thirteenth frame, and from two frames in a row, behind which nothing is joined."""
    n = F.col("row_idx")
    f = evidence(spark, sf).select("video_id", n.alias("frame_index"), (1 + (F.col("ord") % 7) / 20.0).alias("a"), ((F.col("ord") % 5) / 50.0).alias("b"))
    by = Window.partitionBy("video_id").orderBy("frame_index")
    ahead = F.array(*[F.lead(F.struct(F.col("frame_index").alias("target"), F.col("a").alias("a2"), F.col("b").alias("b2")), gap).over(by) for gap in (1, 2)])
    edges = f.select("video_id", F.col("frame_index").alias("source"), "a", "b", ahead.alias("ahead")).select("video_id", "source", "a", "b", F.explode("ahead").alias("to")).where("to IS NOT NULL").select("video_id", "source", "a", "b", "to.*")
    # depth in the reference = a * depth in the frame + b, so target = (a * source + b - b2) / a2
    edges = edges.select("video_id", "source", "target", F.lit("affine_depth").alias("mode"), (F.col("a") / F.col("a2")).alias("scale"), ((F.col("b") - F.col("b2")) / F.col("a2")).alias("shift"), F.when((F.col("source") % 13 == 5) | F.col("source").isin(40, 41), 0.1).otherwise(0.9).alias("quality"), F.lit(0.01).alias("holdout"))
    return alignment.align_sequence(edges)


@query("point_budget", TR + ", n AS (SELECT video_id, frame_index, point_id, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY scale DESC, point_id) AS rn FROM tr) SELECT video_id, frame_index, point_id FROM n WHERE rn <= 2")
def point_budget(spark, sf):
    by = Window.partitionBy("video_id", "frame_index").orderBy(F.desc("scale"), "point_id")
    return tracks(spark, sf).withColumn("_r", F.row_number().over(by)).where("_r <= 2").select("video_id", "frame_index", "point_id")


# --- cameras and graphs ----------------------------------------------------------------------------


@query("camera_world", TR + f"""SELECT vec_id, {r('CASE WHEN vec_id % 9 <> 0 THEN y + 0.2 END')} AS cx, {r('CASE WHEN vec_id % 9 <> 0 THEN -(x - 0.1) END')} AS cy, {r('CASE WHEN vec_id % 9 <> 0 THEN z - 0.4 END')} AS cz, {r('CASE WHEN vec_id % 9 <> 0 THEN x END')} AS wx, {r('CASE WHEN vec_id % 9 <> 0 THEN y END')} AS wy, {r('CASE WHEN vec_id % 9 <> 0 THEN z END')} AS wz,
  CASE WHEN vec_id % 9 <> 0 THEN 0.1 END::DOUBLE AS ox, CASE WHEN vec_id % 9 <> 0 THEN -0.2 END::DOUBLE AS oy, CASE WHEN vec_id % 9 <> 0 THEN 0.4 END::DOUBLE AS oz, CASE WHEN vec_id % 9 <> 0 THEN '' ELSE 'no_camera_pose' END AS reason FROM tr""")
def camera_world(spark, sf):
    """World points into the camera and back, and where the camera stands."""
    t = tracks(spark, sf).withColumn("pose", F.when(F.col("vec_id") % 9 != 0, F.array(*[F.lit(v) for v in _POSE])))
    t = t.withColumn("inverse", F.when(F.col("pose").isNotNull(), G.inverse_rigid(F.col("pose"))))
    t = t.withColumn("c", F.when(F.col("pose").isNotNull(), G.transform(F.col("p"), F.col("inverse"))))
    t = t.withColumn("w", F.when(F.col("pose").isNotNull(), G.transform(F.col("c"), F.col("pose")))).withColumn("o", G.camera_center(F.col("pose")))
    names = [F.col(f"{s}.{x}").alias(f"{s}{x}") for s in "cwo" for x in "xyz"]
    return t.select("vec_id", *names, F.when(F.col("pose").isNull(), "no_camera_pose").otherwise("").alias("reason"))


@query("target_prediction", TR + f", q AS (SELECT vec_id, -y + 0.1 AS x, x - 0.2 AS y, z + 0.4 AS z FROM tr) SELECT vec_id, {r('CASE WHEN z > 0 AND vec_id % 9 <> 0 THEN 20 * x / z + 16 END')} AS u, {r('CASE WHEN z > 0 AND vec_id % 9 <> 0 THEN 20 * y / z + 16 END')} AS v FROM q")
def target_prediction(spark, sf):
    pose = F.when(F.col("vec_id") % 9 != 0, F.array(*[F.lit(v) for v in _POSE]))
    t = tracks(spark, sf).withColumn("uv", G.predict_target(F.col("p"), pose, F.lit(20.0), F.lit(20.0), F.lit(16.0), F.lit(16.0)))
    return t.select("vec_id", "uv.u", "uv.v")


@query("orientation_angles", TR + f""", o AS (SELECT * FROM tr WHERE vec_id % 5 <> 0) SELECT a.video_id, a.frame_index, a.point_id AS a, b.point_id AS b, {r('acos(least(1, greatest(-1, (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(b.x * b.x + b.y * b.y + b.z * b.z))))) / pi()')} AS angle
  FROM o a JOIN o b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.point_id < b.point_id""")
def orientation_angles(spark, sf):
    t = tracks(spark, sf).select("video_id", "frame_index", F.col("point_id").alias("node_id"), F.when(F.col("vec_id") % 5 != 0, F.col("p")).alias("o"))
    return relations.orientation_angles(t, ["video_id", "frame_index"])


@query("boundary_radii", TR + f""", c AS (SELECT video_id, frame_index, x, y, z, 0.5 + point_id / 10.0::DOUBLE AS c FROM tr WHERE point_id = 0), b AS (SELECT video_id, frame_index, x, y, z, scale / (1 + scale) AS q FROM tr WHERE point_id > 0),
  d AS (SELECT c.video_id, c.frame_index, c.c, b.q, sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2) + pow(c.z - b.z, 2)) AS d FROM c JOIN b ON c.video_id = b.video_id AND c.frame_index = b.frame_index)
  SELECT video_id, frame_index, {r('median(d)')} AS median_radius, {r('quantile_cont(d, 0.9)')} AS p90_radius, {r('least(first(c), median(q))')} AS confidence, count(*) AS points FROM d GROUP BY ALL HAVING median(d) > 0""")
def boundary_radii(spark, sf):
    t = tracks(spark, sf)
    centres = t.where("point_id = 0").select("video_id", "frame_index", "p", (0.5 + F.col("point_id") / 10.0).alias("confidence"))
    return relations.boundary_radii(centres, t.where("point_id > 0").select("video_id", "frame_index", "p", (F.col("scale") / (1 + F.col("scale"))).alias("confidence")), ["video_id", "frame_index"])


@query("structure_edges", TR + f""", ed AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3), (3, 0), (0, 9)) AS e(a, b)), l AS (SELECT p.video_id AS object_id, p.frame_index, ed.a || '-' || ed.b AS edge_id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS length FROM ed JOIN tr p ON p.point_id = ed.a JOIN tr q ON q.point_id = ed.b AND q.video_id = p.video_id AND q.frame_index = p.frame_index)
  SELECT object_id, frame_index, edge_id, {r('length')} AS length, {r('length / median(length) OVER (PARTITION BY object_id, frame_index)')} AS rigidity FROM l WHERE length > 0""")
def structure_edges(spark, sf):
    t = tracks(spark, sf).select(F.col("video_id").alias("object_id"), "frame_index", F.col("point_id").alias("node_id"), "p")
    fixed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(f"{a}-{b}").alias("edge_id")) for a, b in ((0, 1), (1, 2), (2, 3), (3, 0), (0, 9))])
    edges = t.select("object_id").distinct().withColumn("_e", F.explode(fixed)).select("object_id", "_e.*")
    return relations.structure_edges(t, edges, ["frame_index"])


@query("object_d2", TR + f", e AS (SELECT video_id, frame_index, CASE WHEN vec_id % 4 <> 0 THEN abs(x) END AS pe, CASE WHEN vec_id % 3 <> 0 THEN abs(y) END AS be FROM tr) SELECT video_id, frame_index, {r('median(coalesce(pe, be))')} AS residual FROM e GROUP BY ALL")
def object_d2(spark, sf):
    rows = tracks(spark, sf).select("video_id", "frame_index", F.when(F.col("vec_id") % 4 != 0, F.abs("p.x")).alias("point_error"), F.when(F.col("vec_id") % 3 != 0, F.abs("p.y")).alias("boundary_error"))
    return residuals.object_d2(rows, ["video_id", "frame_index"])


@query("object_source_pooling", """WITH px AS (SELECT DISTINCT l_suppkey AS f, l_linenumber AS o, (l_partkey % 20)::INT AS "row", (l_orderkey % 20)::INT AS col FROM lineitem),
 mp AS (SELECT s AS f, a::INT AS "row", b::INT AS col, CASE WHEN (a + b + s) % 7 <> 0 THEN ((a * 3 + b * 5 + s) % 100) / 100.0::DOUBLE END AS flow, CASE WHEN (a * b + s) % 5 <> 0 THEN ((a * 7 + b * 2 + s) % 100) / 50.0::DOUBLE END AS depth, ((a + b * 9 + s) % 100) / 25.0::DOUBLE AS corr FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem), range(20) x(a), range(20) y(b)),
 pt AS (SELECT l_suppkey AS f, (l_partkey % 40) / 2.0::DOUBLE AS u, (l_quantity % 40) / 2.0::DOUBLE AS v, l_discount * 10 AS res, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber))::INT AS id FROM lineitem),
 l AS (SELECT px.f, px.o, 'flow' AS s, flow AS v, px."row" AS k1, px.col AS k2 FROM px JOIN mp USING (f, "row", col) UNION ALL SELECT px.f, px.o, 'depth', depth, px."row", px.col FROM px JOIN mp USING (f, "row", col) UNION ALL SELECT px.f, px.o, 'corr', corr, px."row", px.col FROM px JOIN mp USING (f, "row", col)
   UNION ALL SELECT px.f, px.o, 'track', res, id, 0 FROM pt JOIN px ON px.f = pt.f AND px."row" = round_even(pt.v, 0)::INT AND px.col = round_even(pt.u, 0)::INT),
 k AS (SELECT *, row_number() OVER (PARTITION BY f, o, s ORDER BY v DESC, k1, k2) AS rn, count(*) OVER (PARTITION BY f, o, s) AS n FROM l WHERE v IS NOT NULL)
 SELECT f AS frame_id, o AS object_id, """ + ", ".join(f"{r(f'avg(v) FILTER (s = {x!r})')} AS {x}" for x in ("flow", "depth", "corr", "track")) + " FROM k WHERE rn <= greatest(1, ceil(n * 0.25::DOUBLE)) GROUP BY ALL")
def object_source_pooling(spark, sf):
    c = F.col
    line = table(spark, sf, "lineitem")
    px = line.select(c("l_suppkey").alias("frame_id"), c("l_linenumber").alias("object_id"), (c("l_partkey") % 20).cast("int").alias("row"), (c("l_orderkey") % 20).cast("int").alias("col")).distinct()
    grid = F.sequence(F.lit(0), F.lit(19))
    mp = line.select(c("l_suppkey").alias("frame_id")).distinct().select("frame_id", F.explode(grid).alias("row")).select("frame_id", "row", F.explode(grid).alias("col"))
    a, b, s = c("row"), c("col"), c("frame_id")
    mp = mp.select("*", F.when((a + b + s) % 7 != 0, ((a * 3 + b * 5 + s) % 100) / 100.0).alias("flow"), F.when((a * b + s) % 5 != 0, ((a * 7 + b * 2 + s) % 100) / 50.0).alias("depth"), (((a + b * 9 + s) % 100) / 25.0).alias("corr"))
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    pt = line.select(c("l_suppkey").alias("frame_id"), ((c("l_partkey") % 40) / 2.0).alias("u"), ((c("l_quantity") % 40) / 2.0).alias("v"), (c("l_discount") * 10).alias("residual"), number.alias("point_id"))
    return pooling.pool_sources(px, mp, pt, ["frame_id"], ["frame_id", "object_id"], ["flow", "depth", "corr"])
