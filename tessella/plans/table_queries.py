"""Queries over tracks, objects, records, predictions and the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import governance, metrics, relations, residuals, sequential, windows
from tessella.session import parts, stored

from .adapters import OB, PR, RE, TR, objects, predictions, records, table, tracks
from .registry import query, r

W = "(PARTITION BY video_id, point_id ORDER BY frame_index)"


def _d(a, b):
    return f"sqrt(pow({a}x - {b}x, 2) + pow({a}y - {b}y, 2) + pow({a}z - {b}z, 2))"


# --- tracks ----------------------------------------------------------------------------------

LAGS = TR + f""", lg AS (SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(z) OVER w AS z1, lag(x, 2) OVER w AS x2, lag(y, 2) OVER w AS y2, lag(z, 2) OVER w AS z2,
  lag(frame_index) OVER w AS f1, lag(frame_index, 2) OVER w AS f2 FROM tr WINDOW w AS {W})"""


@query("velocity_prediction", LAGS + f""", p AS (SELECT *, (frame_index - f1) / (f1 - f2)::DOUBLE AS k FROM lg)
SELECT video_id, point_id, frame_index, {r('sqrt(pow(x - (x1 + (x1 - x2) * k), 2) + pow(y - (y1 + (y1 - y2) * k), 2) + pow(z - (z1 + (z1 - z2) * k), 2))')} AS error FROM p""")
def velocity_prediction(spark, sf):
    return residuals.velocity_prediction(tracks(spark, sf)).select("video_id", "point_id", "frame_index", "error")


@query("track_continuity", LAGS + f""", c AS (SELECT *, sqrt(pow(x - 2 * x1 + x2, 2) + pow(y - 2 * y1 + y2, 2) + pow(z - 2 * z1 + z2, 2)) AS raw FROM lg)
SELECT video_id, point_id, frame_index, {r('raw')} AS raw, {r('raw / scale')} AS normalized FROM c""")
def track_continuity(spark, sf):
    return residuals.continuity(tracks(spark, sf)).select("video_id", "point_id", "frame_index", "raw", "normalized")


STEPS = LAGS + f""", sp AS (SELECT *, x - x1 AS dx, y - y1 AS dy, z - z1 AS dz, frame_index - f1 AS dt, sqrt(pow(x - x1, 2) + pow(y - y1, 2) + pow(z - z1, 2)) AS step FROM lg),
sq AS (SELECT *, lag(dx) OVER w AS ex, lag(dy) OVER w AS ey, lag(dz) OVER w AS ez, lag(step) OVER w AS estep FROM sp WINDOW w AS {W})"""


@query("direction_change", STEPS + f"SELECT video_id, point_id, frame_index, {r('CASE WHEN step > 1e-6 AND estep > 1e-6 THEN 1 - least(1, greatest(-1, (dx * ex + dy * ey + dz * ez) / (step * estep))) END')} AS direction_change FROM sq")
def direction_change(spark, sf):
    return residuals.direction_change(tracks(spark, sf))


@query("speed_change", STEPS + f""", v AS (SELECT video_id, point_id, frame_index, CASE WHEN scale > 0 AND dt > 0 THEN step / (dt * scale) END AS speed FROM sq),
  v2 AS (SELECT *, abs(speed - lag(speed) OVER {W}) AS speed_change FROM v),
  pe AS (SELECT a.video_id, a.point_id, a.frame_index, median(b.speed) AS m FROM v a JOIN v b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.point_id <> b.point_id GROUP BY ALL)
  SELECT video_id, point_id, frame_index, {r('speed')} AS speed, {r('speed_change')} AS speed_change, {r('abs(speed - m)')} AS peer_gap FROM v2 LEFT JOIN pe USING (video_id, point_id, frame_index)""")
def speed_change(spark, sf):
    return residuals.speed_change(tracks(spark, sf))


CAM = {"fx": 20.0, "fy": 20.0, "cx": 16.0, "cy": 16.0}


def _cam():
    return [F.lit(CAM[k]) for k in ("fx", "fy", "cx", "cy")]


@query("project", TR + f"SELECT video_id, point_id, frame_index, {r('20 * x / z + 16')} AS u, {r('20 * y / z + 16')} AS v FROM tr WHERE z > 0")
def project(spark, sf):
    t = tracks(spark, sf).withColumn("uv", G.project(F.col("p"), *_cam())).where("uv IS NOT NULL")
    return t.select("video_id", "point_id", "frame_index", "uv.u", "uv.v")


@query("back_project", TR + f"SELECT video_id, point_id, frame_index, {r('(x * 10 - 16) * z / 20')} AS x, {r('(y * 10 - 16) * z / 20')} AS y, {r('z')} AS z FROM tr WHERE z > 0")
def back_project(spark, sf):
    t = tracks(spark, sf).withColumn("q", G.back_project(F.col("p.x") * 10, F.col("p.y") * 10, F.col("p.z"), *_cam())).where("q IS NOT NULL")
    return t.select("video_id", "point_id", "frame_index", "q.x", "q.y", "q.z")


POSE = [0.0, -1.0, 0.0, 0.5, 1.0, 0.0, 0.0, -0.25, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0]


@query("rigid_transform", TR + f"SELECT video_id, point_id, frame_index, {r('-y + 0.5')} AS x, {r('x - 0.25')} AS y, {r('z + 2.0')} AS z FROM tr")
def rigid_transform(spark, sf):
    t = tracks(spark, sf).withColumn("q", G.transform(F.col("p"), F.array(*[F.lit(v) for v in POSE])))
    return t.select("video_id", "point_id", "frame_index", "q.x", "q.y", "q.z")


@query("ray_to_z_depth", TR + f"SELECT video_id, point_id, frame_index, {r('z / sqrt(pow((x * 10 - 16) / 20, 2) + pow((y * 10 - 16) / 20, 2) + 1)')} AS z_depth FROM tr")
def ray_to_z_depth(spark, sf):
    return tracks(spark, sf).select("video_id", "point_id", "frame_index", G.ray_to_z(F.col("p.z"), F.col("p.x") * 10, F.col("p.y") * 10, *_cam()).alias("z_depth"))


@query("camera_checks", "SELECT vec_id, (embedding[1] > 0 AND embedding[2] > 0) AS valid_k, vec_id % 3 <> 0 AS valid_t FROM embeddings")
def camera_checks(spark, sf):
    e = table(spark, sf, "embeddings")
    g = lambda i: F.get("embedding", F.lit(i)).cast("double")
    k = F.array(g(0), F.lit(0.0), F.lit(16.0), F.lit(0.0), g(1), F.lit(16.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    t = F.when(F.col("vec_id") % 3 == 0, F.array(*[F.lit(2.0 * v) for v in POSE])).otherwise(F.array(*[F.lit(v) for v in POSE]))
    return e.select("vec_id", G.valid_intrinsics(k).alias("valid_k"), G.valid_rigid(t).alias("valid_t"))


D2 = LAGS + """, d AS (SELECT *, CASE WHEN point_id <> 3 THEN x1 END AS px, y1 AS py, z1 - 1 AS pz, 20 * x / z + 16 AS su0, 20 * y / z + 16 AS sv, CASE WHEN vec_id % 7 <> 0 THEN z - 1 END AS sz FROM lg),
 e AS (SELECT *, CASE WHEN vec_id % 11 <> 0 THEN su0 END AS su, CASE WHEN pz > 0 THEN 20 * px / pz + 16 END AS u, CASE WHEN pz > 0 THEN 20 * py / pz + 16 END AS v, pz - sz AS dz, greatest(0.10, 0.10 * sz) AS tau FROM d),
 s AS (SELECT *, CASE WHEN px IS NULL THEN 'point_missing' WHEN pz <= 0 THEN 'behind_camera' WHEN u < 0 OR v < 0 OR u >= 32 OR v >= 32 THEN 'out_of_frame' WHEN su IS NULL THEN 'no_correspondence' WHEN sz IS NULL THEN 'depth_missing'
   WHEN dz > tau THEN 'occluded' WHEN dz < -tau THEN 'depth_conflict' ELSE 'visible' END AS state FROM e)
"""


@query("d2_reprojection", D2 + f"SELECT video_id, point_id, frame_index, state, {r(chr(67) + 'ASE WHEN state = ' + repr('visible') + ' THEN sqrt(pow(u - su, 2) + pow(v - sv, 2)) / sqrt(2048) END')} AS pixel_error, {r('CASE WHEN state = ' + repr('visible') + ' THEN abs(dz) / sz END')} AS depth_error FROM s")
def d2_reprojection(spark, sf):
    from pyspark.sql import Window

    t = tracks(spark, sf)
    before = F.lag("p").over(Window.partitionBy("video_id", "point_id").orderBy("frame_index"))
    t = t.withColumn("_b", before)
    predicted = F.when(F.col("_b").isNotNull() & (F.col("point_id") != 3), G.point(F.col("_b.x"), F.col("_b.y"), F.col("_b.z") - 1))
    rows = t.select(
        "video_id", "point_id", "frame_index", predicted.alias("predicted"), *[F.lit(v).alias(k) for k, v in CAM.items()], F.lit(32.0).alias("width"), F.lit(32.0).alias("height"),
        F.when(F.col("vec_id") % 11 != 0, 20 * F.col("p.x") / F.col("p.z") + 16).alias("seen_u"), (20 * F.col("p.y") / F.col("p.z") + 16).alias("seen_v"), F.when(F.col("vec_id") % 7 != 0, F.col("p.z") - 1).alias("seen_z"),
    )
    return residuals.d2_reprojection(rows).select("video_id", "point_id", "frame_index", "state", "pixel_error", "depth_error")


GRAPH = TR + f""", g AS (SELECT a.video_id, a.frame_index, a.point_id AS a, b.point_id AS b, {_d('a.', 'b.')} AS d, b.x - a.x AS vx, b.y - a.y AS vy, b.z - a.z AS vz
  FROM tr a JOIN tr b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.point_id < b.point_id),
gr AS (SELECT video_id, frame_index, a, b, d AS distance, CASE WHEN d > 0 THEN vx / d END AS bx, CASE WHEN d > 0 THEN vy / d END AS by_, CASE WHEN d > 0 THEN vz / d END AS bz, sign(vz)::DOUBLE AS depth_order FROM g)
"""


def _graph(spark, sf):
    return relations.relation_graph(tracks(spark, sf).withColumnRenamed("point_id", "node_id"), ["video_id", "frame_index"])


@query("relation_graph", GRAPH + f"SELECT video_id, frame_index, a, b, {r('distance')} AS distance, {r('bx')} AS bx, {r('by_')} AS \"by\", {r('bz')} AS bz, depth_order FROM gr")
def relation_graph(spark, sf):
    return _graph(spark, sf)


@query("relation_diff", GRAPH + f""", j AS (SELECT coalesce(n.video_id, p.video_id) AS video_id, coalesce(n.frame_index, p.frame_index + 1)::INT AS frame_index, coalesce(n.a, p.a) AS a, coalesce(n.b, p.b) AS b,
    n.distance AS d1, p.distance AS d0, least(1, greatest(-1, n.bx * p.bx + n.by_ * p.by_ + n.bz * p.bz)) AS c, n.depth_order * p.depth_order AS o
  FROM gr n FULL JOIN gr p ON n.video_id = p.video_id AND n.frame_index = p.frame_index + 1 AND n.a = p.a AND n.b = p.b)
  SELECT video_id, frame_index, a, b, {r('abs(ln((d1 + 1e-9) / (d0 + 1e-9)))')} AS distance_change, {r('CASE WHEN d1 IS NOT NULL AND d0 IS NOT NULL THEN acos(c) / pi() END')} AS bearing_change,
    CASE WHEN d1 IS NOT NULL AND d0 IS NOT NULL THEN (o < 0)::INT::DOUBLE END AS order_flip, CASE WHEN d1 IS NOT NULL AND d0 IS NOT NULL THEN '' ELSE 'relation_not_observed_in_both_frames' END AS reason FROM j""")
def relation_diff(spark, sf):
    return relations.relation_diff(_graph(spark, sf), "video_id")


KNN = TR + f""", f0 AS (SELECT *, min(frame_index) OVER (PARTITION BY video_id) AS f FROM tr), ff AS (SELECT * FROM f0 WHERE frame_index = f),
nn AS (SELECT a.video_id, a.point_id AS a, b.point_id AS b, {_d('a.', 'b.')} AS d FROM ff a JOIN ff b ON a.video_id = b.video_id AND a.point_id <> b.point_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, a ORDER BY d, b) AS rn FROM nn),
ed AS (SELECT video_id, least(a, b) AS a, greatest(a, b) AS b, min(d) AS reference FROM rk WHERE rn <= 2 GROUP BY ALL)
"""


@query("knn_edges", KNN + f"SELECT video_id, a, b, {r('reference')} AS reference FROM ed")
def knn_edges(spark, sf):
    return relations.knn_edges(tracks(spark, sf), "video_id", 2)


@query("structure_change", KNN + f""", ch AS (SELECT ed.video_id, a.frame_index, ed.a, ed.b, abs({_d('a.', 'b.')} - reference) AS c FROM ed JOIN tr a ON a.video_id = ed.video_id AND a.point_id = ed.a JOIN tr b ON b.video_id = ed.video_id AND b.point_id = ed.b AND b.frame_index = a.frame_index),
  rc AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY c DESC, a, b) AS rn, count(*) OVER (PARTITION BY video_id, frame_index) AS n FROM ch)
  SELECT video_id, frame_index, {r('avg(c)')} AS mean_change, {r('avg(c) FILTER (rn <= greatest(1, ceil(n * 0.25::DOUBLE)))')} AS top_change, count(*) AS edges FROM rc GROUP BY ALL""")
def structure_change(spark, sf):
    t = tracks(spark, sf)
    return relations.structure_change(relations.knn_edges(t, "video_id", 2), t, "video_id")


@query("surface_extent", TR + "SELECT video_id, " + ", ".join(f"{r(f'quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)')} AS extent_{c}, {r(f'median({c})')} AS centre_{c}" for c in "xyz") + f", {r('covar_samp(x, y)')} AS cov_xy, {r('covar_samp(x, z)')} AS cov_xz, {r('covar_samp(y, z)')} AS cov_yz, count(*) AS points FROM tr GROUP BY ALL")
def surface_extent(spark, sf):
    return residuals.surface_extent(tracks(spark, sf).select("video_id", "p.*"), ["video_id"])


@query("principal_axis", TR + f""", m AS (SELECT video_id, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM tr GROUP BY ALL),
  e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS major, greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 0) AS minor FROM m)
  SELECT video_id, {r('major')} AS major, {r('minor')} AS minor, {r('CASE WHEN major >= 1.25 * greatest(minor, 1e-12) THEN 0.5 * atan2(2 * b, a - c) END')} AS angle FROM e""")
def principal_axis(spark, sf):
    return residuals.principal_axis2(tracks(spark, sf).select("video_id", "p.*"), ["video_id"])


CHAIN = """WITH RECURSIVE e AS (SELECT 'v' || (vec_id // 8) AS video_id, (vec_id % 8)::INT AS f, vec_id % 29 <> 28 AS ok, cos(embedding[1]::DOUBLE) AS c, sin(embedding[1]::DOUBLE) AS s, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z, abs(embedding[5]::DOUBLE) / (1 + abs(embedding[5]::DOUBLE)) AS q FROM embeddings),
 o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f) AS n FROM e),
 h AS (SELECT video_id, f, n, ok AS alive, c AS rc, s AS rs, x AS tx, y AS ty, z AS tz, least(1.0, q) AS q FROM o WHERE n = 1
  UNION ALL SELECT o.video_id, o.f, o.n, alive AND ok, o.c * rc - o.s * rs, o.s * rc + o.c * rs, o.c * tx - o.s * ty + o.x, o.s * tx + o.c * ty + o.y, tz + o.z, least(h.q, o.q) FROM h JOIN o ON o.video_id = h.video_id AND o.n = h.n + 1)
"""


@query("pose_chain", CHAIN + "SELECT video_id, f AS frame_index, " + ", ".join(f"{r(f'CASE WHEN alive THEN {x} END')} AS t{i}" for i, x in ((0, "rc"), (1, "-rs"), (3, "tx"), (4, "rs"), (7, "ty"), (11, "tz"))) + f", {r('CASE WHEN alive THEN q ELSE 0 END')} AS chain_confidence FROM h")
def pose_chain(spark, sf):
    e = table(spark, sf, "embeddings")
    c, s = F.cos(F.get("embedding", F.lit(0)).cast("double")), F.sin(F.get("embedding", F.lit(0)).cast("double"))
    zero, one = F.lit(0.0), F.lit(1.0)
    t = lambda i: F.get("embedding", F.lit(i)).cast("double")
    pose = F.array(c, -s, zero, t(1), s, c, zero, t(2), zero, zero, one, t(3), zero, zero, zero, one)
    rows = e.select(F.concat(F.lit("v"), (F.col("vec_id") / 8).cast("long").cast("string")).alias("video_id"), (F.col("vec_id") % 8).cast("int").alias("frame_index"), F.when(F.col("vec_id") % 29 != 28, pose).alias("pose"), (F.abs(t(4)) / (1 + F.abs(t(4)))).alias("confidence"))
    out = residuals.prefix_poses(rows)
    return out.select("video_id", "frame_index", *[F.get("pose_to_first", F.lit(i)).alias(f"t{i}") for i in (0, 1, 3, 4, 7, 11)], "chain_confidence")


#: Eigenvalues of a symmetric 3 x 3 matrix by the cosine formula; the first axis is a column of (A - l2)(A - l3).
AXES = TR + """, m AS (SELECT video_id, var_samp(x) AS a, covar_samp(x, y) AS b, covar_samp(x, z) AS c, var_samp(y) AS d, covar_samp(y, z) AS e, var_samp(z) AS f FROM tr GROUP BY ALL),
 q AS (SELECT *, (a + d + f) / 3 AS q FROM m), p AS (SELECT *, sqrt((pow(a - q, 2) + pow(d - q, 2) + pow(f - q, 2) + 2 * (b * b + c * c + e * e)) / 6) AS p FROM q),
 t AS (SELECT *, acos(least(1, greatest(-1, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (2 * p * p * p)))) / 3 AS phi FROM p),
 l AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM t), v AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM l),
 k AS (SELECT *, (a - l2) * (a - l3) + b * b + c * c AS kx, b * (a - l3) + (d - l2) * b + e * c AS ky, c * (a - l3) + e * b + (f - l2) * c AS kz FROM v),
 n AS (SELECT *, sign(kx) * sqrt(kx * kx + ky * ky + kz * kz) AS norm FROM k)
"""


@query("surface_axes", AXES + f"SELECT video_id, {r('l1')} AS l1, {r('l2')} AS l2, {r('l3')} AS l3, {r('kx / norm')} AS ax, {r('ky / norm')} AS ay, {r('kz / norm')} AS az FROM n")
def surface_axes(spark, sf):
    return sequential.surface_axes(tracks(spark, sf).select("video_id", "p.*"), "video_id")


# --- objects ------------------------------------------------------------------------------------


def _rsd(log):
    ratio = "(a.projected * a.depth) / (b.projected * b.depth + 1e-9)"
    lo, hi, v = ("ln(a.low / b.high)", "ln(a.high / b.low)", f"ln({ratio} + 1e-9)") if log else ("a.low / b.high", "a.high / b.low", ratio)
    return OB + f"SELECT a.frame_id, a.object_id AS object_a, b.object_id AS object_b, {r(ratio)} AS ratio, {r(f'greatest({lo} - {v}, 0, {v} - {hi})')} AS residual FROM ob a JOIN ob b ON a.frame_id = b.frame_id AND a.object_id <> b.object_id"


@query("rsd_ratio", _rsd(False))
def rsd_ratio(spark, sf):
    return relations.scale_depth_pairs(objects(spark, sf), "frame_id")


@query("rsd_log", _rsd(True))
def rsd_log(spark, sf):
    return relations.scale_depth_pairs(objects(spark, sf), "frame_id", log=True)


@query("leave_one_out_scale", OB + f""", s AS (SELECT *, (low + high) / 2 / observed AS scale FROM ob),
  p AS (SELECT a.frame_id, a.object_id, median(b.scale) AS m FROM s a JOIN s b ON a.frame_id = b.frame_id AND a.object_id <> b.object_id GROUP BY ALL)
  SELECT s.frame_id, s.object_id, {r('m')} AS scene_scale, {r('CASE WHEN m IS NOT NULL THEN greatest(low - observed * m, 0, observed * m - high) END')} AS residual FROM s LEFT JOIN p USING (frame_id, object_id)""")
def leave_one_out_scale(spark, sf):
    out = relations.leave_one_out_scale(objects(spark, sf), "frame_id")
    return out.withColumn("residual", F.when(F.col("scene_scale").isNotNull(), F.col("residual")))


BOX = """WITH bx AS (SELECT l_orderkey AS frame_id, l_linenumber AS box_id, (l_partkey % 100)::DOUBLE AS x1, (l_suppkey % 50)::DOUBLE AS y1, (l_partkey % 100 + l_quantity)::DOUBLE AS x2, (l_suppkey % 50 + l_quantity / 2)::DOUBLE AS y2,
  l_discount * 100 AS z1, l_discount * 100 + l_quantity AS z2 FROM lineitem)
"""


def _boxes(spark, sf):
    q = F.col("l_quantity").cast("double")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("box_id"), (F.col("l_partkey") % 100).cast("double").alias("x1"), (F.col("l_suppkey") % 50).cast("double").alias("y1"), (F.col("l_partkey") % 100 + q).alias("x2"), (F.col("l_suppkey") % 50 + q / 2).alias("y2"), (F.col("l_discount") * 100).alias("z1"), (F.col("l_discount") * 100 + q).alias("z2"))


@query("box_iou", BOX + f""", p AS (SELECT a.frame_id, a.box_id AS a, b.box_id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb, sqrt(pow((a.x1 + a.x2 - b.x1 - b.x2) / 2, 2) + pow((a.y1 + a.y2 - b.y1 - b.y2) / 2, 2)) / sqrt(160 * 160 + 90 * 90) AS c
  FROM bx a JOIN bx b ON a.frame_id = b.frame_id AND a.box_id < b.box_id)
  SELECT frame_id, a, b, {r('CASE WHEN sa + sb - i > 0 THEN i / (sa + sb - i) ELSE 0 END')} AS iou, {r('c')} AS center_distance, {r('CASE WHEN sa > 0 AND sb > 0 THEN greatest(sa / sb, sb / sa) END')} AS area_ratio FROM p""")
def box_iou(spark, sf):
    b = _boxes(spark, sf)
    side = lambda s: b.select("frame_id", F.col("box_id").alias(s), F.struct("x1", "y1", "x2", "y2").alias(f"b{s}"))
    p = side("a").join(side("b"), "frame_id").where("a < b")
    return p.select("frame_id", "a", "b", G.box_iou(F.col("ba"), F.col("bb")).alias("iou"), G.center_distance(F.col("ba"), F.col("bb"), F.lit(160.0), F.lit(90.0)).alias("center_distance"), G.area_ratio(F.col("ba"), F.col("bb")).alias("area_ratio"))


@query("box_overlap3", BOX + f""", p AS (SELECT a.frame_id, a.box_id AS a, b.box_id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) * greatest(least(a.z2, b.z2) - greatest(a.z1, b.z1), 0) AS i,
    least((a.x2 - a.x1) * (a.y2 - a.y1) * (a.z2 - a.z1), (b.x2 - b.x1) * (b.y2 - b.y1) * (b.z2 - b.z1)) AS v FROM bx a JOIN bx b ON a.frame_id = b.frame_id AND a.box_id < b.box_id)
  SELECT frame_id, a, b, {r('CASE WHEN v > 0 THEN i / v ELSE 0 END')} AS overlap FROM p""")
def box_overlap3(spark, sf):
    return relations.box_overlap3(_boxes(spark, sf), "frame_id")


@query("box_clip_contact", BOX + """SELECT frame_id, box_id, least(greatest(x1, 0), 60) AS x1, least(greatest(y1, 0), 40) AS y1, least(greatest(x2, 0), 60) AS x2, least(greatest(y2, 0), 40) AS y2,
  concat_ws(',', CASE WHEN x1 <= 2 THEN 'left' END, CASE WHEN y1 <= 2 THEN 'top' END, CASE WHEN x2 >= 58 THEN 'right' END, CASE WHEN y2 >= 38 THEN 'bottom' END) AS contacts FROM bx""")
def box_clip_contact(spark, sf):
    b = _boxes(spark, sf).withColumn("b", F.struct("x1", "y1", "x2", "y2"))
    size = (F.lit(60.0), F.lit(40.0))
    return b.select("frame_id", "box_id", G.clip_box(F.col("b"), *size).alias("c"), F.concat_ws(",", G.boundary_contacts(F.col("b"), *size, 2.0)).alias("contacts")).select("frame_id", "box_id", "c.*", "contacts")


@query("depth_order_violation", BOX + f"SELECT frame_id, box_id, {r('greatest(0, z2 - z1 * 2 + 0.5) / ((z2 + z1 * 2) / 2)')} AS residual FROM bx")
def depth_order_violation(spark, sf):
    rows = _boxes(spark, sf).select("frame_id", "box_id", F.col("z2").alias("front_depth"), (F.col("z1") * 2).alias("back_depth"), F.lit(0.5).alias("uncertainty"))
    return relations.depth_order_violation(rows).select("frame_id", "box_id", "residual")


@query("bind_points", """WITH pt AS (SELECT l_suppkey AS video_id, (l_partkey % 6)::INT AS point_id, (row_number() OVER (PARTITION BY l_suppkey, l_partkey % 6 ORDER BY l_orderkey, l_linenumber) - 1)::INT AS frame_index, (l_partkey % 100)::DOUBLE AS u, (l_linenumber * 10)::DOUBLE AS v FROM lineitem),
  ob AS (SELECT 'o' || o AS object_id, o * 30.0 AS x1, o * 30.0 + 40 AS x2 FROM (SELECT unnest([0, 1, 2]) AS o)),
  ow AS (SELECT video_id, point_id, frame_index, min(object_id) AS object_id FROM pt JOIN ob ON u BETWEEN x1 AND x2 AND v BETWEEN 0 AND 60 GROUP BY ALL),
  h AS (SELECT video_id, point_id, count(DISTINCT object_id) AS owners, min(object_id) AS owner, count(*) AS owned FROM ow GROUP BY ALL),
  f AS (SELECT video_id, point_id, count(*) AS frames FROM pt GROUP BY ALL),
  s AS (SELECT *, CASE WHEN owners IS NULL THEN 'background' WHEN owners > 1 THEN 'object_assignment_switched' WHEN owned / frames < 0.6 THEN 'inconsistent' ELSE 'bound' END AS state FROM f LEFT JOIN h USING (video_id, point_id))
  SELECT video_id, point_id, CASE WHEN state = 'bound' THEN owner END AS object_id, round(coalesce(owned, 0) / frames + 1e-9::DOUBLE, 6) + 0::DOUBLE AS consistency, state FROM s""")
def bind_points(spark, sf):
    from pyspark.sql import Window

    line = table(spark, sf, "lineitem")
    line = line.repartition(parts(spark, line.count(), 100_000), "l_suppkey")
    by = Window.partitionBy("l_suppkey", F.col("l_partkey") % 6).orderBy("l_orderkey", "l_linenumber")
    points = line.select(F.col("l_suppkey").alias("video_id"), (F.col("l_partkey") % 6).cast("int").alias("point_id"), (F.row_number().over(by) - 1).cast("int").alias("frame_index"), (F.col("l_partkey") % 100).cast("double").alias("u"), (F.col("l_linenumber") * 10).cast("double").alias("v"))
    points = stored(points, "points")
    shapes = F.array(*[F.struct(F.lit(f"o{o}").alias("object_id"), F.lit(o * 30.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(o * 30.0 + 40).alias("x2"), F.lit(60.0).alias("y2")) for o in range(3)])
    boxes = points.select("video_id", "frame_index").distinct().select("video_id", "frame_index", F.explode(shapes).alias("b")).select("video_id", "frame_index", "b.*")
    return relations.bind_points(points, boxes)


def video_boxes(spark, sf):
    """Orders as frames, 32 a video, and their lines as boxes."""
    b = _boxes(spark, sf)
    return b.select((F.col("frame_id") / 32).cast("long").alias("video_id"), (F.col("frame_id") % 32).cast("int").alias("frame_index"), "box_id", (F.col("box_id") % 2).cast("string").alias("label"), "x1", "y1", "x2", "y2", F.lit(160.0).alias("width"), F.lit(90.0).alias("height"))


@query("associate_objects")
def associate_objects(spark, sf):
    return sequential.associate(video_boxes(spark, sf))


# --- records -------------------------------------------------------------------------------------

KEYS = ["sample_id", "group_id", "content_hash"]


@query("leakage_audit_source", RE + """, k AS (SELECT DISTINCT split, 'sample_id' AS key, sample_id::VARCHAR AS value FROM re UNION SELECT DISTINCT split, 'group_id', group_id::VARCHAR FROM re UNION SELECT DISTINCT split, 'content_hash', content_hash FROM re),
  o AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS n FROM k),
  p AS (SELECT a.key, a.split AS left_split, b.split AS right_split, a.value FROM o a JOIN o b ON a.key = b.key AND a.value = b.value AND a.n < b.n),
  q AS (SELECT *, row_number() OVER (PARTITION BY key, left_split, right_split ORDER BY value) AS rn FROM p)
  SELECT key, left_split, right_split, count(*) AS shared, string_agg(value, ',' ORDER BY value) FILTER (rn <= 5) AS examples FROM q GROUP BY ALL""")
def leakage_audit_source(spark, sf):
    return governance.leakage(records(spark, sf), KEYS)


@query("leakage_audit_clip", RE + """, k AS (SELECT DISTINCT split, 'clip_uid' AS key, group_id || '::c' || (sample_id % 4) AS value FROM re), o AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS n FROM k),
  p AS (SELECT a.key, a.split AS left_split, b.split AS right_split, a.value FROM o a JOIN o b ON a.key = b.key AND a.value = b.value AND a.n < b.n), q AS (SELECT *, row_number() OVER (PARTITION BY key, left_split, right_split ORDER BY value) AS rn FROM p)
  SELECT key, left_split, right_split, count(*) AS shared, string_agg(value, ',' ORDER BY value) FILTER (rn <= 5) AS examples FROM q GROUP BY ALL""")
def leakage_audit_clip(spark, sf):
    rows = records(spark, sf).withColumn("clip_uid", F.concat_ws("::c", F.col("group_id").cast("string"), (F.col("sample_id") % 4).cast("string")))
    return governance.leakage(rows, ["clip_uid"])


@query("group_cross_split", RE + "SELECT group_id, count(DISTINCT split) AS splits, count(*) AS rows FROM re GROUP BY ALL HAVING count(DISTINCT split) > 1")
def group_cross_split(spark, sf):
    return governance.groups_across_splits(records(spark, sf), "group_id")


@query("hash_split_order", RE + "SELECT group_id, count(*) AS rows, sha256('7:' || group_id) AS order_key FROM re GROUP BY ALL")
def hash_split_order(spark, sf):
    return governance.hash_order(records(spark, sf), "group_id", 7)


@query("hash_split", RE + """, h AS (SELECT group_id, count(*) AS rows, sha256('7:' || group_id) AS order_key FROM re GROUP BY ALL)
  SELECT *, CASE WHEN ('0x' || substr(order_key, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8::DOUBLE THEN 'train' WHEN ('0x' || substr(order_key, 1, 8))::BIGINT / 4294967296.0::DOUBLE < (0.8::DOUBLE + 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM h""")
def hash_split(spark, sf):
    return governance.hash_split(governance.hash_order(records(spark, sf), "group_id", 7))


@query("split_summary", RE + "SELECT split, count(*) AS samples, count(DISTINCT group_id) AS groups, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, count(*) FILTER (label IS NULL) AS unknown FROM re GROUP BY ALL")
def split_summary(spark, sf):
    return governance.split_summary(records(spark, sf))


@query("balanced_sample", RE + "SELECT sample_id, split, label FROM re WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split, label ORDER BY sha256('11:' || sample_id), sample_id) <= 20")
def balanced_sample(spark, sf):
    return governance.balanced_sample(records(spark, sf).where("label IS NOT NULL"), ["split", "label"], 20, 11).select("sample_id", "split", "label")


@query("exclusion_reasons", RE + "SELECT sample_id, concat_ws(',', CASE WHEN label IS NULL THEN 'unknown_label' END, CASE WHEN split = 'test' THEN 'held_out' END, CASE WHEN size < 50000 THEN 'too_small' END) AS reasons FROM re")
def exclusion_reasons(spark, sf):
    rules = {"unknown_label": F.col("label").isNull(), "held_out": F.col("split") == "test", "too_small": F.col("size") < 50000}
    return governance.exclusion_reasons(records(spark, sf), rules).select("sample_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("storage_estimate", RE + f"SELECT dataset, {r('sum(size)')} AS bytes, count(*) AS frames, {r('sum(size) / count(*)')} AS bytes_per_frame, {r('sum(size) / count(*) * 1000')} AS planned_bytes FROM re GROUP BY ALL")
def storage_estimate(spark, sf):
    return governance.storage_estimate(records(spark, sf).withColumn("one", F.lit(1)), ["dataset"], "size", "one", 1000)


@query("batch_single_equivalence", f"""WITH a AS (SELECT user_id, sum(value) AS v FROM events GROUP BY ALL), b AS (SELECT user_id, sum(CASE WHEN event_id % 1000 = 7 THEN value + 0.25 ELSE value END) AS v FROM events WHERE user_id % 50 <> 1 GROUP BY ALL)
  SELECT {r('max(abs(a.v - b.v))')} AS max_difference, count(*) FILTER (a.user_id IS NULL OR b.user_id IS NULL) AS unmatched, max(abs(a.v - b.v)) <= 1e-6 AND count(*) FILTER (a.user_id IS NULL OR b.user_id IS NULL) = 0 AS equal FROM a FULL JOIN b ON a.user_id = b.user_id""")
def batch_single_equivalence(spark, sf):
    """Sums by key from one pass against sums by week, of which some values are off and some keys are missing."""
    e = table(spark, sf, "events")
    one = e.groupBy("user_id").agg(F.sum("value").alias("v"))
    off = e.where("user_id % 50 <> 1").withColumn("value", F.when(F.col("event_id") % 1000 == 7, F.col("value") + 0.25).otherwise(F.col("value")))
    two = off.groupBy("user_id", F.weekofyear("ts").alias("w")).agg(F.sum("value").alias("v")).groupBy("user_id").agg(F.sum("v").alias("v"))
    return governance.max_difference(one, two, ["user_id"], "v")


@query("duplicates_exact", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicates_exact(spark, sf):
    return governance.exact_duplicates(table(spark, sf, "documents"), "text", "doc_id")


@query("pk_violations", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")
def pk_violations(spark, sf):
    return governance.key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("fk_violations", "SELECT doc_id AS missing_key, count(*) AS rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL")
def fk_violations(spark, sf):
    return governance.reference_violations(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id")


@query("scene_segments", f"""WITH f AS (SELECT conv_id, turn AS frame_index, length(text) / 1000.0::DOUBLE AS signature FROM conversations),
  c AS (SELECT *, sum(CASE WHEN abs(signature - s0) >= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY frame_index) AS scene FROM (SELECT *, lag(signature) OVER (PARTITION BY conv_id ORDER BY frame_index) AS s0 FROM f))
  SELECT conv_id, scene::BIGINT AS scene, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frames FROM c GROUP BY ALL""")
def scene_segments(spark, sf):
    f = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("frame_index"), (F.length("text") / 1000.0).alias("signature"))
    return windows.scene_segments(f, "conv_id", 0.05)


@query("label_normalization", r"SELECT p_partkey, regexp_replace(lower(trim(p_type)), '[\s_]+', '_', 'g') AS label, 'prior_' || substr(sha256(regexp_replace(lower(trim(p_type)), '[\s_]+', '_', 'g') || '|' || p_brand), 1, 20) AS stable_id FROM part")
def label_normalization(spark, sf):
    label = G.normalize_label(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", label.alias("label"), G.stable_id("prior_", label, F.col("p_brand")).alias("stable_id"))


# --- metrics ---------------------------------------------------------------------------------------

M = f"""{r('(tp + tn) / greatest(tp + tn + fp + fn, 1)')} AS accuracy, {r('tp / greatest(tp + fp, 1)')} AS precision, {r('tp / greatest(tp + fn, 1)')} AS recall, {r('tn / greatest(tn + fp, 1)')} AS specificity,
  {r('2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12)')} AS f1"""


@query("confusion", PR + f", c AS (SELECT lang, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM pr GROUP BY ALL) SELECT lang, tp, tn, fp, fn, {M} FROM c")
def confusion(spark, sf):
    return metrics.confusion(predictions(spark, sf), ["lang"])


CURVE = PR + """, st AS (SELECT lang, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM pr GROUP BY ALL),
cu AS (SELECT lang, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY lang) AS pos, sum(n) OVER (PARTITION BY lang) AS neg FROM st WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
al AS (SELECT lang, score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (neg - fp)::BIGINT AS tn, (pos - tp)::BIGINT AS fn FROM cu UNION ALL SELECT lang, NULL, 0, 0, max(neg)::BIGINT, max(pos)::BIGINT FROM cu GROUP BY ALL)
"""


@query("roc_curve", CURVE + f"SELECT lang, threshold, {r('fp / greatest(fp + tn, 1)')} AS false_positive_rate, {r('tp / greatest(tp + fn, 1)')} AS true_positive_rate, tp, tn, fp, fn FROM al")
def roc_curve(spark, sf):
    return metrics.roc_curve(predictions(spark, sf), ["lang"])


@query("pr_curve", CURVE + f"SELECT lang, threshold, {r('tp / greatest(tp + fn, 1)')} AS recall, {r('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END')} AS precision, tp, tn, fp, fn FROM al")
def pr_curve(spark, sf):
    return metrics.pr_curve(predictions(spark, sf), ["lang"])


@query("threshold_curve", PR + f""", t AS (SELECT DISTINCT lang, score AS threshold FROM pr UNION SELECT lang, unnest([0.0, 0.5, 1.0])::DOUBLE FROM (SELECT DISTINCT lang FROM pr)),
  c AS (SELECT t.lang, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM t JOIN pr ON t.lang = pr.lang GROUP BY ALL)
  SELECT lang, {r('threshold')} AS threshold, {M} FROM c""")
def threshold_curve(spark, sf):
    return metrics.threshold_curve(predictions(spark, sf), ["lang"])


@query("auc", CURVE + f""", a AS (SELECT *, fp / greatest(fp + tn, 1) AS x, tp / greatest(tp + fn, 1) AS y, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS q FROM al),
  b AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(q) OVER w AS q0 FROM a WINDOW w AS (PARTITION BY lang ORDER BY threshold DESC NULLS FIRST))
  SELECT lang, {r('CASE WHEN max(fn + tp) > 0 AND max(fp + tn) > 0 THEN sum((x - x0) * (y + y0) / 2) END')} AS roc_auc, {r('CASE WHEN max(fn + tp) > 0 AND max(fp + tn) > 0 THEN sum((y - y0) * (q + q0) / 2) END')} AS pr_auc FROM b GROUP BY ALL""")
def auc(spark, sf):
    return metrics.auc(predictions(spark, sf), ["lang"])
