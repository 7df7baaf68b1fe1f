"""Queries over metric sizes of single objects and sizes calibrated by anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import scale
from tessella.session import parts, stored

from .adapters import OB, objects
from .evidence3d_queries import MASK, _depth, _mask
from .registry import query, r

KEY = ["object_id"]
_RAY = "object_id % 3 = 0"
PX = MASK + f""", px AS (SELECT m.object_id, m."row", m.col, z, CASE WHEN (m."row" + m.col) % 5 <> 1 THEN ((m."row" * 3 + m.col) % 10) / 10.0::DOUBLE END AS conf, 20.0::DOUBLE + m.object_id % 5 AS fx, 21.0::DOUBLE AS fy, 12.0::DOUBLE AS cx, 11.0::DOUBLE AS cy, m.{_RAY} AS ray, (m.object_id % 10) / 10.0::DOUBLE AS dq
   FROM m JOIN dz ON dz.object_id = m.object_id AND dz."row" = m."row" AND dz.col = m.col),
 zz AS (SELECT *, CASE WHEN z > 0 AND (object_id + "row") % 4 > 0 AND object_id % 37 <> 5 THEN CASE WHEN ray THEN z / sqrt(1 + pow((col - cx) / fx, 2) + pow(("row" - cy) / fy, 2)) ELSE z END END AS d FROM px),
 xy AS (SELECT *, (col - cx) * d / fx AS x, ("row" - cy) * d / fy AS y FROM zz),
 ag AS (SELECT object_id, count(*) AS n, count(d) AS points, median(d) AS depth, median(conf) FILTER (d IS NOT NULL) AS mc, any_value(dq) AS dq, any_value(fx) AS fx, any_value(fy) AS fy, max("row") FILTER (d IS NOT NULL) - min("row") FILTER (d IS NOT NULL) + 1 AS h, max(col) FILTER (d IS NOT NULL) - min(col) FILTER (d IS NOT NULL) + 1 AS w,
   {', '.join(f"quantile_cont({a}, {p}) AS {b}{n}" for a, b in (('x', 'x'), ('y', 'y'), ('d', 'z')) for n, p in (('l', 0.05), ('h', 0.95)))}, median(x) AS mx, median(y) AS my, median(d) AS mz FROM xy GROUP BY object_id),
 md AS (SELECT object_id, median(abs(x - mx)) AS dx, median(abs(y - my)) AS dy, median(abs(d - mz)) AS dd FROM xy JOIN ag USING (object_id) GROUP BY object_id)
"""
_CLOUD = "SELECT object_id, xh - xl AS ex, yh - yl AS ey, zh - zl AS ez, depth, CASE WHEN points > 0 THEN coalesce(mc, dq) ELSE 0 END AS dc, points, points / n AS vr, sqrt(dx * dx + dy * dy + dd * dd) / greatest(sqrt(pow(xh - xl, 2) + pow(yh - yl, 2) + pow(zh - zl, 2)), 1e-12) AS un FROM ag JOIN md USING (object_id)"
_BOX = "SELECT object_id, w * depth / fx AS ex, h * depth / fy AS ey, zh - zl AS ez, depth, CASE WHEN points > 0 THEN coalesce(mc, dq) ELSE 0 END AS dc, points, points / n AS vr, greatest(0, zh - zl) / greatest(depth, 1e-12) AS un FROM ag"


def _regions(spark, sf):
    c = F.col
    conf = F.when((c("row") + c("col")) % 5 != 1, (c("row") * 3 + c("col")) % 10 / 10.0)
    z = F.when(((c("object_id") + c("row")) % 4 > 0) & (c("object_id") % 37 != 5), c("z")).otherwise(F.lit(float("nan")))
    pixels = _mask(spark, sf).join(_depth(spark, sf), ["object_id", "row", "col"]).select("object_id", "row", "col", z.alias("z"), conf.alias("confidence"))
    cameras = _mask(spark, sf).select("object_id").distinct().select("object_id", (20.0 + c("object_id") % 5).alias("fx"), F.lit(21.0).alias("fy"), F.lit(12.0).alias("cx"), F.lit(11.0).alias("cy"), F.expr(_RAY).alias("ray"), (c("object_id") % 10 / 10.0).alias("depth_quality"))
    return pixels, cameras


_SHOW = f"{r('ex')} AS x_extent, {r('ey')} AS y_extent, {r('ez')} AS z_extent, {r('depth')} AS depth, {r('dc')} AS depth_confidence, points, {r('vr')} AS valid_ratio, {r('CASE WHEN points > 0 THEN un END')} AS uncertainty, CASE WHEN points > 0 THEN '' ELSE 'no_valid_metric_depth_in_object' END AS failure"


@query("projected_extent", PX + f"SELECT object_id, {_SHOW} FROM ({_BOX})")
def projected_extent(spark, sf):
    return scale.region_extents(*_regions(spark, sf), KEY, cloud=False)


@query("pointcloud_extent", PX + f"SELECT object_id, {_SHOW} FROM ({_CLOUD})")
def pointcloud_extent(spark, sf):
    return scale.region_extents(*_regions(spark, sf), KEY, cloud=True)


#: One gate each in objects of their own; the others pass.
_OBJECT = {
    "object_status": "CASE object_id % 31 WHEN 1 THEN 'provider_failed' WHEN 2 THEN 'blocked' ELSE 'ok' END", "depth_status": "CASE object_id % 31 WHEN 3 THEN 'provider_failed' ELSE 'ok' END", "depth_type": "CASE object_id % 31 WHEN 4 THEN 'relative' ELSE 'metric' END",
    "depth_unit": "CASE object_id % 31 WHEN 5 THEN 'feet' ELSE 'meter' END", "scale_status": "CASE object_id % 31 WHEN 6 THEN 'invalid' ELSE 'estimated' END", "depth_definition": "CASE object_id % 31 WHEN 7 THEN 'unknown' ELSE 'z_depth' END", "has_depth": "object_id % 31 <> 8", "camera_valid": "object_id % 31 <> 9",
    "intrinsics_source": "CASE object_id % 31 WHEN 10 THEN ' Approximated' ELSE 'calibrated' END", "detection": "CASE object_id % 31 WHEN 11 THEN 0.2 ELSE 0.9 END", "severe_truncation": "object_id % 31 = 12", "out_of_frame": "CASE object_id % 31 WHEN 13 THEN 0.3 ELSE 0.0 END", "has_region": "object_id % 31 <> 14",
    "depth_quality": "(object_id % 10) / 10.0", "camera_quality": "0.8", "height_ok": "object_id % 4 <> 1", "width_ok": "object_id % 5 <> 1", "length_ok": "object_id % 6 <> 1",
}
_PRIORS = {"bottle": [("height_m", [(2.0, 3.0), (5.0, 6.0)], 0.9), ("width_m", [(1.0, 2.5)], 0.7)], "car": [("length_m", [(3.0, 4.0)], 0.6), ("extent_m", [(0.5, 1.0), (9.0, 12.0)], 0.4)]}
_CLASS = "CASE object_id % 3 WHEN 0 THEN 'bottle' WHEN 1 THEN 'car' ELSE CASE WHEN object_id % 2 = 0 THEN 'thing' ELSE 'bottle' END END"


def _metric_sql() -> str:
    value = {"height_m": ("ey", "height_ok"), "width_m": ("ex", "width_ok"), "length_m": ("ez", "length_ok"), "extent_m": ("greatest(ex, ey, ez)", "height_ok OR width_ok OR length_ok")}
    rows = []
    for name, priors in _PRIORS.items():
        for d, intervals, conf in priors:
            v, ok = value[d]
            distance = "least(" + ", ".join(f"greatest(0, ln({a}) - ln({v}), ln({v}) - ln({b}))" for a, b in intervals) + ")"
            rows.append(f"SELECT object_id, '{d}' AS dim, {distance} AS dist, {conf}::DOUBLE AS pc FROM o WHERE cls = '{name}' AND ({ok}) AND {v} > 0")
    gates = ["object_provider_failed", "provider_not_ready", "metric_depth_provider_failed", "metric_scale_unavailable", "metric_depth_unit_not_meter", "metric_scale_status_unavailable", "unknown_depth_definition", "missing_metric_depth_map", "missing_camera_intrinsics", "approximated_intrinsics_not_allowed", "low_object_detection_confidence", "severe_object_truncation", "object_largely_out_of_frame", "invalid_object_region"]
    return PX + f""", o AS (SELECT e.*, {', '.join(f'{x} AS {k}' for k, x in _OBJECT.items() if k.endswith('_ok'))}, {_CLASS} AS cls FROM ({_CLOUD}) e),
 j AS ({' UNION ALL '.join(rows)}), a AS (SELECT object_id, max(dist) AS residual, min(pc) AS pc, string_agg(dim, ',' ORDER BY dim) AS dims FROM j GROUP BY ALL),
 x AS (SELECT *, CASE {' '.join(f"WHEN object_id % 31 = {i + 1} THEN '{g}'" for i, g in enumerate(gates))} WHEN cls = 'thing' THEN 'missing_physical_scale_prior' WHEN points = 0 THEN 'no_valid_metric_depth_in_object' WHEN vr < 0.5 THEN 'insufficient_valid_metric_depth_ratio' WHEN dc < 0.3 THEN 'low_metric_depth_confidence' WHEN points < 20 THEN 'insufficient_pointcloud_support'
   WHEN dims IS NULL THEN 'no_observable_dimension_with_physical_prior' ELSE '' END AS reason FROM o LEFT JOIN a USING (object_id))
 SELECT object_id, {r("CASE WHEN reason = '' THEN residual END")} AS residual, {r("CASE WHEN reason = '' THEN least(0.9, (object_id % 10) / 10.0, 0.8, dc, pc) ELSE 0 END")} AS confidence, {r("CASE WHEN reason = '' THEN un END")} AS uncertainty, CASE WHEN reason = '' THEN dims ELSE '' END AS dimensions,
  CASE WHEN object_id % 31 IN (1, 3) THEN 'provider_failed' WHEN object_id % 31 BETWEEN 1 AND 14 THEN 'blocked' ELSE 'ok' END AS provider_status, reason FROM x"""


@query("metric_single_object", _metric_sql())
def metric_single_object(spark, sf):
    pixels, cameras = _regions(spark, sf)
    extents = scale.region_extents(pixels, cameras, KEY, cloud=True)
    of = cameras.select("object_id", F.expr(_CLASS).alias("class_name"), *[(F.expr(x).cast("double") if k in ("detection", "out_of_frame", "depth_quality", "camera_quality") else F.expr(x)).alias(k) for k, x in _OBJECT.items()])
    priors = spark.createDataFrame([(name, d, [{"low": a, "high": b} for a, b in i], conf) for name, p in _PRIORS.items() for d, i, conf in p], "class_name string, dimension string, intervals array<struct<low:double,high:double>>, confidence double")
    return scale.metric_scale(of, extents, priors, KEY, cloud=True)


@query("anchored_size", OB + f""", o AS (SELECT frame_id, object_id, max(CASE WHEN (frame_id + object_id) % 13 <> 3 THEN depth / 10.0::DOUBLE END) AS scale, (frame_id + object_id) % 17 <> 4 AS valid, CASE WHEN (frame_id + 2 * object_id) % 11 = 5 THEN 'metric_3d' ELSE 'relative_3d' END AS st, CASE WHEN (frame_id + 3 * object_id) % 7 <> 2 THEN 2.0 + object_id END::DOUBLE AS low, 4.0::DOUBLE + object_id AS high, ((frame_id * 3 + object_id) % 10 + 1) / 10.0::DOUBLE AS q FROM ob GROUP BY ALL),
 an AS (SELECT DISTINCT a.frame_id, a.object_id, b.object_id AS anchor_id FROM o a JOIN o b USING (frame_id) WHERE CASE WHEN a.frame_id % 9 = 1 THEN b.object_id = a.object_id OR b.object_id < a.object_id ELSE b.object_id < a.object_id END),
 f AS (SELECT an.frame_id, an.object_id, count(*) AS given, max((anchor_id = an.object_id)::INT) AS self, median(CASE WHEN ok THEN 0.5 * (low + high) / scale END) AS sc, count(*) FILTER (ok) AS n, avg(q) FILTER (ok) AS aq FROM an JOIN (SELECT *, coalesce(valid AND scale > 0 AND st = 'relative_3d' AND low IS NOT NULL, false) AS ok FROM o) o ON o.frame_id = an.frame_id AND o.object_id = anchor_id GROUP BY ALL),
 x AS (SELECT o.*, coalesce(n, 0) AS n, sc, aq, CASE WHEN NOT coalesce(valid AND scale IS NOT NULL, false) THEN 'invalid_object_scale' WHEN given IS NULL THEN 'no_independent_scale_anchor' WHEN self = 1 THEN 'anchor_self_evaluation_forbidden' WHEN o.frame_id % 8 = 2 THEN 'anchor_independence_not_established' WHEN st <> 'relative_3d' THEN 'relative_calibration_requires_relative_3d'
   WHEN low IS NULL THEN 'missing_or_unreliable_physical_prior' WHEN coalesce(n, 0) = 0 THEN 'no_valid_independent_scale_anchor' ELSE '' END AS reason FROM o LEFT JOIN f USING (frame_id, object_id))
 SELECT frame_id, object_id, {r("CASE WHEN reason = '' THEN greatest(low - scale * sc, 0, scale * sc - high) END")} AS residual, {r("CASE WHEN reason = '' THEN least(q, aq) ELSE 0 END")} AS quality, {r("CASE WHEN reason = '' THEN sc END")} AS scene_scale, CASE WHEN reason = '' THEN n ELSE 0 END AS anchors, reason FROM x""")
def anchored_size(spark, sf):
    c = F.col
    f, i = c("frame_id"), c("object_id")
    size = F.when((f + i) % 13 != 3, c("depth").cast("double") / 10.0)
    o = objects(spark, sf).groupBy("frame_id", "object_id").agg(F.max(size).alias("scale"))
    o = o.select("frame_id", "object_id", ((f + i) % 17 != 4).alias("valid"), F.coalesce("scale", F.lit(float("nan"))).alias("scale"), F.when((f + 2 * i) % 11 == 5, "metric_3d").otherwise("relative_3d").alias("scale_status"), F.when((f + 3 * i) % 7 != 2, (2.0 + i).cast("double")).alias("low"), (4.0 + i).cast("double").alias("high"), (((f * 3 + i) % 10 + 1) / 10.0).alias("quality"))
    o = stored(o, "objects")
    n = parts(spark, o.count(), 50_000)
    other = o.select("frame_id", i.alias("anchor_id")).repartition(n, "frame_id")
    anchors = o.select("frame_id", "object_id").repartition(n, "frame_id").join(other, "frame_id").where((c("anchor_id") < i) | ((f % 9 == 1) & (c("anchor_id") == i)))
    return scale.anchored_size(o, o.select("frame_id", "object_id", (f % 8 != 2).alias("independent")), anchors, ["frame_id"])
