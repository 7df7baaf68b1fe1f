"""Queries over rasters: masks and frames made of order lines, a supplier each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import raster
from tessella.session import parts, stored

from .adapters import table
from .evidence3d_queries import MASK, SIDE, _mask
from .registry import query, r

KEY = ["object_id"]

#: Masks with an inside: a disc of the supplier's radius with some pixels of its lines punched out.
BLOB = f"""WITH RECURSIVE s AS (SELECT DISTINCT l_suppkey AS object_id FROM lineitem), hole AS (SELECT DISTINCT l_suppkey AS object_id, (l_partkey % {SIDE})::INT AS "row", (l_orderkey % {SIDE})::INT AS col FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 40),
 d AS (SELECT object_id, a::INT AS "row", b::INT AS col FROM s, range({SIDE}) x(a), range({SIDE}) y(b) WHERE (a - 11) * (a - 11) + (b - 9 - object_id % 5) * (b - 9 - object_id % 5) <= (object_id % 7 + 5) * (object_id % 7 + 5)),
 m AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM hole WHERE hole.object_id = d.object_id AND hole."row" = d."row" AND hole.col = d.col))
"""


def blobs(spark, sf):
    line = table(spark, sf, "lineitem")
    hole = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 40), (F.col("l_partkey") % SIDE * SIDE + F.col("l_orderkey") % SIDE).cast("int"))
    # One row a supplier, with its holes, until the disc is drawn.
    own = stored(line.groupBy(F.col("l_suppkey").alias("object_id")).agg(F.collect_set(hole).alias("holes")).where("object_id IS NOT NULL"), "discs")
    own = own.repartition(parts(spark, own.count(), 500), "object_id")
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = own.select("*", F.explode(side).alias("row")).select("*", F.explode(side).alias("col"))
    radius, middle = F.col("object_id") % 7 + 5, 9 + F.col("object_id") % 5
    disc = grid.where((F.col("row") - 11) * (F.col("row") - 11) + (F.col("col") - middle) * (F.col("col") - middle) <= radius * radius)
    return disc.where(~F.array_contains("holes", F.col("row") * SIDE + F.col("col"))).select("object_id", "row", "col")


@query("mask_erosion", BLOB + f""", e AS (SELECT object_id, greatest(1, least(4, round_even(0.02::DOUBLE * sqrt(count(*)), 0)))::INT AS e FROM m GROUP BY ALL)
 SELECT a.object_id, a."row", a.col FROM m a JOIN e USING (object_id) JOIN m b ON b.object_id = a.object_id AND abs(b."row" - a."row") <= e AND abs(b.col - a.col) <= e GROUP BY a.object_id, a."row", a.col, e
 HAVING count(*) = (least(a."row" + e, {SIDE - 1}) - greatest(a."row" - e, 0) + 1) * (least(a.col + e, {SIDE - 1}) - greatest(a.col - e, 0) + 1)""")
def mask_erosion(spark, sf):
    m = blobs(spark, sf)
    area = m.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_area"))
    return raster.erode(m.join(area, KEY), KEY, raster.adaptive_erosion(F.col("_area")), SIDE, SIDE)


@query("mask_erosion_noise", MASK + f"""SELECT a.object_id, a."row", a.col FROM m a JOIN m b ON b.object_id = a.object_id AND abs(b."row" - a."row") <= 1 AND abs(b.col - a.col) <= 1 GROUP BY ALL
 HAVING count(*) = (least(a."row" + 1, {SIDE - 1}) - greatest(a."row" - 1, 0) + 1) * (least(a.col + 1, {SIDE - 1}) - greatest(a.col - 1, 0) + 1)""")
def mask_erosion_noise(spark, sf):
    return raster.erode(_mask(spark, sf), KEY, 1, SIDE, SIDE)


@query("edge_distance", BLOB + f""", o AS (SELECT object_id, a::INT AS r, b::INT AS c FROM s, range({SIDE}) x(a), range({SIDE}) y(b) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.object_id = s.object_id AND m."row" = a AND m.col = b))
 SELECT m.object_id, m."row", m.col, min(abs(m."row" - r) + abs(m.col - c))::INT AS distance FROM m JOIN o USING (object_id) GROUP BY ALL""")
def edge_distance(spark, sf):
    return raster.edge_distance(blobs(spark, sf), KEY, SIDE, SIDE)


#: Edges as "row, col, side" and the edge that follows.
_AT = "EXISTS (SELECT 1 FROM m n WHERE n.object_id = m.object_id AND n.\"row\" = m.\"row\" + {0} AND n.col = m.col + {1})"


def _edges_sql() -> str:
    parts = []
    for side, (dr, dc) in enumerate(raster._BEYOND):
        ar, ac = raster._BEYOND[(side + 1) % 4]
        corner, ahead = _AT.format(dr + ar, dc + ac), _AT.format(ar, ac)
        e = lambda r_, c_, s_: f"((m.\"row\" + {r_})::BIGINT * 2147483648 + m.col + {c_}) * 4 + {s_}"
        parts.append(f"SELECT object_id, {e(0, 0, side)} AS e, CASE WHEN {corner} THEN {e(dr + ar, dc + ac, (side + 3) % 4)} WHEN {ahead} THEN {e(ar, ac, side)} ELSE {e(0, 0, (side + 1) % 4)} END AS nxt FROM m WHERE NOT {_AT.format(dr, dc)}")
    return " UNION ALL ".join(parts)


@query("contour_trace", BLOB + f""", ed AS MATERIALIZED ({_edges_sql()}),
 w AS (SELECT object_id, e AS loop, e, nxt, 0::BIGINT AS place FROM ed UNION ALL SELECT w.object_id, loop, ed.e, ed.nxt, place + 1 FROM w JOIN ed ON ed.object_id = w.object_id AND ed.e = w.nxt WHERE w.nxt > loop),
 full_ AS (SELECT object_id, loop, max(place) + 1 AS length FROM w GROUP BY ALL HAVING arg_max(nxt, place) = loop)
 SELECT object_id, ((e // 4) // 2147483648)::INT AS "row", ((e // 4) % 2147483648)::INT AS col, (e % 4)::INT AS side, loop, place, length FROM w JOIN full_ USING (object_id, loop)""")
def contour_trace(spark, sf):
    return raster.trace_contours(blobs(spark, sf), KEY)


@query("contour_samples")
def contour_samples(spark, sf):
    return raster.sample_contour(blobs(spark, sf), KEY)


_PTS = f"""WITH RECURSIVE p AS (SELECT l_suppkey AS object_id, l_orderkey * 10 + l_linenumber AS point_id, max(l_partkey % {SIDE})::DOUBLE AS "row", max(l_orderkey % {SIDE})::DOUBLE AS col, max(l_extendedprice)::DOUBLE AS score FROM lineitem GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, point_id) AS n FROM p),
"""


@query("spaced_points", _PTS + """ k AS (SELECT object_id, n, [{'i': point_id, 'r': "row", 'c': col}] AS kept FROM o WHERE n = 1 UNION ALL
  SELECT k.object_id, o.n, CASE WHEN len(list_filter(kept, lambda q: (q.r - o."row") * (q.r - o."row") + (q.c - o.col) * (q.c - o.col) < 25)) = 0 THEN list_append(kept, {'i': o.point_id, 'r': o."row", 'c': o.col}) ELSE kept END FROM k JOIN o ON o.object_id = k.object_id AND o.n = k.n + 1),
 f AS (SELECT object_id, arg_max(kept, n) AS kept FROM k GROUP BY object_id), u AS (SELECT object_id, unnest(kept) AS q, generate_subscripts(kept, 1) - 1 AS place FROM f)
 SELECT object_id, q.i AS point_id, place::INT AS place FROM u WHERE place < 12""")
def spaced_points(spark, sf):
    line = table(spark, sf, "lineitem")
    n = lambda c: F.max(c).cast("double")
    points = line.groupBy(F.col("l_suppkey").alias("object_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id")).agg(n(F.col("l_partkey") % SIDE).alias("row"), n(F.col("l_orderkey") % SIDE).alias("col"), n("l_extendedprice").alias("score"))
    return raster.spaced_points(points, KEY, 5.0, most=12).select("object_id", "point_id", "place")


#: A shift, a turn about the middle, a turn of the camera, a stretch and a singular map.
_TURN = (0.8, -0.6, 8.0, 0.6, 0.8, -5.0, 0.0, 0.0, 1.0)
_MAPS = [(1.0, 0.0, 2.6, 0.0, 1.0, -1.4, 0.0, 0.0, 1.0), _TURN, (0.9, 0.1, 1.0, -0.1, 0.9, 2.0, 0.004, -0.003, 1.0), (1.5, 0.0, -4.0, 0.0, 0.7, 3.0, 0.0, 0.0, 1.0), (1.0, 2.0, 0.0, 2.0, 4.0, 0.0, 0.0, 0.0, 1.0)]


def _warp_sql() -> str:
    import numpy as np

    rows = []
    for i, m in enumerate(_MAPS):
        a = np.array(m).reshape(3, 3)
        if abs(np.linalg.det(a)) > 1e-12:
            rows.append(f"({i}, [{', '.join(f'{x!r}::DOUBLE' for x in (np.linalg.inv(a)).ravel().tolist())}])")
    return BLOB + f""", v AS (SELECT * FROM (VALUES {', '.join(rows)}) t(k, i)),
 t AS (SELECT object_id, a::INT AS "row", b::INT AS col, i[7] * b + i[8] * a + i[9] AS w, i FROM s JOIN v ON v.k = object_id % {len(_MAPS)}, range({SIDE}) x(a), range({SIDE}) y(b)),
 q AS (SELECT object_id, "row", col, floor((i[4] * col + i[5] * "row" + i[6]) / w + 0.5)::INT AS sr, floor((i[1] * col + i[2] * "row" + i[3]) / w + 0.5)::INT AS sc FROM t WHERE abs(w) > 1e-12)
 SELECT q.object_id, q."row", q.col FROM q JOIN m ON m.object_id = q.object_id AND m."row" = sr AND m.col = sc"""


@query("mask_warp", _warp_sql())
def mask_warp(spark, sf):
    maps = F.array(*[F.array(*[F.lit(x) for x in m]) for m in _MAPS])
    m = blobs(spark, sf).withColumn("matrix", F.get(maps, (F.col("object_id") % len(_MAPS)).cast("int")))
    return raster.warp(m, KEY, "matrix", SIDE, SIDE)


_MODE = "list_extract(['static_camera_3d', 'rotation_compensated', 'full_se3_3d', 'unavailable', 'rotation_compensated'], ((video_id + object_id) % 5 + 1)::INT)"
#: A turn whose pixels never fall between two.
_R = (0.8196480178454795, -0.5728674601004813, 6.013, 0.5728674601004813, 0.8196480178454795, -2.017)
SUPPORTS = f"""WITH m AS (SELECT DISTINCT l_suppkey AS video_id, l_linenumber AS object_id, (l_orderkey % 9)::INT AS frame_index, (l_partkey % 20)::INT AS "row", (l_quantity % 20)::INT AS col FROM lineitem),
 ob AS (SELECT DISTINCT video_id, object_id, {_MODE} AS mode, CASE WHEN video_id % 7 = 3 THEN 1.5::DOUBLE END AS mu, CASE WHEN video_id % 7 = 3 THEN -0.5::DOUBLE END AS mv, (video_id + object_id) % 5 = 1 AS rot, video_id % 11 <> 5 AS has FROM m),
 c AS (SELECT *, row_number() OVER (PARTITION BY video_id, object_id ORDER BY frame_index DESC) AS rn FROM (SELECT video_id, object_id, frame_index, avg(col) AS u, avg("row") AS v, count(*) AS area FROM m WHERE (video_id * 3 + object_id + frame_index) % 6 < 2 GROUP BY ALL)),
 t AS (SELECT ob.*, coalesce(h.n, 0)::INT AS history, a.frame_index AS f1, a.area, coalesce(mu, a.u - b.u) * (10 - a.frame_index) / (a.frame_index - b.frame_index) AS su, coalesce(mv, a.v - b.v) * (10 - a.frame_index) / (a.frame_index - b.frame_index) AS sv,
   least((a.frame_index * 7 % 10 + 1) / 10.0::DOUBLE, (b.frame_index * 7 % 10 + 1) / 10.0::DOUBLE) AS q, a.frame_index % 5 = 0 OR b.frame_index % 5 = 0 AS lg
   FROM ob LEFT JOIN c a ON a.video_id = ob.video_id AND a.object_id = ob.object_id AND a.rn = 1 LEFT JOIN c b ON b.video_id = ob.video_id AND b.object_id = ob.object_id AND b.rn = 2 LEFT JOIN (SELECT video_id, object_id, least(2, count(*)) AS n FROM c GROUP BY ALL) h ON h.video_id = ob.video_id AND h.object_id = ob.object_id),
 pj AS (SELECT video_id, object_id, count(*) AS n FROM m WHERE frame_index = 4 AND video_id % 3 > 0 GROUP BY ALL),
 w AS (SELECT t.video_id, t.object_id, CASE WHEN rot THEN {_R[0]} * (x - {_R[2]}) + {_R[3]} * (y - {_R[5]}) ELSE x END - su AS sx, CASE WHEN rot THEN {_R[1]} * (x - {_R[2]}) + {_R[4]} * (y - {_R[5]}) ELSE y END - sv AS sy, f1 FROM t, (SELECT unnest(range(20))::DOUBLE AS x), (SELECT unnest(range(20))::DOUBLE AS y) WHERE history = 2 AND mode NOT IN ('unavailable', 'full_se3_3d')),
 s AS (SELECT w.video_id, w.object_id, count(*) AS n FROM w JOIN m ON m.video_id = w.video_id AND m.object_id = w.object_id AND m.frame_index = f1 AND m.col = floor(sx + 0.5) AND m."row" = floor(sy + 0.5) GROUP BY ALL),
 x AS (SELECT t.*, coalesce(CASE WHEN mode = 'full_se3_3d' THEN pj.n ELSE s.n END, 0) AS n,
   CASE WHEN history = 0 THEN 'missing_mask_history' WHEN mode = 'unavailable' THEN 'dynamic_geometry_unavailable' WHEN history < 2 THEN 'insufficient_mask_history' WHEN mode = 'full_se3_3d' AND NOT has THEN 'full_se3_support_projector_unavailable' WHEN mode = 'full_se3_3d' AND pj.n IS NULL THEN 'invalid_full_se3_projected_support'
    WHEN mode <> 'full_se3_3d' AND s.n IS NULL THEN 'predicted_support_outside_frame' ELSE '' END AS reason FROM t LEFT JOIN s USING (video_id, object_id) LEFT JOIN pj USING (video_id, object_id))
 SELECT video_id, object_id, history, CASE WHEN reason <> '' THEN '' WHEN mode = 'full_se3_3d' THEN '{raster.PROJECTED}' WHEN rot THEN '{raster.TURNED}' WHEN mode = 'rotation_compensated' THEN '{raster.UNTURNED}' ELSE '{raster.TRANSLATED}' END AS method,
  CASE WHEN reason = '' THEN area END AS predicted_area, CASE WHEN reason = '' THEN n END AS support_area, {r("CASE WHEN reason = '' THEN least(1, n / area) END")} AS in_frame_ratio, {r("CASE WHEN reason <> '' THEN 0 WHEN lg THEN least(q, 0.25) ELSE q END")} AS quality, reason FROM x"""


@query("support_modes", SUPPORTS)
def support_modes(spark, sf):
    c = F.col
    keys = ["video_id", "object_id"]
    masks = table(spark, sf, "lineitem").select(c("l_suppkey").alias("video_id"), c("l_linenumber").alias("object_id"), (c("l_orderkey") % 9).cast("int").alias("frame_index"), (c("l_partkey") % 20).cast("int").alias("row"), (c("l_quantity") % 20).cast("int").alias("col")).distinct()
    frames = masks.select(*keys, "frame_index").distinct().where((c("video_id") * 3 + c("object_id") + c("frame_index")) % 6 < 2)
    frames = frames.withColumn("confidence", (c("frame_index") * 7 % 10 + 1) / 10.0).withColumn("legacy", c("frame_index") % 5 == 0)
    names = F.array(*[F.lit(x) for x in ("static_camera_3d", "rotation_compensated", "full_se3_3d", "unavailable", "rotation_compensated")])
    place = (c("video_id") + c("object_id")) % 5
    prior = c("video_id") % 7 == 3
    objects = masks.select(*keys).distinct().select(
        *keys, F.lit(10).alias("target_frame"), F.get(names, place.cast("int")).alias("mode"), F.when(prior, F.lit(1.5)).alias("motion_u"), F.when(prior, F.lit(-0.5)).alias("motion_v"), F.when(place == 1, F.array(*[F.lit(x) for x in _R])).alias("rotation"), (c("video_id") % 11 != 5).alias("has_projection")
    )
    projected = masks.where("frame_index = 4 AND video_id % 3 > 0").select(*keys, "row", "col")
    return raster.predict_supports(masks, frames, objects, projected, keys, 20, 20)[0]


@query("frame_hash", f"""WITH p AS (SELECT l_suppkey AS object_id, l_partkey % {SIDE} AS "row", l_orderkey % 20 AS col, max(l_quantity) AS gray FROM lineitem GROUP BY ALL),
 w AS (SELECT object_id, gray, i, j, greatest(0, least(("row" + 1) * 8 / {SIDE}::DOUBLE, i + 1) - greatest("row" * 8 / {SIDE}::DOUBLE, i)) * greatest(0, least((col + 1) * 9 / 20::DOUBLE, j + 1) - greatest(col * 9 / 20::DOUBLE, j)) AS w FROM p, range(8) a(i), range(9) b(j)),
 c AS (SELECT object_id, i, j, round(sum(gray * w), 9) AS v FROM w GROUP BY ALL), n AS (SELECT object_id, i, j, v, lead(v) OVER (PARTITION BY object_id, i ORDER BY j) AS nxt FROM c)
 SELECT object_id, right((bit_or(CASE WHEN nxt > v THEN (1::UBIGINT << (8 * (7 - i) + 7 - j)::INT) ELSE 0::UBIGINT END)::BIT::VARCHAR), 64) AS bits FROM n WHERE j < 8 GROUP BY ALL""")
def frame_hash(spark, sf):
    line = table(spark, sf, "lineitem")
    frames = line.groupBy(F.col("l_suppkey").alias("object_id"), (F.col("l_partkey") % SIDE).cast("int").alias("row"), (F.col("l_orderkey") % 20).cast("int").alias("col")).agg(F.max("l_quantity").cast("double").alias("gray"))
    out = raster.frame_hash(frames, KEY, 20, SIDE)
    return out.select("object_id", F.lpad(F.bin("hash"), 64, "0").alias("bits"))


# --- robust models -------------------------------------------------------------------------------

_H = ["1 + (k % 5) / 50.0D", "(k % 3) / 40.0D", "5.0D + k % 7", "-(k % 4) / 50.0D", "1 - (k % 6) / 60.0D", "k % 9 - 4.0D", "(k % 3) / 20000.0D", "-(k % 5) / 30000.0D"]
_HS = [h.replace("D", "::DOUBLE") for h in _H]


@query("robust_homography", f"""WITH l AS (SELECT (l_suppkey % 20)::BIGINT AS k, (l_partkey % 640)::DOUBLE AS x, (l_orderkey % 480)::DOUBLE AS y, (l_orderkey + l_linenumber) % 5 < 2 AS bad, (l_orderkey * 7919 % 640)::DOUBLE AS ru, (l_partkey * 104729 % 480)::DOUBLE AS rv FROM lineitem),
 h AS (SELECT *, {', '.join(f'{h} AS h{i}' for i, h in enumerate(_HS))} FROM l), t AS (SELECT *, (h0 * x + h1 * y + h2) / (h6 * x + h7 * y + 1) AS u, (h3 * x + h4 * y + h5) / (h6 * x + h7 * y + 1) AS v FROM h),
 d AS (SELECT *, CASE WHEN bad THEN sqrt((u - ru) * (u - ru) + (v - rv) * (v - rv)) ELSE 0 END AS d FROM t),
 g AS (SELECT k, count(*) AS support, count(*) FILTER (NOT bad) AS planted, {', '.join(f'any_value(h{i}) AS h{i}' for i in range(8))} FROM d GROUP BY k)
 SELECT k, {', '.join(f"{r(f'round(h{i}, 5)')} AS h{i}" for i in range(8))}, support, true AS enough, true AS precise, '' AS reason FROM g""")
def robust_homography(spark, sf):
    """Planted motions of twenty pairs, two fifths of the points astray: the model to five decimals, inliers at least as many as planted (within the strays that happen to fit)."""
    from tessella.operators import ransac

    c = F.col
    line = table(spark, sf, "lineitem").select(
        (c("l_suppkey") % 20).cast("long").alias("k"), (c("l_partkey") % 640).cast("double").alias("x"), (c("l_orderkey") % 480).cast("double").alias("y"), ((c("l_orderkey") + c("l_linenumber")) % 5 < 2).alias("bad"),
        (c("l_orderkey") * 7919 % 640).cast("double").alias("ru"), (c("l_partkey") * 104729 % 480).cast("double").alias("rv"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("point_id"),
    )
    h = [F.expr(x) for x in _H]
    w = h[6] * c("x") + h[7] * c("y") + 1
    u, v = (h[0] * c("x") + h[1] * c("y") + h[2]) / w, (h[3] * c("x") + h[4] * c("y") + h[5]) / w
    points = line.select(c("k").alias("pair_id"), "point_id", "bad", c("x").alias("x0"), c("y").alias("y0"), F.when(c("bad"), c("ru")).otherwise(u).alias("x1"), F.when(c("bad"), c("rv")).otherwise(v).alias("y1"))
    found = ransac.robust_models(points, "homography", 0.01)
    planted = points.groupBy("pair_id").agg(F.count_if(~c("bad")).alias("planted"))
    out = found.join(planted, "pair_id")
    strays = (c("inliers") - c("planted")) / c("support")
    return out.select(c("pair_id").alias("k"), *[F.round(F.get("model", F.lit(i)), 5).alias(f"h{i}") for i in range(8)], "support", strays.between(0, 0.01).alias("enough"), (c("error") < 0.01).alias("precise"), "reason")
