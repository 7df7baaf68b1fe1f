"""Queries for single-frame evidence, applicability, ranking and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import fusion, static
from tessella.session import new_folder
from tessella.sources import outputs

from .adapters import EV, OB, evidence, objects, table
from .gate_queries import K, m, s
from .registry import query, r


def _e(spark, sf):
    return table(spark, sf, "events")


@query("centre_depth_order", f"SELECT event_id, {r(f'{s(7)} - {s(3)}')} AS difference, CASE WHEN {s(7)} > {s(3)} THEN 'a_in_front' WHEN {s(7)} < {s(3)} THEN 'b_in_front' ELSE 'same_depth' END AS relation FROM events")
def centre_depth_order(spark, sf):
    return static.centre_order(_e(spark, sf).select("event_id", m(3).alias("za"), m(7).alias("zb"))).select("event_id", "difference", "relation")


@query("occlusion_depth_consistency", f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN {s(3)} + 0.1 END AS f, {s(7)} + 0.1 AS b, CASE WHEN event_id % 5 <> 0 THEN {s(11)} * 2 END AS o, {s(17)} AS q FROM events),
  y AS (SELECT *, CASE WHEN o IS NULL OR o <= 0 THEN 'no_occlusion_relation_evidence' WHEN f IS NULL THEN 'invalid_object_center_depth' ELSE '' END AS reason FROM x)
  SELECT event_id, reason, {r("CASE WHEN reason = '' THEN greatest(0, -((b - f) / greatest(abs(f), abs(b), 1e-12)) - 0.01) END")} AS residual, {r("CASE WHEN reason = '' THEN least(q, least(1, o)) ELSE 0 END")} AS residual_quality FROM y""")
def occlusion_depth_consistency(spark, sf):
    rows = _e(spark, sf).select("event_id", F.when(K() % 13 != 0, m(3) + 0.1).alias("front_z"), (m(7) + 0.1).alias("back_z"), F.when(K() % 5 != 0, m(11) * 2).alias("overlap"), m(17).alias("quality"))
    return static.occlusion_order(rows).select("event_id", "reason", "residual", "residual_quality")


@query("contact_depth_order", f"""WITH p AS (SELECT l_suppkey, CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, l_quantity + CASE WHEN l_partkey % 2 = 0 THEN l_suppkey % 7 ELSE 0 END AS d, l_linenumber = 1 AND l_suppkey % 3 = 0 AS c FROM lineitem),
  g AS (SELECT l_suppkey, count(*) FILTER (side = 'a' AND c) AS na, count(*) FILTER (side = 'b' AND c) AS nb, count(*) FILTER (side = 'a') AS aa, count(*) FILTER (side = 'b') AS ab, median(d) FILTER (side = 'a' AND c) AS dna, median(d) FILTER (side = 'b' AND c) AS dnb, median(d) FILTER (side = 'a') AS daa, median(d) FILTER (side = 'b') AS dab FROM p GROUP BY ALL),
  h AS (SELECT l_suppkey, na >= 12 AND nb >= 12 AS k, CASE WHEN na >= 12 AND nb >= 12 THEN dna WHEN aa >= 12 AND ab >= 12 THEN daa END AS x, CASE WHEN na >= 12 AND nb >= 12 THEN dnb WHEN aa >= 12 AND ab >= 12 THEN dab END AS y FROM g)
  SELECT l_suppkey, {r('x')} AS depth_a, {r('y')} AS depth_b, CASE WHEN x IS NULL OR abs(x - y) <= 0.03 * greatest((x + y) / 2, 1e-8) THEN '' WHEN x < y THEN 'a' ELSE 'b' END AS front,
    {r('CASE WHEN x IS NULL THEN 0 WHEN abs(x - y) <= 0.03 * greatest((x + y) / 2, 1e-8) THEN CASE WHEN k THEN 0.5 ELSE 0.25 END ELSE CASE WHEN k THEN 1 ELSE 0.5 END END')} AS quality FROM h""")
def contact_depth_order(spark, sf):
    even = F.col("l_partkey") % 2 == 0
    p = table(spark, sf, "lineitem").select("l_suppkey", F.when(even, "a").otherwise("b").alias("side"), (F.col("l_quantity") + F.when(even, F.col("l_suppkey") % 7).otherwise(0)).alias("depth"), ((F.col("l_linenumber") == 1) & (F.col("l_suppkey") % 3 == 0)).alias("contact"))
    return static.contact_order(p, ["l_suppkey"])


@query("relative_size_ratio", OB + f"SELECT a.frame_id, a.object_id AS a, b.object_id AS b, {r('greatest(ln(a.low / b.high) - ln(a.observed / b.observed), 0, ln(a.observed / b.observed) - ln(a.high / b.low))')} AS residual FROM ob a JOIN ob b ON a.frame_id = b.frame_id AND a.object_id < b.object_id")
def relative_size_ratio(spark, sf):
    return static.relative_size(objects(spark, sf).withColumnRenamed("observed", "size"), "frame_id")


@query("reconstruction_quality", f"WITH x AS (SELECT event_id, [{s(3)}, CASE WHEN event_id % 3 <> 0 THEN {s(7)} END, CASE WHEN event_id % 5 <> 0 THEN {s(11)} * 2 END] AS p FROM events) SELECT event_id, {r('least(1, greatest(0, list_avg(p)))')} AS quality, least(1, greatest(0, list_avg(p))) >= 0.5 AS passes FROM x")
def reconstruction_quality(spark, sf):
    rows = _e(spark, sf).select("event_id", m(3).alias("p1"), F.when(K() % 3 != 0, m(7)).alias("p2"), F.when(K() % 5 != 0, m(11) * 2).alias("p3"))
    return static.reconstruction_quality(rows, ["p1", "p2", "p3"]).select("event_id", "quality", "passes")


@query("upright_gate", f"""WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 100)::DOUBLE AS x1, (l_suppkey % 50)::DOUBLE AS y1, (l_partkey % 100)::DOUBLE + l_quantity AS x2, (l_suppkey % 50)::DOUBLE + l_quantity * 0.8::DOUBLE AS y2, l_tax * 10 AS cf, CASE WHEN l_linenumber <> 3 THEN l_discount * 4 END AS v, l_discount AS iqr, l_tax + 0.01::DOUBLE AS dp, l_quantity / 30 AS dr FROM lineitem),
  c AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM b)
  SELECT l_orderkey, l_linenumber, CASE WHEN w <= 0 OR h <= 0 THEN 'pose_unresolved' WHEN w < 16 OR h < 16 THEN 'too_small' WHEN x1 <= 0.8 OR y1 <= 0.45 OR x2 >= 0.995::DOUBLE * 160 OR y2 >= 0.995::DOUBLE * 90 THEN 'boundary_truncated' WHEN v > 0.2 THEN 'unstable_projection'
    WHEN NOT (iqr / dp <= 0.2 AND dr >= 0.5) THEN 'unstable_depth' WHEN cf < 0.3 OR NOT w / h BETWEEN 0.45 AND 1.6 THEN 'pose_unresolved' ELSE 'applicable' END AS applicability FROM c""")
def upright_gate(spark, sf):
    q = F.col("l_quantity").cast("double")
    x1, y1 = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", x1.alias("x1"), y1.alias("y1"), (x1 + q).alias("x2"), (y1 + q * 0.8).alias("y2"), F.lit(160.0).alias("width"), F.lit(90.0).alias("height"), (F.col("l_tax") * 10).alias("confidence"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 4).alias("variation"), F.col("l_discount").alias("depth_iqr"), (F.col("l_tax") + 0.01).alias("depth"), (q / 30).alias("depth_ratio"),
    )
    return static.upright_gate(rows).select("l_orderkey", "l_linenumber", "applicability")


@query("diagnostic_labels", f"SELECT event_id, CASE WHEN {s(3)} <= 0.8 AND {s(7)} <= 0.7 AND {s(11)} <= 0.9 THEN 'no_obvious_issue' ELSE concat_ws(',', CASE WHEN {s(3)} > 0.8 THEN 'truncated' END, CASE WHEN {s(7)} > 0.7 THEN 'pose_mismatch' END, CASE WHEN {s(11)} > 0.9 THEN 'depth_instability' END) END AS labels FROM events")
def diagnostic_labels(spark, sf):
    rows = static.diagnostic_labels(_e(spark, sf), {"truncated": m(3) > 0.8, "pose_mismatch": m(7) > 0.7, "depth_instability": m(11) > 0.9})
    return rows.select("event_id", F.array_join("labels", ",").alias("labels"))


@query("view_observability", f"SELECT event_id, concat_ws(',', CASE WHEN {s(3)} < 0.5 THEN 'view_confidence' END, CASE WHEN {s(7)} < 0.6 THEN 'visible_ratio' END, CASE WHEN {s(11)} > 0.4 THEN 'occlusion' END, CASE WHEN event_id % 6 = 0 THEN 'border' END) AS failed, {s(3)} >= 0.5 AND {s(7)} >= 0.6 AND {s(11)} <= 0.4 AND event_id % 6 <> 0 AS observable FROM events")
def view_observability(spark, sf):
    rows = _e(spark, sf).select("event_id", m(3).alias("view_confidence"), m(7).alias("visible_ratio"), m(11).alias("occlusion"), (K() % 6 == 0).alias("border"))
    return static.view_observability(rows).select("event_id", F.array_join("failed", ",").alias("failed"), "observable")


@query("rank_evidence", EV + f""", c AS (SELECT video_id, clip_id, 'object' AS identity_type, object_id AS identity_id, sum(normalized_value * greatest(confidence, 1e-8)) / sum(greatest(confidence, 1e-8)) AS s FROM ev WHERE valid AND object_id IS NOT NULL GROUP BY ALL
    UNION ALL SELECT video_id, clip_id, 'track', track_id, sum(normalized_value * greatest(confidence, 1e-8)) / sum(greatest(confidence, 1e-8)) FROM ev WHERE valid AND track_id IS NOT NULL GROUP BY ALL),
  g AS (SELECT video_id, identity_type, identity_id, round(max(s), 9) AS score FROM c GROUP BY ALL)
  SELECT video_id, identity_type, identity_id, {r('score')} AS score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, identity_type, identity_id)::INT AS rank FROM g""")
def rank_evidence(spark, sf):
    e = evidence(spark, sf)
    one = lambda kind, key: fusion.entity_scores(e, key).select("video_id", F.lit(kind).alias("identity_type"), F.col(key).alias("identity_id"), F.round("score", 9).alias("score"))
    return static.rank_evidence(one("object", "object_id").unionByName(one("track", "track_id")), ["video_id"])


GREEDY = """WITH RECURSIVE p AS (SELECT a.l_orderkey AS f, a.l_linenumber AS o, b.l_linenumber AS c, 1 / (1 + abs(a.l_quantity - b.l_quantity - 2)) AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE 1 / (1 + abs(a.l_quantity - b.l_quantity - 2)) >= 0.35::DOUBLE),
 k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s DESC, o, c) AS n FROM p),
 g AS (SELECT f, n, o, c, s, true AS taken, [o] AS os, [c] AS cs FROM k WHERE n = 1 UNION ALL SELECT f, n, o, c, s, free, CASE WHEN free THEN list_append(os, o) ELSE os END, CASE WHEN free THEN list_append(cs, c) ELSE cs END FROM (SELECT k.*, g.os, g.cs, NOT list_contains(g.os, k.o) AND NOT list_contains(g.cs, k.c) AS free FROM g JOIN k ON k.f = g.f AND k.n = g.n + 1))
"""


@query("greedy_match", GREEDY + f"SELECT f AS frame_id, o AS object_id, c AS candidate_id, {r('s')} AS score FROM g WHERE taken")
def greedy_match(spark, sf):
    line = table(spark, sf, "lineitem")
    a = line.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("object_id"), F.col("l_quantity").alias("qa"))
    b = line.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("candidate_id"), F.col("l_quantity").alias("qb"))
    pairs = a.join(b, "frame_id").withColumn("score", 1 / (1 + F.abs(F.col("qa") - F.col("qb") - 2))).drop("qa", "qb")
    return static.greedy_match(pairs, "frame_id")


@query("depth_alignment_holdout", f"""WITH x AS (SELECT label, vec_id, abs(embedding[3]::DOUBLE) + 0.1::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL),
 p AS (SELECT label::VARCHAR AS pair_id, x, CASE label % 3 WHEN 0 THEN x + 1 WHEN 1 THEN 2 * x ELSE 3 * x + 0.7::DOUBLE END AS y, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 = 4 AS o FROM x),
 f AS (SELECT pair_id, count(*) FILTER (NOT o) >= 8 AND count(*) FILTER (o) >= 2 AS enough, greatest(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 1e-12::DOUBLE) AS spread, median(y - x) FILTER (NOT o) AS sh, exp(median(ln(y / x)) FILTER (NOT o)) AS sc,
   min(x) FILTER (NOT o) > 0 AND min(y) FILTER (NOT o) > 0 AS pos, regr_slope(y, x) FILTER (NOT o) AS a, regr_intercept(y, x) FILTER (NOT o) AS b FROM p GROUP BY ALL),
 m AS (SELECT pair_id, spread, 0 AS k, 'shift' AS model, 1.0::DOUBLE AS scale, sh AS shift FROM f WHERE enough UNION ALL SELECT pair_id, spread, 1, 'scale', sc, 0 FROM f WHERE enough AND pos UNION ALL SELECT pair_id, spread, 2, 'line', a, b FROM f WHERE enough AND a > 0),
 e AS (SELECT m.pair_id, k, model, scale, shift, median(abs(y - scale * x - shift)) / any_value(spread) AS err FROM m JOIN p ON p.pair_id = m.pair_id AND o GROUP BY ALL),
 w AS (SELECT * FROM (SELECT *, min(err) OVER (PARTITION BY pair_id) AS best FROM e) WHERE err <= 1.05::DOUBLE * best + 1e-12 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY k) = 1)
 SELECT f.pair_id, CASE WHEN err <= 0.25 THEN model ELSE 'none' END AS model, {r('CASE WHEN err <= 0.25 THEN scale END')} AS scale, {r('CASE WHEN err <= 0.25 THEN shift END')} AS shift, {r('CASE WHEN err <= 0.25 THEN err END')} AS error FROM f LEFT JOIN w USING (pair_id)""")
def depth_alignment_holdout(spark, sf):
    g = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, sf, "embeddings").where("label IS NOT NULL")
    x = F.abs(g(2)) + 0.1
    model = F.when(F.col("label") % 3 == 0, x + 1).when(F.col("label") % 3 == 1, 2 * x).otherwise(3 * x + 0.7)
    return static.align_with_holdout(e.select(F.col("label").cast("string").alias("pair_id"), F.col("vec_id").alias("ord"), x.alias("source"), model.alias("target")))


@query("array_store", f"SELECT vec_id, len(embedding) AS length, {r('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} AS total, {r('embedding[1]::DOUBLE')} AS first, {r('embedding[-1]::DOUBLE')} AS last FROM embeddings")
def array_store(spark, sf):
    """Arrays written to a store of binary rows, read back, checked by their hash and decoded."""
    path = new_folder(spark, "arrays")
    outputs.array_rows(table(spark, sf, "embeddings"), "vec_id", "embedding").write.parquet(path)
    back = outputs.read_arrays(spark.read.parquet(path), "vec_id")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", F.size("values").cast("long").alias("length"), total.alias("total"), F.get("values", F.lit(0)).alias("first"), F.element_at("values", -1).alias("last"))
