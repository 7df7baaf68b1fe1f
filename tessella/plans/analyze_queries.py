"""One way from observations to a report: the oracles build the same evidence and hand it to the fusion's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import analyze, fusion

from .adapters import tracks
from .evidence_queries import CONTRIB, LEVELS_SQL
from .registry import query, r
from .table_queries import STEPS, W

_Q = lambda p: f"(vec_id * {p} % 100) / 100.0"

#: The evidence of the fusion's SQL, ``ev``, from tracks.
EVIDENCE = STEPS + f""", pv AS (SELECT *, CASE WHEN scale > 0 AND dt > 0 THEN step / (dt * scale) END AS speed FROM sq),
 pm AS (SELECT a.video_id, a.point_id, a.frame_index, median(b.speed) AS m FROM pv a JOIN pv b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.point_id <> b.point_id GROUP BY ALL),
 pt AS (SELECT pv.*, m, lag(scale) OVER {W} AS before, vec_id % 19 <> 4 AS point_valid, CASE WHEN vec_id % 7 <> 2 THEN 0.45::DOUBLE END AS low, 0.7::DOUBLE AS high, (vec_id * 7 % 100 + 1) / 100.0::DOUBLE AS quality,
   CASE WHEN vec_id % 11 = 0 THEN 'instance_mask_unavailable' WHEN {_Q(3)} > 0.9 THEN 'severe_object_occlusion' WHEN {_Q(7)} < 0.1 THEN 'insufficient_mask_quality' WHEN vec_id % 17 = 0 THEN 'unstable_track_identity' WHEN {_Q(11)} < 0.1 THEN 'insufficient_valid_metric_depth_ratio' ELSE '' END AS gate FROM pv LEFT JOIN pm USING (video_id, point_id, frame_index)),
 ch AS (SELECT video_id, point_id, frame_index, quality, 0 AS i, 'semantic_metric_prior' AS name, 'object' AS level, CASE WHEN gate = '' AND low IS NOT NULL THEN greatest(ln(low) - ln(scale), 0, ln(scale) - ln(high)) END AS v FROM pt
  UNION ALL SELECT video_id, point_id, frame_index, quality, 1, 'semantic_metric_temporal', 'track', CASE WHEN gate = '' THEN abs(ln(scale) - ln(before)) END FROM pt
  UNION ALL SELECT video_id, point_id, frame_index, quality, 2, 'dynamic_reprojection', 'point', CASE WHEN point_valid THEN sqrt(pow(x - (x1 + (x1 - x2) * ((frame_index - f1) / (f1 - f2)::DOUBLE)), 2) + pow(y - (y1 + (y1 - y2) * ((frame_index - f1) / (f1 - f2)::DOUBLE)), 2) + pow(z - (z1 + (z1 - z2) * ((frame_index - f1) / (f1 - f2)::DOUBLE)), 2)) END FROM pt
  UNION ALL SELECT video_id, point_id, frame_index, quality, 3, 'track_3d_continuity', 'point', CASE WHEN point_valid THEN sqrt(pow(x - 2 * x1 + x2, 2) + pow(y - 2 * y1 + y2, 2) + pow(z - 2 * z1 + z2, 2)) / scale END FROM pt
  UNION ALL SELECT video_id, point_id, frame_index, quality, 4, 'direction_consistency', 'point', CASE WHEN point_valid AND step > 1e-6 AND estep > 1e-6 THEN 1 - least(1, greatest(-1, (dx * ex + dy * ey + dz * ez) / (step * estep))) END FROM pt
  UNION ALL SELECT video_id, point_id, frame_index, quality, 5, 'relative_velocity', 'point', CASE WHEN point_valid THEN abs(speed - m) END FROM pt),
 ev AS (SELECT video_id, 'c' || (frame_index // 8) AS clip_id, (row_number() OVER (PARTITION BY video_id ORDER BY frame_index, point_id, i) - 1)::INT AS row_idx, name, level, frame_index, NULL::VARCHAR AS object_id, 't' || point_id AS track_id,
   v AS raw_value, CASE WHEN v IS NOT NULL THEN 1 - exp(-greatest(v, 0)) END AS normalized_value, v IS NOT NULL AS valid, CASE WHEN v IS NOT NULL THEN quality ELSE 0 END AS confidence FROM ch)
"""


def observed_points(spark, sf):
    c = F.col
    q = lambda p: c("vec_id") * p % 100 / 100.0
    return tracks(spark, sf).select(
        "video_id", "point_id", "frame_index", "p", "scale", (c("vec_id") % 19 != 4).alias("point_valid"), F.when(c("vec_id") % 7 != 2, F.lit(0.45)).alias("low"), F.lit(0.7).alias("high"), ((c("vec_id") * 7 % 100 + 1) / 100.0).alias("quality"),
        (c("vec_id") % 11 != 0).alias("has_mask"), F.lit(True).alias("mask_support"), (q(3) - 0.4).alias("occlusion"), (q(7) + 0.4).alias("mask_quality"), (c("vec_id") % 17 != 0).alias("track_stable"), F.lit(True).alias("surface_valid"), (q(11) + 0.2).alias("depth_coverage"),
    )


@query("analyze_clips", EVIDENCE + LEVELS_SQL + f"SELECT video_id, clip_id, {r('risk_score')} AS risk_score, {r('coverage')} AS coverage, {r('confidence')} AS confidence FROM cl")
def analyze_clips(spark, sf):
    return fusion.fuse_clips(analyze.point_evidence(observed_points(spark, sf)))


@query("analyze_report", EVIDENCE + CONTRIB + f""", vd AS (SELECT video_id, sum(risk_score * greatest(confidence, 1e-8)) / sum(CASE WHEN risk_score IS NOT NULL THEN greatest(confidence, 1e-8) END) AS risk_score, count(*) AS clips, count(risk_score) AS scored_clips,
   count(*) FILTER (risk_score > 0.5) AS suspicious_clips, avg(coverage) AS coverage FROM cl GROUP BY video_id),
 tc AS (SELECT video_id, clip_id AS top_clip FROM cl WHERE risk_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY risk_score DESC, clip_id) = 1),
 tn AS (SELECT video_id, name AS top_channel FROM (SELECT video_id, name, round(sum(contribution), 9) AS s FROM co GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY s DESC, name) = 1)
 SELECT video_id, {r('risk_score')} AS risk_score, clips, scored_clips, suspicious_clips, top_clip, top_channel, {r('coverage')} AS coverage FROM vd LEFT JOIN tc USING (video_id) LEFT JOIN tn USING (video_id)""")
def analyze_report(spark, sf):
    """From observed points over gates, residuals and fusion to a row for each video."""
    return analyze.report(analyze.point_evidence(observed_points(spark, sf)))
