"""Queries over the evidence view: fusion, aggregation, branches, windows, contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import aggregate, branches, contract, fusion, governance, relations, residuals, windows

from .adapters import AG, BR, EV, aggregation_rows, branch_rows, evidence
from .registry import query, r

LEVELS_SQL = """, en AS (SELECT video_id, clip_id, coalesce(frame_index, -1) AS frame, level, coalesce(nullif(object_id, ''), nullif(track_id, ''), name) AS entity,
    sum(normalized_value * greatest(confidence, 1e-8)) / sum(greatest(confidence, 1e-8)) AS score, avg(confidence) AS conf
  FROM ev WHERE valid GROUP BY ALL),
fr AS (SELECT video_id, clip_id, frame, sum(score * greatest(conf, 1e-8)) / sum(greatest(conf, 1e-8)) AS score, avg(conf) AS conf FROM en GROUP BY ALL),
cl0 AS (SELECT video_id, clip_id, sum(score * greatest(conf, 1e-8)) / sum(greatest(conf, 1e-8)) AS risk_score, avg(conf) AS conf FROM fr GROUP BY ALL),
ct AS (SELECT video_id, clip_id, count(*) AS n, count(*) FILTER (valid) AS k, min(row_idx) AS start_frame, max(row_idx) AS end_frame FROM ev GROUP BY ALL),
cl AS (SELECT ct.video_id, ct.clip_id, risk_score, k / n AS coverage, coalesce(conf * k / n, 0) AS confidence, start_frame, end_frame
  FROM ct LEFT JOIN cl0 USING (video_id, clip_id))
"""


@query("fuse_clips", EV + LEVELS_SQL + f"SELECT video_id, clip_id, {r('risk_score')} AS risk_score, {r('coverage')} AS coverage, {r('confidence')} AS confidence FROM cl")
def fuse_clips(spark, sf):
    return fusion.fuse_clips(evidence(spark, sf))


@query("fuse_videos", EV + LEVELS_SQL + f"""SELECT video_id, {r("sum(risk_score * greatest(confidence, 1e-8)) / sum(CASE WHEN risk_score IS NOT NULL THEN greatest(confidence, 1e-8) END)")} AS risk_score,
  count(*) AS clips, count(risk_score) AS scored_clips FROM cl GROUP BY video_id""")
def fuse_videos(spark, sf):
    return fusion.fuse_videos(fusion.fuse_clips(evidence(spark, sf)))


CONTRIB = LEVELS_SQL + """, ro AS (SELECT *, coalesce(frame_index, -1) AS frame, coalesce(nullif(object_id, ''), nullif(track_id, ''), name) AS entity FROM ev WHERE valid),
ro2 AS (SELECT *, greatest(confidence, 1e-8) / sum(greatest(confidence, 1e-8)) OVER (PARTITION BY video_id, clip_id, frame, level, entity) AS w1 FROM ro),
en2 AS (SELECT *, greatest(conf, 1e-8) / sum(greatest(conf, 1e-8)) OVER (PARTITION BY video_id, clip_id, frame) AS w2 FROM en),
fr2 AS (SELECT *, greatest(conf, 1e-8) / sum(greatest(conf, 1e-8)) OVER (PARTITION BY video_id, clip_id) AS w3 FROM fr),
co AS (SELECT ro2.video_id, ro2.clip_id, row_idx, name, normalized_value * w1 * w2 * w3 AS contribution FROM ro2
  JOIN en2 USING (video_id, clip_id, frame, level, entity) JOIN fr2 USING (video_id, clip_id, frame))
"""


@query("evidence_contributions", EV + CONTRIB + f"SELECT video_id, clip_id, row_idx, name, {r('contribution')} AS contribution FROM co")
def evidence_contributions(spark, sf):
    return fusion.contributions(evidence(spark, sf))


@query("dominant_residual", EV + CONTRIB + "SELECT video_id, clip_id, name AS dominant_residual FROM co QUALIFY row_number() OVER (PARTITION BY video_id, clip_id ORDER BY round(contribution, 12) DESC, row_idx) = 1")
def dominant_residual(spark, sf):
    return fusion.dominant(fusion.contributions(evidence(spark, sf)))


def _entity(key):
    return EV + f""", c AS (SELECT video_id, clip_id, {key}, sum(normalized_value * greatest(confidence, 1e-8)) / sum(greatest(confidence, 1e-8)) AS s
      FROM ev WHERE valid AND {key} IS NOT NULL GROUP BY ALL) SELECT video_id, {key}, {r('max(s)')} AS score, count(*) AS clips FROM c GROUP BY ALL"""


@query("object_scores", _entity("object_id"))
def object_scores(spark, sf):
    return fusion.entity_scores(evidence(spark, sf), "object_id")


@query("track_scores", _entity("track_id"))
def track_scores(spark, sf):
    return fusion.entity_scores(evidence(spark, sf), "track_id")


CHANNEL_SQL = ", ".join(f"{r(f'avg(normalized_value) FILTER (valid AND name = {c!r})')} AS {c}_value, count(*) FILTER (valid AND name = {c!r}) > 0 AS {c}_available, {r(f'coalesce(avg(confidence) FILTER (valid AND name = {c!r}), 0)')} AS {c}_confidence" for c in fusion.CHANNELS)


@query("channel_matrix", EV + f"SELECT video_id, clip_id, {CHANNEL_SQL} FROM ev GROUP BY ALL")
def channel_matrix(spark, sf):
    return fusion.channel_matrix(evidence(spark, sf))


@query("video_risk_mix", EV + LEVELS_SQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY risk_score DESC, clip_id) AS rn FROM cl WHERE risk_score IS NOT NULL)
SELECT video_id, {r("0.5 * avg(risk_score) + 0.3 * max(risk_score) + 0.2 * avg(risk_score) FILTER (rn <= 3)")} AS risk FROM k GROUP BY ALL""")
def video_risk_mix(spark, sf):
    return fusion.video_risk_mix(fusion.fuse_clips(evidence(spark, sf)))


@query("minmax_norm", EV + f""", m AS (SELECT video_id, min(raw_value) lo, max(raw_value) hi FROM ev WHERE valid GROUP BY ALL)
SELECT video_id, row_idx, {r("CASE WHEN hi > lo THEN (raw_value - lo) / (hi - lo) ELSE 0 END")} AS normalized FROM ev JOIN m USING (video_id) WHERE valid""")
def minmax_norm(spark, sf):
    rows = evidence(spark, sf).where("valid").select("video_id", "row_idx", "raw_value")
    return fusion.minmax(rows, "raw_value", ["video_id"]).select("video_id", "row_idx", "normalized")


@query("zscore_norm", EV + f""", m AS (SELECT video_id, avg(raw_value) a, stddev_pop(raw_value) s FROM ev WHERE valid GROUP BY ALL)
SELECT video_id, row_idx, {r("CASE WHEN s > 1e-12 THEN (raw_value - a) / s ELSE 0 END")} AS normalized FROM ev JOIN m USING (video_id) WHERE valid""")
def zscore_norm(spark, sf):
    rows = evidence(spark, sf).where("valid").select("video_id", "row_idx", "raw_value")
    return fusion.zscore(rows, "raw_value", ["video_id"]).select("video_id", "row_idx", "normalized")


@query("heatmap_max", EV + f"""SELECT video_id, clip_no AS frame, round_even(raw_value * 3, 0)::INT AS col, round_even(row_idx / 2, 0)::INT AS row, {r('max(normalized_value)')} AS value FROM ev WHERE valid GROUP BY ALL""")
def heatmap_max(spark, sf):
    e = evidence(spark, sf).where("valid")
    return fusion.heatmap(e.select("video_id", F.col("clip_no").alias("frame"), (F.col("raw_value") * 3).alias("x"), (F.col("row_idx") / 2).alias("y"), F.col("normalized_value").alias("value")))


# --- the seven methods -------------------------------------------------------------------

VALUE_SQL = {
    "median": "median(value)",
    "trimmed_mean": "avg(value) FILTER (up > floor(n * 0.1::DOUBLE) AND up <= n - floor(n * 0.1::DOUBLE))",
    "top_k_mean": "avg(value) FILTER (up > n - least(n, 3))",
    "legacy_topk_mean": "sum(value * w) FILTER (up > n - least(n, 3)) / sum(w) FILTER (up > n - least(n, 3))",
    "quality_weighted_mean": "sum(value * w) / sum(w)",
    "quality_weighted_top_k": "sum(value * w) FILTER (uq > n - least(n, 3)) / sum(w) FILTER (uq > n - least(n, 3))",
    "hybrid_median_top_k": "0.5 * median(value) + 0.5 * sum(value * w) FILTER (uq > n - least(n, 3)) / sum(w) FILTER (uq > n - least(n, 3))",
}


def _aggregate_sql(method, keys="video_id, clip_id"):
    return AG + f""", ok AS (SELECT *, greatest(quality, 1e-12) AS w, row_number() OVER (PARTITION BY {keys} ORDER BY value, ord) AS up,
      row_number() OVER (PARTITION BY {keys} ORDER BY value * quality, ord) AS uq, count(*) OVER (PARTITION BY {keys}) AS n
      FROM ag WHERE applicability = 'applicable' AND valid AND value IS NOT NULL),
    s AS (SELECT {keys}, {VALUE_SQL[method]} AS value, avg(quality) AS quality, count(*) AS accepted FROM ok GROUP BY {keys}),
    c AS (SELECT {keys}, count(*) AS rows, count(*) FILTER (applicability = 'applicable') AS applicable, count(*) FILTER (applicability = 'observation_missing') AS observation_missing,
      count(*) FILTER (applicability = 'not_applicable') AS not_applicable, count(*) FILTER (applicability = 'invalid_geometry') AS invalid_geometry,
      count(*) FILTER (applicability = 'unsupported_mode') AS unsupported_mode FROM ag GROUP BY {keys})
    SELECT {keys}, {r('value')} AS value, {r('coalesce(quality, CASE WHEN not_applicable = rows THEN 1 ELSE 0 END)')} AS quality,
      {r('CASE WHEN rows > not_applicable THEN coalesce(accepted, 0) / (rows - not_applicable) WHEN not_applicable > 0 THEN 1 ELSE 0 END')} AS coverage,
      coalesce(accepted, 0) AS accepted, applicable, observation_missing, not_applicable, invalid_geometry, unsupported_mode
    FROM c LEFT JOIN s USING ({keys})"""


def _add_method(name, method):
    @query(name, _aggregate_sql(method))
    def build(spark, sf):
        return aggregate.aggregate(aggregation_rows(spark, sf), ["video_id", "clip_id"], method)


for _name, _method in (("agg_median", "median"), ("agg_trimmed", "trimmed_mean"), ("agg_topk", "top_k_mean"), ("agg_legacy_topk", "legacy_topk_mean"), ("agg_qw_mean", "quality_weighted_mean"), ("agg_qw_topk", "quality_weighted_top_k"), ("agg_hybrid", "hybrid_median_top_k")):
    _add_method(_name, _method)

CASCADE = [["video_id", "clip_id", "frame_index", "object_id", "track_id"], ["video_id", "clip_id", "frame_index", "object_id"], ["video_id", "clip_id", "frame_index"], ["video_id", "clip_id"], ["video_id"]]


def _cascade_sql():
    sql, source = AG, "ag"
    for i, keys in enumerate(CASCADE):
        k = ", ".join(keys)
        sql += f""", l{i} AS (SELECT {k}, sum(value * greatest(quality, 1e-12)) FILTER (ok) / sum(greatest(quality, 1e-12)) FILTER (ok) AS value,
          coalesce(avg(quality) FILTER (ok), CASE WHEN count(*) = count(*) FILTER (applicability = 'not_applicable') THEN 1 ELSE 0 END) AS quality,
          CASE WHEN count(*) > count(*) FILTER (applicability = 'not_applicable') THEN count(*) FILTER (ok) / (count(*) - count(*) FILTER (applicability = 'not_applicable'))
            WHEN count(*) FILTER (applicability = 'not_applicable') > 0 THEN 1 ELSE 0 END AS coverage
          FROM (SELECT *, coalesce(applicability = 'applicable' AND valid AND value IS NOT NULL, false) AS ok FROM {source}) GROUP BY {k}),
        a{i} AS (SELECT *, value IS NOT NULL AS valid, CASE WHEN value IS NOT NULL THEN 'applicable' ELSE 'observation_missing' END AS applicability FROM l{i})"""
        source = f"a{i}"
    return sql + f" SELECT video_id, {r('value')} AS value, {r('quality')} AS quality, {r('coverage')} AS coverage, valid FROM {source}"


@query("point_object_frame_clip_cascade", _cascade_sql())
def cascade(spark, sf):
    return aggregate.cascade(aggregation_rows(spark, sf), CASCADE)


@query("topk_ratio_mean", AG + f""", k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, ord) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM ag WHERE value IS NOT NULL)
SELECT video_id, {r('avg(value)')} AS value, count(*) AS kept FROM k WHERE rn <= greatest(1, ceil(n * 0.1::DOUBLE)) GROUP BY ALL""")
def topk_ratio_mean(spark, sf):
    return aggregate.topk_ratio_mean(aggregation_rows(spark, sf), ["video_id"], 0.1)


# --- branches ------------------------------------------------------------------------------


def _branch_sql(keys, source="br", where="true"):
    return f""", b0 AS (SELECT * FROM {source} WHERE {where}),
    bw AS (SELECT {keys}, sum(CASE WHEN a THEN 1.0::DOUBLE ELSE 0 END) AS wanted FROM (SELECT {keys}, branch, bool_or(applicable) AS a FROM b0 GROUP BY ALL) GROUP BY {keys}),
    bg AS (SELECT *, greatest(quality, 1e-12) AS w, row_number() OVER (PARTITION BY {keys}, branch ORDER BY value * quality, ord) AS up, count(*) OVER (PARTITION BY {keys}, branch) AS n
      FROM b0 WHERE valid AND applicable AND provider_ok),
    bs AS (SELECT {keys}, branch, 0.5 * median(value) + 0.5 * sum(value * w) FILTER (up > n - least(n, 3)) / sum(w) FILTER (up > n - least(n, 3)) AS residual, avg(quality / (1 + uncertainty)) AS cf FROM bg GROUP BY ALL),
    bm AS (SELECT {keys}, count(*)::DOUBLE AS have, sum(cf) AS wc, sum(cf * (1 - exp(-greatest(residual, 0)))) AS wcb, max((1 - exp(-greatest(residual, 0))) * cf) AS most, count(*) AS n FROM bs GROUP BY {keys}),
    bf AS (SELECT {keys}, CASE WHEN wc > 0 THEN 0.5 * wcb / wc + 0.5 * most END AS risk,
      CASE WHEN wc > 0 THEN least(1, greatest(0, wc / have * (have / wanted))) ELSE 0 END AS confidence,
      CASE WHEN wc > 0 THEN n ELSE 0 END AS active_branches, CASE WHEN wanted > 0 THEN coalesce(have, 0) / wanted ELSE 0 END AS available_share FROM bw LEFT JOIN bm USING ({keys}))
    SELECT {keys}, {r('risk')} AS risk, {r('confidence')} AS confidence, active_branches, {r('available_share')} AS available_share FROM bf"""


@query("branch_fusion", BR + _branch_sql("video_id, clip_id"))
def branch_fusion(spark, sf):
    return branches.fuse(branch_rows(spark, sf), ["video_id", "clip_id"])


@query("branch_dropout", BR + f", dr AS (SELECT br.*, d.dropped FROM br JOIN (SELECT unnest({branches.BRANCHES!r}) AS dropped) d ON d.dropped <> br.branch)" + _branch_sql("video_id, dropped", "dr"))
def branch_dropout(spark, sf):
    return branches.dropout(branch_rows(spark, sf), ["video_id"])


@query("frame_fusion", BR + _branch_sql("video_id, clip_id, frame_index", where="frame_index IS NOT NULL"))
def frame_fusion(spark, sf):
    return branches.frame_fusion(branch_rows(spark, sf))


@query("missingness_features", BR + f"""SELECT video_id, count(*) AS rows, count(*) FILTER (NOT valid) AS missing, {r('count(*) FILTER (NOT valid) / count(*)')} AS missing_ratio,
  count(*) FILTER (NOT provider_ok) AS provider_failures, count(DISTINCT branch) AS branches FROM br GROUP BY ALL""")
def missingness_features(spark, sf):
    return branches.missingness_features(branch_rows(spark, sf), ["video_id"])


@query("branch_availability", BR + f"SELECT branch, count(*) AS rows, count(*) FILTER (applicable) AS applicable, count(*) FILTER (valid) AS valid, {r('count(*) FILTER (valid) / count(*)')} AS valid_ratio FROM br GROUP BY ALL")
def branch_availability(spark, sf):
    return branches.availability(branch_rows(spark, sf))


@query("reason_histogram", BR + "SELECT branch, reason, count(*) AS rows FROM br WHERE NOT valid GROUP BY ALL")
def reason_histogram(spark, sf):
    return branches.reason_histogram(branch_rows(spark, sf), ["branch"])


@query("coverage_by_group", BR + f"SELECT video_id, branch, count(*) AS rows, {r('count(*) FILTER (valid) / count(*)')} AS coverage FROM br GROUP BY ALL")
def coverage_by_group(spark, sf):
    return branches.coverage_by_group(branch_rows(spark, sf), "video_id")


@query("provider_failure_balance", BR + f"SELECT event_type, count(*) AS rows, count(*) FILTER (NOT provider_ok) AS failures, {r('count(*) FILTER (NOT provider_ok) / count(*)')} AS failure_ratio FROM br GROUP BY ALL")
def provider_failure_balance(spark, sf):
    return branches.provider_failure_balance(branch_rows(spark, sf), "event_type")


@query("missingness_bias", BR + f""", v AS (SELECT video_id, count(*) FILTER (NOT valid) / count(*) AS missing_ratio, avg(uncertainty) AS uncertainty, abs(hash_of) % 2 AS label, CASE WHEN hash_of % 3 = 0 THEN 'train' ELSE 'test' END AS split
    FROM (SELECT *, length(video_id) + substr(video_id, 2)::INT AS hash_of FROM br) GROUP BY ALL),
  x AS (SELECT split, label, 'missing_ratio' AS feature, missing_ratio AS v FROM v UNION ALL SELECT split, label, 'uncertainty', uncertainty FROM v),
  m AS (SELECT split, feature, avg(v) FILTER (label = 0) AS mean0, avg(v) FILTER (label = 1) AS mean1 FROM x GROUP BY ALL)
  SELECT split, feature, {r('mean0')} AS mean0, {r('mean1')} AS mean1, {r('abs(mean1 - mean0)')} AS difference, coalesce(abs(mean1 - mean0) >= 0.01, false) AS flagged FROM m""")
def missingness_bias(spark, sf):
    h = F.length("video_id") + F.substring("video_id", 2, 20).cast("int")
    v = branch_rows(spark, sf).groupBy("video_id").agg((F.count_if(~F.col("valid")) / F.count(F.lit(1))).alias("missing_ratio"), F.avg("uncertainty").alias("uncertainty"))
    v = v.withColumn("label", h % 2).withColumn("split", F.when(h % 3 == 0, "train").otherwise("test"))
    return branches.missingness_bias(v, ["missing_ratio", "uncertainty"], 0.01)


# --- windows ---------------------------------------------------------------------------------

N_FRAMES = EV + ", n AS (SELECT video_id, count(*)::INT AS n_frames FROM ev GROUP BY ALL)"
SLIDING = N_FRAMES + """, st AS (SELECT DISTINCT video_id, n_frames, s FROM (SELECT video_id, n_frames, unnest(range(0, greatest(n_frames - 10, 0) + 1, 6)) AS s FROM n UNION ALL SELECT video_id, n_frames, greatest(n_frames - 10, 0) FROM n)),
sl AS (SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY s) - 1)::INT AS clip_ordinal, s::INT AS start_frame, (least(s + 10, n_frames) - 1)::INT AS end_frame FROM st WHERE n_frames >= 2)
"""


def _videos(spark, sf):
    return evidence(spark, sf).groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))


@query("clips_sliding_tail", SLIDING + "SELECT * FROM sl WHERE end_frame > start_frame")
def clips_sliding_tail(spark, sf):
    return windows.sliding_clips(_videos(spark, sf), 10, 6)


@query("clips_tumbling", EV + "SELECT video_id, row_idx AS frame_index, (row_idx // 8)::INT AS clip_ordinal, (row_idx % 8)::INT AS position FROM ev")
def clips_tumbling(spark, sf):
    return windows.tumbling_clips(evidence(spark, sf).select("video_id", F.col("row_idx").alias("frame_index")), 8)


@query("clips_owner", SLIDING + """, f AS (SELECT video_id, clip_ordinal, start_frame, end_frame, unnest(range(start_frame, end_frame + 1))::INT AS frame_index FROM sl WHERE end_frame > start_frame)
SELECT video_id, frame_index, arg_min(clip_ordinal, abs(frame_index - (start_frame + end_frame) / 2.0::DOUBLE) * 1000000 + clip_ordinal) AS owner_clip, count(*) AS candidates FROM f GROUP BY ALL""")
def clips_owner(spark, sf):
    return windows.owned_frames(_videos(spark, sf), 10, 6)


@query("owner_violations", SLIDING + """, f AS (SELECT video_id, unnest(range(start_frame, end_frame + 1))::INT AS frame_index, clip_ordinal FROM sl WHERE end_frame > start_frame),
 c AS (SELECT video_id, frame_index, count(*) FILTER ((frame_index + clip_ordinal) % 7 = 0) AS owners FROM f GROUP BY ALL) SELECT * FROM c WHERE owners <> 1""")
def owner_violations(spark, sf):
    """A wrong rule of ownership, so that frames without an owner and with several turn up."""
    clips = windows.sliding_clips(_videos(spark, sf), 10, 6)
    rows = clips.select("video_id", "clip_ordinal", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_index"))
    return governance.owner_violations(rows.withColumn("is_owner", (F.col("frame_index") + F.col("clip_ordinal")) % 7 == 0), ["video_id", "frame_index"])


@query("uniform_sample", N_FRAMES + """SELECT video_id, p::INT AS position, (p * (n_frames - 1) // 59)::INT AS frame_index, '' AS reason FROM (SELECT video_id, n_frames, unnest(range(0, 60)) AS p FROM n WHERE n_frames >= 60)
 UNION ALL SELECT video_id, NULL, NULL, 'INSUFFICIENT_UNIQUE_FRAMES' FROM n WHERE n_frames < 60""")
def uniform_sample(spark, sf):
    return windows.uniform_sample(_videos(spark, sf), 60)


SCENES = EV + ", sc AS (SELECT video_id, row_idx // 23 AS scene, min(row_idx) AS a, max(row_idx) AS b FROM ev GROUP BY ALL)"


def _scenes(spark, sf):
    e = evidence(spark, sf).select("video_id", F.floor(F.col("row_idx") / 23).alias("scene"), "row_idx")
    return e.groupBy("video_id", "scene").agg(F.min("row_idx").alias("start_frame"), F.max("row_idx").alias("end_frame"))


@query("scene_clips", SCENES + """, st AS (SELECT DISTINCT video_id, b, s FROM (SELECT video_id, b, unnest(range(a, greatest(b - 9, a) + 1, 6)) AS s FROM sc UNION ALL SELECT video_id, b, greatest(b - 9, a) FROM sc)),
 k AS (SELECT video_id, s, least(s + 9, b) AS e FROM st WHERE least(s + 9, b) > s)
 SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY s) - 1)::INT AS clip_ordinal, s::INT AS start_frame, e::INT AS end_frame FROM k""")
def scene_clips(spark, sf):
    return windows.scene_clips(_scenes(spark, sf), 10, 6)


WIN = SCENES + """, st AS (SELECT DISTINCT video_id, scene, a, b, s FROM (SELECT video_id, scene, a, b, unnest(range(a, greatest(b - 9, a) + 1, 6)) AS s FROM sc WHERE b - a + 1 >= 4 UNION ALL SELECT video_id, scene, a, b, greatest(b - 9, a) FROM sc WHERE b - a + 1 >= 4)),
 wi AS (SELECT video_id, scene, (row_number() OVER (PARTITION BY video_id ORDER BY s) - 1)::INT AS clip_ordinal, s AS cs, least(s + 9, b) AS ce, greatest(s - 3, a) AS va, least(least(s + 9, b) + 2, b) AS vb FROM st)
"""


@query("scene_windows", WIN + "SELECT video_id, scene, clip_ordinal, cs::INT AS core_start, ce::INT AS core_end, va::INT AS start_frame, vb::INT AS end_frame, ((cs + ce) // 2)::BIGINT AS reference_frame FROM wi")
def scene_windows(spark, sf):
    return windows.scene_windows(_scenes(spark, sf), 10, 6, 3, 2, 4)


@query("window_members", WIN + """, f AS (SELECT video_id, scene, clip_ordinal, unnest(range(va, vb + 1))::INT AS frame_index, (va + vb) / 2.0::DOUBLE AS c FROM wi),
 r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY abs(frame_index - c), clip_ordinal) = 1 AS own FROM f) SELECT video_id, scene, clip_ordinal, frame_index, own AS is_owned, NOT own AS is_context FROM r""")
def window_members(spark, sf):
    return windows.window_members(windows.scene_windows(_scenes(spark, sf), 10, 6, 3, 2, 4))


SERIES = EV + ", se AS (SELECT video_id, row_idx AS frame_index, normalized_value AS score, confidence AS quality FROM ev)"
SMOOTH = SERIES + ", sm AS (SELECT *, median(score) OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smoothed FROM se)"


def _series(spark, sf):
    return evidence(spark, sf).select("video_id", F.col("row_idx").alias("frame_index"), F.col("normalized_value").alias("score"), F.col("confidence").alias("quality"))


@query("moving_median", SMOOTH + f"SELECT video_id, frame_index, {r('score')} AS score, {r('quality')} AS quality, {r('smoothed')} AS smoothed FROM sm")
def moving_median(spark, sf):
    return windows.moving_median(_series(spark, sf), "video_id", 3)


INTERVALS = SMOOTH + """, hi AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER (PARTITION BY video_id ORDER BY frame_index) - 1 <= 1 THEN 0 ELSE 1 END AS new FROM sm WHERE smoothed >= 0.6),
hg AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY frame_index) AS g FROM hi),
iv AS (SELECT video_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, avg(smoothed) AS score, avg(quality) AS quality, count(*) AS valid_frames,
  (max(frame_index) - min(frame_index) + 1 - count(*))::BIGINT AS missing_frames FROM hg GROUP BY video_id, g HAVING max(frame_index) - min(frame_index) + 1 >= 2)
"""


@query("threshold_intervals", INTERVALS + f"SELECT video_id, start_frame, end_frame, {r('score')} AS score, {r('quality')} AS quality, valid_frames, missing_frames FROM iv")
def threshold_intervals(spark, sf):
    return windows.threshold_intervals(_series(spark, sf), "video_id", 0.6)


MERGED = INTERVALS + """, mr AS (SELECT *, max(end_frame) OVER (PARTITION BY video_id ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
mn AS (SELECT *, CASE WHEN start_frame - reach - 1 <= 4 THEN 0 ELSE 1 END AS new FROM mr), mg AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY start_frame) AS g FROM mn),
me AS (SELECT video_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, sum(score * valid_frames) / greatest(sum(valid_frames), 1) AS score,
  sum(quality * valid_frames) / greatest(sum(valid_frames), 1) AS quality, sum(valid_frames)::BIGINT AS valid_frames,
  sum(missing_frames + CASE WHEN new = 0 THEN greatest(start_frame - reach - 1, 0) ELSE 0 END)::BIGINT AS missing_frames FROM mg GROUP BY video_id, g)
"""


@query("merge_intervals", MERGED + f"SELECT video_id, start_frame, end_frame, {r('score')} AS score, {r('quality')} AS quality, valid_frames, missing_frames FROM me")
def merge_intervals(spark, sf):
    return windows.merge_intervals(windows.threshold_intervals(_series(spark, sf), "video_id", 0.6), "video_id", 4)


SUSPICIOUS = EV + LEVELS_SQL + """, su AS (SELECT *, max(end_frame) OVER (PARTITION BY video_id ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cl WHERE risk_score >= 0.5),
sg AS (SELECT *, sum(CASE WHEN start_frame - reach - 1 <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY start_frame) AS g FROM su),
sp AS (SELECT video_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, max(risk_score) AS risk_score, count(*) AS clips FROM sg GROUP BY video_id, g)
"""


def _clip_spans(spark, sf):
    e = evidence(spark, sf)
    return fusion.fuse_clips(e).join(e.groupBy("video_id", "clip_id").agg(F.min("row_idx").alias("start_frame"), F.max("row_idx").alias("end_frame")), ["video_id", "clip_id"])


@query("suspicious_merge", SUSPICIOUS + f"SELECT video_id, start_frame, end_frame, {r('risk_score')} AS risk_score, clips FROM sp")
def suspicious_merge(spark, sf):
    return windows.merge_suspicious(_clip_spans(spark, sf), 0.5)


@query("interval_iou", MERGED + f""", l AS (SELECT DISTINCT video_id, unnest(range(start_frame, end_frame + 1)) AS f FROM me), rr AS (SELECT video_id, row_idx AS f FROM ev WHERE normalized_value >= 0.6 AND valid),
  j AS (SELECT coalesce(l.video_id, rr.video_id) AS video_id, l.f AS a, rr.f AS b FROM l FULL JOIN rr ON l.video_id = rr.video_id AND l.f = rr.f)
  SELECT video_id, {r('count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*)')} AS iou FROM j GROUP BY ALL""")
def interval_iou(spark, sf):
    merged = windows.merge_intervals(windows.threshold_intervals(_series(spark, sf), "video_id", 0.6), "video_id", 4)
    target = _series(spark, sf).where("score >= 0.6").select("video_id", F.col("frame_index").alias("start_frame"), F.col("frame_index").alias("end_frame"))
    return windows.interval_iou(merged, target, "video_id")


@query("first_per_frame", EV + "SELECT video_id, clip_no AS frame_index, row_idx, name FROM ev QUALIFY row_number() OVER (PARTITION BY video_id, clip_no ORDER BY row_idx) = 1")
def first_per_frame(spark, sf):
    e = evidence(spark, sf).select("video_id", F.col("clip_no").alias("frame_index"), "row_idx", "name")
    return windows.first_per_frame(e, "video_id", "row_idx")


@query("forward_fill", EV + f"SELECT video_id, row_idx AS frame_index, {r('last_value(raw_value IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS filled FROM ev")
def forward_fill(spark, sf):
    return windows.forward_fill(evidence(spark, sf).select("video_id", F.col("row_idx").alias("frame_index"), F.col("raw_value").alias("filled")), "video_id", "filled")


# --- depth, size, visibility over evidence as tracked objects -----------------------------------

DEPTH = EV + """, dp AS (SELECT video_id, track_id, row_idx AS frame_index, raw_value + 0.5 AS depth, 2.0::DOUBLE AS reference, confidence + 0.1 AS size, confidence FROM ev WHERE valid AND track_id IS NOT NULL),
dg AS (SELECT *, ln(depth / reference + 1e-6) + ln(size + 1e-6) AS g FROM dp),
dl AS (SELECT *, frame_index - lag(frame_index) OVER w AS gap, lag(g) OVER w AS g0, lag(confidence) OVER w AS c0 FROM dg WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_index)),
dt AS (SELECT video_id, track_id, frame_index, gap, CASE WHEN gap BETWEEN 1 AND 3 THEN greatest(0, abs(g - g0) - 0.1) END AS residual, CASE WHEN gap BETWEEN 1 AND 3 THEN sqrt(confidence * c0) END AS weight FROM dl)
"""


def _depth_rows(spark, sf):
    e = evidence(spark, sf).where("valid AND track_id IS NOT NULL")
    return e.select("video_id", "track_id", F.col("row_idx").alias("frame_index"), (F.col("raw_value") + 0.5).alias("depth"), F.lit(2.0).alias("reference"), (F.col("confidence") + 0.1).alias("size"), "confidence", "branch")


@query("depth_transitions", DEPTH + f"SELECT video_id, track_id, frame_index, gap, {r('residual')} AS residual, {r('weight')} AS weight FROM dt")
def depth_transitions(spark, sf):
    return residuals.depth_transitions(_depth_rows(spark, sf), max_gap=3)


@query("track_summary", DEPTH + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY residual DESC NULLS LAST, frame_index) AS rn FROM dt)
SELECT video_id, track_id, {r('coalesce(avg(residual), 0)')} AS mean, {r('coalesce(max(residual), 0)')} AS max, {r('coalesce(avg(residual) FILTER (rn <= 3), 0)')} AS top_mean, {r('count(residual) / count(*)')} AS valid_ratio FROM rk GROUP BY ALL""")
def track_summary(spark, sf):
    return residuals.track_summary(residuals.depth_transitions(_depth_rows(spark, sf), max_gap=3))


@query("size_history", EV + f""", sz AS (SELECT video_id, track_id, row_idx AS frame_index, raw_value + 0.5 AS size, ord % 2 AS axis, confidence FROM ev WHERE valid AND track_id IS NOT NULL),
  h AS (SELECT *, list({{'a': axis, 's': size, 'c': confidence}}) OVER (PARTITION BY video_id, track_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS al FROM sz),
  g AS (SELECT *, list_filter(coalesce(al, []), lambda x: x.a = axis) AS same FROM h),
  k AS (SELECT *, same[greatest(1, len(same) - 4):] AS last FROM g)
  SELECT video_id, track_id, frame_index, {r("CASE WHEN len(last) > 0 THEN abs(ln(size) - ln(list_median(list_transform(last, lambda x: x.s)))) END")} AS residual,
    {r("CASE WHEN len(last) > 0 THEN least(confidence, list_median(list_transform(last, lambda x: x.c))) ELSE 0 END")} AS confidence,
    CASE WHEN len(last) > 0 THEN '' WHEN len(coalesce(al, [])) > 0 THEN 'no_comparable_axis_history' ELSE 'no_track_history' END AS reason FROM k""")
def size_history(spark, sf):
    e = evidence(spark, sf).where("valid AND track_id IS NOT NULL")
    return residuals.size_history(e.select("video_id", "track_id", F.col("row_idx").alias("frame_index"), (F.col("raw_value") + 0.5).alias("size"), (F.col("ord") % 2).alias("axis"), "confidence"))


@query("reappearance", EV + f""", x AS (SELECT video_id, row_idx, ((ord % 50) + 50) / 100.0::DOUBLE AS a, ((ord % 40) + 60) / 100.0::DOUBLE AS s, ((ord % 30) + 70) / 100.0::DOUBLE AS d, ((ord % 20) + 40) / 100.0::DOUBLE AS m, ord % 2 = 0 AS same_id, ord % 7 <> 0 AS lm, ord % 41 = 0 AS cut FROM ev),
  y AS (SELECT *, (a + s + d + m) / 4 AS q, lm AND NOT cut AND (a + s + d + m) / 4 >= CASE WHEN same_id THEN 0.60::DOUBLE ELSE 0.85::DOUBLE END AS accepted FROM x)
  SELECT video_id, row_idx, {r('q')} AS quality, accepted, {r('CASE WHEN accepted THEN 1 - q END')} AS residual FROM y""")
def reappearance(spark, sf):
    k = F.col("ord")
    rows = evidence(spark, sf).select("video_id", "row_idx", ((k % 50 + 50) / 100.0).alias("appearance"), ((k % 40 + 60) / 100.0).alias("structure"), ((k % 30 + 70) / 100.0).alias("depth"), ((k % 20 + 40) / 100.0).alias("motion"), (k % 2 == 0).alias("same_id"), (k % 7 != 0).alias("label_match"), (k % 41 == 0).alias("scene_cut"))
    return relations.reappearance(rows).select("video_id", "row_idx", "quality", "accepted", "residual")


# --- contract ------------------------------------------------------------------------------------


BROKEN = EV + """, bk AS (SELECT video_id, row_idx, valid, CASE WHEN ord % 101 = 0 THEN -1.0 WHEN ord % 103 = 0 THEN NULL WHEN ord % 107 = 0 THEN 0.5 ELSE raw_value END AS raw_value, normalized_value,
   CASE WHEN ord % 109 = 0 THEN 1.5 ELSE confidence END AS confidence, CASE WHEN ord % 113 = 0 THEN '' WHEN ord % 127 = 0 THEN 'odd' ELSE reason END AS reason FROM ev)
"""


@query("contract_violations", BROKEN + "SELECT video_id, row_idx FROM bk WHERE valid AND (raw_value IS NULL OR normalized_value IS NULL OR raw_value < 0 OR reason <> '') OR NOT valid AND (raw_value IS NOT NULL OR confidence <> 0 OR reason = '') OR confidence NOT BETWEEN 0 AND 1")
def contract_violations(spark, sf):
    """Evidence with every kind of breach put in."""
    k = F.col("ord")
    rows = evidence(spark, sf)
    rows = rows.withColumn("raw_value", F.when(k % 101 == 0, -1.0).when(k % 103 == 0, F.lit(None)).when(k % 107 == 0, 0.5).otherwise(F.col("raw_value")))
    rows = rows.withColumn("confidence", F.when(k % 109 == 0, 1.5).otherwise(F.col("confidence"))).withColumn("reason", F.when(k % 113 == 0, "").when(k % 127 == 0, "odd").otherwise(F.col("reason")))
    return contract.violations(rows).select("video_id", "row_idx")


@query("ablation_filter", EV + LEVELS_SQL.replace("FROM ev", f"FROM (SELECT * FROM ev WHERE name IN ({', '.join(map(repr, contract.ABLATIONS['motion_tracks_only']))}))") + f"SELECT video_id, clip_id, {r('risk_score')} AS risk_score, {r('coverage')} AS coverage, {r('confidence')} AS confidence FROM cl")
def ablation_filter(spark, sf):
    return fusion.fuse_clips(contract.ablate(evidence(spark, sf), "motion_tracks_only"))


@query("ablation_blank_channels", EV + ", ev_b AS (SELECT * REPLACE (valid AND name NOT IN ('relation', 'occlusion') AS valid, CASE WHEN name NOT IN ('relation', 'occlusion') THEN normalized_value END AS normalized_value, CASE WHEN name IN ('relation', 'occlusion') THEN 0 ELSE confidence END AS confidence) FROM ev)" + LEVELS_SQL.replace("FROM ev", "FROM ev_b") + f"SELECT video_id, clip_id, {r('risk_score')} AS risk_score, {r('coverage')} AS coverage, {r('confidence')} AS confidence FROM cl")
def ablation_blank_channels(spark, sf):
    return fusion.fuse_clips(contract.blank(evidence(spark, sf), ["relation", "occlusion"]))


ELIG = EV + """, sa AS (SELECT video_id AS sample_id, CASE WHEN substr(video_id, 2)::INT % 10 < 7 THEN 'train' WHEN substr(video_id, 2)::INT % 10 < 9 THEN 'validation' ELSE 'test' END AS split, substr(video_id, 2)::INT % 2 AS label,
    substr(video_id, 2)::INT % 23 <> 0 AS has_file, substr(video_id, 2)::INT % 19 <> 0 AS well_formed FROM ev GROUP BY ALL),
  rw AS (SELECT video_id AS sample_id, row_idx AS position, ord % 97 <> 0 AS known, valid, valid AND ord % 103 <> 0 AS observed, confidence FROM ev WHERE substr(video_id, 2)::INT % 3 = 0 OR ord % 97 <> 0 AND ord % 103 <> 0),
  rp AS (SELECT *, CASE WHEN NOT known THEN 'unknown channel' WHEN valid AND NOT observed THEN 'valid but not observed' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence outside [0, 1]' END AS problem FROM rw),
  rr AS (SELECT *, row_number() OVER (PARTITION BY sample_id, problem IS NULL ORDER BY position) AS rn FROM rp),
  ea AS (SELECT sample_id, count(*) AS rows, count(*) FILTER (valid) AS valid_rows, count(problem) AS schema_errors, string_agg('row ' || position || ': ' || problem, '; ' ORDER BY position) FILTER (problem IS NOT NULL AND rn <= 10) AS messages FROM rr GROUP BY ALL),
  el AS (SELECT sa.sample_id, split, label, coalesce(rows, 0) AS rows, coalesce(valid_rows, 0) AS valid_rows, coalesce(schema_errors, 0) AS schema_errors,
    CASE WHEN NOT has_file THEN 'missing' WHEN NOT well_formed THEN 'malformed' WHEN coalesce(schema_errors, 0) > 0 THEN 'schema_error' WHEN coalesce(valid_rows, 0) = 0 THEN 'no_valid_residual' WHEN valid_rows < rows THEN 'partial_missing' ELSE 'eligible' END AS status, CASE WHEN has_file AND well_formed THEN coalesce(messages, '') ELSE '' END AS errors FROM sa LEFT JOIN ea USING (sample_id))
"""


def _eligibility(spark, sf):
    e = evidence(spark, sf)
    n = F.substring("sample_id", 2, 20).cast("int")
    s = e.select(F.col("video_id").alias("sample_id")).distinct()
    s = s.select("sample_id", F.when(n % 10 < 7, "train").when(n % 10 < 9, "validation").otherwise("test").alias("split"), (n % 2).alias("label"), (n % 23 != 0).alias("has_file"), (n % 19 != 0).alias("well_formed"))
    k = F.col("ord")
    # Two thirds of the samples have no schema errors.
    e = e.where((F.substring("video_id", 2, 20).cast("int") % 3 == 0) | ((k % 97 != 0) & (k % 103 != 0)))
    rows = e.select(F.col("video_id").alias("sample_id"), F.col("row_idx").alias("position"), (k % 97 != 0).alias("known_channel"), "valid", (F.col("valid") & (k % 103 != 0)).alias("observed"), "confidence")
    return governance.eligibility(s, rows)


@query("eligibility_audit", ELIG + "SELECT * FROM el")
def eligibility_audit(spark, sf):
    return _eligibility(spark, sf)


@query("eligibility_summary", ELIG + f"SELECT split, status, count(sample_id) AS samples FROM (SELECT * FROM (SELECT unnest({list(governance.SPLITS)!r}) AS split), (SELECT unnest({list(governance.STATUSES)!r}) AS status)) LEFT JOIN el USING (split, status) GROUP BY ALL")
def eligibility_summary(spark, sf):
    return governance.eligibility_summary(_eligibility(spark, sf))


@query("eligible_split", ELIG + "SELECT * FROM el WHERE split = 'train' AND status IN ('eligible', 'partial_missing')")
def eligible_split(spark, sf):
    return governance.eligible(_eligibility(spark, sf), "train")


