"""Queries over visibility states, their explanations and occlusion events.

A track is a video's objects by event type; its observations come from the event number.
The oracles follow the track row by row (recursive), the operators by windows. Some numbers
are NaN, infinite or NULL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import visibility

from .adapters import EV, evidence
from .registry import odd, query, r

_VIS = {
    "scene_cut": "ord % 41 = 0",
    "geometry_available": "ord % 29 <> 0",
    "supported": "ord % 7 <> 0",
    "predicted_area": "CAST(40 + ord % 60 AS DOUBLE)",
    "covered_area": "CAST((ord * 13) % (40 + ord % 60) AS DOUBLE)",
    "occluders": "CAST(ord % 3 AS INT)",
    "in_frame_ratio": "CAST((ord * 3) % 100 AS DOUBLE) / 100",
    "prediction_quality": "CAST((ord * 11) % 100 AS DOUBLE) / 100",
    "seen": "ord % 5 < 2",
    "observed_area": "CAST((ord * 17) % 100 AS DOUBLE)",
    "observed_confidence": "CAST((ord * 19) % 100 AS DOUBLE) / 100",
    "legacy": "ord % 5 < 2 AND ord % 31 = 0",
    "detector_confidence": "CAST((ord * 23) % 100 AS DOUBLE) / 100",
    "confirmed_absent": "ord % 2 = 0",
    "predicted_legacy": "ord % 17 = 4",
}
_OCC = {
    "provider_failed": "ord % 43 = 0",
    "scene_cut": "ord % 41 = 0",
    "has_history": "ord % 37 <> 0",
    "quality": "CAST(40 + (ord * 11) % 60 AS DOUBLE) / 100",
    "candidate": "ord % 4 < 2",
    "identity_consistent": "ord % 11 <> 0",
    "seen": "ord % 5 < 2",
    "has_mask": "ord % 13 <> 0",
    "visible_ratio": "CAST((ord * 17) % 100 AS DOUBLE) / 100",
    "overlap": "CAST((ord * 7) % 100 AS DOUBLE) / 100",
    "depth_order": "ord % 6 <> 0",
    "d2_supported": "ord % 8 <> 0",
    "occluders": "CAST(ord % 3 AS INT)",
    "in_frame_ratio": "CAST((ord * 3) % 100 AS DOUBLE) / 100",
    "tracker_failed": "ord % 19 = 0",
    "detector_attempted": "ord % 3 <> 2",
    "detector_reliable": "ord % 10 < 6",
    "confirmed_absent": "ord % 9 < 6",
}


#: Each of these is missing in rows of its own.
_ODD = {"quality": "(ord + 1)", "visible_ratio": "(ord + 2)", "overlap": "(ord + 3)", "in_frame_ratio": "(ord + 4)", "predicted_area": "(ord + 5)", "covered_area": "(ord + 6)", "prediction_quality": "(ord + 8)", "observed_area": "(ord + 9)", "observed_confidence": "(ord + 10)", "detector_confidence": "(ord + 11)"}


def _with_gaps(columns, sql):
    return {name: odd(x, _ODD[name], sql) if name in _ODD else x for name, x in columns.items()}


def _rows(spark, sf, columns):
    e = evidence(spark, sf).select("video_id", "event_type", "row_idx", "ord")
    return e.select("video_id", F.col("event_type").alias("object_id"), F.col("row_idx").alias("frame_index"), *[F.expr(x).alias(name) for name, x in _with_gaps(columns, False).items()])


def _sql(columns):
    fields = ", ".join(f"{x} AS {name}" for name, x in _with_gaps(columns, True).items())
    return EV.replace("WITH ev0", "WITH RECURSIVE ev0") + f""", v AS (SELECT video_id, event_type AS object_id, row_idx AS frame_index, row_number() OVER (PARTITION BY video_id, event_type ORDER BY row_idx) AS n, {fields} FROM ev)
"""


STATE = _sql(_VIS) + """, w AS (SELECT *, least(1.0, CASE WHEN seen THEN observed_area ELSE 0 END / greatest(predicted_area, 1)) AS vr, covered_area / greatest(predicted_area, 1) AS orr FROM v),
st AS (SELECT video_id, object_id, n, 'uncertain' AS previous_state, CASE WHEN scene_cut THEN 'scene_cut' WHEN NOT geometry_available OR NOT supported THEN 'uncertain'
    WHEN seen THEN CASE WHEN vr >= 0.8 THEN 'fully_visible' WHEN vr > 0 THEN 'partially_occluded' ELSE 'uncertain' END
    WHEN in_frame_ratio <= 0.2 THEN 'out_of_frame' WHEN orr >= 0.8 AND occluders > 0 THEN 'fully_occluded' WHEN confirmed_absent AND detector_confidence >= 0.5 THEN 'uncertain' ELSE 'detector_missing' END AS state
  FROM w WHERE n = 1
  UNION ALL
  SELECT w.video_id, w.object_id, w.n, st.state, CASE WHEN scene_cut THEN 'scene_cut' WHEN NOT geometry_available THEN 'uncertain'
    WHEN NOT supported THEN CASE WHEN seen AND st.state IN ('fully_occluded', 'out_of_frame') THEN 'reappeared' ELSE 'uncertain' END
    WHEN seen THEN CASE WHEN st.state = 'fully_occluded' THEN 'reappeared' WHEN vr >= 0.8 THEN 'fully_visible' WHEN vr > 0 THEN 'partially_occluded' ELSE 'uncertain' END
    WHEN in_frame_ratio <= 0.2 THEN 'out_of_frame' WHEN orr >= 0.8 AND occluders > 0 THEN 'fully_occluded' WHEN confirmed_absent AND detector_confidence >= 0.5 THEN 'uncertain' ELSE 'detector_missing' END
  FROM st JOIN w ON w.video_id = st.video_id AND w.object_id = st.object_id AND w.n = st.n + 1),
ob AS (SELECT w.video_id, w.object_id, w.frame_index, previous_state, state, w.legacy,
    CASE WHEN scene_cut THEN 'scene_cut_breaks_visibility_history' WHEN NOT geometry_available THEN 'dynamic_geometry_unavailable'
      WHEN NOT supported THEN CASE WHEN NOT seen THEN 'missing_predicted_support' WHEN state <> 'reappeared' THEN 'insufficient_history_for_appearance_explanation' WHEN legacy THEN 'legacy_bbox_mask_visibility_diagnostic_only' ELSE '' END
      WHEN seen THEN CASE WHEN legacy OR predicted_legacy THEN 'legacy_bbox_mask_visibility_diagnostic_only' ELSE '' END
      WHEN state = 'detector_missing' THEN CASE WHEN detector_confidence < 0.5 THEN 'low_detector_confidence' ELSE 'missing_detection_is_not_occlusion' END WHEN predicted_legacy THEN 'legacy_bbox_mask_visibility_diagnostic_only' ELSE '' END AS reason,
    CASE WHEN scene_cut OR NOT geometry_available THEN 0 WHEN NOT supported THEN CASE WHEN state = 'reappeared' THEN observed_confidence ELSE 0 END WHEN seen THEN least(prediction_quality, observed_confidence)
      WHEN state = 'detector_missing' THEN 0 WHEN state = 'uncertain' THEN least(prediction_quality, detector_confidence) ELSE prediction_quality END::DOUBLE AS quality,
    CASE WHEN scene_cut OR NOT geometry_available THEN NULL WHEN NOT supported THEN CASE WHEN state = 'reappeared' THEN 1.0 END WHEN state = 'detector_missing' THEN NULL ELSE vr END::DOUBLE AS visible_ratio,
    CASE WHEN scene_cut OR NOT geometry_available THEN NULL WHEN NOT supported THEN CASE WHEN state = 'reappeared' THEN 1.0 END ELSE in_frame_ratio END AS ifr,
    CASE WHEN scene_cut OR NOT geometry_available OR NOT supported THEN 0 ELSE occluders END AS oc
  FROM w JOIN st USING (video_id, object_id, n))
"""


@query("visibility_state", STATE + f"SELECT video_id, object_id, frame_index, previous_state, state, reason = '' AS valid, reason, {r('quality')} AS quality, {r('visible_ratio')} AS visible_ratio FROM ob")
def visibility_state(spark, sf):
    out = visibility.visibility_states(_rows(spark, sf, _VIS), ["video_id", "object_id"])
    return out.select("video_id", "object_id", "frame_index", "previous_state", "state", "valid", "reason", "quality", "visible_ratio")


#: Every sighting without a predicted support reappears.
APPEARED = STATE.replace("WHEN NOT geometry_available OR NOT supported THEN 'uncertain'", "WHEN NOT geometry_available THEN 'uncertain' WHEN NOT supported THEN CASE WHEN seen THEN 'reappeared' ELSE 'uncertain' END").replace("WHEN seen AND st.state IN ('fully_occluded', 'out_of_frame') THEN 'reappeared'", "WHEN seen THEN 'reappeared'")


@query("visibility_appearance", APPEARED + f"SELECT video_id, object_id, frame_index, previous_state, state, reason = '' AS valid, reason, {r('quality')} AS quality, {r('visible_ratio')} AS visible_ratio FROM ob")
def visibility_appearance(spark, sf):
    out = visibility.visibility_states(_rows(spark, sf, _VIS), ["video_id", "object_id"], appearance_is_event=True)
    return out.select("video_id", "object_id", "frame_index", "previous_state", "state", "valid", "reason", "quality", "visible_ratio")


@query("visibility_explanation", STATE + """, ex AS (SELECT *, reason = '' OR legacy AND reason = 'legacy_bbox_mask_visibility_diagnostic_only' AS judged FROM ob),
 ey AS (SELECT *, CASE WHEN state = 'detector_missing' THEN 'detector_uncertain' WHEN NOT judged THEN 'no_visibility_event' WHEN state = 'fully_occluded' AND oc > 0 THEN 'explained_occlusion' WHEN state = 'out_of_frame' THEN 'explained_out_of_frame'
    WHEN state = 'reappeared' AND previous_state NOT IN ('fully_occluded', 'out_of_frame') THEN 'unexplained_appearance' WHEN state = 'uncertain' AND ifr > 0.5 AND oc = 0 THEN 'unexplained_disappearance' ELSE 'no_visibility_event' END AS explanation FROM ex)
 SELECT video_id, object_id, frame_index, explanation, CASE WHEN judged THEN CASE WHEN explanation LIKE 'unexplained%' THEN 1.0 ELSE 0.0 END END::DOUBLE AS diagnostic,
   CASE WHEN judged AND reason = '' AND explanation LIKE 'unexplained%' THEN 1.0 END::DOUBLE AS residual,
   CASE WHEN NOT judged THEN reason WHEN reason = '' AND explanation LIKE 'unexplained%' THEN '' WHEN explanation NOT LIKE 'unexplained%' AND explanation <> 'detector_uncertain' THEN 'explained_visibility_change' ELSE coalesce(nullif(reason, ''), 'detector_uncertain') END AS reason FROM ey""")
def visibility_explanation(spark, sf):
    states = visibility.visibility_states(_rows(spark, sf, _VIS), ["video_id", "object_id"])
    return visibility.visibility_explanation(states).select("video_id", "object_id", "frame_index", "explanation", "diagnostic", "residual", "reason")


def _event(previous: str) -> str:
    return f"""CASE WHEN blocked <> '' THEN 'unknown' WHEN candidate AND NOT identity_consistent THEN 'track_failure' WHEN candidate AND {previous} IN ('full_occlusion', 'out_of_frame', 'true_disappearance') THEN 'reappearance'
    WHEN seen THEN CASE WHEN has_mask AND visible_ratio > 0 AND visible_ratio < 0.8 AND overlap > 0 AND depth_order AND d2_supported AND occluders > 0 THEN 'partial_occlusion' ELSE 'unknown' END
    WHEN in_frame_ratio <= 0.2 THEN 'out_of_frame' WHEN has_mask AND overlap >= 0.75 AND depth_order AND d2_supported AND occluders > 0 THEN 'full_occlusion' WHEN tracker_failed THEN 'track_failure'
    WHEN detector_attempted AND detector_reliable AND confirmed_absent AND occluders = 0 AND absence >= 2 THEN 'true_disappearance' WHEN detector_attempted AND NOT detector_reliable AND d2_supported AND in_frame_ratio > 0.2 THEN 'detector_miss' ELSE 'unknown' END"""


@query("occlusion_events", _sql(_OCC) + f""", b AS (SELECT *, CASE WHEN provider_failed THEN 'event_provider_failed' WHEN scene_cut THEN 'scene_cut_breaks_event_history' WHEN NOT has_history THEN 'history_prediction_unavailable' WHEN quality IS NULL OR quality < 0.5 THEN 'track_prediction_quality_insufficient' ELSE '' END AS blocked,
   n - coalesce(max(CASE WHEN seen THEN n END) OVER (PARTITION BY video_id, object_id ORDER BY n), 0) AS absence FROM v),
 e AS (SELECT video_id, object_id, n, {_event("'unknown'")} AS event FROM b WHERE n = 1 UNION ALL SELECT b.video_id, b.object_id, b.n, {_event('e.event')} FROM e JOIN b ON b.video_id = e.video_id AND b.object_id = e.object_id AND b.n = e.n + 1),
 f AS (SELECT *, CASE WHEN event <> 'unknown' THEN '' WHEN blocked <> '' THEN blocked WHEN seen THEN 'not_applicable_no_event' ELSE 'event_observation_unresolved' END AS reason FROM b JOIN e USING (video_id, object_id, n))
 SELECT video_id, object_id, frame_index, absence::BIGINT AS absence, event, reason, CASE WHEN event <> 'unknown' THEN 'executed_valid' WHEN reason = 'event_provider_failed' THEN 'provider_failed' WHEN reason IN ('scene_cut_breaks_event_history', 'not_applicable_no_event') THEN 'not_applicable' ELSE 'blocked_by_input' END AS status,
   {r("CASE WHEN event = 'unknown' THEN 0 WHEN event IN ('partial_occlusion', 'full_occlusion') THEN least(quality, overlap) ELSE quality END")} AS confidence FROM f""")
def occlusion_events(spark, sf):
    out = visibility.occlusion_events(_rows(spark, sf, _OCC), ["video_id", "object_id"])
    return out.select("video_id", "object_id", "frame_index", "absence", "event", "reason", "status", "confidence")
