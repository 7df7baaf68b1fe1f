"""What an object's visibility says: states, their explanation and occlusion events.

Absence of a detection is never an occlusion by itself. A state or event depends on its
predecessor only through a few states that an unseen object alone can have, so a
window over the track replaces the state machine. NaN and infinities are missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import without_nan

#: Names of states, explanations and events.
STATES = ("fully_visible", "partially_occluded", "fully_occluded", "out_of_frame", "detector_missing", "reappeared", "scene_cut", "uncertain")
EXPLANATIONS = ("explained_occlusion", "explained_out_of_frame", "unexplained_disappearance", "unexplained_appearance", "detector_uncertain", "no_visibility_event")
EVENTS = ("partial_occlusion", "full_occlusion", "out_of_frame", "detector_miss", "track_failure", "true_disappearance", "reappearance", "unknown")
#: Events that a later sighting ends.
GONE = ("full_occlusion", "out_of_frame", "true_disappearance")

FULL_VISIBLE, FULL_OCCLUDED, OUT_OF_FRAME, DETECTOR = 0.80, 0.80, 0.20, 0.5


def first_rule(*rules: tuple[Column, Column | str]) -> Column:
    """The value of the first rule that holds (a rule that is NULL doesn't)."""
    out = None
    for cond, value in rules:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def visibility_states(rows: DataFrame, keys: list[str], appearance_is_event: bool = False) -> DataFrame:
    """previous_state, state, ratios, quality, valid and reason of an object in every frame.

    Rows: keys, frame_index, scene_cut, geometry_available, supported (a predicted support exists),
    predicted_area, covered_area (support under nearer objects), occluders (how many), in_frame_ratio,
    prediction_quality, seen (a mask was observed), observed_area, observed_confidence,
    legacy (the observation is a box only), detector_confidence, confirmed_absent, and, if there, predicted_legacy (the support was
    predicted from boxes: never more than a diagnostic). A row without a
    predecessor has the previous state ``uncertain``. With ``appearance_is_event`` a sighting without support reappears whatever came before.

    Only sightings look back, and only for ``fully_occluded`` and ``out_of_frame``, which
    rows without a sighting have whatever came before: one lag suffices.
    """
    c, rows = F.col, without_nan(rows, infinite=True)
    usable = c("geometry_available") & c("supported")
    ratio = F.least(F.lit(1.0), F.when(c("seen"), c("observed_area")).otherwise(F.lit(0.0)) / F.greatest(c("predicted_area"), F.lit(1.0)))
    covered = c("covered_area") / F.greatest(c("predicted_area"), F.lit(1.0))
    hidden = first_rule(
        (c("scene_cut"), F.lit("scene_cut")),
        (~usable | c("seen"), F.lit(None).cast("string")),
        (c("in_frame_ratio") <= OUT_OF_FRAME, "out_of_frame"),
        ((covered >= FULL_OCCLUDED) & (c("occluders") > 0), "fully_occluded"),
    )
    before = F.lag("_hidden").over(Window.partitionBy(*keys).orderBy("frame_index"))
    out = rows.withColumn("_hidden", hidden).withColumn("_before", before)
    back = F.coalesce(c("_before").isin("fully_occluded", "out_of_frame"), F.lit(False)) | F.lit(appearance_is_event)
    boxed = F.coalesce("predicted_legacy", F.lit(False)) if "predicted_legacy" in rows.columns else F.lit(False)
    occluded = F.coalesce(c("_before") == "fully_occluded", F.lit(False))
    state = first_rule(
        (c("scene_cut"), "scene_cut"),
        (~c("geometry_available"), "uncertain"),
        (~c("supported") & c("seen") & back, "reappeared"),
        (~c("supported"), "uncertain"),
        (c("seen") & occluded, "reappeared"),
        (c("seen") & (ratio >= FULL_VISIBLE), "fully_visible"),
        (c("seen") & (ratio > 0), "partially_occluded"),
        (c("seen"), "uncertain"),
        (c("_hidden").isNotNull(), c("_hidden")),
        (c("confirmed_absent") & (c("detector_confidence") >= DETECTOR), "uncertain"),
    ).otherwise("detector_missing")
    legacy = "legacy_bbox_mask_visibility_diagnostic_only"
    reason = first_rule(
        (c("scene_cut"), "scene_cut_breaks_visibility_history"),
        (~c("geometry_available"), "dynamic_geometry_unavailable"),
        (~c("supported") & c("seen") & back & c("legacy"), legacy),
        (~c("supported") & c("seen") & back, ""),
        (~c("supported") & c("seen"), "insufficient_history_for_appearance_explanation"),
        (~c("supported"), "missing_predicted_support"),
        (c("seen") & c("legacy"), legacy),
        ((c("state") == "detector_missing") & (c("detector_confidence") < DETECTOR), "low_detector_confidence"),
        (c("state") == "detector_missing", "missing_detection_is_not_occlusion"),
        (boxed, legacy),
    ).otherwise("")
    out = out.withColumn("state", state).withColumn("reason", reason)
    bare = c("scene_cut") | ~c("geometry_available") | (~c("supported") & (c("state") != "reappeared"))
    quality = first_rule(
        (bare, F.lit(0.0)),
        (~c("supported"), c("observed_confidence")),
        (c("seen"), F.least(c("prediction_quality"), c("observed_confidence"))),
        (c("state") == "detector_missing", F.lit(0.0)),
        (c("state") == "uncertain", F.least(c("prediction_quality"), c("detector_confidence"))),
    ).otherwise(c("prediction_quality"))
    again = ~c("supported")
    out = out.withColumn("quality", quality).withColumn("valid", c("reason") == "")
    out = out.withColumn("visible_ratio", F.when(bare | (c("state") == "detector_missing"), F.lit(None)).when(again, F.lit(1.0)).otherwise(ratio))
    out = out.withColumn("occluded_ratio", F.when(bare, F.lit(None)).when(again, F.lit(0.0)).otherwise(covered))
    out = out.withColumn("in_frame_ratio", F.when(bare, F.lit(None)).when(again, F.lit(1.0)).otherwise(c("in_frame_ratio")))
    out = out.withColumn("occluders", F.when(bare | again, F.lit(0)).otherwise(c("occluders")))
    previous = F.coalesce(F.lag("state").over(Window.partitionBy(*keys).orderBy("frame_index")), F.lit("uncertain"))
    return out.withColumn("previous_state", previous).drop("_hidden", "_before")


def visibility_explanation(states: DataFrame) -> DataFrame:
    """explanation, diagnostic, residual, reason: explained changes and an uncertain detector are no evidence.

    Rows: what :func:`visibility_states` gives (previous_state, state, valid, legacy, reason,
    in_frame_ratio, occluders). A row that isn't valid, unless for its box alone, has no diagnostic value.
    """
    c, states = F.col, without_nan(states, infinite=True)
    judged = c("valid") | (c("legacy") & (c("reason") == "legacy_bbox_mask_visibility_diagnostic_only"))
    missing = c("state") == "detector_missing"
    explanation = first_rule(
        (missing, "detector_uncertain"),
        (~judged, "no_visibility_event"),
        ((c("state") == "fully_occluded") & (c("occluders") > 0), "explained_occlusion"),
        (c("state") == "out_of_frame", "explained_out_of_frame"),
        ((c("state") == "reappeared") & ~c("previous_state").isin("fully_occluded", "out_of_frame"), "unexplained_appearance"),
        ((c("state") == "uncertain") & (c("in_frame_ratio") > 0.5) & (c("occluders") == 0), "unexplained_disappearance"),
    ).otherwise("no_visibility_event")
    odd = c("explanation").isin("unexplained_appearance", "unexplained_disappearance")
    out = states.withColumnRenamed("reason", "_reason").withColumn("reason", c("_reason"))
    out = out.withColumn("explanation", explanation).withColumn("diagnostic", F.when(judged, odd.cast("double")))
    out = out.withColumn("residual", F.when(judged & odd & c("valid"), F.lit(1.0)))
    why = F.when(~judged, F.when(c("_reason") == "", "visibility_observation_missing").otherwise(c("_reason")))
    why = why.when(c("residual").isNotNull(), "").when(c("explanation").isin("explained_occlusion", "explained_out_of_frame", "no_visibility_event"), "explained_visibility_change")
    return out.withColumn("reason", why.otherwise(F.when(c("_reason") == "", "detector_uncertain").otherwise(c("_reason")))).drop("_reason")


def occlusion_events(
    rows: DataFrame, keys: list[str], partial: float = 0.80, full: float = 0.75, out_of_frame: float = 0.20, least_quality: float = 0.50, confirm: int = 2
) -> DataFrame:
    """event, status, confidence, reason and absence (frames without a sighting in a row) of every row.

    Rows: keys, frame_index, provider_failed, scene_cut, has_history, quality, candidate,
    identity_consistent, seen, has_mask, visible_ratio, overlap, depth_order, d2_supported, occluders,
    in_frame_ratio, tracker_failed, detector_attempted, detector_reliable, confirmed_absent.

    Of the event before only "gone or not" matters. A row is gone by itself, unless a
    candidate of the same identity turns it into a reappearance, which takes a predecessor that is gone: along
    a run of such rows "gone" alternates, so the parity of the place in the run decides.
    """
    c, rows = F.col, without_nan(rows, infinite=True)
    by = Window.partitionBy(*keys).orderBy("frame_index")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_sights", F.sum(c("seen").cast("int")).over(run))
    in_absence = Window.partitionBy(*keys, "_sights").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("absence", F.sum((~c("seen")).cast("int")).over(in_absence))
    blocked = first_rule(
        (c("provider_failed"), "event_provider_failed"),
        (c("scene_cut"), "scene_cut_breaks_event_history"),
        (~c("has_history"), "history_prediction_unavailable"),
        (c("quality").isNull() | (c("quality") < least_quality), "track_prediction_quality_insufficient"),
    )
    supported = c("has_mask") & c("depth_order") & c("d2_supported") & (c("occluders") > 0)
    alone = first_rule(
        (c("candidate") & ~c("identity_consistent"), "track_failure"),
        (c("seen") & supported & (c("visible_ratio") > 0) & (c("visible_ratio") < partial) & (c("overlap") > 0), "partial_occlusion"),
        (c("seen"), "unknown"),
        (c("in_frame_ratio") <= out_of_frame, "out_of_frame"),
        (supported & (c("overlap") >= full), "full_occlusion"),
        (c("tracker_failed"), "track_failure"),
        (c("detector_attempted") & c("detector_reliable") & c("confirmed_absent") & (c("occluders") == 0) & (c("absence") >= confirm), "true_disappearance"),
        (c("detector_attempted") & ~c("detector_reliable") & c("d2_supported") & (c("in_frame_ratio") > out_of_frame), "detector_miss"),
    ).otherwise("unknown")
    out = out.withColumn("_blocked", blocked).withColumn("_alone", F.when(c("_blocked").isNotNull(), "unknown").otherwise(alone))
    same = F.coalesce(c("_blocked").isNull() & c("candidate") & c("identity_consistent"), F.lit(False))
    gone = c("_alone").isin(*GONE)
    out = out.withColumn("_same", same).withColumn("_gone", gone).withColumn("_turns", same & gone)
    out = out.withColumn("_anchor", F.sum((~c("_turns")).cast("int")).over(run))
    in_run = Window.partitionBy(*keys, "_anchor").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum(c("_turns").cast("int")).over(in_run)
    anchored = F.first(F.when(~c("_turns"), c("_gone")).otherwise(False)).over(in_run)
    out = out.withColumn("_is_gone", F.when(turns % 2 == 0, anchored).otherwise(~anchored))
    was_gone = F.coalesce(F.lag("_is_gone").over(by), F.lit(False))
    out = out.withColumn("event", F.when(c("_same") & was_gone, "reappearance").otherwise(c("_alone")))
    confidence = first_rule(
        (c("event") == "unknown", F.lit(0.0)),
        (c("event").isin("partial_occlusion", "full_occlusion"), F.least(c("quality"), c("overlap"))),
    ).otherwise(c("quality"))
    reason = first_rule((c("event") != "unknown", F.lit("")), (c("_blocked").isNotNull(), c("_blocked")), (c("seen"), "not_applicable_no_event")).otherwise("event_observation_unresolved")
    out = out.withColumn("confidence", confidence).withColumn("reason", reason)
    status = first_rule((c("event") != "unknown", "executed_valid"), (c("reason") == "event_provider_failed", "provider_failed"), (c("reason").isin("scene_cut_breaks_event_history", "not_applicable_no_event"), "not_applicable")).otherwise("blocked_by_input")
    return out.withColumn("status", status).drop("_sights", "_blocked", "_alone", "_same", "_gone", "_turns", "_anchor", "_is_gone")
