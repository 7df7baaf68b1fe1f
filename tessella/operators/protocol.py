"""The experiment protocol: leakage findings with severity, and which tasks a video may serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of findings, tasks and the branches and providers that they rest on.
FINDINGS = ("source_group_cross_split", "exact_duplicate_cross_split", "near_duplicate_cross_split", "official_split_source_group_conflict", "test_used_for_normalization_fit", "test_used_for_threshold_tuning")
UNLABELLED = {
    "video_classification": "geometry_validation_smoke_not_formal_classification_data",
    "temporal_localization": "temporal_annotations_unavailable",
    "spatial_localization": "spatial_annotations_unavailable",
    "object_localization": "object_localization_annotations_unavailable",
}
REPROJECTION = {"reprojection_D1": "dynamic_static_camera", "reprojection_D2": "dynamic_rotation_compensated", "reprojection_D3": "dynamic_full_se3"}
STATIC, OCCLUSION = "frame_static_3d", "occlusion"


def leakage_findings(inventory: DataFrame, assignments: DataFrame, duplicates: DataFrame, near: float = 0.92, fit_splits: tuple[str, ...] = ("train",), tuning_splits: tuple[str, ...] = ("validation",)) -> DataFrame:
    """conflict_type, severity, video_id_a, video_id_b, source_group_id, split_a, split_b, details, review_required.

    Inventory: video_id, source_group_id. Assignments: video_id, source_group_id, split. Duplicates: video_id_a, video_id_b, exact_duplicate,
    near_duplicate_score, split_conflict. A group in several splits is one finding with its smallest video and all its splits; a pair of
    duplicates across splits one each (exact ones first); an official conflict stays one for each video; a test split that fits statistics or tunes
    thresholds is one. Nothing is repaired. Missing texts are empty.
    """
    c, none = F.col, F.lit("")
    splits = assignments.select("video_id", "split").dropDuplicates(["video_id"])

    def rows(df: DataFrame, kind: Column, a: Column, b: Column, group: Column, split_a: Column, split_b: Column, details: Column) -> DataFrame:
        text = lambda x, name: F.coalesce(x.cast("string"), none).alias(name)
        return df.select(kind.alias("conflict_type"), F.lit("error").alias("severity"), text(a, "video_id_a"), text(b, "video_id_b"), text(group, "source_group_id"), text(split_a, "split_a"), text(split_b, "split_b"), details.alias("details"), F.lit(True).alias("review_required"))

    groups = inventory.select("video_id", "source_group_id").join(splits, "video_id", "left").groupBy("source_group_id").agg(F.min("video_id").alias("a"), F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    out = rows(groups, F.lit(FINDINGS[0]), c("a"), none, c("source_group_id"), F.concat_ws(";", "s"), none, F.lit("one source group spans multiple splits"))
    kind = F.when(c("exact_duplicate"), FINDINGS[1]).when(c("near_duplicate_score") >= near, FINDINGS[2])
    pairs = duplicates.where("split_conflict").withColumn("kind", kind).where("kind IS NOT NULL")
    for side in "ab":
        pairs = pairs.join(splits.select(c("video_id").alias(f"video_id_{side}"), c("split").alias(f"split_{side}")), f"video_id_{side}", "left")
    score = F.format_string("near_duplicate_score=%.6f", c("near_duplicate_score").cast("double"))
    out = out.unionByName(rows(pairs, c("kind"), c("video_id_a"), c("video_id_b"), none, c("split_a"), c("split_b"), score))
    official = assignments.where("split = 'official_conflict'")
    out = out.unionByName(rows(official, F.lit(FINDINGS[3]), c("video_id"), none, c("source_group_id"), c("split"), none, F.lit("official split conflict was preserved for review")))
    one = inventory.sparkSession.range(1)
    for used, kind, details in (("test" in fit_splits, FINDINGS[4], "test cannot fit normalization statistics"), ("test" in tuning_splits, FINDINGS[5], "test cannot tune thresholds")):
        if used:
            out = out.unionByName(rows(one, F.lit(kind), none, none, none, F.lit("test"), none, F.lit(details)))
    return out


def leakage_summary(findings: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: conflicts and errors, findings of each kind, and videos whose group awaits review. Inventory: review_required."""
    kinds = [F.count_if(F.col("conflict_type") == k).alias(k) for k in FINDINGS]
    counts = findings.agg(F.count(F.lit(1)).alias("conflict_count"), F.count_if(F.col("severity") == "error").alias("error_count"), *kinds)
    review = inventory.agg(F.count_if("review_required").alias("source_group_review_required_count"))
    return counts.withColumn("_one", F.lit(1)).join(review.withColumn("_one", F.lit(1)), "_one").drop("_one")  # a row each


def task_matrix(videos: DataFrame, clips: DataFrame, branches: DataFrame) -> DataFrame:
    """video_id, task_name, status, reason, provider_name, available, expected: nine rows a video.

    Videos: video_id, frame_count. Clips: video_id, valid_depth_count, num_frames. Branches: video_id, ord, branch_name, eligibility_status,
    exclusion_reason, ready (valid frames, ready clips or formal events); the first row by ord of a branch counts. What lacks
    annotations is ineligible, what lacks its branch is a failed provider, an occlusion without events not applicable.
    """
    c = F.col
    depth = clips.groupBy("video_id").agg(F.count(F.lit(1)).alias("_clips"), F.sum(F.coalesce("valid_depth_count", F.lit(0))).alias("_depth"), F.sum(F.coalesce("num_frames", F.lit(0))).alias("_frames"))
    names = [STATIC, *REPROJECTION.values(), OCCLUSION]
    first = lambda b: F.min_by(F.struct("eligibility_status", "exclusion_reason", "ready"), F.when(c("branch_name") == b, c("ord"))).alias(f"_{b}")
    states = branches.where(c("branch_name").isin(names)).groupBy("video_id").agg(*[first(b) for b in names])
    rows = videos.join(depth, "video_id", "left").na.fill(0, ["_clips", "_depth", "_frames"]).join(states, "video_id", "left")

    def record(task: str, status, reason, provider: str, available, expected) -> Column:
        col = lambda x: F.lit(x) if isinstance(x, str) else x
        count = lambda x, name: F.greatest(F.lit(0).cast("long"), F.coalesce(x, F.lit(0)).cast("long")).alias(name)
        return F.struct(F.lit(task).alias("task_name"), col(status).alias("status"), col(reason).alias("reason"), F.lit(provider).alias("provider_name"), count(available, "available"), count(expected, "expected"))

    def of_branch(task: str, branch: str, missing: str, provider: str, expected: Column) -> Column:
        b = c(f"_{branch}")
        ok = F.coalesce(b["eligibility_status"] == "applicable", F.lit(False))
        return record(task, F.when(ok, "eligible").otherwise("provider_failed"), F.when(ok, "").otherwise(F.coalesce(b["exclusion_reason"], F.lit(missing))), provider, F.when(ok, b["ready"]), expected)

    zero = F.lit(0)
    tasks = [record(task, "ineligible", reason, "", zero, c("_clips")) for task, reason in UNLABELLED.items()]
    tasks.append(of_branch("static_geometry", STATIC, "static_geometry_metadata_missing", "shared_3d_frame_observation", c("frame_count")))
    tasks.append(record("depth_residual", F.when(c("_depth") > 0, "eligible").otherwise("provider_failed"), F.when(c("_depth") > 0, "").otherwise("depth_observation_unavailable"), "depth_observation", c("_depth"), c("_frames")))
    tasks += [of_branch(task, branch, "reprojection_metadata_missing", "camera_pose_and_track_geometry", c("_clips")) for task, branch in REPROJECTION.items()]
    o = c(f"_{OCCLUSION}")
    seen = o["eligibility_status"]
    status = F.when(o.isNull(), "unknown").when(seen == "applicable", "eligible").when(seen == "not_applicable", "not_applicable").otherwise("provider_failed")
    reason = F.when(o.isNull(), "occlusion_metadata_missing").when(seen == "applicable", "").when(seen == "not_applicable", F.coalesce(o["exclusion_reason"], F.lit("no_observed_event"))).otherwise(F.coalesce(o["exclusion_reason"], F.lit("occlusion_provider_failed")))
    tasks.append(record("occlusion_and_reappearance", status, reason, "formal_mask_depth_order_visibility", o["ready"], c("_clips")))
    return rows.select("video_id", F.explode(F.array(*tasks)).alias("t")).select("video_id", "t.*")
