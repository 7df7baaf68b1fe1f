"""Sizes of single objects: metric extents behind gates, and sizes calibrated by independent anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import interval_distance, without_nan
from tessella.session import parts

from .gates import first_reason

#: Thresholds of metric scale, and the dimensions that an extent gives.
LIMITS = {"detection": 0.3, "depth_confidence": 0.3, "valid_ratio": 0.5, "out_of_frame": 0.1, "points": 20}
DIMENSIONS = ("height_m", "width_m", "length_m", "extent_m")
METERS = ("m", "meter", "meters")


def region_extents(pixels: DataFrame, cameras: DataFrame, key: list[str], cloud: bool, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """x_extent, y_extent, z_extent, depth, depth_confidence, points, valid_ratio, uncertainty and failure of every region.

    Pixels: key, row, col, z (a distance along the ray where ``ray``; NULL or not positive: invalid), confidence (NULL: none). Cameras: key, fx, fy, cx, cy,
    ray, depth_quality. Without ``cloud`` the region's box is scaled by its median depth; with it every pixel is back-projected and the extents
    lie between quantiles. Quantiles are exact.
    """
    c = F.col
    rows = without_nan(pixels, infinite=True).join(cameras, key)
    side = F.sqrt(1 + ((c("col") - c("cx")) / c("fx")) ** 2 + ((c("row") - c("cy")) / c("fy")) ** 2)
    z = F.when(c("z") > 0, F.when(c("ray"), c("z") / side).otherwise(c("z")))
    rows = rows.withColumn("_z", z).withColumn("_x", (c("col") - c("cx")) * c("_z") / c("fx")).withColumn("_y", (c("row") - c("cy")) * c("_z") / c("fy"))
    good = c("_z").isNotNull()
    q = lambda x, p: F.percentile(x, F.lit(p))
    span = lambda x: F.max(F.when(good, c(x))) - F.min(F.when(good, c(x))) + 1
    agg = [
        F.count(F.lit(1)).alias("_all"), F.count("_z").alias("points"), F.median("_z").alias("depth"), F.median(F.when(good, c("confidence"))).alias("_conf"), F.first("depth_quality").alias("_q"), F.first("fx").alias("_fx"), F.first("fy").alias("_fy"),
        span("row").alias("_h"), span("col").alias("_w"), *[q(f"_{x}", p).alias(f"_{x}{n}") for x in "xyz" for n, p in (("l", low), ("h", high))], *[F.median(f"_{x}").alias(f"_m{x}") for x in "xyz"],
    ]
    out = rows.groupBy(*key).agg(*agg)
    width = {x: c(f"_{x}h") - c(f"_{x}l") for x in "xyz"}
    if cloud:
        middle = out.select(*key, *[f"_m{x}" for x in "xyz"])
        apart = rows.join(middle, key).groupBy(*key).agg(*[F.median(F.abs(c(f"_{x}") - c(f"_m{x}"))).alias(f"_d{x}") for x in "xyz"])
        out = out.join(apart, key)
        norm = lambda v: F.sqrt(v["x"] ** 2 + v["y"] ** 2 + v["z"] ** 2)
        extents, uncertainty = width, norm({x: c(f"_d{x}") for x in "xyz"}) / F.greatest(norm(width), F.lit(1e-12))
    else:
        extents = {"x": c("_w") * c("depth") / c("_fx"), "y": c("_h") * c("depth") / c("_fy"), "z": width["z"]}
        uncertainty = F.greatest(F.lit(0.0), width["z"]) / F.greatest(c("depth"), F.lit(1e-12))
    seen = c("points") > 0
    return out.select(
        *key, *[F.when(seen, extents[x]).alias(f"{x}_extent") for x in "xyz"], "depth", F.when(seen, F.coalesce("_conf", "_q")).otherwise(F.lit(0.0)).alias("depth_confidence"), "points", (c("points") / F.greatest("_all", F.lit(1))).alias("valid_ratio"),
        F.when(seen, uncertainty).alias("uncertainty"), F.when(seen, "").otherwise("no_valid_metric_depth_in_object").alias("failure"),
    )


def metric_scale(objects: DataFrame, extents: DataFrame, priors: DataFrame, key: list[str], cloud: bool, approximate: bool = False, limits: dict[str, float] = LIMITS) -> DataFrame:
    """residual, confidence, uncertainty, dimensions (those judged, in order), provider_status, reason of every object.

    Objects: key, class_name, object_status, depth_status, depth_type, depth_unit, scale_status, depth_definition, has_depth, camera_valid, intrinsics_source,
    detection, severe_truncation, out_of_frame, has_region, depth_quality, camera_quality, height_ok, width_ok, length_ok. Priors: class_name, dimension,
    intervals (array of low, high), confidence. The residual is the greatest log distance of a dimension that can be observed to its union of
    intervals. The first gate that blocks names the reason; an extent in any direction needs any observable dimension.
    """
    c = F.col
    o = without_nan(objects)
    held = priors.where(c("dimension").isin(*DIMENSIONS)).groupBy("class_name").agg(F.array_sort(F.collect_list(F.struct("dimension", "intervals", "confidence"))).alias("_priors"))  # four at most
    rows = o.join(extents, key, "left").join(held, "class_name", "left")
    failed = (c("object_status") == "provider_failed") | (c("depth_status") == "provider_failed")
    source = F.lower(F.trim("intrinsics_source"))
    rules = [
        ("object_provider_failed", c("object_status") == "provider_failed"),
        ("metric_depth_provider_failed", c("depth_status") == "provider_failed"),
        ("provider_not_ready", (c("object_status") != "ok") | (c("depth_status") != "ok")),
        ("metric_scale_unavailable", ~c("depth_type").isin("metric", "sensor_metric")),
        ("metric_depth_unit_not_meter", ~c("depth_unit").isin(*METERS)),
        ("metric_scale_status_unavailable", c("scale_status").isin("unavailable", "invalid")),
        ("unknown_depth_definition", c("depth_definition") == "unknown"),
        ("missing_metric_depth_map", ~c("has_depth")),
        ("missing_camera_intrinsics", ~c("camera_valid")),
        ("approximated_intrinsics_not_allowed", ~F.lit(approximate) & (source.contains("approx") | source.contains("assumed"))),
        ("low_object_detection_confidence", c("detection") < limits["detection"]),
        ("severe_object_truncation", c("severe_truncation")),
        ("object_largely_out_of_frame", c("out_of_frame") > limits["out_of_frame"]),
        ("invalid_object_region", ~c("has_region")),
        ("missing_physical_scale_prior", c("_priors").isNull()),
        ("no_valid_metric_depth_in_object", c("failure").isNull() | (c("failure") != "")),
        ("insufficient_valid_metric_depth_ratio", c("valid_ratio") < limits["valid_ratio"]),
        ("low_metric_depth_confidence", c("depth_confidence") < limits["depth_confidence"]),
        ("insufficient_pointcloud_support", F.lit(cloud) & (c("points") < limits["points"])),
    ]
    rows = rows.withColumn("_gate", first_reason(rules))
    size = {"height_m": c("y_extent"), "width_m": c("x_extent"), "length_m": c("z_extent"), "extent_m": F.greatest("x_extent", "y_extent", "z_extent")}
    seen = {"height_m": c("height_ok"), "width_m": c("width_ok"), "length_m": c("length_ok"), "extent_m": c("height_ok") | c("width_ok") | c("length_ok")}

    def pick(of: dict[str, Column], name: Column) -> Column:
        out = F.lit(None)
        for d, v in of.items():
            out = F.when(name == d, v).otherwise(out)
        return out

    def judged(p: Column) -> Column:
        value = pick(size, p["dimension"])
        distance = F.array_min(F.transform(p["intervals"], lambda i: interval_distance(F.ln(value), F.ln(i["low"]), F.ln(i["high"]))))
        return F.when(F.coalesce(pick(seen, p["dimension"]) & (value > 0), F.lit(False)), F.struct(distance.alias("d"), p["dimension"].alias("dimension"), p["confidence"].alias("confidence")))

    rows = rows.withColumn("_judged", F.filter(F.transform("_priors", judged), lambda x: x.isNotNull()))
    reason = F.when(c("_gate") != "", c("_gate")).when(F.size("_judged") < 1, "no_observable_dimension_with_physical_prior").otherwise("")
    rows = rows.withColumn("reason", reason)
    ok = c("reason") == ""
    quality = F.least("detection", "depth_quality", "camera_quality", "depth_confidence", F.array_min(F.transform("_judged", lambda x: x["confidence"])))
    return rows.select(
        *key, F.when(ok, F.array_max(F.transform("_judged", lambda x: x["d"]))).alias("residual"), F.when(ok, quality).otherwise(F.lit(0.0)).alias("confidence"), F.when(ok, c("uncertainty")).alias("uncertainty"),
        F.when(ok, F.array_join(F.transform("_judged", lambda x: x["dimension"]), ",")).otherwise("").alias("dimensions"), F.when(failed, "provider_failed").when(c("_gate").isin(*[r for r, _ in rules[:14]]), "blocked").otherwise("ok").alias("provider_status"), "reason",
    )


def anchored_size(objects: DataFrame, targets: DataFrame, anchors: DataFrame, frame: list[str]) -> DataFrame:
    """residual, quality, scene_scale, anchors (how many were used), reason: a relative size, made metric by other objects of its frame.

    Objects: frame, object_id, valid, scale, scale_status, low, high (NULL: no prior), quality. Targets: frame, object_id, independent (whether its anchors are
    known to be). Anchors: frame, object_id, anchor_id; repeated ones count once. The scene's scale is the median of the anchors' expected middle sizes over their
    observed ones; anchors that are absent, invalid, not relative or without prior are passed over. A target never calibrates itself.
    Partitions are as many as the objects' number asks for.
    """
    c = F.col
    n = parts(objects.sparkSession, objects.count(), 50_000)
    o = without_nan(objects, infinite=True).repartition(n, *frame, "object_id")
    pairs = anchors.select(*frame, "object_id", "anchor_id").repartition(n, *frame, "anchor_id").distinct()
    other = o.select(*frame, c("object_id").alias("anchor_id"), *[c(x).alias(f"a_{x}") for x in ("valid", "scale", "scale_status", "low", "high", "quality")])
    joined = pairs.join(other, [*frame, "anchor_id"], "left").repartition(n, *frame, "object_id")
    usable = F.coalesce(c("a_valid") & (c("a_scale") > 0) & (c("a_scale_status") == "relative_3d") & c("a_low").isNotNull() & c("a_high").isNotNull(), F.lit(False))
    factor = F.when(usable, 0.5 * (c("a_low") + c("a_high")) / c("a_scale"))
    of = joined.groupBy(*frame, "object_id").agg(F.count(F.lit(1)).alias("_given"), F.max((c("anchor_id") == c("object_id")).cast("int")).alias("_self"), F.median(factor).alias("scene_scale"), F.count(factor).alias("anchors"), F.avg(F.when(usable, c("a_quality"))).alias("_q"))
    rows = targets.repartition(n, *frame, "object_id").join(o, [*frame, "object_id"], "left").join(of, [*frame, "object_id"], "left").na.fill(0, ["_given", "anchors"])
    rules = [
        ("invalid_object_scale", ~F.coalesce(c("valid") & c("scale").isNotNull(), F.lit(False))),
        ("no_independent_scale_anchor", c("_given") == 0),
        ("anchor_self_evaluation_forbidden", c("_self") == 1),
        ("anchor_independence_not_established", ~F.coalesce("independent", F.lit(False))),
        ("relative_calibration_requires_relative_3d", ~c("scale_status").eqNullSafe(F.lit("relative_3d"))),
        ("missing_or_unreliable_physical_prior", c("low").isNull() | c("high").isNull()),
        ("no_valid_independent_scale_anchor", c("anchors") == 0),
    ]
    rows = rows.withColumn("reason", first_reason(rules))
    ok = c("reason") == ""
    size = c("scale") * c("scene_scale")
    return rows.select(
        *frame, "object_id", F.when(ok, interval_distance(size, c("low"), c("high"))).alias("residual"), F.when(ok, F.least("quality", "_q")).otherwise(F.lit(0.0)).alias("quality"), F.when(ok, c("scene_scale")).alias("scene_scale"), F.when(ok, c("anchors")).otherwise(F.lit(0)).alias("anchors"), "reason"
    )
