"""Evidence of single frames: depth order, relative size, reconstruction quality, applicability, ranking, matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import interval_distance

from .gates import failed_checks, first_reason


def centre_order(pairs: DataFrame) -> DataFrame:
    """Signed depth difference of two objects: a diagnostic, never evidence. Columns za, zb (NULL invalid)."""
    d = F.col("zb") - F.col("za")
    return pairs.withColumn("difference", d).withColumn("relation", F.when(d > 0, "a_in_front").when(d < 0, "b_in_front").when(d == 0, "same_depth").otherwise("invalid_object_center_depth"))


def occlusion_order(pairs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """How far the seen occluder lies behind the occluded, relative to the farther, beyond a tolerance.

    Columns front_z, back_z, overlap (NULL: no relation seen), quality.
    """
    margin = (F.col("back_z") - F.col("front_z")) / F.greatest(F.abs("front_z"), F.abs("back_z"), F.lit(1e-12))
    reason = first_reason([("no_occlusion_relation_evidence", F.col("overlap").isNull() | (F.col("overlap") <= 0)), ("invalid_object_center_depth", F.col("front_z").isNull() | F.col("back_z").isNull())])
    out = pairs.withColumn("reason", reason)
    ok = F.col("reason") == ""
    return out.withColumn("residual", F.when(ok, F.greatest(F.lit(0.0), -margin - tolerance))).withColumn("residual_quality", F.when(ok, F.least("quality", F.least(F.lit(1.0), F.col("overlap")))).otherwise(F.lit(0.0)))


def contact_order(pixels: DataFrame, keys: list[str], least: int = 12, uncertainty: float = 0.03) -> DataFrame:
    """Which of two objects is in front, by the median depth on their sides of the contact, or of
    their whole masks where the contact has too few pixels.

    Pixels: keys, side ('a' or 'b'), depth (NULL or <= 0 invalid), contact.
    """
    ok = F.col("depth") > 0
    side = lambda s: ok & (F.col("side") == s)
    near = lambda s: side(s) & F.col("contact")
    m = pixels.groupBy(*keys).agg(
        *[F.count_if(near(s)).alias(f"near_{s}") for s in "ab"],
        *[F.count_if(side(s)).alias(f"all_{s}") for s in "ab"],
        *[F.median(F.when(near(s), F.col("depth"))).alias(f"dn_{s}") for s in "ab"],
        *[F.median(F.when(side(s), F.col("depth"))).alias(f"da_{s}") for s in "ab"],
    )
    by_contact = (F.col("near_a") >= least) & (F.col("near_b") >= least)
    by_mask = (F.col("all_a") >= least) & (F.col("all_b") >= least)
    a, b = (F.when(by_contact, F.col(f"dn_{s}")).when(by_mask, F.col(f"da_{s}")) for s in "ab")
    m = m.withColumn("depth_a", a).withColumn("depth_b", b)
    margin = F.abs(F.col("depth_a") - F.col("depth_b"))
    unsure = margin <= uncertainty * F.greatest((F.col("depth_a") + F.col("depth_b")) / 2, F.lit(1e-8))
    front = F.when(F.col("depth_a").isNull(), "").when(unsure, "").when(F.col("depth_a") < F.col("depth_b"), "a").otherwise("b")
    full = F.when(by_contact, 1.0).otherwise(0.5)
    quality = F.when(F.col("depth_a").isNull(), 0.0).when(unsure, full / 2).otherwise(full)
    return m.select(*keys, "depth_a", "depth_b", front.alias("front"), quality.alias("quality"))


def relative_size(objects: DataFrame, group: str) -> DataFrame:
    """Log distance of the size ratio of every unordered pair of a frame to the ratio interval of their priors. Objects: group, object_id, size, low, high."""
    a, b = (objects.select(group, *[F.col(c).alias(f"{c}_{s}") for c in ("object_id", "size", "low", "high")]) for s in "ab")
    pairs = a.join(b, group).where("object_id_a < object_id_b AND size_a > 0 AND size_b > 0")
    d = interval_distance(F.ln(F.col("size_a") / F.col("size_b")), F.ln(F.col("low_a") / F.col("high_b")), F.ln(F.col("high_a") / F.col("low_b")))
    return pairs.select(group, F.col("object_id_a").alias("a"), F.col("object_id_b").alias("b"), d.alias("residual"))


def reconstruction_quality(rows: DataFrame, parts: list[str], least: float = 0.5) -> DataFrame:
    """Mean of the available parts, clipped to [0, 1]; 0 without any."""
    held = F.filter(F.array(*[F.col(p).cast("double") for p in parts]), lambda x: x.isNotNull())
    mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held)).otherwise(F.lit(0.0))
    return rows.withColumn("quality", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))).withColumn("passes", F.col("quality") >= least)


def upright_gate(rows: DataFrame, side: float = 16.0, aspect: tuple[float, float] = (0.45, 1.6), confidence: float = 0.3, margin: float = 0.005, variation: float = 0.2, depth_spread: float = 0.2, depth_ratio: float = 0.5) -> DataFrame:
    """Whether a box can stand for an object's upright height, and if not why.

    Columns x1, y1, x2, y2, width, height, confidence, variation (NULL unknown), depth_iqr, depth, depth_ratio.
    """
    c = F.col
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    touch = (c("x1") <= margin * c("width")) | (c("y1") <= margin * c("height")) | (c("x2") >= (1 - margin) * c("width")) | (c("y2") >= (1 - margin) * c("height"))
    steady = F.coalesce((c("depth_iqr") / F.when(c("depth") > 0, c("depth")) <= depth_spread) & (c("depth_ratio") >= depth_ratio), F.lit(False))
    rules = [
        ("pose_unresolved", (w <= 0) | (h <= 0)),
        ("too_small", (w < side) | (h < side)),
        ("boundary_truncated", touch),
        ("unstable_projection", c("variation") > variation),
        ("unstable_depth", ~steady),
        ("pose_unresolved", (c("confidence") < confidence) | ~(w / F.when(h > 0, h)).between(*aspect)),
    ]
    return rows.withColumn("applicability", first_reason(rules, "applicable"))


def diagnostic_labels(rows: DataFrame, rules: dict) -> DataFrame:
    """All diagnostic labels whose rule holds, or the one that says none does."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("labels", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("no_obvious_issue"))))


def view_observability(rows: DataFrame, confidence: float = 0.5, visible: float = 0.6, occlusion: float = 0.4) -> DataFrame:
    """Columns view_confidence, visible_ratio, occlusion, border -> failed checks and whether the view serves."""
    c = F.col
    checks = [("view_confidence", c("view_confidence") >= confidence), ("visible_ratio", c("visible_ratio") >= visible), ("occlusion", c("occlusion") <= occlusion), ("border", ~c("border"))]
    return rows.withColumn("failed", failed_checks(checks)).withColumn("observable", F.size("failed") == 0)


def rank_evidence(scores: DataFrame, by: list[str]) -> DataFrame:
    """Finite scores with their place: greatest first, then by the identity columns. Ranks are inside ``by``."""
    order = [F.desc("score"), "identity_type", "identity_id"]
    return scores.where("score IS NOT NULL AND NOT isnan(score)").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def greedy_match(pairs: DataFrame, key: str, least: float = 0.35) -> DataFrame:
    """One-to-one matches of a frame, best score first. Pairs: key, object_id, candidate_id, score.

    A frame's pairs are collected once and folded in order by a higher-order function, on the JVM.
    """
    kinds = dict(pairs.dtypes)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    row = F.struct((-F.col("score")).alias("order"), "object_id", "candidate_id", "score")
    ranked = pairs.where(F.col("score") >= least).groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    start = F.struct(none(kinds["object_id"]).alias("objects"), none(kinds["candidate_id"]).alias("candidates"), none(f"struct<object_id:{kinds['object_id']},candidate_id:{kinds['candidate_id']},score:{kinds['score']}>").alias("out"))

    def fold(acc, x):
        taken = F.array_contains(acc["objects"], x["object_id"]) | F.array_contains(acc["candidates"], x["candidate_id"])
        add = lambda name, value: F.when(taken, acc[name]).otherwise(F.concat(acc[name], F.array(value))).alias(name)
        match = F.struct(x["object_id"].alias("object_id"), x["candidate_id"].alias("candidate_id"), x["score"].alias("score"))
        return F.struct(add("objects", x["object_id"]), add("candidates", x["candidate_id"]), add("out", match))

    return ranked.select(key, F.explode(F.aggregate("_all", start, fold, lambda acc: acc["out"])).alias("m")).select(key, "m.*")


def align_with_holdout(pairs: DataFrame, least: int = 8, hold: int = 5, most: float = 0.25) -> DataFrame:
    """The simplest of shift, scale and line that fits a frame pair almost best on held-out points.

    Pairs: pair_id, ord, source, target. Every ``hold``-th point by ord is held out; errors are medians
    over the target's spread; a simpler model wins within 5 %.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        x, y = pdf["source"].to_numpy(float), pdf["target"].to_numpy(float)
        out = np.arange(len(x)) % hold == hold - 1
        row = {"pair_id": pdf["pair_id"].iloc[0], "model": "none", "scale": None, "shift": None, "error": None}
        if (~out).sum() >= least and out.sum() >= 2:
            fx, fy = x[~out], y[~out]
            spread = max(float(np.percentile(y, 75) - np.percentile(y, 25)), 1e-12)
            models = [("shift", 1.0, float(np.median(fy - fx)))]
            if (fx > 0).all() and (fy > 0).all():
                models.append(("scale", float(np.exp(np.median(np.log(fy / fx)))), 0.0))
            if np.ptp(fx) > 0:
                a, b = np.polyfit(fx, fy, 1)
                if a > 0:
                    models.append(("line", float(a), float(b)))
            errors = [float(np.median(np.abs(y[out] - a * x[out] - b))) / spread for _, a, b in models]
            best = min(errors)
            i = next(i for i, e in enumerate(errors) if e <= 1.05 * best + 1e-12)
            if errors[i] <= most:
                row = {"pair_id": row["pair_id"], "model": models[i][0], "scale": models[i][1], "shift": models[i][2], "error": errors[i]}
        return pd.DataFrame([row]).astype({"scale": float, "shift": float, "error": float})

    kind = dict(pairs.dtypes)["pair_id"]
    return pairs.groupBy("pair_id").applyInPandas(run, f"pair_id {kind}, model string, scale double, shift double, error double")


def apply_missing_policy(audit: DataFrame, policy: str = "exclude") -> DataFrame:
    """Samples without a valid residual: ``error`` raises if there is one, ``exclude`` drops them, ``keep_empty`` keeps them."""
    if policy not in ("error", "exclude", "keep_empty"):
        raise ValueError(policy)
    bad = F.col("status") == "no_valid_residual"
    if policy == "error" and not audit.where(bad).isEmpty():
        raise ValueError("a sample has no valid residual")
    return audit if policy == "keep_empty" else audit.where(~bad)
