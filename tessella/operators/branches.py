"""Branch fusion: aggregate every evidence branch, bound it, and mix the branches.

Rows: keys, branch, value, quality, uncertainty, applicable, valid, provider_ok, reason, ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import bounded

BRANCHES = [  # fixed values
    "semantic_metric",
    "semantic_temporal",
    "static_depth",
    "static_boundary",
    "dynamic_point",
    "dynamic_structure",
    "reprojection",
    "relation",
    "occlusion",
]


def branch_scores(rows: DataFrame, keys: list[str], top_k: int = 3) -> DataFrame:
    """Of every branch: half median, half quality-weighted top-k of its usable rows, their mean
    effective confidence and number, and whether any row applies."""
    good = F.col("_good")
    rows = rows.withColumn("_good", F.coalesce(F.col("valid") & F.col("applicable") & F.col("provider_ok"), F.lit(False)))
    by = Window.partitionBy(*keys, "branch")
    rows = rows.withColumn("_n", F.sum(good.cast("long")).over(by))
    rows = rows.withColumn("_up", F.row_number().over(by.orderBy("_good", (F.col("value") * F.col("quality")).asc(), "ord")) - F.count(F.lit(1)).over(by) + F.col("_n"))
    w = F.greatest(F.col("quality"), F.lit(1e-12))
    top = good & (F.col("_up") > F.col("_n") - F.least(F.col("_n"), F.lit(top_k)))
    head = F.sum(F.when(top, F.col("value") * w)) / F.sum(F.when(top, w))
    return rows.groupBy(*keys, "branch").agg(
        (0.5 * F.median(F.when(good, F.col("value"))) + 0.5 * head).alias("residual"),
        F.avg(F.when(good, F.col("quality") / (1 + F.col("uncertainty")))).alias("confidence"),
        F.count_if(good).alias("usable"),
        F.max("applicable").alias("applies"),
    )


def fuse(rows: DataFrame, keys: list[str], weights: dict[str, float] | None = None, top_k: int = 3) -> DataFrame:
    """risk, confidence, branches and available share of every group, by one exchange."""
    return _combine(branch_scores(rows.repartition(*keys), keys, top_k), keys, weights)


def _combine(scores: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Fuse rows of :func:`branch_scores`."""
    weight = F.lit(1.0)
    for branch, w in (weights or {}).items():
        weight = F.when(F.col("branch") == branch, F.lit(float(w))).otherwise(weight)
    scored = scores.withColumn("w", weight).withColumn("b", bounded("residual"))
    live = F.col("usable") > 0
    out = scored.groupBy(*keys).agg(
        F.sum(F.when(F.col("applies"), F.col("w")).otherwise(0.0)).alias("wanted"),
        F.coalesce(F.sum(F.when(live, F.col("w"))), F.lit(0.0)).alias("have"),
        F.sum(F.when(live, F.col("w") * F.col("confidence"))).alias("wc"),
        F.sum(F.when(live, F.col("w") * F.col("confidence") * F.col("b"))).alias("wcb"),
        F.max(F.when(live, F.col("b") * F.col("confidence"))).alias("most"),
        F.count_if(live).alias("n"),
    )
    share = F.when(F.col("wanted") > 0, F.col("have") / F.col("wanted")).otherwise(F.lit(0.0))
    active = F.coalesce(F.col("wc") > 0, F.lit(False))
    return out.select(
        *keys,
        F.when(active, 0.5 * F.col("wcb") / F.col("wc") + 0.5 * F.col("most")).alias("risk"),
        F.when(active, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("wc") / F.col("have") * share))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(active, F.col("n")).otherwise(F.lit(0)).cast("long").alias("active_branches"),
        share.alias("available_share"),
    )


def dropout(rows: DataFrame, keys: list[str], branches: list[str] = BRANCHES, weights: dict[str, float] | None = None, top_k: int = 3) -> DataFrame:
    """:func:`fuse` once for every branch left out. What a branch says doesn't depend on the others, so the evidence is
    scored once, and only the handful of branch rows of each group is repeated."""
    scores = branch_scores(rows.repartition(*keys), keys, top_k)
    dropped = F.explode(F.filter(F.array(*[F.lit(b) for b in branches]), lambda b: b != F.col("branch"))).alias("dropped")
    return _combine(scores.select("*", dropped), [*keys, "dropped"], weights)


def frame_fusion(rows: DataFrame, **options) -> DataFrame:
    """Fusion of every frame; rows without a frame are left out."""
    return fuse(rows.where("frame_index IS NOT NULL"), ["video_id", "clip_id", "frame_index"], **options)


def missingness_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How much is missing, and nothing about values."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("valid")).alias("missing"),
        (F.count_if(~F.col("valid")) / F.count(F.lit(1))).alias("missing_ratio"),
        F.count_if(~F.col("provider_ok")).alias("provider_failures"),
        F.count_distinct("branch").alias("branches"),
    )


def availability(rows: DataFrame) -> DataFrame:
    """Counts and ratios of every branch over all evidence."""
    return rows.groupBy("branch").agg(F.count(F.lit(1)).alias("rows"), F.count_if("applicable").alias("applicable"), F.count_if("valid").alias("valid"), (F.count_if("valid") / F.count(F.lit(1))).alias("valid_ratio"))


def reason_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of every reason among the invalid ones."""
    return rows.where("NOT valid").groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("rows"))


def coverage_by_group(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group, "branch").agg(F.count(F.lit(1)).alias("rows"), (F.count_if("valid") / F.count(F.lit(1))).alias("coverage"))


def provider_failure_balance(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("provider_ok")).alias("failures"), (F.count_if(~F.col("provider_ok")) / F.count(F.lit(1))).alias("failure_ratio"))


def missingness_bias(samples: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """Features whose mean differs between labels inside a split by the threshold or more."""
    long = samples.select("split", "label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("split", "label", "x.*")
    means = long.groupBy("split", "feature").agg(F.avg(F.when(F.col("label") == 0, F.col("v"))).alias("mean0"), F.avg(F.when(F.col("label") == 1, F.col("v"))).alias("mean1"))
    return means.withColumn("difference", F.abs(F.col("mean1") - F.col("mean0"))).withColumn("flagged", F.coalesce(F.col("difference") >= threshold, F.lit(False)))
