"""Aggregation of evidence by seven methods, and the five-level cascade.

Input rows: key columns, value, quality, applicability, valid, ord (a total order).
Accepted are the applicable, valid, finite rows whose quality reaches the floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("applicable", "observation_missing", "not_applicable", "invalid_geometry", "unsupported_mode")
METHODS = ("median", "trimmed_mean", "top_k_mean", "legacy_topk_mean", "quality_weighted_mean", "quality_weighted_top_k", "hybrid_median_top_k")


def accepted(quality_floor: float = 0.0) -> Column:
    """Whether a row counts."""
    return F.coalesce((F.col("applicability") == "applicable") & F.col("valid") & F.col("value").isNotNull() & (F.col("quality") >= quality_floor), F.lit(False))


def aggregate(rows: DataFrame, keys: list[str], method: str, top_k: int = 3, trim: float = 0.1, quality_floor: float = 0.0) -> DataFrame:
    """keys, value, quality, coverage and the counts by applicability of every group.

    One exchange by the keys: ranks come from a window over it (rows that don't count sort
    first), and every figure from one conditional aggregate.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    rows = rows.withColumn("_ok", accepted(quality_floor))
    ok, w = F.col("_ok"), F.greatest(F.col("quality"), F.lit(1e-12))
    of = lambda cond, v: F.when(ok & cond, v)
    mean = lambda cond: F.sum(of(cond, F.col("value") * w)) / F.sum(of(cond, w))
    if method == "median":
        value = F.median(of(F.lit(True), F.col("value")))
    elif method == "quality_weighted_mean":
        value = mean(F.lit(True))
    else:
        score = F.col("value") * F.col("quality") if method in ("quality_weighted_top_k", "hybrid_median_top_k") else F.col("value")
        by = Window.partitionBy(*keys)
        rows = rows.withColumn("_n", F.sum(ok.cast("long")).over(by)).withColumn("_up", F.row_number().over(by.orderBy("_ok", score.asc(), "ord")) - F.count(F.lit(1)).over(by) + F.col("_n"))
        top = F.col("_up") > F.col("_n") - F.least(F.col("_n"), F.lit(top_k))
        cut = F.floor(F.col("_n") * F.lit(trim))
        value = {
            "trimmed_mean": F.avg(of((F.col("_up") > cut) & (F.col("_up") <= F.col("_n") - cut), F.col("value"))),
            "top_k_mean": F.avg(of(top, F.col("value"))),
            "legacy_topk_mean": mean(top),
            "quality_weighted_top_k": mean(top),
            "hybrid_median_top_k": 0.5 * F.median(of(F.lit(True), F.col("value"))) + 0.5 * mean(top),
        }[method]
    is_ = lambda s: F.count_if(F.col("applicability") == s)
    out = rows.groupBy(*keys).agg(
        value.alias("value"),
        F.avg(F.when(ok, F.col("quality"))).alias("quality"),
        F.count_if(ok).alias("accepted"),
        F.count(F.lit(1)).alias("rows"),
        *[is_(s).alias(s) for s in STATES],
    )
    base = F.col("rows") - F.col("not_applicable")
    return out.select(
        *keys,
        "value",
        F.coalesce("quality", F.when(F.col("not_applicable") == F.col("rows"), 1.0).otherwise(0.0)).alias("quality"),
        F.when(base > 0, F.col("accepted") / base).otherwise(F.when(F.col("not_applicable") > 0, 1.0).otherwise(0.0)).alias("coverage"),
        "accepted",
        *STATES,
    )


def cascade(rows: DataFrame, levels: list[list[str]], method: str = "quality_weighted_mean", **options) -> DataFrame:
    """Roll up level by level; each level's result is the evidence of the next.

    ``levels`` are the key lists from fine to coarse. A group without accepted rows
    goes up as missing evidence, so it lowers coverage but not the value. Rows are dealt
    by the coarsest keys once; all finer levels keep to that.
    """
    rows = rows.repartition(*levels[-1])
    for keys in levels:
        got = aggregate(rows, keys, method, **options)
        rows = got.select(
            *keys,
            "value",
            "quality",
            F.when(F.col("value").isNotNull(), "applicable").otherwise("observation_missing").alias("applicability"),
            F.col("value").isNotNull().alias("valid"),
            F.xxhash64(*keys).alias("ord"),
            "coverage",
        )
    return rows.select(*levels[-1], "value", "quality", "coverage", "valid")


def topk_ratio_mean(rows: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Mean of the greatest ceil(n * ratio) values, one at least."""
    by = Window.partitionBy(*keys)
    ranked = rows.where("value IS NOT NULL").withColumn("_r", F.row_number().over(by.orderBy(F.desc("value"), "ord"))).withColumn("_n", F.count(F.lit(1)).over(by))
    return ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(ratio)))).groupBy(*keys).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("kept"))
