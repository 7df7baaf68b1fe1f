"""The evidence contract: missing is not zero.

An observed row has raw = max(0, v), normalized = 1 - exp(-raw) and no reason. An
unavailable row has neither value, confidence 0 and a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.stats import bounded, finite

EVIDENCE = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("clip_id", T.StringType()),
        T.StructField("row_idx", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("frame_index", T.IntegerType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("track_id", T.StringType()),
        T.StructField("raw_value", T.DoubleType()),
        T.StructField("normalized_value", T.DoubleType()),
        T.StructField("availability", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)


def observe(df: DataFrame, value: str = "value", confidence: str = "confidence", ok: str = "ok", reason: str = "reason") -> DataFrame:
    """Fill the value, availability, confidence, valid and reason columns from a measured value and a gate."""
    v = finite(value)
    good = F.col(ok) & v.isNotNull()
    raw = F.when(good, F.greatest(v, F.lit(0.0)))
    return (
        df.withColumn("raw_value", raw)
        .withColumn("normalized_value", bounded("raw_value"))
        .withColumn("availability", F.when(good, "observed").otherwise("blocked_by_input"))
        .withColumn("_c", F.when(good, F.col(confidence)).otherwise(0.0))
        .withColumn("_r", F.when(good, "").otherwise(F.coalesce(F.when(F.col(reason) != "", F.col(reason)), F.lit("value_not_finite"))))
        .withColumn("valid", good)
        .withColumn("confidence", F.col("_c"))
        .withColumn("reason", F.col("_r"))
        .drop("_c", "_r")
    )


def violations(df: DataFrame) -> DataFrame:
    """Rows that break the contract, with what they break."""
    rules = {
        "observed_without_value": F.col("valid") & (F.col("raw_value").isNull() | F.col("normalized_value").isNull()),
        "negative_value": F.col("raw_value") < 0,
        "unavailable_with_value": ~F.col("valid") & (F.col("raw_value").isNotNull() | F.col("normalized_value").isNotNull()),
        "unavailable_with_confidence": ~F.col("valid") & (F.col("confidence") != 0),
        "unavailable_without_reason": ~F.col("valid") & (F.coalesce(F.col("reason"), F.lit("")) == ""),
        "observed_with_reason": F.col("valid") & (F.col("reason") != ""),
        "confidence_out_of_range": ~F.col("confidence").between(0, 1),
        "valid_but_not_observed": F.col("valid") & (F.col("availability") != "observed"),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


ABLATIONS = {  # fixed values: channels that each step keeps
    "semantic_only": ["semantic_metric_prior", "semantic_metric_temporal"],
    "motion_tracks_only": ["dynamic_reprojection", "track_3d_continuity", "direction_consistency", "relative_velocity"],
    "reprojection_only": ["point_reprojection", "boundary_reprojection", "depth_reprojection"],
    "relations_only": ["relation", "occlusion", "reappearance"],
}


def ablate(df: DataFrame, name: str) -> DataFrame:
    """The evidence of one ablation step."""
    return df.where(F.col("name").isin(ABLATIONS[name]))


def blank(df: DataFrame, channels: list[str], use_confidence: bool = True) -> DataFrame:
    """Evidence with some channels made unavailable and, if asked, all confidences set to 1."""
    out = F.col("name").isin(channels)
    df = df.withColumn("valid", F.col("valid") & ~out)
    for c in ("raw_value", "normalized_value"):
        df = df.withColumn(c, F.when(~out, F.col(c)))
    conf = F.col("confidence") if use_confidence else F.when(F.col("valid"), F.lit(1.0)).otherwise(F.col("confidence"))
    return df.withColumn("confidence", F.when(out, 0.0).otherwise(conf)).withColumn("reason", F.when(out, "ablated").otherwise(F.col("reason")))
