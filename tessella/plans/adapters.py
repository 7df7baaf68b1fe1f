"""Presents the driver's tables as the engine's inputs, by rules that SQL can state too.

Evidence: one row for each event; a user is a video, its events in order are frames,
eight frames a clip. ``EV`` is the same rule in DuckDB's SQL, as the first CTE ``ev``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators.branches import BRANCHES
from tessella.operators.contract import observe
from tessella.operators.fusion import CHANNELS

LEVELS = ["object", "object", "point", "track", "track", "track", "point", "boundary", "point", "pair", "object", "object"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    k = F.col("event_id")
    rows = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"),
        idx.alias("row_idx"),
        _pick(CHANNELS, k % 12).alias("name"),
        _pick(LEVELS, k % 12).alias("level"),
        _pick(BRANCHES, k % 9).alias("branch"),
        F.when(k % 5 != 0, F.col("event_type")).alias("object_id"),
        F.when(k % 3 != 0, F.concat(F.lit("t"), (k % 4).cast("string"))).alias("track_id"),
        F.when(k % 17 != 0, F.lit(1)).alias("_has_frame"),
        (F.col("value") / 50.0).alias("value"),
        (((k * 7) % 100 + 1) / 100.0).alias("confidence"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", "provider_failed").otherwise("").alias("reason"),
        F.col("event_type"),
        k.alias("ord"),
        F.col("ts"),
    )
    rows = rows.withColumn("frame_index", F.when(F.col("_has_frame").isNotNull(), F.col("row_idx"))).withColumn("clip_no", F.floor(F.col("row_idx") / 8).cast("int")).drop("_has_frame")
    rows = rows.withColumn("clip_id", F.concat(F.lit("c"), F.col("clip_no").cast("string")))
    return observe(rows)


def _case(values: list[str], index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({index} + 1)::INT)"


EV = f"""WITH ev0 AS (
  SELECT 'u' || user_id AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS row_idx,
    {_case(CHANNELS, 'event_id % 12')} AS name, {_case(LEVELS, 'event_id % 12')} AS level, {_case(BRANCHES, 'event_id % 9')} AS branch,
    CASE WHEN event_id % 5 <> 0 THEN event_type END AS object_id, CASE WHEN event_id % 3 <> 0 THEN 't' || (event_id % 4) END AS track_id,
    event_type <> 'error' AS valid, value / 50.0::DOUBLE AS v, ((event_id * 7) % 100 + 1) / 100.0::DOUBLE AS c, event_id AS ord, event_type, ts, event_id
  FROM events),
ev AS (SELECT *, CASE WHEN event_id % 17 <> 0 THEN row_idx END AS frame_index, row_idx // 8 AS clip_no, 'c' || (row_idx // 8) AS clip_id,
    CASE WHEN valid THEN v END AS raw_value, CASE WHEN valid THEN 1 - exp(-v) END AS normalized_value, CASE WHEN valid THEN c ELSE 0 END AS confidence,
    CASE WHEN valid THEN '' ELSE 'provider_failed' END AS reason FROM ev0)
"""


def aggregation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as aggregation input: value, quality and one of five applicability states."""
    e = evidence(spark, sf_dir)
    state = (
        F.when(F.col("ord") % 13 == 0, "not_applicable")
        .when(~F.col("valid"), "observation_missing")
        .when(F.col("ord") % 19 == 0, "invalid_geometry")
        .when(F.col("ord") % 23 == 0, "unsupported_mode")
        .otherwise("applicable")
    )
    return e.select("video_id", "clip_id", "clip_no", "row_idx", "level", F.coalesce("object_id", F.lit("none")).alias("object_id"), F.coalesce("track_id", F.lit("none")).alias("track_id"), F.coalesce("frame_index", F.lit(-1)).alias("frame_index"), F.col("raw_value").alias("value"), F.col("confidence").alias("quality"), state.alias("applicability"), "valid", "ord")


AG = (
    EV
    + """, ag AS (SELECT video_id, clip_id, coalesce(object_id, 'none') AS object_id, coalesce(track_id, 'none') AS track_id, coalesce(frame_index, -1) AS frame_index,
    raw_value AS value, confidence AS quality, valid, ord,
    CASE WHEN ord % 13 = 0 THEN 'not_applicable' WHEN NOT valid THEN 'observation_missing' WHEN ord % 19 = 0 THEN 'invalid_geometry'
      WHEN ord % 23 = 0 THEN 'unsupported_mode' ELSE 'applicable' END AS applicability FROM ev)
"""
)


def branch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    return e.select("video_id", "clip_id", "frame_index", "branch", "event_type", F.col("raw_value").alias("value"), F.col("confidence").alias("quality"), ((F.col("ord") % 4) / 10.0).alias("uncertainty"), (F.col("ord") % 13 != 0).alias("applicable"), "valid", (F.col("ord") % 29 != 0).alias("provider_ok"), "reason", "ord")


BR = (
    EV
    + """, br AS (SELECT video_id, clip_id, frame_index, branch, event_type, raw_value AS value, confidence AS quality, (ord % 4) / 10.0::DOUBLE AS uncertainty,
    ord % 13 <> 0 AS applicable, valid, ord % 29 <> 0 AS provider_ok, reason, ord FROM ev)
"""
)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from embeddings: 16 points a video, frames in order of vec_id, the first three components as x, y, z (z made positive)."""
    e = table(spark, sf_dir, "embeddings")
    g = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(
        F.concat(F.lit("v"), F.coalesce(F.col("label").cast("string"), F.lit("none"))).alias("video_id"),
        (F.col("vec_id") % 4).cast("int").alias("point_id"),
        F.floor(F.col("vec_id") / 40).cast("int").alias("frame0"),
        F.col("vec_id"),
        G.point(g(0), g(1), g(2) + 2.0).alias("p"),
        (F.abs(g(3)) + 0.5).alias("scale"),
    ).withColumn("frame_index", (F.row_number().over(Window.partitionBy("video_id", "point_id").orderBy("vec_id")) - 1).cast("int"))


TR = """WITH tr0 AS (SELECT 'v' || coalesce(label::VARCHAR, 'none') AS video_id, (vec_id % 4)::INT AS point_id, vec_id,
    embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE + 2.0::DOUBLE AS z, abs(embedding[4]::DOUBLE) + 0.5::DOUBLE AS scale FROM embeddings),
tr AS (SELECT *, (row_number() OVER (PARTITION BY video_id, point_id ORDER BY vec_id) - 1)::INT AS frame_index FROM tr0)
"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the objects of a frame (the order), parts as their priors."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    j = line.join(part, line["l_partkey"] == part["p_partkey"])
    return j.select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").alias("object_id"),
        F.sqrt(F.col("l_extendedprice") / 1e6).alias("projected"),
        F.col("l_quantity").alias("depth"),
        (F.col("p_size") * 0.9).cast("double").alias("low"),
        (F.col("p_size") * 1.1).cast("double").alias("high"),
        (F.sqrt(F.col("l_extendedprice")) / 10).alias("observed"),
    )


OB = """WITH ob AS (SELECT l_orderkey AS frame_id, l_linenumber AS object_id, sqrt(l_extendedprice / 1e6) AS projected, l_quantity AS depth,
    p_size * 0.9::DOUBLE AS low, p_size * 1.1::DOUBLE AS high, sqrt(l_extendedprice) / 10 AS observed FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples: the customer is the source group, the split comes from a hash of the order (so groups leak)."""
    o = table(spark, sf_dir, "orders")
    h = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 10
    return o.select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("group_id"),
        F.col("o_orderpriority").alias("dataset"),
        F.when(h < 8, "train").when(h < 9, "validation").otherwise("test").alias("split"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).cast("int").alias("label"),
        F.sha2(F.col("o_orderdate").cast("date").cast("string"), 256).alias("content_hash"),
        F.col("o_totalprice").alias("size"),
    )


RE = """WITH re0 AS (SELECT *, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 6))::BIGINT % 10 AS h FROM orders),
re AS (SELECT o_orderkey AS sample_id, o_custkey AS group_id, o_orderpriority AS dataset, CASE WHEN h < 8 THEN 'train' WHEN h < 9 THEN 'validation' ELSE 'test' END AS split,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label, sha256(o_orderdate::DATE::VARCHAR) AS content_hash, o_totalprice AS size FROM re0)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score from their length."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(y, "doc_id")
    logit = (F.col("n_chars") % 4000 - 2000) / 1000.0
    score = F.round(F.when(logit >= 0, 1 / (1 + F.exp(-logit))).otherwise(F.exp(logit) / (1 + F.exp(logit))), 4)
    return j.select("doc_id", "lang", F.col("quality").cast("int").alias("label"), score.alias("score"))


PR = """WITH pr0 AS (SELECT doc_id, lang, quality::INT AS label, (n_chars % 4000 - 2000) / 1000.0::DOUBLE AS logit FROM documents JOIN labels USING (doc_id)),
pr AS (SELECT doc_id, lang, label, round(CASE WHEN logit >= 0 THEN 1 / (1 + exp(-logit)) ELSE exp(logit) / (1 + exp(logit)) END, 4) AS score FROM pr0)
"""
