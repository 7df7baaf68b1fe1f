"""Readers of manifests, results and tables with declared schemas, and sinks.

Nothing here infers a schema; corrupt records are kept and named, never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "sample_id string, dataset_name string, source_video_id string, group_id string, split string, label int, residual_sequence_path string"
SMALL_MANIFEST = "video_path string, label int, split string"
SPLITS = ("train", "validation", "test")
RESULT = (
    "video_id string, video_path string, risk_score double, clips array<struct<clip_id:string,start_frame:int,end_frame:int,risk_score:double,coverage:double,confidence:double,"
    "residuals:array<struct<name:string,level:string,raw_value:double,normalized_value:double,availability:string,confidence:double,valid_mask:boolean,reason:string,"
    "spatial_support:struct<kind:string,object_id:string,track_id:string,frame_index:int>,temporal_support:struct<frame_index:int,track_id:string>>>>>"
)


def read_manifest(spark: SparkSession, path: str, split: str | None = None, schema: str = MANIFEST) -> DataFrame:
    """Rows of a CSV manifest; ``problem`` names a bad split or label. The filter on split comes after that."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    problem = F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "bad_split").when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "bad_label").otherwise("")
    df = df.withColumn("problem", problem)
    return df if split is None else df.where(F.col("split") == split)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, JSON array, CSV or Parquet by suffix, under one schema."""
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    if path.endswith(".csv"):
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).option("multiLine", not path.endswith(".jsonl")).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files, one document each; ``_corrupt_record`` holds what isn't JSON."""
    return spark.read.schema(RESULT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("source_file", F.input_file_name())


def evidence_of_results(results: DataFrame) -> DataFrame:
    """One evidence row for each residual of each clip, in file order."""
    clips = results.select("video_id", F.explode("clips").alias("c")).select("video_id", F.col("c.clip_id").alias("clip_id"), F.col("c.start_frame").alias("start_frame"), F.posexplode("c.residuals").alias("row_idx", "r"))
    value = lambda c: F.when(F.col("r.valid_mask") & ~F.isnan(F.col(c)), F.col(c))
    return clips.select(
        "video_id",
        "clip_id",
        "row_idx",
        "r.name",
        "r.level",
        F.coalesce("r.temporal_support.frame_index", "r.spatial_support.frame_index").alias("frame_index"),
        F.col("r.spatial_support.object_id").alias("object_id"),
        F.coalesce("r.spatial_support.track_id", "r.temporal_support.track_id").alias("track_id"),
        value("r.raw_value").alias("raw_value"),
        value("r.normalized_value").alias("normalized_value"),
        "r.availability",
        F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("r.valid_mask", F.lit(False)).alias("valid"),
        "r.reason",
    )


#: A clip's observations: frames with their objects.
OBSERVATION = (
    "clip_id string, video_id string, frames array<struct<frame_index:int,width:int,height:int,"
    "objects:array<struct<object_id:string,label:string,mask_area:double,frame_area:double,depth:double,confidence:double,bbox:array<double>>>>>"
)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Clip observations, JSON lines or a document a file; what doesn't parse stays in ``_corrupt_record``."""
    reader = spark.read.schema(OBSERVATION + ", _corrupt_record string").option("mode", "PERMISSIVE")
    return reader.option("multiLine", path.endswith(".json")).json(path)


def write_observations(objects: DataFrame, path: str) -> None:
    """Objects (clip_id, video_id, frame_index, width, height, object columns) as one JSON document a clip, in gzip files: names repeat in every document."""
    item = F.struct("object_id", "label", "mask_area", "frame_area", "depth", "confidence", "bbox")
    frames = objects.groupBy("clip_id", "video_id", "frame_index").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.array_sort(F.collect_list(item)).alias("objects"))
    clips = frames.groupBy("clip_id", "video_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", "width", "height", "objects"))).alias("frames"))
    clips.write.option("ignoreNullFields", False).option("compression", "gzip").json(path)


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("mp4", "avi", "mov", "mkv")) -> DataFrame:
    """Path, size and content hash of the files below a folder; contents stay on the executors."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return df.where(suffix.isin(*extensions)).select("path", "length", F.sha2("content", 256).alias("sha256"))


def load_priors(priors: DataFrame, sources: DataFrame) -> DataFrame:
    """Scale priors of approved sources, one row for each class name and alias; ``problem`` names a bad range."""
    rows = priors.join(sources.where("review_status = 'approved'"), "derivation_id")
    names = rows.withColumn("label", F.explode(F.array_distinct(F.concat(F.array("class_name"), F.coalesce("aliases", F.array().cast("array<string>"))))))
    problem = F.when(~((F.col("min_m") > 0) & (F.col("max_m") > F.col("min_m"))), "bad_range").otherwise("")
    return names.withColumn("problem", problem)


def resolve_priors(objects: DataFrame, priors: DataFrame) -> DataFrame:
    """Objects with the prior of their label: exact name first, else alias, else a reason."""
    exact = priors.where("label = class_name").select(F.col("label").alias("_n"), F.struct("min_m", "max_m").alias("_e"))
    alias = priors.where("label <> class_name").groupBy(F.col("label").alias("_a")).agg(F.min(F.struct("min_m", "max_m")).alias("_l"))
    out = objects.join(exact, objects["label"] == exact["_n"], "left").join(alias, objects["label"] == alias["_a"], "left")
    found = F.coalesce("_e", "_l")
    return out.withColumn("min_m", found["min_m"]).withColumn("max_m", found["max_m"]).withColumn("prior_reason", F.when(found.isNull(), "missing_category").otherwise("")).drop("_n", "_a", "_e", "_l")


def write_table(df: DataFrame, path: str, columns: list[str], keys: list[str]) -> None:
    """Zstandard Parquet with a fixed column order; tables with a label column are refused."""
    if any("label" in c.lower() for c in columns):
        raise ValueError("labels live in a table of their own")
    df.select(*columns).sortWithinPartitions(*keys).write.option("compression", "zstd").mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.option("header", True).mode("errorifexists").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.option("ignoreNullFields", False).mode("errorifexists").json(path)
