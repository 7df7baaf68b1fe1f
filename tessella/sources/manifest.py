"""Building and checking the manifest of a data set, and the registries it names."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns a training manifest must have.
REQUIRED = ("sample_id", "dataset_name", "source_video_id", "group_id", "split", "label", "residual_sequence_path")
#: Thresholds of the axis registry; those of the second list may not exceed 1.
AXIS_THRESHOLDS = (
    "bottle_eigenvalue_ratio_min",
    "bottle_extent_ratio_min",
    "bottle_point_support_min",
    "bottle_depth_coverage_min",
    "bottle_axis_stability_min",
    "bottle_track_axis_compatibility_min",
    "bottle_track_extent_log_delta_max",
    "bottle_mask_quality_min",
    "truncation_threshold",
    "occlusion_threshold",
    "robust_projection_low_quantile",
    "robust_projection_high_quantile",
)
AXIS_SHARES = ("bottle_depth_coverage_min", "bottle_axis_stability_min", "bottle_track_axis_compatibility_min", "bottle_mask_quality_min", "truncation_threshold", "occlusion_threshold", "robust_projection_low_quantile", "robust_projection_high_quantile")


def missing_columns(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> list[str]:
    """Required columns that a CSV manifest's header hasn't."""
    return sorted(set(required) - set(spark.read.option("header", True).csv(path).columns))


def read_training_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest, all columns as text; an error if required columns or all rows are missing."""
    rows = spark.read.option("header", True).csv(path)
    lost = sorted(set(REQUIRED) - set(rows.columns))
    if lost or rows.isEmpty():
        raise ValueError(f"the training manifest lacks {lost or 'rows'}")
    return rows


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's columns as text, NULL told from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)


def build(videos: DataFrame, labels: DataFrame, groups: DataFrame, splits: DataFrame) -> DataFrame:
    """One row for each video with its label, group, split and row hash; what keeps it out of use is in ``problems``.

    Videos: video_id, dataset, path, frames. Labels: video_id, label. Groups: video_id, group_id. Splits: group_id, split.
    """
    rows = videos.join(labels, "video_id", "left").join(groups, "video_id", "left").join(splits, "group_id", "left")
    rules = {"missing_label": F.col("label").isNull(), "missing_group": F.col("group_id").isNull(), "missing_split": F.col("split").isNull(), "no_frames": F.coalesce(F.col("frames"), F.lit(0)) < 1}
    problems = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    columns = ["video_id", "dataset", "path", "frames", "label", "group_id", "split"]
    return rows.select(*columns, problems.alias("problems")).withColumn("row_sha256", row_hash(rows, columns))


def digest(manifest: DataFrame) -> DataFrame:
    """rows, usable and a fingerprint that doesn't depend on the rows' order: the XOR of 60 bits of each row's hash."""
    bits = F.conv(F.substring("row_sha256", 1, 15), 16, 10).cast("long")
    return manifest.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("problems") == "").alias("usable"), F.coalesce(F.bit_xor(bits), F.lit(0)).alias("fingerprint"))


def violations(manifest: DataFrame) -> DataFrame:
    """(rule, key, rows): repeated videos, groups in several splits, rows whose hash isn't that of their columns."""
    columns = ["video_id", "dataset", "path", "frames", "label", "group_id", "split"]
    repeated = manifest.groupBy(F.col("video_id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.lit("repeated_video").alias("rule"), "key", "rows")
    crossed = manifest.where("group_id IS NOT NULL AND split IS NOT NULL").groupBy(F.col("group_id").cast("string").alias("key")).agg(F.count_distinct("split").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1").select(F.lit("group_in_several_splits").alias("rule"), "key", "rows")
    changed = manifest.where(row_hash(manifest, columns) != F.col("row_sha256")).select(F.lit("changed_row").alias("rule"), F.col("video_id").cast("string").alias("key"), F.lit(1).cast("long").alias("rows"))
    return repeated.unionByName(crossed).unionByName(changed)


def prior_registry(spark: SparkSession, entries: list[Mapping], sources: DataFrame) -> DataFrame:
    """Priors of a registry (a configuration's list) whose source is approved, a row for each name and alias.

    Sources: derivation_id, review_status. A repeated entry or name, an unapproved or unknown source, or a range that isn't 0 < min < max is an
    error: a registry is small and must be right.
    """
    seen: dict[str, str] = {}
    approved = {r[0] for r in sources.where("review_status = 'approved'").select("derivation_id").distinct().collect()}
    rows = []
    for e in entries:
        low, high = float(e["min_m"]), float(e["max_m"])
        if not 0 < low < high < math.inf:
            raise ValueError(f"{e['entry_id']}: bad range")
        if e["derivation_id"] not in approved:
            raise ValueError(f"{e['entry_id']}: its source isn't approved")
        for name in dict.fromkeys([e["class_name"], *e.get("aliases", ())]):
            if name in seen:
                raise ValueError(f"{name} is in {seen[name]} and {e['entry_id']}")
            seen[name] = e["entry_id"]
            rows.append((e["entry_id"], e["class_name"], name, e["supported_dimension"], low, high, e["derivation_id"]))
    return spark.createDataFrame(rows, "entry_id string, class_name string, label string, supported_dimension string, min_m double, max_m double, derivation_id string")


#: Splits of a training set, what its audit may say, and inputs that must not have been used.
TRAINING_SPLITS = ("train", "validation", "test")
FATAL, EMPTY = ("missing_file", "malformed", "schema_error"), "no_valid_residual"
FORBIDDEN = ("authenticity_label_used", "historical_csv_read", "m6_to_a2_bridge_called")
POLICIES = ("error", "exclude", "keep_empty")


def training_rows(rows: DataFrame, audit: DataFrame, load_splits: Sequence[str] = TRAINING_SPLITS, policy: str = "error") -> DataFrame:
    """The rows of a training manifest that are loaded: those of the wanted splits whose sample is eligible, in part or whole; with the policy ``keep_empty``
    also those without any valid residual (``empty``). Audit: sample_id, split, status."""
    _known(load_splits, policy)
    seen = audit.select("sample_id", "split", "status").dropDuplicates(["sample_id", "split"])
    good = F.col("status").isin("eligible", "partial_missing") | (F.lit(policy == "keep_empty") & (F.col("status") == EMPTY))
    return rows.where(F.col("split").isin(*load_splits)).join(seen, ["sample_id", "split"]).where(good).withColumn("empty", F.col("status") == EMPTY).drop("status")


def _known(load_splits: Sequence[str], policy: str) -> None:
    unknown = sorted(set(load_splits) - set(TRAINING_SPLITS))
    if unknown or policy not in POLICIES:
        raise ValueError(f"unknown splits {unknown} or policy {policy!r}")


def training_faults(rows: DataFrame, audit: DataFrame, commit: str, config: str, load_splits: Sequence[str] = TRAINING_SPLITS, policy: str = "error") -> DataFrame:
    """(rule, rows, example) of every rule that a training manifest breaks; the example is the smallest sample_id (NULL for a split).

    Rows: sample_id, dataset_name, source_video_id, group_id, split, label, source_commit, source_config_sha256 (empty: not stated), and the flags ``FORBIDDEN`` of
    the sample's result. Audit: sample_id, split, status. All of the manifest comes from one commit and one configuration.
    """
    _known(load_splits, policy)
    c = F.col
    text = lambda x: F.trim(F.coalesce(c(x).cast("string"), F.lit("")))
    blank, bad_input = F.lit(False), F.lit(False)
    for x in ("sample_id", "dataset_name", "source_video_id", "group_id"):
        blank = blank | (text(x) == "")
    for x in FORBIDDEN:
        bad_input = bad_input | F.coalesce(c(x), F.lit(False))
    rules = {
        "unsupported_split": ~F.coalesce(text("split").isin(*TRAINING_SPLITS), F.lit(False)),
        "empty_identity": blank,
        "label_not_binary": ~F.coalesce(c("label").isin(0, 1), F.lit(False)),
        "other_source_commit": ~text("source_commit").isin("", commit),
        "other_source_config": ~text("source_config_sha256").isin("", config),
        "forbidden_input": bad_input,
    }
    broken = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    found = rows.select("sample_id", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.min("sample_id").alias("example"))
    again = rows.groupBy("sample_id", "split").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = {"fatal_sample": c("status").isin(*FATAL)} | ({"no_valid_residual": c("status") == EMPTY} if policy == "error" else {})
    listed = audit.join(rows.select("sample_id", "split").distinct(), ["sample_id", "split"], "left_semi")
    parts = [again.agg(F.lit("repeated_sample").alias("rule"), F.count(F.lit(1)).alias("rows"), F.min("sample_id").alias("example"))]
    parts += [listed.where(cond).agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("rows"), F.min("sample_id").alias("example")) for name, cond in judged.items()]
    if {"train", "validation"} <= set(load_splits):
        loaded = training_rows(rows, audit, load_splits, policy)
        lacking = F.lit(2) - F.count_distinct(F.when(c("split").isin("train", "validation"), c("split")))
        parts.append(loaded.agg(F.lit("empty_train_or_validation").alias("rule"), lacking.cast("long").alias("rows"), F.min(F.when(F.lit(False), c("sample_id"))).alias("example")))
    for one in parts:
        found = found.unionByName(one.where("rows > 0"))
    return found


#: The formal registry's schema, its sources' columns and what its entries may say.
FORMAL = {"schema_version": "paper_core_scale_priors_v1", "unit": "meter"}
SOURCE_FIELDS = ("derivation_id", "source_type", "source_title", "publisher", "source_identifier", "source_version", "accessed_at", "sample_count", "raw_measurements_or_range", "derivation_method", "review_status")
APPROVED, TOO_BROAD = "APPROVED_SOURCE_BACKED", "CATEGORY_TOO_BROAD_WITHOUT_SUBTYPE"
DIMENSIONS, CONFIDENCES, SCOPES = ("height", "width", "length"), ("low", "medium", "high"), ("dimension_definition", "applicable_scope", "excluded_scope")


def _source_faults(sources: DataFrame) -> DataFrame:
    """(derivation_id, fault) of sources that break a rule."""
    c = F.col
    blank = F.lit(False)
    for f in SOURCE_FIELDS:
        blank = blank | (F.trim(F.coalesce(c(f).cast("string"), F.lit(""))) == "")
    again = F.count(F.lit(1)).over(Window.partitionBy("derivation_id")) > 1
    fault = F.when(again | (F.coalesce("derivation_id", F.lit("")) == ""), "is empty or repeated").when(~c("review_status").eqNullSafe(F.lit(APPROVED)), "is not source-approved")
    fault = fault.when(~F.coalesce(F.expr("try_cast(sample_count AS INT)") > 0, F.lit(False)), "has no source samples").when(blank, "has incomplete provenance")
    return sources.select("derivation_id", fault.alias("fault")).where("fault IS NOT NULL")


def _labels(entry: Mapping) -> list[str]:
    labels = [entry.get("class_name"), *entry.get("aliases", ())]
    if any(not isinstance(x, str) or not x.strip() or x != x.strip() for x in labels):
        raise ValueError(f"{entry.get('class_name')!r}: names must be non-empty exact text")
    if len(labels) != len(set(labels)):
        raise ValueError(f"{entry.get('class_name')!r} repeats a name")
    return labels


def formal_registry(spark: SparkSession, payload: Mapping, sources: DataFrame) -> DataFrame:
    """Every name of a formal prior registry: its prior (entry_id, category, dimension, min_m, max_m, confidence, minimum_observability, scopes,
    derivation_id), or why its class is ``unsupported``.

    The registry is a configuration, the sources a table (``SOURCE_FIELDS``). Whatever breaks a rule is an error: another schema or unit, a source that is
    unapproved, repeated, without samples or with an empty field, an entry without id, source, scope, a range 0 < min < max, a known dimension or
    confidence, and a name that stands twice, among priors and unsupported classes together.
    """
    for name, value in FORMAL.items():
        if payload.get(name) != value:
            raise ValueError(f"{name} must be {value!r}")
    lacking = set(SOURCE_FIELDS) - set(sources.columns)
    if lacking:
        raise ValueError(f"the source table lacks {sorted(lacking)}")
    for r in _source_faults(sources).limit(1).collect():
        raise ValueError(f"source {r['derivation_id']!r} {r['fault']}")
    wanted = sorted({str(e.get("derivation_id", "")) for e in payload.get("priors", ())})
    known = {r[0] for r in sources.where(F.col("derivation_id").isin(wanted)).select("derivation_id").collect()}  # at most the registry's entries
    names: set[str] = set()
    ids: set[str] = set()
    rows = []

    def claim(label: str) -> None:
        if label in names:
            raise ValueError(f"{label!r} stands for several entries")
        names.add(label)

    for e in payload.get("priors", ()):
        labels, entry = _labels(e), str(e.get("entry_id", ""))
        low, high, sight = float(e["min_m"]), float(e["max_m"]), float(e.get("minimum_observability", 0.0))
        checks = {
            "its id is empty or repeated": bool(entry) and entry not in ids,
            "its source isn't approved": str(e.get("derivation_id", "")) in known,
            "unsupported dimension": e.get("supported_dimension") in DIMENSIONS,
            "the range must be 0 < min < max": 0 < low < high < math.inf,
            "unknown confidence": e.get("confidence") in CONFIDENCES,
            "incomplete scope": all(e.get(s) for s in SCOPES),
        }
        for fault, fine in checks.items():
            if not fine:
                raise ValueError(f"{entry!r}: {fault}")
        ids.add(entry)
        for label in labels:
            claim(label)
            rows.append((entry, labels[0], label, e["supported_dimension"], low, high, e["confidence"], sight, *(str(e[s]) for s in SCOPES), str(e["derivation_id"]), ""))
    for e in payload.get("unsupported_classes", ()):
        if e.get("reason") != TOO_BROAD:
            raise ValueError(f"{e.get('class_name')!r}: no approved reason")
        for label in _labels(e):
            claim(label)
            rows.append((None, None, label, *[None] * 9, TOO_BROAD))
    return spark.createDataFrame(rows, "entry_id string, category string, label string, dimension string, min_m double, max_m double, confidence string, minimum_observability double, dimension_definition string, applicable_scope string, excluded_scope string, derivation_id string, unsupported string")


def axis_registry(config: Mapping) -> dict[str, float]:
    """The thresholds of an axis configuration, frozen, blind to labels and without fallback; anything else is an error."""
    wanted = {"schema_version": "paper_core_canonical_axis_v1", "unit_system": "meter", "frozen_before_real_video_run": True, "post_result_threshold_tuning": False, "authenticity_label_used": False, "universal_fallback": False}
    for name, value in wanted.items():
        if config.get(name) != value or type(config.get(name)) is not type(value):
            raise ValueError(f"{name} must be {value!r}")
    given = config.get("thresholds")
    if not isinstance(given, Mapping) or set(given) != set(AXIS_THRESHOLDS):
        raise ValueError("the thresholds are not those of the axis registry")
    out = {k: float(v) for k, v in given.items()}
    for name, value in out.items():
        least = 0.0 if name == "truncation_threshold" else math.ulp(0.0)
        if not math.isfinite(value) or value < least or (name in AXIS_SHARES and value > 1):
            raise ValueError(f"{name} is out of range")
    if out["robust_projection_low_quantile"] >= out["robust_projection_high_quantile"]:
        raise ValueError("the quantiles of the projection are out of order")
    return out
