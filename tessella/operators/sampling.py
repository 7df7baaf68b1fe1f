"""A small balanced sample of pairs, and the optional relations of a frame's graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What keeps a plan from being made.
BLOCKERS = ("decof_data_license_unverified", "real_source_recovery_not_ready")


def blockers(license_verified: bool, recovery_ready: bool) -> list[str]:
    return [b for b, fine in zip(BLOCKERS, (license_verified, recovery_ready), strict=True) if not fine]


def pair_plan(records: DataFrame, revision: str, limits: dict[str, int], license_verified: bool = True, recovery_ready: bool = True) -> DataFrame:
    """split, source_id, position, sample_id, label, generator of the plan: a real sample and one fake of each chosen source.

    Records: split, source_id, sample_id, is_real, generator, located (a fake's archive member, a real one's locator, is known). Sources with a located
    real sample and a located fake are ordered by sha256(revision:split:source_id); the first half of a split's limit is chosen (the limit is
    the operator). In that order each takes the fake of the generator used least so far, ties by sha256(revision:split:sample_id). A blocked plan is empty.

    Only the chosen sources, a few a split, meet in one task, with one fake for each of their generators.
    """
    c = F.col
    kinds = dict(records.dtypes)
    schema = f"split string, source_id {kinds['source_id']}, position long, sample_id {kinds['sample_id']}, label int, generator string"
    if blockers(license_verified, recovery_ready):
        return records.sparkSession.createDataFrame([], schema)
    order = lambda *what: F.sha2(F.concat_ws(":", F.lit(revision), *[c(x).cast("string") for x in what]), 256)
    key = ["split", "source_id"]
    rows = records.where(c("split").isin(*limits) & (c("is_real") | c("located")))
    # A source's first real sample decides, located or not.
    real = rows.where("is_real").groupBy(*key).agg(F.min(F.struct("sample_id", "located")).alias("r")).where("r.located").select(*key, c("r.sample_id").alias("real"))
    fakes = rows.where("NOT is_real").groupBy(*key, "generator").agg(F.min(F.struct(order("split", "sample_id").alias("tie"), "sample_id")).alias("f"))
    fakes = fakes.groupBy(*key).agg(F.collect_list(F.struct("generator", "f.tie", "f.sample_id")).alias("fakes"))  # at most one a generator
    half = F.lit(0)
    for split, limit in limits.items():
        half = F.when(c("split") == split, F.lit(limit // 2)).otherwise(half)
    place = F.row_number().over(Window.partitionBy("split").orderBy(order("split", "source_id"), "source_id"))
    chosen = real.join(fakes, key).withColumn("position", (place - 1).cast("long")).where(c("position") < half)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        out = []
        for r in pdf.sort_values("position").itertuples(index=False):
            fake = min(r.fakes, key=lambda f: (used.get(f["generator"] or "", 0), f["tie"]))
            used[fake["generator"] or ""] = used.get(fake["generator"] or "", 0) + 1
            out += [(r.split, r.source_id, r.position, r.real, 0, None), (r.split, r.source_id, r.position, fake["sample_id"], 1, fake["generator"])]
        return pd.DataFrame(out, columns=["split", "source_id", "position", "sample_id", "label", "generator"])

    return chosen.groupBy("split").applyInPandas(choose, schema)


#: Kinds of relations that a provider may give, and their units.
OPTIONAL = {"containment_overlap": "ratio", "support_contact": "meter_and_confidence"}


def optional_relations(nodes: DataFrame, given: DataFrame, frame: list[str]) -> DataFrame:
    """relation_id, relation_type, values, confidence, identity_reliable of containment and support contact between two objects of a frame.

    Nodes: frame, object_id, track_id, confidence, identity_reliable, node_type. Given: frame, source, target (track ids), relation_type, value_a, value_b.
    A relation needs both of its objects as nodes with a finite pair of values; it is as sure as the less sure of them, and its identity is reliable
    if both are. Given pairs are unordered: the smaller track comes first. One that is given twice counts once, by its smaller values.
    """
    c = F.col
    finite = lambda x: ~F.isnan(x) & (F.abs(c(x)) < float("inf"))
    rows = given.where(c("relation_type").isin(*OPTIONAL) & finite("value_a") & finite("value_b") & (c("source") != c("target")))
    rows = rows.select(*frame, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "relation_type", F.struct("value_a", "value_b").alias("v")).groupBy(*frame, "a", "b", "relation_type").agg(F.min("v").alias("v"))
    objects = nodes.where("node_type = 'object'").groupBy(*frame, "track_id").agg(F.max(F.struct("confidence", "identity_reliable", "object_id")).alias("o"))
    side = lambda s: objects.select(*frame, c("track_id").alias(s), c("o.confidence").alias(f"_c{s}"), c("o.identity_reliable").alias(f"_i{s}"))
    out = rows.join(side("a"), [*frame, "a"]).join(side("b"), [*frame, "b"])
    return out.select(
        *frame, F.concat_ws(":", "relation_type", c("a").cast("string"), c("b").cast("string")).alias("relation_id"), "relation_type", c("v.value_a").alias("value_a"), c("v.value_b").alias("value_b"), F.least("_ca", "_cb").alias("confidence"), (c("_ia") & c("_ib")).alias("identity_reliable")
    )
