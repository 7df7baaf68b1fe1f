"""Lineage: stage graphs, protocol leakage, eligibility matrices, inventories, retries, pose graphs."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, source: str = "stage", target: str = "needs", rounds: int = 20) -> DataFrame:
    """All (stage, ancestor) pairs of an acyclic graph, by repeated squaring: log2(depth) joins."""
    known = edges.select(F.col(source).alias("stage"), F.col(target).alias("ancestor")).distinct()
    count = known.count()
    for _ in range(rounds):
        step = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.stage")).select(F.col("a.stage").alias("stage"), F.col("b.ancestor").alias("ancestor"))
        known = known.unionByName(step).distinct()
        now = known.count()
        if now == count:
            return known
        count = now
    raise ValueError("the graph is too deep or has a cycle")


def descendants(edges: DataFrame, stage: str) -> DataFrame:
    """Stages that need a stage, directly or through others."""
    return closure(edges).where(F.col("ancestor") == stage).select("stage")


def execution_plan(edges: DataFrame, stages: DataFrame, wanted: str) -> DataFrame:
    """The stages that ``wanted`` needs, itself last; ``position`` is the number of a stage's own ancestors."""
    all_pairs = closure(edges)
    need = all_pairs.where(F.col("stage") == wanted).select(F.col("ancestor").alias("stage")).unionByName(stages.where(F.col("stage") == wanted).select("stage")).distinct()
    depth = all_pairs.groupBy("stage").agg(F.count(F.lit(1)).alias("position"))
    return need.join(depth, "stage", "left").na.fill(0, ["position"])


def protocol_leakage(records: DataFrame, keys: list[str]) -> DataFrame:
    """Findings: values of an identity key that lie in several splits (one row a key and value)."""
    out = None
    for k in keys:
        one = records.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("value")).agg(F.count_distinct("split").alias("splits"), F.concat_ws(",", F.array_sort(F.collect_set("split"))).alias("in_splits")).where("splits > 1").select(F.lit(k).alias("finding"), "value", "splits", "in_splits")
        out = one if out is None else out.unionByName(one)
    return out


def eligibility_matrix(entities: DataFrame, evidence: DataFrame, branches: list[str], least: int = 1) -> DataFrame:
    """A row for every entity and branch: evidence rows, valid rows, and why the branch is or isn't usable.

    Entities: entity_id. Evidence: entity_id, branch, valid, reason. The branches are a fixed handful.
    """
    grid = entities.select("entity_id", F.explode(F.array(*[F.lit(b) for b in branches])).alias("branch"))
    seen = evidence.groupBy("entity_id", "branch").agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid_rows"))
    out = grid.join(seen, ["entity_id", "branch"], "left").na.fill(0, ["rows", "valid_rows"])
    return out.withColumn("status", F.when(F.col("rows") == 0, "no_observation").when(F.col("valid_rows") < least, "no_valid_evidence").otherwise("eligible"))


def inventory(videos: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Videos with isolated labels and groups; a missing group falls back to the video, a missing label stays unknown.

    Videos: video_id, provenance_label. Labels: video_id, label. Groups: video_id, group_id.
    """
    out = videos.join(labels, "video_id", "left").join(groups, "video_id", "left")
    return out.select("video_id", F.coalesce("label", "provenance_label").alias("label"), F.coalesce(F.col("group_id").cast("string"), F.concat(F.lit("video:"), F.col("video_id").cast("string"))).alias("group_id"), F.when(F.col("label").isNotNull(), "labels").when(F.col("provenance_label").isNotNull(), "provenance").otherwise("unknown").alias("label_source"))


def relocate(rows: DataFrame, mapping: DataFrame, path: str) -> DataFrame:
    """Paths of this machine, the original kept. Mapping: original, relocated."""
    m = mapping.select(F.col("original").alias("_o"), F.col("relocated").alias("_n"))
    return rows.join(m, rows[path] == m["_o"], "left").withColumn(f"original_{path}", F.col(path)).withColumn(path, F.coalesce("_n", path)).drop("_o", "_n")


def retry_decisions(batches: DataFrame, most: int = 3) -> DataFrame:
    """allowed, next_status and reason: only failed batches below the limit go again, from where their download got to.

    Batches: status, attempt, downloaded (whether the state ``downloaded`` was ever reached).
    """
    failed, left = F.col("status") == "failed", F.col("attempt") < most
    out = batches.withColumn("allowed", failed & left)
    out = out.withColumn("next_status", F.when(~F.col("allowed"), "").when(F.col("downloaded"), "processing").otherwise("downloading"))
    return out.withColumn("reason", F.when(~failed, "batch_is_not_failed").when(~left, "maximum_retry_attempts_reached").otherwise("retry_requires_explicit_state_transition"))


def recovery_actions(history: DataFrame, key: str) -> DataFrame:
    """status, last_stable_status and action of every batch. History: key, position, status."""
    stable = F.when(F.col("status").isin("planned", "downloaded", "completed", "cleaned"), F.struct("position", "status"))
    out = history.groupBy(key).agg(F.max_by("status", "position").alias("status"), F.max(stable).alias("_s"))
    action = (
        F.when(F.col("status") == "failed", "operator_review_then_retry_from_last_stable_state")
        .when(F.col("status").isin("downloading", "processing", "validating"), "mark_failed_with_interruption_reason_before_retry")
        .otherwise("no_recovery_required")
    )
    return out.select(key, "status", F.coalesce("_s.status", F.lit("planned")).alias("last_stable_status"), action.alias("action"))


def cleanup_plan(batches: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Whether a batch may be cleaned (completed, artifacts validated), and its distinct paths, sorted; nothing is deleted.

    Batches: key, status, artifacts_validated. Artifacts: key, path (of one batch: bounded).
    """
    paths = artifacts.groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("_paths"))
    allowed = (F.col("status") == "completed") & F.col("artifacts_validated")
    out = batches.join(paths, key, "left").withColumn("allowed", allowed)
    none = F.array().cast("array<string>")
    return out.select(key, "allowed", F.when(F.col("allowed"), F.coalesce("_paths", none)).otherwise(none).alias("candidate_paths"), F.when(F.col("allowed"), "").otherwise("cleanup_forbidden_before_completed_validation").alias("reason"))


def exclusion_summary(records: DataFrame) -> DataFrame:
    """Rows of every reason; a row counts for each of its reasons (array column ``reasons``)."""
    return records.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def availability_summary(records: DataFrame, modalities: list[str]) -> DataFrame:
    """Rows that have each modality (columns with counts), and their ratio."""
    long = records.select(F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(m).cast("long").alias("n")) for m in modalities])).alias("x")).select("x.*")
    return long.groupBy("modality").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("n") > 0).alias("available"), (F.count_if(F.col("n") > 0) / F.count(F.lit(1))).alias("ratio"), F.sum("n").alias("observations"))


def pose_candidates(frames: DataFrame, strides: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Frame pairs of a video to estimate a pose for: gaps of 1, 2 and 4 that cross no cut. Frames: video_id, frame_index, scene."""
    a = frames.withColumn("target", F.explode(F.array(*[F.col("frame_index") + s for s in strides])))
    b = frames.select("video_id", F.col("frame_index").alias("target"), F.col("scene").alias("_s"))
    return a.join(b, ["video_id", "target"]).where("scene = _s").select("video_id", F.col("frame_index").alias("source"), "target")


def pose_graph(edges: DataFrame, reference: int = 0, least: float = 0.2) -> DataFrame:
    """Reach every frame of a video from the reference, nearest gap first, then best quality; edges work both ways.

    Edges: video_id, source, target, quality. A frame's quality is the least on its path. Sequential inside a video.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        for s, t, q in zip(pdf["source"].astype(int), pdf["target"].astype(int), pdf["quality"].astype(float), strict=True):
            if q >= least:
                near.setdefault(s, []).append((t, q))
                near.setdefault(t, []).append((s, q))
        best, parent = {reference: math.inf}, {reference: -1}
        waiting: list[tuple[int, float, int, int]] = []

        def reach(a: int) -> None:
            for b, q in near.get(a, ()):
                if b not in best:
                    heapq.heappush(waiting, (abs(a - b), -q, a, b))

        reach(reference)
        while waiting:
            _, q, a, b = heapq.heappop(waiting)
            if b not in best:
                best[b], parent[b] = min(best[a], -q), a
                reach(b)
        frames = sorted({*pdf["source"].astype(int), *pdf["target"].astype(int), reference})
        return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]] * len(frames), "frame_index": frames, "parent": [parent.get(f) for f in frames], "quality": [None if f not in best else min(best[f], 1.0) for f in frames]}).astype({"parent": "Int64", "quality": "Float64"})

    kind = dict(edges.dtypes)["video_id"]
    return edges.groupBy("video_id").applyInPandas(run, f"video_id {kind}, frame_index long, parent long, quality double")


#: Segments that are linked side by side.
TOGETHER = 1 << 17


def _near(video: np.ndarray, start: np.ndarray, ends: np.ndarray, owner: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, start, end) of all starts and ends of the same video within reach: only ends in the nine cells around a start can be."""
    si, ej = (np.flatnonzero(np.isfinite(p).all(axis=1)) for p in (start, ends))
    if not len(si) or not len(ej):
        return np.zeros(0), si[:0], ej[:0]
    start, video, ends, owner = start[si], video[si], ends[ej], owner[ej]
    cell = lambda p: np.floor(p / reach).astype(np.int64)
    at, to = cell(ends), cell(start)
    base = min(at.min(), to.min()) - 1
    wide = max(at.max(), to.max()) - base + 2
    rows, line = np.unique(np.concatenate([owner * wide + at[:, 0] - base, *(video * wide + to[:, 0] + dx - base for dx in (-1, 0, 1))]), return_inverse=True)
    n, m = len(ends), len(start)
    key = line[:n] * wide + at[:, 1] - base
    order = np.argsort(key, kind="stable")
    key = key[order]
    found = []
    for k in range(3):
        # Three cells side by side are one range of keys.
        middle = line[n + k * m : n + (k + 1) * m] * wide + to[:, 1] - base
        lo, hi = np.searchsorted(key, middle - 1, "left"), np.searchsorted(key, middle + 1, "right")
        size = hi - lo
        i = np.repeat(np.arange(m), size)
        j = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)]
        d = np.hypot(start[i, 0] - ends[j, 0], start[i, 1] - ends[j, 1])
        ok = d <= reach
        found.append((d[ok], i[ok], j[ok]))
    d, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return d, si[i], ej[j]


def _chains(pdf: pd.DataFrame, reach: float) -> np.ndarray:
    """Chain numbers of whole videos' segments, sorted by video, frame and start."""
    video, frame = pdf["video_id"].to_numpy(), pdf["frame_index"].to_numpy()
    start, end = pdf[["u0", "v0"]].to_numpy(float), pdf[["u1", "v1"]].to_numpy(float)
    n = len(pdf)
    new = np.r_[True, video[1:] != video[:-1]]
    of, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    step = np.cumsum(np.r_[True, new[1:] | (frame[1:] != frame[:-1])])
    step = step - step[heads][of]  # the place of the frame among its video's
    chain, following = np.full(n, -1, np.int64), np.zeros(len(heads), np.int64)
    levels = np.argsort(step, kind="stable")
    cuts = np.searchsorted(step[levels], np.arange(step.max() + 2))
    before = levels[:0]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        now = levels[lo:hi]
        if len(before):
            d, i, j = _near(of[now], start[now], end[before], of[before], reach)
            # The best pair first: one that is the best of its start and of its end is taken, until none is left.
            order = np.lexsort((chain[before][j], i, d))
            i, j = i[order], j[order]
            while len(i):
                place = np.arange(len(i))
                best_i, best_j = np.full(len(now), len(i)), np.full(len(before), len(i))
                np.minimum.at(best_i, i, place)
                np.minimum.at(best_j, j, place)
                take = (best_i[i] == place) & (best_j[j] == place)
                chain[now[i[take]]] = chain[before[j[take]]]
                used_i, used_j = np.zeros(len(now), bool), np.zeros(len(before), bool)
                used_i[i[take]] = used_j[j[take]] = True
                left = ~(used_i[i] | used_j[j])
                i, j = i[left], j[left]
        fresh = now[chain[now] < 0]
        # New chains of a video are numbered on, in the order of its rows.
        v = of[fresh]
        rank = np.arange(len(v)) - np.searchsorted(v, v, "left")
        chain[fresh] = following[v] + rank
        following += np.bincount(v, minlength=len(heads))
        before = now
    return chain


def link_endpoints(segments: DataFrame, reach: float = 2.0) -> DataFrame:
    """Chain point pairs of consecutive frames: each end takes the nearest unused start within ``reach`` pixels, best first.

    Segments: video_id, frame_index, u0, v0, u1, v1. Returns a chain number for every segment. Videos are sorted and read as a stream; the first
    frames of a batch of videos are linked at once, then the second, and so on.
    """

    kind = dict(segments.dtypes)
    rows = segments.where("video_id IS NOT NULL AND frame_index IS NOT NULL").select("video_id", "frame_index", *[F.col(x).cast("double").alias(x) for x in ("u0", "v0", "u1", "v1")])
    held = ["video_id", "frame_index", "u0", "v0"]

    def run(batches):
        waiting, count = [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            waiting.append(pdf)
            count += len(pdf)
            if count >= TOGETHER:
                whole = pd.concat(waiting, ignore_index=True)
                cut = int((whole["video_id"] != whole["video_id"].iloc[-1]).sum())  # the last video may go on
                if cut:
                    yield whole.iloc[:cut][held].assign(chain=_chains(whole.iloc[:cut], reach))
                waiting = [whole.iloc[cut:]]
                count = len(whole) - cut if cut else 0  # one that outgrows a batch waits for as much again
        if waiting:
            whole = pd.concat(waiting, ignore_index=True)
            yield whole[held].assign(chain=_chains(whole, reach))

    ordered = rows.repartition("video_id").sortWithinPartitions("video_id", "frame_index", "u0", "v0")
    return ordered.mapInPandas(run, f"video_id {kind['video_id']}, frame_index {kind['frame_index']}, u0 double, v0 double, chain long")
