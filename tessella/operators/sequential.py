"""Operators whose state depends on their own output: one pandas group for each video.

A group is one video (or one series), never a whole table; groups spread over the
cluster. Everything stateless around them stays in DataFrame expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost 1:1 assignment of rows to columns (inf: not allowed), by shortest augmenting paths."""
    n, m = cost.shape
    if n == 0 or m == 0:
        return []
    finite = cost[np.isfinite(cost)]
    if not len(finite):
        return []
    # A private dummy column for every row stands for staying unmatched.
    big = float(finite.max()) * (min(n, m) + 1) + 1.0
    wide = np.hstack([np.where(np.isfinite(cost), cost, 4 * big), np.full((n, n), 2 * big)])
    k = m + n
    u, v, match = np.zeros(n + 1), np.zeros(k + 1), np.zeros(k + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, used = np.full(k + 1, np.inf), np.zeros(k + 1, int), np.zeros(k + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            slack = wide[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = back[j0]
            match[j0] = match[j1]
            j0 = j1
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((i, j) for i, j in pairs if np.isfinite(cost[i, j]))


SIDES = ["x1", "y1", "x2", "y2"]
#: Pairs of boxes whose costs are looked at in one step: it bounds memory, whatever a video's length.
PAIRS = 1 << 18


def _costs(boxes: pd.DataFrame, label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What it costs box ``j`` to continue the track that box ``i`` is the last of, infinite where it may not (see :func:`associate`)."""
    at = boxes[SIDES].to_numpy(float)
    a, b = at[i], at[j]
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    cross = np.maximum(0.0, np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2])).prod(axis=-1)
    sa, sb = size(a), size(b)
    union = sa + sb - cross
    with np.errstate(divide="ignore", invalid="ignore"):
        over = np.where(union > 0, cross / union, 0.0)
        far = np.hypot(*((a[:, :2] + a[:, 2:] - b[:, :2] - b[:, 2:]) / 2).T) / np.hypot(boxes["width"].to_numpy(float), boxes["height"].to_numpy(float))[j]
        able = (label[i] == label[j]) & (sa > 0) & (sb > 0) & (far <= 0.25) & (np.maximum(sa / sb, sb / sa) <= 3) & ((over >= 0.1) | (far <= 0.125))
        return np.where(able, (1 - over) + far + 0.2 * np.abs(np.log(sa / sb)), np.inf)


def _match(rows: list[tuple[int, int, float]], n: int, track: np.ndarray, live: list[int], start: int) -> list[tuple[int, int]]:
    """Pairs (i, j) for one frame's n boxes from their possible continuations (i, j, cost): box j is i's next. ``live``: last boxes of all live tracks."""
    if len({i for i, _, _ in rows}) == len(rows):  # no two boxes want the same track: each takes its cheapest
        best: dict[int, tuple] = {}
        for i, j, cost in rows:
            best[j] = min(best.get(j, (np.inf, 0, -1)), (cost, track[i], i))
        return [(i, j) for j, (_, _, i) in best.items()]
    live = sorted(live, key=lambda i: track[i])
    place = {i: k for k, i in enumerate(live)}
    cost = np.full((n, len(live)), np.inf)
    for i, j, x in rows:
        cost[j - start, place[i]] = x
    return [(live[k], start + j) for j, k in assign(cost)]


def carry_tracks(boxes: pd.DataFrame, held: int, track: np.ndarray, following: int, max_gap: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(each box's track, the box before it on its track or -1, the next free id) for boxes in order of frames.

    The first ``held`` boxes are the last of tracks ``track`` that came before.
    """
    track = np.concatenate([np.asarray(track, np.int64), np.full(len(boxes) - held, -1, np.int64)])
    return carry_frames(boxes["frame_index"].to_numpy(), boxes, track, following, max_gap)


def carry_frames(frame: np.ndarray, boxes: pd.DataFrame, track: np.ndarray, following: int, max_gap: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What :func:`carry_tracks` gives for boxes in order of ``frame``, of which those with a ``track`` (others: -1) are the last of tracks that came before.

    Videos may follow each other if their frames lie further apart than ``max_gap``. Costs are computed for all pairs of near frames at once; frame by
    frame only the assignment is left, and of that only what two boxes compete for.
    """
    n = len(boxes)
    track, label = track.copy(), pd.factorize(boxes["label"])[0]
    before, taken = np.full(n, -1, np.int64), np.zeros(n, bool)
    first, end = np.searchsorted(frame, frame - max_gap), np.searchsorted(frame, frame)
    sizes = end - first
    sizes[track >= 0] = 0
    sums, at = np.cumsum(sizes), 0
    while at < n:
        # Whole frames: as many as hold PAIRS pairs, one at least.
        upto = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, side="right"))
        upto = max(int(end[upto]) if upto < n else n, int(np.searchsorted(frame, frame[at], side="right")))
        k = sizes[at:upto]
        j = np.repeat(np.arange(at, upto), k)
        i = np.arange(len(j)) - np.repeat(np.cumsum(k) - k, k) + first[j]
        cost = _costs(boxes, label, i, j)
        able = np.isfinite(cost)
        i, j, cost = i[able], j[able], cost[able]
        cuts = np.append(np.flatnonzero(np.diff(frame[at:upto])) + at + 1, upto).tolist()
        edges = [0, *np.searchsorted(j, cuts).tolist()]
        i, j, cost = i.tolist(), j.tolist(), cost.tolist()
        for start, stop, lo, hi in zip([at, *cuts], cuts, edges, edges[1:], strict=False):
            rows = [(i[e], j[e], cost[e]) for e in range(lo, hi) if not taken[i[e]]]
            if rows:
                live = [x for x in range(int(first[start]), int(end[start])) if not taken[x]]
                for x, y in _match(rows, stop - start, track, live, start):
                    track[y], before[y], taken[x] = track[x], x, True
            for y in range(start, stop):
                if track[y] < 0:
                    track[y], following = following, following + 1
        at = upto
    return track, before, following


def associate(boxes: DataFrame, max_gap: int = 2) -> DataFrame:
    """Track ids of detected boxes, carried from frame to frame.

    Boxes: video_id, frame_index, box_id, label, x1, y1, x2, y2, width, height. A box
    may continue a track of its label last seen at most ``max_gap`` frames ago, with
    centres within a quarter diagonal, areas within three times, and an IoU of 0.1
    or centres within an eighth; cost (1 - IoU) + distance + 0.2 |ln area ratio|, least in sum.
    ``tessella.streaming.tracks`` gives the same tracks for a stream.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_index", "box_id"], ignore_index=True)
        track, _, _ = carry_tracks(pdf, 0, np.zeros(0, np.int64), 0, max_gap)
        return pdf[["video_id", "frame_index", "box_id"]].assign(track=track)

    kinds = dict(boxes.dtypes)
    return boxes.groupBy("video_id").applyInPandas(run, f"video_id {kinds['video_id']}, frame_index {kinds['frame_index']}, box_id {kinds['box_id']}, track long")


def split_conflicts(rows: DataFrame) -> DataFrame:
    """(dataset, group_id) that lie in several splits. Rows: dataset, split, group_id."""
    return rows.groupBy("dataset", "group_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1").select("dataset", "group_id")


def plan_batches(rows: DataFrame, limit: float, strict: bool = True) -> DataFrame:
    """Next-fit packing of whole groups, in order of group_id, into batches whose input, temporary and output bytes stay below a limit.

    Rows: dataset, split, group_id, input_bytes, temporary_bytes, output_bytes. Sequential inside a dataset's split; a group in
    several splits is an error (``strict``), otherwise its parts are packed split by split.
    """
    if strict and not split_conflicts(rows).isEmpty():
        raise ValueError("source groups cross splits")
    size = F.col("input_bytes") + F.col("temporary_bytes") + F.col("output_bytes")
    groups = rows.groupBy("dataset", "split", "group_id").agg(F.sum(size).cast("double").alias("peak"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_id")
        batch, held, out = 0, None, []
        for peak in pdf["peak"]:
            if held is not None and held + peak > limit:
                batch, held = batch + 1, None
            held = peak if held is None else held + peak
            out.append(batch)
        return pdf[["dataset", "split", "group_id", "peak"]].assign(batch=out)

    kinds = dict(groups.dtypes)
    return groups.groupBy("dataset", "split").applyInPandas(run, f"dataset {kinds['dataset']}, split {kinds['split']}, group_id {kinds['group_id']}, peak double, batch long")


def plan_split(groups: DataFrame, features: list[str], ratios: dict[str, float], seed: int) -> DataFrame:
    """(group_id, split, source): whole groups, one after the other in order of sha256(seed:group), go where the squared relative
    error of their features' totals grows least (ties: the split's name).

    Groups: group_id, official (a split, NULL, or ``official_conflict``), and a count for every feature. Official
    splits stay and count first. The plan is sequential by definition: one task streams the sorted groups and holds
    nothing but a counter for each split and feature.
    """
    names = sorted(ratios)
    keyed = groups.withColumn("order_key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string")), 256))
    totals = groups.agg(*[F.sum(f).alias(f) for f in features]).first()
    target = np.array([[max(ratios[n] * float(totals[f] or 0), 1.0) for f in features] for n in names])
    fixed = keyed.where("official IS NOT NULL")
    have = np.zeros((len(names), len(features)))
    for row in fixed.groupBy("official").agg(*[F.sum(f).alias(f) for f in features]).collect():  # a row for each split
        if row["official"] in names:
            have[names.index(row["official"])] = [float(row[f]) for f in features]

    def run(batches):
        now = have.copy()
        for pdf in batches:
            out = []
            for add in pdf[features].to_numpy(float):
                used = add != 0
                old, t = now[:, used], target[:, used]
                before, after = (old - t) / t, (old + add[used] - t) / t
                i = int(np.argmin((after * after - before * before).cumsum(axis=1)[:, -1])) if used.any() else 0
                now[i] += add
                out.append(names[i])
            yield pd.DataFrame({"group_id": pdf["group_id"], "split": out, "source": "group_aware_planner"})

    kind = dict(groups.dtypes)["group_id"]
    free = keyed.where("official IS NULL").select("group_id", "order_key", *features).repartition(1).sortWithinPartitions("order_key", "group_id")
    planned = free.drop("order_key").mapInPandas(run, f"group_id {kind}, split string, source string")
    kept = fixed.select("group_id", F.col("official").alias("split"), F.when(F.col("official") == "official_conflict", "official_split_conflict").otherwise("official").alias("source"))
    return planned.unionByName(kept)


#: Thresholds of the bottle's axis.
BOTTLE = {"eigenvalue_ratio": 2.0, "extent_ratio": 1.8, "points": 20, "stability": 0.6, "compatibility": 0.8, "log_delta": 0.4}


def bottle_history(rows: DataFrame, limits: dict[str, float] = BOTTLE) -> DataFrame:
    """accepted, reason, quality of a bottle's axis in every frame; a track's history grows only by accepted rows.

    Rows: video_id, track_id, frame_index, dimension_match, axis_valid, points, eigenvalue_ratio, extent_ratio, extent,
    ax, ay, az (unit axis), point_ratio, depth_quality.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        last, out = None, []
        for r in pdf.itertuples(index=False):
            axis = np.array([r.ax, r.ay, r.az])
            steady = min(r.eigenvalue_ratio / (r.eigenvalue_ratio + 1.0), r.extent_ratio / (r.extent_ratio + 1.0))
            reason = ""
            if not r.dimension_match:
                reason = "BOTTLE_SOURCE_RUNTIME_DIMENSION_MISMATCH"
            elif not r.axis_valid:
                reason = "AXIS_INVALID"
            elif r.points < limits["points"]:
                reason = "BOTTLE_AXIS_POINT_SUPPORT_INSUFFICIENT"
            elif r.eigenvalue_ratio < limits["eigenvalue_ratio"] or r.extent_ratio < limits["extent_ratio"]:
                reason = "BOTTLE_NOT_ELONGATED_IN_3D"
            elif steady < limits["stability"]:
                reason = "BOTTLE_AXIS_UNSTABLE"
            elif last is not None and abs(float(axis @ last[0])) < limits["compatibility"]:
                reason = "BOTTLE_TRACK_AXIS_INCOMPATIBLE"
            elif last is not None and abs(math.log(r.extent) - math.log(last[1])) > limits["log_delta"]:
                reason = "BOTTLE_TRACK_SIZE_INCOMPATIBLE"
            if not reason:
                last = (axis, r.extent)
            out.append((not reason, reason, min(1.0, steady, r.point_ratio, r.depth_quality) if not reason else math.nan))
        done = pd.DataFrame(out, columns=["accepted", "reason", "quality"])
        return pd.concat([pdf[["video_id", "track_id", "frame_index"]].reset_index(drop=True), done], axis=1)

    kinds = dict(rows.dtypes)
    out = rows.groupBy("video_id", "track_id").applyInPandas(run, f"video_id {kinds['video_id']}, track_id {kinds['track_id']}, frame_index {kinds['frame_index']}, accepted boolean, reason string, quality double")
    return out.withColumn("quality", F.when(~F.isnan("quality"), F.col("quality")))


def surface_axes(points: DataFrame, key: str) -> DataFrame:
    """Eigenvalues (descending) of the covariance of every group's points, and the first axis with a positive first component."""
    c = points.groupBy(key).agg(*[F.covar_samp(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")], F.count(F.lit(1)).alias("points"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]], float)
                if not np.isfinite(m).all():
                    out.append([None] * 6)
                    continue
                w, v = np.linalg.eigh(m)
                axis = v[:, 2]
                axis = axis * (1 if axis[np.flatnonzero(np.abs(axis) > 1e-12)[0]] > 0 else -1)
                out.append([w[2], w[1], w[0], *axis])
            yield pd.concat([pdf[[key]].reset_index(drop=True), pd.DataFrame(out, columns=["l1", "l2", "l3", "ax", "ay", "az"], dtype=float)], axis=1)

    kind = dict(points.dtypes)[key]
    return c.mapInPandas(run, f"{key} {kind}, l1 double, l2 double, l3 double, ax double, ay double, az double")
