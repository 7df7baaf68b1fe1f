"""Depth alignment: a robust map between two frames, and one scale and shift for every frame of a sequence.

Two frames' correspondences become one array, and the rounds of the robust fit fold over it inside one expression: what
a round hands on is a line, the middle of its residuals and the reach around it, never a mask. A sequence's frames are
nodes of a graph; how far each model reaches and how well it held out is an aggregate a model, the models are
ranked by a window, and scales and shifts are potentials of the graph's Laplacian, found by conjugate gradients over its edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import stored

#: The models of an edge, the simplest first among equals, and the reasons of missing alignments.
MODES = ("scale_only", "affine_depth", "affine_inverse_depth", "provider_shared_scale")
GRAPH_MODES = MODES[:3]
FEW, FAILED, APART = "insufficient_background_depth_support", "robust_depth_alignment_failed", "depth_alignment_graph_disconnected"

ENDLESS = float("inf")


def _total(points: Column, of) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + of(p))


def _middle(numbers: Column) -> Column:
    s = F.array_sort(numbers)
    n = F.size(s)
    at = lambda i: F.get(s, F.floor(i).cast("int"))
    return (at((n - 1) / 2) + at(n / 2)) / 2


def _line(points: Column, mode: str) -> Column:
    """struct(a, b) of the least-squares line, NULL where the points don't carry one."""
    n, xx = F.size(points), _total(points, lambda p: p["x"] * p["x"])
    if mode == "scale_only":
        return F.when(xx > 1e-12, F.struct((_total(points, lambda p: p["x"] * p["y"]) / xx).alias("a"), F.lit(0.0).alias("b")))
    centre = F.struct((_total(points, lambda p: p["x"]) / n).alias("x"), (_total(points, lambda p: p["y"]) / n).alias("y"))
    # One element, so that the centre is computed once.
    return F.get(
        F.transform(
            F.array(F.struct(centre.alias("c"), xx.alias("xx"))),
            lambda m: F.get(
                F.transform(
                    F.array(F.struct(_total(points, lambda p: (p["x"] - m["c"]["x"]) * (p["x"] - m["c"]["x"])).alias("s"), _total(points, lambda p: (p["x"] - m["c"]["x"]) * (p["y"] - m["c"]["y"])).alias("t"))),
                    lambda q: F.when(q["s"] > 1e-12 * F.greatest(F.lit(1.0), m["xx"]), F.struct((q["t"] / q["s"]).alias("a"), (m["c"]["y"] - q["t"] / q["s"] * m["c"]["x"]).alias("b"))),
                ),
                F.lit(0),
            ),
        ),
        F.lit(0),
    )


def _off(p: Column, s: Column) -> Column:
    return p["y"] - s["a"] * p["x"] - s["b"]


def _inside(p: Column, s: Column) -> Column:
    return F.abs(_off(p, s) - s["m"]) <= s["reach"]


def _state(a, b, m, reach, fitted: bool, done) -> Column:
    double = lambda v, name: v.cast("double").alias(name)
    return F.struct(double(a, "a"), double(b, "b"), double(m, "m"), double(reach, "reach"), F.lit(fitted).alias("fitted"), done.alias("done"))


def _round(points: Column, state: Column, mode: str, least: int, cut: float) -> Column:
    """The state after one more round: done where the line can't be fitted or the points inside stay the same."""
    held = F.filter(points, lambda p: _inside(p, state))
    line = F.when(F.size(held) >= least, _line(held, mode))

    def judged(new: Column) -> Column:
        off = F.transform(held, lambda p: _off(p, new))
        return F.get(F.transform(F.array(_middle(off)), lambda m: F.struct(m.alias("m"), _middle(F.transform(off, lambda o: F.abs(o - m))).alias("mad"))), F.lit(0))

    def reached(new: Column) -> Column:
        scale = _middle(F.transform(held, lambda p: F.abs(p["y"])))
        found = F.transform(
            F.array(judged(new)),
            lambda j: F.struct(new["a"].alias("a"), new["b"].alias("b"), j["m"].alias("m"), F.greatest(F.lit(1e-8), F.lit(1e-4) * scale, F.lit(cut * 1.4826) * j["mad"]).alias("reach")),
        )
        return F.get(F.transform(found, lambda s: _state(s["a"], s["b"], s["m"], s["reach"], True, ~F.exists(points, lambda p: _inside(p, s) != _inside(p, state)))), F.lit(0))

    stop = F.struct(*[state[k].alias(k) for k in ("a", "b", "m", "reach", "fitted")], F.lit(True).alias("done"))
    return F.when(state["done"], state).otherwise(F.get(F.transform(F.array(line), lambda new: F.when(new.isNull(), stop).otherwise(reached(new))), F.lit(0)))


def align_depth(pairs: DataFrame, mode: str, least: int = 12, rounds: int = 8, cut: float = 3.5) -> DataFrame:
    """scale, shift, support, inlier_ratio, error (RMS), quality, reason of every pair. Pairs: pair_id, source, target.

    target = scale x source + shift over positive, finite depths: a least-squares line, of which the points within ``cut`` robust deviations
    (1.4826 MAD) of the median residual are kept for the next, until nothing changes. The inverse model fits reciprocals,
    the shared scale states a scale of 1. All points of a pair are one row's array.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported depth alignment mode: {mode}")
    c = F.col
    good = lambda x: ~F.isnan(x) & (F.col(x) > 0) & (F.col(x) < ENDLESS)
    of = (lambda x: 1 / c(x)) if mode == "affine_inverse_depth" else c
    point = F.when(good("source") & good("target"), F.struct(of("source").cast("double").alias("x"), of("target").cast("double").alias("y")))
    rows = pairs.groupBy("pair_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    rows = rows.withColumn("support", F.size("points").cast("long"))
    if mode == "provider_shared_scale":
        given = _state(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(ENDLESS), True, F.lit(True))
    else:
        start = _state(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(ENDLESS), False, F.lit(False))
        given = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, i: _round(c("points"), s, mode, least, cut))
    rows = rows.withColumn("s", F.when(c("support") >= least, given))
    rows = rows.withColumn("kept", F.when(c("s.fitted"), F.filter("points", lambda p: _inside(p, c("s")))))
    sound = c("s.fitted") & (F.size("kept") >= least) & (c("s.a") > 0) & (c("s.a") < ENDLESS) & (F.abs(c("s.b")) < ENDLESS)
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False)))
    error = F.sqrt(_total(c("kept"), lambda p: F.pow(_off(p, c("s")), F.lit(2.0))) / F.size("kept"))
    rows = rows.withColumn("error", F.when(c("ok"), error)).withColumn("inlier_ratio", F.when(c("ok"), F.size("kept") / c("support")))
    level = F.greatest(_middle(F.transform("kept", lambda p: F.abs(p["y"]))), F.lit(1e-12))
    quality = F.when(c("ok"), F.least(F.lit(1.0), c("inlier_ratio") / (1 + c("error") / level))).otherwise(F.lit(0.0))
    reason = F.when(c("support") < least, FEW).when(~c("ok"), FAILED).otherwise("")
    return rows.select("pair_id", F.when(c("ok"), c("s.a")).alias("scale"), F.when(c("ok"), c("s.b")).alias("shift"), "support", "inlier_ratio", "error", quality.alias("quality"), reason.alias("reason"))


def _joined(a: np.ndarray, b: np.ndarray, n: int, start: int | np.ndarray) -> np.ndarray:
    """Nodes that edges a - b join to ``start`` (of all, or of each node): labels sink to the smaller end and jump to their label's label."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label == label[start]
        label = new


def potentials(a: np.ndarray, b: np.ndarray, gain: np.ndarray, weight: np.ndarray, n: int, fixed: int | np.ndarray, tolerance: float = 1e-13, graph: np.ndarray | None = None) -> np.ndarray:
    """Values of n nodes, 0 at ``fixed``, whose differences b - a fit the gains best by weight: the Laplacian's
    normal equations by conjugate gradients, preconditioned by the degrees. Memory and a step's work are linear in the edges.

    ``graph`` numbers the connected graph of each node, ``fixed`` names a node of each: they are solved side by side, and leave when they are done.
    """
    fixed = np.atleast_1d(fixed)
    graph = np.zeros(n, np.int64) if graph is None else graph
    most, m = 8 * np.bincount(graph, minlength=len(fixed)) + 64, len(fixed)
    out, place = np.zeros(n), np.arange(n)
    spread = lambda flow: np.bincount(b, flow, n) - np.bincount(a, flow, n)
    dot = lambda u, v: np.bincount(graph, u * v, m)
    degree = np.maximum(np.bincount(a, weight, n) + np.bincount(b, weight, n), 1e-300)
    x, r = np.zeros(n), spread(weight * gain)
    r[fixed] = 0
    z = r / degree
    p, rz = z.copy(), dot(r, z)
    first, rounds = rz, 0
    while True:
        live = (rz > tolerance**2 * first) & (rounds < most)
        if live.sum() * 2 < m or not live.any():
            # Those that are done hand over their values; what isn't a number has none.
            out[place] = np.where(np.isnan(rz)[graph], np.nan, x)
            if not live.any():
                return out
            stays = live[graph]
            node, name = np.cumsum(stays) - 1, np.cumsum(live) - 1
            edge = stays[a]
            a, b, weight, fixed, graph, place = node[a[edge]], node[b[edge]], weight[edge], node[fixed[live]], name[graph[stays]], place[stays]
            x, r, p, degree = x[stays], r[stays], p[stays], degree[stays]
            rz, first, most, n, m = rz[live], first[live], most[live], len(place), int(live.sum())
            live = np.ones(m, bool)
        q = spread(weight * (p[b] - p[a]))
        q[fixed] = 0
        step = np.where(live, rz / np.where(live, dot(p, q), 1.0), 0.0)[graph]
        x, r = x + step * p, r - step * q
        z = r / degree
        before, rz = rz, np.where(live, dot(r, z), rz)
        p = z + np.where(live, rz / np.where(live, before, 1.0), 0.0)[graph] * p
        rounds += 1


#: Edges that are solved side by side.
TOGETHER = 1 << 17


def _model_graphs(pdf: pd.DataFrame, reference: int | None, least_quality: float) -> pd.DataFrame:
    """Of whole videos and models, each one's rows together: scale, shift and quality of the frames that usable edges join to the reference, with what ranks the model."""
    starts = ((pdf["video_id"] != pdf["video_id"].shift()) | (pdf["mode"] != pdf["mode"].shift())).to_numpy()
    of, heads = np.cumsum(starts) - 1, np.flatnonzero(starts)
    m = len(heads)
    roots = pdf["first"].to_numpy(np.int64)[heads] if reference is None else np.full(m, reference, np.int64)
    use = (pdf["scale"].notna() & (pdf["quality"] >= least_quality)).to_numpy()
    own, of = pdf[use], of[use]
    frames, at = np.unique(np.concatenate([own["source"].to_numpy(np.int64), own["target"].to_numpy(np.int64), roots]), return_inverse=True)
    names, at = np.unique(np.concatenate([of, of, np.arange(m)]) * len(frames) + at, return_inverse=True)
    a, b, root, graph = at[: len(own)], at[len(own) : 2 * len(own)], at[2 * len(own) :], names // len(frames)
    seen = _joined(a, b, len(names), root[graph])
    live = seen[a]
    a, b = a[live], b[live]
    scale, shift, quality, holdout = (own[k].to_numpy(float)[live] for k in ("scale", "shift", "quality", "holdout"))
    weight = np.maximum(quality, 1e-3)
    # Only the joined nodes take part.
    number = np.cumsum(seen) - 1
    a, b, root, graph, frames = number[a], number[b], number[root], graph[seen], frames[names[seen] % len(frames)]
    n = len(frames)
    logs = potentials(a, b, -np.log(scale), weight, n, root, graph=graph)
    shifts = potentials(a, b, -np.exp(logs[a]) * shift / scale, weight, n, root, graph=graph)
    ends = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    mean = (np.bincount(a, quality, n) + np.bincount(b, quality, n)) / np.maximum(ends, 1)
    rest, per = logs[b] - logs[a] + np.log(scale), graph[a]
    edges, known = np.bincount(per, minlength=m), ~np.isnan(holdout)
    held = np.bincount(per[known], minlength=m)
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.where(edges > 0, np.sqrt(np.bincount(per, rest**2, m) / edges), np.nan)
        error = np.where(held > 0, np.bincount(per[known], holdout[known], m) / held, np.inf)
    top = np.zeros(n, bool)
    top[root] = True
    return pd.DataFrame(
        {
            "video_id": pdf["video_id"].iloc[heads].to_numpy()[graph], "mode": pdf["mode"].iloc[heads].to_numpy()[graph], "frame_index": frames.astype(np.int64), "scale": np.exp(logs), "shift": shifts, "quality": np.where(ends > 0, mean, 1.0),
            "edges": edges[graph], "inconsistency": off[graph], "holdout": error[graph], "strength": np.bincount(per, quality, m)[graph], "reach": np.bincount(graph, minlength=m)[graph], "root": top,
        }
    )


def align_sequence(edges: DataFrame, reference: int | None = None, least_quality: float = 0.20) -> DataFrame:
    """mode, scale, shift, quality, inconsistency, reason of every frame of a video, mapping its depth into the reference frame's.

    Edges: video_id, source, target, mode, scale, shift, quality, holdout. The model joins the most of the video's frames to the reference, then has
    about the least holdout error (5 %), then is the simplest. Log scales, then shifts, fit all its edges at once by
    weighted least squares. The reference is the video's first frame. A task holds one video's edges of one model, or those of
    several videos up to ``TOGETHER``.
    """
    c = F.col
    by = Window.partitionBy("video_id")
    given = edges.where("video_id IS NOT NULL").select("video_id", "mode", *[c(k).cast("long") for k in ("source", "target")], *[c(k).cast("double") for k in ("scale", "shift", "quality", "holdout")])
    held = F.lit(True) if reference is None else F.coalesce(F.max((c("source") == reference) | (c("target") == reference)).over(by), F.lit(False))
    given = stored(given.select("*", F.min(F.least("source", "target")).over(by).alias("first"), F.max(F.greatest("source", "target")).over(by).alias("last"), held.alias("held")), "sequence-edges")
    frames = given.select("video_id", F.explode(F.array("source", "target")).alias("frame_index")).distinct()
    videos = given.select("video_id", "first", "last", "held").distinct()
    # Every model judges every video, if only by the reference alone.
    none = F.lit(None).cast("double")
    alone = videos.select("video_id", F.explode(F.array(*[F.lit(m) for m in GRAPH_MODES])).alias("mode"), c("first").alias("source"), c("first").alias("target"), *[none.alias(k) for k in ("scale", "shift", "quality", "holdout")], "first")
    ends = {k: F.coalesce(k, "first") for k in ("source", "target")}
    rows = given.where(c("mode").isin(*GRAPH_MODES)).withColumns(ends).select(*alone.columns).unionByName(alone)

    def solve(batches):
        waiting, count = [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            waiting.append(pdf)
            count += len(pdf)
            if count >= TOGETHER:
                whole = pd.concat(waiting, ignore_index=True)
                same = (whole["video_id"] == whole["video_id"].iloc[-1]) & (whole["mode"] == whole["mode"].iloc[-1])
                cut = int((~same).sum())  # the last one may go on
                if cut:
                    yield _model_graphs(whole.iloc[:cut].reset_index(drop=True), reference, least_quality)
                waiting = [whole.iloc[cut:]]
                count = len(whole) - cut if cut else 0  # one that outgrows a batch waits for as much again
        if waiting:
            yield _model_graphs(pd.concat(waiting, ignore_index=True), reference, least_quality)

    kind = dict(edges.dtypes)["video_id"]
    schema = f"video_id {kind}, mode string, frame_index long, scale double, shift double, quality double, edges long, inconsistency double, holdout double, strength double, reach long, root boolean"
    solved = stored(rows.repartition("video_id", "mode").sortWithinPartitions("video_id", "mode").mapInPandas(solve, schema), "sequence-models")
    model = solved.where("root").join(videos, "video_id").withColumn("reach", c("reach") - F.when(c("held"), 0).otherwise(1))
    model = model.withColumn("_widest", F.max("reach").over(by)).where("reach = _widest")
    model = model.withColumn("_best", F.min("holdout").over(by)).where("_best = double('Infinity') OR holdout <= _best * 1.05 + 1e-12")
    plain = F.when(c("mode") == GRAPH_MODES[0], 0).otherwise(1)
    place = F.row_number().over(by.orderBy(plain, "holdout", F.desc("strength"), "mode"))
    chosen = model.withColumn("_place", place).where("_place = 1")
    rest = F.when(c("edges") > 0, c("inconsistency")).when(c("first") == c("last"), F.lit(0.0))
    chosen = chosen.select("video_id", "mode", rest.alias("inconsistency"))
    known = solved.select("video_id", "mode", "frame_index", "scale", "shift", "quality")
    out = frames.join(chosen, "video_id").join(known, ["video_id", "mode", "frame_index"], "left")
    reason = F.when(c("scale").isNull(), APART).otherwise("")
    return out.select("video_id", "frame_index", "mode", "scale", "shift", F.coalesce("quality", F.lit(0.0)).alias("quality"), "inconsistency", reason.alias("reason"))
