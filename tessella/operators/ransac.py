"""Robust two-view models from point correspondences, with random samples as rows.

A pair's minimal samples are drawn by hashes: every point enters some draws, and each draw keeps the points of its least
hashes. Samples are solved in batches, every model is scored by all points of its pair in parts of bounded size whose
counts add up, and the best one is refined from sums over its inliers (the normal matrix, 45 numbers a part). No step
holds a pair's points in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import stored

#: Points of a minimal sample.
SIZE = {"homography": 4, "essential": 8}
#: Points of a pair that one task scores at a time.
PART = 1 << 15
#: Points that meet all models at once: their distances should stay in the processor's cache.
CHUNK = 256
_UPPER = np.triu_indices(9)
_POINT = ["x0", "y0", "x1", "y1"]


def design(kind: str, p: np.ndarray) -> np.ndarray:
    """Rows of the homogeneous equations A m = 0 of points (..., 4): (..., rows, 9)."""
    x, y, u, v = np.moveaxis(p, -1, 0)
    one, none = np.ones_like(x), np.zeros_like(x)
    if kind == "homography":
        return np.stack([np.stack([-x, -y, -one, none, none, none, u * x, u * y, u], -1), np.stack([none, none, none, -x, -y, -one, v * x, v * y, v], -1)], -2)
    return np.stack([u * x, u * y, u, v * x, v * y, v, x, y, one], -1)[..., None, :]


def _essential(m: np.ndarray) -> np.ndarray:
    """The nearest matrices with singular values (s, s, 0)."""
    u, s, vt = np.linalg.svd(m.reshape(-1, 3, 3))
    mean = (s[:, 0] + s[:, 1]) / 2
    return ((u * np.stack([mean, mean, np.zeros_like(mean)], 1)[:, None, :]) @ vt).reshape(-1, 9)


def solve(kind: str, normal: np.ndarray) -> np.ndarray:
    """Models (n, 9) of normal matrices (n, 9, 9): the eigenvector of the least eigenvalue."""
    m = np.linalg.eigh(normal)[1][:, :, 0]
    return _essential(m) if kind == "essential" else m


def residuals(kind: str, models: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances (points, models): transfer error in the second view, or Sampson distance."""
    x, y, u, v = (p[:, i, None] for i in range(4))
    m = [models[None, :, i] for i in range(9)]

    def line(i, j, k, p, q):
        """m[i] p + m[j] q + m[k], in one array."""
        out = m[i] * p
        out += m[j] * q
        out += m[k]
        return out

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        a, b, c = line(0, 1, 2, x, y), line(3, 4, 5, x, y), line(6, 7, 8, x, y)
        if kind == "homography":
            a /= c
            a -= u
            b /= c
            b -= v
            a *= a
            b *= b
            a += b
            out = np.sqrt(a, out=a)
        else:
            d, e = line(0, 3, 6, u, v), line(1, 4, 7, u, v)
            out = np.abs(u * a + v * b + c) / np.sqrt(a * a + b * b + d * d + e * e)
    return np.where(np.isfinite(out), out, np.inf)


def _draws(points: DataFrame, size: int, draws: int, seed: int) -> DataFrame:
    """(pair_id, draw, sample): the points of every draw that has enough of them, in arrays."""
    c = F.col
    hashed = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40))
    # A draw looks at four times the points that it keeps, so it rarely comes out short.
    wanted = F.lit(4.0 * size * draws) / c("n")
    times = F.floor(wanted) + (hashed(F.lit("extra"), "pair_id", "point_id") / float(1 << 40) < wanted - F.floor(wanted)).cast("int")
    times = F.when(c("n") <= 4 * size, F.lit(draws)).otherwise(times).cast("int")
    rows = points.where("n >= " + str(size)).withColumn("_t", times).where("_t > 0").withColumn("_j", F.explode(F.sequence(F.lit(1), c("_t"))))
    draw = F.when(c("n") <= 4 * size, c("_j") - 1).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "pair_id", "point_id", "_j"), F.lit(draws))).cast("int")
    rows = rows.select("pair_id", draw.alias("draw"), "point_id", *_POINT).dropDuplicates(["pair_id", "draw", "point_id"])
    place = F.row_number().over(Window.partitionBy("pair_id", "draw").orderBy(hashed(F.lit("place"), "pair_id", "draw", "point_id"), "point_id"))
    kept = rows.withColumn("_r", place).where(c("_r") <= size)
    sample = F.array_sort(F.collect_list(F.struct("_r", F.array(*_POINT).alias("p"))))
    return kept.groupBy("pair_id", "draw").agg(sample.alias("s")).where(F.size("s") == size).select("pair_id", "draw", F.flatten(F.transform("s", lambda q: q["p"])).alias("sample"))


def robust_models(points: DataFrame, kind: str, threshold: float, draws: int = 256, seed: int = 7, rounds: int = 2, least: int = 8) -> DataFrame:
    """model (nine numbers by rows), support, inliers, inlier_ratio, error (RMS over the inliers), reason of every pair.

    Points: pair_id, point_id, x0, y0, x1, y1; ``homography`` maps the first view to the second, scaled to a last number of 1;
    ``essential`` takes camera coordinates (pixels through the inverse intrinsics) and has a unit norm. ``threshold`` is the greatest distance of an
    inlier. Rows with a NULL or non-finite number are left out; a pair with fewer than ``least`` points, or without a model that so many fit, has a reason.
    """
    c = F.col
    size = SIZE[kind]
    good = F.lit(True)
    for x in _POINT:
        good = good & ~F.isnan(x) & (F.abs(c(x)) < float("inf"))
    ids = points.select("pair_id").distinct()
    rows = points.where(F.coalesce(good, F.lit(False))).select("pair_id", c("point_id").cast("long").alias("point_id"), *[c(x).cast("double").alias(x) for x in _POINT])
    stats = rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{x}") for x in _POINT], *[F.sqrt(F.var_pop(a) + F.var_pop(b)).alias(s) for a, b, s in (("x0", "y0", "s0"), ("x1", "y1", "s1"))])
    if kind == "essential":
        stats = stats.withColumns({**{f"m_{x}": F.lit(0.0) for x in _POINT}, "s0": F.lit(1.0), "s1": F.lit(1.0)})
    else:
        stats = stats.withColumns({s: F.when(c(s) > 1e-12, c(s)).otherwise(F.lit(1.0)) for s in ("s0", "s1")})
    stats = stored(stats, "pair-stats")
    centred = [((c(x) - c(f"m_{x}")) / c(f"s{x[1]}")).alias(x) for x in _POINT]
    part = F.pmod(F.xxhash64("point_id"), F.ceil(c("n") / PART)).cast("int")
    p = stored(rows.join(stats, "pair_id").select("pair_id", "point_id", "n", part.alias("part"), (F.lit(threshold) / c("s1")).alias("reach"), *centred), "pair-points")
    kinds = dict(p.dtypes)["pair_id"]

    def fit(batches):
        for pdf in batches:
            if len(pdf):
                a = design(kind, np.stack(pdf["sample"].to_numpy()).reshape(len(pdf), size, 4)).reshape(len(pdf), -1, 9)
                yield pdf[["pair_id", "draw"]].assign(model=list(solve(kind, np.swapaxes(a, 1, 2) @ a)))

    models = stored(_draws(p, size, draws, seed).mapInPandas(fit, f"pair_id {kinds}, draw int, model array<double>"), "pair-models")
    parts = stored(p.select("pair_id", "part").distinct(), "pair-parts")

    def score(points: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        columns = ["pair_id", "draw", "inliers", "error"]
        if not len(points) or not len(models):
            return pd.DataFrame(columns=columns)
        xy, reach = points[_POINT].to_numpy(), float(points["reach"].iloc[0])
        inliers, error = np.zeros(len(models), np.int64), np.zeros(len(models))
        held = np.stack(models["model"].to_numpy())
        for lo in range(0, len(xy), CHUNK):
            d = residuals(kind, held, xy[lo : lo + CHUNK])
            inside = d <= reach
            inliers += inside.sum(axis=0)
            error += np.where(inside, d, 0.0).sum(axis=0)
        return pd.DataFrame({"pair_id": points["pair_id"].iloc[0], "draw": models["draw"].to_numpy(), "inliers": inliers, "error": error})[columns]

    def normal(points: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        columns = ["pair_id", "inliers", "square", "sums"]
        if not len(points) or not len(models):
            return pd.DataFrame(columns=columns)
        xy = points[_POINT].to_numpy()
        d = residuals(kind, np.stack(models["model"].to_numpy()), xy)[:, 0]
        inside = d <= float(points["reach"].iloc[0])
        a = design(kind, xy[inside]).reshape(-1, 9)
        return pd.DataFrame({"pair_id": [points["pair_id"].iloc[0]], "inliers": [int(inside.sum())], "square": [float((d[inside] ** 2).sum())], "sums": [(a.T @ a)[_UPPER]]})[columns]

    def against(models: DataFrame, run, schema: str) -> DataFrame:
        spread = models.join(parts, "pair_id")
        return p.groupBy("pair_id", "part").cogroup(spread.groupBy("pair_id", "part")).applyInPandas(run, schema)

    scored = against(models, score, f"pair_id {kinds}, draw int, inliers long, error double").groupBy("pair_id", "draw").agg(F.sum("inliers").alias("inliers"), F.sum("error").alias("error"))
    first = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("inliers"), "error", "draw"))
    best = scored.withColumn("_r", first).where("_r = 1").select("pair_id", "draw").join(models, ["pair_id", "draw"]).select("pair_id", "model")

    def refit(batches):
        for pdf in batches:
            if len(pdf):
                full = np.zeros((len(pdf), 9, 9))
                full[:, _UPPER[0], _UPPER[1]] = full[:, _UPPER[1], _UPPER[0]] = np.stack(pdf["sums"].to_numpy())
                yield pdf[["pair_id"]].assign(model=list(solve(kind, full)))

    sums = f"pair_id {kinds}, inliers long, square double, sums array<double>"
    total = [F.sum("inliers").alias("inliers"), F.sum("square").alias("square")]
    for i in range(rounds):
        best = stored(best, f"pair-best-{i}")
        added = against(best, normal, sums).groupBy("pair_id").agg(*total, F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(45)]).alias("sums"))
        refined = added.where(c("inliers") >= max(size, least)).select("pair_id", "sums").mapInPandas(refit, f"pair_id {kinds}, model array<double>")
        # A pair whose refit lacks support keeps what it has.
        best = best.withColumnRenamed("model", "_old").join(refined, "pair_id", "left").select("pair_id", F.coalesce("model", "_old").alias("model"))
    best = stored(best, "pair-best")
    final = against(best, normal, sums).groupBy("pair_id").agg(*total)

    def scaled(batches):
        for pdf in batches:
            out = []
            for m, a, b in zip(pdf["model"], pdf[["m_x0", "m_y0", "s0"]].to_numpy(), pdf[["m_x1", "m_y1", "s1"]].to_numpy(), strict=True):
                m = np.asarray(m, float).reshape(3, 3)
                if kind == "homography":
                    m = np.array([[b[2], 0, b[0]], [0, b[2], b[1]], [0, 0, 1]]) @ m @ np.array([[1 / a[2], 0, -a[0] / a[2]], [0, 1 / a[2], -a[1] / a[2]], [0, 0, 1]])
                    m = m / m[2, 2] if abs(m[2, 2]) > 1e-12 else m
                else:
                    m = m / np.linalg.norm(m)
                    m = m * np.sign(m.ravel()[np.abs(m).argmax()])
                out.append(m.ravel())
            yield pdf[["pair_id"]].assign(model=out)

    shown = best.join(stats, "pair_id").select("pair_id", "model", *[f"m_{x}" for x in _POINT], "s0", "s1").mapInPandas(scaled, f"pair_id {kinds}, model array<double>")
    out = ids.join(stats.select("pair_id", "n", "s1"), "pair_id", "left").join(final, "pair_id", "left").join(shown, "pair_id", "left")
    enough = F.coalesce(c("n") >= least, F.lit(False))
    fits = F.coalesce(enough & (c("inliers") >= least), F.lit(False))
    return out.select(
        "pair_id", F.when(fits, c("model")).alias("model"), F.coalesce("n", F.lit(0)).alias("support"), F.when(fits, c("inliers")).otherwise(F.lit(0)).alias("inliers"), F.when(fits, c("inliers") / c("n")).alias("inlier_ratio"),
        F.when(fits, F.sqrt(c("square") / c("inliers")) * c("s1")).alias("error"), F.when(~enough, "insufficient_correspondences").when(~fits, f"{kind}_estimation_failed").otherwise("").alias("reason"),
    )
