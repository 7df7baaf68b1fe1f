"""Planted motions among outliers."""

import numpy as np
import pytest

from tessella.operators import ransac

SCHEMA = "pair_id string, point_id long, x0 double, y0 double, x1 double, y1 double"


def rows_of(name, p):
    return [(name, i, *map(float, q)) for i, q in enumerate(p)]


def planted(rng, h, n, bad):
    a = rng.uniform(0, 640, (n, 2))
    b = np.column_stack([a, np.ones(n)]) @ h.T
    b = b[:, :2] / b[:, 2:] + rng.normal(0, 0.2, (n, 2))
    out = rng.permutation(n)[: int(bad * n)]
    b[out] = rng.uniform(0, 640, (len(out), 2))
    return np.hstack([a, b]), n - len(out)


def test_homographies_among_outliers(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(8):
        h = np.eye(3) + rng.normal(0, 1, (3, 3)) * [[0.1, 0.1, 20], [0.1, 0.1, 20], [1e-4, 1e-4, 0]]
        n = (9, 30, 200, 40_000)[k % 4]
        p, inliers = planted(rng, h, n, 0.0 if n == 9 else 0.4)
        want[f"p{k}"] = (h, inliers, n)
        rows += rows_of(f"p{k}", p)
    rows += [("few", 0, 0.0, 0.0, 1.0, 1.0), ("noise", 1, float("nan"), 0.0, 1.0, 1.0), ("noise", 2, None, 0.0, 1.0, float("inf"))]
    rows += rows_of("random", rng.uniform(0, 640, (60, 4)))
    got = {r["pair_id"]: r for r in ransac.robust_models(spark.createDataFrame(rows, SCHEMA), "homography", 2.0).collect()}
    for k, (h, inliers, n) in want.items():
        r = got[k]
        assert r["reason"] == "" and r["support"] == n and abs(r["inliers"] - inliers) <= max(2, 0.01 * n) and r["error"] < 0.6
        grid = np.array([[x, y, 1] for x in (50, 300, 600) for y in (50, 300, 600)], float)
        a, b = (grid @ m.T for m in (np.array(r["model"]).reshape(3, 3), h))
        assert np.abs(a[:, :2] / a[:, 2:] - b[:, :2] / b[:, 2:]).max() < (3.0 if n < 50 else 1.0)
    assert got["few"]["reason"] == got["noise"]["reason"] == "insufficient_correspondences" and got["noise"]["support"] == 0
    assert got["random"]["reason"] == "homography_estimation_failed" and got["random"]["model"] is None


def test_essential_matrices_among_outliers(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(3):
        axis = rng.normal(size=3)
        angle = 0.1 * (k + 1)
        cross = lambda v: np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        u = cross(axis / np.linalg.norm(axis))
        r = np.eye(3) + np.sin(angle) * u + (1 - np.cos(angle)) * u @ u
        t = rng.normal(size=3)
        t /= np.linalg.norm(t)
        x = rng.uniform([-2, -2, 4], [2, 2, 9], (300, 3))
        y = x @ r.T + t
        p = np.hstack([x[:, :2] / x[:, 2:], y[:, :2] / y[:, 2:]]) + rng.normal(0, 2e-4, (300, 4))
        bad = rng.permutation(300)[:120]
        p[bad, 2:] = rng.uniform(-0.6, 0.6, (120, 2))
        e = cross(t) @ r
        e /= np.linalg.norm(e)
        want[f"e{k}"] = e * np.sign(e.ravel()[np.abs(e).argmax()])
        rows += rows_of(f"e{k}", p)
    got = {r["pair_id"]: r for r in ransac.robust_models(spark.createDataFrame(rows, SCHEMA), "essential", 1e-3, draws=1024).collect()}
    for k, e in want.items():
        m = np.array(got[k]["model"]).reshape(3, 3)
        assert min(np.abs(m - e).max(), np.abs(m + e).max()) < 0.05 and got[k]["inliers"] >= 170
        s = np.linalg.svd(m)[1]
        assert s[0] == pytest.approx(s[1], rel=1e-6) and s[2] < 1e-6


def test_draws_are_minimal_and_repeat(spark):
    from pyspark.sql import functions as F

    p = spark.range(500).select(F.lit("a").alias("pair_id"), F.col("id").alias("point_id"), F.lit(500).cast("long").alias("n"), *[F.rand(i).alias(x) for i, x in enumerate(("x0", "y0", "x1", "y1"))])
    one, two = ({r["draw"]: tuple(r["sample"]) for r in ransac._draws(p, 4, 64, 3).collect()} for _ in range(2))
    assert one == two and len(one) >= 60 and all(len(v) == 16 for v in one.values()) and len(set(one.values())) == len(one)


@pytest.mark.parametrize("kind", ["homography", "essential"])
def test_residuals_in_chunks(kind):
    """distances by squares, a few points at a time, are those of the plain formulas; a model that maps to infinity has none."""
    rng = np.random.default_rng(2)
    p, models = rng.normal(size=(700, 4)), rng.normal(size=(9, 9))
    models[0, 6:] = 0
    assert ransac.CHUNK < len(p)
    got = np.concatenate([ransac.residuals(kind, models, p[lo : lo + ransac.CHUNK]) for lo in range(0, len(p), ransac.CHUNK)])
    one, other = np.c_[p[:, :2], np.ones(700)], np.c_[p[:, 2:], np.ones(700)]
    for k, m in enumerate(models.reshape(-1, 3, 3)):
        to, back = one @ m.T, other @ m
        with np.errstate(divide="ignore", invalid="ignore"):
            want = np.hypot(*(to[:, :2] / to[:, 2:] - p[:, 2:]).T) if kind == "homography" else np.abs((to * other).sum(1)) / np.sqrt((to[:, :2] ** 2).sum(1) + (back[:, :2] ** 2).sum(1))
        assert got[:, k] == pytest.approx(np.where(np.isfinite(want), want, np.inf), rel=1e-9)
