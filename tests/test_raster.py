"""Rasters against sequential traces, dense arrays and greedy loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import raster

H, W = 12, 15


def masks(rng):
    out = {1: {(4, 4)}, 2: {(r, c) for r in range(2, 9) for c in range(3, 12)}, 3: {(r, c) for r in range(H) for c in range(W)}}
    out[4] = out[2] - {(4, 5), (5, 6), (4, 6), (7, 9)}  # holes, one beside another by a corner
    out[5] = {(3, c) for c in range(2, 11)} | {(4, 11), (5, 12)}  # a line, then pixels that touch by corners
    for k in range(6, 12):
        out[k] = {(r, c) for r in range(H) for c in range(W) if rng.random() < k / 13}
    return out


@pytest.fixture(scope="module")
def shapes():
    return masks(random.Random(4))


@pytest.fixture(scope="module")
def frame(spark, shapes):
    return spark.createDataFrame([(k, r, c) for k, m in shapes.items() for r, c in m], "k int, row int, col int").cache()


def test_erosion(frame, shapes):
    for e in (1, 2, 3):
        got = {(x["k"], x["row"], x["col"]) for x in raster.erode(frame, ["k"], e, W, H).collect()}
        square = lambda r, c: [(a, b) for a in range(max(0, r - e), min(H, r + e + 1)) for b in range(max(0, c - e), min(W, c + e + 1))]  # noqa: E731, B023
        assert got == {(k, r, c) for k, m in shapes.items() for r, c in m if all(p in m for p in square(r, c))}


def test_edge_distance(frame, shapes):
    got = {(x["k"], x["row"], x["col"]): x["distance"] for x in raster.edge_distance(frame, ["k"], W, H).collect()}
    for k, m in shapes.items():
        off = [(r, c) for r in range(H) for c in range(W) if (r, c) not in m]
        for r, c in m:
            assert got[k, r, c] == (min(abs(r - a) + abs(c - b) for a, b in off) if off else None)


def walk(mask):
    """All loops of directed edges, one step after the other."""
    beyond = [(-1, 0), (0, 1), (1, 0), (0, -1)]
    edges = {(r, c, s) for r, c in mask for s, (dr, dc) in enumerate(beyond) if (r + dr, c + dc) not in mask}
    loops = []
    while edges:
        start = min(edges)
        loop, at = [], start
        while True:
            loop.append(at)
            edges.discard(at)
            r, c, s = at
            (dr, dc), (ar, ac) = beyond[s], beyond[(s + 1) % 4]
            if (r + dr + ar, c + dc + ac) in mask:
                at = (r + dr + ar, c + dc + ac, (s + 3) % 4)
            elif (r + ar, c + ac) in mask:
                at = (r + ar, c + ac, s)
            else:
                at = (r, c, (s + 1) % 4)
            if at == start:
                break
        loops.append(loop)
    return loops


def test_contours_are_a_sequential_trace(frame, shapes):
    got = {}
    for x in raster.trace_contours(frame, ["k"]).collect():
        got.setdefault((x["k"], x["loop"]), {})[x["place"]] = (x["row"], x["col"], x["side"])
    found = sorted((k, [v[i] for i in range(len(v))]) for (k, _), v in got.items())
    assert found == sorted((k, loop) for k, m in shapes.items() for loop in walk(m))


def test_even_samples(frame, shapes):
    got = {}
    for x in raster.sample_contour(frame, ["k"], most=10, spacing=2.0).collect():
        got.setdefault(x["k"], {})[x["sample"]] = (x["row"], x["col"])
    for k, m in shapes.items():
        best = None
        for loop in walk(m):
            pixels = [e[:2] for i, e in enumerate(loop) if e[:2] != loop[i - 1][:2]] or [loop[0][:2]]
            area = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(pixels, pixels[1:] + pixels[:1], strict=True)) / 2
            if best is None or area > best[0]:
                best = (area, pixels)
        pixels = best[1]
        closed = pixels + pixels[:1]
        sizes = [math.dist(a, b) for a, b in zip(closed, closed[1:], strict=False)]
        total = sum(sizes)
        n = min(10, max(1, int(total / 2.0)))
        assert sorted(got[k]) == list(range(n))
        for i in range(n):
            at, j = i * total / n, 0
            while j < len(sizes) - 1 and at >= sizes[j] - 1e-9:
                at, j = at - sizes[j], j + 1
            a, b = closed[j], closed[j + 1]
            part = at / sizes[j] if sizes[j] else 0.0
            assert got[k][i] == pytest.approx((a[0] + part * (b[0] - a[0]), a[1] + part * (b[1] - a[1])), abs=1e-6)


def test_spaced_points_are_greedy(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.random() * 40, rng.random() * 40, float(rng.randrange(20))) for k in range(3) for i in range(250)]
    rows += [(9, i, float(i), 0.0, 100.0 - i) for i in range(60)]  # each point near the next: the longest chain
    got = {(r["k"], r["point_id"]): r["place"] for r in raster.spaced_points(spark.createDataFrame(rows, "k int, point_id int, row double, col double, score double"), ["k"], 4.0).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        kept = []
        for _, i, y, x, s in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[1])):
            if all((y - a) ** 2 + (x - b) ** 2 >= 16 for a, b in kept):
                want[k, i] = len(kept)
                kept.append((y, x))
    assert got == want


def test_first_spaced_points_make_no_pairs(spark, monkeypatch):
    """The first points of a key are those of the whole walk, whatever batches its rows come in, without stored conflicts."""
    rng = random.Random(4)
    rows = [(k, i, float(rng.randrange(30)), float(rng.randrange(30)), float(rng.randrange(9))) for k in range(4) for i in range(300)]
    points = spark.createDataFrame(rows + [(None, 1, 0.0, 0.0, 1.0)], "k int, point_id int, row double, col double, score double")
    want = set()
    for k in range(4):
        kept = []
        for _, i, y, x, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[1])):
            if len(kept) < 7 and all((y - a) ** 2 + (x - b) ** 2 >= 16 for a, b in kept):
                want.add((k, i, len(kept)))
                kept.append((y, x))
    monkeypatch.setattr(raster, "stored", None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r["k"], r["point_id"], r["place"]) for r in raster.spaced_points(points, ["k"], 4.0, most=7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_warp(spark, frame, shapes):
    for m in ([1, 0, 3, 0, 1, -2, 0, 0, 1], [0.5, -0.9, 9, 0.9, 0.5, -4, 0, 0, 1], [1, 0.13, 0.07, -0.11, 1, 1.03, 0.021, 0.013, 1], [1, 0, 0.013, 0, 1, 0.017, -0.1217, 0, 1]):
        got = {(x["k"], x["row"], x["col"]) for x in raster.warp(frame.withColumn("m", F.array(*[F.lit(float(x)) for x in m])), ["k"], "m", W, H).collect()}
        back = np.linalg.inv(np.array(m, float).reshape(3, 3))
        want = set()
        for r in range(H):
            for c in range(W):
                x, y, w = back @ (c, r, 1)
                if abs(w) > 1e-12:
                    at = (math.floor(y / w + 0.5), math.floor(x / w + 0.5))
                    want |= {(k, r, c) for k, s in shapes.items() if at in s}
        assert got == want
    assert raster.warp(frame.withColumn("m", F.array(*[F.lit(float(x)) for x in (1, 2, 0, 2, 4, 0, 0, 0, 1)])), ["k"], "m", W, H).count() == 0


def test_frame_hash(spark):
    rng = np.random.default_rng(1)
    h, w = 20, 31
    frames = {k: rng.integers(0, 255, (h, w)).astype(float) for k in range(3)}
    rows = [(k, r, c, float(v[r, c])) for k, v in frames.items() for r in range(h) for c in range(w)]
    got = {r["k"]: r["hash"] for r in raster.frame_hash(spark.createDataFrame(rows, "k int, row int, col int, gray double"), ["k"], w, h).collect()}
    weights = lambda n, cells: np.maximum(0, np.minimum((np.arange(n) + 1) * cells / n, np.arange(1, cells + 1)[:, None]) - np.maximum(np.arange(n) * cells / n, np.arange(cells)[:, None]))
    for k, v in frames.items():
        small = weights(h, 8) @ v @ weights(w, 9).T
        bits = (small[:, 1:] > small[:, :-1]).ravel()
        assert got[k] & (2**64 - 1) == int("".join("1" if b else "0" for b in bits), 2)


def test_contours_are_dealt_by_edges(spark, monkeypatch):
    """F14, F16: partitions follow the number of pixels and edges, not their compressed size; the same contours and samples in any number of them."""
    rows = [(k, r, c) for k in range(4) for r in range(8) for c in range(9) if (r * 7 + c * 3 + k) % 11]
    mask = spark.createDataFrame(rows, "object_id int, row int, col int")
    few = sorted(map(tuple, raster.sample_contour(mask, ["object_id"]).collect()))
    whole = sorted(map(tuple, raster.trace_contours(mask, ["object_id"]).collect()))
    monkeypatch.setattr(raster, "PIXELS", 20)
    out = raster.trace_contours(mask, ["object_id"])
    assert f", {-(-len(whole) // 20)}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == whole and sorted(map(tuple, raster.sample_contour(mask, ["object_id"]).collect())) == few
