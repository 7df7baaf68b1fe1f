"""Hand-computed cases and invariants of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import stats
from tessella.operators import aggregate, alignment, branches, contract, fusion, governance, metrics, relations, residuals, sequential, windows
from tessella.sources import records

EV = "video_id string, clip_id string, row_idx int, name string, level string, frame_index int, object_id string, track_id string, normalized_value double, confidence double, valid boolean"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_missing_lowers_coverage_not_risk(spark):
    e = spark.createDataFrame([("v", "c", 0, "a", "object", 0, "o", None, 0.4, 0.5, True), ("v", "c", 1, "a", "object", 0, "o", None, None, 0.0, False)], EV)
    (got,) = fusion.fuse_clips(e).collect()
    assert got["risk_score"] == pytest.approx(0.4) and got["coverage"] == 0.5 and got["confidence"] == pytest.approx(0.25)


def test_all_missing_gives_null(spark):
    e = spark.createDataFrame([("v", "c", 0, "a", "object", 0, "o", None, None, 0.0, False)], EV)
    (got,) = fusion.fuse_clips(e).collect()
    assert got["risk_score"] is None and got["coverage"] == 0 and got["confidence"] == 0
    assert fusion.fuse_videos(fusion.fuse_clips(e)).first()["risk_score"] is None


def test_contributions_add_up(spark):
    e = spark.createDataFrame([("v", "c", i, f"n{i % 3}", "object", i % 2, f"o{i % 2}", None, 0.1 * i, 0.2 + 0.1 * i, True) for i in range(6)], EV)
    risk = fusion.fuse_clips(e).first()["risk_score"]
    assert fusion.contributions(e).agg(F.sum("contribution")).first()[0] == pytest.approx(risk)


def test_contract(spark):
    df = spark.createDataFrame([(float("nan"), 0.9, True, ""), (-1.0, 0.9, True, ""), (2.0, 0.9, False, "gate")], "value double, confidence double, ok boolean, reason string")
    got = contract.observe(df)
    assert contract.violations(got).count() == 0
    assert [r["valid"] for r in got.collect()] == [False, True, False]
    assert got.collect()[1]["normalized_value"] == 0.0 and got.collect()[0]["reason"] == "value_not_finite"


@pytest.mark.parametrize("method,want", [("median", 2.5), ("top_k_mean", 3.0), ("trimmed_mean", 2.5)])
def test_methods(spark, method, want):
    df = spark.createDataFrame([("k", float(v), 0.5, "applicable", True, i) for i, v in enumerate([1, 2, 3, 4])], "k string, value double, quality double, applicability string, valid boolean, ord int")
    assert aggregate.aggregate(df, ["k"], method).first()["value"] == pytest.approx(want)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        aggregate.aggregate(spark.range(1), ["id"], "mode")


def test_sliding_clips_end_at_the_last_frame(spark):
    v = spark.createDataFrame([("a", 23), ("b", 1), ("c", 8)], "video_id string, n_frames int")
    got = rows(windows.sliding_clips(v, 8, 4).orderBy("video_id", "clip_ordinal"))
    assert got[-1] == ("c", 0, 0, 7) and [r for r in got if r[0] == "a"][-1] == ("a", 4, 15, 22) and not [r for r in got if r[0] == "b"]


def test_intervals(spark):
    s = spark.createDataFrame([("v", i, x, 1.0) for i, x in enumerate([0.9, 0.9, None, 0.9, 0.1, 0.1, 0.1, 0.9])], "k string, frame_index int, score double, quality double")
    got = rows(windows.threshold_intervals(s, "k", 0.8, width=1))
    assert [(r[1], r[2], r[5], r[6]) for r in got] == [(0, 3, 3, 1)]


def test_islands_use_the_running_end(spark):
    c = spark.createDataFrame([("v", 0, 20, 0.9), ("v", 3, 5, 0.8), ("v", 21, 25, 0.7), ("v", 40, 41, 0.9)], "video_id string, start_frame int, end_frame int, risk_score double")
    got = sorted((r["start_frame"], r["end_frame"], r["clips"]) for r in windows.merge_suspicious(c, 0.5).collect())
    assert got == [(0, 25, 3), (40, 41, 1)]


def test_geometry(spark):
    cam = [F.lit(float(x)) for x in (20, 20, 16, 16)]
    df = spark.range(1).select(G.project(G.back_project(F.lit(10.0), F.lit(12.0), F.lit(2.0), *cam), *cam).alias("uv"), G.back_project(F.lit(1.0), F.lit(1.0), F.lit(-1.0), *cam).alias("none"))
    got = df.first()
    assert (got["uv"]["u"], got["uv"]["v"]) == pytest.approx((10, 12)) and got["none"] is None


def test_sigmoid_is_stable(spark):
    got = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(stats.sigmoid("x")).collect()
    assert [r[0] for r in got] == [0.0, 0.5, 1.0]


def test_auc(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, 0.8), ("b", 1, 0.3)], "k string, label int, score double")
    got = {r["k"]: r["roc_auc"] for r in metrics.auc(df, ["k"]).collect()}
    assert got == {"a": 1.0, "b": None}


def test_branch_dropout_leaves_one_out(spark):
    df = spark.createDataFrame([("v", "c", None, b, 0.5 + i, 0.8, 0.0, True, True, True, "", i) for i, b in enumerate(("relation", "occlusion"))], "video_id string, clip_id string, frame_index int, branch string, value double, quality double, uncertainty double, applicable boolean, valid boolean, provider_ok boolean, reason string, ord int")
    got = {r["dropped"]: r["active_branches"] for r in branches.dropout(df, ["video_id"]).collect()}
    assert got["relation"] == 1 and got["semantic_metric"] == 2


def test_leakage(spark):
    df = spark.createDataFrame([("s1", "g", "train"), ("s2", "g", "test"), ("s3", None, "test")], "sample_id string, group_id string, split string")
    got = rows(governance.leakage(df, ["sample_id", "group_id"]).select("key", "left_split", "right_split", "shared", "examples"))
    assert got == [("group_id", "train", "test", 1, "g")]


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    from itertools import permutations

    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        cost = rng.random((n, m))
        cost[rng.random((n, m)) < 0.3] = np.inf
        got = sequential.assign(cost)
        best = (0, 0.0)
        for k in range(min(n, m), 0, -1):
            totals = [sum(cost[i, j] for i, j in zip(r, c, strict=True)) for r in permutations(range(n), k) for c in permutations(range(m), k)]
            totals = [t for t in totals if math.isfinite(t)]
            if totals:
                best = (k, min(totals))
                break
        assert (len(got), sum(cost[i, j] for i, j in got)) == (best[0], pytest.approx(best[1]))


def test_tracks_continue(spark):
    b = spark.createDataFrame([("v", f, 0, "car", 10.0 + f, 10.0, 30.0 + f, 30.0, 100.0, 100.0) for f in range(4)] + [("v", 2, 1, "dog", 10.0, 10.0, 30.0, 30.0, 100.0, 100.0)], "video_id string, frame_index int, box_id int, label string, x1 double, y1 double, x2 double, y2 double, width double, height double")
    got = {(r["frame_index"], r["box_id"]): r["track"] for r in sequential.associate(b).collect()}
    assert len({got[f, 0] for f in range(4)}) == 1 and got[2, 1] != got[2, 0]


@pytest.mark.parametrize("mode", alignment.MODES)
def test_depth_alignment_modes(spark, mode):
    """Each model finds its own line among outliers; the shared scale only measures."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0.5, 4, 60)
    y = {"scale_only": 2 * x, "affine_depth": 2 * x + 1, "affine_inverse_depth": 1 / (0.5 / x + 0.25), "provider_shared_scale": x}[mode]
    y = np.where(np.arange(60) % 9 == 4, y + 50, y)
    rows = [("p", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("p", None, 1.0), ("p", -1.0, 1.0), ("q", 1.0, 1.0)]
    got = {r["pair_id"]: r for r in alignment.align_depth(spark.createDataFrame(rows, "pair_id string, source double, target double"), mode).collect()}
    assert got["q"]["reason"] == "insufficient_background_depth_support" and got["q"]["scale"] is None
    p = got["p"]
    assert p["support"] == 60 and p["reason"] == ""
    if mode == "provider_shared_scale":
        error = float(np.sqrt(np.mean((y - x) ** 2)))
        assert p["error"] == pytest.approx(error) and p["quality"] == pytest.approx(1 / (1 + error / np.median(y)))
    else:
        scale, shift = {"scale_only": (2, 0), "affine_depth": (2, 1), "affine_inverse_depth": (0.5, 0.25)}[mode]
        assert p["scale"] == pytest.approx(scale) and p["shift"] == pytest.approx(shift, abs=1e-9) and p["inlier_ratio"] == pytest.approx(53 / 60)


def test_depth_alignment_never_keeps_a_negative_scale(spark):
    df = spark.createDataFrame([("p", float(i + 1), 100.0 - i) for i in range(40)], "pair_id string, source double, target double")
    assert alignment.align_depth(df, "affine_depth").first()["reason"] == "robust_depth_alignment_failed"


def test_sequence_alignment(spark):
    """Scales and shifts come back from consistent edges, over a missing one; what no edge reaches has a reason."""
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0.5, 2, 8), rng.uniform(-0.2, 0.2, 8)
    a[0], b[0] = 1.0, 0.0
    rows = []
    for i in range(7):
        for j in (i + 1, i + 2):
            if j < 7 and (i, j) != (2, 3):
                rows.append(("v", i, j, "affine_depth", float(a[i] / a[j]), float((b[i] - b[j]) / a[j]), 0.9, 0.01))
    rows.append(("v", 6, 7, "affine_depth", 1.0, 0.0, 0.1, 0.01))  # too poor
    rows.append(("v", 0, 1, "scale_only", 1.0, 0.0, 0.9, 0.001))  # reaches fewer frames
    got = {r["frame_index"]: r for r in alignment.align_sequence(spark.createDataFrame(rows, "video_id string, source long, target long, mode string, scale double, shift double, quality double, holdout double")).collect()}
    for i in range(7):
        assert got[i]["scale"] == pytest.approx(a[i]) and got[i]["shift"] == pytest.approx(b[i], abs=1e-9) and got[i]["mode"] == "affine_depth"
    assert got[7]["reason"] == "depth_alignment_graph_disconnected" and got[7]["scale"] is None


def test_potentials_of_noisy_edges():
    """Conjugate gradients against dense least squares, on a graph with cycles and parallel edges."""
    rng = np.random.default_rng(11)
    n, m = 60, 240
    a, b = np.concatenate([np.arange(n - 1), rng.integers(0, n, m)]), np.concatenate([np.arange(1, n), rng.integers(0, n, m)])
    a, b = a[a != b], b[a != b]
    gain, weight = rng.normal(size=len(a)), rng.uniform(0.1, 1, len(a))
    dense = np.zeros((len(a), n))
    dense[np.arange(len(a)), b] += 1
    dense[np.arange(len(a)), a] -= 1
    free = np.arange(n) != 4
    want = np.zeros(n)
    want[free] = np.linalg.lstsq(dense[:, free] * np.sqrt(weight)[:, None], gain * np.sqrt(weight), rcond=None)[0]
    assert alignment.potentials(a, b, gain, weight, n, 4) == pytest.approx(want, abs=1e-9)


def test_sequences_side_by_side(spark, monkeypatch):
    """F8: many graphs in one run of conjugate gradients have each its own values, long or short, cut anywhere into batches."""
    rng = np.random.default_rng(12)
    parts, want, at = [], [], 0
    for n in (2, 40, 3, 150, 5, 1):
        a, b = np.arange(n - 1), np.arange(1, n)
        a, b = np.concatenate([a, a[: n // 2]]), np.concatenate([b, b[: n // 2]])
        gain, weight = rng.normal(size=len(a)), rng.uniform(0.1, 1, len(a))
        want.append(alignment.potentials(a, b, gain, weight, n, 0))
        parts.append((a + at, b + at, gain, weight, at, n))
        at += n
    join = lambda i: np.concatenate([p[i] for p in parts])
    got = alignment.potentials(join(0), join(1), join(2), join(3), at, np.array([p[4] for p in parts]), graph=np.repeat(np.arange(len(parts)), [p[5] for p in parts]))
    assert got == pytest.approx(np.concatenate(want), abs=1e-9)
    monkeypatch.setattr(alignment, "TOGETHER", 7)
    rows, known = [], {}
    for v, n in enumerate((2, 30, 4, 3, 12)):
        a, b = rng.uniform(0.5, 2, n), rng.uniform(-0.2, 0.2, n)
        a[0], b[0] = 1.0, 0.0
        known |= {(f"v{v}", i): (a[i], b[i]) for i in range(n)}
        rows += [(f"v{v}", i, i + 1, "affine_depth", float(a[i] / a[i + 1]), float((b[i] - b[i + 1]) / a[i + 1]), 0.9, 0.01) for i in range(n - 1)]
    df = spark.createDataFrame(rows, "video_id string, source long, target long, mode string, scale double, shift double, quality double, holdout double")
    found = {(r["video_id"], r["frame_index"]): (r["scale"], r["shift"]) for r in alignment.align_sequence(df).collect()}
    assert found.keys() == known.keys() and all(found[k] == pytest.approx(known[k], abs=1e-9) for k in known)


def _exchanges(df):
    """Shuffles of a plan, as planned before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_pixels_of_dealt_supports_move_no_more(spark):
    """supports dealt by their frame meet in it without another shuffle; several depths of one object and missing values count as in a join of the supports with themselves."""
    from tessella.operators import pooling

    rng = np.random.default_rng(3)
    rows = [(int(k) if k else None, int(o), int(p), float(d)) for k, o, p, d in zip(rng.integers(0, 4, 300), rng.integers(0, 5, 300), rng.integers(0, 9, 300), rng.integers(0, 4, 300), strict=True)] + [(1, 2, None, 3.0), (1, 2, 3, None)]
    df = spark.createDataFrame(rows, "f int, object_id int, pixel int, depth double")
    want = {}
    for f, a, p, x in rows:
        for g, b, q, y in rows:
            if f is not None and f == g and p is not None and p == q and x is not None and y is not None and (x < y or (x == y and a < b)):
                n, u, v = want.get((f, a, b), (0, math.inf, math.inf))
                want[f, a, b] = (n + 1, min(u, x), min(v, y))
    dealt = pooling.occlusion_pairs(df.repartition(3, "f"), ["f"])
    assert _exchanges(dealt) == 1
    assert {tuple(r)[:3]: tuple(r)[3:] for r in dealt.collect()} == want


def test_bound_points_are_dealt_once(spark):
    """one shuffle, into as many partitions as there are rows for; repeated points, frames without boxes, missing names and boxes."""
    rows = [("v", 1, f, 5.0, 5.0) for f in range(4)] + [("v", 1, 3, 5.0, 5.0), ("v", 2, 0, 5.0, 5.0), ("v", 2, 1, 25.0, 5.0), ("v", 3, 0, 5.0, 5.0), ("v", 3, 7, 5.0, 5.0), ("v", 4, 0, 90.0, 5.0), ("v", None, 0, 5.0, 5.0), (None, 1, 0, 5.0, 5.0), ("v", 5, None, 5.0, 5.0), ("v", 5, 0, 5.0, 5.0), ("v", 5, 1, 5.0, 5.0)]
    boxes = [("v", f, o, x, 0.0, x + 10, 10.0) for f in range(4) for o, x in (("a", 0.0), ("b", 20.0), (None, 0.0))] + [(None, 0, "a", 0.0, 0.0, 9.0, 9.0), ("v", None, "a", 0.0, 0.0, 9.0, 9.0)]
    points = spark.createDataFrame(rows, "video_id string, point_id int, frame_index int, u double, v double")
    out = relations.bind_points(points, spark.createDataFrame(boxes, "video_id string, frame_index int, object_id string, x1 double, y1 double, x2 double, y2 double"))
    assert _exchanges(out) == 1 and "ENSURE_REQUIREMENTS" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["video_id"], r["point_id"]): (r["object_id"], r["consistency"], r["state"]) for r in out.collect()}
    assert got == {
        ("v", 1): ("a", 0.8, "bound"), ("v", 2): (None, 1.0, "object_assignment_switched"), ("v", 3): (None, 0.5, "inconsistent"), ("v", 4): (None, 0.0, "background"), ("v", None): (None, 0.0, "background"), (None, 1): (None, 0.0, "background"),
        ("v", 5): ("a", pytest.approx(2 / 3), "bound"),
    }


def test_anchors_are_dealt_by_rows(spark):
    """no step leaves its partitions to the compressed size of what it reads."""
    from tessella.operators import scale

    o = spark.createDataFrame([(1, i, True, float(i), "relative_3d", 2.0 * i, 4.0 * i, 0.5 + i / 10) for i in (1, 2, 3)], "f int, object_id int, valid boolean, scale double, scale_status string, low double, high double, quality double")
    anchors = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (1, 1, 3), (1, 2, 9)], "f int, object_id int, anchor_id int")
    out = scale.anchored_size(o, o.select("f", "object_id", F.lit(True).alias("independent")), anchors, ["f"])
    assert "ENSURE_REQUIREMENTS" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["object_id"]: (r["scene_scale"], r["anchors"], r["reason"]) for r in out.collect()}
    assert got == {1: (3.0, 2, ""), 2: (None, 0, "no_valid_independent_scale_anchor"), 3: (None, 0, "no_independent_scale_anchor")}


def test_smoothed_pixels_move_no_more(spark):
    """rows are dealt by frames before the kernel multiplies them, and once."""
    from tessella.operators import pooling

    heat = spark.createDataFrame([("v", 0, 5, 5, 2.0), ("v", 1, 0, 0, 0.0), ("v", 1, 9, 9, 0.0), ("w", 0, 1, 1, 1.0), ("w", 0, 1, 2, 1.0)], "video_id string, frame int, row int, col int, value double")
    out = pooling.smooth_heatmap(heat)
    assert _exchanges(out) == 1
    got = {tuple(r)[:4]: r["value"] for r in out.select("video_id", "frame", "row", "col", "value").collect()}
    assert len(got) == 25 + 50 + 30 and got["v", 0, 5, 5] == 1.0 and got["v", 0, 4, 5] == pytest.approx(math.exp(-0.5)) and got["v", 1, 9, 9] == 0.0
    assert got["w", 0, 1, 1] == got["w", 0, 1, 2] == 1.0 and got["w", 0, 1, 0] == pytest.approx((math.exp(-0.5) + math.exp(-2)) / (1 + math.exp(-0.5)))


def test_broken_pose_breaks_all_later(spark):
    unit = [float(x) for x in (1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]
    df = spark.createDataFrame([("v", 0, unit, 0.9), ("v", 1, unit, 0.5), ("v", 2, None, 0.9), ("v", 3, unit, 0.9)], "video_id string, frame_index int, pose array<double>, confidence double")
    got = residuals.prefix_poses(df).orderBy("frame_index").collect()
    assert got[1]["pose_to_first"][3] == 2 and got[1]["chain_confidence"] == 0.5 and got[2]["pose_to_first"] is None and got[3]["pose_to_first"] is None


def test_relation_unmatched_has_a_reason(spark):
    p = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame([("v", 0, 1, (0.0, 0.0, 1.0)), ("v", 0, 2, (1.0, 0.0, 1.0)), ("v", 1, 1, (0.0, 0.0, 1.0))], f"video_id string, frame_index int, node_id int, p {p}")
    got = relations.relation_diff(relations.relation_graph(df, ["video_id", "frame_index"]), "video_id").collect()
    assert all(r["distance_change"] is None and r["reason"] for r in got)


def test_manifest_problems(spark, tmp_path):
    (tmp_path / "m.csv").write_text("video_path,label,split\na.mp4,1,train\nb.mp4,0,val\nc.mp4,7,test\n")
    got = [r["problem"] for r in records.read_manifest(spark, str(tmp_path / "m.csv"), schema=records.SMALL_MANIFEST).orderBy("video_path").collect()]
    assert got == ["", "bad_split", "bad_label"]


def test_result_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"video_id": "v", "clips": [{"clip_id": "c", "start_frame": 0, "residuals": [{"name": "relation", "level": "pair", "normalized_value": 0.1, "raw_value": 0.1, "availability": "observed", "confidence": 0.9, "valid_mask": true, "reason": ""}, {"name": "relation", "valid_mask": false, "reason": "blocked"}]}]}')
    (tmp_path / "b.json").write_text("not json")
    r = records.read_results(spark, str(tmp_path)).cache()
    assert r.where("_corrupt_record IS NOT NULL").count() == 1
    assert [x["valid"] for x in records.evidence_of_results(r).orderBy("row_idx").collect()] == [True, False]


def test_label_columns_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        records.write_table(spark.range(1).withColumn("label", F.lit(1)), str(tmp_path / "t"), ["id", "label"], ["id"])


def test_priors(spark):
    priors = spark.createDataFrame([("car", ["auto"], 2.9, 4.9, "d"), ("cup", None, 0.3, 0.1, "x")], "class_name string, aliases array<string>, min_m double, max_m double, derivation_id string")
    sources = spark.createDataFrame([("d", "approved"), ("x", "draft")], "derivation_id string, review_status string")
    objects = spark.createDataFrame([("car",), ("auto",), ("cup",)], "label string")
    got = {r["label"]: (r["min_m"], r["prior_reason"]) for r in records.resolve_priors(objects, records.load_priors(priors, sources)).collect()}
    assert got == {"car": (2.9, ""), "auto": (2.9, ""), "cup": (None, "missing_category")}


def test_prefix_products_match_numpy(spark):
    rng = np.random.default_rng(3)
    poses = []
    for _ in range(6):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        t = np.eye(4)
        t[:3, :3], t[:3, 3] = q, rng.normal(size=3)
        poses.append(t)
    rows = [("v", i, [float(x) for x in p.ravel()], 1 - i / 10) for i, p in enumerate(poses)]
    got = residuals.prefix_poses(spark.createDataFrame(rows[::-1], "video_id string, frame_index int, pose array<double>, confidence double")).orderBy("frame_index").collect()
    chain = np.eye(4)
    for i, (p, r) in enumerate(zip(poses, got, strict=True)):
        chain = p @ chain
        assert np.allclose(np.array(r["pose_to_first"]).reshape(4, 4), chain) and r["chain_confidence"] == pytest.approx(1 - i / 10)


def test_size_history_uses_the_last_five_of_the_axis(spark):
    rows = [("v", "t", i, float(i + 1), "x" if i != 3 else "y", 0.5) for i in range(8)]
    got = residuals.size_history(spark.createDataFrame(rows, "video_id string, track_id string, frame_index int, size double, axis string, confidence double")).orderBy("frame_index").collect()
    assert got[0]["reason"] == "no_track_history" and got[3]["reason"] == "no_comparable_axis_history"
    assert got[7]["residual"] == pytest.approx(abs(math.log(8) - math.log(np.median([2, 3, 5, 6, 7]))))


def test_depth_maps_are_not_broadcast(spark):
    """A grid made by explode looks as small as its frames: its joins shuffle. Jumps against the prevailing direction count in one pass."""
    from tessella.operators import evidence3d

    axis = F.sequence(F.lit(0), F.lit(9))
    depth = spark.range(3).select(F.col("id").alias("k"), F.explode(axis).alias("row")).select("k", "row", F.explode(axis).alias("col")).withColumn("z", F.when(F.col("col") == 5, 3.0 - 2.0 * F.col("k")).otherwise(2.0))
    pairs = spark.createDataFrame([(k, r, 4, r, 5) for k in range(2) for r in range(4)] + [(0, 9, 5, 9, 4), (2, 0, 5, 0, 4)], "k long, row int, col int, outer_row int, outer_col int")
    out = evidence3d.boundary_depth(pairs, depth, ["k"], ["k"])
    got = {r["k"]: (r["pairs"], r["valid_pairs"], r["residual"], r["aligned"], r["direction"]) for r in out.collect()}
    assert got == {0: (5, 5, 0.2, 1.0, 1.0), 1: (4, 4, 0.0, 1.0, -1.0), 2: (1, 0, None, None, None)}
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_classes_of_equal_content_all_pair(spark):
    """Equal contents with other metadata pair with each other, not only with the first; further copies pair with their class. Nothing is broadcast."""
    h = [1, 2, 3, 4, 5]
    items = [(1, "x", h, 9.0, 2, 3, 0.5, "g", "train"), (2, "x", h, 9.0, 4, 3, 0.5, "g", "train"), (3, "x", h, 9.0, 5, 3, 0.5, "g", "test"), (4, "x", h, 9.0, 5, 3, 0.5, "q", "test")]
    items += [(5, "y", None, 1.0, 2, 3, 0.5, "g", "train"), (6, "y", None, 1.0, 4, 3, 0.5, "g", "train"), (7, "z", h, 9.0, 2, 3, 0.5, "g", "test"), (8, None, None, 0.0, 2, 3, 0.5, "g", "test"), (9, None, None, 0.0, 2, 3, 0.5, "g", "test")]
    out = governance.media_duplicates(spark.createDataFrame(items, "item_id long, content_hash string, hashes array<long>, duration double, width int, height int, rate double, group_id string, split string"))
    got = {(r["a"], r["b"]): (r["exact"], r["review_required"]) for r in out.collect()}
    assert got == {(1, 2): (True, False), (1, 3): (True, True), (2, 3): (True, True), (3, 4): (True, True), (5, 6): (True, False), (1, 7): (False, True)}
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key_rows, group_rows, company", [(8192, 1 << 16, 1 << 17), (7, 50, 1 << 17), (16, 300, 0)])
def test_vectors_of_hashes_meet_once(spark, monkeypatch, key_rows, group_rows, company):
    """Round 4, F3: classes of equal hashes meet as one vector; keys dealt in blocks and of more blocks bring all close pairs, each once."""
    monkeypatch.setattr(governance, "KEY_ROWS", key_rows)
    monkeypatch.setattr(governance, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(governance, "COMPANY", company)
    monkeypatch.setattr(governance, "CLASS_ROWS", 9)
    rng = random.Random(5)
    centres = [[rng.getrandbits(64) for _ in range(5)] for _ in range(3)]
    vectors = []
    for i in range(90):  # flips from none to well beyond the bound, in one sample or all
        h = list(centres[i % 3])
        for _ in range(rng.choice([0, 3, 8, 17, 20, 40])):
            k = rng.randrange(5) if i % 2 else 1
            h[k] ^= 1 << rng.randrange(64)
        vectors.append(h)
    signed = lambda h: [x - (1 << 64) if x >> 63 else x for x in h]
    items = [(i, f"c{i}", signed(vectors[i % 90]), 9.0 + i % 4, 2 + (i % 45 == 44), 3, 0.5, "g", "train") for i in range(180)] + [(180 + i, f"d{i}", signed(vectors[0]), 9.0, None, 3, 0.5, "g", "train") for i in range(3)]
    met, real = [], governance.hash_candidates
    monkeypatch.setattr(governance, "hash_candidates", lambda v, *a: (met.append(v.count()), real(v, *a))[1])
    out = governance.media_duplicates(spark.createDataFrame(items, "item_id long, content_hash string, hashes array<long>, duration double, width int, height int, rate double, group_id string, split string"))
    want = {}
    for a in items:
        for b in items:
            if a[0] < b[0] and a[4] == b[4] and a[4] is not None:
                apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[2], b[2], strict=True))
                score = 0.75 * (1 - apart / 320) + 0.25 * (1 - abs(a[3] - b[3]) / max(a[3], b[3]) + 2) / 3
                if score >= 0.92:
                    want[a[0], b[0]] = round(score, 9)
    got = [(r["a"], r["b"], round(r["score"], 9)) for r in out.collect()]
    assert {r[:2]: r[2] for r in got} == want and len(got) == len(want) > 900
    assert met[0] == len({(tuple(i[2]), i[4]) for i in items if i[4] is not None})


def test_only_frames_where_boxes_compete_are_assigned(monkeypatch):
    """Lone continuations need no assignment, costs come for many frames at once, and pieces of any size give the same tracks."""
    import pandas as pd

    rng = np.random.default_rng(5)
    lone = pd.DataFrame([(f, b, "a", 60.0 * b + f % 3, 0.0, 60.0 * b + f % 3 + 20, 10.0) for f in range(500) for b in range(3)], columns=["frame_index", "box_id", "label", "x1", "y1", "x2", "y2"])
    x, y = rng.integers(0, 9, 400) * 4.0, rng.integers(0, 6, 400) * 4.0
    crowd = pd.DataFrame({"frame_index": np.sort(rng.integers(0, 60, 400)), "box_id": range(400), "label": rng.choice(["a", "b"], 400), "x1": x, "y1": y, "x2": x + 16, "y2": y + rng.integers(1, 3, 400) * 8.0})
    calls, assign = [], sequential.assign
    monkeypatch.setattr(sequential, "assign", lambda cost: calls.append(1) or assign(cost))
    run = lambda d: sequential.carry_tracks(d.assign(width=160.0, height=90.0), 0, np.zeros(0, np.int64), 0, 2)
    track, before, following = run(lone)
    assert following == 3 and not calls and (track == lone["box_id"]).all() and (before == np.r_[[-1] * 3, np.arange(1497)]).all()
    whole = run(crowd)
    assert calls
    monkeypatch.setattr(sequential, "PAIRS", 16)
    assert all(np.array_equal(a, b) for a, b in zip(run(crowd), whole, strict=True))
