"""Configuration, cache, outputs, streams and single-frame operators."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import gates, lineage, pooling, sequential, static
from tessella.sources import archives, cache, config, manifest, outputs, records
from tessella.streaming import tracks
from tessella.streaming import windows as streaming


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("paths:\n  root: ${ROOT}/x\nlist:\n  - ${ROOT}\n")
    got = config.load(str(tmp_path / "c.yaml"), ("paths",), {"ROOT": "/d"})
    assert got == {"paths": {"root": "/d/x"}, "list": ["/d"]}
    with pytest.raises(KeyError):
        config.load(str(tmp_path / "c.yaml"), (), {})
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.yaml"), ("missing",), {"ROOT": "/d"})


def test_cache_builds_once_and_again_after_a_broken_write(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    args = (spark, str(tmp_path), "stage", {"a": 1, "b": [2]})
    assert cache.cached(*args, build).count() == cache.cached(*args, build).count() == 3 and len(calls) == 1
    (tmp_path / "stage" / cache.key_of("stage", {"b": [2], "a": 1}) / "_SUCCESS").unlink()
    assert cache.cached(*args, build).count() == 3 and len(calls) == 2
    assert cache.cached(spark, str(tmp_path), "stage", {"a": 2}, build).count() == 3 and len(calls) == 3


def test_outputs(spark, tmp_path):
    clips = spark.createDataFrame([("v", "c1", 0.5, 1.0, 0.9), ("v", "c0", None, 0.0, 0.0)], "video_id string, clip_id string, risk_score double, coverage double, confidence double")
    videos = spark.createDataFrame([("v", float("nan"))], "video_id string, risk_score double")
    scores = lambda k: spark.createDataFrame([("v", "x", 0.1)], f"video_id string, {k} string, score double")
    outputs.write_analysis(str(tmp_path / "out"), clips, videos, videos, scores("object_id"), scores("track_id"))
    assert spark.read.json(str(tmp_path / "out" / "result")).where("risk_score IS NULL").count() == 1 or "risk_score" not in spark.read.json(str(tmp_path / "out" / "result")).columns
    assert [r["clip_id"] for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "timeline")).collect()] == ["c0", "c1"]


def test_array_rows(spark):
    got = outputs.array_rows(spark.createDataFrame([(1, [1.0, None]), (2, None)], "k long, a array<double>"), "k", "a").orderBy("k").collect()
    raw = np.array([1.0, np.nan], "<f8").tobytes()
    assert got[0]["length"] == 2 and bytes(got[0]["payload"]) == raw and got[0]["sha256"] == hashlib.sha256(raw).hexdigest() and got[1]["payload"] is None


def test_records_by_suffix(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    for name in ("a.jsonl", "a.json", "a.csv"):
        assert sorted(r["x"] for r in records.read_records(spark, str(tmp_path / name), "x long").collect()) == [1, 2]


def test_scan_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.MP4").write_bytes(b"one")
    (tmp_path / "d" / "b.txt").write_bytes(b"two")
    (got,) = records.scan_files(spark, str(tmp_path)).collect()
    assert got["sha256"] == hashlib.sha256(b"one").hexdigest() and got["length"] == 3


def test_stream_deduplicates_and_resumes(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:01:00")], "event_id long, t string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    rows.coalesce(1).write.parquet(src)
    stream = lambda: streaming.deduplicate(spark.readStream.schema(rows.schema).parquet(src), ["event_id"]).select("event_id")
    args = (str(tmp_path / "out"), str(tmp_path / "state"))
    assert streaming.run_once(spark, stream(), *args).count() == 2
    rows.coalesce(1).write.mode("append").parquet(src)
    assert streaming.run_once(spark, stream(), *args).count() == 2


def test_scale_router_prunes_before_pairs(spark):
    o = spark.createDataFrame([("a", 1.0, None), ("b", None, 2.0), ("c", None, None), ("d", None, None)], "k string, metric double, temporal double")
    p = spark.createDataFrame([("a", 9.0, 0), ("c", None, 0), ("c", 5.0, 1)], "k string, value double, ord int")
    got = {r["k"]: (r["branch"], r["scale"], r["audited"]) for r in gates.route_scale(o, p, "k").collect()}
    assert got == {"a": ("metric", 1.0, False), "b": ("temporal", 2.0, False), "c": ("pair", 5.0, False), "d": ("none", None, False)}
    assert {r["k"]: r["audited"] for r in gates.route_scale(o, p, "k", "always").collect()}["a"]
    assert gates.route_scale(o, p, "k", "disabled").where("branch = 'pair'").count() == 0
    with pytest.raises(ValueError):
        gates.route_scale(o, p, "k", "sometimes")


def test_strict_and_lenient(spark):
    df = spark.createDataFrame([("k", 1.0, 0.5, True, "", 0), ("k", None, 0.0, False, "blocked", 1)], "k string, value double, quality double, valid boolean, reason string, ord int")
    assert pooling.strict_aggregate(df, ["k"]).first()["reason"] == "blocked"
    assert pooling.strict_aggregate(df, ["k"], require_all=False).first()["value"] == 1.0


def test_closure_finds_a_cycle(spark):
    with pytest.raises(ValueError):
        lineage.closure(spark.createDataFrame([("a", "b"), ("b", "c")], "stage string, needs string"), rounds=1)


def test_greedy_match(spark):
    df = spark.createDataFrame([("f", 1, 1, 0.9), ("f", 1, 2, 0.8), ("f", 2, 1, 0.85), ("f", 2, 2, 0.1)], "f string, object_id int, candidate_id int, score double")
    assert [(r["object_id"], r["candidate_id"]) for r in static.greedy_match(df, "f").collect()] == [(1, 1)]


def test_holdout_prefers_the_simple_model(spark):
    rows = [("s", i, float(i), i + 2.0) for i in range(40)] + [("l", i, float(i + 1), 3.0 * (i + 1) + 5) for i in range(40)] + [("n", i, float(i), 0.0) for i in range(5)]
    got = {r["pair_id"]: r["model"] for r in static.align_with_holdout(spark.createDataFrame(rows, "pair_id string, ord int, source double, target double")).collect()}
    assert got == {"s": "shift", "l": "line", "n": "none"}


def test_missing_policy(spark):
    audit = spark.createDataFrame([("a", "eligible"), ("b", "no_valid_residual")], "sample_id string, status string")
    assert static.apply_missing_policy(audit).count() == 1 and static.apply_missing_policy(audit, "keep_empty").count() == 2
    with pytest.raises(ValueError):
        static.apply_missing_policy(audit, "error")


def test_config_checks_windows_and_resolves_paths(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("video:\n  clip_length: 8\n  clip_stride: 4\npaths:\n  data: sub/x\n  remote: s3://b/x\nprice: 5$ and $HOME\n")
    got = config.load(str(path), (), {})
    assert got["paths"] == {"data": str(tmp_path / "sub/x"), "remote": "s3://b/x"} and got["price"] == "5$ and $HOME"
    for bad in ("clip_length: 1", "clip_stride: 0"):
        path.write_text(f"video:\n  {bad}\n")
        with pytest.raises(ValueError):
            config.load(str(path), (), {})


def test_cache_notices_changed_files(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).coalesce(1)

    args = (spark, str(tmp_path), "stage", {"a": 1}, build, True)
    assert cache.cached(*args).count() == cache.cached(*args).count() == 5 and len(calls) == 1
    folder = tmp_path / "stage" / cache.key_of("stage", {"a": 1})
    part = next(folder.glob("part-*"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "other"))
    part.write_bytes(next((tmp_path / "other").glob("part-*")).read_bytes())
    (folder / f".{part.name}.crc").unlink(missing_ok=True)
    assert cache.cached(*args).count() == 5 and len(calls) == 2


def test_axis_registry():
    good = {"schema_version": "paper_core_canonical_axis_v1", "unit_system": "meter", "frozen_before_real_video_run": True, "post_result_threshold_tuning": False, "authenticity_label_used": False, "universal_fallback": False}
    limits = {k: 0.5 for k in manifest.AXIS_THRESHOLDS} | {"robust_projection_low_quantile": 0.05, "truncation_threshold": 0.0, "bottle_point_support_min": 20}
    assert manifest.axis_registry(good | {"thresholds": limits})["bottle_point_support_min"] == 20.0
    for change in ({"unit_system": "foot"}, {"universal_fallback": True}, {"frozen_before_real_video_run": 1}, {"thresholds": limits | {"x": 1}}, {"thresholds": limits | {"occlusion_threshold": 1.5}}, {"thresholds": limits | {"bottle_extent_ratio_min": 0}}, {"thresholds": limits | {"robust_projection_low_quantile": 0.6}}):
        with pytest.raises(ValueError):
            manifest.axis_registry({"thresholds": limits} | good | change)


def test_prior_registry_must_be_right(spark):
    sources = spark.createDataFrame([("d1", "approved"), ("d2", "draft")], "derivation_id string, review_status string")
    entry = {"entry_id": "e", "class_name": "car", "aliases": ["auto"], "supported_dimension": "length", "min_m": 1, "max_m": 2, "derivation_id": "d1"}
    assert {r["label"] for r in manifest.prior_registry(spark, [entry], sources).collect()} == {"car", "auto"}
    for bad in ([entry, entry | {"entry_id": "f", "class_name": "auto", "aliases": []}], [entry | {"derivation_id": "d2"}], [entry | {"min_m": 3}]):
        with pytest.raises(ValueError):
            manifest.prior_registry(spark, bad, sources)


def test_pose_graph_takes_near_then_good_edges(spark):
    """Against the rule, applied by search over all edges."""
    rng = np.random.default_rng(2)
    edges = [("v", i, i + g, float(rng.integers(0, 100)) / 100) for i in range(14) for g in (1, 2, 4)]
    best, parent = {0: 2.0}, {0: -1}
    usable = [(a, b, q) for _, s, t, q in edges if q >= 0.2 for a, b in ((s, t), (t, s))]
    while options := [(abs(a - b), -q, a, b) for a, b, q in usable if a in best and b not in best]:
        _, q, a, b = min(options)
        best[b], parent[b] = min(best[a], -q), a
    got = {r["frame_index"]: (r["parent"], r["quality"]) for r in lineage.pose_graph(spark.createDataFrame(edges, "video_id string, source long, target long, quality double")).collect()}
    for f, (p, q) in got.items():
        assert p == parent.get(f) and (q is None if f not in best else q == pytest.approx(min(best[f], 1.0)))


def test_endpoint_chains(spark):
    """Against all pairs of neighbouring frames."""
    rng = np.random.default_rng(4)
    rows = [("v", f, *(float(x) for x in rng.uniform(0, 12, 2)), *(float(x) for x in rng.uniform(0, 12, 2))) for f in range(6) for _ in range(25)]
    got = {(r["frame_index"], r["u0"], r["v0"]): r["chain"] for r in lineage.link_endpoints(spark.createDataFrame(rows, "video_id string, frame_index int, u0 double, v0 double, u1 double, v1 double")).collect()}
    want, ends, number = {}, {}, 0
    for f in range(6):
        frame = sorted(r for r in rows if r[1] == f)
        near = sorted((float(np.hypot(r[2] - e[0], r[3] - e[1])), i, k) for i, r in enumerate(frame) for k, e in ends.items())
        chain, used = {}, set()
        for d, i, k in near:
            if d <= 2.0 and i not in chain and k not in used:
                chain[i] = k
                used.add(k)
        ends = {}
        for i, r in enumerate(frame):
            if i not in chain:
                chain[i], number = number, number + 1
            want[r[1], r[2], r[3]] = chain[i]
            ends[chain[i]] = (r[4], r[5])
    assert got == want


def test_endpoint_chains_side_by_side(spark, monkeypatch):
    """many videos in one batch, cut anywhere, give what each gives alone; starts at the same place and frames without any."""
    monkeypatch.setattr(lineage, "TOGETHER", 40)
    rng = np.random.default_rng(8)
    rows = [(f"v{v}", f * (1 + v % 2), *(float(x) for x in rng.integers(0, 12, 2)), *(float(x) for x in rng.integers(-2, 14, 2))) for v in range(7) for f in range(v + 1) for _ in range(12)]
    rows = list({r[:4]: r for r in rows}.values())
    kinds = "video_id string, frame_index int, u0 double, v0 double, u1 double, v1 double"
    got = {tuple(r)[:4]: r["chain"] for r in lineage.link_endpoints(spark.createDataFrame(rows, kinds)).collect()}
    want = {}
    for v in {r[0] for r in rows}:
        ends, number = {}, 0
        for f in sorted({r[1] for r in rows if r[0] == v}):
            frame = sorted(r for r in rows if r[:2] == (v, f))
            chain = {}
            for d, i, k in sorted((float(np.hypot(r[2] - e[0], r[3] - e[1])), i, k) for i, r in enumerate(frame) for k, e in ends.items()):
                if d <= 2.0 and i not in chain and k not in chain.values():
                    chain[i] = k
            ends = {}
            for i, r in enumerate(frame):
                if i not in chain:
                    chain[i], number = number, number + 1
                want[r[:4]] = chain[i]
                ends[chain[i]] = r[4:]
    assert got == want


def test_curves_in_ranges(spark, monkeypatch):
    """Two levels of running sums give what one gives."""
    from tessella.operators import metrics

    rng = np.random.default_rng(6)
    rows = [("a", float(s), int(y)) for s, y in zip(rng.random(400).round(2), rng.integers(0, 2, 400), strict=True)] + [(None, 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    want = sorted((r["g"] or "", r["threshold"] or -1.0, r["tp"], r["fp"], r["tn"], r["fn"]) for r in metrics.roc_curve(df, ["g"]).collect())
    for t in {r[1] for r in want if r[1] >= 0}:
        hit = [r for r in rows if r[0] == "a" and r[1] >= t]
        assert ("a", t, sum(r[2] for r in hit), sum(1 - r[2] for r in hit)) in {r[:4] for r in want} or t not in {r[1] for r in rows if r[0] == "a"}
    monkeypatch.setattr(metrics, "RANGES", 3)
    assert sorted((r["g"] or "", r["threshold"] or -1.0, r["tp"], r["fp"], r["tn"], r["fn"]) for r in metrics.roc_curve(df, ["g"]).collect()) == want


BOXES = "video_id long, frame_index long, box_id long, label string, x1 double, y1 double, x2 double, y2 double, width double, height double"


def test_stream_of_tracks_is_the_batch_operator(spark, tmp_path):
    """Boxes out of order in micro-batches, one restart in between: the tracks are the batch operator's, and every track ends once."""
    rng = random.Random(3)
    rows = []
    for v in range(4):
        for f in range(30):
            for b in range(rng.randrange(0, 4)):
                x, y = rng.randrange(100) + f / 3, rng.randrange(50)
                rows.append((v, f, b, rng.choice("ab"), float(x), float(y), float(x + rng.randrange(5, 40)), float(y + rng.randrange(5, 30)), 160.0, 90.0))
    files: dict[int, list] = {}
    for r in rows:
        files.setdefault((r[1] + rng.randrange(4)) // 8, []).append(r)
    source = str(tmp_path / "source")
    feed = lambda part: spark.createDataFrame(part, BOXES).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(BOXES).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda build, name: streaming.run_once(spark, build(stream(), 12), str(tmp_path / name), str(tmp_path / f"{name}-state"))
    tracks.rocks(spark)
    keys = sorted(files)
    for k in keys[:2]:
        feed(files[k])
    run(tracks.track_boxes, "boxes")
    for k in keys[2:]:
        feed(files[k])
    feed([(-1, 10**6, 0, "end", 0.0, 0.0, 1.0, 1.0, 160.0, 90.0)])  # moves the watermark past all
    got = {(r["video_id"], r["frame_index"], r["box_id"]): r["track"] for r in run(tracks.track_boxes, "boxes").where("video_id >= 0").collect()}
    want = {(r["video_id"], r["frame_index"], r["box_id"]): r["track"] for r in sequential.associate(spark.createDataFrame(rows, BOXES)).collect()}
    assert got == want
    spans: dict[tuple, list] = {}
    for (v, f, _), t in want.items():
        spans.setdefault((v, t), []).append(f)
    ended = sorted(tuple(r) for r in run(tracks.track_spans, "spans").where("video_id >= 0").collect())
    assert ended == sorted((v, t, min(x), max(x), len(x)) for (v, t), x in spans.items())


def test_zip_directories(spark, tmp_path):
    """Members, sizes and checksums as zipfile gives them, Zip64 and comments included; faults are rows with a reason."""
    import zipfile

    paths, want = [], {}
    for k in range(4):
        path = tmp_path / f"{k}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED) as z:
            for i in range((0, 3, 700, 20)[k]):
                if k == 3 and i % 5 == 0:
                    with z.open(f"d/{i} é.txt", "w", force_zip64=True) as f:
                        f.write(b"x" * i)
                else:
                    z.writestr(f"d/{i} é.txt" if i % 3 else f"dir{i}/", b"" if i % 3 == 0 else b"text %d" % i * i)
        want[f"file://{path}"] = [(i.filename, i.is_dir(), i.file_size, i.compress_size, i.CRC, i.compress_type, i.header_offset) for i in zipfile.ZipFile(path).infolist()]
        paths.append(f"file://{path}")
    whole = (tmp_path / "2.zip").read_bytes()
    # An archive whose end record points to 64-bit values.
    small = (tmp_path / "1.zip").read_bytes()
    at = small.rfind(b"PK\x05\x06")
    note = b"PK\x05\x06 in a comment"
    count, size, offset = struct.unpack_from("<HLL", small, at + 10)
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, offset)
    big = small[:at] + end64 + struct.pack("<4sLQL", b"PK\x06\x07", 0, at, 1) + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    bad = {"big.zip": (big, None), "note.zip": (small[:-2] + struct.pack("<H", len(note)) + note, None), "cut.zip": (whole[: len(whole) // 2], "end_record_missing"), "text.zip": (b"plain", "not_a_zip_archive"), "mixed.zip": (whole.replace(b"PK\x01\x02", b"PK\x01\x03"), "unexpected_directory_signature")}
    for name, (content, _) in bad.items():
        (tmp_path / name).write_bytes(content)
        paths.append(f"file://{tmp_path / name}")
    paths.append(f"file://{tmp_path}/none.zip")
    spark.dataSource.register(archives.ZipDirectory)
    df = spark.read.format("zip_directory").option("paths", "\n".join(paths)).load()
    assert df.rdd.getNumPartitions() == len(paths)
    got = {}
    for r in df.collect():
        got.setdefault(r["archive"], []).append(r)
    for path, members in want.items():
        assert [(r["member"], r["directory"], r["size"], r["compressed_size"], r["crc32"], r["method"], r["header_offset"]) for r in sorted(got.get(path, []), key=lambda r: r["position"])] == members
    for name, (_, reason) in bad.items():
        rows = got[f"file://{tmp_path / name}"]
        assert reason is None and [r["member"] for r in rows] == [m[0] for m in want[paths[1]]] or [r["reason"] for r in rows] == [reason]
    assert [r["reason"] for r in got[paths[-1]]] == ["archive_unavailable"]


def _registry(**changes):
    entry = {"entry_id": "e", "class_name": "cup", "aliases": ["mug"], "supported_dimension": "height", "dimension_definition": "d", "applicable_scope": "a", "excluded_scope": "x", "min_m": 0.1, "max_m": 0.2, "confidence": "low", "derivation_id": "s"}
    return {"schema_version": "paper_core_scale_priors_v1", "unit": "meter", "priors": [entry | changes], "unsupported_classes": [{"class_name": "thing", "reason": manifest.TOO_BROAD}]}


def _sources(spark, **changes):
    row = {f: "stated" for f in manifest.SOURCE_FIELDS} | {"derivation_id": "s", "sample_count": "3", "review_status": manifest.APPROVED} | changes
    return spark.createDataFrame([tuple(row[f] for f in manifest.SOURCE_FIELDS)], ", ".join(f"{f} string" for f in manifest.SOURCE_FIELDS))


def test_formal_registry(spark):
    got = {r["label"]: r for r in manifest.formal_registry(spark, _registry(), _sources(spark)).collect()}
    assert set(got) == {"cup", "mug", "thing"} and got["mug"]["category"] == "cup" and got["mug"]["min_m"] == 0.1 and got["thing"]["unsupported"] == manifest.TOO_BROAD


@pytest.mark.parametrize(
    "changes", [{"entry_id": ""}, {"derivation_id": "t"}, {"supported_dimension": "depth"}, {"min_m": 0.0}, {"max_m": float("inf")}, {"min_m": float("nan")}, {"confidence": "sure"}, {"excluded_scope": ""}, {"aliases": ["cup"]}, {"aliases": [" mug"]}, {"aliases": ["thing"]}, {"class_name": None}]
)
def test_formal_registry_rejects_entries(spark, changes):
    with pytest.raises(ValueError):
        manifest.formal_registry(spark, _registry(**changes), _sources(spark))


@pytest.mark.parametrize("changes", [{"review_status": "approved"}, {"sample_count": "0"}, {"sample_count": "many"}, {"publisher": " "}, {"publisher": None}, {"derivation_id": ""}])
def test_formal_registry_rejects_sources(spark, changes):
    with pytest.raises(ValueError):
        manifest.formal_registry(spark, _registry(), _sources(spark, **changes))


def test_formal_registry_rejects_schemas(spark):
    for changes in ({"unit": "cm"}, {"schema_version": "v2"}, {"unsupported_classes": [{"class_name": "thing", "reason": "because"}]}, {"unsupported_classes": [{"class_name": "mug", "reason": manifest.TOO_BROAD}]}):
        with pytest.raises(ValueError):
            manifest.formal_registry(spark, _registry() | changes, _sources(spark))
    with pytest.raises(ValueError):
        manifest.formal_registry(spark, _registry(), _sources(spark).drop("publisher"))
    with pytest.raises(ValueError):
        manifest.formal_registry(spark, _registry(), _sources(spark).unionByName(_sources(spark)))


def test_training_manifest_policies(spark):
    schema = "sample_id string, dataset_name string, source_video_id string, group_id string, split string, label int, source_commit string, source_config_sha256 string, authenticity_label_used boolean, historical_csv_read boolean, m6_to_a2_bridge_called boolean"
    fine = [("a", "d", "v1", "g1", "train", 1, "c", "k", False, None, False), ("b", "d", "v2", "g2", "validation", 0, "", None, False, False, False), ("c", "d", "v3", "g3", "train", 0, "c", "k", False, False, False)]
    rows = spark.createDataFrame(fine, schema)
    audit = spark.createDataFrame([("a", "train", "eligible"), ("b", "validation", "partial_missing"), ("c", "train", "no_valid_residual")], "sample_id string, split string, status string")
    faults = lambda r, a, **how: {x["rule"]: (x["rows"], x["example"]) for x in manifest.training_faults(r, a, "c", "k", **how).collect()}
    assert faults(rows, audit) == {"no_valid_residual": (1, "c")} and faults(rows, audit, policy="exclude") == {}
    load = lambda **how: sorted((r["sample_id"], r["empty"]) for r in manifest.training_rows(rows, audit, **how).collect())
    assert load() == [("a", False), ("b", False)] and load(policy="keep_empty") == [("a", False), ("b", False), ("c", True)] and load(load_splits=("validation",)) == [("b", False)]
    bad = rows.unionByName(spark.createDataFrame([("a", "d", "v1", "g1", "train", 2, "x", "y", True, False, False), (" ", "d", "v", "g", "other", 1, "c", "k", False, False, False)], schema))
    assert faults(bad, audit.where("sample_id <> 'b'"), policy="exclude") == {"unsupported_split": (1, " "), "empty_identity": (1, " "), "label_not_binary": (1, "a"), "other_source_commit": (1, "a"), "other_source_config": (1, "a"), "forbidden_input": (1, "a"), "repeated_sample": (1, "a"), "empty_train_or_validation": (1, None)}
    for how in ({"policy": "drop"}, {"load_splits": ("dev",)}):
        with pytest.raises(ValueError):
            manifest.training_rows(rows, audit, **how)


def test_a_video_takes_few_calls_of_its_state():
    """Calls of the state store and timers don't grow with a video's boxes; a box that comes twice counts once."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                if name in ("get", "exists"):
                    return list(self.held)
                self.held = {"appendList": lambda: self.held + list(a[0]), "put": lambda: list(a[0]), "update": lambda: list(a[0]), "clear": list}[name]()

            return call

    class Handle:
        def getListState(self, *a):
            return State()

        getValueState = getMapState = getListState

        def registerTimer(self, ms):
            calls.append("timer")

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    rows = [(f, b, "a", 60.0 * b, 0.0, 60.0 * b + 20, 10.0, 160.0, 90.0, (f + 1) * 1000) for f in range(200) for b in range(3)]
    frame = pd.DataFrame(rows + rows[:5], columns=["frame_index", "box_id", *tracks.BOX, "ms"])
    p = tracks._Association(2, False)
    p.init(Handle())
    assert not list(p.handleInputRows((1,), iter([frame]), Now(0)))
    out = [*p.handleExpiredTimer((1,), Now(100_000), None), *p.handleExpiredTimer((1,), Now(10**9), None)]
    got = pd.concat(out)
    assert len(got) == 600 and (got["track"] == got["box_id"]).all()
    assert len(calls) < 20


@pytest.mark.parametrize("spans", [True, False])
def test_videos_of_a_bucket_share_calls(spans):
    """Round 4, F1 and F2: a bucket's calls of its state don't grow with its videos, each of which has the batch operator's tracks (one has no id)."""
    import pandas as pd

    calls, states = [], []

    class State:
        held = None

        def __init__(self, *a):
            states.append(self)

        def get(self):
            calls.append("get")
            return self.held or []

        def put(self, x):
            calls.append("put")
            self.held = list(x)

        def appendList(self, x):
            self.put([*(self.held or []), *x])

        def update(self, x):
            calls.append("update")
            self.held = x

        def clear(self):
            self.held = None

    class Handle:
        getListState = getValueState = State

        def registerTimer(self, ms):
            calls.append("timer")

    class Now:
        def __init__(self, frame):
            self.ms = (frame + 1) * 1000

        def getCurrentWatermarkInMs(self):
            return self.ms

    rng, rows = random.Random(8), []
    for v in [None, *map(str, range(40))]:
        for f in sorted(rng.sample(range(60), 25)):
            for b in range(rng.randrange(1, 4)):
                x, y = rng.randrange(60) + f / 3, rng.randrange(40)
                rows.append((v, f, b, rng.choice("ab"), float(x), float(y), float(x + rng.randrange(5, 40)), float(y + rng.randrange(5, 30)), 160.0, 90.0, (f + 1) * 1000))
    want = {}
    for v in {r[0] for r in rows}:
        one = pd.DataFrame(sorted(r[1:] for r in rows if r[0] == v), columns=["frame_index", "box_id", *tracks.BOX, "ms"])
        track, _, _ = sequential.carry_tracks(one, 0, np.zeros(0, np.int64), 0, 2)
        want |= {(v, f, b): int(t) for f, b, t in zip(one["frame_index"], one["box_id"], track, strict=True)}
    rng.shuffle(rows)
    p, out = tracks._Association(2, spans), []
    p.init(Handle())
    for lo, hi in ((0, 20), (20, 40), (40, 60)):
        some = pd.DataFrame([r for r in rows if lo <= r[1] < hi], columns=["video_id", "frame_index", "box_id", *tracks.BOX, "ms"])
        out += [*p.handleInputRows((7,), iter([some[:100], some[100:]]), Now(lo - 9)), *p.handleExpiredTimer((7,), Now(hi - 9), None)]
    out += p.handleExpiredTimer((7,), Now(10**6), None)
    name = lambda v: None if pd.isna(v) else v
    got = pd.concat(out)
    if spans:
        ends: dict[tuple, list] = {}
        for (v, f, _), t in want.items():
            ends.setdefault((v, t), []).append(f)
        assert sorted((str(name(r[0])), *map(int, r[1:])) for r in got[["video_id", "track", "first_frame", "last_frame", "boxes"]].itertuples(index=False)) == sorted((str(v), t, min(x), max(x), len(x)) for (v, t), x in ends.items())
    else:
        assert {(name(r[0]), r[1], r[2]): r[3] for r in got[["video_id", "frame_index", "box_id", "track"]].itertuples(index=False)} == want and len(got) == len(rows)
    assert len(states) == 3 and len(calls) < 60


def test_observations_are_written_small(spark, tmp_path):
    """Documents go to compressed files and come back whole."""
    rows = spark.range(3000).selectExpr("concat('c', id DIV 30) AS clip_id", "'v' AS video_id", "id % 5 AS frame_index", "1280 AS width", "720 AS height", "cast(id AS string) AS object_id", "'a' AS label", "1.0D AS mask_area", "2.0D AS frame_area", "3.0D AS depth", "0.9D AS confidence", "array(0.0D, 0.0D, 1.0D, 1.0D) AS bbox")
    path = tmp_path / "observations"
    records.write_observations(rows, str(path))
    back = records.read_observations(spark, str(path)).where("_corrupt_record IS NULL").selectExpr("explode(frames) AS f").selectExpr("explode(f.objects) AS o")
    assert {r["object_id"] for r in back.select("o.object_id").collect()} == {str(i) for i in range(3000)}
    assert sum(f.stat().st_size for f in path.rglob("part-*")) < 60 * 3000


def test_archives_are_streamed(spark, tmp_path, monkeypatch):
    """texts pass into their archives in batches of any size; no archive's texts are one group in Python."""
    from pyspark.sql import GroupedData

    from tessella.plans import source_queries

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(90)] + [(90, None), (91, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 2)
    try:
        got = {r["doc_id"]: (r["size"], r["crc_equal"], r["reason"]) for r in source_queries.zip_directory(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(key)
    assert got == {i: (len(f"text {i} ") * (i % 7), True, "") for i in range(90)} | {91: (0, True, "")}
