"""Queries over the experiment protocol: leakage findings, task eligibility, strict leakage and formal priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import governance, protocol, sampling
from tessella.sources import manifest

from .adapters import EV, RE, evidence, records, table
from .registry import query

_SPLIT = "CASE WHEN group_id % 97 = 0 THEN 'official_conflict' ELSE split END"
FINDINGS = RE + f""", a AS (SELECT sample_id AS video_id, group_id, {_SPLIT} AS split, content_hash FROM re),
 d AS (SELECT f.video_id AS a, o.video_id AS b, f.split AS sa, o.split AS sb, true AS exact, 1.0::DOUBLE AS score FROM (SELECT content_hash, min(video_id) AS f FROM a GROUP BY ALL) h JOIN a f ON f.video_id = h.f JOIN a o ON o.content_hash = h.content_hash AND o.video_id <> h.f
  UNION ALL SELECT x.video_id, y.video_id, x.split, y.split, false, (x.video_id * 7 % 100) / 100.0::DOUBLE FROM a x JOIN a y ON y.video_id = x.video_id + 1),
 g AS (SELECT group_id, min(video_id) AS v, string_agg(DISTINCT split, ';' ORDER BY split) AS s FROM a GROUP BY group_id HAVING count(DISTINCT split) > 1),
 f AS (SELECT 'source_group_cross_split' AS conflict_type, v::VARCHAR AS video_id_a, '' AS video_id_b, group_id::VARCHAR AS source_group_id, s AS split_a, '' AS split_b, 'one source group spans multiple splits' AS details FROM g
  UNION ALL SELECT CASE WHEN exact THEN 'exact_duplicate_cross_split' ELSE 'near_duplicate_cross_split' END, a::VARCHAR, b::VARCHAR, '', sa, sb, format('near_duplicate_score={{:.6f}}', score) FROM d WHERE sa <> sb AND (exact OR score >= 0.92)
  UNION ALL SELECT 'official_split_source_group_conflict', video_id::VARCHAR, '', group_id::VARCHAR, split, '', 'official split conflict was preserved for review' FROM a WHERE split = 'official_conflict'
  UNION ALL SELECT 'test_used_for_threshold_tuning', '', '', '', 'test', '', 'test cannot tune thresholds')
"""


def _protocol(spark, sf):
    c = F.col
    rows = records(spark, sf).select(c("sample_id").alias("video_id"), c("group_id").alias("source_group_id"), F.expr(_SPLIT).alias("split"), "content_hash", (c("group_id") % 5 == 0).alias("review_required"))
    first = rows.groupBy("content_hash").agg(F.min(F.struct("video_id", "split")).alias("f"))
    exact = rows.join(first, "content_hash").where("video_id <> f.video_id").select(c("f.video_id").alias("video_id_a"), c("video_id").alias("video_id_b"), F.lit(True).alias("exact_duplicate"), F.lit(1.0).alias("near_duplicate_score"), (c("f.split") != c("split")).alias("split_conflict"))
    other = rows.select((c("video_id") - 1).alias("video_id_a"), c("video_id").alias("video_id_b"), c("split").alias("_s"))
    near = other.join(rows.select(c("video_id").alias("video_id_a"), "split"), "video_id_a").select("video_id_a", "video_id_b", F.lit(False).alias("exact_duplicate"), (c("video_id_a") * 7 % 100 / 100.0).alias("near_duplicate_score"), (c("split") != c("_s")).alias("split_conflict"))
    return rows, protocol.leakage_findings(rows, rows, exact.unionByName(near), tuning_splits=("validation", "test"))


@query("leakage_findings", FINDINGS + "SELECT conflict_type, 'error' AS severity, video_id_a, video_id_b, source_group_id, split_a, split_b, details, true AS review_required FROM f")
def leakage_findings(spark, sf):
    return _protocol(spark, sf)[1]


@query("leakage_findings_summary", FINDINGS + "SELECT count(*) AS conflict_count, count(*) AS error_count, " + ", ".join(f"count(*) FILTER (conflict_type = '{k}') AS {k}" for k in protocol.FINDINGS) + ", (SELECT count(*) FROM re WHERE group_id % 5 = 0) AS source_group_review_required_count FROM f")
def leakage_findings_summary(spark, sf):
    rows, found = _protocol(spark, sf)
    return protocol.leakage_summary(found, rows)


@query("leakage_strict", RE + """, x AS (SELECT 'content_hash' AS k, content_hash AS v, split FROM re UNION ALL SELECT 'group_id', group_id::VARCHAR, split FROM re),
 p AS (SELECT DISTINCT a.k, a.split AS l, b.split AS r FROM (SELECT DISTINCT * FROM x) a JOIN (SELECT DISTINCT * FROM x) b ON a.k = b.k AND a.v = b.v AND a.v <> '' AND list_position(['train', 'validation', 'test'], a.split) < list_position(['train', 'validation', 'test'], b.split))
 SELECT 'splits share values: ' || string_agg(k || ' (' || l || ', ' || r || ')', '; ' ORDER BY k || ' (' || l || ', ' || r || ')') AS error FROM p""")
def leakage_strict(spark, sf):
    """What the strict mode raises."""
    try:
        governance.assert_no_leakage(records(spark, sf), ["group_id", "content_hash"])
        error = None
    except ValueError as e:
        error = str(e)
    return spark.createDataFrame([(error,)], "error string")


_BRANCH = "list_extract(['frame_static_3d', 'dynamic_static_camera', 'dynamic_rotation_compensated', 'dynamic_full_se3', 'occlusion', 'other'], (ord % 6 + 1)::INT)"
_STATE = "list_extract(['applicable', 'not_applicable', 'provider_failed', 'applicable', 'blocked'], (ord % 5 + 1)::INT)"


def _tasks_sql() -> str:
    smoke = " UNION ALL ".join(f"SELECT video_id, '{t}' AS task_name, 'ineligible' AS status, '{why}' AS reason, '' AS provider_name, 0::BIGINT AS available, clips AS expected FROM v" for t, why in protocol.UNLABELLED.items())
    of = lambda t, b, missing, provider, expected: f"SELECT v.video_id, '{t}', CASE WHEN s = 'applicable' THEN 'eligible' ELSE 'provider_failed' END, CASE WHEN s = 'applicable' THEN '' ELSE coalesce(why, '{missing}') END, '{provider}', CASE WHEN s = 'applicable' THEN ready ELSE 0 END, {expected} FROM v LEFT JOIN b ON b.video_id = v.video_id AND branch = '{b}'"
    parts = [smoke, of("static_geometry", "frame_static_3d", "static_geometry_metadata_missing", "shared_3d_frame_observation", "frames")]
    parts.append("SELECT video_id, 'depth_residual', CASE WHEN depth > 0 THEN 'eligible' ELSE 'provider_failed' END, CASE WHEN depth > 0 THEN '' ELSE 'depth_observation_unavailable' END, 'depth_observation', depth::BIGINT, nf::BIGINT FROM v")
    parts += [of(t, b, "reprojection_metadata_missing", "camera_pose_and_track_geometry", "clips") for t, b in protocol.REPROJECTION.items()]
    parts.append("SELECT v.video_id, 'occlusion_and_reappearance', CASE WHEN s IS NULL THEN 'unknown' WHEN s = 'applicable' THEN 'eligible' WHEN s = 'not_applicable' THEN s ELSE 'provider_failed' END, CASE WHEN s IS NULL THEN 'occlusion_metadata_missing' WHEN s = 'applicable' THEN '' WHEN s = 'not_applicable' THEN coalesce(why, 'no_observed_event') ELSE coalesce(why, 'occlusion_provider_failed') END, 'formal_mask_depth_order_visibility', coalesce(ready, 0), clips FROM v LEFT JOIN b ON b.video_id = v.video_id AND branch = 'occlusion'")
    return EV + f""", c AS (SELECT video_id, clip_no, count(*) AS nf, count(*) FILTER (valid AND ord % 3 = 0 AND user_no % 4 <> 0) AS d FROM (SELECT *, substr(video_id, 2)::INT AS user_no FROM ev) GROUP BY ALL), v AS (SELECT video_id, count(*) AS clips, sum(d) AS depth, sum(nf) AS nf, sum(nf)::BIGINT AS frames FROM c GROUP BY ALL),
 b AS (SELECT video_id, {_BRANCH} AS branch, {_STATE} AS s, CASE WHEN ord % 7 < 4 THEN 'reason_' || ord % 7 END AS why, (ord % 11)::BIGINT AS ready FROM ev WHERE row_idx < 9 QUALIFY row_number() OVER (PARTITION BY video_id, {_BRANCH} ORDER BY row_idx) = 1)
 {' UNION ALL '.join(parts)}"""


@query("task_eligibility", _tasks_sql())
def task_eligibility(spark, sf):
    c, e = F.col, evidence(spark, sf)
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    known = c("valid") & (c("ord") % 3 == 0) & (F.substring("video_id", 2, 9).cast("int") % 4 != 0)
    clips = e.groupBy("video_id", "clip_no").agg(F.count(F.lit(1)).alias("num_frames"), F.count_if(known).alias("valid_depth_count"))
    videos = e.groupBy("video_id").agg(F.count(F.lit(1)).alias("frame_count"))
    branches = e.where("row_idx < 9").select(
        "video_id", c("row_idx").alias("ord"), pick(["frame_static_3d", "dynamic_static_camera", "dynamic_rotation_compensated", "dynamic_full_se3", "occlusion", "other"], c("ord") % 6).alias("branch_name"),
        pick(["applicable", "not_applicable", "provider_failed", "applicable", "blocked"], c("ord") % 5).alias("eligibility_status"), F.when(c("ord") % 7 < 4, F.concat(F.lit("reason_"), (c("ord") % 7).cast("string"))).alias("exclusion_reason"), (c("ord") % 11).alias("ready"),
    )
    return protocol.task_matrix(videos, clips, branches)


@query("formal_priors", """SELECT 'e' || p_size AS entry_id, 'class ' || p_size AS category, l AS label, 'height' AS dimension, p_size / 100.0::DOUBLE AS min_m, p_size / 50.0::DOUBLE AS max_m, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, 'd' || p_size % 4 AS derivation_id, '' AS unsupported
 FROM (SELECT DISTINCT p_size FROM part), (SELECT unnest([0, 1]) AS i), LATERAL (SELECT CASE i WHEN 0 THEN 'class ' || p_size ELSE 'alias ' || p_size END AS l) UNION ALL SELECT NULL, NULL, 'thing', NULL, NULL, NULL, NULL, NULL, 'CATEGORY_TOO_BROAD_WITHOUT_SUBTYPE'""")
def formal_priors(spark, sf):
    """A registry with a class for every size of a part, its rules checked."""
    sizes = sorted(r[0] for r in table(spark, sf, "part").select("p_size").distinct().collect())  # fifty
    sources = table(spark, sf, "part").select(F.concat(F.lit("d"), (F.col("p_size") % 4).cast("string")).alias("derivation_id")).distinct()
    fields = {f: F.lit("stated") for f in manifest.SOURCE_FIELDS if f not in ("derivation_id", "sample_count", "review_status")}
    sources = sources.withColumns({**fields, "sample_count": F.lit("12"), "review_status": F.lit(manifest.APPROVED)})
    entry = lambda n: {"entry_id": f"e{n}", "class_name": f"class {n}", "aliases": [f"alias {n}"], "supported_dimension": "height", "dimension_definition": "standing", "applicable_scope": "adults", "excluded_scope": "toys", "min_m": n / 100, "max_m": n / 50, "confidence": ("low", "medium", "high")[n % 3], "derivation_id": f"d{n % 4}"}
    payload = {"schema_version": "paper_core_scale_priors_v1", "unit": "meter", "priors": [entry(n) for n in sizes], "unsupported_classes": [{"class_name": "thing", "reason": "CATEGORY_TOO_BROAD_WITHOUT_SUBTYPE"}]}
    return manifest.formal_registry(spark, payload, sources).select("entry_id", "category", "label", "dimension", "min_m", "max_m", "confidence", "derivation_id", "unsupported")


# --- sampling and optional relations -------------------------------------------------------------

_PLAN_LIMITS = {"train": 32, "validation": 16}
PLAN = f"""WITH RECURSIVE rr AS (SELECT CASE WHEN o_custkey % 5 < 3 THEN 'train' WHEN o_custkey % 5 = 3 THEN 'validation' ELSE 'test' END AS split, o_custkey AS source_id, o_orderkey AS sample_id, o_orderkey % 4 = 0 AS is_real, CASE WHEN o_orderkey % 4 > 0 THEN 'g' || o_orderkey % 3 END AS generator, o_orderkey % 7 <> 2 AS located FROM orders),
 k AS (SELECT * FROM rr WHERE split <> 'test' AND (is_real OR located)), re AS (SELECT split, source_id, min(sample_id) AS real FROM k WHERE is_real GROUP BY ALL), ok AS (SELECT re.* FROM re JOIN (SELECT DISTINCT split, source_id, sample_id FROM k WHERE is_real AND located) l ON l.split = re.split AND l.source_id = re.source_id AND l.sample_id = re.real),
 fk AS (SELECT split, source_id, generator, min_by(sample_id, sha256('r1:' || split || ':' || sample_id)) AS sample_id, min(sha256('r1:' || split || ':' || sample_id)) AS tie FROM k WHERE NOT is_real GROUP BY ALL),
 ch AS (SELECT ok.*, row_number() OVER (PARTITION BY split ORDER BY sha256('r1:' || split || ':' || source_id), source_id) - 1 AS position FROM ok WHERE EXISTS (SELECT 1 FROM fk WHERE fk.split = ok.split AND fk.source_id = ok.source_id)),
 c AS MATERIALIZED (SELECT * FROM ch WHERE position < CASE split WHEN 'train' THEN 16 ELSE 8 END),
 st AS (SELECT split, -1::BIGINT AS position, [0, 0, 0] AS used, NULL::VARCHAR AS generator, NULL::BIGINT AS fake FROM (SELECT DISTINCT split FROM c)
  UNION ALL SELECT split, position, list_transform(used, lambda u, i: u + CASE WHEN 'g' || (i - 1) = generator THEN 1 ELSE 0 END), generator, fake FROM
   (SELECT st.split, c.position, st.used, f.generator, f.sample_id AS fake, row_number() OVER (PARTITION BY st.split ORDER BY st.used[substr(f.generator, 2)::INT + 1], f.tie) AS pick FROM st JOIN c ON c.split = st.split AND c.position = st.position + 1 JOIN fk f ON f.split = c.split AND f.source_id = c.source_id) WHERE pick = 1)
 SELECT c.split, c.source_id, c.position, x.sample_id, x.label, x.generator FROM c JOIN st ON st.split = c.split AND st.position = c.position, LATERAL (SELECT c.real AS sample_id, 0 AS label, NULL AS generator UNION ALL SELECT st.fake, 1, st.generator) x"""


@query("pair_plan", PLAN)
def pair_plan(spark, sf):
    """Orders as samples, customers as sources: pairs of a real and a fake one, generators in turn."""
    c = F.col
    split = F.when(c("o_custkey") % 5 < 3, "train").when(c("o_custkey") % 5 == 3, "validation").otherwise("test")
    real = c("o_orderkey") % 4 == 0
    rows = table(spark, sf, "orders").select(split.alias("split"), c("o_custkey").alias("source_id"), c("o_orderkey").alias("sample_id"), real.alias("is_real"), F.when(~real, F.concat(F.lit("g"), (c("o_orderkey") % 3).cast("string"))).alias("generator"), (c("o_orderkey") % 7 != 2).alias("located"))
    return sampling.pair_plan(rows, "r1", _PLAN_LIMITS)


@query("given_relations", """WITH n AS (SELECT l_orderkey AS frame_id, l_linenumber AS t, max({'c': (l_partkey % 10) / 10.0::DOUBLE, 'i': l_suppkey % 3 > 0, 'o': l_linenumber}) AS o FROM lineitem WHERE l_quantity > 5 GROUP BY ALL),
 g AS (SELECT l_orderkey AS frame_id, least(l_linenumber, l_partkey % 7 + 1) AS a, greatest(l_linenumber, l_partkey % 7 + 1) AS b, CASE l_suppkey % 3 WHEN 0 THEN 'containment_overlap' WHEN 1 THEN 'support_contact' ELSE 'other' END AS k, min({'a': l_discount::DOUBLE, 'b': l_tax::DOUBLE}) AS v FROM lineitem WHERE l_linenumber <> l_partkey % 7 + 1 AND l_orderkey % 29 <> 3 GROUP BY ALL)
 SELECT g.frame_id, k || ':' || a || ':' || b AS relation_id, k AS relation_type, v.a AS value_a, v.b AS value_b, least(x.o.c, y.o.c) AS confidence, x.o.i AND y.o.i AS identity_reliable FROM g JOIN n x ON x.frame_id = g.frame_id AND x.t = a JOIN n y ON y.frame_id = g.frame_id AND y.t = b WHERE k <> 'other'""")
def given_relations(spark, sf):
    c = F.col
    line = table(spark, sf, "lineitem")
    nodes = line.where("l_quantity > 5").select(c("l_orderkey").alias("frame_id"), c("l_linenumber").alias("track_id"), c("l_linenumber").alias("object_id"), (c("l_partkey") % 10 / 10.0).alias("confidence"), (c("l_suppkey") % 3 > 0).alias("identity_reliable"), F.lit("object").alias("node_type"))
    kind = F.when(c("l_suppkey") % 3 == 0, "containment_overlap").when(c("l_suppkey") % 3 == 1, "support_contact").otherwise("other")
    odd = F.when(c("l_orderkey") % 29 == 3, F.lit(float("nan"))).otherwise(c("l_discount").cast("double"))
    given = line.select(c("l_orderkey").alias("frame_id"), c("l_linenumber").alias("source"), (c("l_partkey") % 7 + 1).alias("target"), kind.alias("relation_type"), odd.alias("value_a"), c("l_tax").cast("double").alias("value_b"))
    return sampling.optional_relations(nodes, given, ["frame_id"])


# --- training manifests --------------------------------------------------------------------------

_TRAIN = {
    "dataset_name": "CASE WHEN sample_id % 101 = 7 THEN ' ' ELSE dataset END", "split": "CASE WHEN sample_id % 211 = 9 THEN 'holdout' ELSE split END", "source_commit": "CASE sample_id % 89 WHEN 3 THEN 'c2' WHEN 4 THEN '' ELSE 'c1' END", "source_config_sha256": "CASE sample_id % 97 WHEN 3 THEN 'k2' WHEN 4 THEN NULL ELSE 'k1' END",
    "authenticity_label_used": "sample_id % 149 = 8", "historical_csv_read": "sample_id % 151 = 8", "m6_to_a2_bridge_called": "CASE WHEN sample_id % 157 = 8 THEN NULL ELSE false END",
}
_STATUS = "CASE WHEN sample_id % 61 = 2 THEN 'malformed' WHEN sample_id % 67 = 2 THEN 'missing_file' WHEN sample_id % 13 = 2 THEN 'no_valid_residual' WHEN sample_id % 11 = 2 THEN 'partial_missing' ELSE 'eligible' END"
TRAINING = RE + f""", t AS (SELECT sample_id, group_id, sample_id AS source_video_id, label, {', '.join(f'{x} AS {k}' for k, x in _TRAIN.items())} FROM re), a AS (SELECT sample_id, split, {_STATUS} AS status FROM t)
"""


def _training(spark, sf):
    base = records(spark, sf)
    rows = base.select("sample_id", "group_id", F.col("sample_id").alias("source_video_id"), "label", *[F.expr(x).alias(k) for k, x in _TRAIN.items()])
    return rows, rows.select("sample_id", "split", F.expr(_STATUS).alias("status"))


@query("training_faults", TRAINING + """, f AS (SELECT 'unsupported_split' AS rule, sample_id FROM t WHERE split = 'holdout' UNION ALL SELECT 'empty_identity', sample_id FROM t WHERE trim(dataset_name) = '' UNION ALL SELECT 'label_not_binary', sample_id FROM t WHERE label IS NULL
  UNION ALL SELECT 'other_source_commit', sample_id FROM t WHERE source_commit = 'c2' UNION ALL SELECT 'other_source_config', sample_id FROM t WHERE source_config_sha256 = 'k2' UNION ALL SELECT 'forbidden_input', sample_id FROM t WHERE authenticity_label_used OR historical_csv_read OR coalesce(m6_to_a2_bridge_called, false)
  UNION ALL SELECT 'fatal_sample', sample_id FROM a WHERE status IN ('malformed', 'missing_file') UNION ALL SELECT 'no_valid_residual', sample_id FROM a WHERE status = 'no_valid_residual'
  UNION ALL SELECT 'repeated_sample', sample_id FROM (SELECT sample_id FROM t GROUP BY sample_id, split HAVING count(*) > 1))
 SELECT rule, count(*) AS rows, min(sample_id) AS example FROM f GROUP BY rule""")
def training_faults(spark, sf):
    return manifest.training_faults(*_training(spark, sf), "c1", "k1")


@query("training_rows", TRAINING + "SELECT t.sample_id, t.split, label, status = 'no_valid_residual' AS empty FROM t JOIN (SELECT DISTINCT * FROM a) a ON a.sample_id = t.sample_id AND a.split = t.split WHERE t.split IN ('train', 'validation') AND status IN ('eligible', 'partial_missing', 'no_valid_residual')")
def training_rows(spark, sf):
    rows, audit = _training(spark, sf)
    return manifest.training_rows(rows, audit, ("train", "validation"), "keep_empty").select("sample_id", "split", "label", "empty")
