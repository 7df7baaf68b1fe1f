"""Queries over duplicates, splits, batches and their states.

The oracles state the rules themselves: all pairs for duplicates, recursion for plans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import governance, lineage, sequential

from .adapters import RE, records, table, tracks
from .registry import query, r

STATES = list(governance.BATCH_STATES)


# --- duplicates ----------------------------------------------------------------------------------

_VOTES = ", ".join(f"sum(((h >> {i}) & 1) * 2 - 1) AS b{i}" for i in range(60))
_VALUE = " + ".join(f"CASE WHEN b{i} > 0 THEN {1 << i} ELSE 0 END" for i in range(60))
RUNS = f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w WHERE len(ws) >= 5),
hh AS (SELECT doc_id, i * 5 // n AS run, ('0x' || substr(md5(word), 1, 15))::BIGINT AS h FROM e),
t AS (SELECT doc_id, run, {_VOTES} FROM hh GROUP BY ALL),
rh AS (SELECT doc_id, list(({_VALUE})::BIGINT ORDER BY run) AS hashes FROM t GROUP BY ALL)
"""


def _items(spark, sf):
    docs = table(spark, sf, "documents")
    hashes = governance.word_run_hashes(docs, "doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 10
    return docs.join(hashes, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("content_hash"), "hashes", n.cast("double").alias("duration"), F.length("lang").alias("width"), F.length("source").alias("height"),
        (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^aeiou]", "")) / F.greatest(n, F.lit(1))).alias("rate"), F.col("source").alias("group_id"), F.when(part < 8, "train").otherwise("test").alias("split"),
    )


@query("duplicates_near", RUNS + f""", i AS (SELECT doc_id AS item_id, sha256(text) AS content_hash, hashes, length(coalesce(text, ''))::DOUBLE AS duration, length(lang) AS width, length(source) AS height,
   length(regexp_replace(coalesce(text, ''), '[^aeiou]', '', 'g')) / greatest(length(coalesce(text, '')), 1) AS rate, source AS group_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::BIGINT % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents LEFT JOIN rh USING (doc_id)),
 k AS (SELECT *, min(item_id) OVER (PARTITION BY content_hash, hashes, duration, width, height, rate) AS rep FROM i),
 p AS (SELECT a.item_id AS a, b.item_id AS b, a.content_hash = b.content_hash AS exact, 1 - list_sum(list_transform(range(1, 6), lambda x: bit_count(xor(a.hashes[x], b.hashes[x])))) / 320.0::DOUBLE AS perceptual,
   (greatest(0, 1 - abs(a.duration - b.duration) / greatest(a.duration, b.duration, 1e-8::DOUBLE)) + CASE WHEN a.width = b.width AND a.height = b.height THEN 1 ELSE 0 END + greatest(0, 1 - abs(a.rate - b.rate) / greatest(a.rate, b.rate, 1e-8::DOUBLE))) / 3 AS metadata,
   a.group_id IS NOT DISTINCT FROM b.group_id AS same_group, a.split <> b.split AS split_conflict
   FROM k a JOIN k b ON a.item_id < b.item_id AND a.item_id = a.rep AND b.item_id = b.rep AND a.hashes IS NOT NULL AND b.hashes IS NOT NULL AND a.content_hash <> b.content_hash
  UNION ALL SELECT a.item_id, b.item_id, true, 1, 1, a.group_id IS NOT DISTINCT FROM b.group_id, a.split <> b.split FROM k a JOIN k b ON a.content_hash = b.content_hash AND a.item_id < b.item_id AND a.item_id = a.rep AND (b.item_id = b.rep OR b.rep = a.item_id)),
 s AS (SELECT *, CASE WHEN exact THEN 1 ELSE 0.75::DOUBLE * perceptual + 0.25::DOUBLE * metadata END AS score FROM p)
 SELECT a, b, exact, {r('perceptual')} AS perceptual, {r('metadata')} AS metadata, {r('score')} AS score, same_group, split_conflict, split_conflict OR NOT same_group AS review_required FROM s WHERE score >= 0.92""")
def duplicates_near(spark, sf):
    return governance.media_duplicates(_items(spark, sf))


# --- splits and batches --------------------------------------------------------------------------

LABELS = ["0", "1", "unknown"]
DATASETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
RATIOS = {"train": 0.7, "validation": 0.15, "test": 0.15}
FEATURES = ["total", *(f"label_{x}" for x in LABELS), *(f"dataset_{i}" for i in range(len(DATASETS))), "big"]


def _groups(spark, sf):
    k = records(spark, sf)
    label = F.coalesce(F.col("label").cast("string"), F.lit("unknown"))
    counts = [F.count(F.lit(1)), *(F.count_if(label == x) for x in LABELS), *(F.count_if(F.col("dataset") == x) for x in DATASETS), F.count_if(F.col("size") >= 200_000)]
    official = F.when(F.col("group_id") % 17 == 0, "test").when(F.col("group_id") % 19 == 0, "train").when(F.col("group_id") % 97 == 0, "official_conflict")
    return k.groupBy("group_id").agg(*[c.alias(f) for c, f in zip(counts, FEATURES, strict=True)]).withColumn("official", official)


def _plan_sql():
    names = sorted(RATIOS)
    n = len(FEATURES)
    counts = ["count(*)", *(f"count(*) FILTER (coalesce(label::VARCHAR, 'unknown') = '{x}')" for x in LABELS), *(f"count(*) FILTER (dataset = '{x}')" for x in DATASETS), "count(*) FILTER (size >= 200000)"]
    target = lambda s: "[" + ", ".join(f"greatest(sum(f[{i + 1}]) * {RATIOS[s]}::DOUBLE, 1)" for i in range(n)) + "]"
    start = lambda s: "[" + ", ".join(f"coalesce(sum(f[{i + 1}]) FILTER (official = '{s}'), 0)::DOUBLE" for i in range(n)) + "]"
    cost = lambda s: f"list_reduce(list_transform(range(1, {n + 1}), lambda i: CASE WHEN q.f[i] <> 0 THEN (((p.h_{s}[i] + q.f[i] - t_{s}[i]) / t_{s}[i]) * ((p.h_{s}[i] + q.f[i] - t_{s}[i]) / t_{s}[i]) - ((p.h_{s}[i] - t_{s}[i]) / t_{s}[i]) * ((p.h_{s}[i] - t_{s}[i]) / t_{s}[i])) ELSE 0 END), lambda x, y: x + y)"
    pick = f"CASE WHEN c_{names[0]} <= c_{names[1]} AND c_{names[0]} <= c_{names[2]} THEN '{names[0]}' WHEN c_{names[1]} <= c_{names[2]} THEN '{names[1]}' ELSE '{names[2]}' END"
    grow = ", ".join(f"CASE WHEN split = '{s}' THEN list_transform(range(1, {n + 1}), lambda i: h_{s}[i] + f[i]) ELSE h_{s} END" for s in names)
    return RE.replace("WITH re0", "WITH RECURSIVE re0") + f""", g AS (SELECT group_id, CASE WHEN group_id % 17 = 0 THEN 'test' WHEN group_id % 19 = 0 THEN 'train' WHEN group_id % 97 = 0 THEN 'official_conflict' END AS official, [{', '.join(c + '::DOUBLE' for c in counts)}] AS f FROM re GROUP BY group_id),
 tg AS MATERIALIZED (SELECT {', '.join(f'{target(s)} AS t_{s}' for s in names)}, {', '.join(f'{start(s)} AS s_{s}' for s in names)} FROM g),
 q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('20260722:' || group_id), group_id) AS n FROM g WHERE official IS NULL),
 p AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS group_id, NULL::VARCHAR AS split, {', '.join(f's_{s} AS h_{s}' for s in names)} FROM tg
  UNION ALL SELECT n, group_id, split, {grow} FROM (SELECT *, {pick} AS split FROM (SELECT q.n, q.group_id, q.f, {', '.join(f'p.h_{s}' for s in names)}, {', '.join(f'{cost(s)} AS c_{s}' for s in names)} FROM p JOIN q ON q.n = p.n + 1, tg)))
 SELECT group_id, split, 'group_aware_planner' AS source FROM p WHERE n > 0 UNION ALL SELECT group_id, official, CASE WHEN official = 'official_conflict' THEN 'official_split_conflict' ELSE 'official' END FROM g WHERE official IS NOT NULL"""


@query("group_aware_split", _plan_sql())
def group_aware_split(spark, sf):
    return sequential.plan_split(_groups(spark, sf), FEATURES, RATIOS, 20260722)


_BYTES = {"input_bytes": "size", "temporary_bytes": "size / 4", "output_bytes": "sample_id % 7 * 1000.0"}


@query("batch_plan", RE.replace("WITH re0", "WITH RECURSIVE re0") + """, b AS (SELECT dataset, CASE WHEN group_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, group_id, sum(size + size / 4 + sample_id % 7 * 1000.0::DOUBLE) AS peak FROM re GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY dataset, split ORDER BY group_id) AS n FROM b),
 p AS (SELECT dataset, split, group_id, peak, n, peak AS held, 0 AS batch FROM o WHERE n = 1 UNION ALL SELECT o.dataset, o.split, o.group_id, o.peak, o.n, CASE WHEN held + o.peak > 2000000 THEN o.peak ELSE held + o.peak END, batch + CASE WHEN held + o.peak > 2000000 THEN 1 ELSE 0 END FROM p JOIN o ON o.dataset = p.dataset AND o.split = p.split AND o.n = p.n + 1)
 SELECT dataset, split, group_id, """ + r("peak") + " AS peak, batch::BIGINT AS batch FROM p")
def batch_plan(spark, sf):
    split = F.when(F.col("group_id") % 10 < 8, "train").otherwise("test")
    rows = records(spark, sf).select("dataset", split.alias("split"), "group_id", *[F.expr(x).alias(k) for k, x in _BYTES.items()])
    return sequential.plan_batches(rows, 2_000_000.0)


@query("split_conflicts", RE + "SELECT dataset, group_id FROM re GROUP BY ALL HAVING count(DISTINCT split) > 1")
def split_conflicts(spark, sf):
    return sequential.split_conflicts(records(spark, sf))


# --- batch states --------------------------------------------------------------------------------

_STATUS = f"list_extract({STATES!r}, (event_id % 8 + 1)::INT)"


def _history(spark, sf):
    pick = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf, "events").select("user_id", "ts", F.col("event_id").alias("ord"), pick.alias("status"))


@query("transition_audit", f"""WITH s AS (SELECT user_id, ts, event_id, {_STATUS} AS status FROM events), p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM s),
 legal AS (SELECT * FROM (VALUES ('planned', ['downloading', 'failed']), ('downloading', ['downloaded', 'failed']), ('downloaded', ['processing', 'failed']), ('processing', ['validating', 'failed']), ('validating', ['completed', 'failed']), ('completed', ['cleaned']), ('failed', ['downloading', 'processing'])) AS t(previous, next))
 SELECT previous, status, count(*) AS changes FROM p LEFT JOIN legal USING (previous) WHERE previous IS NOT NULL AND previous <> status AND NOT coalesce(list_contains(next, status), false) GROUP BY ALL""")
def transition_audit(spark, sf):
    return governance.transition_audit(_history(spark, sf), "user_id")


@query("retry_plan", f"""WITH b AS (SELECT event_id, {_STATUS} AS status, event_id % 5 AS attempt, event_id % 3 = 0 AS downloaded FROM events)
 SELECT event_id, status = 'failed' AND attempt < 3 AS allowed, CASE WHEN status <> 'failed' OR attempt >= 3 THEN '' WHEN downloaded THEN 'processing' ELSE 'downloading' END AS next_status,
  CASE WHEN status <> 'failed' THEN 'batch_is_not_failed' WHEN attempt >= 3 THEN 'maximum_retry_attempts_reached' ELSE 'retry_requires_explicit_state_transition' END AS reason FROM b""")
def retry_plan(spark, sf):
    k = F.col("ord")
    rows = _history(spark, sf).select(k.alias("event_id"), "status", (k % 5).alias("attempt"), (k % 3 == 0).alias("downloaded"))
    return lineage.retry_decisions(rows).select("event_id", "allowed", "next_status", "reason")


@query("recovery_plan", f"""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {_STATUS} AS status FROM events),
 l AS (SELECT user_id, max(n) AS last, max(n) FILTER (status IN ('planned', 'downloaded', 'completed', 'cleaned')) AS stable FROM s GROUP BY ALL)
 SELECT user_id, a.status, coalesce(b.status, 'planned') AS last_stable_status, CASE WHEN a.status = 'failed' THEN 'operator_review_then_retry_from_last_stable_state' WHEN a.status IN ('downloading', 'processing', 'validating') THEN 'mark_failed_with_interruption_reason_before_retry' ELSE 'no_recovery_required' END AS action
 FROM l JOIN s a USING (user_id) LEFT JOIN (SELECT user_id, n AS stable, status FROM s) b USING (user_id, stable) WHERE a.n = last""")
def recovery_plan(spark, sf):
    rows = _history(spark, sf).withColumn("position", F.struct("ts", "ord"))
    return lineage.recovery_actions(rows, "user_id")


@query("cleanup_plan", f"""WITH b AS (SELECT event_id, {_STATUS} AS status, event_id % 3 = 0 AS ok FROM events), a AS (SELECT event_id, unnest(['/tmp/' || (event_id % 50), '/tmp/' || (event_id % 7), '/tmp/' || (event_id % 50)]) AS path FROM events WHERE event_id % 5 <> 0),
 g AS (SELECT event_id, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM a GROUP BY ALL)
 SELECT event_id, status = 'completed' AND ok AS allowed, CASE WHEN status = 'completed' AND ok THEN coalesce(paths, '') ELSE '' END AS paths, CASE WHEN status = 'completed' AND ok THEN '' ELSE 'cleanup_forbidden_before_completed_validation' END AS reason FROM b LEFT JOIN g USING (event_id)""")
def cleanup_plan(spark, sf):
    k = F.col("event_id")
    rows = _history(spark, sf).select(F.col("ord").alias("event_id"), "status", (F.col("ord") % 3 == 0).alias("artifacts_validated"))
    tmp = lambda n: F.concat(F.lit("/tmp/"), (k % n).cast("string"))
    paths = table(spark, sf, "events").where(k % 5 != 0).select("event_id", F.explode(F.array(tmp(50), tmp(7), tmp(50))).alias("path"))
    out = lineage.cleanup_plan(rows, paths, "event_id")
    return out.select("event_id", "allowed", F.concat_ws(",", "candidate_paths").alias("paths"), "reason")


# --- identities ----------------------------------------------------------------------------------


@query("source_group_ids", """SELECT p_partkey, 'srcgrp_' || substr(sha256('["' || lower(trim(p_brand)) || '","' || lower(trim(p_name)) || '"]'), 1, 20) AS group_id FROM part""")
def source_group_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", G.source_group_id(F.col("p_brand"), F.col("p_name")).alias("group_id"))


@query("safe_identity", "SELECT page_id, 'sid_' || rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') AS identity FROM pages")
def safe_identity(spark, sf):
    return table(spark, sf, "pages").select("page_id", G.safe_identity(F.col("url")).alias("identity"))


# --- axis history --------------------------------------------------------------------------------

AXIS = """WITH RECURSIVE t0 AS (SELECT 'v' || coalesce(label::VARCHAR, 'none') AS video_id, (vec_id % 4)::INT AS track_id, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE + 2.0::DOUBLE AS z, abs(embedding[4]::DOUBLE) + 0.5::DOUBLE AS extent FROM embeddings),
 t AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY vec_id) AS n, x / sqrt(x * x + y * y + z * z) AS ax, y / sqrt(x * x + y * y + z * z) AS ay, z / sqrt(x * x + y * y + z * z) AS az,
   vec_id % 31 <> 0 AS dm, vec_id % 29 <> 0 AS av, 15 + vec_id % 23 AS pts, 1.8::DOUBLE + vec_id % 13 / 5.0::DOUBLE AS er, 1.7::DOUBLE + vec_id % 11 / 4.0::DOUBLE AS xr, (50 + vec_id % 50) / 100.0::DOUBLE AS pr, (60 + vec_id % 40) / 100.0::DOUBLE AS dq FROM t0),
 s AS (SELECT *, least(er / (er + 1), xr / (xr + 1)) AS st FROM t),
 b AS (SELECT *, CASE WHEN NOT dm THEN 'BOTTLE_SOURCE_RUNTIME_DIMENSION_MISMATCH' WHEN NOT av THEN 'AXIS_INVALID' WHEN pts < 20 THEN 'BOTTLE_AXIS_POINT_SUPPORT_INSUFFICIENT' WHEN er < 2 OR xr < 1.8::DOUBLE THEN 'BOTTLE_NOT_ELONGATED_IN_3D' WHEN st < 0.6::DOUBLE THEN 'BOTTLE_AXIS_UNSTABLE' ELSE '' END AS r0 FROM s),
 h AS (SELECT video_id, track_id, n, r0 AS reason, CASE WHEN r0 = '' THEN ax END AS lx, CASE WHEN r0 = '' THEN ay END AS ly, CASE WHEN r0 = '' THEN az END AS lz, CASE WHEN r0 = '' THEN extent END AS le FROM b WHERE n = 1
  UNION ALL SELECT video_id, track_id, n, reason, CASE WHEN reason = '' THEN ax ELSE lx END, CASE WHEN reason = '' THEN ay ELSE ly END, CASE WHEN reason = '' THEN az ELSE lz END, CASE WHEN reason = '' THEN extent ELSE le END FROM
   (SELECT b.*, lx, ly, lz, le, CASE WHEN r0 <> '' THEN r0 WHEN le IS NULL THEN '' WHEN abs(ax * lx + ay * ly + az * lz) < 0.8::DOUBLE THEN 'BOTTLE_TRACK_AXIS_INCOMPATIBLE' WHEN abs(ln(extent) - ln(le)) > 0.4::DOUBLE THEN 'BOTTLE_TRACK_SIZE_INCOMPATIBLE' ELSE '' END AS reason FROM h JOIN b ON b.video_id = h.video_id AND b.track_id = h.track_id AND b.n = h.n + 1))
"""


@query("axis_history", AXIS + f"SELECT video_id, track_id, (n - 1)::INT AS frame_index, reason = '' AS accepted, reason, {r(chr(67) + 'ASE WHEN reason = ' + repr('') + ' THEN least(1, st, pr, dq) END')} AS quality FROM h JOIN b USING (video_id, track_id, n)")
def axis_history(spark, sf):
    k, norm = F.col("vec_id"), F.sqrt(F.col("p.x") * F.col("p.x") + F.col("p.y") * F.col("p.y") + F.col("p.z") * F.col("p.z"))
    rows = tracks(spark, sf).select(
        "video_id", F.col("point_id").alias("track_id"), "frame_index", (k % 31 != 0).alias("dimension_match"), (k % 29 != 0).alias("axis_valid"), (15 + k % 23).alias("points"), (1.8 + k % 13 / 5.0).alias("eigenvalue_ratio"), (1.7 + k % 11 / 4.0).alias("extent_ratio"),
        F.col("scale").alias("extent"), (F.col("p.x") / norm).alias("ax"), (F.col("p.y") / norm).alias("ay"), (F.col("p.z") / norm).alias("az"), ((50 + k % 50) / 100.0).alias("point_ratio"), ((60 + k % 40) / 100.0).alias("depth_quality"),
    )
    return sequential.bottle_history(rows)
