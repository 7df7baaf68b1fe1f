"""Queries that write tables with the sinks, read them back with the readers and report what came through."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import fusion
from tessella.session import new_folder
from tessella.sources import archives, cache, manifest, outputs, records

from .adapters import EV, RE, evidence, table
from .adapters import records as samples
from .evidence_queries import SUSPICIOUS, _clip_spans
from .gate_queries import HEAT
from .registry import ORACLES, query, r


@query("manifest_csv", RE + """, m AS (SELECT 's' || sample_id AS sample_id, CASE WHEN sample_id % 7 = 0 THEN 'val' ELSE split END AS split, CASE WHEN sample_id % 11 = 0 THEN 2 ELSE label END AS label FROM re)
 SELECT sample_id, split, label, CASE WHEN split NOT IN ('train', 'validation', 'test') THEN 'bad_split' WHEN label IS NULL OR label NOT IN (0, 1) THEN 'bad_label' ELSE '' END AS problem FROM m""")
def manifest_csv(spark, sf):
    """A CSV manifest with bad splits and labels, written, read with its schema and judged row by row."""
    k = F.col("sample_id")
    rows = samples(spark, sf).select(
        F.concat(F.lit("s"), k.cast("string")).alias("sample_id"), F.col("dataset").alias("dataset_name"), F.concat(F.lit("v"), (k % 100).cast("string")).alias("source_video_id"), F.col("group_id").cast("string").alias("group_id"),
        F.when(k % 7 == 0, "val").otherwise(F.col("split")).alias("split"), F.when(k % 11 == 0, 2).otherwise(F.col("label")).alias("label"), F.lit("r.json").alias("residual_sequence_path"),
    )
    path = new_folder(spark, "manifest")
    records.write_csv(rows, path, rows.columns)
    return records.read_manifest(spark, path).select("sample_id", "split", "label", "problem")


@query("training_manifest", RE + "SELECT split, count(*) AS rows, count(DISTINCT group_id) AS groups FROM re GROUP BY ALL")
def training_manifest(spark, sf):
    """A manifest with all required columns passes; the same without one of them is refused."""
    s = samples(spark, sf)
    rows = s.select(F.col("sample_id").cast("string"), F.col("dataset").alias("dataset_name"), F.lit("v").alias("source_video_id"), F.col("group_id").cast("string"), "split", F.coalesce("label", F.lit(0)).alias("label"), F.lit("r.json").alias("residual_sequence_path"))
    good, bad = new_folder(spark, "training"), new_folder(spark, "training")
    records.write_csv(rows, good, rows.columns)
    records.write_csv(rows, bad, [c for c in rows.columns if c != "group_id"])
    if manifest.missing_columns(spark, bad) != ["group_id"]:
        raise AssertionError("a missing column went unnoticed")
    return manifest.read_training_manifest(spark, good).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("group_id").alias("groups"))


@query("multi_format", f"SELECT f AS format, c_nationkey, count(*) AS customers, {r('sum(c_acctbal)')} AS balance FROM customer, (SELECT unnest(['csv', 'jsonl', 'parquet']) AS f) GROUP BY ALL")
def multi_format(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    schema, out = "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string", None
    for kind in ("csv", "jsonl", "parquet"):
        path = f"{new_folder(spark, 'formats')}.{kind}"
        if kind == "csv":
            records.write_csv(c, path, c.columns)
        elif kind == "jsonl":
            records.write_json(c, path)
        else:
            records.write_table(c, path, c.columns, ["c_custkey"])
        one = records.read_records(spark, path, schema).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance")).select(F.lit(kind).alias("format"), "c_nationkey", "customers", "balance")
        out = one if out is None else out.unionByName(one)
    return out


@query("json_sink", f"SELECT event_id, {r('CASE WHEN event_id % 10 <> 3 THEN value END')} AS value, event_type FROM events")
def json_sink(spark, sf):
    """NaN becomes null on the way."""
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), "event_type")
    path = new_folder(spark, "json")
    records.write_json(e, path)
    return spark.read.schema("event_id long, value double, event_type string").json(path)


@query("parquet_sink", f"SELECT o_orderkey, o_custkey, {r('o_totalprice')} AS o_totalprice FROM orders")
def parquet_sink(spark, sf):
    o = table(spark, sf, "orders")
    path = new_folder(spark, "sink")
    records.write_table(o, path, ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderkey"])
    back = spark.read.parquet(path)
    if back.columns != ["o_orderkey", "o_custkey", "o_totalprice"]:
        raise AssertionError("the column order changed")
    return back


@query("directory_scan", "SELECT n_nationkey::VARCHAR AS nation, length(n_name) + 1 AS length, sha256(n_name || chr(10)) AS sha256 FROM nation")
def directory_scan(spark, sf):
    """One file for each nation, found by suffix below a folder, with size and content hash."""
    path = new_folder(spark, "scan")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).repartition(4, "k").write.partitionBy("k").text(path)
    return records.scan_files(spark, path, ("txt",)).select(F.regexp_extract("path", "k=([0-9]+)/", 1).alias("nation"), "length", "sha256")


@query("directory_manifest", "SELECT n_nationkey::VARCHAR AS video_id, 'missing_label,missing_group,missing_split' AS problems, sha256(n_name || chr(10)) AS sha256 FROM nation")
def directory_manifest(spark, sf):
    """A manifest straight from the files: nothing is inferred about labels, groups or splits."""
    path = new_folder(spark, "scan")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).repartition(4, "k").write.partitionBy("k").text(path)
    found = records.scan_files(spark, path, ("txt",)).select(F.regexp_extract("path", "k=([0-9]+)/", 1).alias("video_id"), F.lit("scan").alias("dataset"), F.lit(1).alias("frames"), F.lit("p").alias("path"), "sha256")
    none = lambda schema: spark.createDataFrame([], schema)
    built = manifest.build(found, none("video_id string, label int"), none("video_id string, group_id string"), none("group_id string, split string"))
    return built.select("video_id", "problems").join(found.select("video_id", "sha256"), "video_id")


@query("stage_cache", f"SELECT event_type, count(*) AS rows, {r('sum(value)')} AS total, 2 AS builds FROM events GROUP BY ALL")
def stage_cache(spark, sf):
    """Built once for equal inputs, again for others; the second reading checks the files' hashes."""
    root, calls = new_folder(spark, "cache"), []

    def build():
        calls.append(1)
        return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))

    cache.cached(spark, root, "totals", {"version": 1}, build, verify=True)
    out = cache.cached(spark, root, "totals", {"version": 1}, build, verify=True)
    cache.cached(spark, root, "totals", {"version": 2}, build, verify=True)
    return out.withColumn("builds", F.lit(len(calls)))


@query("observation_json", f"SELECT 'c' || l_orderkey AS clip_id, l_linenumber AS frame_index, l_partkey::VARCHAR AS object_id, {r('l_quantity * 10')} AS mask_area, {r('l_tax * 100 + 1')} AS depth, {r('l_quantity + l_discount')} AS box_sum FROM lineitem")
def observation_json(spark, sf):
    """Clip observations as nested JSON documents, written and read back."""
    c = F.col
    q, d = c("l_quantity").cast("double"), c("l_discount").cast("double")
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), c("l_orderkey").cast("string")).alias("clip_id"), F.concat(F.lit("v"), c("l_suppkey").cast("string")).alias("video_id"), c("l_linenumber").alias("frame_index"), F.lit(1280).alias("width"), F.lit(720).alias("height"),
        c("l_partkey").cast("string").alias("object_id"), c("l_returnflag").alias("label"), (q * 10).alias("mask_area"), F.lit(921600.0).alias("frame_area"), (c("l_tax") * 100 + 1).cast("double").alias("depth"), F.lit(0.9).alias("confidence"), F.array(F.lit(0.0), F.lit(0.0), q, d).alias("bbox"),
    )
    path = new_folder(spark, "observations")
    records.write_observations(rows, path)
    back = records.read_observations(spark, path).where("_corrupt_record IS NULL").select("clip_id", F.explode("frames").alias("f")).select("clip_id", "f.frame_index", F.explode("f.objects").alias("o"))
    return back.select("clip_id", "frame_index", "o.object_id", "o.mask_area", "o.depth", (F.get("o.bbox", F.lit(2)) + F.get("o.bbox", F.lit(3))).alias("box_sum"))


@query("result_json", EV + f"SELECT video_id, clip_id, name, {r('CASE WHEN valid THEN raw_value END')} AS raw_value, {r('confidence')} AS confidence, valid, coalesce(frame_index, -1) AS frame_index, track_id FROM ev")
def result_json(spark, sf):
    """Result documents, one a line, written from evidence, read with their schema and turned back into evidence."""
    e = evidence(spark, sf)
    residual = F.struct(
        "name", "level", "raw_value", "normalized_value", F.when(F.col("valid"), "observed").otherwise("blocked_by_input").alias("availability"), "confidence", F.col("valid").alias("valid_mask"), "reason",
        F.struct(F.lit("object").alias("kind"), "object_id", "track_id", "frame_index").alias("spatial_support"), F.struct("frame_index", "track_id").alias("temporal_support"),
    )
    clips = e.groupBy("video_id", "clip_id").agg(F.min("row_idx").alias("start_frame"), F.max("row_idx").alias("end_frame"), F.array_sort(F.collect_list(F.struct("row_idx", residual.alias("r")))).alias("rs"))
    clip = F.struct("clip_id", "start_frame", "end_frame", F.transform("rs", lambda x: x["r"]).alias("residuals"))
    docs = clips.groupBy("video_id").agg(F.collect_list(clip).alias("clips"))
    path = new_folder(spark, "results")
    records.write_json(docs, path)
    back = records.evidence_of_results(spark.read.schema(records.RESULT).json(path))
    return back.select("video_id", "clip_id", "name", "raw_value", "confidence", "valid", F.coalesce("frame_index", F.lit(-1)).alias("frame_index"), "track_id")


MAN = """WITH v AS (SELECT doc_id AS video_id, coalesce(lang, 'none') AS dataset, 'p/' || doc_id AS path, n_chars % 5 AS frames FROM documents), l AS (SELECT doc_id AS video_id, toxic::INT AS label FROM labels), g AS (SELECT doc_id AS video_id, source AS group_id FROM documents WHERE doc_id % 13 <> 0),
 s AS (SELECT DISTINCT source AS group_id, CASE WHEN length(source) % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM documents WHERE source <> 's3'),
 m AS (SELECT video_id, dataset, path, frames, label, g.group_id, split, concat_ws(',', CASE WHEN label IS NULL THEN 'missing_label' END, CASE WHEN g.group_id IS NULL THEN 'missing_group' END, CASE WHEN split IS NULL THEN 'missing_split' END, CASE WHEN coalesce(frames, 0) < 1 THEN 'no_frames' END) AS problems FROM v LEFT JOIN l USING (video_id) LEFT JOIN g USING (video_id) LEFT JOIN s ON s.group_id = g.group_id),
 h AS (SELECT *, sha256(concat_ws(chr(31), coalesce('=' || video_id, '-'), coalesce('=' || dataset, '-'), coalesce('=' || path, '-'), coalesce('=' || frames, '-'), coalesce('=' || label, '-'), coalesce('=' || group_id, '-'), coalesce('=' || split, '-'))) AS row_sha256 FROM m)
"""


def _manifest(spark, sf):
    d = table(spark, sf, "documents")
    videos = d.select(F.col("doc_id").alias("video_id"), F.coalesce("lang", F.lit("none")).alias("dataset"), F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), (F.col("n_chars") % 5).alias("frames"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("video_id"), F.col("toxic").cast("int").alias("label"))
    groups = d.where(F.col("doc_id") % 13 != 0).select(F.col("doc_id").alias("video_id"), F.col("source").alias("group_id"))
    splits = d.where("source <> 's3'").select(F.col("source").alias("group_id"), F.when(F.length("source") % 2 == 0, "train").otherwise("test").alias("split")).distinct()
    return manifest.build(videos, labels, groups, splits)


@query("manifest_build", MAN + "SELECT video_id, label, group_id, split, problems, row_sha256 FROM h")
def manifest_build(spark, sf):
    return _manifest(spark, sf).select("video_id", "label", "group_id", "split", "problems", "row_sha256")


@query("manifest_digest", MAN + "SELECT count(*) AS rows, count(*) FILTER (problems = '') AS usable, bit_xor(('0x' || substr(row_sha256, 1, 15))::BIGINT) AS fingerprint FROM h")
def manifest_digest(spark, sf):
    return manifest.digest(_manifest(spark, sf))


@query("manifest_violations", MAN + """, b AS (SELECT * FROM h UNION ALL SELECT * FROM h WHERE video_id % 50 = 0), c AS (SELECT *, CASE WHEN video_id % 7 = 0 THEN 'other' ELSE split END AS split2 FROM b)
 SELECT 'repeated_video' AS rule, video_id::VARCHAR AS key, count(*) AS rows FROM c GROUP BY video_id HAVING count(*) > 1 UNION ALL SELECT 'group_in_several_splits', group_id, count(*) FROM c WHERE group_id IS NOT NULL AND split2 IS NOT NULL GROUP BY group_id HAVING count(DISTINCT split2) > 1
 UNION ALL SELECT 'changed_row', video_id::VARCHAR, 1 FROM c WHERE split2 IS DISTINCT FROM split""")
def manifest_violations(spark, sf):
    """A manifest with repeated rows and changed splits."""
    m = _manifest(spark, sf)
    m = m.unionByName(m.where(F.col("video_id") % 50 == 0))
    return manifest.violations(m.withColumn("split", F.when(F.col("video_id") % 7 == 0, "other").otherwise(F.col("split"))))


@query("prior_registry", "SELECT p_partkey, x.class_name, x.min_m FROM part LEFT JOIN (VALUES ('car', 'car', 2.94::DOUBLE), ('automobile', 'car', 2.94), ('person', 'person', 1.5), ('human', 'person', 1.5), ('bottle', 'bottle', 0.137)) AS x(label, class_name, min_m) ON x.label = CASE p_size % 4 WHEN 0 THEN 'automobile' WHEN 1 THEN 'human' WHEN 2 THEN 'bottle' ELSE 'dog' END")
def prior_registry(spark, sf):
    entries = [
        {"entry_id": "e1", "class_name": "car", "aliases": ["automobile"], "supported_dimension": "length", "min_m": 2.94, "max_m": 4.92, "derivation_id": "d1"},
        {"entry_id": "e2", "class_name": "person", "aliases": ["human"], "supported_dimension": "height", "min_m": 1.5, "max_m": 1.99, "derivation_id": "d2"},
        {"entry_id": "e3", "class_name": "bottle", "supported_dimension": "height", "min_m": 0.137, "max_m": 0.339, "derivation_id": "d2"},
    ]
    approved = spark.createDataFrame([("d1", "approved"), ("d2", "approved"), ("d3", "draft")], "derivation_id string, review_status string")
    priors = manifest.prior_registry(spark, entries, approved)
    k = F.col("p_size") % 4
    parts = table(spark, sf, "part").select("p_partkey", F.when(k == 0, "automobile").when(k == 1, "human").when(k == 2, "bottle").otherwise("dog").alias("label"))
    return parts.join(F.broadcast(priors), "label", "left").select("p_partkey", "class_name", "min_m")


@query("video_report", SUSPICIOUS + """, vd AS (SELECT video_id, sum(risk_score * greatest(confidence, 1e-8)) / sum(CASE WHEN risk_score IS NOT NULL THEN greatest(confidence, 1e-8) END) AS risk_score, count(*) AS clips FROM cl GROUP BY video_id),
 os AS (SELECT video_id, object_id AS id, sum(normalized_value * greatest(confidence, 1e-8)) / sum(greatest(confidence, 1e-8)) AS s, clip_id FROM ev WHERE valid AND object_id IS NOT NULL GROUP BY ALL), ts AS (SELECT video_id, track_id AS id, sum(normalized_value * greatest(confidence, 1e-8)) / sum(greatest(confidence, 1e-8)) AS s, clip_id FROM ev WHERE valid AND track_id IS NOT NULL GROUP BY ALL),
 o AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY round(max(s), 9) DESC, id) AS rn FROM os GROUP BY video_id, id), t AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY round(max(s), 9) DESC, id) AS rn FROM ts GROUP BY video_id, id),
 oo AS (SELECT video_id, string_agg(id, ',' ORDER BY rn) AS objects FROM o WHERE rn <= 3 GROUP BY ALL), tt AS (SELECT video_id, string_agg(id, ',' ORDER BY rn) AS tracks FROM t WHERE rn <= 3 GROUP BY ALL), ii AS (SELECT video_id, string_agg(start_frame || '-' || end_frame, ',' ORDER BY start_frame) AS intervals FROM sp GROUP BY ALL)
 SELECT video_id, """ + r("risk_score") + " AS risk_score, clips, coalesce(intervals, '') AS intervals, coalesce(objects, '') AS objects, coalesce(tracks, '') AS tracks FROM vd LEFT JOIN oo USING (video_id) LEFT JOIN tt USING (video_id) LEFT JOIN ii USING (video_id)")
def video_report(spark, sf):
    from tessella.operators import windows

    spans = _clip_spans(spark, sf)
    e = evidence(spark, sf)
    score = lambda key: fusion.entity_scores(e, key).select("video_id", key, F.round("score", 9).alias("score"))
    report = fusion.video_report(fusion.fuse_videos(spans), windows.merge_suspicious(spans, 0.5), score("object_id"), score("track_id"))
    ids = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["id"]))
    text = F.concat_ws(",", F.transform("intervals", lambda x: F.concat(x["start_frame"].cast("string"), F.lit("-"), x["end_frame"].cast("string"))))
    return report.select("video_id", "risk_score", "clips", text.alias("intervals"), ids("objects").alias("objects"), ids("tracks").alias("tracks"))


def _analysis(spark, sf) -> str:
    """The folder of a whole analysis: clips, timeline, intervals, scores, result and heat maps."""
    e = evidence(spark, sf)
    clips = e.groupBy("video_id", "clip_id").agg(F.min("row_idx").alias("start_frame"), F.max("row_idx").alias("end_frame"), F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("confidence"), F.max("normalized_value").alias("risk_score"), F.avg(F.col("valid").cast("double")).alias("coverage"))
    root = new_folder(spark, "analysis")
    heat = fusion.heatmap(e.where("valid").select("video_id", F.col("clip_no").alias("frame"), (F.col("raw_value") * 3).alias("x"), (F.col("row_idx") / 2).alias("y"), F.col("normalized_value").alias("value")))
    scores = [fusion.entity_scores(e, k) for k in ("object_id", "track_id")]
    outputs.write_analysis(root, clips, fusion.fuse_videos(clips), clips.where("risk_score > 0.5").select("video_id", "start_frame", "end_frame"), *scores, heat=heat)
    return root


@query("analysis_output", EV + f"SELECT video_id, clip_id, min(row_idx) AS start_frame, max(row_idx) AS end_frame, count(*) AS rows, {r('avg(confidence)')} AS confidence FROM ev GROUP BY ALL")
def analysis_output(spark, sf):
    """The clips of an analysis, read back."""
    return spark.read.parquet(f"{_analysis(spark, sf)}/clips").select("video_id", "clip_id", "start_frame", "end_frame", "rows", "confidence")


_COUNTS = {"object_scores": ORACLES["object_scores"], "track_scores": ORACLES["track_scores"], "heatmaps": HEAT + 'SELECT video_id, frame, "row", col FROM h'}


@query("analysis_tables", EV + f""", c AS (SELECT video_id, clip_id, min(row_idx) AS a, max(row_idx) AS b, avg(confidence) AS confidence, max(normalized_value) AS risk FROM ev GROUP BY ALL)
 SELECT 'clips' AS name, count(*) AS rows, {r('sum(confidence)')} AS total FROM c UNION ALL SELECT 'timeline', count(*), {r('sum(risk)')} FROM c UNION ALL SELECT 'suspicious', count(*), {r('sum(b - a)')} FROM c WHERE risk > 0.5 UNION ALL SELECT 'result', count(DISTINCT video_id), NULL FROM c
 UNION ALL """ + " UNION ALL ".join(f"SELECT '{name}', count(*), NULL FROM ({sql})" for name, sql in _COUNTS.items()))
def analysis_tables(spark, sf):
    """All seven tables of an analysis, read back in their own formats."""
    root = _analysis(spark, sf)
    csv = lambda name: spark.read.option("header", True).csv(f"{root}/{name}")
    total = {"clips": F.sum("confidence"), "timeline": F.sum(F.col("risk_score").cast("double")), "suspicious": F.sum(F.col("end_frame") - F.col("start_frame")).cast("double")}
    tables = {"clips": spark.read.parquet(f"{root}/clips"), "timeline": csv("timeline"), "suspicious": spark.read.json(f"{root}/suspicious"), "result": spark.read.json(f"{root}/result"), "object_scores": csv("object_scores"), "track_scores": csv("track_scores"), "heatmaps": spark.read.parquet(f"{root}/heatmaps")}
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows"), total.get(name, F.lit(None).cast("double")).alias("total")).select(F.lit(name).alias("name"), "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("zip_directory", "SELECT doc_id, octet_length(encode(text)) AS size, true AS crc_equal, '' AS reason FROM documents WHERE text IS NOT NULL")
def zip_directory(spark, sf):
    """Texts written to archives, sixteen folders of members, and the archives' directories read back: sizes, and whether checksums are the texts'."""
    path = new_folder(spark, "archives")
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int").alias("archive"))

    def write(batches):
        import zipfile

        import pandas as pd
        from pyarrow import fs

        # Sorted by archive: texts pass one by one into the open one's stream, and none is held as a whole.
        now, out, z = None, None, None
        for pdf in batches:
            for doc_id, text, archive in zip(pdf["doc_id"], pdf["text"], pdf["archive"], strict=True):
                if archive != now:
                    if z is not None:
                        z.close()
                        out.close()
                    now, name = archive, f"{path}/{archive}.zip"
                    system, inner = fs.FileSystem.from_uri(name)
                    system.create_dir(inner.rsplit("/", 1)[0])
                    out = system.open_output_stream(inner)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    yield pd.DataFrame({"archive": [archive], "path": [name]})
                z.writestr(f"texts/{doc_id}.txt", text.encode())
        if z is not None:
            z.close()
            out.close()

    written = docs.repartition(16, "archive").sortWithinPartitions("archive").mapInPandas(write, "archive int, path string")
    paths = sorted(r["path"] for r in written.collect())  # sixteen
    spark.dataSource.register(archives.ZipDirectory)
    found = spark.read.format("zip_directory").option("paths", "\n".join(paths)).load()
    doc_id = F.regexp_extract("member", r"(\d+)\.txt$", 1).cast("long")
    found = found.select(doc_id.alias("doc_id"), "size", "crc32", "reason")
    return found.join(docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("own")), "doc_id").select("doc_id", "size", (F.col("crc32") == F.col("own")).alias("crc_equal"), "reason")
