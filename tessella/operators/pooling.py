"""Pooling, coverage and remaining residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import interval_distance
from tessella.session import parts, stored


def strict_aggregate(rows: DataFrame, keys: list[str], method: str = "mean", require_all: bool = True) -> DataFrame:
    """mean, max or median of value; with ``require_all`` one invalid row makes the group missing.

    Rows: keys, value, quality, valid, reason, ord. The reason is the first invalid row's.
    """
    pick = {"mean": F.avg, "max": F.max, "median": F.median}[method]
    ok = F.col("valid")
    out = rows.groupBy(*keys).agg(
        pick(F.when(ok, F.col("value"))).alias("_v"),
        F.avg(F.when(ok, F.col("quality"))).alias("_q"),
        F.count_if(ok).alias("valid_rows"),
        F.count_if(~ok).alias("invalid_rows"),
        F.min_by(F.when(~ok, F.col("reason")), F.when(~ok, F.col("ord"))).alias("_r"),
    )
    live = (F.col("valid_rows") > 0) & (F.lit(not require_all) | (F.col("invalid_rows") == 0))
    reason = F.when(live, "").otherwise(F.coalesce("_r", F.lit("no_valid_evidence"))) if require_all else F.when(live, "").otherwise(F.lit("no_valid_evidence"))
    return out.select(*keys, F.when(live, F.col("_v")).alias("value"), F.when(live, F.col("_q")).otherwise(F.lit(0.0)).alias("quality"), "valid_rows", "invalid_rows", reason.alias("reason"))


def weighted_fields(rows: DataFrame, keys: list[str], weights: dict[str, float], require_all: bool = True) -> DataFrame:
    """Weighted sum of named fields (columns, NULL missing); missing ones are skipped or, strictly, make the sum missing."""
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) * w for n, w in weights.items()), F.lit(0.0))
    have = sum((F.col(n).isNotNull().cast("int") for n in weights), F.lit(0))
    ok = have == len(weights) if require_all else have > 0
    return rows.select(*keys, F.when(ok, total).alias("score"), have.alias("fields"))


def relation_distance(rows: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Change of one relation between frames by its kind. Rows: kind, before, after (arrays of doubles).

    Lengths: mean |ln ratio|; depth order: share of flipped signs; bearing: angle / pi;
    orientation, rigidity, containment and contact: mean absolute difference.
    """
    pairs = F.zip_with("after", "before", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mean = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, x: s + x) / F.size("after")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot("after", "after")), F.sqrt(dot("before", "before"))
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot("after", "before") / (na * nb)))
    same = F.size("after") == F.size("before")
    positive = F.forall("after", lambda x: x > 0) & F.forall("before", lambda x: x > 0)
    clear = F.forall("after", lambda x: F.abs(x) > eps) & F.forall("before", lambda x: F.abs(x) > eps)
    k = F.col("kind")
    value = (
        F.when(~same, F.lit(None).cast("double"))
        .when(k.isin("object_relative_distance", "structure_edge_length", "object_boundary_relation"), F.when(positive, mean(lambda x: F.abs(F.ln((x["a"] + eps) / (x["b"] + eps))))))
        .when(k == "depth_order", F.when(clear, mean(lambda x: (F.signum(x["a"]) != F.signum(x["b"])).cast("double"))))
        .when(k == "bearing_relation", F.when((na > eps) & (nb > eps), F.acos(cos) / F.pi()))
        .otherwise(mean(lambda x: F.abs(x["a"] - x["b"])))
    )
    return rows.withColumn("distance", value)


def reappearance_cues(rows: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Mean of six cues of a reappeared object. Rows: position_error, depth0, depth1, scale0, scale1, structure, motion, same_id, event."""
    c = F.col
    ok = c("event") & (F.least("depth0", "depth1") > 0) & (F.least("scale0", "scale1") > 0) & c("same_id")
    zero = F.lit(0.0)
    total = F.greatest(zero, c("position_error")) + F.abs(F.ln((c("depth1") + eps) / (c("depth0") + eps))) + F.abs(F.ln((c("scale1") + eps) / (c("scale0") + eps))) + F.greatest(zero, c("structure")) + F.greatest(zero, c("motion"))
    reason = F.when(~c("event"), "not_applicable_no_event").when(F.least("depth0", "depth1") <= 0, "reappearance_measurement_unavailable").when(F.least("scale0", "scale1") <= 0, "reappearance_physical_scale_unavailable").when(~c("same_id"), "reappearance_identity_inconsistent").otherwise("")
    return rows.withColumn("residual", F.when(ok, total / 6)).withColumn("reason", reason)


def interval_union_distance(rows: DataFrame, value: str = "value", intervals: str = "intervals") -> DataFrame:
    """Least log distance of a value to a set of intervals (array of structs low, high)."""
    d = F.transform(F.col(intervals), lambda x: interval_distance(F.ln(F.col(value)), F.ln(x["low"]), F.ln(x["high"])))
    return rows.withColumn("distance", F.array_min(d))


def mask_completeness(pixels: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of a box that its mask fills, and of the mask that spills over. Pixels: keys, row, col. Boxes: keys, x1, y1, x2, y2 (integers, half open)."""
    j = boxes.join(pixels, keys, "left")
    inside = (F.col("col") >= F.col("x1")) & (F.col("col") < F.col("x2")) & (F.col("row") >= F.col("y1")) & (F.col("row") < F.col("y2"))
    out = j.groupBy(*keys).agg(F.count("col").alias("area"), F.count_if(inside).alias("inner"), F.max((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("box"))
    return out.select(*keys, F.when(F.col("box") > 0, F.col("inner") / F.col("box")).alias("completeness"), F.when(F.col("area") > 0, (F.col("area") - F.col("inner")) / F.col("area")).alias("spill"))


def variation(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population deviation over mean of the positive values."""
    good = rows.where(F.col(value) > 0)
    return good.groupBy(*keys).agg((F.stddev_pop(value) / F.avg(value)).alias("cv"), F.count(F.lit(1)).alias("rows"))


def pool_points(points: DataFrame, mask: DataFrame, keys: list[str], ratio: float = 0.25) -> DataFrame:
    """Mean of the greatest quarter of the point residuals that fall on a mask pixel (points round half to even)."""
    on = points.withColumn("row", F.rint("v").cast("int")).withColumn("col", F.rint("u").cast("int")).join(mask, [*keys, "row", "col"], "left_semi")
    by = Window.partitionBy(*keys)
    ranked = on.withColumn("_r", F.row_number().over(by.orderBy(F.desc("residual"), "point_id"))).withColumn("_n", F.count(F.lit(1)).over(by))
    return ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * ratio))).groupBy(*keys).agg(F.avg("residual").alias("residual"), F.max("_n").alias("points"))


def pool_sources(pixels: DataFrame, maps: DataFrame, points: DataFrame, frame: list[str], keys: list[str], sources: list[str], ratio: float = 0.25) -> DataFrame:
    """Mean of the greatest quarter of each source's residuals inside an object's mask, and of its track points'; NULL where there are none.

    Pixels: keys (frame and object), row, col. Maps: frame, row, col and a column for each source. Points: frame, u, v, residual, point_id (they
    round half to even). A source is one column, so one pass over the mask serves all of them.
    """
    on = pixels.join(maps, [*frame, "row", "col"])
    long = on.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("v")) for s in sources])).alias("x"), "row", "col").select(*keys, "x.source", "x.v", F.struct("row", "col").alias("_o")).where("v IS NOT NULL")
    hit = points.select(*frame, F.rint("v").cast("int").alias("row"), F.rint("u").cast("int").alias("col"), "residual", "point_id").join(pixels, [*frame, "row", "col"])
    long = long.unionByName(hit.select(*keys, F.lit("track").alias("source"), F.col("residual").alias("v"), F.struct(F.col("point_id").cast("int").alias("row"), F.lit(0).alias("col")).alias("_o")))
    by = Window.partitionBy(*keys, "source")
    ranked = long.withColumn("_r", F.row_number().over(by.orderBy(F.desc("v"), "_o"))).withColumn("_n", F.count(F.lit(1)).over(by))
    top = ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * ratio)))
    return top.groupBy(*keys).agg(*[F.avg(F.when(F.col("source") == s, F.col("v"))).alias(s) for s in (*sources, "track")])


def coverage_targets(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts of every target (a small table), the gap to it and whether the minimum is met. Targets: name, minimum, target."""
    out = targets.join(counts, "name", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("name", n.alias("n"), F.greatest(F.col("target") - n, F.lit(0)).alias("gap"), (n >= F.col("minimum")).alias("met"))


def scene_cut_statistics(rows: DataFrame, key: str) -> DataFrame:
    """Frames, cuts (the first frame is none) and objects that appear at a cut. Rows: key, frame_index, cut, objects."""
    first = F.min("frame_index").over(Window.partitionBy(key))
    r = rows.withColumn("_cut", F.col("cut") & (F.col("frame_index") > first))
    return r.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.count_if("_cut").alias("cuts"), F.coalesce(F.sum(F.when(F.col("_cut"), F.col("objects"))), F.lit(0)).alias("objects_at_cuts"))


def sequence_statistics(matrix: DataFrame, channels: list[str]) -> DataFrame:
    """Cells, available cells and mean confidence of every channel of a channel matrix."""
    cells = matrix.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_available").alias("a"), F.col(f"{c}_confidence").alias("q"), F.col(f"{c}_value").alias("v")) for c in channels])).alias("x")).select("x.*")
    return cells.groupBy("channel").agg(F.count(F.lit(1)).alias("cells"), F.count_if("a").alias("available"), (F.count_if("a") / F.count(F.lit(1))).alias("availability"), F.avg("q").alias("confidence"), F.avg("v").alias("value"))


def funnel(rows: DataFrame, reasons: list[str]) -> DataFrame:
    """One row of counters: rows, valid rows, tracks, objects, and a count for each known reason, zeros included."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid"), F.count_distinct("track_id").alias("tracks"), F.count_distinct("object_id").alias("objects"), *[F.count_if(F.col("reason") == r).alias(f"reason_{r}") for r in reasons])


def occlusion_pairs(supports: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of objects of a frame that share predicted pixels, the nearer one first. Supports: key, object_id, pixel, depth.

    The supports of a pixel are one row, in which they meet. Supports that are dealt by the key already are not shuffled at all.
    """
    c = F.col
    rows = supports.select(*key, "pixel", F.struct("object_id", "depth").alias("_s")).dropna(subset=[*key, "pixel"])
    pixels = rows.groupBy(*key, "pixel").agg(F.collect_list("_s").alias("_all")).where(F.size("_all") > 1)
    front = pixels.select(*key, "_all", F.explode("_all").alias("_f"))
    behind = lambda o: (c("_f.depth") < o["depth"]) | ((c("_f.depth") == o["depth"]) & (c("_f.object_id") < o["object_id"]))
    both = front.select(*key, "_f", F.explode(F.filter("_all", behind)).alias("_b"))
    both = both.select(*key, c("_f.object_id").alias("front"), c("_b.object_id").alias("back"), c("_f.depth").alias("front_depth"), c("_b.depth").alias("back_depth"))
    return both.groupBy(*key, "front", "back").agg(F.count(F.lit(1)).alias("overlap"), F.min("front_depth").alias("front_depth"), F.min("back_depth").alias("back_depth"))


def chamfer(left: DataFrame, right: DataFrame, key: list[str], diagonal: float) -> DataFrame:
    """Symmetric mean nearest distance of two boundaries in diagonals. Both: key, x, y.

    Each boundary is one array (contours are sampled to some hundred points), so pairs are only ever looked at inside an expression.
    """
    side = lambda d, name: d.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias(name))
    both = side(left, "_l").join(side(right, "_r"), key)

    def nearest(one: str, other: str):
        square = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
        least = F.transform(one, lambda p: F.sqrt(F.array_min(F.transform(other, lambda q: square(p, q)))))
        return F.aggregate(least, F.lit(0.0), lambda s, d: s + d) / F.size(one)

    return both.select(*key, ((nearest("_l", "_r") + nearest("_r", "_l")) / 2 / diagonal).alias("distance"))


def metric_size(rows: DataFrame) -> DataFrame:
    """Physical extent h Z / f against a prior interval, as a log distance. Rows: pixels, depth, focal, low, high."""
    size = F.when((F.col("depth") > 0) & (F.col("focal") > 0), F.col("pixels") * F.col("depth") / F.col("focal"))
    return rows.withColumn("size", size).withColumn("residual", F.when(F.col("size") > 0, interval_distance(F.ln("size"), F.ln("low"), F.ln("high"))))


def smooth_heatmap(heat: DataFrame, radius: int = 2, sigma: float = 1.0) -> DataFrame:
    """Gaussian blur of a sparse raster (video_id, frame, row, col, value), scaled to a maximum of 1 in each frame."""
    import math

    kernel = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    total = sum(w for *_, w in kernel)
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w / total).alias("w")) for i, j, w in kernel]))
    # Dealt by frames before the kernel multiplies the rows: neither their sums nor the maximum moves them again.
    heat = stored(heat.select("video_id", "frame", "row", "col", "value"), "heat")
    heat = heat.repartition(parts(heat.sparkSession, heat.count(), 1_000_000 // len(kernel)), "video_id", "frame")
    out = heat.select("*", spread.alias("k")).groupBy("video_id", "frame", (F.col("row") + F.col("k.i")).alias("row"), (F.col("col") + F.col("k.j")).alias("col")).agg(F.sum(F.col("value") * F.col("k.w")).alias("value"))
    most = F.max("value").over(Window.partitionBy("video_id", "frame"))
    return out.withColumn("_m", most).withColumn("value", F.when(F.col("_m") > 0, F.col("value") / F.col("_m")).otherwise(F.lit(0.0))).drop("_m")
