"""Pairs, graphs and events: scale-depth residuals, relation graphs and reappearance.

Pair joins always have an equality on the frame (or group), so no pair crosses frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.stats import array_median, interval_distance
from tessella.session import parts


def _sides(objects: DataFrame, group: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    side = lambda s: objects.select(group, *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return side("a"), side("b")


def scale_depth_pairs(objects: DataFrame, group: str, log: bool = False, eps: float = 1e-9) -> DataFrame:
    """Residual of every ordered pair of a frame: how far the ratio of (projected size x depth) lies outside the priors' ratio interval.

    Objects: group, object_id, projected, depth, low, high (prior sizes).
    """
    a, b = _sides(objects, group, ["object_id", "projected", "depth", "low", "high"])
    pairs = a.join(b, group).where("object_id_a <> object_id_b")
    ratio = (F.col("projected_a") * F.col("depth_a")) / (F.col("projected_b") * F.col("depth_b") + eps)
    low, high = F.col("low_a") / F.col("high_b"), F.col("high_a") / F.col("low_b")
    residual = interval_distance(F.ln(ratio + eps), F.ln(low), F.ln(high)) if log else interval_distance(ratio, low, high)
    return pairs.select(group, F.col("object_id_a").alias("object_a"), F.col("object_id_b").alias("object_b"), ratio.alias("ratio"), residual.alias("residual"))


def leave_one_out_scale(objects: DataFrame, group: str) -> DataFrame:
    """Each object's size times the median scale (prior middle / observed) of the others, against its own prior.

    Objects: group, object_id, observed, low, high.
    """
    o = objects.withColumn("scale", (F.col("low") + F.col("high")) / 2 / F.col("observed"))
    peers = o.groupBy(group).agg(F.collect_list(F.struct("object_id", "scale")).alias("_all"))  # the objects of one frame
    others = F.transform(F.filter("_all", lambda x: x["object_id"] != F.col("object_id")), lambda x: x["scale"])
    out = o.join(peers, group).withColumn("scene_scale", array_median(others))
    estimate = F.col("observed") * F.col("scene_scale")
    return out.select(group, "object_id", "scene_scale", interval_distance(estimate, F.col("low"), F.col("high")).alias("residual"))


def relation_graph(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Every unordered pair of a frame's nodes: distance, bearing cosine, depth order and midpoint.

    Nodes: by..., node_id, p (struct).
    """
    a = nodes.select(*by, F.col("node_id").alias("a"), F.col("p").alias("pa"))
    b = nodes.select(*by, F.col("node_id").alias("b"), F.col("p").alias("pb"))
    pairs = a.join(b, by).where("a < b")
    d = G.distance(F.col("pa"), F.col("pb"))
    return pairs.select(
        *by,
        "a",
        "b",
        d.alias("distance"),
        F.when(d > 0, (F.col("pb.x") - F.col("pa.x")) / d).alias("bx"),
        F.when(d > 0, (F.col("pb.y") - F.col("pa.y")) / d).alias("by"),
        F.when(d > 0, (F.col("pb.z") - F.col("pa.z")) / d).alias("bz"),
        F.signum(F.col("pb.z") - F.col("pa.z")).alias("depth_order"),
    )


def orientation_angles(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Angle between the orientations of every pair of a frame's nodes, over pi. Nodes: keys, node_id, o (struct x, y, z; NULL unknown)."""
    a, b = (nodes.where("o IS NOT NULL").select(*keys, F.col("node_id").alias(s), F.col("o").alias(f"o{s}")) for s in "ab")
    length = lambda v: F.sqrt(v["x"] ** 2 + v["y"] ** 2 + v["z"] ** 2)
    u, v = F.col("oa"), F.col("ob")
    cos = (u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]) / (length(u) * length(v))
    return a.join(b, keys).where("a < b").select(*keys, "a", "b", (F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))) / F.pi()).alias("angle"))


def boundary_radii(objects: DataFrame, boundary: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 90th percentile of the distances of an object's boundary points from its centre; objects without a positive median don't appear.

    Objects: keys, p, confidence. Boundary: keys, p, confidence; any number of points.
    """
    points = boundary.select(*keys, F.col("p").alias("_q"), F.col("confidence").alias("_c"))
    rows = objects.join(points, keys).withColumn("_r", G.distance(F.col("p"), F.col("_q")))
    out = rows.groupBy(*keys).agg(F.median("_r").alias("median_radius"), F.percentile("_r", 0.9).alias("p90_radius"), F.least(F.first("confidence"), F.median("_c")).alias("confidence"), F.count(F.lit(1)).alias("points"))
    return out.where("median_radius > 0")


def structure_edges(points: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Length of every fixed edge in a frame, and over the median length of its object there (rigidity).

    Points: keys, object_id, node_id, p. Edges: object_id, edge_id, a, b. An edge with a missing end or no length doesn't appear.
    """
    at = lambda s: points.select(*keys, "object_id", F.col("node_id").alias(s), F.col("p").alias(f"p{s}"))
    rows = edges.join(at("a"), ["object_id", "a"]).join(at("b"), [*keys, "object_id", "b"])
    rows = rows.select(*keys, "object_id", "edge_id", G.distance(F.col("pa"), F.col("pb")).alias("length")).where("length > 0")
    middle = rows.groupBy(*keys, "object_id").agg(F.median("length").alias("_m"))
    return rows.join(middle, [*keys, "object_id"]).withColumn("rigidity", F.col("length") / F.col("_m")).drop("_m")


def relation_diff(graph: DataFrame, key: str, eps: float = 1e-9) -> DataFrame:
    """Relations of each frame against the frame before: |ln distance ratio|, bearing angle / pi and depth-order flip.

    A relation that only one of the frames has gives a row with a reason and no value.
    """
    now = graph.select(key, "frame_index", "a", "b", *[F.col(c).alias(f"{c}1") for c in ("distance", "bx", "by", "bz", "depth_order")])
    before = graph.select(key, (F.col("frame_index") + 1).alias("frame_index"), "a", "b", *[F.col(c).alias(f"{c}0") for c in ("distance", "bx", "by", "bz", "depth_order")])
    both = now.join(before, [key, "frame_index", "a", "b"], "full_outer")
    seen = F.col("distance1").isNotNull() & F.col("distance0").isNotNull()
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("bx1") * F.col("bx0") + F.col("by1") * F.col("by0") + F.col("bz1") * F.col("bz0")))
    return both.select(
        key,
        "frame_index",
        "a",
        "b",
        F.when(seen, F.abs(F.ln((F.col("distance1") + eps) / (F.col("distance0") + eps)))).alias("distance_change"),
        F.when(seen, F.acos(cos) / F.pi()).alias("bearing_change"),
        F.when(seen, (F.col("depth_order1") * F.col("depth_order0") < 0).cast("double")).alias("order_flip"),
        F.when(seen, "").otherwise("relation_not_observed_in_both_frames").alias("reason"),
    )


def knn_edges(points: DataFrame, group: str, k: int) -> DataFrame:
    """Undirected edges from each point to its k nearest in the group's first frame."""
    first = points.withColumn("_f", F.min("frame_index").over(Window.partitionBy(group))).where("frame_index = _f")
    a = first.select(group, F.col("point_id").alias("a"), F.col("p").alias("pa"))
    b = first.select(group, F.col("point_id").alias("b"), F.col("p").alias("pb"))
    near = a.join(b, group).where("a <> b").withColumn("distance", G.distance(F.col("pa"), F.col("pb")))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy(group, "a").orderBy("distance", "b"))).where(F.col("_r") <= k)
    return near.groupBy(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("distance").alias("reference"))


def structure_change(edges: DataFrame, points: DataFrame, group: str, top: float = 0.25) -> DataFrame:
    """Change of the fixed edges' lengths in every frame: mean, and mean of the greatest quarter."""
    at = lambda s: points.select(group, "frame_index", F.col("point_id").alias(s), F.col("p").alias(f"p{s}"))
    rows = edges.join(at("a"), [group, "a"]).join(at("b"), [group, "frame_index", "b"])
    rows = rows.withColumn("change", F.abs(G.distance(F.col("pa"), F.col("pb")) - F.col("reference")))
    by = Window.partitionBy(group, "frame_index")
    rows = rows.withColumn("_r", F.row_number().over(by.orderBy(F.desc("change"), "a", "b"))).withColumn("_n", F.count(F.lit(1)).over(by))
    return rows.groupBy(group, "frame_index").agg(F.avg("change").alias("mean_change"), F.avg(F.when(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(top))), F.col("change"))).alias("top_change"), F.count(F.lit(1)).alias("edges"))


def reappearance(rows: DataFrame, least: float = 0.60, cross: float = 0.85) -> DataFrame:
    """1 - mean of four similarities; accepted from 0.60, across identities from 0.85.

    Rows: appearance, structure, depth, motion, same_id, label_match, scene_cut.
    """
    mean = (F.col("appearance") + F.col("structure") + F.col("depth") + F.col("motion")) / 4
    ok = F.col("label_match") & ~F.col("scene_cut") & (mean >= F.when(F.col("same_id"), F.lit(least)).otherwise(F.lit(cross)))
    return rows.withColumn("quality", mean).withColumn("accepted", ok).withColumn("residual", F.when(ok, 1 - mean))


def depth_order_violation(rows: DataFrame) -> DataFrame:
    """max(0, front - back + uncertainty) over their mean: the occluder must not lie behind."""
    v = F.greatest(F.lit(0.0), F.col("front_depth") - F.col("back_depth") + F.col("uncertainty")) / ((F.col("front_depth") + F.col("back_depth")) / 2)
    return rows.withColumn("residual", v)


def box_overlap3(boxes: DataFrame, group: str) -> DataFrame:
    """Overlap volume over the smaller volume of every pair of axis-aligned boxes of a frame."""
    cols = ["box_id", "x1", "y1", "z1", "x2", "y2", "z2"]
    a, b = _sides(boxes, group, cols)
    pairs = a.join(b, group).where("box_id_a < box_id_b")
    over = F.lit(1.0)
    for c in "xyz":
        over = over * F.greatest(F.lit(0.0), F.least(f"{c}2_a", f"{c}2_b") - F.greatest(f"{c}1_a", f"{c}1_b"))
    volume = lambda s: (F.col(f"x2_{s}") - F.col(f"x1_{s}")) * (F.col(f"y2_{s}") - F.col(f"y1_{s}")) * (F.col(f"z2_{s}") - F.col(f"z1_{s}"))
    least = F.least(volume("a"), volume("b"))
    return pairs.select(group, F.col("box_id_a").alias("a"), F.col("box_id_b").alias("b"), F.when(least > 0, over / least).otherwise(F.lit(0.0)).alias("overlap"))


def bind_points(points: DataFrame, boxes: DataFrame, least: float = 0.6) -> DataFrame:
    """The one object whose boxes hold a point in most of its frames.

    Points: video_id, point_id, frame_index, u, v. Boxes: video_id, frame_index, object_id, x1, y1, x2, y2.
    Several owners make the binding invalid, none means background. Points and boxes are dealt by videos together, once; those of a frame meet in one row.
    """
    c = F.col
    kinds = dict(points.dtypes)
    none = lambda kind: F.lit(None).cast(kind)
    box = F.struct("object_id", "x1", "y1", "x2", "y2").alias("_box")
    boxes = boxes.where("video_id IS NOT NULL AND frame_index IS NOT NULL AND object_id IS NOT NULL").select("video_id", "frame_index", none("int").alias("_r"), none(kinds["point_id"]).alias("point_id"), none(kinds["u"]).alias("u"), none(kinds["v"]).alias("v"), box)
    own = points.select("video_id", "frame_index", F.lit(1).alias("_r"), "point_id", "u", "v", none(dict(boxes.dtypes)["_box"]).alias("_box"))
    rows = own.unionByName(boxes).repartition(parts(points.sparkSession, points.count(), 100_000), "video_id")
    met = rows.groupBy("video_id", "frame_index").agg(F.collect_list("_box").alias("_boxes"), F.collect_list(F.when(c("_r") == 1, F.struct("point_id", "u", "v"))).alias("_points"))
    met = met.select("video_id", "frame_index", "_boxes", F.explode("_points").alias("_p"))  # what has no name has no owner
    holds = lambda b: c("_p.point_id").isNotNull() & c("_p.u").between(b["x1"], b["x2"]) & c("_p.v").between(b["y1"], b["y2"])
    owner = F.array_min(F.transform(F.filter("_boxes", holds), lambda b: b["object_id"]))
    frames = met.select("video_id", "frame_index", c("_p.point_id").alias("point_id"), owner.alias("object_id")).groupBy("video_id", "point_id", "frame_index").agg(F.min("object_id").alias("object_id"), F.count(F.lit(1)).alias("_n"))
    out = frames.groupBy("video_id", "point_id").agg(F.min("object_id").alias("owner"), F.max("object_id").alias("_other"), F.count("object_id").alias("owned"), F.sum("_n").alias("frames"))
    state = F.when(c("owner").isNull(), "background").when(c("owner") != c("_other"), "object_assignment_switched").when(c("owned") / c("frames") < least, "inconsistent").otherwise("bound")
    return out.withColumn("state", state).select("video_id", "point_id", F.when(c("state") == "bound", c("owner")).alias("object_id"), (c("owned") / c("frames")).alias("consistency"), "state")
