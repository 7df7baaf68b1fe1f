"""Rasters as rows: erosion, distances to the edge, contours, spaced points, warps and frame hashes.

A mask is its pixels (key, row, col); a frame its grey values (key, row, col, gray). Neighbourhoods come from windows over rows and
columns, contours from pointer doubling over the mask's edges, selections from rounds over a grid: nothing
pairs all pixels of a mask, and no mask has to fit into one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import parts, stored


def adaptive_erosion(area: Column, least: int = 1, most: int = 4) -> Column:
    """Pixels to erode by the mask's size: a fiftieth of the root of its area, rounded half to even, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.rint(0.02 * F.sqrt(area)).cast("int")))


def _islands(mask: DataFrame, key: list[str], line: str, along: str, first: str, last: str) -> DataFrame:
    """``mask`` with the first and last pixel of the run that holds each pixel along a line."""
    by = Window.partitionBy(*key, line).orderBy(along)
    run = F.col(along) - F.row_number().over(by)
    held = Window.partitionBy(*key, line, "_run")
    return mask.withColumn("_run", run).withColumn(first, F.min(along).over(held)).withColumn(last, F.max(along).over(held)).drop("_run")


def erode(mask: DataFrame, key: list[str], pixels: Column | int, width: int, height: int) -> DataFrame:
    """Pixels whose whole square of ``pixels`` to every side lies in the mask; what lies outside the frame doesn't count.

    The square is a run along the row, then one along the column of what is left.
    """
    e = F.lit(pixels) if isinstance(pixels, int) else pixels
    rows = mask.select(*key, "row", "col", e.cast("int").alias("_e")).distinct()
    rows = _islands(rows, key, "row", "col", "_a", "_b")
    whole = lambda at, end: ((F.col("_a") == 0) | (F.col(at) - F.col("_a") >= F.col("_e"))) & ((F.col("_b") == end) | (F.col("_b") - F.col(at) >= F.col("_e")))
    rows = rows.where(whole("col", width - 1)).drop("_a", "_b")
    return _islands(rows, key, "col", "row", "_a", "_b").where(whole("row", height - 1)).select(*key, "row", "col")


def edge_distance(mask: DataFrame, key: list[str], width: int, height: int) -> DataFrame:
    """``distance`` of every pixel of a mask: steps along rows and columns to the nearest pixel of the frame outside it (NULL: none).

    A pixel's distance along its row, then running minima down and up its column's run: behind the run's end another
    run's pixels are farther than the gap.
    """
    c = F.col
    rows = _islands(mask.select(*key, "row", "col").distinct(), key, "row", "col", "_a", "_b")
    along = F.least(F.when(c("_a") > 0, c("col") - c("_a") + 1), F.when(c("_b") < width - 1, c("_b") - c("col") + 1))
    rows = _islands(rows.withColumn("_g", along).drop("_a", "_b"), key, "col", "row", "_a", "_b")
    run = Window.partitionBy(*key, "col", "_a")
    down = F.min(c("_g") - c("row")).over(run.orderBy("row")) + c("row")
    up = F.min(c("_g") + c("row")).over(run.orderBy(F.desc("row"))) - c("row")
    ends = F.least(F.when(c("_a") > 0, c("row") - c("_a") + 1), F.when(c("_b") < height - 1, c("_b") - c("row") + 1))
    return rows.select(*key, "row", "col", F.least(down, up, ends).cast("int").alias("distance"))


# --- contours ------------------------------------------------------------------------------------

#: Sides of a pixel, going round with the pixel on the right hand in image coordinates: (from, to) corners as (row, col) offsets.
_SIDES = (((0, 0), (0, 1)), ((0, 1), (1, 1)), ((1, 1), (1, 0)), ((1, 0), (0, 0)))
#: The pixel beyond each side.
_BEYOND = ((-1, 0), (0, 1), (1, 0), (0, -1))


#: Pixels or edges of a mask in one partition, about.
PIXELS = 100_000


def contour_edges(mask: DataFrame, key: list[str]) -> DataFrame:
    """The mask's directed boundary edges: key, row, col, side, and the edge that follows (next_row, next_col, next_side).

    An edge is a side of a pixel whose neighbour there is outside. Where two edges leave a corner, pixels that touch
    there count as joined (8-neighbours): the walk turns towards the other pixel.
    """
    c = F.col
    pixels = stored(mask.select(*key, "row", "col"), "contour-pixels")
    n = parts(pixels.sparkSession, pixels.count(), PIXELS)
    deal = lambda df: df.repartition(n, *key, "row", "col")
    pixels = deal(pixels).distinct()
    around = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    spread = pixels.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(-dr).alias("r"), F.lit(-dc).alias("c"), F.lit(1 << i).alias("bit")) for i, (dr, dc) in enumerate(around)])))
    near = deal(spread.select(*key, (c("row") + c("_o.r")).alias("row"), (c("col") + c("_o.c")).alias("col"), c("_o.bit").alias("bit"))).groupBy(*key, "row", "col").agg(F.sum("bit").alias("near"))
    bit = {o: 1 << i for i, o in enumerate(around)}
    has = lambda o: c("near").bitwiseAND(F.lit(bit[o])) != 0
    rows = pixels.join(near, [*key, "row", "col"], "left").na.fill(0, ["near"])
    sides = []
    for side, out in enumerate(_BEYOND):
        # Ahead along the side: the next pixel in that direction, and the one diagonally beyond it.
        step = _BEYOND[(side + 1) % 4]
        ahead, corner = step, (out[0] + step[0], out[1] + step[1])
        here = lambda o, s: F.struct((c("row") + o[0]).alias("row"), (c("col") + o[1]).alias("col"), F.lit(s).alias("side"))
        following = F.when(has(corner), here(corner, (side + 3) % 4)).when(has(ahead), here(ahead, side)).otherwise(here((0, 0), (side + 1) % 4))
        sides.append(F.when(~has(out), F.struct(F.lit(side).alias("side"), following.alias("next"))))
    edges = rows.select(*key, "row", "col", F.explode(F.filter(F.array(*sides), lambda e: e.isNotNull())).alias("e"))
    return edges.select(*key, "row", "col", "e.side", c("e.next.row").alias("next_row"), c("e.next.col").alias("next_col"), c("e.next.side").alias("next_side"))


def trace_contours(mask: DataFrame, key: list[str]) -> DataFrame:
    """Every boundary edge with its loop and place: key, row, col, side, loop (its least edge), place (from 0), length.

    Pointer doubling: after k rounds an edge knows the least of the 2^k edges from it on and how far that is, so
    a loop of n edges takes log2(n) rounds of one join each, wherever its edges lie. Partitions are as many as the edges ask for.
    """
    c = F.col
    code = lambda r, k, s: (r.cast("long") * F.lit(1 << 31) + k.cast("long")) * 4 + s
    edges = contour_edges(mask, key).select(*key, code(c("row"), c("col"), c("side")).alias("e"), code(c("next_row"), c("next_col"), c("next_side")).alias("next"))
    now = stored(edges.withColumn("best", c("e")).withColumn("steps", F.lit(0).cast("long")), "contour-0")
    n = parts(now.sparkSession, now.count(), PIXELS)
    longest = now.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach < longest:
        ahead = now.repartition(n, *key, "e").select(*key, c("e").alias("next"), c("next").alias("_next"), c("best").alias("_best"), c("steps").alias("_steps"))
        nearer = c("_best") < c("best")
        now = stored(
            now.repartition(n, *key, "next").join(ahead, [*key, "next"]).select(*key, "e", c("_next").alias("next"), F.least("best", "_best").alias("best"), F.when(nearer, c("_steps") + reach).otherwise(c("steps")).alias("steps")),
            f"contour-{reach}",
        )
        reach *= 2
    loop = Window.partitionBy(*key, "best")
    out = now.repartition(n, *key, "best").withColumn("length", F.count(F.lit(1)).over(loop))
    pixel = F.floor(c("e") / 4)
    return out.select(
        *key, F.floor(pixel / (1 << 31)).cast("int").alias("row"), (pixel % (1 << 31)).cast("int").alias("col"), (c("e") % 4).cast("int").alias("side"), c("best").alias("loop"), ((c("length") - c("steps")) % c("length")).alias("place"), "length"
    )


def sample_contour(mask: DataFrame, key: list[str], most: int = 32, spacing: float = 4.0) -> DataFrame:
    """key, sample (from 0), row, col: points spaced evenly along the pixel centres of each mask's largest outer contour.

    As many as ``most``, or as fit at ``spacing`` (at least one). Arc lengths are prefix sums along the loop; a segment gives the samples that fall on it.
    """
    c = F.col
    edges = stored(trace_contours(mask, key), "contours")
    edges = edges.repartition(parts(edges.sparkSession, edges.count(), PIXELS), *key, "loop")
    by = Window.partitionBy(*key, "loop").orderBy("place")
    # A walk stays on a pixel for its sides in a row: one vertex each.
    before = F.struct(F.lag("row").over(by).alias("r"), F.lag("col").over(by).alias("c"))
    ends = Window.partitionBy(*key, "loop").orderBy(F.desc("place"))
    edges = edges.withColumn("_p", before).withColumn("_last", F.struct(F.first("row").over(ends).alias("r"), F.first("col").over(ends).alias("c")))
    came = F.when(c("place") == 0, c("_last")).otherwise(c("_p"))
    alone = (c("length") == 4) & (c("place") == 0)  # a single pixel comes from itself all the way round
    vertices = edges.withColumn("_came", came).where((c("_came.r") != c("row")) | (c("_came.c") != c("col")) | alone).select(*key, "loop", "place", "row", "col")
    whole = Window.partitionBy(*key, "loop")
    following = F.coalesce(F.lead(F.struct("row", "col")).over(by), F.first(F.struct("row", "col")).over(by))
    v = vertices.withColumn("_to", following)
    v = v.withColumn("_cross", (c("col") * c("_to.row") - c("_to.col") * c("row")).cast("double")).withColumn("_size", F.sqrt((c("_to.row") - c("row")) ** 2 + (c("_to.col") - c("col")) ** 2))
    v = v.withColumn("_area", F.sum("_cross").over(whole) / 2).withColumn("perimeter", F.sum("_size").over(whole)).withColumn("_from", F.coalesce(F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # Outer loops go round clockwise (rows grow downwards): their area is positive, that of holes negative.
    best = v.groupBy(*key, "loop").agg(F.first("_area").alias("a")).groupBy(*key).agg(F.max(F.struct("a", (-c("loop")).alias("l"))).alias("b")).select(*key, (-c("b.l")).alias("loop"))
    v = v.join(best, [*key, "loop"])
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(c("perimeter") / spacing))).cast("int")
    v = v.withColumn("_step", c("perimeter") / count).withColumn("_n", count)
    low = F.ceil(F.when(c("perimeter") > 0, c("_from") / c("_step") - 1e-9).otherwise(F.lit(0.0)))
    high = F.when(c("perimeter") > 0, F.least(F.ceil((c("_from") + c("_size")) / c("_step") - 1e-9), c("_n")) - 1).otherwise(F.lit(0))
    v = v.withColumn("_lo", low).withColumn("_hi", high).where("_lo <= _hi").withColumn("sample", F.explode(F.sequence(c("_lo"), c("_hi"))))
    part = F.when(c("_size") > 0, (c("sample") * c("_step") - c("_from")) / c("_size")).otherwise(F.lit(0.0))
    return v.select(*key, c("sample").cast("int").alias("sample"), (c("row") + part * (c("_to.row") - c("row"))).alias("row"), (c("col") + part * (c("_to.col") - c("col"))).alias("col"))


# --- points --------------------------------------------------------------------------------------


def spaced_points(points: DataFrame, key: list[str], distance: float, most: int | None = None) -> DataFrame:
    """The points that a greedy walk by (score descending, point_id) keeps, each at least ``distance`` from all kept before it,
    the first ``most`` of a key. Points: key, point_id, row, col, score.

    With ``most``, keys are sorted and walked as a stream: a task holds one batch of rows and the points kept of one key, and no pairs
    are made. Without it, by rounds: a point without a better live point nearby is kept, and those near it leave. Points meet those of
    their own and the adjacent cells of a grid once; a round only moves ids. Rounds are as many as the longest chain of falling scores in which each is near the next.
    """
    plain = points.select(*key, "point_id", *[F.col(x).cast("double").alias(x) for x in ("row", "col", "score")])
    if most is None:
        return _spaced_by_rounds(plain, key, distance)

    def walk(batches):
        now, kept, count = None, np.zeros((0, 2)), 0
        for pdf in batches:
            if not len(pdf):
                continue
            at, ids = pdf[["row", "col"]].to_numpy(float), list(zip(*(pdf[k].tolist() for k in key), strict=True))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            picks, places = [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if ids[lo] != now:
                    now, kept, count = ids[lo], np.zeros((0, 2)), 0
                free = np.ones(hi - lo, bool)
                for row, col in kept:
                    free &= ~((at[lo:hi, 0] - row) ** 2 + (at[lo:hi, 1] - col) ** 2 < distance * distance)
                while count < most and free.any():
                    i = lo + int(free.argmax())
                    picks.append(i)
                    places.append(count)
                    kept, count = np.vstack([kept, at[i]]), count + 1
                    free[i - lo] = False
                    free &= ~((at[lo:hi, 0] - at[i, 0]) ** 2 + (at[lo:hi, 1] - at[i, 1]) ** 2 < distance * distance)
            yield pdf.iloc[picks].assign(place=np.array(places, np.int32))

    kinds = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    plain = plain.dropna(subset=[*key, "point_id"])  # a key or id that is missing names nothing
    return plain.repartition(*key).sortWithinPartitions(*key, F.desc("score"), "point_id").mapInPandas(walk, f"{kinds}, place int")


def _spaced_by_rounds(p: DataFrame, key: list[str], distance: float) -> DataFrame:
    c = F.col
    cell = lambda x: F.floor(c(x) / distance)
    p = stored(p, "points")
    wide = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = p.select(*key, c("point_id").alias("a"), c("row").alias("_ra"), c("col").alias("_ca"), c("score").alias("_sa"), cell("row").alias("_i"), cell("col").alias("_j"))
    right = p.withColumn("_o", wide).select(*key, c("point_id").alias("b"), c("row").alias("_rb"), c("col").alias("_cb"), c("score").alias("_sb"), (cell("row") + c("_o.i")).alias("_i"), (cell("col") + c("_o.j")).alias("_j"))
    close = (c("_ra") - c("_rb")) ** 2 + (c("_ca") - c("_cb")) ** 2 < distance * distance
    better = (c("_sa") > c("_sb")) | ((c("_sa") == c("_sb")) & (c("a") < c("b")))
    edges = stored(left.join(right, [*key, "_i", "_j"]).where(close & better).select(*key, "a", "b"), "conflicts")
    live, kept = p.select(*key, "point_id"), None
    while True:
        top = stored(live.join(edges.select(*key, c("b").alias("point_id")).distinct(), [*key, "point_id"], "left_anti"), "kept")
        kept = top if kept is None else kept.unionByName(top)
        out = edges.join(top.withColumnRenamed("point_id", "a"), [*key, "a"], "left_semi").select(*key, c("b").alias("point_id")).distinct()
        gone = stored(out.unionByName(top), "gone")
        live = stored(live.join(gone, [*key, "point_id"], "left_anti"), "live")
        if live.isEmpty():
            break
        drop = gone.select(*key, c("point_id").alias("_g"))
        edges = stored(edges.join(drop, [*[edges[k] == drop[k] for k in key], edges["a"] == drop["_g"]], "left_anti").join(drop, [*[edges[k] == drop[k] for k in key], edges["b"] == drop["_g"]], "left_anti"), "conflicts")
    out = p.join(kept, [*key, "point_id"])
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "point_id"))
    return out.withColumn("place", (place - 1).cast("int"))


# --- warps and hashes ----------------------------------------------------------------------------


def warp(mask: DataFrame, key: list[str], matrix: str, width: int, height: int) -> DataFrame:
    """A mask under a projective map of (col, row), by inverse mapping to the nearest source pixel.

    ``matrix`` names a column of the mask: nine numbers by rows, target = M source, one for each key (an affine map ends in 0, 0, 1; a
    rotating camera's is K R inverse(K)). Only target pixels within the mapped bounding box of the mask are looked at; a singular
    or non-finite matrix gives nothing.
    """
    c = F.col
    m = lambda i: F.get(matrix, F.lit(i)).cast("double")
    box = mask.groupBy(*key).agg(F.first(matrix).alias(matrix), *[f(x).alias(f"_{n}{x}") for x in ("row", "col") for n, f in (("a", F.min), ("b", F.max))])
    # The adjugate, which maps back up to a factor.
    minor = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    box = box.withColumn("_inv", F.array(*[m(a) * m(b) - m(p) * m(q) for a, b, p, q in minor]))
    determinant = m(0) * F.get("_inv", F.lit(0)) + m(1) * F.get("_inv", F.lit(3)) + m(2) * F.get("_inv", F.lit(6))
    box = box.where((F.abs(determinant) > 1e-12) & (F.abs(determinant) < float("inf")))

    def through(x: Column, y: Column) -> Column:
        return F.struct((m(0) * x + m(1) * y + m(2)).alias("x"), (m(3) * x + m(4) * y + m(5)).alias("y"), (m(6) * x + m(7) * y + m(8)).alias("w"))

    corners = F.array(*[through(x, y) for x in (c("_acol") - 0.5, c("_bcol") + 0.5) for y in (c("_arow") - 0.5, c("_brow") + 0.5)])
    box = box.withColumn("_c", corners)
    tame = F.forall("_c", lambda p: p["w"] > 1e-9)  # a box that crosses the horizon may land anywhere in the frame
    low = lambda x, end: F.when(tame, F.greatest(F.lit(0), F.floor(F.array_min(F.transform("_c", lambda p: p[x] / p["w"]))).cast("int"))).otherwise(F.lit(0))
    high = lambda x, end: F.when(tame, F.least(F.lit(end), F.ceil(F.array_max(F.transform("_c", lambda p: p[x] / p["w"]))).cast("int"))).otherwise(F.lit(end))
    box = box.select(*key, "_inv", low("y", height - 1).alias("_r0"), high("y", height - 1).alias("_r1"), low("x", width - 1).alias("_c0"), high("x", width - 1).alias("_c1")).where("_r0 <= _r1 AND _c0 <= _c1")
    target = box.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    inv = lambda i: F.get("_inv", F.lit(i))
    w = inv(6) * c("col") + inv(7) * c("row") + inv(8)
    back = lambda i: F.floor((inv(i) * c("col") + inv(i + 1) * c("row") + inv(i + 2)) / w + 0.5).cast("int")
    target = target.where(F.abs(w) > 1e-12).select(*key, "row", "col", back(3).alias("_sr"), back(0).alias("_sc"))
    source = mask.select(*key, c("row").alias("_sr"), c("col").alias("_sc")).distinct()
    return target.join(source, [*key, "_sr", "_sc"]).select(*key, "row", "col")


#: How a support was predicted, and why it couldn't be.
TRANSLATED, TURNED, UNTURNED, PROJECTED = "history_mask_constant_translation", "rotation_compensated_history_mask_warp", "rotation_mode_2d_history_motion_only", "full_se3_history_support_projection"


def predict_supports(masks: DataFrame, frames: DataFrame, objects: DataFrame, projected: DataFrame, key: list[str], width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Where objects should be in a later frame under each geometry mode: (one row an object, the predicted pixels).

    Objects: key, target_frame, mode (unavailable, static_camera_3d, rotation_compensated, full_se3_3d), motion_u, motion_v (a motion prior in pixels between the
    last two masks; NULL: their centres' shift), rotation (six numbers of an affine map of (col, row), or NULL), has_projection. Frames: key, frame_index,
    confidence, legacy, for every valid mask. Masks: key, frame_index, row, col. Projected: key, row, col of a full projection.

    The last mask before the target moves on at the speed of the last two, then turns with the camera where its rotation is known; a full projection is
    taken as it is. Gives history (frames), method, predicted_area, support_area, in_frame_ratio, quality, reason. Nothing of the target frame is looked at.
    """
    c = F.col
    past = frames.join(objects.select(*key, "target_frame"), key).where("frame_index < target_frame")
    two = past.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("frame_index")))).where("_r <= 2")
    centre = masks.groupBy(*key, "frame_index").agg(F.avg("col").alias("_u"), F.avg("row").alias("_v"), F.count(F.lit(1)).alias("_area"))
    pick = lambda r, x: F.max(F.when(c("_r") == r, c(x)))
    last = two.join(centre, [*key, "frame_index"]).groupBy(*key).agg(
        F.count(F.lit(1)).cast("int").alias("history"), *[pick(r, x).alias(f"{x}{r}") for r in (1, 2) for x in ("frame_index", "_u", "_v", "_area")], F.min("confidence").alias("_q"), F.max(c("legacy").cast("int")).alias("_legacy")
    )
    whole = projected.groupBy(*key).agg(F.count_if(c("row").between(0, height - 1) & c("col").between(0, width - 1)).alias("_projected"))
    o = objects.join(last, key, "left").join(whole, key, "left").na.fill(0, ["history", "_projected"])
    ahead = (c("target_frame") - c("frame_index1")) / (c("frame_index1") - c("frame_index2"))
    given = c("motion_u").isNotNull() & c("motion_v").isNotNull()
    shift = lambda x: F.when(given, c(f"motion_{x}")).otherwise(c(f"_{x}1") - c(f"_{x}2"))
    o = o.withColumn("_su", shift("u") * ahead).withColumn("_sv", shift("v") * ahead)
    turning = (c("mode") == "rotation_compensated") & c("rotation").isNotNull()
    r = lambda i: F.get("rotation", F.lit(i))
    sane = (F.size("rotation") == 6) & F.forall("rotation", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    full = c("mode") == "full_se3_3d"
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(c(x)) < float("inf")), F.lit(False))
    early = (
        F.when(c("history") == 0, "missing_mask_history").when(c("mode") == "unavailable", "dynamic_geometry_unavailable").when(c("history") < 2, "insufficient_mask_history")
        .when(full & ~c("has_projection"), "full_se3_support_projector_unavailable").when(full & (c("_projected") == 0), "invalid_full_se3_projected_support")
        .when(~full & ~(finite("_su") & finite("_sv")), "invalid_object_motion_translation").when(turning & ~sane, "invalid_rotation_affine").otherwise("")
    )
    o = o.withColumn("_early", early)
    plain = F.array(F.lit(1.0), F.lit(0.0), c("_su"), F.lit(0.0), F.lit(1.0), c("_sv"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    turned = F.array(r(0), r(1), r(0) * c("_su") + r(1) * c("_sv") + r(2), r(3), r(4), r(3) * c("_su") + r(4) * c("_sv") + r(5), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    moving = o.where((c("_early") == "") & ~full).select(*key, c("frame_index1").alias("frame_index"), F.when(turning, turned).otherwise(plain).alias("_matrix"))
    pixels = warp(masks.join(moving, [*key, "frame_index"]), key, "_matrix", width, height)
    inside = projected.join(o.where((c("_early") == "") & full).select(*key), key).where(c("row").between(0, height - 1) & c("col").between(0, width - 1)).select(*key, "row", "col")
    pixels = pixels.unionByName(inside)
    found = pixels.groupBy(*key).agg(F.count(F.lit(1)).alias("support_area"))
    out = o.join(found, key, "left").na.fill(0, ["support_area"])
    out = out.withColumn("reason", F.when((c("_early") == "") & (c("support_area") == 0), "predicted_support_outside_frame").otherwise(c("_early")))
    ok = c("reason") == ""
    method = F.when(full, PROJECTED).when(turning, TURNED).when(c("mode") == "rotation_compensated", UNTURNED).otherwise(TRANSLATED)
    quality = F.when(c("_legacy") == 1, F.least("_q", F.lit(0.25))).otherwise(c("_q"))
    ratio = F.least(F.lit(1.0), c("support_area") / F.greatest("_area1", F.lit(1)))
    out = out.select(*key, "history", F.when(ok, method).otherwise("").alias("method"), F.when(ok, c("_area1")).alias("predicted_area"), F.when(ok, c("support_area")).alias("support_area"), F.when(ok, ratio).alias("in_frame_ratio"), F.when(ok, quality).otherwise(F.lit(0.0)).alias("quality"), "reason")
    return out, pixels


def frame_hash(frames: DataFrame, key: list[str], width: int, height: int, size: int = 8) -> DataFrame:
    """``hash``: size x size bits of a frame, whether each cell of its area-averaged size x (size + 1) picture is darker than the next.

    Every pixel adds its grey value to the cells that it overlaps, by the overlapping area; pixels that are missing count as 0. The
    first bit is the highest.
    """
    c = F.col

    def share(at: str, cells: int, length: int) -> Column:
        """Cells along one axis that a pixel overlaps, with the overlap."""
        a, b = c(at) * cells / F.lit(float(length)), (c(at) + 1) * cells / F.lit(float(length))
        first, last = F.floor(a).cast("int"), F.least(F.lit(cells - 1), F.ceil(b).cast("int") - 1)
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.struct(i.alias("i"), (F.least(b, i + 1) - F.greatest(a, i)).alias("w")))

    spread = frames.select(*key, "gray", F.explode(share("row", size, height)).alias("_r"), share("col", size + 1, width).alias("_c")).select(*key, "gray", "_r", F.explode("_c").alias("_k"))
    cells = spread.groupBy(*key, c("_r.i").alias("_i"), c("_k.i").alias("_j")).agg(F.sum(c("gray") * c("_r.w") * c("_k.w")).alias("_v"))
    # Sums of the same parts in another order differ in their last bits.
    rows = cells.groupBy(*key, "_i").agg(F.map_from_entries(F.collect_list(F.struct("_j", F.round("_v", 9).alias("v")))).alias("_m"))
    at = lambda j: F.coalesce(F.try_element_at("_m", F.lit(j)), F.lit(0.0))
    bits = F.lit(0).cast("long")
    for j in range(size):
        bits = bits * 2 + F.when(at(j + 1) > at(j), F.lit(1)).otherwise(F.lit(0))
    # Cells of a row are one byte; bytes stand side by side, the first row highest.
    shifted = F.lit(0).cast("long")
    for i in range(size):
        shifted = F.when(c("_i") == i, F.expr(f"shiftleft(_b, {size * (size - 1 - i)})")).otherwise(shifted)
    return rows.withColumn("_b", bits).groupBy(*key).agg(F.bit_or(shifted).alias("hash"))
