"""Pinhole and box geometry as column expressions (JVM side, in codegen).

Cameras are (fx, fy, cx, cy) columns or 3x3 row-major arrays, rigid transforms
4x4 row-major arrays, boxes structs with x1, y1, x2, y2. Invalid input gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def back_project(u: Column, v: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Camera point of a pixel at Z-depth z > 0."""
    return F.when(z > 0, point((u - cx) * z / fx, (v - cy) * z / fy, z))


def project(p: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel of a camera point in front of the camera."""
    return F.when(p["z"] > 0, F.struct((fx * p["x"] / p["z"] + cx).alias("u"), (fy * p["y"] / p["z"] + cy).alias("v")))


def transform(p: Column, t: Column) -> Column:
    """Point under a 4x4 rigid transform."""
    row = lambda i: F.get(t, F.lit(4 * i)) * p["x"] + F.get(t, F.lit(4 * i + 1)) * p["y"] + F.get(t, F.lit(4 * i + 2)) * p["z"] + F.get(t, F.lit(4 * i + 3))
    return point(row(0), row(1), row(2))


def matmul4(a: Column, b: Column) -> Column:
    """Product of two 4x4 row-major arrays."""
    cell = lambda i, j: sum((F.get(a, F.lit(4 * i + k)) * F.get(b, F.lit(4 * k + j)) for k in range(1, 4)), F.get(a, F.lit(4 * i)) * F.get(b, F.lit(j)))
    return F.array(*[cell(i, j) for i in range(4) for j in range(4)])


def inverse_rigid(t: Column) -> Column:
    """Inverse of a 4x4 rigid transform: the rotation transposed, the translation turned back."""
    g = lambda i, j: F.get(t, F.lit(4 * i + j))
    back = lambda j: -(g(0, j) * g(0, 3) + g(1, j) * g(1, 3) + g(2, j) * g(2, 3))
    rows = [x for j in range(3) for x in (g(0, j), g(1, j), g(2, j), back(j))]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def camera_center(t_world_from_camera: Column) -> Column:
    """Where a camera stands: the translation of its pose."""
    g = lambda i: F.get(t_world_from_camera, F.lit(i))
    return F.when(t_world_from_camera.isNotNull(), point(g(3), g(7), g(11)))


def predict_target(p: Column, t: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel in the target of a source point under the relative pose; NULL without a pose or behind the camera."""
    return F.when(t.isNotNull(), project(transform(p, t), fx, fy, cx, cy))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2)


def ray_to_z(d: Column, u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Z-depth of a ray length."""
    return d / F.sqrt(((u - cx) / fx) ** 2 + ((v - cy) / fy) ** 2 + 1)


def valid_intrinsics(k: Column) -> Column:
    """A 3x3 camera matrix: positive focal lengths, last row 0 0 1, not the identity."""
    g = lambda i: F.get(k, F.lit(i))
    identity = (g(0) == 1) & (g(4) == 1) & (g(2) == 0) & (g(5) == 0) & (g(1) == 0)
    return F.coalesce((F.size(k) == 9) & (g(0) > 0) & (g(4) > 0) & (g(6) == 0) & (g(7) == 0) & (g(8) == 1) & ~identity, F.lit(False))


def valid_rigid(t: Column, eps: float = 1e-6) -> Column:
    """A 4x4 transform with an orthonormal rotation of determinant 1 and last row 0 0 0 1."""
    g = lambda i, j: F.get(t, F.lit(4 * i + j))
    dots = [F.abs(sum((g(i, k) * g(j, k) for k in range(1, 3)), g(i, 0) * g(j, 0)) - (1.0 if i == j else 0.0)) <= eps for i in range(3) for j in range(i, 3)]
    det = g(0, 0) * (g(1, 1) * g(2, 2) - g(1, 2) * g(2, 1)) - g(0, 1) * (g(1, 0) * g(2, 2) - g(1, 2) * g(2, 0)) + g(0, 2) * (g(1, 0) * g(2, 1) - g(1, 1) * g(2, 0))
    ok = (F.size(t) == 16) & (F.abs(det - 1) <= eps) & (g(3, 0) == 0) & (g(3, 1) == 0) & (g(3, 2) == 0) & (g(3, 3) == 1)
    for d in dots:
        ok = ok & d
    return F.coalesce(ok, F.lit(False))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def center_distance(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Distance of the centres in frame diagonals."""
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2
    return F.sqrt(dx**2 + dy**2) / F.sqrt(width**2 + height**2)


def area_ratio(a: Column, b: Column) -> Column:
    return F.when((area(a) > 0) & (area(b) > 0), F.greatest(area(a) / area(b), area(b) / area(a)))


def clip_box(b: Column, width: Column, height: Column) -> Column:
    hold = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), top)
    return F.struct(hold(b["x1"], width).alias("x1"), hold(b["y1"], height).alias("y1"), hold(b["x2"], width).alias("x2"), hold(b["y2"], height).alias("y2"))


def boundary_contacts(b: Column, width: Column, height: Column, margin: float) -> Column:
    """Sides of the frame that the box touches within a margin."""
    touch = lambda name, c: F.when(c, F.lit(name))
    return F.filter(F.array(touch("left", b["x1"] <= margin), touch("top", b["y1"] <= margin), touch("right", b["x2"] >= width - margin), touch("bottom", b["y2"] >= height - margin)), lambda x: x.isNotNull())


def normalize_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "_")


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def source_group_id(dataset: Column, identity: Column) -> Column:
    """A group's id from its data set and source: a hash of the JSON pair, lower case and trimmed; NULL if either is empty.

    Characters beyond ASCII are escaped as JSON does, so they must come escaped.
    """
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), '(["\\\\])', "\\\\$1")
    pair = F.concat(F.lit('["'), clean(dataset), F.lit('","'), clean(identity), F.lit('"]'))
    return F.when((F.trim(dataset) != "") & (F.trim(identity) != ""), F.concat(F.lit("srcgrp_"), F.substring(F.sha2(pair, 256), 1, 20)))


def safe_identity(value: Column) -> Column:
    """An id that is safe in a file name and can be turned back: URL-safe base64 without padding."""
    raw = F.base64(F.encode(value, "UTF-8"))
    return F.concat(F.lit("sid_"), F.rtrim(F.translate(F.regexp_replace(raw, "[\r\n]", ""), "+/", "-_"), F.lit("=")))
