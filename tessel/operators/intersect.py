"""Self-intersection: pairs of a mesh's triangles of which one meets the other's interior.

Broad phase: a grid self-join on bounding boxes (each pair in one cell).  What is left goes to Arrow batches of big integers, where
the side test comes first.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wide as Z
from . import mesh


def _flat_axis(plane) -> int:
    return max(range(3), key=lambda k: abs(plane[k]))


def point_in_coplanar(tri, plane, v) -> int:
    """-1 outside, 0 on the border, 1 inside; v is a canonical point in the triangle's plane."""
    axis = _flat_axis(plane)
    s = [Z.orient2d(tri[i], tri[(i + 1) % 3], v, axis) * Z.sign(plane[axis]) for i in range(3)]
    return -1 if min(s) < 0 else 1 if min(s) > 0 else 0


def segment_meets_interior(tri, plane, p, q) -> bool:
    """Whether the closed segment of two canonical points in the triangle's plane meets the open triangle."""
    axis = _flat_axis(plane)
    i, j = Z.PROJECT[axis]
    up = Z.sign(plane[axis])

    def height(a, b, v) -> Fraction:
        return Fraction(up * ((b[i] - a[i]) * (v[j] - a[j] * v[3]) - (b[j] - a[j]) * (v[i] - a[i] * v[3])), v[3])

    low, high = Fraction(0), Fraction(1)
    low_open = high_open = False
    for k in range(3):
        a, b = height(tri[k], tri[(k + 1) % 3], p), height(tri[k], tri[(k + 1) % 3], q)
        if a <= 0 and b <= 0:
            return False
        if a > 0 and b > 0:
            continue
        t = a / (a - b)
        if b > a:
            if t >= low:
                low, low_open = t, True
        elif t <= high:
            high, high_open = t, True
    return low < high or (low == high and not low_open and not high_open)


def coplanar_overlap(t1, t2, plane) -> bool:
    """Whether two triangles of one plane share interior points: no side of either keeps them apart."""
    axis = _flat_axis(plane)
    for a, b in ((t1, t2), (t2, t1)):
        turn = Z.orient2d(a[0], a[1], (*a[2], 1), axis)
        for i in range(3):
            if all(Z.orient2d(a[i], a[(i + 1) % 3], (*v, 1), axis) * turn <= 0 for v in b):
                return False
    return True


def crosses_interior(t1, plane1, t2) -> bool:
    """Whether triangle t2, not in the plane of t1, meets the interior of t1."""
    s = [Z.sign(plane1[0] * v[0] + plane1[1] * v[1] + plane1[2] * v[2] + plane1[3]) for v in t2]
    if min(s) > 0 or max(s) < 0:
        return False
    ends = [(*v, 1) for v, k in zip(t2, s, strict=True) if k == 0]
    value = lambda v: plane1[0] * v[0] + plane1[1] * v[1] + plane1[2] * v[2] + plane1[3]
    for i in range(3):
        a, b = t2[i], t2[(i + 1) % 3]
        if s[i] * s[(i + 1) % 3] < 0:
            ha, hb = value(a), value(b)
            ends.append(Z.reduce(*(a[k] * -hb + b[k] * ha for k in range(3)), ha - hb))
    return bool(ends) and segment_meets_interior(t1, plane1, ends[0], ends[-1])


def meet(t1, t2) -> bool:
    p1, p2 = Z.plane_of(*t1), Z.plane_of(*t2)
    if not any(p1[:3]) or not any(p2[:3]):
        return False
    if Z.plane_key(p1) == Z.plane_key(p2):
        return coplanar_overlap(t1, t2, p1)
    return crosses_interior(t1, p1, t2) or crosses_interior(t2, p2, t1)


def self_intersections(fat_triangles: DataFrame, b: int = 21, cell: int | None = None) -> DataFrame:
    """mesh_id, t1, t2: the pairs (t1 < t2)."""
    boxed = mesh.checkpoint(mesh.boxes(fat_triangles))  # both sides of the join read it; its own plan may be long
    pairs = mesh.grid_pairs(boxed, "tid", cell or max(1, 1 << (b - 6)), ["mesh_id"])
    names = mesh.CORNERS
    pairs = pairs.select(F.col("a.mesh_id").alias("mesh_id"), F.col("a.tid").alias("t1"), F.col("b.tid").alias("t2"), *[F.col(f"{s}.{c}").cast("long").alias(f"{s}_{c}") for s in "ab" for c in names])
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            keep = [meet(*(tuple((r[f"{s}_x{k}"], r[f"{s}_y{k}"], r[f"{s}_z{k}"]) for k in range(3)) for s in "ab")) for r in rows]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["mesh_id", "t1", "t2"])

    return pairs.mapInArrow(run, pairs.select("mesh_id", "t1", "t2").schema)


def is_self_intersecting(fat_triangles: DataFrame, b: int = 21, cell: int | None = None) -> DataFrame:
    """mesh_id, self_intersecting, pairs."""
    hit = self_intersections(fat_triangles, b, cell).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("pairs"))
    all_ = fat_triangles.select("mesh_id").distinct().join(hit, "mesh_id", "left")
    return all_.select("mesh_id", F.col("pairs").isNotNull().alias("self_intersecting"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
