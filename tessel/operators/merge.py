"""Coplanar patches and the greedy merge of triangles into convex polygons."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact as X
from ..functions import wide as Z
from . import mesh, planes


def patches(fat_triangles: DataFrame, b: int = 21) -> DataFrame:
    """mesh_id, tid, patch (smallest tid): triangles of one oriented plane joined over edges of degree 2.

    Label propagation with pointer jumping, until nothing changes.
    """
    plane = X.plane_of(*mesh.corners(b))
    key = planes.canonical(plane)
    t = fat_triangles.where(~X.is_degenerate(plane)).withColumn("_plane", F.struct(*[key[c].alias(c) for c in ("a", "b", "c", "d", "flipped")]))
    t = mesh.checkpoint(t.select("mesh_id", "tid", "v0", "v1", "v2", "_plane"))
    e = mesh.directed_edges(t)
    two = e.groupBy("mesh_id", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("a"), F.max("tid").alias("c")).where("n = 2 and a <> c")
    of = t.select("mesh_id", F.col("tid").alias("a"), F.col("_plane").alias("pa"))
    oc = t.select("mesh_id", F.col("tid").alias("c"), F.col("_plane").alias("pc"))
    flat = two.join(of, ["mesh_id", "a"]).join(oc, ["mesh_id", "c"]).where("pa = pc").select("mesh_id", "a", "c")
    links = mesh.checkpoint(flat.union(flat.select("mesh_id", F.col("c").alias("a"), F.col("a").alias("c"))))
    label = t.select("mesh_id", "tid", F.col("tid").alias("patch"))
    while True:
        low = links.join(label.withColumnRenamed("tid", "c"), ["mesh_id", "c"]).groupBy("mesh_id", F.col("a").alias("tid")).agg(F.min("patch").alias("m"))
        new = label.join(low, ["mesh_id", "tid"], "left").select("mesh_id", "tid", F.col("patch").alias("old"), F.least("patch", F.coalesce("m", "patch")).alias("patch"))
        new = mesh.checkpoint(new)
        up = new.select("mesh_id", F.col("tid").alias("patch"), F.col("patch").alias("root"))
        new = mesh.checkpoint(new.join(up, ["mesh_id", "patch"]).select("mesh_id", "tid", "old", F.col("root").alias("patch")))
        label = new.select("mesh_id", "tid", "patch")
        if new.where("old <> patch").isEmpty():
            return label


def convex(loop: list[tuple], axis: int) -> bool:
    turns = {Z.orient2d(loop[i - 2], loop[i - 1], (*loop[i], 1), axis) for i in range(len(loop))} - {0}
    return len(turns) == 1


def drop_collinear(loop: list[tuple], axis: int) -> list[tuple]:
    out = list(loop)
    i = 0
    while i < len(out) and len(out) > 3:
        if Z.orient2d(out[i - 1], out[i], (*out[(i + 1) % len(out)], 1), axis) == 0:
            out.pop(i)
            i = max(0, i - 1)
        else:
            i += 1
    return out


def splice(one: list, two: list) -> list | None:
    """Two loops joined over the first side that they share in opposite directions."""
    sides = {(two[k], two[(k + 1) % len(two)]): k for k in range(len(two))}
    for i in range(len(one)):
        k = sides.get((one[(i + 1) % len(one)], one[i]))
        if k is not None:
            rest = [two[(k + 1 + s) % len(two)] for s in range(len(two))]
            return one[: i + 1] + rest[1:-1] + one[i + 1 :]
    return None


def greedy(loops: list[tuple[int, list[tuple]]], axis: int, max_merges: int) -> list[tuple[int, list[tuple]]]:
    """Neighbours merged while the result stays convex, in order of tag; the smaller tag stays."""
    loops = sorted(loops)
    done = 0
    again = True
    while again and done < max_merges:
        again = False
        for i in range(len(loops)):
            j = i + 1
            while j < len(loops) and done < max_merges:
                joined = splice(loops[i][1], loops[j][1])
                if joined is not None and len(set(joined)) == len(joined) and convex(joined, axis):
                    loops[i] = (loops[i][0], joined)
                    loops.pop(j)
                    done += 1
                    again = True
                else:
                    j += 1
    return [(t, drop_collinear(p, axis)) for t, p in loops]


def merge_convex(fat_triangles: DataFrame, b: int = 21, max_merges: int = 1 << 20) -> DataFrame:
    """mesh_id, tag (smallest tid), corners (array of points): convex polygons, merged inside each coplanar patch."""
    label = patches(fat_triangles, b)
    t = fat_triangles.join(label, ["mesh_id", "tid"]).select("mesh_id", "patch", F.col("tid").cast("long").alias("tid"), *[F.col(c).cast("long").alias(c) for c in mesh.CORNERS])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        loops = [(r["tid"], [(r[f"x{k}"], r[f"y{k}"], r[f"z{k}"]) for k in range(3)]) for r in rows]
        plane = Z.plane_of(*loops[0][1])
        axis = next(k for k in range(3) if plane[k])
        got = greedy(loops, axis, max_merges)
        point = pa.struct([(c, pa.int64()) for c in "xyz"])
        corners = [[dict(zip("xyz", v, strict=True)) for v in p] for _, p in got]
        return pa.table({"mesh_id": pa.array([rows[0]["mesh_id"]] * len(got), pa.int64()), "tag": pa.array([x[0] for x in got], pa.int64()), "corners": pa.array(corners, pa.list_(point))})

    return t.groupBy("mesh_id", "patch").applyInArrow(run, "mesh_id long, tag long, corners array<struct<x:long,y:long,z:long>>")
