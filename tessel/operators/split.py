"""Contacts: an output mesh whose edges have more than two triangles, or whose vertices have several fans, made manifold.

At such an edge triangles are paired by the face components they belong to, if each component has two there, else by their radial order
around the edge.  Round each vertex triangles are joined over paired edges; each further fan gets a vertex of its own.  No
triangle is added or lost.  Edges that cannot be paired stay as they are and are reported.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wide as Z
from . import mesh


def _plane(points: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int]:
    """A plane through three rational points, oriented by their order."""
    a, b, c = points
    u = tuple(b[k] * a[3] - a[k] * b[3] for k in range(3))
    v = tuple(c[k] * a[3] - a[k] * c[3] for k in range(3))
    n = Z.cross(u, v)
    return (*(x * a[3] for x in n), -Z.dot(n, a))


def _pair_group(rows: list[dict]) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of triangle ids at one edge, and whether the edge was resolved.  rows: tid, sign, component, p0..p2, u, v (points)."""
    by_component: dict = {}
    for r in rows:
        by_component.setdefault(r["component"], []).append(r["tid"])
    if all(len(x) == 2 for x in by_component.values()):
        return [tuple(sorted(x)) for x in by_component.values()], True
    point = lambda s: tuple(map(int, s.split(",")))
    u, v = point(rows[0]["pu"]), point(rows[0]["pv"])
    direction = tuple(v[k] * u[3] - u[k] * v[3] for k in range(3))
    rows = sorted(rows, key=lambda r: r["tid"])
    faces = [(_plane([point(r[f"p{k}"]) for k in range(3)]), r["sign"]) for r in rows]
    pairs = Z.radial_pairs(direction, faces)
    if pairs is None:
        return [], False
    return [tuple(sorted((rows[i]["tid"], rows[j]["tid"]))) for i, j in pairs], True


def edge_pairs(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, u, v, t1, t2, resolved: which triangles belong together over each edge.

    Edges of degree 2 are a plain aggregation; only the others, rare, reach the kernel with their points.
    """
    e = mesh.directed_edges(triangles)
    per = e.groupBy("mesh_id", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("t1"), F.max("tid").alias("t2"))
    two = per.where("n = 2").select("mesh_id", "u", "v", "t1", "t2", F.lit(True).alias("resolved"))
    wide = per.where("n > 2").select("mesh_id", "u", "v")
    comp = mesh.face_components(triangles)
    at = e.join(wide, ["mesh_id", "u", "v"]).join(comp, ["mesh_id", "tid"]).join(triangles.select("mesh_id", "tid", "v0", "v1", "v2"), ["mesh_id", "tid"])
    for name, out in (("v0", "p0"), ("v1", "p1"), ("v2", "p2"), ("u", "pu"), ("v", "pv")):
        at = at.join(vertices.select("mesh_id", F.col("vid").alias(name), F.col("point").alias(out)), ["mesh_id", name])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pairs, ok = _pair_group(rows)
        if not ok:
            ids = sorted(r["tid"] for r in rows)
            pairs = list(zip(ids, ids[1:], strict=False))  # all stay joined
        n = len(pairs)
        cols = {"mesh_id": [rows[0]["mesh_id"]] * n, "u": [rows[0]["u"]] * n, "v": [rows[0]["v"]] * n, "t1": [p[0] for p in pairs], "t2": [p[1] for p in pairs]}
        return pa.table({**{k: pa.array(x, pa.int64()) for k, x in cols.items()}, "resolved": pa.array([ok] * n, pa.bool_())})

    cols = ["mesh_id", "u", "v", "tid", "component", "sign", "p0", "p1", "p2", "pu", "pv"]
    some = at.select(*[F.col(c).cast("long").alias(c) if c in ("mesh_id", "u", "v", "tid", "component") else F.col(c) for c in cols])
    rest = some.groupBy("mesh_id", "u", "v").applyInArrow(run, "mesh_id long, u long, v long, t1 long, t2 long, resolved boolean")
    long = two.select(*[F.col(c).cast("long").alias(c) for c in ("mesh_id", "u", "v", "t1", "t2")], "resolved")
    return long.unionByName(rest)


def split_contacts(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices with ``origin``, triangles, unresolved edges): every fan but a vertex's first has a vertex of its own."""
    pairs = mesh.checkpoint(edge_pairs(vertices, triangles))
    ends = pairs.select("mesh_id", F.explode(F.array("u", "v")).alias("vid"), "t1", "t2")
    corner = triangles.select(F.col("mesh_id").cast("long").alias("mesh_id"), F.explode(F.array("v0", "v1", "v2")).alias("vid"), F.col("tid").cast("long").alias("t1"), F.col("tid").cast("long").alias("t2"))
    around = corner.select("mesh_id", F.col("vid").cast("long").alias("vid"), "t1", "t2").unionByName(ends)

    def run(table: pa.Table) -> pa.Table:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, c in zip(table["t1"].to_pylist(), table["t2"].to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(c, c)
            ra, rc = root(a), root(c)
            if ra != rc:
                parent[max(ra, rc)] = min(ra, rc)
        tids = sorted(parent)
        order = {r: k for k, r in enumerate(sorted({root(x) for x in tids}))}
        n = len(tids)
        return pa.table({"mesh_id": pa.array([table["mesh_id"][0].as_py()] * n, pa.int64()), "vid": pa.array([table["vid"][0].as_py()] * n, pa.int64()), "tid": pa.array(tids, pa.int64()), "fan": pa.array([order[root(x)] for x in tids], pa.int32())})

    fans = mesh.checkpoint(around.groupBy("mesh_id", "vid").applyInArrow(run, "mesh_id long, vid long, tid long, fan int"))
    extra = fans.where("fan > 0").select("mesh_id", "vid", "fan").distinct()
    top = vertices.groupBy("mesh_id").agg(F.max("vid").cast("long").alias("top"))
    new = extra.withColumn("k", F.row_number().over(Window.partitionBy("mesh_id").orderBy("vid", "fan"))).join(top, "mesh_id").select("mesh_id", "vid", "fan", (F.col("top") + F.col("k")).alias("new"))
    moved = fans.where("fan > 0").join(new, ["mesh_id", "vid", "fan"]).select("mesh_id", "vid", "tid", "new")
    t = triangles
    for c in ("v0", "v1", "v2"):
        t = t.join(moved.select("mesh_id", F.col("vid").alias(c), "tid", F.col("new").alias(f"_{c}")), ["mesh_id", "tid", c], "left")
        t = t.withColumn(c, F.coalesce(f"_{c}", F.col(c).cast("long"))).drop(f"_{c}")
    v = vertices.withColumn("origin", F.col("vid").cast("long"))
    copies = v.join(new, ["mesh_id", "vid"]).withColumn("vid", F.col("new")).drop("fan", "new")
    out = v.withColumn("vid", F.col("vid").cast("long")).unionByName(copies.select(*v.columns))
    unresolved = pairs.where("not resolved").select("mesh_id", "u", "v").distinct()
    return out, t.select(*triangles.columns), unresolved
