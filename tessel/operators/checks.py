"""Independent checks of meshes and volumes, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mesh


def structure(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id and counts of violations: dangling ids, repeated ids in a face, undirected degree not 2, directed edges used twice, duplicate faces."""
    ids = vertices.select("mesh_id", "vid")
    corners = triangles.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    dangling = corners.join(ids, ["mesh_id", "vid"], "left_anti").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("dangling"))
    twisted = triangles.groupBy("mesh_id").agg(F.count_if(F.expr("v0 = v1 or v1 = v2 or v0 = v2")).alias("twisted"))
    d = mesh.directed_edges(triangles)
    degree = d.groupBy("mesh_id", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sign") > 0).alias("up"))
    edges = degree.groupBy("mesh_id").agg(F.count_if(F.col("n") != 2).alias("bad_degree"), F.count_if((F.col("up") > 1) | (F.col("n") - F.col("up") > 1)).alias("repeated_direction"), F.count_if(2 * F.col("up") != F.col("n")).alias("unbalanced"))
    face = triangles.groupBy("mesh_id", F.array_sort(F.array("v0", "v1", "v2")).alias("f")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("mesh_id").agg(F.sum(F.col("n") - 1).alias("duplicates"))
    out = twisted
    for part in (dangling, edges, face):
        out = out.join(part, "mesh_id", "left")
    return out.select("mesh_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dangling", "twisted", "bad_degree", "repeated_direction", "unbalanced", "duplicates")])


def volume_float(fat_triangles: DataFrame) -> DataFrame:
    """mesh_id, volume6 in doubles: a quick sieve, not a proof."""
    x = {c: F.col(c).cast("double") for c in mesh.CORNERS}
    det = x["x0"] * (x["y1"] * x["z2"] - x["z1"] * x["y2"]) + x["y0"] * (x["z1"] * x["x2"] - x["x1"] * x["z2"]) + x["z0"] * (x["x1"] * x["y2"] - x["y1"] * x["x2"])
    return fat_triangles.groupBy("mesh_id").agg(F.sum(det).alias("volume6"))
