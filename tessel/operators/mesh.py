"""Mesh aggregates and validation.

Tables: ``vertices(mesh_id, vid, x, y, z)`` and ``triangles(mesh_id, tid, v0, v1, v2)``.  A *fat* triangle carries its
corner coordinates (x0 .. z2), so the aggregates below need one shuffle at most.  Counts are partial aggregations on (mesh, edge)
or (mesh, vertex); no mesh is ever gathered into one task, except for the topology of meshes of up to ``SMALL`` triangles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact as X

CORNERS = tuple(f"{c}{k}" for k in range(3) for c in "xyz")
SMALL = 1 << 16


def fat(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, tid, v0..v2, x0..z2: corner coordinates beside the ids."""
    long = triangles.select("mesh_id", "tid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid"))
    met = long.join(vertices, ["mesh_id", "vid"])
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    aggs = [pick("vid", k).alias(f"v{k}") for k in range(3)] + [pick(c, k).alias(f"{c}{k}") for k in range(3) for c in "xyz"]
    return met.groupBy("mesh_id", "tid").agg(*aggs)


def corners(b: int, prefix: str = "") -> tuple:
    """The three corners of a fat triangle as exact points."""
    return tuple(tuple(X.coordinate(f"{prefix}{c}{k}", b) for c in "xyz") for k in range(3))


def signed_volume6(fat_triangles: DataFrame, b: int = 21, keys=("mesh_id",)) -> DataFrame:
    """keys, volume6 (DECIMAL(38, 0)) and outward: positive volume, that is an outward orientation for closed meshes."""
    det = X.tetra_volume6(*corners(b))
    total = F.sum(det.col.cast("decimal(28,0)")).cast(X.DECIMAL)
    return fat_triangles.groupBy(*keys).agg(total.alias("volume6")).withColumn("outward", F.col("volume6") > 0)


def in_range(vertices: DataFrame, b: int) -> DataFrame:
    lo, hi = -(1 << (b - 1)), (1 << (b - 1)) - 1
    ok = F.col("x").between(lo, hi) & F.col("y").between(lo, hi) & F.col("z").between(lo, hi)
    return vertices.groupBy("mesh_id").agg(F.bool_and(ok).alias("in_range"))


def directed_edges(triangles: DataFrame) -> DataFrame:
    """mesh_id, tid, u < v, sign (1 for u to v), for sides of two different vertices."""
    sides = F.array(*[F.struct(F.col(f"v{i}").alias("a"), F.col(f"v{(i + 1) % 3}").alias("b")) for i in range(3)])
    e = triangles.select("mesh_id", "tid", F.explode(sides).alias("e")).where("e.a <> e.b")
    return e.select("mesh_id", "tid", F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v"), F.when(F.col("e.a") < F.col("e.b"), 1).otherwise(-1).alias("sign"))


def edges(triangles: DataFrame) -> DataFrame:
    """mesh_id, u, v, degree, boundary (signed sum)."""
    return directed_edges(triangles).groupBy("mesh_id", "u", "v").agg(F.count(F.lit(1)).alias("degree"), F.sum("sign").alias("boundary"))


def boundary_is_zero(triangles: DataFrame) -> DataFrame:
    """mesh_id, closed: the signed boundary sum is zero on every edge."""
    per = edges(triangles).groupBy("mesh_id").agg(F.bool_and(F.col("boundary") == 0).alias("closed"))
    return triangles.select("mesh_id").distinct().join(per, "mesh_id", "left").select("mesh_id", F.coalesce("closed", F.lit(True)).alias("closed"))


def face_components(triangles: DataFrame, max_rounds: int = 64, every: int = 4) -> DataFrame:
    """mesh_id, tid, component (smallest tid reachable): faces that share an edge of degree 2 are joined.

    Label propagation with pointer jumping; lineage is cut every few rounds in the checkpoint folder.  All joins are told to sort and
    merge: Spark takes generated triangles for about as many bytes as the rows that they come from, and would broadcast them.
    """
    e = directed_edges(triangles)
    two = e.groupBy("mesh_id", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("a"), F.max("tid").alias("b")).where("n = 2 and a <> b")
    links = two.select("mesh_id", "a", "b").union(two.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = checkpoint(links)
    label = triangles.select("mesh_id", "tid", F.col("tid").alias("component")).distinct()  # rows of one tid would multiply in each round
    for i in range(max_rounds):
        near = links.hint("merge").join(label.withColumnRenamed("tid", "b"), ["mesh_id", "b"]).select("mesh_id", F.col("a").alias("tid"), "component")
        low = near.groupBy("mesh_id", "tid").agg(F.min("component").alias("m"))
        new = label.join(low.hint("merge"), ["mesh_id", "tid"], "left").select("mesh_id", "tid", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        up = new.select("mesh_id", F.col("tid").alias("component"), F.col("component").alias("root"))
        new = new.join(up.hint("merge"), ["mesh_id", "component"]).select("mesh_id", "tid", "old", F.col("root").alias("component"))
        new = checkpoint(new)
        if new.where("old <> component").isEmpty():
            return new.select("mesh_id", "tid", "component")
        label = new.select("mesh_id", "tid", "component")
    raise RuntimeError("face components did not settle")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; in a session that names no folder, one of our own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessel-"))
    return df.checkpoint(eager=True)


def vertex_fans(triangles: DataFrame) -> DataFrame:
    """mesh_id, vid, fans: cycles in the vertex's link (1 for a manifold vertex), by label propagation inside the link.

    Links are short paths on real meshes, so each vertex's arcs are one array, walked in an Arrow batch.  (One expression over the array took
    the driver more memory to compile than the rest of the topology.)
    """
    arcs = triangles.select("mesh_id", F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("vid"), F.col(f"v{(i + 1) % 3}").alias("a"), F.col(f"v{(i + 2) % 3}").alias("b")) for i in range(3)])).alias("t")).select("mesh_id", "t.*")
    link = arcs.groupBy("mesh_id", "vid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("arcs"), F.count(F.lit(1)).alias("n"))

    def run(batches):
        for b in batches:
            at = b.column(3)
            offsets = at.offsets.to_pylist()
            arcs = list(zip(at.values.field("a").to_pylist(), at.values.field("b").to_pylist(), strict=True))
            fans = [walks(arcs[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fans, pa.int32())], names=["mesh_id", "vid", "n", "fans"])

    kinds = {f.name: f.dataType.simpleString() for f in link.schema.fields}
    rows = link.select("mesh_id", "vid", "n", "arcs")
    return rows.mapInArrow(run, f"mesh_id {kinds['mesh_id']}, vid {kinds['vid']}, n long, fans int")


def walks(arcs: list[tuple[int, int]]) -> int:
    """Arcs are followed from the first unused one: how many walks use all of them."""
    after: dict[int, list[int]] = {}
    for k in range(len(arcs) - 1, -1, -1):
        after.setdefault(arcs[k][0], []).append(k)
    used, fans = [False] * len(arcs), 0
    for k in range(len(arcs)):
        if used[k]:
            continue
        fans += 1
        while True:
            used[k] = True
            after[arcs[k][0]].remove(k)
            follow = after.get(arcs[k][1])
            if not follow:
                break
            k = follow[-1]
    return fans


FIGURES = {"f": "long", "no_degenerate": "boolean", "e": "long", "edge_manifold": "boolean", "oriented": "boolean", "deficient": "long", "excess": "long", "odd": "long", "max_degree": "long", "v": "long", "vertex_manifold": "boolean", "extra_fans": "long", "components": "long"}


def topology(triangles: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per mesh: v, e, f; edge_manifold, vertex_manifold, oriented, no_degenerate; deficient, excess and odd edges,
    max_degree; components, extra_fans, chi, genus, chi_even, ok.

    Meshes of up to ``small`` triangles meet in one shuffle and are worked out many at a time in Arrow batches; larger ones, and those with
    null ids, by aggregations and joins that spread a mesh over tasks.
    """
    ids = ("tid", "v0", "v1", "v2")
    t = triangles.select("mesh_id", *ids)
    nulls = F.count_if(F.expr(" or ".join(f"{c} is null" for c in ids)))
    large = checkpoint(t.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), nulls.alias("nulls")).where((F.col("n") > small) | (F.col("nulls") > 0)).select(F.struct("mesh_id").alias("mesh")))
    n = large.count()
    if n:
        keyed = t.withColumn("mesh", F.struct("mesh_id"))  # a struct of a null is not null: such a mesh is not lost in joins
        large = F.broadcast(large) if n <= 10_000 else large.hint("merge")
        t = keyed.join(large, "mesh", "left_anti").select("mesh_id", *ids)
    r = t.repartition("mesh_id").sortWithinPartitions("mesh_id").mapInArrow(_whole_meshes, f"mesh_id {t.schema['mesh_id'].dataType.simpleString()}, " + ", ".join(map(" ".join, FIGURES.items())))
    if n:
        rest = _spread_meshes(keyed.join(large, "mesh", "left_semi").select(F.col("mesh").alias("mesh_id"), *ids))
        r = r.unionByName(rest.select("mesh_id.mesh_id", *[F.col(c).cast(kind).alias(c) for c, kind in FIGURES.items()]))
    r = r.withColumn("chi", F.col("v") - F.col("e") + F.col("f"))
    r = r.withColumn("chi_even", F.pmod("chi", F.lit(2)) == 0).withColumn("genus", (F.col("components") - F.expr("chi div 2")))
    return r.withColumn("ok", F.expr("edge_manifold and vertex_manifold and oriented and no_degenerate and chi_even"))


def _spread_meshes(triangles: DataFrame) -> DataFrame:
    """FIGURES of meshes of any size."""
    e = edges(triangles).groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("e"),
        F.bool_and(F.col("degree") == 2).alias("edge_manifold"),
        F.bool_and(F.col("boundary") == 0).alias("oriented"),
        F.count_if(F.col("degree") == 1).alias("deficient"),
        F.count_if(F.col("degree") > 2).alias("excess"),
        F.count_if(F.col("degree") % 2 == 1).alias("odd"),
        F.max("degree").alias("max_degree"),
    )
    twisted = (F.col("v0") == F.col("v1")) | (F.col("v1") == F.col("v2")) | (F.col("v0") == F.col("v2"))
    f = triangles.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("f"), (~F.bool_or(twisted)).alias("no_degenerate"))
    fans = vertex_fans(triangles).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("v"), F.bool_and(F.col("fans") == 1).alias("vertex_manifold"), F.sum(F.col("fans") - 1).alias("extra_fans"))
    comps = face_components(triangles).groupBy("mesh_id").agg(F.countDistinct("component").alias("components"))
    r = f.join(e.hint("merge"), "mesh_id", "left").join(fans.hint("merge"), "mesh_id").join(comps.hint("merge"), "mesh_id")
    return r.fillna(0, ["e", "deficient", "excess", "odd", "max_degree"])


def _whole_meshes(batches, rows: int = 100_000):
    """FIGURES of meshes whose triangles come one mesh after the other, as many meshes at a time as have ``rows`` triangles."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        code = _codes(t)
        last = int(np.searchsorted(code, code[-1]))
        if last:
            yield _figures(t.slice(0, last))
        held = t.slice(last).to_batches()
        n = t.num_rows - last
    if n:
        yield _figures(pa.Table.from_batches(held).combine_chunks())


def _codes(t: pa.Table) -> np.ndarray:
    return t.column("mesh_id").combine_chunks().dictionary_encode("encode").indices.to_numpy()


def _figures(t: pa.Table) -> pa.RecordBatch:
    """FIGURES, as the aggregations above have them."""
    mesh = t.column("mesh_id").combine_chunks().dictionary_encode("encode")
    of, k = mesh.indices.to_numpy().astype(np.int64), len(mesh.dictionary)
    tid, *v = (t.column(c).to_numpy() for c in ("tid", "v0", "v1", "v2"))

    def dense(own, ids):
        """Numbers from 0 by mesh and then id; the mesh of each."""
        some, at = np.unique(ids, return_inverse=True)
        keys, at = np.unique(own * len(some) + at, return_inverse=True)
        return at, keys // len(some)

    def count(where, per=None):
        return np.bincount(where if per is None else where[per], minlength=k)

    at, of_vertex = dense(np.tile(of, 3), np.concatenate(v))
    v, m = at.reshape(3, -1), len(of_vertex)
    face, of_face = dense(of, tid)

    a, b = v.ravel(), v[[1, 2, 0]].ravel()
    side = np.flatnonzero(a != b)
    a, b, own = a[side], b[side], np.tile(face, 3)[side]
    key = np.minimum(a, b) * m + np.maximum(a, b)
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    degree = np.diff(start, append=len(order))
    boundary = np.add.reduceat(np.where(a < b, 1, -1)[order], start) if len(start) else start
    of_edge = of_vertex[a[order[start]]]
    most = np.zeros(k, np.int64)
    np.maximum.at(most, of_edge, degree)
    e = count(of_edge)

    two = start[degree == 2]
    root = _roots(len(of_face), own[order[two]], own[order[two + 1]])
    fans = _fans(v, m)
    twisted = (v[0] == v[1]) | (v[1] == v[2]) | (v[0] == v[2])
    none = e == 0
    found = {
        "f": count(of), "no_degenerate": count(of, twisted) == 0, "e": e,
        "edge_manifold": pa.array(count(of_edge, degree != 2) == 0, mask=none), "oriented": pa.array(count(of_edge, boundary != 0) == 0, mask=none),
        "deficient": count(of_edge, degree == 1), "excess": count(of_edge, degree > 2), "odd": count(of_edge, degree % 2 == 1), "max_degree": most,
        "v": count(of_vertex), "vertex_manifold": count(of_vertex, fans != 1) == 0, "extra_fans": np.bincount(of_vertex, fans - 1, k).astype(np.int64),
        "components": count(of_face, root == np.arange(len(root))),
    }
    return pa.RecordBatch.from_arrays([mesh.dictionary, *[pa.array(found[c]) for c in FIGURES]], names=["mesh_id", *FIGURES])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0 .. n - 1 over the links a to b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def _fans(v: np.ndarray, m: int) -> np.ndarray:
    """walks() of each of m vertices, for corners v (3 x triangles).  Where each neighbour begins one arc and ends one, they are the cycles."""
    at, a, b = v.ravel(), v[[1, 2, 0]].ravel(), v[[2, 0, 1]].ravel()
    order = np.lexsort((b, a, at))
    at, a, b = at[order], a[order], b[order]
    begins, ends = at * m + a, at * m + b
    follow = np.minimum(np.searchsorted(begins, ends), len(begins) - 1)
    odd = np.zeros(m, bool)
    odd[at[begins[follow] != ends]] = True
    odd[at[1:][np.diff(begins) == 0]] = True
    odd[np.sort(ends)[1:][np.diff(np.sort(ends)) == 0] // m] = True
    plain = np.flatnonzero(~odd[at])
    root = _roots(len(at), plain, follow[plain])
    fans = np.bincount(at[plain], root[plain] == plain, m).astype(np.int64)
    bounds = np.searchsorted(at, np.arange(m + 1))
    for x in np.flatnonzero(odd).tolist():
        i, j = bounds[x], bounds[x + 1]
        fans[x] = walks(list(zip(a[i:j].tolist(), b[i:j].tolist(), strict=True)))
    return fans


def boxes(fat_triangles: DataFrame) -> DataFrame:
    """Fat triangles with their bounding boxes lx..hz."""
    out = fat_triangles
    for c in "xyz":
        three = [F.col(f"{c}{k}") for k in range(3)]
        out = out.withColumn(f"l{c}", F.least(*three)).withColumn(f"h{c}", F.greatest(*three))
    return out


def overlap(a: str, b: str):
    """Closed boxes of two aliases overlap."""
    cond = F.lit(True)
    for c in "xyz":
        cond = cond & (F.col(f"{a}.l{c}") <= F.col(f"{b}.h{c}")) & (F.col(f"{b}.l{c}") <= F.col(f"{a}.h{c}"))
    return cond


def grid_pairs(items: DataFrame, key: str, cell: int, same: list[str]) -> DataFrame:
    """Pairs a < b (by ``key``) of items with equal ``same`` columns whose closed boxes overlap: a self-join on grid cells of edge ``cell``.

    Each pair is kept in one cell only, the lowest that both touch, so no distinct is needed.
    """
    lo = lambda c: F.floor(F.col(f"l{c}") / cell).cast("long")
    hi = lambda c: F.floor(F.col(f"h{c}") / cell).cast("long")
    g = items
    for c in "xyz":
        g = g.withColumn(f"c{c}", F.explode(F.sequence(lo(c), hi(c))))
    on = F.col("a." + key) < F.col("b." + key)
    for s in [*same, "cx", "cy", "cz"]:
        on = on & (F.col(f"a.{s}") == F.col(f"b.{s}"))
    for c in "xyz":
        on = on & (F.col(f"a.c{c}") == F.greatest(F.floor(F.col(f"a.l{c}") / cell), F.floor(F.col(f"b.l{c}") / cell)))
    return g.alias("a").join(g.alias("b"), on & overlap("a", "b"))
