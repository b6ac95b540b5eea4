"""Meshes with answers known by hand."""

import pytest
from pyspark.sql import functions as F

from tessel.functions import exact as X
from tessel.functions import wide as Z
from tessel.operators import merge, mesh, octree, solids, winding
from tessel.plans.indicator import Indicator, compose
from tessel.sources import quantise, templates


def box(spark, *rows):
    return templates.box_rows(spark, [(m, part, *b) for m, part, b in rows])


def soup(spark, boxes, depth=0, adaptive=False):
    rows = [(1, k, *b) for k, b in enumerate(boxes)]
    t = templates.box_triangles(templates.box_rows(spark, rows).withColumnRenamed("mesh_id", "scene"))
    t = t.select("scene", (F.col("part") * 12 + F.col("tid")).alias("tid"), *[(F.col("part") * 8 + F.col(f"v{k}")).alias(f"v{k}") for k in range(3)], *mesh.CORNERS)
    return solids.from_mesh(t, solids.Options(b=9, depth=depth, adaptive=adaptive, leaf_threshold=4))


def scenes(spark, boxes, depth):
    rows = templates.box_rows(spark, [(i, 0, *b) for i, b in enumerate(boxes)]).withColumnRenamed("mesh_id", "scene")
    return solids.from_mesh(templates.box_triangles(rows).select("scene", "tid", "v0", "v1", "v2", *mesh.CORNERS), solids.Options(b=6, depth=depth))


def volume(s):
    got = {r.scene: int(r.volume6) for r in solids.volume6(s).collect()}
    return got.get(1, 0) / 6


def test_topology_of_boxes_and_torus(spark):
    _, t = templates.box_mesh(box(spark, (1, 0, (0, 0, 0, 2, 2, 2)), (1, 1, (5, 5, 5, 6, 6, 6)), (2, 0, (0, 0, 0, 1, 1, 1))))
    rows = {r.mesh_id: r for r in mesh.topology(t).collect()}
    assert (rows[1].v, rows[1].e, rows[1].f, rows[1].components, rows[1].genus, rows[1].ok) == (16, 36, 24, 2, 0, True)
    assert (rows[2].v, rows[2].e, rows[2].f, rows[2].chi) == (8, 18, 12, 2)
    _, torus = templates.torus(spark.createDataFrame([(7, 4, 5)], "mesh_id long, n int, m int"))
    r = mesh.topology(torus).first()
    assert (r.v, r.e, r.f, r.chi, r.genus, r.ok) == (20, 60, 40, 0, 1, True)


def test_contacts_are_not_manifold(spark):
    v, t = templates.box_mesh(box(spark, (1, 0, (0, 0, 0, 2, 2, 2)), (1, 1, (2, 2, 0, 4, 4, 2)), (2, 0, (0, 0, 0, 2, 2, 2)), (2, 1, (2, 2, 2, 4, 4, 4))))
    rows = {r.mesh_id: r for r in mesh.topology(templates.weld(v, t)[1]).collect()}
    assert not rows[1].edge_manifold and rows[1].excess == 1 and rows[1].max_degree == 4 and rows[1].oriented
    assert rows[2].edge_manifold and not rows[2].vertex_manifold and rows[2].extra_fans == 1
    assert all(r.closed for r in mesh.boundary_is_zero(t).collect())


def test_loose_triangle_is_rejected(spark):
    t = templates.box_triangles(templates.box_rows(spark, [(1, 0, 0, 0, 0, 4, 4, 4)]).withColumnRenamed("mesh_id", "scene")).where("tid <> 3")
    with pytest.raises(ValueError):
        solids.from_mesh(t.select("scene", "tid", "v0", "v1", "v2", *mesh.CORNERS), solids.Options(b=9))


def test_plans_that_could_overflow_do_not_build():
    with pytest.raises(X.WidthError):
        X.side_h(tuple(X.coordinate("a", 45) for _ in range(4)), tuple(X.coordinate("a", 139) for _ in range(4)))


CASES = [
    ("corner", [(0, 0, 0, 8, 8, 8)], [(4, 4, 4, 12, 12, 12)], 64),
    ("shared face", [(0, 0, 0, 8, 8, 8)], [(8, 0, 0, 12, 8, 8)], 0),
    ("half of a face", [(0, 0, 0, 8, 8, 8)], [(8, 4, 0, 12, 12, 8)], 0),
    ("same box", [(0, 0, 0, 8, 8, 8)], [(0, 0, 0, 8, 8, 8)], 512),
    ("inside", [(0, 0, 0, 8, 8, 8)], [(2, 2, 2, 4, 4, 4)], 8),
    ("flush inside", [(0, 0, 0, 8, 8, 8)], [(0, 0, 2, 4, 4, 8)], 96),
    ("disjoint", [(0, 0, 0, 8, 8, 8)], [(20, 20, 20, 30, 30, 30)], 0),
    ("edge only", [(0, 0, 0, 8, 8, 8)], [(8, 8, 0, 12, 12, 8)], 0),
]


@pytest.mark.parametrize("depth", [0, 1])
def test_booleans_of_boxes(spark, depth):
    """All cases at once, a scene each."""
    size = lambda x: (x[3] - x[0]) * (x[4] - x[1]) * (x[5] - x[2])
    left, right = (scenes(spark, [c[k][0] for c in CASES], depth) for k in (1, 2))
    want = {"union": lambda a, b, c: a + b - c, "intersection": lambda a, b, c: c, "difference": lambda a, b, c: a - c}
    for op, f in want.items():
        got = {r.scene: int(r.volume6) / 6 for r in solids.volume6(solids.boolean(left, right, op)).collect()}
        for i, (name, a, b, common) in enumerate(CASES):
            assert got.get(i, 0) == f(size(a[0]), size(b[0]), common), (op, name)


def test_adaptive_leaves_give_the_same_solid(spark):
    a, b = [(0, 0, 0, 40, 40, 40), (60, 60, 60, 70, 70, 70)], [(30, 30, 30, 65, 65, 65)]
    plain = solids.difference(soup(spark, a), soup(spark, b))
    split = solids.difference(soup(spark, a, 3, True), soup(spark, b, 3, True))
    assert volume(plain) == volume(split) == 40**3 + 10**3 - 10**3 - 5**3


def test_self_union_and_exit(spark):
    s = solids.self_union(soup(spark, [(0, 0, 0, 10, 10, 10), (5, 5, 5, 15, 15, 15)]))
    assert volume(s) == 1000 + 1000 - 125
    v, t = solids.to_mesh(s)
    r = mesh.topology(t).first()
    assert r.ok and r.components == 1 and r.genus == 0
    assert solids.mesh_volume6(v, t).first().volume6 == str(6 * 1875)


def test_drilling_makes_a_hole(spark):
    drilled = solids.difference(soup(spark, [(0, 0, 0, 10, 10, 10)]), soup(spark, [(4, 4, -2, 6, 6, 12)]))
    assert volume(drilled) == 960
    _, t = solids.to_mesh(drilled)
    r = mesh.topology(t).first()
    assert r.ok and r.genus == 1


def test_indicator_is_three_valued(spark):
    e = compose("difference", Indicator.source(0) | Indicator.source(1), Indicator.source(0), 2)
    rows = spark.createDataFrame([(1, 0, 0), (None, 0, 1), (None, 0, 0), (0, 0, None)], "w0 int, w1 int, w2 int")
    assert [r[0] for r in rows.select(e.column(lambda k: F.col(f"w{k}"))).collect()] == [True, False, None, False]
    assert e.value({0: 1}) and not e.value({0: 1, 2: 1})
    assert e.postfix()[0] == (0, "source", 0)


def test_ownership_and_presence_differ(spark):
    flat = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 3)], "id long, lx long, hx long, ly long, hy long, lz long, hz long")
    own = octree.assign(flat, 1, 4).select("ci", "cj", "ck").collect()
    there = octree.assign(flat, 1, 4, closed=True).select("ci", "cj", "ck").collect()
    assert [tuple(r) for r in own] == [(1, 1, 1)]
    assert len(there) == 8


def test_quantise_welds_and_drops(spark):
    raw = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 1.0 + 1e-12, 0.0, 0.0), ("m", 3, 0.0, 1.0, 0.0)], "model_id string, vid long, x double, y double, z double")
    q = quantise.quantise_vertices(raw, 11)
    t = spark.createDataFrame([("m", 0, 0, 1, 3), ("m", 1, 1, 2, 3)], "model_id string, tid long, v0 long, v1 long, v2 long")
    v, kept = quantise.quantise_triangles(q, t)
    assert v.count() == 3 and kept.count() == 1
    assert q.agg(F.max("x") - F.min("x")).first()[0] == round(0.6 * 1023)
    rotation, shift = quantise.seeded_transform(5)
    assert abs(sum(c * c for c in rotation[:3]) - 1) < 1e-12 and all(abs(s) <= 0.35 for s in shift)


def test_long_flat_strip_is_one_patch(spark):
    at = lambda i: (i // 2, i % 2, 0)
    rows = []
    for i in range(150):
        v = (i, i + 1, i + 2) if i % 2 else (i + 1, i, i + 2)
        rows.append((1, i, *v, *[c for k in v for c in at(k)]))
    fat = spark.createDataFrame(rows, "mesh_id long, tid long, v0 long, v1 long, v2 long, " + ", ".join(f"{c} long" for c in mesh.CORNERS))
    got = merge.patches(fat, b=11).collect()
    assert len(got) == 150 and {r.patch for r in got} == {0}


def test_vertex_fans_are_walked_outside_the_plan(spark):
    """The driver compiles no expression over a vertex's arcs (more than 1,500 MB of the driver on 120,000 meshes)."""
    assert mesh.walks([(1, 2), (2, 3), (3, 1)]) == 1
    assert mesh.walks([(1, 2), (4, 5), (2, 1), (5, 4)]) == 2
    assert mesh.walks([(1, 2), (1, 3), (2, 1), (3, 1)]) == 1
    assert mesh.walks([(2, 3), (1, 2)]) == 2  # from the first arc, not from the start of its path
    _, t = templates.box_mesh(templates.box_rows(spark, [(1, 0, 0, 0, 0, 1, 1, 1)]))
    fans = mesh.vertex_fans(t)
    assert sorted((r.vid, r.fans) for r in fans.collect()) == [(v, 1) for v in range(8)]
    assert "aggregate(" not in fans._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_points_and_triangles_meet_once(spark):
    """900,000 points on 500 places took pairs with 60,000 boxes, most of them copies: too long, and too much for the driver."""
    boxes = spark.range(40).selectExpr("0L as scene", "0 as src", "id", *[f"0L as l{c}" for c in "xyz"], *[f"{k}L as h{c}" for c, k in zip("xyz", (4, 5, 6), strict=True)])
    tris = templates.box_triangles(boxes)
    points = spark.range(60).selectExpr("id as pid", "0L as scene", "1L + id % 2 * 4 as px", "1L as py", "2L as pz")
    once, _ = winding._once(tris, ["scene", "src"], 8)
    assert once.count() == 12 and {r.copies for r in once.collect()} == {40}
    got = winding.on_boundary(winding.windings(points, tris, [0], 8, 4), tris, 8, 4).collect()
    assert len(got) == 60 and {(r.px, r.w0, r.on_surface) for r in got} == {(1, 40, False), (5, 0, False)}
    assert {r.w for r in winding.crossings(points, tris, 8, 4).collect()} == {40}


def test_equal_scenes_are_worked_out_once(spark, tmp_path):
    """480 suppliers have 120 pairs of boxes: the solids of 120 scenes are built, and all 480 have rows (boxes repeat with s_suppkey mod 120)."""
    from tessel import queries

    spark.range(480).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    of, shapes = queries._shapes(spark, str(tmp_path), 0, 1)
    assert shapes.count() == 120 and {r.s_suppkey for r in shapes.collect()} == set(range(120))
    assert {(r.scene, r.shape) for r in of.collect()} == {(i, i % 120) for i in range(480)}
    got = {r.mesh_id: r.self_intersecting for r in queries.self_intersections(spark, str(tmp_path)).collect()}
    assert len(got) == 480 and all(got[i] == got[i % 120] for i in got) and set(got.values()) == {True}  # as the SQL has it


def test_soups_enter_plans_as_they_are(spark):
    """A boolean's plans hold no expressions of its meshes' planes: they took the driver more than 1,500 MB on 6,000 scenes."""
    s = soup(spark, [(0, 0, 0, 4, 4, 4)])
    for df in (s.polys, s.triangles):
        assert "Project" not in df._jdf.queryExecution().optimizedPlan().toString()
    slanted = [(0, 0, 0), (7, 3, 1), (2, 9, 5)]
    corner = [tuple(X.as_exact(v) for v in p) for p in slanted]
    support = X.plane_of(*corner)
    for k in range(3):
        cols = X.edge_plane(corner[k - 1], corner[k], support)[0]
        assert tuple(spark.range(1).select(*[c.col for c in cols]).first()) == Z.edge_plane(slanted[k - 1], slanted[k], Z.plane_of(*slanted))


ODD = [(1, 2, 3), (1, 3, 2), (2, 2, 3), (4, 4, 4), (3, 1, 2), (1, 2, 3), (5, 6, 7), (7, 6, 8), (5, 7, 9), (1, 7, 6)]


def test_topology_of_small_and_large_meshes_agrees(spark):
    """Whole meshes in Arrow batches give what aggregations and joins give, on random and broken meshes, a null mesh_id and null ids."""
    import random

    draw = random.Random(7)
    rows = [(m, draw.randrange(n) if m % 3 == 0 else i, *(draw.randrange(2 + m % 9) for _ in range(3))) for m in range(40) for n in [draw.randrange(1, 30)] for i in range(n)]
    rows += [(100, i, *c) for i, c in enumerate(ODD)] + [(101, i, *c) for i, c in enumerate(ODD[:3])] + [(102, 0, 4, 4, 4)]
    rows += [(None, i, *c) for i, c in enumerate(ODD)] + [(103, 0, 1, None, 2), (103, None, 1, 2, 3)]
    t = spark.createDataFrame(rows, "mesh_id long, tid long, v0 int, v1 int, v2 int")
    _, torus = templates.torus(spark.createDataFrame([(200, 9, 7), (201, 3, 3)], "mesh_id long, n int, m int"))
    t = t.unionByName(torus.withColumn("tid", F.col("tid").cast("long")))
    whole, mixed, spread = ({r.mesh_id: r for r in mesh.topology(t, small).collect()} for small in (mesh.SMALL, 15, 0))
    assert len(whole) == 40 + 7 and whole == mixed == spread
    assert None in whole and whole[None][1:] == whole[100][1:]


def test_whole_meshes_are_dealt_in_any_batches():
    import pyarrow as pa

    rows = [{"mesh_id": m, "tid": t, "v0": a, "v1": b, "v2": c} for m in (None, 1, 2, 5) for t, (a, b, c) in enumerate(templates.BOX_TRIANGLES)]
    table = pa.Table.from_pylist(rows)
    for size in (1, 7, 12, 1000):
        got = [r for b in mesh._whole_meshes(table.to_batches(max_chunksize=size), rows=10) for r in b.to_pylist()]
        assert [r["mesh_id"] for r in got] == [None, 1, 2, 5]
        assert all((r["v"], r["e"], r["f"], r["components"], r["extra_fans"], r["edge_manifold"]) == (8, 18, 12, 1, 0, True) for r in got)


def test_topology_broadcasts_no_triangles(spark):
    """Triangles count for about as many bytes as the rows they come from: 120,000 rows of part were broadcast as 344 MB of links and labels."""
    _, t = templates.box_mesh(templates.box_rows(spark, [(m, 0, 0, 0, 0, 1, 1, 1) for m in range(3)]))
    store = spark._jsparkSession.sharedState().statusStore()
    for figures in (mesh.topology, mesh._spread_meshes):
        before = store.executionsCount()
        assert {(r.v, r.e, r.f, r.components) for r in figures(t).collect()} == {(8, 18, 12, 1)}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
        assert plans and not any("Broadcast" in p for p in plans)
