"""Operators on small meshes with known answers."""

import math
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import config as cfg
from talweg.operators import contour, critical, export, fields, geodesic, levels, topology, vizprep
from talweg.plans import catalog
from talweg.plans.methods import METHODS, Engine
from talweg.sources import meshfile
from talweg.sources.tubes import Mesh, tubes

SF = "/root/testdata/sf0.001"


def mesh(spark, points, faces):
    v = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(points)], "mesh_id int, vid int, x double, y double, z double")
    f = spark.createDataFrame([(0, i, *t) for i, t in enumerate(faces)], "mesh_id int, fid int, a int, b int, c int")
    return Mesh(v, f)


def hexagon(spark, values):
    ring = [(math.cos(k * math.pi / 3), math.sin(k * math.pi / 3), 0) for k in range(6)]
    m = mesh(spark, [(0, 0, 0), *ring], [(0, 1 + k, 1 + (k + 1) % 6) for k in range(6)])
    return m, spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(values)], "mesh_id int, vid int, r double")


def test_tetrahedron_has_no_boundary(spark):
    m = mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)])
    assert topology.boundary_edges(m.faces).count() == 0
    assert topology.euler(m).first()["chi"] == 2


def test_two_triangles_are_two_loops(spark):
    m = mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 5), (1, 0, 5), (0, 1, 5)], [(0, 1, 2), (3, 4, 5)])
    loops = {r["vid"]: r["boundary_number"] for r in topology.boundary_loops(m).collect()}
    assert loops == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert topology.boundary_loops(m, huge=True).count() == 6
    d = {r["vid"]: r["value"] for r in geodesic.to_side(m.vertices, topology.both_ways(topology.weighted_edges(m)), m.vertices.where("vid = 0")).collect()}
    assert d[1] == 1 and math.isinf(d[3])


def plain_distances(arcs, n, seeds):
    """Bellman-Ford by loops."""
    d = [0.0 if v in seeds else math.inf for v in range(n)]
    moved = True
    while moved:
        moved = False
        for u, v, w in arcs:
            if d[u] + w < d[v]:
                d[v], moved = d[u] + w, True
    return d


@pytest.mark.parametrize("most", [25, 10**6])
def test_distances_part_by_part_equal_plain_ones(spark, most):
    m = tubes(spark, SF)
    arcs = topology.both_ways(topology.weighted_edges(m))
    seeds = spark.createDataFrame([(0, 5, 0), (0, 5, 17), (0, 5, 17), (0, 9, 120), (0, 11, 999)], "mesh_id int, source int, vid int")
    plain = defaultdict(list)
    for r in arcs.collect():
        plain[r["mesh_id"]].append((r["u"], r["v"], r["weight"]))
    got = {(r["source"], r["vid"]): round(r["d"], 9) for r in geodesic.distances(m.vertices, arcs, seeds, most=most).collect()}
    want = {(s, v): d for s, at in ((5, {0, 17}), (9, {120}), (11, set())) for v, d in enumerate(plain_distances(plain[0], 200, at))}
    assert got == {k: round(d, 9) for k, d in want.items()}
    near = {(r["source"], r["vid"]): r["d"] for r in geodesic.distances(m.vertices, arcs, seeds.where("source = 9"), 3.0, most).collect()}
    assert {k for k, d in near.items() if d < math.inf} == {k for k, d in want.items() if k[0] == 9 and d <= 3.0} and len(near) == 200


def test_conforming_field_of_parts_equals_plain_loops(spark):
    m = tubes(spark, SF)
    arcs = topology.both_ways(topology.weighted_edges(m))
    sided = topology.side_vertices(m)
    rim = {k: [r["vid"] for r in sided.where(F.col("boundary_side") == k).collect()] for k in ("lower", "upper")}
    rows = [(r["u"], r["v"], r["weight"]) for r in arcs.collect()]
    radius = {45: 2.0, 103: 4.5}
    reach = {s: plain_distances(rows, 200, {s}) for s in radius}
    want = []
    side = {b: plain_distances(rows, 200, {b}) for k in rim for b in rim[k]}
    for v in range(200):
        pull = {s: 1 / math.sinh(max(math.sqrt(max(reach[s][v] + q**2 - q, 0)), 1e-12)) for s, q in radius.items()}
        pull = {s: x / (sum(pull.values()) + 1e-12) for s, x in pull.items()}
        lo, up = (min(side[b][v] + sum(pull[s] * reach[s][b] for s in radius) for b in rim[k]) for k in ("lower", "upper"))
        want.append(up / (up + lo + 1e-9))
    saddles = spark.createDataFrame([(0, s, q) for s, q in radius.items()] + [(0, 45, 9.0)], "mesh_id int, vid int, radius double")
    for most in (50, 10**6):
        got = {r["vid"]: r["value"] for r in critical.conforming_field(m, sided, saddles, most=most).collect()}
        assert [got[v] for v in range(200)] == pytest.approx(want, abs=1e-9)
    with pytest.raises(Exception, match="upper side"):
        critical.conforming_field(m, sided.where("boundary_side <> 'upper'"), saddles).collect()


def test_parts_are_small_whatever_the_places(spark):
    same = spark.range(3000).selectExpr("0 as mesh_id", "cast(id as int) as vid", "0d as x", "case when id % 7 = 0 then null else 1d end as y", "0d as z")
    grid = spark.range(2500).selectExpr("1 as mesh_id", "cast(id as int) as vid", "cast(id % 50 as double) as x", "cast(id div 50 as double) as y", "0d as z")
    home, split = geodesic.parts(same.unionByName(grid), 100)
    sizes = home.groupBy("mesh_id", "part").count()
    assert split and home.count() == 5500 and sizes.agg(F.max("count")).first()[0] <= 100
    assert sizes.where("mesh_id = 1").count() <= 64  # places side by side stay together


@pytest.mark.parametrize(("values", "kind", "changes"), [([0, 1, -1, 1, -1, 1, -1], "saddle", 6), ([5, 1, 2, 3, 1, 2, 3], "maximum", 0), ([0, 1, 2, 3, 1, 2, 3], "minimum", 0), ([0, 1, 2, 1, -1, -2, -1], "regular", 2), ([0, 1, -1, -1, 1, -1, -1], "saddle", 4)])
def test_rings(spark, values, kind, changes):
    m, r = hexagon(spark, values)
    row = critical.critical_points(m, r).where("vid = 0").first()
    assert (row["critical_type"], row["changes"]) == (kind, changes)
    assert critical.critical_points(m, r).where("vid > 0 and critical_type <> 'regular'").count() == 0


def test_bow_tie_falls_back_to_angles(spark):
    m = mesh(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (-1, 0, 0), (-1, -1, 0)], [(0, 1, 2), (0, 3, 4)])
    assert critical.ring_order([(1, 2), (3, 4)]) is None
    assert sorted(critical.angle_order(np.zeros(3), {1: np.array([1.0, 0, 0]), 2: np.array([1.0, 1, 0]), 3: np.array([-1.0, 0, 0]), 4: np.array([-1.0, -1, 0])}, [(1, 2), (3, 4)])) == [1, 2, 3, 4]
    assert critical.critical_points(m, m.vertices.select("mesh_id", "vid", F.col("x").alias("r"))).count() == 5


@pytest.mark.parametrize("adaptive", [True, False])
def test_critical_points_equal_a_walk_round_each_ring(spark, adaptive):
    """Array functions against the walk in Python, with tied neighbours, flat rings and a vertex of two fans."""
    m = tubes(spark, SF, "isolated")
    extra = mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, 2), (1, 1, 1)], [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 1), (5, 1, 2), (5, 2, 3), (5, 3, 4), (5, 4, 1)])
    for one in (m, extra):
        r = fields.normalized(fields.coordinate(one))
        got = {x["vid"]: (x["critical_type"], x["changes"], round(x["confidence"], 9)) for x in critical.critical_points(one, r, 1e-12, adaptive).collect()}
        value = {x["vid"]: x["r"] for x in r.collect()}
        around = {}
        for f in one.faces.collect():
            for v, u, w in ((f["a"], f["b"], f["c"]), (f["b"], f["c"], f["a"]), (f["c"], f["a"], f["b"])):
                around.setdefault(v, []).append((u, w))
        border = {x["vid"] for x in topology.boundary_vertices(one.faces).collect()}
        for v in value:
            want = ("regular", 0, 0.0)
            if v in around and v not in border:
                ring = np.array([value[u] for u in critical.ring_order(around[v])])
                gaps = np.sort(np.abs(ring[:, None] - ring[None])[np.triu_indices(len(ring), 1)])
                eps = max(1e-12, min(0.1 * gaps[int(0.1 * (len(gaps) - 1))], 0.01 * (ring.max() - ring.min()))) if adaptive else 1e-12
                kind, changes = critical.classify_ring(value[v] - ring, eps)
                want = (kind, changes, round(critical.confidence_of(value[v] - ring, changes, eps, True), 9))
            assert got[v] == want


def test_degenerate_and_constant_fields(spark):
    m = mesh(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)], [(0, 1, 2)])
    r = fields.normalized(m.vertices.select("mesh_id", "vid", F.lit(3.0).alias("value")))
    assert {x["r"] for x in r.collect()} == {0.0}
    assert fields.face_gradients(m, r).first()["g"] == 0
    with pytest.raises(Exception, match="finite range"):
        fields.normalized(m.vertices.select("mesh_id", "vid", F.lit(float("inf")).alias("value"))).collect()


def test_level_through_a_vertex(spark):
    m = mesh(spark, [(0, 0, 0), (1, 0, 1), (0, 1, 0.5)], [(0, 1, 2)])
    r = m.vertices.select("mesh_id", "vid", F.col("z").alias("r"))
    assert contour.segments(m, r, [0.5]).count() == 1
    assert contour.segments(m, r, [0.5], strict=True).count() == 0


def test_flat_tube_contours_are_squares(spark):
    m = tubes(spark, SF, "plain", 0.0)
    r = fields.normalized(fields.coordinate(m))
    segs = contour.segments(m, r, [0.55])
    assert round(contour.level_sums(segs).first()["len_sum"], 6) == 20
    parts = contour.components(segs, contour.orientation_hints(m, r)).collect()
    assert len(parts) == 1 and parts[0]["is_closed"] and round(parts[0]["curve_length"], 6) == 20
    found = levels.adaptive_levels(m, r, 1.0).first()["levels"]
    assert found[0] == 0 and found[-1] == 1 and all(b > a for a, b in zip(found, found[1:], strict=False))


def levels_by_hand(m, r, height, blend):
    """The recurrence of each mesh with the contour cut anew at each level."""
    out = {}
    every = contour.segments
    for row in fields.layer_intervals(g := fields.effective_gradient(fields.face_gradients(m, r)), height).join(g, "mesh_id").collect():
        one = Mesh(m.vertices.where(f"mesh_id = {row['mesh_id']}"), m.faces.where(f"mesh_id = {row['mesh_id']}"))
        at, got = 0.0, [0.0]
        for done in range(row["n_intervals"] - 1):
            s = contour.level_sums(every(one, r, [at])).first()
            mean = s["wgrad_sum"] / s["len_sum"] if s and s["len_sum"] > 0 and s["wgrad_sum"] > 0 else row["g_eff"]
            rest = 1 - at
            at += min(min(max((1 - blend) * rest / (row["n_intervals"] - done) + blend * row["h_mod"] * mean, 1e-4), 0.2), rest)
            got.append(at)
        out[row["mesh_id"]] = [*got, 1.0] if at < 1 - 1e-12 else got
    return out


@pytest.mark.parametrize("cell", [500_000, 40])
def test_levels_equal_the_recurrence_over_contours(spark, cell):
    """However many ranges of breakpoints a mesh is walked in."""
    m = tubes(spark, SF)
    r = fields.normalized(fields.coordinate(m))
    got = {x["mesh_id"]: x["levels"] for x in levels.adaptive_levels(m, r, 2.0, 0.7, cell=cell).collect()}
    want = levels_by_hand(m, r, 2.0, 0.7)
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) and np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_levels_of_level_and_unreached_faces(spark):
    m = mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (5, 5, 5)], [(0, 1, 2), (0, 1, 3)])
    flat = m.vertices.select("mesh_id", "vid", F.lit(0.0).alias("r"))
    found = levels.adaptive_levels(m, flat, 0.5).first()["levels"]
    assert found[0] == 0 and found[-1] == 1
    odd = m.vertices.select("mesh_id", "vid", F.when(F.col("vid") == 3, float("nan")).otherwise(F.col("x")).alias("r"))
    assert levels.adaptive_levels(m, odd, 0.5).first()["levels"][-1] == 1


def test_curves():
    square = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 0]], float)
    assert np.allclose(contour.area_vector(square), [0, 0, 1])
    assert np.allclose(contour.oriented(square, np.array([0, 0, -1.0]), True), square[::-1])
    assert len(contour.resampled(square[:3], 5, False)) == 5
    assert np.allclose(contour.resampled(square, 200, True)[0], contour.resampled(square, 200, True)[-1])
    line = np.array([[x, 2 * x, 0] for x in range(9)], float)
    assert np.allclose(contour.smoothed_curve(line)[3:-3], line[3:-3])
    assert np.allclose(contour.nearest_tour(line[[3, 0, 2, 1]]), line[:4])
    assert len(contour.smoothed_curve(np.repeat(line[:2], 2, axis=0))) == 2


def test_methods_and_dispatch(spark):
    e = Engine(tubes(spark, SF), {"iso_slices": {"samples": 20}})
    with pytest.raises(ValueError, match="unknown method"):
        e.run("nothing")
    assert set(METHODS) == {"conformal", "planar_z", "principal_axis", "upper_only", "lower_only", "between_boundaries"}
    f = METHODS["conformal"](e).agg(F.min("value"), F.max("value")).first()
    assert f[0] >= 0 and f[1] <= 1
    assert e.run(" Planar_Z ", 3).slices.count() > 3


def test_saddles_keep_to_their_own_mesh(spark):
    m = tubes(spark, SF)
    coarse = Mesh(m.vertices.select(F.lit(1).alias("mesh_id"), "vid", *((F.col(c) * 10).alias(c) for c in "xyz")), m.faces.withColumn("mesh_id", F.lit(1)))
    both = Mesh(m.vertices.unionByName(coarse.vertices), m.faces.unionByName(coarse.faces))
    alone = {r["vid"] for r in Engine(m).saddles().collect()}
    found = Engine(both).saddles().collect()
    assert len(alone) > 1
    assert {r["vid"] for r in found if r["mesh_id"] == 0} == {r["vid"] for r in found if r["mesh_id"] == 1} == alone
    a_length = {"critical_points": {"clip_saddles": {"mode": "absolute", "value": 3.0}}}
    times_ten = {"critical_points": {"clip_saddles": {"mode": "absolute", "value": 30.0}}}
    ids = lambda mesh, over: {r["vid"] for r in Engine(mesh, over).saddles().collect()}
    assert ids(m, a_length) == ids(coarse, times_ten) < ids(coarse, a_length)


def test_exports(spark, tmp_path):
    import json

    m = tubes(spark, SF)
    r = fields.normalized(fields.coordinate(m))
    parts = contour.components(contour.segments(m, r, [0.3, 0.6]), contour.orientation_hints(m, r))
    path = export.save_document(export.slice_documents(contour.slices(parts, 20), parts), 0, str(tmp_path / "new"))
    doc = json.loads(path.read_text())
    assert doc["meta"]["slice_count"] == len(doc["slices"]) == 2 and len(doc["slices"][0]["components"][0]["points"][0]) == 3
    assert len(json.loads(export.field_documents(m, fields.coordinate(m)).first()["document"])["vertices"]) == 200
    export.save_graphml(export.graphml_lines(m.vertices, topology.labelled_edges(m)), 0, str(tmp_path / "g.xml"))
    assert (tmp_path / "g.xml").read_text().count("<node") == 200
    assert "canvas" in vizprep.save_html(m, fields.coordinate(m), 0, str(tmp_path / "m.html")).read_text()


def judged(m, mesh_id=0):
    """Points, values and kinds of the vertices of one mesh, by a walk round each ring, and the tied ones among them."""
    at = {r["vid"]: (r["x"], r["y"], r["z"]) for r in m.vertices.where(F.col("mesh_id") == mesh_id).collect()}
    faces = [(r["a"], r["b"], r["c"]) for r in m.faces.where(F.col("mesh_id") == mesh_id).collect()]
    lo, hi = min(p[2] for p in at.values()), max(p[2] for p in at.values())
    value = {v: (p[2] - lo) / (hi - lo) for v, p in at.items()}
    kinds, tied = dict.fromkeys(at, "regular"), set()
    for v in at:
        step = {f[(f.index(v) + 1) % 3]: f[(f.index(v) + 2) % 3] for f in faces if v in f}
        if set(step) != set(step.values()):
            continue  # a boundary vertex
        ring = [min(step)]
        while step[ring[-1]] != ring[0]:
            ring.append(step[ring[-1]])
        r = [value[u] for u in ring]
        gaps = sorted(abs(p - q) for i, p in enumerate(r) for q in r[i + 1 :])
        tol = max(1e-12, min(0.1 * gaps[int(0.1 * (len(gaps) - 1))], 0.01 * (max(r) - min(r))))
        over = [value[v] > x for x in r if abs(value[v] - x) > tol]
        turns = sum(over[i] != over[i - 1] for i in range(len(over)))
        kinds[v] = "saddle" if turns >= 4 else "regular" if turns or not over else "maximum" if over[0] else "minimum"
        if any(abs(value[v] - x) <= 1e-12 for x in r):
            tied.add(v)
    return at, faces, value, kinds, tied


def test_queries_of_all_critical_points(spark):
    m = tubes(spark, SF)
    at, faces, value, kinds, tied = judged(m)
    assert any(kinds[v] == "saddle" for v in tied)
    rows = lambda name: catalog.queries()[name](spark, SF).where("mesh_id = 0").collect()
    assert {r["critical_type"]: r["n"] for r in rows("critical_planar")} == Counter(kinds.values())
    points = [v for v in at if kinds[v] != "regular"]
    assert {r["vid"]: (r["critical_type"], r["value_gap"]) for r in rows("value_gaps")} == {v: (kinds[v], pytest.approx(min(abs(value[v] - value[u]) for u in points if u != v), abs=1e-6)) for v in points}
    d = np.full((200, 200), np.inf)
    np.fill_diagonal(d, 0)
    for f in faces:
        for p, q in zip(f, f[1:] + f[:1], strict=True):
            d[p, q] = d[q, p] = math.dist(at[p], at[q])
    for k in range(200):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    saddles = [v for v in at if kinds[v] == "saddle"]
    assert {r["vid"]: r["value"] for r in rows("distance_to_saddles")} == {v: pytest.approx(d[v, saddles].min(), abs=1e-6) for v in at}
    sides = [r["vid"] for r in topology.side_vertices(m).where("mesh_id = 0").collect()]
    assert {r["vid"]: r["radius"] for r in rows("saddle_radius")} == {s: pytest.approx(d[s, sides].min(), abs=1e-6) for s in saddles}
    want = Counter()
    for r in contour.segments(m, fields.normalized(fields.coordinate(m)), catalog.LEVELS).where("mesh_id = 0").collect():
        want[r["layer"], min(saddles, key=lambda s: (round(math.dist(at[s], tuple(r["p0"][c] for c in "xyz")) ** 2, 9), s))] += 1
    assert {(r["layer"], r["vid"]): r["n"] for r in rows("saddle_histogram")} == want


def test_nearest_nodes_of_all_vertices(spark):
    at = {(r["mesh_id"], r["vid"]): np.array([r["x"], r["y"], r["z"]]) for r in tubes(spark, SF).vertices.collect()}
    got = {(r["mesh_id"], r["pid"]): (r["vid"], r["distance"]) for r in catalog.queries()["nearest_nodes"](spark, SF).collect()}
    assert got.keys() == at.keys()
    for (mesh_id, pid), (vid, distance) in got.items():
        near = {v: float(np.linalg.norm(p - at[mesh_id, pid] - [0.3, -0.2, 0.1])) for (k, v), p in at.items() if k == mesh_id}
        least = min(near.values())
        assert distance == pytest.approx(least, abs=1e-6) and near[vid] == pytest.approx(least, abs=1e-9)


def test_documents_name_the_nearest_of_all_saddles(spark):
    import json

    m, named_tied = tubes(spark, "/root/testdata/sf0.01"), 0
    for row in catalog._documents(m).where("mesh_id < 5").collect():
        at, _, _, kinds, tied = judged(m, row["mesh_id"])
        saddles = [v for v in at if kinds[v] == "saddle"]
        for c in (c for s in json.loads(row["document"])["slices"] for c in s["components"]):
            near = Counter(min(saddles, key=lambda v: (sum((a - b) * (a - b) for a, b in zip(at[v], p, strict=True)), v)) for p in c["points"])
            assert {b["index"]: b["count"] for b in c["topology"]["saddle_histogram"]} == near
            named_tied += len(tied & set(near))
    assert named_tied


def test_mesh_files(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2 3 4\n")
    (tmp_path / "b.off").write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    (tmp_path / "d.stl").write_bytes(b"\0" * 80 + struct.pack("<I12fH", 1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0))
    m = meshfile.load_meshes(spark, str(tmp_path))
    assert [r["count"] for r in m.vertices.groupBy("mesh_id").count().orderBy("mesh_id").collect()] == [4, 3, 3, 3]
    assert m.faces.where("mesh_id = 0").count() == 2
    spark.dataSource.register(meshfile.MeshSource)
    assert spark.read.format("mesh").option("part", "faces").load(str(tmp_path / "a.obj")).count() == 2


def test_config(tmp_path):
    assert cfg.to_bool(" Yes ", False) and not cfg.to_bool("off", True) and cfg.to_bool("maybe", True)
    assert cfg.to_axis("Q") == "z" and cfg.to_int("x", 4) == 4 and cfg.to_floats([1, "a"], []) == [1.0, 0.0]
    assert cfg.layer_step(15, 0.1)[0] == 5
    (tmp_path / "c.yaml").write_text("iso_slices: {samples: 7}")
    assert cfg.defaults(cfg.yaml_overrides(str(tmp_path / "c.yaml")))["iso_slices"]["samples"] == 7
    assert cfg.DEFAULTS["iso_slices"]["samples"] == 1800
    (tmp_path / "v.yaml").write_text("global: {auto_open: false}\niso_slices: {line_width: 1}")
    got = cfg.view_section("iso_slices", str(tmp_path / "v.yaml"))
    assert got["line_width"] == 1 and got["auto_open"] is False and got["save_html"] is False and cfg.VIEWS["iso_slices"]["line_width"] == 2.5
    (tmp_path / "list.yaml").write_text("[1, 2]")
    assert cfg.yaml_overrides(str(tmp_path / "list.yaml")) == {}


def smoothed_by_hand(m, value, times):
    faces = [(r["a"], r["b"], r["c"]) for r in m.faces.collect()]
    near, seen = {}, Counter()
    for t in faces:
        for a, b in ((0, 1), (1, 2), (2, 0)):
            near.setdefault(t[a], set()).add(t[b])
            near.setdefault(t[b], set()).add(t[a])
            seen[frozenset((t[a], t[b]))] += 1
    fixed = {v for e, n in seen.items() if n == 1 for v in e}
    for _ in range(times):
        value = {v: x if v in fixed or v not in near else 0.5 * x + 0.5 * np.mean([value[u] for u in near[v]]) for v, x in value.items()}
    return value, near, fixed


def test_options_of_saddles(spark):
    """Smoothing, persistence, strategies, several scales and radii, each against the steps done by hand."""
    m = tubes(spark, SF)
    raw = {r["vid"]: r["value"] for r in fields.coordinate(m).collect()}
    lo, hi = min(raw.values()), max(raw.values())
    unit = {v: (x - lo) / (hi - lo) for v, x in raw.items()}
    runs = []
    for k in range(3):
        value, _, _ = smoothed_by_hand(m, unit, k + 1)
        r = spark.createDataFrame([(0, v, float(x)) for v, x in value.items()], "mesh_id int, vid int, r double")
        found = {x["vid"]: x["critical_type"] for x in critical.critical_points(m, r).collect()}
        kinds = [v for v, t in found.items() if t != "regular"]
        gap = {v: min((abs(value[v] - value[u]) for u in kinds if u != v), default=math.inf) for v in kinds}
        runs.append({v for v in kinds if found[v] == "saddle" and gap[v] >= 0.01 * k})
        if k == 1:
            got = critical.detect(m, fields.coordinate(m), smooth=k + 1, persistence=0.01 * k).where("critical_type = 'saddle'")
            assert {x["vid"] for x in got.collect()} == runs[k]
    votes = Counter(v for run in runs for v in run)
    one = Engine(m, {"critical_points": {"multi_scale": True, "smooth_field": True, "smooth_iterations": 1, "clip_saddles_geodesic_threshold": 0, "min_consensus": 0.6}})
    assert {x["vid"] for x in one.saddles().collect()} == {v for v, n in votes.items() if n >= 2}


def test_strategies_and_radii(spark):
    m = tubes(spark, SF)
    r = fields.normalized(fields.coordinate(m))
    all_ = critical.critical_points(m, r)
    salient = {x["vid"]: x["saliency"] for x in critical.saliency(m.faces, r).collect()}
    by = {k: {x["vid"]: x["score"] for x in critical.scored(m, all_, r, k).collect()} for k in ("confidence", "saliency", "none")}
    assert set(by["none"].values()) == {0.0} and all(by["saliency"][v] == salient[v] for v in by["saliency"])
    for k in by:
        kept = {x["kept"] for x in critical.saddle_clusters(m, critical.scored(m, all_, r, k), 1.5, True).collect()}
        got = critical.detect(m, fields.coordinate(m), clip=1.5, clip_by_edge=True, strategy=k).where("critical_type = 'saddle'")
        assert {x["vid"] for x in got.collect()} == kept
    saddles = spark.createDataFrame([(0, 50), (0, 90)], "mesh_id int, vid int")
    assert [x["radius"] for x in critical.given_radii(saddles, [1.0, 2.0]).orderBy("vid").collect()] == [1.0, 2.0]
    with pytest.raises(Exception, match="radii are given"):
        critical.given_radii(saddles, [1.0]).collect()
    index = {"minimum": 0, "saddle": 1, "maximum": 2, "regular": -1}
    assert all(x["morse_index"] == index[x["critical_type"]] for x in critical.annotated(all_).collect())


def test_default_run_and_views(spark, tmp_path):
    import json
    from xml.etree import ElementTree

    from talweg.plans.methods import export_name, run_default

    m = tubes(spark, SF, amp=0.05)
    _, summary, files = run_default(m, {"general": {"slicing_method": "planar_z"}, "iso_slices": {"samples": 20, "layer_height": 2}, "exports": {"export_directory": str(tmp_path)}}, {0: "tube"})
    assert files == [str(tmp_path / export_name("tube", 2, "planar_z"))] == [str(tmp_path / "tube_lh2_planar_z.json")]
    doc = json.loads((tmp_path / "tube_lh2_planar_z.json").read_text())
    assert doc["meta"]["slice_count"] == summary.first()["total_slices"] and doc["meta"]["mesh"] == {"vertex_count": 200, "face_count": 352}
    (tmp_path / "file").write_text("")
    _, _, files = run_default(m, {"general": {"slicing_method": "planar_z"}, "iso_slices": {"samples": 20, "layer_height": 2}, "exports": {"export_directory": str(tmp_path / "file")}})
    assert len(files) == 1 and files[0].startswith("not written")
    export.save_graphml(export.graphml_lines(Engine(m).nodes(), topology.labelled_edges(m)), 0, str(tmp_path / "g.xml"))
    root = ElementTree.parse(tmp_path / "g.xml").getroot()
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert {k.get("attr.name") for k in root.findall(f"{ns}key")} >= {"morse_index", "critical_type", "boundary_side", "weight"}
    assert len(root.find(f"{ns}graph").findall(f"{ns}node")) == 200
    field = json.loads(export.field_documents(m, fields.coordinate(m)).first()["document"])
    assert field["meta"]["vertex_count"] == 200 and field["meta"]["face_count"] == 352 and set(field) == {"meta", "vertices", "scalar_field", "faces"}
    arcs = topology.both_ways(topology.weighted_edges(m))
    assert vizprep.side_view(m, arcs, topology.side_vertices(m), "lower").where("value = 0").count() == topology.side_vertices(m, "lower").count()
    with pytest.raises(RuntimeError, match="sides"):
        vizprep.side_view(m, arcs, topology.side_vertices(m).limit(0), "lower")
    with pytest.raises(RuntimeError, match="saddle"):
        vizprep.saddles_view(m, arcs, critical.critical_points(m, fields.normalized(fields.coordinate(m))).where("false"))
    assert [r["value"] for r in vizprep.bounded(spark.createDataFrame([(1.0,), (5.0,), (None,)], "value double"), 2, 4).collect()][:2] == [2.0, 4.0]
