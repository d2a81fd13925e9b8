"""Edges, boundaries, loops and sides of many meshes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.operators.graph import PART, components
from talweg.sources.tubes import Mesh


def half_edges(faces: DataFrame) -> DataFrame:
    """``mesh_id, fid, u, v``: the three sides of each face, u < v."""
    sides = F.explode(F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    return faces.select("mesh_id", "fid", sides.alias("s")).select("mesh_id", "fid", "s.*")


def edges(faces: DataFrame) -> DataFrame:
    """Distinct edges with the number of faces on them: counted before and after one shuffle."""
    return half_edges(faces).groupBy("mesh_id", "u", "v").agg(F.count("*").alias("n_faces"))


def distance(p: str, q: str) -> Column:
    """Length between the points of two struct columns."""
    return F.sqrt(reduce(Column.__add__, [(F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) * (F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) for c in "xyz"]))


def points(vertices: DataFrame, vid: str, name: str) -> DataFrame:
    """Vertices as a join side: ``mesh_id``, the id under another name, and the position as a struct."""
    return vertices.select("mesh_id", F.col("vid").alias(vid), F.struct("x", "y", "z").alias(name))


def weighted_edges(mesh: Mesh) -> DataFrame:
    """Edges with their Euclidean length ``weight``."""
    e = edges(mesh.faces).join(points(mesh.vertices, "u", "p"), ["mesh_id", "u"]).join(points(mesh.vertices, "v", "q"), ["mesh_id", "v"])
    return e.select("mesh_id", "u", "v", "n_faces", distance("p", "q").alias("weight"))


def both_ways(e: DataFrame) -> DataFrame:
    """Each edge as two arcs ``u -> v`` in one pass, without a second scan."""
    arcs = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return e.select("mesh_id", "weight", F.explode(arcs).alias("arc")).select("mesh_id", "arc.u", "arc.v", "weight")


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edges(faces).where("n_faces = 1").select("mesh_id", "u", "v")


def boundary_vertices(faces: DataFrame) -> DataFrame:
    return boundary_edges(faces).select("mesh_id", F.explode(F.array("u", "v")).alias("vid")).distinct()


def median_edge(mesh: Mesh, sample: int = 5000) -> DataFrame:
    """Median edge length of each mesh. A mesh without edges takes the median distance to the nearest other one among its first ``sample`` vertices, 1.0 if these are fewer than two."""
    got = weighted_edges(mesh).groupBy("mesh_id").agg(F.percentile("weight", F.lit(0.5)).alias("median_edge"))
    lone = mesh.vertices.select("mesh_id").distinct().join(got, "mesh_id", "left_anti")
    first = mesh.vertices.join(lone, "mesh_id", "left_semi").where(F.col("vid") < sample)
    near = first.alias("a").join(first.alias("b"), (F.col("a.mesh_id") == F.col("b.mesh_id")) & (F.col("a.vid") != F.col("b.vid")), "left")
    gap = near.select("a.mesh_id", "a.vid", F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "xyz")).alias("d")).groupBy("mesh_id", "vid").agg(F.min("d").alias("d"))
    return got.unionByName(gap.groupBy("mesh_id").agg(F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(1.0)).alias("median_edge")))


def euler(mesh: Mesh) -> DataFrame:
    """Counts of vertices, edges and faces and V - E + F."""
    nv = mesh.vertices.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))
    nf = mesh.faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))
    ne = edges(mesh.faces).groupBy("mesh_id").agg(F.count("*").alias("n_edges"))
    out = nv.join(ne, "mesh_id", "left").join(nf, "mesh_id", "left").fillna(0)
    return out.select("mesh_id", "n_vertices", "n_edges", "n_faces", (F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).alias("chi"))


def _labels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least vertex of each component of one mesh's edges (union-find)."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    vids = sorted(up)
    return pd.DataFrame({"mesh_id": pdf["mesh_id"].iloc[0], "vid": vids, "label": [find(x) for x in vids]})


def component_labels(e: DataFrame, huge: bool = False, part: int = PART) -> DataFrame:
    """``mesh_id, vid, label``: the least vertex of each vertex's component.

    Meshes are independent, so by default each is labelled in one task by union-find over the
    given edges; ``huge`` spreads large meshes instead, in a number of rounds that grows with the
    logarithm of their vertices.
    """
    if not huge:
        return e.select("mesh_id", "u", "v").groupBy("mesh_id").applyInPandas(_labels, "mesh_id int, vid int, label int")
    node = lambda k: F.shiftleft(F.col("mesh_id").cast("long"), 32) + F.col(k)
    found = components(e.select(node("u").alias("a"), node("v").alias("b")), part)
    vid = lambda c: (F.col(c) - F.shiftleft(F.shiftright(c, 32), 32)).cast("int")
    return found.select(F.shiftright("node", 32).cast("int").alias("mesh_id"), vid("node").alias("vid"), vid("root").alias("label"))


def boundary_loops(mesh: Mesh, huge: bool = False) -> DataFrame:
    """``mesh_id, vid, boundary_number``: loops numbered from 0 by mean height, ties by least vertex."""
    labels = component_labels(boundary_edges(mesh.faces), huge)
    mean = labels.join(mesh.vertices, ["mesh_id", "vid"]).groupBy("mesh_id", "label").agg(F.round(F.avg("z"), 9).alias("mean_z"))
    order = Window.partitionBy("mesh_id").orderBy("mean_z", "label")
    number = mean.select("mesh_id", "label", (F.row_number().over(order) - 1).alias("boundary_number"))
    return labels.join(number, ["mesh_id", "label"]).select("mesh_id", "vid", "boundary_number")


def loop_metadata(mesh: Mesh, loops: DataFrame) -> DataFrame:
    """Size and centroid of each loop."""
    return loops.join(mesh.vertices, ["mesh_id", "vid"]).groupBy("mesh_id", "boundary_number").agg(F.count("*").alias("n_vertices"), *(F.avg(c).alias(f"c{c}") for c in "xyz"))


def loop_sides(meta: DataFrame, axis: str = "z", side_tol: float = 0.05, assign_middle: bool = True) -> DataFrame:
    """Side of each loop by its mean along ``axis``: within the tolerance of the range's ends, the middle by the nearer end (ties: lower) or null."""
    if axis not in ("x", "y", "z"):
        raise ValueError("axis must be x, y or z")
    m, w = F.col(f"c{axis}"), Window.partitionBy("mesh_id")
    lo, hi = F.min(f"c{axis}").over(w), F.max(f"c{axis}").over(w)
    slack = F.greatest(hi - lo, F.lit(1e-14)) * side_tol
    side = F.when(m <= lo + slack, "lower").when(m >= hi - slack, "upper")
    if assign_middle:
        side = side.otherwise(F.when(F.abs(m - lo) <= F.abs(hi - m), "lower").otherwise("upper"))
    return meta.select("mesh_id", "boundary_number", side.alias("boundary_side"))


def side_vertices(mesh: Mesh, side: str | None = None, **options: object) -> DataFrame:
    """``mesh_id, vid, boundary_number, boundary_side`` of boundary vertices, of one side if named."""
    if side not in (None, "lower", "upper"):
        raise ValueError("side must be lower or upper")
    loops = boundary_loops(mesh)
    out = loops.join(loop_sides(loop_metadata(mesh, loops), **options), ["mesh_id", "boundary_number"])
    return (out.where(F.col("boundary_side") == side) if side else out).select("mesh_id", "vid", "boundary_number", "boundary_side")


def labelled_edges(mesh: Mesh, **options: object) -> DataFrame:
    """Edges with type, and number and side of the loop that both ends share."""
    s = side_vertices(mesh, **options)
    u, v = (s.select("mesh_id", F.col("vid").alias(k), F.col("boundary_number").alias(f"b{k}"), F.col("boundary_side").alias(f"s{k}")) for k in "uv")
    e = weighted_edges(mesh).join(u, ["mesh_id", "u"], "left").join(v, ["mesh_id", "v"], "left")
    on = (F.col("n_faces") == 1) & (F.col("bu") == F.col("bv"))
    return e.select("mesh_id", "u", "v", "weight", "n_faces", F.when(on, "boundary").otherwise("interior").alias("edge_type"), F.when(on, F.col("bu")).alias("boundary_number"), F.when(on, F.col("su")).alias("boundary_side"))
