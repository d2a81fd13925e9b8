"""Scalar fields on vertices and their gradients on faces."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.sources.tubes import Mesh


def axis_distance(mesh: Mesh, axis: str) -> DataFrame:
    """Coordinate above the mesh's least along one axis."""
    if axis not in ("x", "y", "z"):
        raise ValueError("axis must be x, y or z")
    least = mesh.vertices.groupBy("mesh_id").agg(F.min(axis).alias("least"))
    return mesh.vertices.select("mesh_id", "vid", axis).join(least, "mesh_id").select("mesh_id", "vid", (F.col(axis) - F.col("least")).alias("value"))


def coordinate(mesh: Mesh, axis: str = "z") -> DataFrame:
    return mesh.vertices.select("mesh_id", "vid", F.col(axis).alias("value"))


def normalized(field: DataFrame) -> DataFrame:
    """``mesh_id, vid, r``: values scaled to [0, 1] per mesh; NaN is ignored in the range and stays NaN; no range: 0.

    Meshes whose range isn't finite are an error, raised when the rows are read. The range is aggregated
    before it meets the rows, so one huge mesh stays spread; ``field`` is planned twice, so write a costly one first.
    """
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    real = F.when(~F.isnan(v), v)
    ranges = field.groupBy("mesh_id").agg(F.min(real).alias("lo"), F.max(real).alias("hi"))
    bad = lo.isNull() | (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
    scaled = F.when(F.isnan(v), v).otherwise(F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    r = F.when(bad, F.raise_error(F.lit("field has no finite range")).cast("double")).when(hi - lo <= 0, 0.0).otherwise(scaled)
    return field.select("mesh_id", "vid", "value").join(ranges, "mesh_id").select("mesh_id", "vid", r.alias("r"))


def field_stats(field: DataFrame) -> DataFrame:
    """Least, largest, mean, population deviation and range per mesh."""
    out = field.groupBy("mesh_id").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.withColumn("range", F.col("max") - F.col("min"))


def bounding_box(mesh: Mesh) -> DataFrame:
    return mesh.vertices.groupBy("mesh_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def covariance(mesh: Mesh) -> DataFrame:
    """The six sample covariances of positions, and the number of vertices."""
    return mesh.vertices.groupBy("mesh_id").agg(F.count("*").alias("n"), *(F.covar_samp(p, q).alias(p + q) for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")))


def principal_axes(mesh: Mesh) -> DataFrame:
    """Direction of most spread per mesh, toward the box's far corner; (0, 0, 1) under three vertices or without spread. One row a mesh is all Python sees."""
    rows = covariance(mesh).join(bounding_box(mesh), "mesh_id")

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                d = np.array([0.0, 0.0, 1.0])
                if r.n >= 3:
                    vec = np.linalg.eigh(np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]]))[1][:, 2]
                    if np.linalg.norm(vec) > 1e-8:
                        d = vec / np.linalg.norm(vec)
                if d @ np.array([r.max_x - r.min_x, r.max_y - r.min_y, r.max_z - r.min_z]) < 0:
                    d = -d
                out.append((r.mesh_id, *map(float, d)))
            yield type(pdf)(out, columns=["mesh_id", "dx", "dy", "dz"])

    return rows.mapInPandas(solve, "mesh_id int, dx double, dy double, dz double")


def principal_projection(mesh: Mesh) -> DataFrame:
    j = mesh.vertices.join(principal_axes(mesh), "mesh_id")
    return j.select("mesh_id", "vid", (F.col("x") * F.col("dx") + F.col("y") * F.col("dy") + F.col("z") * F.col("dz")).alias("value"))


def corners(mesh: Mesh, field: DataFrame) -> DataFrame:
    """Faces with structs ``pa, pb, pc`` of position and value ``r`` (columns of ``field``: r)."""
    v = mesh.vertices.join(field, ["mesh_id", "vid"])
    out = mesh.faces
    for k in "abc":
        out = out.join(v.select("mesh_id", F.col("vid").alias(k), F.struct("x", "y", "z", "r").alias(f"p{k}")), ["mesh_id", k])
    return out


def _dot(p: list[Column], q: list[Column]) -> Column:
    return reduce(Column.__add__, [a * b for a, b in zip(p, q, strict=True)])


def gradient_norm(eps: float = 1e-12) -> Column:
    """Length of the field's gradient over the triangle ``pa, pb, pc``; 0 if the triangle is degenerate."""
    e1, e2 = ([F.col(f"{k}.{c}") - F.col(f"pa.{c}") for c in "xyz"] for k in ("pb", "pc"))
    n = [e1[i] * e2[j] - e1[j] * e2[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    xj, area = F.sqrt(_dot(e1, e1)), F.sqrt(_dot(n, n))
    xk, yk = _dot(e1, e2) / xj, area / xj
    a = (F.col("pb.r") - F.col("pa.r")) / xj
    b = (F.col("pc.r") - F.col("pa.r") - xk * a) / yk
    return F.when((xj < eps) | (area < eps) | (yk < eps), 0.0).otherwise(F.hypot(a, b))


def face_gradients(mesh: Mesh, field: DataFrame) -> DataFrame:
    return corners(mesh, field).select("mesh_id", "fid", gradient_norm().alias("g"))


def effective_gradient(gradients: DataFrame) -> DataFrame:
    """Median of the finite gradients per mesh; 1 if there is none above 0."""
    ok = F.when(~F.isnan("g") & (F.col("g") < float("inf")) & (F.col("g") >= 0), F.col("g"))
    g = gradients.groupBy("mesh_id").agg(F.percentile(ok, F.lit(0.5)).alias("g"))
    return g.select("mesh_id", F.when(F.col("g") > 0, F.col("g")).otherwise(1.0).alias("g_eff"))


def layer_intervals(g_eff: DataFrame, height: float, clip: tuple[float, float] = (1e-4, 0.2)) -> DataFrame:
    """Number of intervals, step and evened height per mesh."""
    step = F.least(F.greatest(F.lit(float(height)) * F.col("g_eff"), F.lit(clip[0])), F.lit(clip[1]))
    n = F.greatest(F.lit(1.0), F.rint(1 / step))
    return g_eff.select("mesh_id", n.cast("int").alias("n_intervals"), step.alias("step"), (1 / n / F.col("g_eff")).alias("h_mod"))


def smoothed(field: DataFrame, arcs: DataFrame, boundary: DataFrame, iterations: int = 2, weight: float = 0.5) -> DataFrame:
    """Mean-of-neighbours smoothing from the old values; boundary vertices stay. Columns of ``field``: value."""
    keep = boundary.select("mesh_id", "vid", F.lit(True).alias("fixed"))
    for _ in range(iterations):
        mean = arcs.join(field.withColumnRenamed("vid", "v"), ["mesh_id", "v"]).groupBy("mesh_id", F.col("u").alias("vid")).agg(F.avg("value").alias("mean"))
        new = field.join(mean, ["mesh_id", "vid"], "left").join(keep, ["mesh_id", "vid"], "left")
        mixed = F.when(F.col("fixed") | F.col("mean").isNull(), F.col("value")).otherwise((1 - weight) * F.col("value") + weight * F.col("mean"))
        field = new.select("mesh_id", "vid", mixed.alias("value"))
    return field
