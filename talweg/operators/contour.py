"""Iso-segments, their lengths, stitching into components and curves."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.operators.fields import corners, gradient_norm
from talweg.sources.tubes import Mesh

TOL = 1e-6
POINT = "struct<x:double,y:double,z:double>"


def _hit(p: str, q: str, level: Column, tol: float) -> Column:
    """Struct of whether the side p-q meets the level, and where."""
    fp, fq = F.col(f"{p}.r"), F.col(f"{q}.r")
    t = (level - fp) / (fq - fp)
    off = ((fp > level + tol) & (fq > level + tol)) | ((fp < level - tol) & (fq < level - tol)) | (F.abs(fq - fp) < tol)
    at = F.struct(*((F.col(f"{p}.{c}") + t * (F.col(f"{q}.{c}") - F.col(f"{p}.{c}"))).alias(c) for c in "xyz"))
    return F.when(~off, F.when((t >= -tol) & (t <= 1 + tol), at))


def segments(mesh: Mesh, field: DataFrame, levels: DataFrame | list[float], tol: float = TOL, strict: bool = False) -> DataFrame:
    """``mesh_id, layer, level, fid, g, p0, p1, len`` of all levels in one pass over the faces (columns of ``field``: r).

    ``levels`` is a list for all meshes or a table ``mesh_id, levels array<double>``; a face only meets the
    levels between its least and largest value. A face gives the first two of the sides hit, in
    the order ab, bc, ca; ``strict`` keeps only faces with just two.
    """
    faces = corners(mesh, field).select("mesh_id", "fid", "pa", "pb", "pc", gradient_norm().alias("g"))
    if isinstance(levels, list):
        faces = faces.withColumn("levels", F.array(*(F.lit(float(v)) for v in levels)))
    else:
        faces = faces.join(levels, "mesh_id")
    lo, hi = F.least("pa.r", "pb.r", "pc.r") - tol, F.greatest("pa.r", "pb.r", "pc.r") + tol
    at = F.filter(F.transform("levels", lambda v, i: F.struct(i.alias("layer"), v.alias("level"))), lambda s: (s["level"] >= lo) & (s["level"] <= hi))
    rows = faces.select("mesh_id", "fid", "pa", "pb", "pc", "g", F.explode(at).alias("s")).select("*", "s.layer", "s.level")
    hits = F.filter(F.array(*(_hit(p, q, F.col("level"), tol) for p, q in (("pa", "pb"), ("pb", "pc"), ("pc", "pa")))), lambda h: h.isNotNull())
    rows = rows.withColumn("hits", hits).where(F.size("hits") == 2 if strict else F.size("hits") >= 2)
    rows = rows.select("mesh_id", "layer", "level", "fid", "g", F.get("hits", F.lit(0)).alias("p0"), F.get("hits", F.lit(1)).alias("p1"))
    return rows.withColumn("len", F.sqrt(sum((F.col(f"p1.{c}") - F.col(f"p0.{c}")) * (F.col(f"p1.{c}") - F.col(f"p0.{c}")) for c in "xyz")))


def level_sums(segs: DataFrame) -> DataFrame:
    """Number of segments, total length and gradient-weighted length per level."""
    return segs.groupBy("mesh_id", "layer", "level").agg(F.count("*").alias("n_segments"), F.sum("len").alias("len_sum"), F.sum(F.when(~F.isnan("g") & (F.col("g") < float("inf")), F.col("g") * F.col("len")).otherwise(0.0)).alias("wgrad_sum"))


def grid_key(p: str, decimals: int = 6) -> Column:
    """Coordinates rounded half to even on the grid that joins endpoints."""
    return F.struct(*((F.rint(F.col(f"{p}.{c}") * 10**decimals) / 10**decimals).alias(c) for c in "xyz"))


def endpoint_buckets(segs: DataFrame, decimals: int = 6) -> DataFrame:
    """Grid points with how many segment ends lie on each."""
    ends = segs.select("mesh_id", "layer", F.explode(F.array(grid_key("p0", decimals), grid_key("p1", decimals))).alias("p"))
    return ends.groupBy("mesh_id", "layer", "p.x", "p.y", "p.z").agg(F.count("*").alias("n_ends"))


def _near_pairs(points: np.ndarray, radius: float):
    """Index pairs of points within ``radius``, by a grid of that size."""
    cells: dict[tuple, list[int]] = {}
    for i, c in enumerate(map(tuple, np.floor(points / radius).astype(np.int64).tolist())):
        for key in ((c[0] + a, c[1] + b, c[2] + d) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)):
            for j in cells.get(key, ()):
                if np.linalg.norm(points[i] - points[j]) <= radius:
                    yield j, i
        cells.setdefault(c, []).append(i)


def stitch(p0: np.ndarray, p1: np.ndarray, decimals: int, factor: float) -> np.ndarray:
    """Component of each segment: ends within a share of the median length, or on one grid point, belong together."""
    n, size = len(p0), np.linalg.norm(p1 - p0, axis=1)
    real = size[~np.all(np.isclose(p0, p1), axis=1)]
    radius = max(1e-6, float(np.median(real)) * factor) if len(real) else 1e-3
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(a: int, b: int) -> None:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)

    ends = np.stack([p0, p1], axis=1).reshape(-1, 3)
    for i, j in _near_pairs(ends, radius):
        union(i // 2, j // 2)
    first: dict[tuple, int] = {}
    for i, k in enumerate(map(tuple, np.round(ends, decimals).tolist())):
        union(first.setdefault(k, i // 2), i // 2)
    roots = np.array([find(i) for i in range(n)])
    return np.unique(roots, return_inverse=True)[1]


def walk(p0: np.ndarray, p1: np.ndarray, decimals: int) -> tuple[np.ndarray | None, bool]:
    """Points along a component from its first open end, else its first point; each step goes to the first neighbour not yet met."""
    a, b = (list(map(tuple, np.round(p, decimals).tolist())) for p in (p0, p1))
    beside: dict[tuple, list[tuple]] = {}
    for p, q in zip(a, b, strict=True):
        beside.setdefault(p, []).append(q)
        beside.setdefault(q, []).append(p)
    open_ends = [p for p, near in beside.items() if len(near) == 1]
    at = open_ends[0] if open_ends else a[0]
    path = {at: None}
    while (step := next((q for q in beside[at] if q not in path), None)) is not None:
        path[at := step] = None
    return (np.array(list(path)), not open_ends) if len(path) > 1 else (None, False)


def best_normal(points: np.ndarray) -> np.ndarray:
    if len(points) < 3:
        return np.zeros(3)
    c = points - points.mean(axis=0)
    return np.linalg.eigh(c.T @ c)[1][:, 0]


def area_vector(points: np.ndarray) -> np.ndarray:
    """Half the sum of cross products of neighbours round a loop."""
    p = points[:-1] if len(points) > 2 and np.allclose(points[0], points[-1]) else points
    return np.cross(p, np.roll(p, -1, axis=0)).sum(axis=0) / 2 if len(p) >= 3 else np.zeros(3)


def oriented(points: np.ndarray, hint: np.ndarray, closed: bool) -> np.ndarray:
    """The curve, reversed if its area (closed) or its run from end to end (open) points against the hint."""
    if not np.all(np.isfinite(hint)) or np.linalg.norm(hint) < 1e-9 or len(points) < 2:
        return points
    way = area_vector(points) if closed else points[-1] - points[0]
    if np.linalg.norm(way) < 1e-9:
        way = best_normal(points)
    return points[::-1] if np.linalg.norm(way) >= 1e-9 and way @ hint < 0 else points


def _components(pdf: pd.DataFrame, min_points: int, decimals: int, factor: float) -> pd.DataFrame:
    pdf = pdf.sort_values("fid", kind="stable")
    p0, p1 = (np.array([[p["x"], p["y"], p["z"]] for p in pdf[c]]) for c in ("p0", "p1"))
    label, hint, rows = stitch(p0, p1, decimals, factor), np.array(pdf["hint"].iloc[0]), []
    for k in range(label.max() + 1):
        points, closed = walk(p0[label == k], p1[label == k], decimals)
        if points is None or len(points) < min_points:
            continue
        if closed and not np.allclose(points[0], points[-1]):
            points = np.vstack([points, points[:1]])
        points = oriented(points, hint, closed)
        rows.append((pdf["mesh_id"].iloc[0], pdf["layer"].iloc[0], pdf["level"].iloc[0], k, closed, float(np.linalg.norm(np.diff(points, axis=0), axis=1).sum()), [dict(zip("xyz", map(float, p), strict=True)) for p in points]))
    return pd.DataFrame(rows, columns=["mesh_id", "layer", "level", "component_id", "is_closed", "curve_length", "points"])


def orientation_hints(mesh: Mesh, field: DataFrame) -> DataFrame:
    """``mesh_id, hint``: direction in which the field grows (least squares plane); Python sees ten sums a mesh.

    A field without slope takes the axis of most spread; NaN fields and tiny meshes as well, or (0, 0, 1).
    """
    v = mesh.vertices.join(field, ["mesh_id", "vid"]).withColumn("one", F.lit(1.0))
    names = ["x", "y", "z", "one"]
    sums = [F.sum(F.col(p) * F.col(q)).alias(f"s_{p}_{q}") for i, p in enumerate(names) for q in names[i:]] + [F.sum(F.col(p) * F.col("r")).alias(f"t_{p}") for p in names]
    rows = v.groupBy("mesh_id").agg(*sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                gram = np.array([[r[f"s_{p}_{q}"] if i <= j else r[f"s_{q}_{p}"] for j, q in enumerate(names)] for i, p in enumerate(names)])
                right, n, d = np.array([r[f"t_{p}"] for p in names]), gram[3, 3], np.zeros(3)
                if n >= 3 and np.all(np.isfinite(right)):
                    d = (np.linalg.pinv(gram) @ right)[:3]
                if n >= 3 and np.linalg.norm(d) < 1e-9:
                    mean = gram[:3, 3] / n
                    d = np.linalg.eigh(gram[:3, :3] / n - np.outer(mean, mean))[1][:, 2]
                if np.linalg.norm(d) < 1e-9:
                    d = np.array([0.0, 0.0, 1.0])
                out.append((r["mesh_id"], list(map(float, d / np.linalg.norm(d)))))
            yield pd.DataFrame(out, columns=["mesh_id", "hint"])

    return rows.mapInPandas(solve, "mesh_id int, hint array<double>")


def components(segs: DataFrame, hints: DataFrame, min_points: int = 3, decimals: int = 6, factor: float = 0.1) -> DataFrame:
    """Ordered, oriented polylines of each mesh and level; ``component_id`` counts components before short ones are dropped."""
    rows = segs.select("mesh_id", "layer", "level", "fid", "p0", "p1").join(hints, "mesh_id")
    return rows.groupBy("mesh_id", "layer").applyInPandas(partial(_components, min_points=min_points, decimals=decimals, factor=factor), f"mesh_id int, layer int, level double, component_id int, is_closed boolean, curve_length double, points array<{POINT}>")


def polyline_length(points: str = "points") -> Column:
    """Length of an array of points, in SQL."""
    gap = lambda a, b: F.sqrt(sum((b[c] - a[c]) * (b[c] - a[c]) for c in "xyz"))
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.size(points)), gap)
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def resampled(points: np.ndarray, samples: int, periodic: bool) -> np.ndarray:
    """Evenly spaced points along the polyline, lightly smoothed; a periodic curve is closed by a chord and ends where it starts."""
    if len(points) < 2:
        return points
    ring = np.allclose(points[0], points[-1])
    if periodic and not ring:
        points = np.vstack([points, points[:1]])
    elif not periodic and ring:
        points = points[:-1]
    step = np.linalg.norm(np.diff(points, axis=0), axis=1)
    along = np.concatenate([[0.0], np.cumsum(step)])
    if along[-1] < 1e-12:
        return points[:-1] if periodic else points
    want = np.linspace(0.0, along[-1], max(samples, 2))
    k = np.searchsorted(along, want)
    before = np.maximum(k - 1, 0)
    k = np.minimum(k, len(points) - 1)
    share = np.where(step[np.minimum(before, len(step) - 1)] < 1e-12, 1.0, (want - along[before]) / np.maximum(step[np.minimum(before, len(step) - 1)], 1e-300))
    out = smoothed_curve(np.where((k == 0)[:, None], points[0], points[before] + share[:, None] * (points[k] - points[before])))
    if periodic and len(out):
        out = out[np.concatenate([[True], np.any(np.diff(out, axis=0), axis=1)])]
        out = np.vstack([out, out[:1]])
    return out


#: Least-squares quadratic over seven points, at the middle.
SMOOTH = np.array([-2, 3, 6, 7, 6, 3, -2]) / 21


def smoothed_curve(points: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Drops points that follow the one before within ``least``; seven or more are smoothed, mirrored at the ends."""
    if len(points) < 2:
        return points
    p = points[np.concatenate([[True], np.linalg.norm(np.diff(points, axis=0), axis=1) > least])]
    if len(p) < len(SMOOTH):
        return p
    wide = np.pad(p, ((3, 3), (0, 0)), mode="reflect")
    return np.stack([np.convolve(wide[:, c], SMOOTH, "valid") for c in range(3)], axis=1)


def nearest_tour(points: np.ndarray) -> np.ndarray:
    """Points in the order of a walk that starts at the least x and always goes to the nearest left."""
    left, at, out = list(range(len(points))), int(np.argmin(points[:, 0])) if len(points) else 0, []
    while left:
        left.remove(at)
        out.append(at)
        if left:
            at = left[int(np.argmin(np.linalg.norm(points[left] - points[at], axis=1)))]
    return points[out]


def slices(parts: DataFrame, samples: int = 1800, periodic: bool = True) -> DataFrame:
    """One row per mesh and level: the largest component as points and resampled curve, totals over all components, and the layer's number."""
    best = F.max_by("points", F.struct(F.size("points"), -F.col("component_id"))).alias("points")
    s = parts.groupBy("mesh_id", "layer", "level").agg(best, F.sum("curve_length").alias("total_length"), F.count("*").cast("int").alias("component_count"))

    def curve(batches):
        for pdf in batches:
            made = [resampled(np.array([[p["x"], p["y"], p["z"]] for p in pts]), samples, periodic) for pts in pdf["points"]]
            pdf["curve"] = [[dict(zip("xyz", map(float, p), strict=True)) for p in c] for c in made]
            yield pdf

    s = s.mapInPandas(curve, f"{s.schema.simpleString()[7:-1]}, curve array<{POINT}>")
    return s.withColumn("layer_number", F.row_number().over(Window.partitionBy("mesh_id").orderBy("level", "layer")) - 1)


def collection_length(segs: DataFrame) -> DataFrame:
    """``mesh_id, n_levels, total_length`` over all segments of each mesh."""
    return segs.groupBy("mesh_id").agg(F.countDistinct("layer").alias("n_levels"), F.sum("len").alias("total_length"))


def summary(slices_: DataFrame) -> DataFrame:
    """Slices, those with several components, the most components (1 at least) and the levels where they split."""
    many = F.col("component_count") > 1
    return slices_.groupBy("mesh_id").agg(F.count("*").alias("total_slices"), F.sum(many.cast("int")).cast("long").alias("bifurcation_slices"), F.greatest(F.max("component_count"), F.lit(1)).alias("max_components"), F.array_sort(F.collect_list(F.when(many, F.col("level")))).alias("bifurcation_levels"))
