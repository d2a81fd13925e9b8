"""Nearest sites of points by grids of growing cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.session import discard, written

#: Sites of a cell of the finest grid, on average over a surface.
EACH = 4
AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def _cell(at: list[Column], size: Column) -> list[Column]:
    return [F.floor((p - F.col(f"lo_{c}")) / size).cast("long") for p, c in zip(at, "xyz", strict=True)]


def nearest(points: DataFrame, sites: DataFrame, key: list[str], digits: int | None = None) -> DataFrame:
    """``mesh_id, key, site, d2``: for points ``mesh_id, key, px, py, pz`` the nearest of the mesh's sites ``mesh_id, site, x, y, z`` and its squared distance; ties go to the least site.

    Distances are compared rounded to ``digits`` if given. Points look into the 27 cells around them (around
    their nearest place in the sites' box, if they lie outside); whoever finds a site nearer than anything
    beyond those cells can be is done, the others go on with cells twice as wide. So work
    is in proportion to points, but for those far from all sites. Sites at one place count once, by the least.
    Points of meshes without sites have no row; points with NaN coordinates are judged in the last round.
    """
    sites = written(sites.groupBy("mesh_id", "x", "y", "z").agg(F.min("site").alias("site")), "sites")
    box = sites.groupBy("mesh_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n_sites"))
    extent = F.greatest(*(F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"))
    box = box.withColumn("size", F.when(extent > 0, extent / F.greatest(F.sqrt(F.col("n_sites") / EACH), F.lit(1.0))).otherwise(1.0)).withColumn("rounds", F.greatest(F.ceil(F.log2(extent / F.col("size"))), F.lit(0)))
    box = written(box, "boxes")
    rounds = box.agg(F.max("rounds")).first()[0]
    place = [F.least(F.greatest(F.col(f"p{c}"), F.col(f"lo_{c}")), F.col(f"hi_{c}")) for c in "xyz"]
    out2 = sum((F.col(f"p{c}") - q) * (F.col(f"p{c}") - q) for c, q in zip("xyz", place, strict=True))
    left = written(points.join(box.drop("n_sites", "rounds"), "mesh_id").select("mesh_id", *key, "px", "py", "pz", "size", *(f"lo_{c}" for c in "xyz"), *(q.alias(f"q{c}") for c, q in zip("xyz", place, strict=True)), out2.alias("out2")), "points")
    last, found = int(rounds or 0) + 1, []
    d2 = sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz")
    for k in range(last + 1):
        size = F.col("size") * 2.0**k
        there = sites.join(box.select("mesh_id", "size", *(f"lo_{c}" for c in "xyz")), "mesh_id")
        there = there.select("mesh_id", "site", "x", "y", "z", *(q.alias(f"c{c}") for c, q in zip("xyz", _cell([F.col(c) for c in "xyz"], size), strict=True)))
        own = _cell([F.col(f"q{c}") for c in "xyz"], size)
        steps = F.array(*(F.struct(*(F.lit(s).cast("long").alias(c) for s, c in zip(step, "xyz", strict=True))) for step in AROUND))
        probes = left.select("mesh_id", *key, "px", "py", "pz", (size * size + F.col("out2")).alias("sure"), *(q.alias(f"o{c}") for c, q in zip("xyz", own, strict=True)), F.explode(steps).alias("s"))
        probes = probes.select("mesh_id", *key, "px", "py", "pz", "sure", *((F.col(f"o{c}") + F.col(f"s.{c}")).alias(f"c{c}") for c in "xyz"))
        near = probes.join(there, ["mesh_id", "cx", "cy", "cz"]).groupBy("mesh_id", *key).agg(F.min(F.struct((F.round(d2, digits) if digits is not None else d2).alias("near"), "site", d2.alias("d2"))).alias("b"), F.first("sure").alias("sure"))
        done = F.lit(True) if k == last else F.col("b.d2") * (1 + 1e-9) + 1e-8 < F.col("sure")
        found.append(written(near.where(done).select("mesh_id", *key, F.col("b.site").alias("site"), F.col("b.d2").alias("d2")), "near"))
        if k == last:
            break
        rest = written(left.join(found[-1].select("mesh_id", *key), ["mesh_id", *key], "left_anti"), "points")
        discard(left)
        left = rest
        if left.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
