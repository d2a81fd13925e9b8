"""Shortest paths along mesh edges."""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from talweg.functions.session import discard, written
from talweg.operators.nearest import nearest

#: Vertices of a part and sources that share a task, at most: they bound what a task's heaps hold.
PART, EACH = 65_536, 64
#: Depth to which places halve; vertices that agree so far are dealt by hash.
DEPTH = 20


class Graph:
    """Adjacency of one mesh, or a part of it, as flat arrays."""

    def __init__(self, arcs: pd.DataFrame, n: int) -> None:
        order = np.argsort(arcs["u"].to_numpy(), kind="stable")
        u = arcs["u"].to_numpy()[order]
        self.n = n
        self.start = np.searchsorted(u, np.arange(n + 1)).tolist()
        self.to = arcs["v"].to_numpy()[order].tolist()
        self.weight = arcs["weight"].to_numpy()[order].tolist()

    def distances(self, seeds: list[int], cutoff: float = np.inf, at: list[float] | None = None) -> np.ndarray:
        """Least distance of every vertex to a seed (which starts ``at`` 0 or more), infinite beyond ``cutoff`` or out of reach."""
        d = [np.inf] * self.n
        for s, far in zip(seeds, at or [0.0] * len(seeds), strict=True):
            d[s] = min(d[s], far)
        heap = [(d[s], s) for s in set(seeds)]
        heapq.heapify(heap)
        while heap:
            far, u = heapq.heappop(heap)
            if far > d[u]:
                continue
            for k in range(self.start[u], self.start[u + 1]):
                new, v = far + self.weight[k], self.to[k]
                if new < d[v] and new <= cutoff:
                    d[v] = new
                    heapq.heappush(heap, (new, v))
        return np.array(d)


def mesh_arcs(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """Arcs with the number ``n`` of the mesh's vertices; a mesh without arcs keeps one row of u = -1."""
    n = vertices.groupBy("mesh_id").agg((F.max("vid") + 1).alias("n"))
    return n.join(arcs, "mesh_id", "left").select("mesh_id", F.coalesce("u", F.lit(-1)).alias("u"), F.coalesce("v", F.lit(-1)).alias("v"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "n")


def parts(vertices: DataFrame, most: int = PART) -> tuple[DataFrame, bool]:
    """``mesh_id, vid, part``: cells of an octree over each mesh, split until each holds ``most`` vertices at most; and whether any was split.

    Vertices at one place are dealt by a hash of their id; a missing coordinate counts as the least.
    """
    if vertices.groupBy("mesh_id").count().where(F.col("count") > most).isEmpty():
        return vertices.select("mesh_id", "vid", F.lit("").alias("part")), False
    side = F.greatest(*(F.max(c) - F.min(c) for c in "xyz"), F.lit(1e-300))
    box = vertices.groupBy("mesh_id").agg(side.alias("side"), *(F.min(c).alias(f"low_{c}") for c in "xyz"))
    place = (F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / F.col("side") * 2**DEPTH), F.lit(2**DEPTH - 1)).cast("long") for c in "xyz")
    now = vertices.join(box, "mesh_id").select("mesh_id", "vid", *(F.coalesce(k, F.lit(0)).alias(f"k{c}") for k, c in zip(place, "xyz", strict=True)), F.lit("").alias("part"))
    depth, last = 0, None
    while True:
        over = now.groupBy("mesh_id", "part").count().where(F.col("count") > most).select("mesh_id", "part", F.lit(True).alias("over"))
        if over.isEmpty():
            return now.select("mesh_id", "vid", "part"), True
        if depth < DEPTH:
            child = sum((F.shiftright(f"k{c}", DEPTH - 1 - depth).bitwiseAND(1) * w for c, w in zip("xyz", (4, 2, 1), strict=True)), F.lit(0))
        else:
            child = F.pmod(F.xxhash64("vid", F.lit(depth)), F.lit(8))
        deeper = F.when(F.col("over"), F.concat("part", child.cast("string"))).otherwise(F.col("part"))
        new = written(now.join(over, ["mesh_id", "part"], "left").select("mesh_id", "vid", "kx", "ky", "kz", deeper.alias("part")), "parts")
        if last is not None:
            discard(last)
        now, last, depth = new, new, depth + 1


def group_graph(rows: pd.DataFrame, entries: pd.DataFrame) -> tuple[np.ndarray, Graph]:
    """Ids of one group's vertices, in order, and its graph over their places; rows of v = -1 are vertices, the others arcs."""
    arcs = rows.loc[rows["v"] >= 0]
    ids = np.unique(np.concatenate([rows["u"].to_numpy(), arcs["v"].to_numpy(), entries.loc[entries["vid"] >= 0, "vid"].to_numpy()]))
    local = pd.DataFrame({"u": np.searchsorted(ids, arcs["u"]), "v": np.searchsorted(ids, arcs["v"]), "weight": arcs["weight"].to_numpy()})
    return ids, Graph(local, len(ids))


def _heaps(rows: pd.DataFrame, entries: pd.DataFrame, cutoff: float) -> pd.DataFrame:
    """Distances of the group's vertices (rows of v = -1) from each source, which comes in at ``entries``."""
    out = [pd.DataFrame({"mesh_id": [], "bunch": [], "source": [], "vid": [], "d": []})]
    asked = np.unique(rows.loc[rows["v"] < 0, "u"].to_numpy())
    if len(asked) and len(entries):
        ids, g = group_graph(rows, entries)
        for s, e in entries.groupby("source"):
            e = e.loc[e["vid"] >= 0]
            d = g.distances(np.searchsorted(ids, e["vid"]).tolist(), cutoff, e["d"].tolist())
            out.append(pd.DataFrame({"mesh_id": entries["mesh_id"].iloc[0], "bunch": entries["bunch"].iloc[0], "source": s, "vid": asked, "d": d[np.searchsorted(ids, asked)]}))
    return pd.concat(out[1:] or out)


HEAPS = "mesh_id int, bunch int, source long, vid int, d double"
GROUP = ["mesh_id", "part", "bunch"]


def heaps(rows: DataFrame, entries: DataFrame, cutoff: float) -> DataFrame:
    """``_heaps`` of each group of mesh, part and bunch of sources."""
    return by_group(rows, entries).applyInPandas(partial(_heaps, cutoff=cutoff), HEAPS)


def by_group(rows: DataFrame, entries: DataFrame) -> PandasCogroupedOps:
    """Both tables grouped together, under columns of their own."""
    r, e = (df.select(*(F.col(c).alias(c) for c in df.columns)).groupBy(*GROUP) for df in (rows, entries))
    return r.cogroup(e)


def points_of(home: DataFrame) -> DataFrame:
    """Vertices of parts as rows of v = -1."""
    return home.select("mesh_id", "part", F.col("vid").alias("u"), F.lit(-1).alias("v"), F.lit(0.0).alias("weight"))


def routes(vertices: DataFrame, arcs: DataFrame, seeds: DataFrame, cutoff: float = float("inf"), most: int = PART, each: int = EACH) -> tuple[DataFrame, DataFrame]:
    """All that a last pass part by part needs: rows ``mesh_id, part, bunch, u, v, weight`` and entries ``mesh_id, part, bunch, source, vid, d``.

    A mesh is cut into parts of at most ``most`` vertices. In each round the parts at which a source has come
    nearer run their heaps from all entries so far, and hand the distances of vertices with arcs to other parts
    over these. That ends when nothing comes nearer: after as many rounds as the shortest paths cross parts, however many
    edges they have, and without any for meshes of one part. Seeds are written once, and only such border vertices are written between rounds. Sources go in
    bunches of ``each``. A part that a source doesn't enter has one entry of it with vid -1.
    """
    home, split = parts(vertices, most)
    number = F.dense_rank().over(Window.partitionBy("mesh_id").orderBy("source"))
    start = written(seeds.select("mesh_id", "source", "vid").distinct().withColumn("bunch", F.floor((number - 1) / each).cast("int")), "seeds")
    bunches = start.select("mesh_id", "bunch").distinct()
    if not split:
        rows = points_of(home).unionByName(arcs.select("mesh_id", F.lit("").alias("part"), "u", "v", "weight")).join(bunches, "mesh_id")
        return rows, start.select("mesh_id", F.lit("").alias("part"), "bunch", "source", "vid", F.lit(0.0).alias("d"))
    home = written(home, "home")
    ends = (home.select("mesh_id", F.col("vid").alias(c), F.col("part").alias(p)) for c, p in (("u", "part"), ("v", "to_part")))
    arcs = arcs.select("mesh_id", "u", "v", "weight").join(next(ends), ["mesh_id", "u"]).join(next(ends), ["mesh_id", "v"])
    arcs = written(arcs, "arcs")
    inner = arcs.where("part = to_part").select("mesh_id", "part", "u", "v", "weight")
    cross = arcs.where("part <> to_part")
    borders = cross.select("mesh_id", "part", "u").distinct().select("mesh_id", "part", "u", F.lit(-1).alias("v"), F.lit(0.0).alias("weight"))
    border_rows = written(inner.unionByName(borders), "borders")
    place = [*GROUP, "source", "vid"]
    entries = written(start.join(home, ["mesh_id", "vid"]).select(*place, F.lit(0.0).alias("d"), F.lit(True).alias("nearer")), "entries")
    while not entries.where("nearer").isEmpty():
        awake = entries.where("nearer").select(*GROUP).distinct()
        found = heaps(border_rows.join(awake, ["mesh_id", "part"]), entries.join(awake, GROUP).drop("nearer"), cutoff).withColumnRenamed("vid", "u").where(F.col("d") < float("inf"))
        sent = found.join(cross, ["mesh_id", "u"]).groupBy("mesh_id", F.col("to_part").alias("part"), "bunch", "source", F.col("v").alias("vid")).agg(F.min(F.col("d") + F.col("weight")).alias("via"))
        both = entries.drop("nearer").join(sent.where(F.col("via") <= cutoff), place, "full")
        new = written(both.select(*place, F.least("d", "via").alias("d"), F.coalesce(F.col("via") < F.col("d"), F.col("d").isNull()).alias("nearer")), "entries")
        discard(entries)
        entries = new
    discard(border_rows)
    everywhere = start.select("mesh_id", "source", "bunch").distinct().join(home.select("mesh_id", "part").distinct(), "mesh_id").select(*GROUP, "source", F.lit(-1).alias("vid"), F.lit(float("inf")).alias("d"))
    return inner.unionByName(points_of(home)).join(bunches, "mesh_id"), entries.drop("nearer").unionByName(everywhere)


def distances(vertices: DataFrame, arcs: DataFrame, seeds: DataFrame, cutoff: float = float("inf"), most: int = PART) -> DataFrame:
    """``mesh_id, source, vid, d`` for seeds ``mesh_id, source, vid``: seeds of one source start together.

    Every vertex of a mesh with seeds has a row for each of its sources, infinite beyond ``cutoff`` or out of
    reach; seeds that are no vertices reach nothing. Repeated seeds count once. See ``routes`` for meshes of more than ``most`` vertices.
    """
    s = seeds.select(F.col("mesh_id").alias("mesh_id"), F.col("source").cast("long").alias("source"), F.col("vid").alias("vid"))
    rows, entries = routes(vertices, arcs, s, cutoff, most)
    return heaps(rows, entries, cutoff).select("mesh_id", F.col("source").cast("int").alias("source"), "vid", "d")


def to_side(vertices: DataFrame, arcs: DataFrame, side: DataFrame) -> DataFrame:
    """``mesh_id, vid, value``: distance to the nearest of the side's vertices (``mesh_id, vid``)."""
    return distances(vertices, arcs, side.select("mesh_id", F.lit(0).alias("source"), "vid")).select("mesh_id", "vid", F.col("d").alias("value"))


def nearest_loop(vertices: DataFrame, arcs: DataFrame, sided: DataFrame) -> DataFrame:
    """Nearest lower and upper loop of each vertex and their distances; none: null and infinity; ties by number."""
    d = distances(vertices, arcs, sided.select("mesh_id", F.col("boundary_number").alias("source"), "vid"))
    side = sided.select("mesh_id", F.col("boundary_number").alias("source"), "boundary_side").distinct()
    best = d.join(side, ["mesh_id", "source"]).groupBy("mesh_id", "vid").agg(*(F.min(F.when((F.col("boundary_side") == s) & (F.col("d") < float("inf")), F.struct("d", "source"))).alias(s) for s in ("lower", "upper")))
    out = vertices.select("mesh_id", "vid").join(best, ["mesh_id", "vid"], "left")
    return out.select("mesh_id", "vid", *(c for s in ("lower", "upper") for c in (F.col(f"{s}.source").alias(f"closest_{s}_boundary"), F.coalesce(f"{s}.d", F.lit(float("inf"))).alias(f"dist_to_{s}"))))


def nearest_nodes(vertices: DataFrame, points: DataFrame) -> DataFrame:
    """``mesh_id, pid, vid, distance``: nearest vertex of each point (``mesh_id, pid, x, y, z``); squared distances equal in nine digits tie, by id."""
    asked = points.select("mesh_id", "pid", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    best = nearest(asked, vertices.select("mesh_id", F.col("vid").alias("site"), "x", "y", "z"), ["pid"], 9)
    return best.select("mesh_id", "pid", F.col("site").alias("vid"), F.sqrt("d2").alias("distance"))


def between(to_lower: DataFrame, to_upper: DataFrame) -> DataFrame:
    """Share of the way from the lower side (0) to the upper (1).

    Infinite distances count as ten times the largest among vertices that reach a side; if one of
    those is infinite itself, or none is above 0, as 10. A mesh where no vertex reaches a side is 0.
    """
    j = to_lower.withColumnRenamed("value", "lo").join(to_upper.withColumnRenamed("value", "up"), ["mesh_id", "vid"])
    inf = F.lit(float("inf"))
    top = j.where((F.col("lo") < inf) | (F.col("up") < inf)).groupBy("mesh_id").agg(F.max(F.greatest("lo", "up")).alias("top"))
    big = F.when((F.col("top") < inf) & (F.col("top") > 0), F.col("top") * 10).otherwise(10.0)
    lo, up = (F.when(F.col(c) == inf, big).otherwise(F.col(c)) for c in ("lo", "up"))
    return j.join(top, "mesh_id", "left").select("mesh_id", "vid", F.when(F.col("top").isNull(), 0.0).otherwise(lo / (lo + up + F.lit(2.0**-52))).alias("value"))
