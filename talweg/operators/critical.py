"""One-rings, critical points, confidence, clustering of saddles and value gaps."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.session import written
from talweg.operators.fields import normalized, smoothed
from talweg.operators.geodesic import PART, Graph, by_group, distances, group_graph, mesh_arcs, routes, to_side
from talweg.operators.topology import boundary_vertices, both_ways, weighted_edges
from talweg.sources.tubes import Mesh

KINDS = ("minimum", "saddle", "maximum", "regular")


def links(faces: DataFrame) -> DataFrame:
    """``mesh_id, fid, v, u, w``: each face seen from each corner."""
    turns = F.array(*(F.struct(F.col(p).alias("v"), F.col(q).alias("u"), F.col(r).alias("w")) for p, q, r in ("abc", "bca", "cab")))
    return faces.select("mesh_id", "fid", F.explode(turns).alias("t")).select("mesh_id", "fid", "t.*")


def one_rings(faces: DataFrame) -> DataFrame:
    """Neighbours of each vertex in order of id."""
    return links(faces).select("mesh_id", F.col("v").alias("vid"), F.explode(F.array("u", "w")).alias("n")).groupBy("mesh_id", "vid").agg(F.array_sort(F.collect_set("n")).alias("ring"))


def ring_values(faces: DataFrame, field: DataFrame) -> DataFrame:
    """``mesh_id, vid, r, ring``: each vertex's value and its neighbours' values (columns of ``field``: r)."""
    near = links(faces).select("mesh_id", F.col("v").alias("vid"), F.explode(F.array("u", "w")).alias("n")).distinct()
    got = near.join(field.select("mesh_id", F.col("vid").alias("n"), F.col("r").alias("rn")), ["mesh_id", "n"]).groupBy("mesh_id", "vid").agg(F.collect_list("rn").alias("ring"))
    return field.join(got, ["mesh_id", "vid"])


def pair_gaps(ring: Column) -> Column:
    """Sorted absolute differences of all pairs of an array."""
    at = F.transform(ring, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.array_sort(F.flatten(F.transform(at, lambda p: F.transform(F.filter(at, lambda q: q["i"] > p["i"]), lambda q: F.abs(p["x"] - q["x"])))))


def adaptive_eps(faces: DataFrame, field: DataFrame, least: float = 1e-12) -> DataFrame:
    """Tolerance of each vertex: a tenth of a low pair gap of its ring or a hundredth of the ring's range, the smaller, but ``least`` at least."""
    return ring_values(faces, field).select("mesh_id", "vid", ring_tolerance(F.col("ring"), least).alias("eps"))


def saliency(faces: DataFrame, field: DataFrame) -> DataFrame:
    """Median absolute difference of each vertex to its ring."""
    v = ring_values(faces, field).select("mesh_id", "vid", F.array_sort(F.transform("ring", lambda x: F.abs(x - F.col("r")))).alias("d"), F.size("ring").alias("n"))
    mid = (F.get("d", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("d", F.floor(F.col("n") / 2).cast("int"))) / 2
    return v.select("mesh_id", "vid", mid.alias("saliency"))


def ring_order(pairs: list[tuple[int, int]]) -> list[int] | None:
    """Neighbours along the link, from its smallest end (or smallest of a cycle); None if the link isn't one path or cycle."""
    beside: dict[int, set[int]] = {}
    for u, w in pairs:
        beside.setdefault(u, set()).add(w)
        beside.setdefault(w, set()).add(u)
    ends = [u for u in beside if len(beside[u]) == 1]
    at = min(ends or beside)
    order, left = [at], set(beside) - {at}
    while left:
        step = [w for w in beside[at] if w in left]
        if not step:
            return None
        at = min(step)
        left.discard(at)
        order.append(at)
    return order


def vertex_normal(center: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the face normals round a vertex; without one, the axis of least spread of its ring."""
    if not pairs:
        return np.array([0.0, 0.0, 1.0])
    n = sum(np.cross(p - center, q - center) for p, q in pairs)
    if np.linalg.norm(n) >= 1e-14:
        return n / np.linalg.norm(n)
    around = np.array([x - center for pair in pairs for x in pair])
    return np.linalg.eigh(around.T @ around)[1][:, 0]


def tangents(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit directions across a normal."""
    help_ = np.array([0.0, 1.0, 0.0]) if abs(n[0]) > 0.9 else np.array([1.0, 0.0, 0.0])
    t = np.cross(n, help_)
    t = t / (np.linalg.norm(t) + 1e-15)
    b = np.cross(n, t)
    return t, b / (np.linalg.norm(b) + 1e-15)


def angle_order(center: np.ndarray, places: dict[int, np.ndarray], pairs: list[tuple[int, int]]) -> list[int]:
    """Neighbours by angle in the tangent plane, ties by id."""
    ids = sorted(places)
    if len(ids) <= 2:
        return ids
    t, b = tangents(vertex_normal(center, [(places[u], places[w]) for u, w in pairs]))
    return sorted(ids, key=lambda u: (math.atan2((places[u] - center) @ b, (places[u] - center) @ t), u))


#: Fixed values of the confidence: 1e-10 beside a mean, 0.5 for one-sided rings, 0.1 a change off four, 0.7 for rings in parts.
def confidence_of(d: np.ndarray, changes: int, eps: float, whole: bool) -> float:
    """Strength of the differences times how well they fit the kind, scaled into [0, 1]."""
    size = np.abs(d)
    strong = size[size > eps]
    if not len(strong) or np.median(strong) <= 0:
        return 0.0
    signal = float(np.median(strong))
    if changes == 0:
        fit = max(0.0, 1 - float(np.std(d)) / (float(size.mean()) + 1e-10))
    elif changes == 2:
        up, down = int((d > eps).sum()), int((d < -eps).sum())
        fit = min(up, down) / max(up, down) if up and down else 0.5
    elif changes % 2 == 0:
        fit = 1 / (1 + abs(changes - 4) * 0.1)
    else:
        fit = 0.0
    return min(max(signal * fit * (1.0 if whole else 0.7) / (signal + 1), 0.0), 1.0)


def classify_ring(d: np.ndarray, eps: float, odd_saddles: bool = False) -> tuple[str, int]:
    """Kind and number of sign changes of the differences value - neighbour round a ring; near-zero ones are passed over."""
    sign = np.sign(d[np.abs(d) > eps])
    changes = int((sign != np.roll(sign, 1)).sum()) if len(sign) else 0
    if changes == 0 and len(sign):
        return ("maximum" if sign[0] > 0 else "minimum"), 0
    if (changes >= 4 and changes % 2 == 0) or (odd_saddles and changes > 2):
        return "saddle", changes
    return "regular", changes


def _classify(batches, eps: float, adaptive: bool, odd_saddles: bool):
    for pdf in batches:
        kinds, scores, counts = [], [], []
        for at, border, around in zip(pdf["at"], pdf["border"], pdf["around"], strict=True):
            pairs = [(x["u"], x["w"]) for x in around]
            value = {x[k]: x[f"p{k}"] for x in around for k in "uw"}
            if border or len(value) < 3:
                kinds.append("regular")
                scores.append(0.0)
                counts.append(0)
                continue
            order = ring_order(pairs)
            if order is None:
                place = {u: np.array([p["x"], p["y"], p["z"]]) for u, p in value.items()}
                order = angle_order(np.array([at["x"], at["y"], at["z"]]), place, pairs)
            ring = np.array([value[u]["r"] for u in order])
            tol = eps
            if adaptive:
                gaps = np.sort(np.abs(ring[:, None] - ring[None])[np.triu_indices(len(ring), 1)])
                tol = max(eps, min(0.1 * gaps[int(0.1 * (len(gaps) - 1))], 0.01 * (ring.max() - ring.min())))
            d = at["r"] - ring
            kind, changes = classify_ring(d, tol, odd_saddles)
            kinds.append(kind)
            counts.append(changes)
            scores.append(confidence_of(d, changes, tol, len(order) == len(value)))
        yield pd.DataFrame({"mesh_id": pdf["mesh_id"], "vid": pdf["vid"], "critical_type": kinds, "changes": counts, "confidence": scores})


def settled(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that are computed once: filters on them are not pushed below, where they'd repeat their expressions."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def ring_tolerance(ring: Column, least: float) -> Column:
    """A tenth of a low pair gap of the ring's values or a hundredth of their range, the smaller, but ``least`` at least."""
    gaps = pair_gaps(ring)
    low = F.get(gaps, F.floor(0.1 * (F.size(gaps) - 1)).cast("int"))
    return F.when(F.size(ring) < 2, least).otherwise(F.greatest(F.lit(least), F.least(0.1 * low, 0.01 * (F.array_max(ring) - F.array_min(ring)))))


def link_order(around: str, ring: str) -> Column:
    """Neighbours along the link of ``around`` (structs with ``u, w``), from its smallest end, or smallest of a cycle; shorter than ``ring`` (all of them) if the link isn't one path or cycle.

    A fold over the array of pairs: from where it stands, it steps to the least neighbour not yet met.
    """
    pairs = F.col(around)
    beside = lambda at: F.array_union(F.transform(F.filter(pairs, lambda x: x["u"] == at), lambda x: x["w"]), F.transform(F.filter(pairs, lambda x: x["w"] == at), lambda x: x["u"]))
    ends = F.filter(ring, lambda n: F.size(beside(n)) == 1)
    first = F.coalesce(F.array_min(ends), F.array_min(ring))

    def step(path: Column, _: Column) -> Column:
        to = F.array_min(F.array_except(beside(F.element_at(path, -1)), path))
        return F.when(to.isNull(), path).otherwise(F.array_append(path, to))

    return F.aggregate(F.slice(ring, 2, F.size(ring)), F.array(first), step)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def median_of(values: Column) -> Column:
    sorted_, n = F.array_sort(values), F.size(values)
    return (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2


def ring_confidence(d: str, changes: str, eps: str) -> Column:
    """As ``confidence_of``, for a whole ring's differences."""
    size = F.transform(d, lambda x: F.abs(x))
    strong = F.filter(size, lambda x: x > F.col(eps))
    signal, mean = median_of(strong), mean_of(F.col(d))
    spread = F.sqrt(mean_of(F.transform(d, lambda x: (x - mean) * (x - mean))))
    up, down = F.size(F.filter(d, lambda x: x > F.col(eps))), F.size(F.filter(d, lambda x: x < -F.col(eps)))
    c = F.col(changes)
    fit = (
        F.when(c == 0, F.greatest(F.lit(0.0), 1 - spread / (mean_of(size) + 1e-10)))
        .when(c == 2, F.when((up > 0) & (down > 0), F.least(up, down) / F.greatest(up, down)).otherwise(0.5))
        .when(c % 2 == 0, 1 / (1 + F.abs(c - 4) * 0.1)).otherwise(0.0)
    )
    return F.when(F.coalesce(signal, F.lit(0.0)) <= 0, 0.0).otherwise(F.least(F.greatest(signal * fit / (signal + 1), F.lit(0.0)), F.lit(1.0)))


def critical_points(mesh: Mesh, field: DataFrame, eps: float = 1e-12, adaptive: bool = True, odd_saddles: bool = False) -> DataFrame:
    """``mesh_id, vid, critical_type, changes, confidence`` of every vertex (columns of ``field``: r).

    Vertices are judged one by one from their own ring, so a mesh of any size is spread over tasks.
    Boundary vertices, rings under three and vertices without faces are regular. Differences to neighbours within the
    tolerance are passed over and changes of sign counted round the ring. All of it is array
    functions, but for rings whose link isn't one path or cycle: these are taken by angle, in Python.
    """
    v = mesh.vertices.join(field, ["mesh_id", "vid"]).select("mesh_id", "vid", F.struct("x", "y", "z", "r").alias("p"))
    j = links(mesh.faces)
    for k in "uw":
        j = j.join(v.select("mesh_id", F.col("vid").alias(k), F.col("p").alias(f"p{k}")), ["mesh_id", k])
    around = j.groupBy("mesh_id", F.col("v").alias("vid")).agg(F.collect_list(F.struct("u", "w", "pu", "pw")).alias("around"))
    border = boundary_vertices(mesh.faces).select("mesh_id", "vid", F.lit(True).alias("border"))
    rows = mesh.vertices.select("mesh_id", "vid").join(around, ["mesh_id", "vid"], "left").join(v, ["mesh_id", "vid"], "left").join(border, ["mesh_id", "vid"], "left")
    value = F.map_from_entries(F.array_distinct(F.flatten(F.transform("around", lambda x: F.array(F.struct(x["u"].alias("key"), x["pu"]["r"].alias("value")), F.struct(x["w"].alias("key"), x["pw"]["r"].alias("value")))))))
    rows = rows.withColumn("value", value).withColumn("ring", F.array_sort(F.map_keys("value")))
    rows = rows.withColumn("plain", F.coalesce("border", F.lit(False)) | F.col("ring").isNull() | (F.size("ring") < 3) | F.col("p").isNull())
    inner = settled(rows.where("not plain"), ["mesh_id", "vid", "p", "around", "value", "ring"], order=link_order("around", "ring"))
    by_angle = inner.where("size(order) < size(ring)").select("mesh_id", "vid", F.col("p").alias("at"), F.lit(False).alias("border"), "around")
    whole = settled(inner.where("size(order) = size(ring)"), ["mesh_id", "vid"], r=F.col("p.r"), ring=F.transform("order", lambda n: F.col("value")[n]))
    whole = settled(whole, ["mesh_id", "vid"], d=F.transform("ring", lambda x: F.col("r") - x), eps=ring_tolerance(F.col("ring"), eps) if adaptive else F.lit(eps))
    whole = settled(whole, ["mesh_id", "vid", "d", "eps"], signs=F.transform(F.filter("d", lambda x: F.abs(x) > F.col("eps")), lambda x: x > 0))
    changed = F.filter(F.transform("signs", lambda s, i: s != F.get("signs", F.when(i == 0, F.size("signs") - 1).otherwise(i - 1))), lambda c: c)
    whole = settled(whole, ["mesh_id", "vid", "d", "eps", "signs"], changes=F.size(changed))
    saddle = ((F.col("changes") >= 4) & (F.col("changes") % 2 == 0)) | (F.lit(odd_saddles) & (F.col("changes") > 2))
    kind = F.when((F.col("changes") == 0) & (F.size("signs") > 0), F.when(F.get("signs", F.lit(0)), "maximum").otherwise("minimum")).when(saddle, "saddle").otherwise("regular")
    judged = settled(whole, ["mesh_id", "vid", "changes", "d", "eps"], critical_type=kind).select("mesh_id", "vid", "critical_type", "changes", ring_confidence("d", "changes", "eps").alias("confidence"))
    angled = by_angle.mapInPandas(partial(_classify, eps=eps, adaptive=adaptive, odd_saddles=odd_saddles), "mesh_id int, vid int, critical_type string, changes int, confidence double")
    rest = rows.where("plain").select("mesh_id", "vid", F.lit("regular").alias("critical_type"), F.lit(0).alias("changes"), F.lit(0.0).alias("confidence"))
    return judged.unionByName(angled).unionByName(rest)


def morse_check(critical: DataFrame, chi: DataFrame) -> DataFrame:
    """Maxima - saddles + minima beside the Euler characteristic; valid within 2."""
    n = [F.sum((F.col("critical_type") == k).cast("int")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    j = critical.groupBy("mesh_id").agg(*n).join(chi.select("mesh_id", "chi"), "mesh_id")
    morse = F.col("n_maximum") - F.col("n_saddle") + F.col("n_minimum")
    return j.select("mesh_id", "n_minimum", "n_saddle", "n_maximum", "chi", morse.alias("morse"), (F.abs(morse - F.col("chi")) <= 2).alias("valid"))


def value_gaps(critical: DataFrame, field: DataFrame) -> DataFrame:
    """Least difference in value of each critical point to another one of its mesh; infinite for a lone one."""
    c = critical.where("critical_type <> 'regular'").join(field, ["mesh_id", "vid"])
    w = Window.partitionBy("mesh_id").orderBy("r", "vid")
    gap = F.least(F.coalesce(F.col("r") - F.lag("r").over(w), F.lit(float("inf"))), F.coalesce(F.lead("r").over(w) - F.col("r"), F.lit(float("inf"))))
    return c.select("mesh_id", "vid", "critical_type", gap.alias("value_gap"))


def persistent(critical: DataFrame, field: DataFrame, threshold: float) -> DataFrame:
    """Critical points whose value gap is under ``threshold`` become regular."""
    gap = value_gaps(critical, field).select("mesh_id", "vid", "value_gap")
    j = critical.join(gap, ["mesh_id", "vid"], "left")
    return j.select("mesh_id", "vid", F.when(F.col("value_gap") < threshold, "regular").otherwise(F.col("critical_type")).alias("critical_type"), "changes", "confidence")


def scored(mesh: Mesh, found: DataFrame, r: DataFrame, strategy: str = "confidence") -> DataFrame:
    """``mesh_id, vid, score`` of the saddles among critical points, by which the best of a cluster is chosen.

    ``confidence`` or ``conf``; ``saliency`` or ``contrast``; any other strategy scores all alike.
    """
    saddles = found.where("critical_type = 'saddle'")
    if strategy.lower() in ("saliency", "contrast"):
        return saddles.select("mesh_id", "vid").join(saliency(mesh.faces, r), ["mesh_id", "vid"]).withColumnRenamed("saliency", "score")
    score = F.col("confidence") if strategy.lower() in ("confidence", "conf") else F.lit(0.0)
    return saddles.select("mesh_id", "vid", score.alias("score"))


def detect(mesh: Mesh, value: DataFrame, eps: float = 1e-12, adaptive: bool = True, odd_saddles: bool = False, normalize: bool = True, smooth: int = 0, weight: float = 0.5, clip: float = 0.0, clip_by_edge: bool = False, strategy: str = "confidence", persistence: float = 0.0) -> DataFrame:
    """``mesh_id, vid, critical_type, changes, confidence`` of a field (columns of ``value``: value), step by step.

    The field is normalised and smoothed ``smooth`` times, vertices are judged, saddles within ``clip`` (a length, or
    median edges of their mesh) give way to the best of them by ``strategy``, and critical points
    whose value gap is under ``persistence`` go. What goes becomes regular.
    """
    r = normalized(value) if normalize else value.select("mesh_id", "vid", F.col("value").alias("r"))
    if smooth > 0:
        again = smoothed(r.withColumnRenamed("r", "value"), both_ways(weighted_edges(mesh)), boundary_vertices(mesh.faces), smooth, weight)
        r = written(again.withColumnRenamed("value", "r"), "smoothed")
    found = critical_points(mesh, r, eps, adaptive, odd_saddles)
    if clip > 0 or persistence > 0:
        found = written(found, "critical")  # read several times from here on
    if clip > 0:
        kept = saddle_clusters(mesh, scored(mesh, found, r, strategy), clip, clip_by_edge).select("mesh_id", F.col("kept").alias("vid")).distinct().withColumn("stays", F.lit(True))
        gone = (F.col("critical_type") == "saddle") & F.col("stays").isNull()
        found = found.join(kept, ["mesh_id", "vid"], "left").withColumn("critical_type", F.when(gone, "regular").otherwise(F.col("critical_type"))).drop("stays")
    return persistent(found, r, persistence) if persistence > 0 else found


def multi_scale_saddles(mesh: Mesh, value: DataFrame, levels: int = 3, share: float = 0.6, smooth: int = 2, persistence: float = 0.0, **options: object) -> DataFrame:
    """``mesh_id, vid, votes``: saddles that at least ``share`` of ``levels`` runs of ``detect`` find; run k smooths k + 1 times as much and asks for k hundredths more persistence."""
    value = written(value.select("mesh_id", "vid", "value"), "field")
    return consensus([detect(mesh, value, smooth=smooth * (k + 1), persistence=persistence + 0.01 * k, **options) for k in range(levels)], share)


def annotated(found: DataFrame) -> DataFrame:
    """``mesh_id, vid, morse_index, critical_type, critical_confidence``: attributes of a graph's nodes; regular vertices have index -1."""
    index = F.when(F.col("critical_type") == "minimum", 0).when(F.col("critical_type") == "saddle", 1).when(F.col("critical_type") == "maximum", 2).otherwise(-1)
    return found.select("mesh_id", "vid", index.alias("morse_index"), "critical_type", F.col("confidence").alias("critical_confidence"))


def saddle_radii(mesh: Mesh, sided: DataFrame, saddles: DataFrame, arcs: DataFrame | None = None) -> DataFrame:
    """``saddles`` with ``radius``: the way along edges (``arcs``, if they are there already) to the nearer of the sides' vertices (``sided``)."""
    way = to_side(mesh.vertices, both_ways(weighted_edges(mesh)) if arcs is None else arcs, sided.where("boundary_side in ('lower', 'upper')"))
    return saddles.join(way.withColumnRenamed("value", "radius"), ["mesh_id", "vid"])


def given_radii(saddles: DataFrame, radii: list[float]) -> DataFrame:
    """``saddles`` with ``radius``: the given ones in order of id; a mesh with another number of saddles is an error."""
    n = F.count("*").over(Window.partitionBy("mesh_id"))
    k = F.row_number().over(Window.partitionBy("mesh_id").orderBy("vid"))
    wrong = F.raise_error(F.lit(f"{len(radii)} radii are given, one for each saddle is needed")).cast("double")
    return saddles.withColumn("radius", F.when(n != len(radii), wrong).otherwise(F.get(F.array(*(F.lit(float(x)) for x in radii)), k - 1)))


def _cluster(arcs: pd.DataFrame, saddles: pd.DataFrame, threshold: float, by_edge: bool) -> pd.DataFrame:
    if not len(saddles):
        return pd.DataFrame({"mesh_id": [], "vid": [], "kept": []})
    if by_edge:
        threshold *= float(arcs.loc[arcs["u"] >= 0, "weight"].median())  # each edge is there twice, which leaves the median
    ids, score = saddles["vid"].tolist(), dict(zip(saddles["vid"], saddles["score"], strict=True))
    group = {s: s for s in ids}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    if len(ids) > 1 and 0 < threshold < np.inf:
        g = Graph(arcs.loc[arcs["u"] >= 0], int(arcs["n"].iloc[0]))
        for s in ids:
            d = g.distances([s], threshold)
            for t in ids:
                if d[t] <= threshold and (a := root(s)) != (b := root(t)):
                    group[max(a, b)] = min(a, b)
    best: dict[int, int] = {}
    for t in sorted(ids, key=lambda t: (-score[t], t)):
        best.setdefault(root(t), t)
    return pd.DataFrame({"mesh_id": saddles["mesh_id"].iloc[0], "vid": ids, "kept": [best[root(s)] for s in ids]})


def saddle_clusters(mesh: Mesh, saddles: DataFrame, threshold: float, by_edge: bool = False) -> DataFrame:
    """``mesh_id, vid, kept``: saddles (``mesh_id, vid, score``) joined within ``threshold`` along edges; the best score stays, ties by id.

    ``by_edge``: the threshold counts in median edges of the saddles' own mesh. Unless it is positive and finite, all saddles stay.
    """
    arcs = both_ways(weighted_edges(mesh))
    s = saddles.select(*(F.col(c).alias(c) for c in ("mesh_id", "vid", "score"))).groupBy("mesh_id")
    return mesh_arcs(mesh.vertices, arcs).groupBy("mesh_id").cogroup(s).applyInPandas(partial(_cluster, threshold=threshold, by_edge=by_edge), "mesh_id int, vid int, kept int")


def consensus(runs: list[DataFrame], share: float = 0.6) -> DataFrame:
    """Saddles that at least ``share`` of several runs find."""
    need = math.ceil(len(runs) * share)
    found = runs[0].where("critical_type = 'saddle'").select("mesh_id", "vid")
    for r in runs[1:]:
        found = found.unionByName(r.where("critical_type = 'saddle'").select("mesh_id", "vid"))
    return found.groupBy("mesh_id", "vid").agg(F.count("*").alias("votes")).where(F.col("votes") >= need)


def _bend(rows: pd.DataFrame, entries: pd.DataFrame, n: float) -> pd.DataFrame:
    """Least way of a part's vertices to a bunch of each side's vertices, bent by the ways to the saddles (``way``)."""
    out = []
    points = rows.loc[rows["v"] < 0].drop_duplicates("u").sort_values("u")
    if len(points) and len(entries):
        ids, g = group_graph(rows, entries)
        asked = np.searchsorted(ids, points["u"])
        reach = np.array(points["way"].tolist(), float).reshape(len(points), -1)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            if s := reach.shape[1]:
                radius = np.array(points["radius"].iloc[0], float)
                pull = 1 / np.sinh(np.maximum(np.sqrt(np.maximum(reach + radius**n - radius, 0)), 1e-12))
                pull = pull / (pull.sum(axis=1, keepdims=True) + 1e-12)
            for side, of_side in entries.groupby("side"):
                best = np.full(len(points), np.inf)
                for _, e in of_side.groupby("source"):
                    at = e.loc[e["vid"] >= 0]
                    d = g.distances(np.searchsorted(ids, at["vid"]).tolist(), at=at["d"].tolist())[asked]
                    best = np.fmin(best, d + pull @ np.array(e["from_source"].iloc[0], float) if s else d)
                out.append(pd.DataFrame({"mesh_id": entries["mesh_id"].iloc[0], "vid": points["u"].to_numpy(), "side": side, "best": best}))
    return pd.concat(out) if out else pd.DataFrame({"mesh_id": [], "vid": [], "side": [], "best": []})


def conforming_field(mesh: Mesh, sided: DataFrame, saddles: DataFrame, n: float = 2.0, eps: float = 1e-9, most: int = PART) -> DataFrame:
    """0 at the upper side, 1 at the lower, bent round the saddles (``mesh_id, vid`` and optionally ``radius``, else ``saddle_radii``).

    Each side's distance is the least, over its vertices, of the way there plus the saddles' weighted
    ways; unreachable vertices are NaN. A mesh that lacks a side is an error. A repeated saddle counts once, with its least radius.

    Ways to the saddles are an array on each vertex. Then each part of a mesh meets bunches of a side's vertices, and only
    the least way of a vertex to a bunch leaves the task: neither a mesh nor the ways from all of a side are ever in one place.
    Arcs, sides and saddles are written once, as each is read several times.
    """
    arcs, sided = written(both_ways(weighted_edges(mesh)), "arcs"), written(sided, "sided")
    if "radius" not in saddles.columns:
        saddles = saddle_radii(mesh, sided, written(saddles.select("mesh_id", "vid"), "saddles"), arcs)
    saddles = written(saddles.groupBy("mesh_id", F.col("vid").alias("source")).agg(F.min(F.col("radius").cast("double")).alias("radius")), "saddles")
    reach = distances(mesh.vertices, arcs, saddles.select("mesh_id", "source", F.col("source").alias("vid")), most=most).join(saddles, ["mesh_id", "source"])
    ordered = F.array_sort(F.collect_list(F.struct("source", "d", "radius")))
    ways = written(reach.groupBy("mesh_id", "vid").agg(ordered.alias("all")).select("mesh_id", "vid", F.col("all.d").alias("way"), F.col("all.radius").alias("radius")), "ways")
    none = F.array().cast("array<double>")
    # a vertex may lie on both sides, so a source is a vertex and a side
    side = F.when(F.col("boundary_side") == "upper", 1).otherwise(0)
    rims = sided.where("boundary_side in ('lower', 'upper')").select("mesh_id", "vid", side.alias("side"), (F.col("vid").cast("long") * 2 + side).alias("source")).distinct()
    rims = written(rims, "rims")
    rows, entries = routes(mesh.vertices, arcs, rims.select("mesh_id", "source", "vid"), most=most)
    at = ways.select("mesh_id", F.col("vid").alias("u"), "way", "radius").withColumn("v", F.lit(-1))
    rows = rows.join(at, ["mesh_id", "u", "v"], "left").withColumn("way", F.coalesce("way", none))
    from_source = rims.join(ways.select("mesh_id", "vid", F.col("way").alias("from_source")), ["mesh_id", "vid"], "left").select("mesh_id", "source", "side", F.coalesce("from_source", none).alias("from_source"))
    best = by_group(rows, entries.join(from_source, ["mesh_id", "source"])).applyInPandas(partial(_bend, n=n), "mesh_id int, vid int, side int, best double")
    least = best.groupBy("mesh_id", "vid").agg(*(F.min(F.when(F.col("side") == k, F.col("best"))).alias(c) for k, c in ((0, "lower"), (1, "upper"))))
    wrong = F.raise_error(F.lit("both a lower and an upper side are needed")).cast("double")
    whole = F.col("upper") + F.col("lower") + F.lit(float(eps))
    value = F.when(F.col("lower").isNull() | F.col("upper").isNull(), wrong).when(whole == 0, float("nan")).otherwise(F.col("upper") / whole)
    return mesh.vertices.select("mesh_id", "vid").join(least, ["mesh_id", "vid"], "left").select("mesh_id", "vid", value.alias("value"))
