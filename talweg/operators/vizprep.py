"""Plot-ready tables, and a small self-contained HTML page of a mesh."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.operators.geodesic import to_side
from talweg.sources.tubes import Mesh

#: Polynomial coefficients, lowest power first, that approximate the turbo colour map.
TURBO = ((0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943), (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604), (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973))
#: The two triangles of each of the six sides of an eight-cornered cell.
CELL = ((0, 1, 2), (0, 2, 3), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7))


def turbo(t: Column) -> list[Column]:
    """Red, green, blue of 0 to 255 (truncated) for values of 0 to 1."""
    out = []
    for c in TURBO:
        x = F.lit(0.0)
        for k in reversed(c):
            x = x * t + k
        out.append(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
    return out


def colored(field: DataFrame) -> DataFrame:
    """``mesh_id, vid, red, green, blue, alpha`` by value; a mesh of one value takes the first colour."""
    w, v = Window.partitionBy("mesh_id"), F.col("value")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    t = F.when(F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(hi), 0.0).otherwise((v - lo) / (hi - lo))
    r, g, b = turbo(F.col("t"))
    return field.select("mesh_id", "vid", t.alias("t")).select("mesh_id", "vid", r.alias("red"), g.alias("green"), b.alias("blue"), F.lit(255).alias("alpha"))


def scaled_field(field: DataFrame) -> DataFrame:
    """Values scaled per mesh for a plot; a range under 1e-12 gives 0."""
    w = Window.partitionBy("mesh_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return field.select("mesh_id", "vid", F.when(hi - lo < 1e-12, 0.0).otherwise((F.col("value") - lo) / (hi - lo)).alias("value"))


def edge_traces(mesh: Mesh, labelled: DataFrame) -> DataFrame:
    """Edges as line pieces with ends and a trace: lower, upper or internal."""
    e = labelled.select("mesh_id", "u", "v", F.when(F.col("edge_type") == "boundary", F.col("boundary_side")).otherwise("internal").alias("trace"))
    for k in "uv":
        e = e.join(mesh.vertices.select("mesh_id", F.col("vid").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz")), ["mesh_id", k])
    return e


def node_colors(mesh: Mesh, sided: DataFrame) -> DataFrame:
    """0 for lower, 1 for upper and 0.5 for all other vertices."""
    j = mesh.vertices.join(sided.select("mesh_id", "vid", "boundary_side"), ["mesh_id", "vid"], "left")
    return j.select("mesh_id", "vid", "x", "y", "z", F.when(F.col("boundary_side") == "lower", 0.0).when(F.col("boundary_side") == "upper", 1.0).otherwise(0.5).alias("color"))


def slice_lines(parts: DataFrame, layers: DataFrame) -> DataFrame:
    """Points of all components in drawing order, a null point after each, with a label of the layer and the count of its rounded level."""
    w = Window.partitionBy("mesh_id", F.round("level", 6)).orderBy("layer_number")
    label = layers.withColumn("label", F.concat_ws(".", F.col("layer_number").cast("string"), (F.row_number().over(w) - 1).cast("string"))).select("mesh_id", "layer", "label")
    ends = F.concat(F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))), F.array(F.struct(*(F.lit(None).cast("double").alias(c) for c in "xyz"))))
    p = parts.join(label, ["mesh_id", "layer"]).select("mesh_id", "layer", "component_id", "level", "label", F.posexplode(ends).alias("pos", "p"))
    return p.select("mesh_id", "layer", "component_id", "pos", "level", "label", "p.*")


def cell_triangles(cells: DataFrame, metric: str | None = None, only: list[int] | None = None) -> DataFrame:
    """Twelve triangles of each eight-cornered cell (``slice_index, cell_id, vertices, metrics``), with a metric's value."""
    c = cells.where(F.col("slice_index").isin(only)) if only is not None else cells
    tri = F.explode(F.array(*(F.array(*map(F.lit, t)) for t in CELL)))
    value = F.col("metrics")[metric] if metric else F.lit(None).cast("double")
    c = c.where(F.size("vertices") == 8).select("slice_index", "cell_id", "vertices", value.alias("value"), tri.alias("t"))
    return c.select("slice_index", "cell_id", "value", *(F.get("vertices", F.get("t", F.lit(i)))[k].alias(f"{k}{i}") for i in range(3) for k in "xyz"))


def color_range(df: DataFrame, column: str = "value") -> DataFrame:
    """Least and largest finite value."""
    v = F.col(column)
    ok = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return df.agg(F.min(ok).alias("cmin"), F.max(ok).alias("cmax"))


def bounded(values: DataFrame, least: float | None = None, most: float | None = None, column: str = "value") -> DataFrame:
    """Values of a metric held between the given bounds, as they are drawn on a mesh."""
    v = F.col(column)
    v = F.greatest(v, F.lit(float(least))) if least is not None else v
    return values.withColumn(column, F.least(v, F.lit(float(most))) if most is not None else v)


def require_sides(sided: DataFrame) -> DataFrame:
    """``sided`` if it has rows; a view of sides that no mesh has is an error."""
    if sided.isEmpty():
        raise RuntimeError("boundary sides are needed: label them first")
    return sided


def require_saddles(critical: DataFrame) -> DataFrame:
    """The saddles among annotated vertices (``critical_type``); a view of saddles that no mesh has is an error."""
    found = critical.where("critical_type = 'saddle'")
    if found.isEmpty():
        raise RuntimeError("saddle annotations are needed: detect critical points first")
    return found


def side_view(mesh: Mesh, arcs: DataFrame, sided: DataFrame, side: str) -> DataFrame:
    """``mesh_id, vid, x, y, z, value``: vertices with their distance to the lower or upper side."""
    d = to_side(mesh.vertices, arcs, require_sides(sided).where(F.col("boundary_side") == side))
    return mesh.vertices.join(d, ["mesh_id", "vid"])


def saddles_view(mesh: Mesh, arcs: DataFrame, critical: DataFrame) -> DataFrame:
    """``mesh_id, vid, x, y, z, value``: vertices with their distance to the nearest saddle."""
    return mesh.vertices.join(to_side(mesh.vertices, arcs, require_saddles(critical).select("mesh_id", "vid")), ["mesh_id", "vid"])


def save_html(mesh: Mesh, field: DataFrame, mesh_id: int, path: str, title: str = "mesh") -> Path:
    """One mesh as a page that draws itself on a canvas, no scripts from elsewhere."""
    v = mesh.vertices.where(F.col("mesh_id") == mesh_id).join(colored(field), ["mesh_id", "vid"]).orderBy("vid").collect()
    f = mesh.faces.where(F.col("mesh_id") == mesh_id).select("a", "b", "c").collect()
    at = {r["vid"]: i for i, r in enumerate(v)}
    data = {"p": [[r["x"], r["y"], r["z"]] for r in v], "c": [[r["red"], r["green"], r["blue"]] for r in v], "f": [[at[i] for i in r] for r in f]}
    script = """const D=DATA,g=document.querySelector('canvas').getContext('2d');let a=.6;
function draw(){g.clearRect(0,0,800,800);const lo=[0,1,2].map(k=>Math.min(...D.p.map(p=>p[k]))),hi=[0,1,2].map(k=>Math.max(...D.p.map(p=>p[k])));
const s=600/Math.hypot(...hi.map((h,k)=>h-lo[k])),q=D.p.map(p=>{const x=p[0]-(lo[0]+hi[0])/2,y=p[1]-(lo[1]+hi[1])/2,z=p[2]-(lo[2]+hi[2])/2;
return[400+s*(x*Math.cos(a)-y*Math.sin(a)),400-s*z+.3*s*(x*Math.sin(a)+y*Math.cos(a)),x*Math.sin(a)+y*Math.cos(a)]});
[...D.f].sort((u,v)=>Math.max(...v.map(i=>q[i][2]))-Math.max(...u.map(i=>q[i][2]))).forEach(t=>{g.beginPath();t.forEach((i,k)=>k?g.lineTo(q[i][0],q[i][1]):g.moveTo(q[i][0],q[i][1]));
g.fillStyle='rgb('+D.c[t[0]].join()+')';g.fill()})}draw();onmousemove=e=>{if(e.buttons){a+=e.movementX/100;draw()}}""".replace("DATA", json.dumps(data))
    out = Path(path)
    out.write_text(f'<!DOCTYPE html><meta charset="utf-8"><title>{title}</title><canvas width="800" height="800"></canvas><script>{script}</script>', encoding="utf-8")
    return out
