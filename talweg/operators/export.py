"""Documents: slices and fields as JSON, graphs as GraphML, and topology of components."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.session import written
from talweg.operators.fields import bounding_box, field_stats
from talweg.operators.nearest import nearest
from talweg.sources.tubes import Mesh


def as_lists(points: str) -> Column:
    """Points as arrays of three numbers."""
    return F.transform(points, lambda p: F.array(p["x"], p["y"], p["z"]))


#: Digits of a squared distance that decide which of several is nearest: beyond them, order by id decides.
DIGITS = 9


def nearest_saddles(parts: DataFrame, saddles: DataFrame) -> DataFrame:
    """``mesh_id, layer, component_id, vid, n, mean_distance``: per component, how many points lie nearest to each saddle (``mesh_id, ord, vid, x, y, z``), ties by order."""
    p = parts.select("mesh_id", "layer", "component_id", F.posexplode("points").alias("pos", "p")).select("mesh_id", "layer", "component_id", "pos", *(F.col(f"p.{c}").alias(f"p{c}") for c in "xyz"))
    near = nearest(p, saddles.select("mesh_id", F.struct("ord", "vid").alias("site"), "x", "y", "z"), ["layer", "component_id", "pos"], DIGITS)
    return near.groupBy("mesh_id", "layer", "component_id", F.col("site.ord").alias("ord"), F.col("site.vid").alias("vid")).agg(F.count("*").alias("n"), F.avg(F.sqrt("d2")).alias("mean_distance"))


def nearest_vertex(points: DataFrame, mesh: Mesh, key: list[str]) -> DataFrame:
    """``points`` (``mesh_id``, the rest of ``key``, ``mx, my, mz``) with the nearest vertex: ``vid, distance``, ties by id."""
    own = [k for k in key if k != "mesh_id"]
    asked = points.select(*key, *(F.col(f"m{c}").alias(f"p{c}") for c in "xyz"))
    near = nearest(asked, mesh.vertices.select("mesh_id", F.col("vid").alias("site"), "x", "y", "z"), own, DIGITS)
    return near.select(*key, F.col("site").alias("vid"), F.sqrt("d2").alias("distance"))


def component_topology(parts: DataFrame, mesh: Mesh, attrs: DataFrame, saddles: DataFrame) -> DataFrame:
    """Per component: the vertex nearest to its centroid with that vertex's attributes, and the histogram of nearest saddles, most first. It is written, so documents don't carry its plan."""
    key = ["mesh_id", "layer", "component_id"]
    mid = parts.select(*key, *((F.aggregate(F.col(f"points.{c}"), F.lit(0.0), lambda s, x: s + x) / F.size("points")).alias(f"m{c}") for c in "xyz"))
    near = nearest_vertex(mid, mesh, key).withColumnRenamed("distance", "nearest_vertex_distance").join(attrs, ["mesh_id", "vid"], "left").withColumnRenamed("vid", "nearest_vertex")
    seen = nearest_saddles(parts, saddles).withColumn("total", F.sum("n").over(Window.partitionBy(*key)))
    bars = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "ord", F.col("vid").alias("index"), F.col("n").alias("count"), (F.col("n") / F.col("total")).alias("fraction"), "mean_distance")))
    hist = seen.groupBy(*key).agg(F.transform(bars, lambda b: F.struct(b["index"].alias("index"), b["count"].alias("count"), b["fraction"].alias("fraction"), b["mean_distance"].alias("mean_distance"))).alias("saddle_histogram"))
    out = near.join(hist, key, "left")
    signature = F.transform(F.slice("saddle_histogram", 1, 3), lambda b: b["index"])
    return written(out.withColumns({"saddle_signature": F.coalesce(signature, F.expr("array()").cast("array<int>")), "dominant_saddle": F.get("saddle_histogram", F.lit(0))["index"]}), "topology")


def saddle_meta(saddles: DataFrame) -> DataFrame:
    """``mesh_id, saddles``: index and place of a mesh's saddles in order."""
    at = F.array_sort(F.collect_list(F.struct("ord", "vid", F.array("x", "y", "z").alias("point"))))
    return saddles.groupBy("mesh_id").agg(F.transform(at, lambda s: F.struct(s["vid"].alias("index"), s["point"].alias("point"))).alias("saddles"))


def mesh_meta(mesh: Mesh) -> DataFrame:
    """``mesh_id, mesh``: numbers of vertices and faces."""
    n = mesh.vertices.groupBy("mesh_id").agg(F.count("*").alias("vertex_count")).join(mesh.faces.groupBy("mesh_id").agg(F.count("*").alias("face_count")), "mesh_id", "left")
    return n.select("mesh_id", F.struct("vertex_count", F.coalesce("face_count", F.lit(0)).alias("face_count")).alias("mesh"))


def slice_documents(slices: DataFrame, parts: DataFrame, topology: DataFrame | None = None, saddles: DataFrame | None = None, mesh: Mesh | None = None) -> DataFrame:
    """``mesh_id, document``: one JSON text per mesh with its slices in order of layer; saddles and mesh go to its head, if given."""
    p = parts.join(topology, ["mesh_id", "layer", "component_id"], "left") if topology is not None else parts
    topo = F.struct(*(c for c in topology.columns if c not in ("mesh_id", "layer", "component_id"))) if topology is not None else F.lit(None)
    comps = p.groupBy("mesh_id", "layer").agg(F.collect_list(F.struct("component_id", F.col("curve_length").alias("length"), as_lists("points").alias("points"), topo.alias("topology"))).alias("c"))
    comps = comps.withColumn("components", F.transform(F.array_sort("c", lambda a, b: a["component_id"] - b["component_id"]), lambda x: F.struct(x["length"].alias("length"), x["points"].alias("points"), x["topology"].alias("topology")))).drop("c")
    rows = slices.join(comps, ["mesh_id", "layer"]).select("mesh_id", F.struct("layer_number", "level", "total_length", "component_count", as_lists("curve").alias("curve"), "components", as_lists("points").alias("raw_points")).alias("s"))
    docs = rows.groupBy("mesh_id").agg(F.count("*").alias("n"), F.collect_list("s").alias("s"))
    ordered = F.array_sort("s", lambda a, b: a["layer_number"] - b["layer_number"])
    meta = [F.col("n").alias("slice_count"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("exported_at")]
    for name, more in (("saddles", saddle_meta(saddles) if saddles is not None else None), ("mesh", mesh_meta(mesh) if mesh is not None else None)):
        if more is not None:
            docs = docs.join(more, "mesh_id", "left")
            meta.append(F.col(name))
    return docs.select("mesh_id", F.to_json(F.struct(F.struct(*meta).alias("meta"), ordered.alias("slices"))).alias("document"))


def field_documents(mesh: Mesh, field: DataFrame, include_faces: bool = True) -> DataFrame:
    """``mesh_id, document``: statistics, box, vertices, values and faces of each mesh; values that aren't finite are an error."""
    v = F.col("value")
    value = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit("field values must be finite")).cast("double")).otherwise(v)
    rows = mesh.vertices.join(field.select("mesh_id", "vid", value.alias("value")), ["mesh_id", "vid"])
    data = rows.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z", "value"))).alias("v"))
    out = data.join(field_stats(field), "mesh_id").join(bounding_box(mesh), "mesh_id")
    box = F.struct(F.array(*(f"min_{c}" for c in "xyz")).alias("min"), F.array(*(f"max_{c}" for c in "xyz")).alias("max"))
    parts = [as_lists("v").alias("vertices"), F.transform("v", lambda p: p["value"]).alias("scalar_field")]
    faces = F.lit(0)
    if include_faces:
        f = mesh.faces.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("fid", "a", "b", "c"))).alias("f"))
        out = out.join(f, "mesh_id", "left")
        parts.append(F.transform("f", lambda t: F.array(t["a"], t["b"], t["c"])).alias("faces"))
        faces = F.coalesce(F.size("f"), F.lit(0))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    meta = F.struct(now.alias("exported_at"), F.size("v").alias("vertex_count"), faces.alias("face_count"), F.struct("min", "max", "mean", "std", "range").alias("field_statistics"), box.alias("bounding_box"))
    return out.select("mesh_id", F.to_json(F.struct(meta.alias("meta"), *parts)).alias("document"))


#: Types that a GraphML key declares, by column type; any other is a string.
GRAPHML_TYPES = {"int": "int", "bigint": "long", "double": "double", "float": "float", "boolean": "boolean"}


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``mesh_id, kind, a, b, line``: a GraphML element per key (kind -1), node (``mesh_id, vid`` and attributes) and edge (``u, v`` and attributes); null is the text None, special signs are escaped."""

    def own(df: DataFrame, skip: tuple) -> list[tuple[str, str]]:
        return [(c, t) for c, t in df.dtypes if c not in skip]

    def data(cols: list[tuple[str, str]], of: str) -> Column:
        text = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("None")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.concat_ws("", *(F.format_string(f'<data key="{of}_{c}">%s</data>', text(c)) for c, _ in cols)) if cols else F.lit("")

    of_nodes, of_edges = own(nodes, ("mesh_id", "vid")), own(edges, ("mesh_id", "u", "v"))
    keys = [f'<key id="{of}_{c}" for="{of}" attr.name="{c}" attr.type="{GRAPHML_TYPES.get(t, "string")}"/>' for of, cols in (("node", of_nodes), ("edge", of_edges)) for c, t in cols]
    head = nodes.select("mesh_id").distinct().select("mesh_id", F.posexplode(F.array(*map(F.lit, keys)).cast("array<string>")).alias("a", "line")).select("mesh_id", F.lit(-1).alias("kind"), "a", F.lit(0).alias("b"), "line")
    n = nodes.select("mesh_id", F.lit(0).alias("kind"), F.col("vid").alias("a"), F.lit(0).alias("b"), F.format_string('<node id="%d">%s</node>', "vid", data(of_nodes, "node")).alias("line"))
    e = edges.select("mesh_id", F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.format_string('<edge source="%d" target="%d">%s</edge>', "u", "v", data(of_edges, "edge")).alias("line"))
    return head.unionByName(n).unionByName(e)


def write_text(text: str, folder: str, name: str) -> Path:
    """A text as a UTF-8 file on the driver's machine; the folder is made."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")
    return path / name


def save_documents(docs: DataFrame, folder: str) -> None:
    """Many documents: one text row each, by mesh."""
    docs.select("mesh_id", F.col("document").alias("value")).write.partitionBy("mesh_id").text(folder)


def save_document(docs: DataFrame, mesh_id: int, folder: str, name: str = "slices.json") -> Path:
    """One mesh's document as a file on the driver's machine; the folder is made."""
    row = docs.where(F.col("mesh_id") == mesh_id).first()
    if row is None:
        raise ValueError(f"no mesh {mesh_id}")
    return write_text(row["document"], folder, name)


def save_graphml(lines: DataFrame, mesh_id: int, path: str) -> None:
    """One mesh's graph as a GraphML file, streamed through the driver in order."""
    rows = lines.where(F.col("mesh_id") == mesh_id).orderBy("kind", "a", "b").select("line")
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        opened = False
        for r in rows.toLocalIterator():
            if not opened and r["line"].startswith("<node"):
                f.write('<graph edgedefault="undirected">\n')
                opened = True
            f.write(r["line"] + "\n")
        if not opened:
            f.write('<graph edgedefault="undirected">\n')
        f.write("</graph></graphml>\n")
