"""Slicing methods by name: mesh -> field -> levels -> segments -> components -> slices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions import config as cfg
from talweg.functions.session import written
from talweg.operators import contour, critical, export, fields, geodesic, topology
from talweg.operators.levels import adaptive_levels
from talweg.sources.tubes import Mesh

Field = Callable[["Engine"], DataFrame]
METHODS: dict[str, Field] = {}


def method(name: str) -> Callable[[Field], Field]:
    """Registers a field (``mesh_id, vid, value``) under a name; anyone may add more."""

    def add(f: Field) -> Field:
        METHODS[name] = f
        return f

    return add


@dataclass
class Result:
    """Tables of one run (field and components are written, the others lazy), and what was asked for."""

    field: DataFrame
    levels: DataFrame
    components: DataFrame
    slices: DataFrame
    metadata: dict = field(default_factory=dict)


class Engine:
    """Steps that methods share over one set of meshes."""

    def __init__(self, mesh: Mesh, config: dict | None = None) -> None:
        self.mesh, self.config = mesh, cfg.defaults(config)
        self.edges = topology.weighted_edges(mesh)
        self.arcs = topology.both_ways(self.edges)
        b = self.config["boundaries"]
        self.sided = topology.side_vertices(mesh, axis=cfg.to_axis(b["axis"]), side_tol=cfg.to_float(b["side_tol"], 0.05), assign_middle=cfg.to_bool(b["assign_middle_to_nearest"], True))

    def distance_to(self, side: str) -> DataFrame:
        return geodesic.to_side(self.mesh.vertices, self.arcs, self.sided.where(F.col("boundary_side") == side))

    def clip_radius(self) -> tuple[float, bool]:
        """Radius within which saddles are joined, and whether it counts in median edges of each mesh."""
        c = self.config["critical_points"]
        if c["clip_saddles_geodesic_threshold"] is not None:
            return cfg.to_float(c["clip_saddles_geodesic_threshold"], 0.0), False
        mode = str(c["clip_saddles"].get("mode", "median_edge_multiplier")).lower()
        return cfg.to_float(c["clip_saddles"].get("value"), 1.5), mode == "median_edge_multiplier"

    def options(self) -> dict:
        """How critical points are detected, as configured."""
        c = self.config["critical_points"]
        radius, by_edge = self.clip_radius()
        strategy = str(c["clip_saddles_strategy"])
        if strategy.lower() in ("confidence", "conf") and not cfg.to_bool(c["compute_confidence"], True):
            strategy = "none"
        return {
            "eps": cfg.to_float(c["eps"], 1e-10), "adaptive": cfg.to_bool(c["adaptive_eps"], True), "normalize": cfg.to_bool(c["normalize"], True),
            "smooth": cfg.to_int(c["smooth_iterations"], 2) if cfg.to_bool(c["smooth_field"], False) else 0,
            "clip": max(0.0, radius), "clip_by_edge": by_edge, "strategy": strategy, "persistence": cfg.to_float(c["persistence_threshold"], 0.0),
        }

    def critical(self, axis: str = "z") -> DataFrame:
        """Critical points of an axis field at one scale."""
        return critical.detect(self.mesh, fields.axis_distance(self.mesh, axis), **self.options())

    def saddles(self, axis: str = "z") -> DataFrame:
        """``mesh_id, vid`` of saddles of an axis field, at one scale or by consensus of several, as configured."""
        c = self.config["critical_points"]
        if not cfg.to_bool(c["multi_scale"], False):
            return self.critical(axis).where("critical_type = 'saddle'").select("mesh_id", "vid")
        found = critical.multi_scale_saddles(self.mesh, fields.axis_distance(self.mesh, axis), cfg.to_int(c["scale_levels"], 3), cfg.to_float(c["min_consensus"], 0.6), **self.options())
        return found.select("mesh_id", "vid")

    def nodes(self, axis: str = "z") -> DataFrame:
        """Vertices with what is known of each: place, side and number of its loop, and, if annotation is on, its critical type."""
        rows = self.mesh.vertices.join(self.sided.select("mesh_id", "vid", "boundary_side", "boundary_number"), ["mesh_id", "vid"], "left")
        return rows.join(critical.annotated(self.critical(axis)), ["mesh_id", "vid"], "left") if cfg.to_bool(self.config["critical_points"]["annotate"], True) else rows

    def run(self, name: str | None = None, height: float | None = None) -> Result:
        """Slices by the named (or configured) method. Several later steps read the field and the components, so both are written once."""
        key = str(name or self.config["general"]["slicing_method"]).strip().lower()
        if key not in METHODS:
            raise ValueError(f"unknown method {key!r}; there are {', '.join(sorted(METHODS))}")
        iso = self.config["iso_slices"]
        height = float(height if height is not None else cfg.to_float(iso["layer_height"], 10.0))
        clip = cfg.to_floats(iso["dr_clip"], (1e-4, 0.2))
        clip = tuple(clip) if len(clip) == 2 else (1e-4, 0.2)
        tol = cfg.to_float(iso["edge_tol"], 1e-6)
        value = written(METHODS[key](self), "field")
        r = fields.normalized(value)
        levels = adaptive_levels(self.mesh, r, height, cfg.to_float(iso["controller_blend"], 0.5), clip, cfg.to_int(iso["max_levels"], 100_000), cfg.to_bool(iso["include_end"], True), tol)
        segs = contour.segments(self.mesh, r, levels, tol)
        parts = written(contour.components(segs, contour.orientation_hints(self.mesh, r), max(2, cfg.to_int(iso["min_component_points"], 3)), cfg.to_int(iso["dedupe_decimals"], 6)), "parts")
        slices = contour.slices(parts, cfg.to_int(iso["samples"], 200), cfg.to_bool(iso["periodic"], True))
        return Result(value, levels, parts, slices, {"requested_method": key, "requested_layer_height": height})

    def documents(self, result: Result, axis: str = "z") -> DataFrame:
        """``mesh_id, document``: a run's slices as JSON, with the saddles of an axis field beside them."""
        saddles = written(self.saddles(axis).join(self.mesh.vertices, ["mesh_id", "vid"]).select("mesh_id", F.col("vid").alias("ord"), "vid", "x", "y", "z"), "saddles")
        attrs = self.sided.select("mesh_id", "vid", "boundary_side", "boundary_number")
        return export.slice_documents(result.slices, result.components, export.component_topology(result.components, self.mesh, attrs, saddles), saddles, self.mesh)


@method("planar_z")
def planar_z(e: Engine) -> DataFrame:
    return fields.coordinate(e.mesh, "z")


@method("principal_axis")
def principal_axis(e: Engine) -> DataFrame:
    return fields.principal_projection(e.mesh)


@method("upper_only")
def upper_only(e: Engine) -> DataFrame:
    return e.distance_to("upper")


@method("lower_only")
def lower_only(e: Engine) -> DataFrame:
    return e.distance_to("lower")


@method("between_boundaries")
def between_boundaries(e: Engine) -> DataFrame:
    return geodesic.between(e.distance_to("lower"), e.distance_to("upper"))


@method("conformal")
def conformal(e: Engine) -> DataFrame:
    """Sides are labelled anew with default tolerances along the field's axis, as the field demands."""
    s = e.config["scalar_field"]
    axis, saddles = cfg.to_axis(s["axis_for_boundary"]), e.saddles(cfg.to_axis(s["axis_for_boundary"]))
    if radii := cfg.to_floats(s["radii_per_saddle"], ()):
        saddles = critical.given_radii(saddles, radii)
    return critical.conforming_field(e.mesh, topology.side_vertices(e.mesh, axis=axis), saddles, cfg.to_float(s["n"], 2.0), cfg.to_float(s["eps"], 1e-9))


def export_name(mesh_name: str, height: float, method_name: str) -> str:
    """File name of a run's export."""
    return f"{mesh_name}_lh{height:g}_{method_name}.json"


def run_default(mesh: Mesh, config: dict | None = None, names: dict[int, str] | None = None) -> tuple[Result, DataFrame, list[str]]:
    """The configured method over all meshes: result, summary of each mesh, and the files written.

    With ``exports.slice_export`` on, each mesh's document goes to its own file in ``exports.export_directory`` on the
    driver's machine, one after another, named after ``names`` (else mesh and its number); a file that
    can't be written is reported in the list and doesn't end the run. For very many meshes turn that off and use ``export.save_documents``.
    """
    engine = Engine(mesh, config)
    result = engine.run()
    files: list[str] = []
    e = engine.config["exports"]
    if cfg.to_bool(e["slice_export"], False):
        method_name, height = result.metadata["requested_method"], result.metadata["requested_layer_height"]
        for row in engine.documents(result).orderBy("mesh_id").toLocalIterator():
            name = export_name((names or {}).get(row["mesh_id"], f"mesh{row['mesh_id']}"), height, method_name)
            try:
                files.append(str(export.write_text(row["document"], str(e["export_directory"] or "analysis_output/slices"), name)))
            except OSError as err:
                files.append(f"not written: {name}: {err}")
    return result, contour.summary(result.slices), files


def main(argv: list[str] | None = None) -> None:
    """``python -m talweg.plans.methods PATH...``: slices mesh files by the configured method and prints a summary of each."""
    import sys

    from pyspark.sql import SparkSession

    from talweg.sources.meshfile import load_meshes, mesh_names

    spark, paths = SparkSession.builder.getOrCreate(), sys.argv[1:] if argv is None else argv
    mesh = load_meshes(spark, paths)
    names = {r["mesh_id"]: Path(r["path"]).stem for r in mesh_names(spark, paths).collect()}
    _, summary, files = run_default(mesh, cfg.yaml_overrides() or None, names)
    for r in summary.orderBy("mesh_id").toLocalIterator():
        levels = r["bifurcation_levels"]
        print(f"{names[r['mesh_id']]}: {r['total_slices']} slices, {r['bifurcation_slices']} with several components, up to {r['max_components']}" + (f", from level {levels[0]:.4f} to {levels[-1]:.4f}" if levels else ""))
    print("\n".join(files))


if __name__ == "__main__":
    main()
