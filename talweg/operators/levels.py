"""Adaptive levels from a table of breakpoints: along the level, contour length and gradient-weighted length are piecewise linear."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.session import written
from talweg.operators.fields import corners, effective_gradient, gradient_norm, layer_intervals
from talweg.sources.tubes import Mesh

#: Breakpoints that one task looks at, at most about: a mesh of more is walked range by range.
CELL = 500_000
SUMS = ("n", "a", "b", "wa", "wb")


def _ramp(start: F.Column, after: bool, stop: F.Column, a: F.Column, b: F.Column) -> list[F.Column]:
    """A line a + b r that holds from ``start`` (beyond it, if ``after``) to ``stop``, as what changes at both ends."""
    on = F.struct(start.alias("value"), F.lit(int(after)).alias("after"), F.lit(1).alias("n"), a.alias("a"), b.alias("b"))
    off = F.struct(stop.alias("value"), F.lit(1).alias("after"), F.lit(-1).alias("n"), (-a).alias("a"), (-b).alias("b"))
    return [on, off]


def breakpoints(faces: DataFrame, tol: float) -> DataFrame:
    """``mesh_id, value, after, n, a, b, wa, wb``: how the sums over all contour segments at level r change at a value (``after`` 1: just beyond it).

    ``faces``: ``mesh_id, g, pa, pb, pc`` with values r. At levels between a face's least and middle value its segment grows in proportion, up to the
    length across the middle corner, then it shrinks to the largest. A side whose values differ by less than ``tol`` is level.
    Summed up to r, ``n`` counts segments, ``a + b r`` is their length and ``wa + wb r`` the length weighted by finite gradients.
    Faces with NaN values have none. Equal values of a mesh meet in one row, before and after the shuffle.
    """
    p = F.array_sort(F.array(*(F.struct(*(F.col(f"{k}.{c}").alias(c) for c in "rxyz")) for k in ("pa", "pb", "pc"))))
    f = faces.select("mesh_id", F.when(~F.isnan("g") & (F.col("g") < float("inf")), F.col("g")).otherwise(0.0).alias("g"), p.alias("p"))
    f = f.select("mesh_id", "g", *(F.get("p", F.lit(i)).alias(f"p{i}") for i in range(3))).where("not isnan(p2.r)")
    f0, f1, f2 = (F.col(f"p{i}.r") for i in range(3))
    share = (f1 - f0) / (f2 - f0)
    gap = [F.col(f"p1.{c}") - (F.col(f"p0.{c}") + share * (F.col(f"p2.{c}") - F.col(f"p0.{c}"))) for c in "xyz"]
    f = f.where(f2 - f0 >= tol).withColumn("most", F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]))
    up, down = F.col("most") / (f1 - f0), F.col("most") / (f2 - f1)
    rises, falls, none = f1 - f0 >= tol, f2 - f1 >= tol, F.array().cast("array<struct<value:double,after:int,n:int,a:double,b:double>>")
    first = F.when(rises, F.array(*_ramp(f0, False, f1, -up * f0, up))).otherwise(none)
    then = F.when(falls & rises, F.array(*_ramp(f1, True, f2, down * f2, -down))).when(falls, F.array(*_ramp(f0, False, f2, down * f2, -down))).otherwise(none)
    x = f.select("mesh_id", "g", F.explode(F.concat(first, then)).alias("x")).select("mesh_id", "g", "x.*")
    return x.groupBy("mesh_id", "value", "after").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("g") * F.col("a")).alias("wa"), F.sum(F.col("g") * F.col("b")).alias("wb"))


def _walk(rows: pd.DataFrame, state: pd.DataFrame, cell: int, blend: float, clip: tuple[float, float], most: int) -> pd.DataFrame:
    """One mesh's levels within a range of values, from the state that the range before has left."""
    if not len(state):
        return state
    s = state.iloc[0].to_dict()
    rows = rows.sort_values(["value", "after"])
    value, after = rows["value"].to_numpy(), rows["after"].to_numpy()
    sums = np.vstack([np.array([s[c] for c in SUMS])[None], np.array([s[c] for c in SUMS])[None] + np.cumsum(rows[list(SUMS)].to_numpy(float), axis=0)])
    size = np.abs(sums[:, 1:]).max(initial=1.0)
    bounds, levels, at = s["bounds"], list(s["levels"]), s["at"]
    end = bounds[cell] if cell < len(bounds) else np.inf
    while s["done"] < s["n_intervals"] - 1 and len(levels) < most and at < end:
        lo, hi = np.searchsorted(value, [at, np.nextafter(at, np.inf)])
        k = lo + int((after[lo:hi] == 0).sum())  # what changes beyond the level isn't there yet
        n, a, b, wa, wb = sums[k]
        length, weighted = (a + b * at, wa + wb * at) if n > 0.5 else (0.0, 0.0)
        mean = weighted / length if length > 1e-12 * size and weighted > 0 else s["g_eff"]
        rest = max(0.0, 1 - at)
        step = min(min(max((1 - blend) * rest / (s["n_intervals"] - s["done"]) + blend * s["h_mod"] * mean, 1e-4), 0.2), rest)
        at += step
        levels.append(at)
        s["done"] += 1
    out = state.copy()
    out["at"], out["done"], out["levels"] = at, s["done"], [levels]
    for c, v in zip(SUMS, sums[-1], strict=True):
        out[c] = v
    return out


def adaptive_levels(mesh: Mesh, field: DataFrame, height: float, blend: float = 0.5, clip: tuple[float, float] = (1e-4, 0.2), most: int = 100_000, include_end: bool = True, tol: float = 1e-6, cell: int = CELL) -> DataFrame:
    """``mesh_id, levels``: levels from 0 to 1 whose steps follow what is left and the gradient along the last contour (columns of ``field``: r).

    Level i + 1 needs the contour length at level i. The faces are read once, for a table of breakpoints; the
    recurrence looks lengths up there and never sees a face. A mesh of more than about ``cell`` breakpoints is cut
    into ranges of values, which are walked in turn with the levels and sums so far handed on, so no task holds a
    whole mesh. A mesh where no face rises by ``tol`` steps by its heights only; meshes without faces give no row.
    """
    if not 0 < height < float("inf"):
        raise ValueError("layer height must be positive and finite")
    faces = written(corners(mesh, field).select("mesh_id", "pa", "pb", "pc", gradient_norm().alias("g")), "cornered")
    table = breakpoints(faces, tol)
    start = layer_intervals(effective_gradient(faces), height, clip).join(effective_gradient(faces), "mesh_id")
    table = written(table, "breakpoints")
    sizes = table.groupBy("mesh_id").count().agg(F.max("count")).first()[0] or 0
    cells = max(1, -(-sizes // cell))
    shares = [k / cells for k in range(1, cells)]
    bounds = table.groupBy("mesh_id").agg((F.percentile_approx("value", shares, 10 * cells) if shares else F.array().cast("array<double>")).alias("bounds"))
    state = start.join(bounds, "mesh_id", "left").select("mesh_id", "n_intervals", "h_mod", "g_eff", F.lit(0.0).alias("at"), F.lit(0).alias("done"), F.array(F.lit(0.0)).alias("levels"), F.coalesce("bounds", F.array().cast("array<double>")).alias("bounds"), *(F.lit(0.0).alias(c) for c in SUMS))
    if cells > 1:  # a folder for each range, so each is read once
        state = written(state, "state")
        k = F.size(F.filter("bounds", lambda b: b <= F.col("value")))
        table = written(table.join(state.select("mesh_id", "bounds"), "mesh_id").select(*table.columns, k.alias("cell")), "ranges", "cell")
    a = min(max(blend, 0.0), 1.0)
    for k in range(cells):
        here = table.where(F.col("cell") == k).drop("cell") if cells > 1 else table
        walk = partial(_walk, cell=k, blend=a, clip=tuple(clip), most=most)
        state = here.groupBy("mesh_id").cogroup(state.groupBy("mesh_id")).applyInPandas(walk, state.schema)
        if cells > 1:
            state = written(state, "state")
    last = F.element_at("levels", -1)
    ended = F.when(F.lit(include_end) & (last < 1 - 1e-12), F.concat("levels", F.array(F.lit(1.0)))).otherwise(F.col("levels"))
    return state.select("mesh_id", ended.alias("levels"))
