"""Queries over the derived tubes by operator name, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.functions.session import written
from talweg.operators import contour, critical, export, fields, geodesic, levels, topology, vizprep
from talweg.plans.methods import METHODS, Engine
from talweg.sources.tubes import Mesh, tubes

Query = Callable[[SparkSession, str], DataFrame]
LEVELS = [0.25, 0.47, 0.75]
HEIGHT = 0.5

#: SQL building blocks in order of need; a query takes those that its text names, and theirs.
BLOCKS = {
    "v": """select cast(p_partkey // 200 as int) as mesh_id, cast(p_partkey % 200 as int) as vid,
        cast(case when p_partkey % 20 < 5 then p_partkey % 20 when p_partkey % 20 < 10 then 5 when p_partkey % 20 < 15 then 15 - p_partkey % 20 else 0 end as double) as x,
        cast(case when p_partkey % 20 < 5 then 0 when p_partkey % 20 < 10 then p_partkey % 20 - 5 when p_partkey % 20 < 15 then 5 else 20 - p_partkey % 20 end as double) as y,
        cast((p_partkey % 200) // 20 as double) + cast(0.3 as double) * (case when (p_partkey % 200) // 20 in (0, 9) then 0 else (p_size * 7 + p_partkey * 3) % 11 end) as z
      from part""",
    "cell": """select m.mesh_id, c.range as k, c.range % 20 as i, c.range // 20 as j from (select mesh_id from v where vid = 0) m, range(180) c
      where not (c.range // 20 in (4, 5) and c.range % 20 in (3, 13))""",
    "f": """select mesh_id, cast(2 * k as int) as fid, cast(20 * j + i as int) as a, cast(20 * j + (i + 1) % 20 as int) as b, cast(20 * (j + 1) + i as int) as c from cell
      union all select mesh_id, cast(2 * k + 1 as int), cast(20 * j + (i + 1) % 20 as int), cast(20 * (j + 1) + (i + 1) % 20 as int), cast(20 * (j + 1) + i as int) from cell""",
    "he": "select mesh_id, fid, a as p, b as q from f union all select mesh_id, fid, b, c from f union all select mesh_id, fid, c, a from f",
    "e": "select mesh_id, least(p, q) as u, greatest(p, q) as w, count(*) as n_faces from he group by all",
    "el": """select e.mesh_id, e.u, e.w, n_faces, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) as weight
      from e join v p on p.mesh_id = e.mesh_id and p.vid = e.u join v q on q.mesh_id = e.mesh_id and q.vid = e.w""",
    "sym": "select mesh_id, u as s, w as t, weight from el union all select mesh_id, w, u, weight from el",
    "be": "select mesh_id, u, w from e where n_faces = 1",
    "bv": "select mesh_id, u as vid from be union select mesh_id, w from be",
    "bs": "select mesh_id, u as s, w as t from be union all select mesh_id, w, u from be",
    "reach": "select mesh_id, vid as s, vid as t from bv union select reach.mesh_id, reach.s, bs.t from reach join bs on bs.mesh_id = reach.mesh_id and bs.s = reach.t",
    "lab": "select mesh_id, s as vid, min(t) as label from reach group by all",
    "lnum": """select mesh_id, label, cast(row_number() over (partition by mesh_id order by round(avg(z), 9), label) - 1 as int) as boundary_number
      from lab join v using (mesh_id, vid) group by mesh_id, label""",
    "loop": "select mesh_id, vid, boundary_number from lab join lnum using (mesh_id, label)",
    "meta": "select mesh_id, boundary_number, count(*) as n_vertices, avg(x) as cx, avg(y) as cy, avg(z) as cz from loop join v using (mesh_id, vid) group by all",
    "rng": "select mesh_id, min(cz) as lo, max(cz) as hi from meta group by all",
    "side": """select mesh_id, boundary_number, case when cz <= lo + greatest(hi - lo, 1e-14) * cast(0.05 as double) then 'lower' when cz >= hi - greatest(hi - lo, 1e-14) * cast(0.05 as double) then 'upper'
      when abs(cz - lo) <= abs(hi - cz) then 'lower' else 'upper' end as boundary_side from meta join rng using (mesh_id)""",
    "sv": "select mesh_id, vid, boundary_number, boundary_side from loop join side using (mesh_id, boundary_number)",
    "zr": "select mesh_id, min(z) as lo, max(z) as hi from v group by all",
    "r": "select mesh_id, vid, least(greatest((z - lo) / (hi - lo), 0), 1) as r from v join zr using (mesh_id)",
    "vr": "select v.mesh_id, v.vid, x, y, z, r from v join r using (mesh_id, vid)",
    "fv": """select f.mesh_id, fid, p.x as ax, p.y as ay, p.z as az, p.r as ar, q.x as bx, q.y as by_, q.z as bz, q.r as br, s.x as cx, s.y as cy, s.z as cz, s.r as cr
      from f join vr p on p.mesh_id = f.mesh_id and p.vid = f.a join vr q on q.mesh_id = f.mesh_id and q.vid = f.b join vr s on s.mesh_id = f.mesh_id and s.vid = f.c""",
    "fe": """select mesh_id, fid, ar, br, cr, bx - ax as ux, by_ - ay as uy, bz - az as uz, cx - ax as wx, cy - ay as wy, cz - az as wz from fv""",
    "fn": """select mesh_id, fid, ar, br, cr, sqrt(ux * ux + uy * uy + uz * uz) as xj, ux * wx + uy * wy + uz * wz as dt,
      sqrt((uy * wz - uz * wy) * (uy * wz - uz * wy) + (uz * wx - ux * wz) * (uz * wx - ux * wz) + (ux * wy - uy * wx) * (ux * wy - uy * wx)) as area from fe""",
    "fg": """select mesh_id, fid, case when xj < 1e-12 or area < 1e-12 or area / xj < 1e-12 then 0 else
      sqrt(((br - ar) / xj) * ((br - ar) / xj) + ((cr - ar - dt / xj * ((br - ar) / xj)) / (area / xj)) * ((cr - ar - dt / xj * ((br - ar) / xj)) / (area / xj))) end as g from fn""",
    "geff": "select mesh_id, case when median(g) > 0 then median(g) else 1.0 end as g_eff from fg where isfinite(g) and g >= 0 group by mesh_id",
    "lev": "select * from (values (0, cast(0.25 as double)), (1, cast(0.47 as double)), (2, cast(0.75 as double))) t(layer, level)",
    "fs": """select mesh_id, fid, 0 as k, ax as px, ay as py, az as pz, ar as pr, bx as qx, by_ as qy, bz as qz, br as qr from fv
      union all select mesh_id, fid, 1, bx, by_, bz, br, cx, cy, cz, cr from fv union all select mesh_id, fid, 2, cx, cy, cz, cr, ax, ay, az, ar from fv""",
    "hit": """select mesh_id, layer, level, fid, k, px + t * (qx - px) as x, py + t * (qy - py) as y, pz + t * (qz - pz) as z from
      (select *, (level - pr) / (qr - pr) as t from fs, lev where not (pr > level + 1e-6 and qr > level + 1e-6) and not (pr < level - 1e-6 and qr < level - 1e-6) and abs(qr - pr) >= 1e-6)
      where t >= -1e-6 and t <= 1 + 1e-6""",
    "two": "select *, row_number() over (partition by mesh_id, layer, fid order by k) as h, count(*) over (partition by mesh_id, layer, fid) as n from hit",
    "seg": """select p.mesh_id, p.layer, p.level, p.fid, p.x as x0, p.y as y0, p.z as z0, q.x as x1, q.y as y1, q.z as z1,
      sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) as len
      from two p join two q on p.mesh_id = q.mesh_id and p.layer = q.layer and p.fid = q.fid and p.h = 1 and q.h = 2""",
    "lk": "select mesh_id, fid, a as v, b as u, c as w from f union all select mesh_id, fid, b, c, a from f union all select mesh_id, fid, c, a, b from f",
    "ring": "select distinct mesh_id, v as vid, n from (select mesh_id, v, u as n from lk union all select mesh_id, v, w from lk)",
    "rv": "select ring.mesh_id, ring.vid, ring.n, r.r from ring join r on r.mesh_id = ring.mesh_id and r.vid = ring.n",
    "rd": "select rv.mesh_id, rv.vid, rv.n, p.r - rv.r as d from rv join r p on p.mesh_id = rv.mesh_id and p.vid = rv.vid",
    "aeps": """select mesh_id, vid, greatest(1e-12, least(cast(0.1 as double) * gaps[1 + cast(floor(cast(0.1 as double) * (len(gaps) - 1)) as int)], cast(0.01 as double) * (hi - lo))) as eps from
      (select p.mesh_id, p.vid, list(abs(p.r - q.r) order by abs(p.r - q.r)) as gaps, greatest(max(p.r), max(q.r)) as hi, least(min(p.r), min(q.r)) as lo from rv p join rv q on p.mesh_id = q.mesh_id and p.vid = q.vid and p.n < q.n group by all)""",
    "rw": """select mesh_id, v as vid, min(u) as start, min(u) as cur, 0 as pos from lk group by all union all
      select rw.mesh_id, rw.vid, start, lk.w as cur, pos + 1 as pos from rw join lk on lk.mesh_id = rw.mesh_id and lk.v = rw.vid and lk.u = rw.cur where lk.w <> start""",
    "crit": """select v.mesh_id, v.vid, cast(coalesce(changes, 0) as int) as changes, case when bv.vid is not null or above is null then 'regular' when changes = 0 and above then 'maximum' when changes = 0 then 'minimum' when changes >= 4 then 'saddle' else 'regular' end as critical_type
      from v left join bv on bv.mesh_id = v.mesh_id and bv.vid = v.vid left join (select mesh_id, vid, sum(cast(s <> prev as int)) as changes, bool_or(s) as above from (select mesh_id, vid, s,
        coalesce(lag(s) over (partition by mesh_id, vid order by pos), last_value(s) over (partition by mesh_id, vid order by pos rows between unbounded preceding and unbounded following)) as prev
        from (select rd.mesh_id, rd.vid, pos, d > 0 as s from rw join rd on rd.mesh_id = rw.mesh_id and rd.vid = rw.vid and rd.n = rw.cur join aeps on aeps.mesh_id = rd.mesh_id and aeps.vid = rd.vid where abs(d) > eps
          and not exists (select 1 from bv b where b.mesh_id = rd.mesh_id and b.vid = rd.vid))) group by all) c on c.mesh_id = v.mesh_id and c.vid = v.vid""",
    "critf": """select v.mesh_id, v.vid, cast(coalesce(changes, 0) as int) as changes, case when bv.vid is not null or above is null then 'regular' when changes = 0 and above then 'maximum' when changes = 0 then 'minimum' when changes >= 4 then 'saddle' else 'regular' end as critical_type
      from v left join bv on bv.mesh_id = v.mesh_id and bv.vid = v.vid left join (select mesh_id, vid, sum(cast(s <> prev as int)) as changes, bool_or(s) as above from (select mesh_id, vid, s,
        coalesce(lag(s) over (partition by mesh_id, vid order by pos), last_value(s) over (partition by mesh_id, vid order by pos rows between unbounded preceding and unbounded following)) as prev
        from (select rd.mesh_id, rd.vid, pos, d > 0 as s from rw join rd on rd.mesh_id = rw.mesh_id and rd.vid = rw.vid and rd.n = rw.cur join aeps on aeps.mesh_id = rd.mesh_id and aeps.vid = rd.vid where abs(d) > 1e-12
          and not exists (select 1 from bv b where b.mesh_id = rd.mesh_id and b.vid = rd.vid))) group by all) c on c.mesh_id = v.mesh_id and c.vid = v.vid""",
    "dl": """select mesh_id, vid, cast(0 as double) as d from sv where boundary_side = 'lower' union
      (select dl.mesh_id, t as vid, min(dl.d + weight) as d from dl join sym on sym.mesh_id = dl.mesh_id and s = dl.vid
        left join recurring.dl o on o.mesh_id = sym.mesh_id and o.vid = t where o.d is null or dl.d + weight < o.d group by all)""",
    "du": """select mesh_id, vid, cast(0 as double) as d from sv where boundary_side = 'upper' union
      (select du.mesh_id, t as vid, min(du.d + weight) as d from du join sym on sym.mesh_id = du.mesh_id and s = du.vid
        left join recurring.du o on o.mesh_id = sym.mesh_id and o.vid = t where o.d is null or du.d + weight < o.d group by all)""",
    "dn": """select mesh_id, boundary_number, vid, cast(0 as double) as d from sv union
      (select dn.mesh_id, dn.boundary_number, t as vid, min(dn.d + weight) as d from dn join sym on sym.mesh_id = dn.mesh_id and s = dn.vid
        left join recurring.dn o on o.mesh_id = sym.mesh_id and o.boundary_number = dn.boundary_number and o.vid = t where o.d is null or dn.d + weight < o.d group by all)""",
    "ds": """select mesh_id, vid, cast(0 as double) as d from crit where critical_type = 'saddle' union
      (select ds.mesh_id, t as vid, min(ds.d + weight) as d from ds join sym on sym.mesh_id = ds.mesh_id and s = ds.vid
        left join recurring.ds o on o.mesh_id = sym.mesh_id and o.vid = t where o.d is null or ds.d + weight < o.d group by all)""",
}
BLOCKS |= {
    "dv": """select mesh_id, vid, cast(0 as double) as d from v where vid in (0, 105) union
      (select dv.mesh_id, t as vid, min(dv.d + weight) as d from dv join sym on sym.mesh_id = dv.mesh_id and s = dv.vid
        left join recurring.dv o on o.mesh_id = sym.mesh_id and o.vid = t where o.d is null or dv.d + weight < o.d group by all)""",
    "sad": "select mesh_id, vid from crit where critical_type = 'saddle'",
    "dm": """select mesh_id, vid as src, vid, cast(0 as double) as d from (select mesh_id, vid from sad union select mesh_id, vid from sv) union
      (select dm.mesh_id, dm.src, t as vid, min(dm.d + weight) as d from dm join sym on sym.mesh_id = dm.mesh_id and s = dm.vid
        left join recurring.dm o on o.mesh_id = sym.mesh_id and o.src = dm.src and o.vid = t where o.d is null or dm.d + weight < o.d group by all)""",
    "srad": "select dm.mesh_id, dm.src as s, min(d) as radius from dm join sad on sad.mesh_id = dm.mesh_id and sad.vid = dm.src join sv on sv.mesh_id = dm.mesh_id and sv.vid = dm.vid group by all",
    "pullraw": """select dm.mesh_id, dm.vid, dm.src as s, 1 / sinh(greatest(sqrt(greatest(d + radius * radius - radius, 0)), 1e-12)) as w
      from dm join srad on srad.mesh_id = dm.mesh_id and srad.s = dm.src""",
    "pull": "select mesh_id, vid, s, w / (sum(w) over (partition by mesh_id, vid) + 1e-12) as w from pullraw",
    "bent": """select a.mesh_id, a.vid, sv.boundary_side as side, a.src as b, a.d + coalesce((select sum(p.w * r.d) from pull p join dm r on r.mesh_id = p.mesh_id and r.src = p.s and r.vid = a.src where p.mesh_id = a.mesh_id and p.vid = a.vid), 0) as d
      from dm a join sv on sv.mesh_id = a.mesh_id and sv.vid = a.src""",
    "least_": "select mesh_id, vid, min(d) filter (side = 'lower') as lo, min(d) filter (side = 'upper') as up from bent group by all",
    "near_": "select mesh_id, src as s, vid as t from dm where d <= cast(1.8 as double) and exists (select 1 from sad x where x.mesh_id = dm.mesh_id and x.vid = dm.src) and exists (select 1 from sad y where y.mesh_id = dm.mesh_id and y.vid = dm.vid)",
    "grp": """select mesh_id, vid, vid as kept from sad union
      (select near_.mesh_id, near_.t as vid, min(grp.kept) as kept from grp join near_ on near_.mesh_id = grp.mesh_id and near_.s = grp.vid
        join recurring.grp o on o.mesh_id = near_.mesh_id and o.vid = near_.t where grp.kept < o.kept group by all)""",
    "ends": """select mesh_id, layer, fid, round_even(x0, 6) + 0.0 as x, round_even(y0, 6) + 0.0 as y, round_even(z0, 6) + 0.0 as z from seg
      union all select mesh_id, layer, fid, round_even(x1, 6) + 0.0, round_even(y1, 6) + 0.0, round_even(z1, 6) + 0.0 from seg""",
    "beside": "select distinct p.mesh_id, p.layer, p.fid as s, q.fid as t from ends p join ends q using (mesh_id, layer, x, y, z) where p.fid <> q.fid",
    "comp": """select mesh_id, layer, fid, fid as root from seg union
      (select b.mesh_id, b.layer, b.t as fid, min(comp.root) as root from comp join beside b on b.mesh_id = comp.mesh_id and b.layer = comp.layer and b.s = comp.fid
        join recurring.comp o on o.mesh_id = b.mesh_id and o.layer = b.layer and o.fid = b.t where comp.root < o.root group by all)""",
    "part_": "select mesh_id, layer, level, root, count(*) as n, sum(len) as len from comp join seg using (mesh_id, layer, fid) group by all",
    "slice_": "select mesh_id, layer, level, count(*) as component_count, sum(len) as total_length from part_ group by all",
}
BLOCKS["part_of"] = """select mesh_id, vid, vid as label from (select distinct mesh_id, u as vid from e union select distinct mesh_id, w from e) union
      (select o.mesh_id, o.vid, min(part_of.label) as label from part_of join sym on sym.mesh_id = part_of.mesh_id and s = part_of.vid
        join recurring.part_of o on o.mesh_id = sym.mesh_id and o.vid = t where part_of.label < o.label group by all)"""
BLOCKS["ls"] = "select mesh_id, g, list_sort([{'r': ar, 'x': ax, 'y': ay, 'z': az}, {'r': br, 'x': bx, 'y': by_, 'z': bz}, {'r': cr, 'x': cx, 'y': cy, 'z': cz}]) as p from fv join fg using (mesh_id, fid)"
BLOCKS["lq"] = "select mesh_id, g, p[1] as p0, p[2] as p1, p[3] as p2, (p[2].r - p[1].r) / (p[3].r - p[1].r) as t from ls where p[3].r - p[1].r >= 1e-6"
BLOCKS["lp"] = """select mesh_id, g, p0.r as f0, p1.r as f1, p2.r as f2, sqrt((p1.x - p0.x - t * (p2.x - p0.x)) * (p1.x - p0.x - t * (p2.x - p0.x)) + (p1.y - p0.y - t * (p2.y - p0.y)) * (p1.y - p0.y - t * (p2.y - p0.y))
      + (p1.z - p0.z - t * (p2.z - p0.z)) * (p1.z - p0.z - t * (p2.z - p0.z))) as most from lq"""
BLOCKS["li"] = "select mesh_id, g_eff, greatest(1, round_even(1 / least(greatest(cast(0.5 as double) * g_eff, 1e-4), cast(0.2 as double)), 0)) as n from geff"
BLOCKS["alv"] = """select mesh_id, 0 as layer, cast(0 as double) as lv, g_eff, n from li union all
      (select mesh_id, layer + 1, lv + least(least(greatest(0.5 * (1 - lv) / (n - layer) + 0.5 / n / g_eff * case when len > 0 and wlen > 0 then wlen / len else g_eff end, 1e-4), cast(0.2 as double)), 1 - lv), g_eff, n from
        (select alv.mesh_id, layer, lv, alv.g_eff, n, sum(cut) as len, sum(cut * g) as wlen from alv join
          lateral (select g, case when f1 - f0 >= 1e-6 and lv <= f1 then most * (lv - f0) / (f1 - f0) when f2 - f1 >= 1e-6 then most * (f2 - lv) / (f2 - f1) else 0 end as cut
            from lp where lp.mesh_id = alv.mesh_id and lv between f0 and f2) on true where layer < n - 1 group by all))"""
KEYED = {"part_of": "part_of(mesh_id, vid, label) using key (mesh_id, vid)",
    "dv": "dv(mesh_id, vid, d) using key (mesh_id, vid)", "dm": "dm(mesh_id, src, vid, d) using key (mesh_id, src, vid)", "grp": "grp(mesh_id, vid, kept) using key (mesh_id, vid)",
    "comp": "comp(mesh_id, layer, fid, root) using key (mesh_id, layer, fid)", "ds": "ds(mesh_id, vid, d) using key (mesh_id, vid)", "dl": "dl(mesh_id, vid, d) using key (mesh_id, vid)", "du": "du(mesh_id, vid, d) using key (mesh_id, vid)", "dn": "dn(mesh_id, boundary_number, vid, d) using key (mesh_id, boundary_number, vid)"}

#: Blocks that a recursion reads again and again.
MADE_ONCE = {"v", "fv", "fg", "lp", "rv", "el", "rd", "crit", "critf", "bv", "hit", "seg", "vr"}


def sql(text: str) -> str:
    """``text`` with the building blocks that it needs before it."""
    import re

    need: set[str] = set()

    def add(body: str) -> None:
        for name in BLOCKS:
            if name not in need and re.search(rf"\b(?:from|join|,)\s+{name}\b", body):
                need.add(name)
                add(BLOCKS[name])

    add(text)
    parts = [f"{KEYED.get(n, n)} as {'materialized ' if n in MADE_ONCE else ''}({BLOCKS[n]})" for n in BLOCKS if n in need]
    return f"with recursive {', '.join(parts)} {text}" if parts else text


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Rounds columns to 6 digits, zero without a sign: sums come in any order."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


def mesh_of(spark: SparkSession, sf_dir: str) -> Mesh:
    return tubes(spark, sf_dir)


def zr(m: Mesh) -> DataFrame:
    return fields.normalized(fields.coordinate(m))


CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, text: str | None = None) -> Callable[[Callable[[Mesh], DataFrame]], Callable]:
    def add(f: Callable[[Mesh], DataFrame]) -> Callable:
        CATALOG[name] = (lambda spark, sf_dir: f(mesh_of(spark, sf_dir)), sql(text) if text else None)
        return f

    return add


#: Levels that pass no vertex of the gentle tubes, whose contours are simple curves: on the rough ones, contours touch at vertices and SQL can't follow the walk there.
GENTLE = [0.26, 0.47, 0.73]


def gentle(name: str, text: str) -> Callable[[Callable[[Mesh], DataFrame]], Callable]:
    """Like ``query``, over tubes of small amplitude and ``GENTLE`` levels."""

    def add(f: Callable[[Mesh], DataFrame]) -> Callable:
        said = sql(text)
        for old, new in (("+ cast(0.3 as double)", "+ cast(0.05 as double)"), ("(0, cast(0.25 as double))", "(0, cast(0.26 as double))"), ("(2, cast(0.75 as double))", "(2, cast(0.73 as double))")):
            assert old in said, old
            said = said.replace(old, new)
        CATALOG[name] = (lambda spark, sf_dir: f(tubes(spark, sf_dir, amp=0.05)), said)
        return f

    return add


query("mesh_vertices", "select mesh_id, vid, x, y, round(z, 6) as z from v")(lambda m: r6(m.vertices, "z"))
query("mesh_faces", "select mesh_id, fid, a, b, c from f")(lambda m: m.faces)
query("edge_incidence", "select mesh_id, u, w as v, n_faces from e")(lambda m: topology.edges(m.faces))
query("boundary_edges", "select mesh_id, u, w as v from be")(lambda m: topology.boundary_edges(m.faces))
query("boundary_vertices", "select mesh_id, vid from bv")(lambda m: topology.boundary_vertices(m.faces))
query("boundary_loops", "select mesh_id, vid, boundary_number from loop")(lambda m: topology.boundary_loops(m))
query("mesh_components", "select mesh_id, vid, label from part_of")(lambda m: topology.component_labels(topology.edges(m.faces), huge=True))
query("boundary_loops_huge", "select mesh_id, vid, boundary_number from loop")(lambda m: topology.boundary_loops(m, huge=True))
query("loop_metadata", "select mesh_id, boundary_number, n_vertices, round(cx, 6) as cx, round(cy, 6) as cy, round(cz, 6) as cz from meta")(lambda m: r6(topology.loop_metadata(m, topology.boundary_loops(m)), "cx", "cy", "cz"))
query("loop_sides", "select mesh_id, boundary_number, boundary_side from side")(lambda m: topology.loop_sides(topology.loop_metadata(m, topology.boundary_loops(m))))
query("side_vertices", "select mesh_id, vid, boundary_number, boundary_side from sv")(lambda m: topology.side_vertices(m))
query("unique_edge_lengths", "select mesh_id, u, w as v, round(weight, 6) as weight from el")(lambda m: r6(topology.weighted_edges(m).select("mesh_id", "u", "v", "weight"), "weight"))
query("median_edge_length", "select mesh_id, round(median(weight), 6) as median_edge from el group by all")(lambda m: r6(topology.median_edge(m), "median_edge"))
query("adjacency", "select mesh_id, s as vid, count(*) as degree, round(sum(weight), 6) as total from sym group by all")(lambda m: r6(topology.both_ways(topology.weighted_edges(m)).groupBy("mesh_id", F.col("u").alias("vid")).agg(F.count("*").alias("degree"), F.sum("weight").alias("total")), "total"))
query("euler_characteristic", """select mesh_id, n_vertices, n_edges, n_faces, n_vertices - n_edges + n_faces as chi from (select mesh_id, count(*) as n_vertices from v group by all)
  join (select mesh_id, count(*) as n_edges from e group by all) using (mesh_id) join (select mesh_id, count(*) as n_faces from f group by all) using (mesh_id)""")(lambda m: topology.euler(m))
query("graph_edges_by_side", """select mesh_id, u, w as v, case when n_faces = 1 and p.boundary_number = q.boundary_number then 'boundary' else 'interior' end as edge_type,
  case when n_faces = 1 and p.boundary_number = q.boundary_number then p.boundary_side end as boundary_side from e left join sv p on p.mesh_id = e.mesh_id and p.vid = e.u left join sv q on q.mesh_id = e.mesh_id and q.vid = e.w""".replace("select mesh_id, u", "select e.mesh_id, u"))(lambda m: topology.labelled_edges(m).select("mesh_id", "u", "v", "edge_type", "boundary_side"))
query("bbox", "select mesh_id, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, round(min(z), 6) as min_z, round(max(z), 6) as max_z from v group by all")(lambda m: r6(fields.bounding_box(m), "min_z", "max_z"))
query("field_stats", "select mesh_id, round(min(z), 6) as min, round(max(z), 6) as max, round(avg(z), 6) as mean, round(stddev_pop(z), 6) as std, round(max(z) - min(z), 6) as range from v group by all")(lambda m: r6(fields.field_stats(fields.coordinate(m)), "min", "max", "mean", "std", "range"))
for _axis in "xyz":
    query(f"axis_distance_{_axis}", f"select mesh_id, vid, round({_axis} - min({_axis}) over (partition by mesh_id), 6) as value from v")(lambda m, a=_axis: r6(fields.axis_distance(m, a), "value"))
query("planar_field", "select mesh_id, vid, round(z, 6) as value from v")(lambda m: r6(fields.coordinate(m), "value"))
query("normalized_field", "select mesh_id, vid, round(r, 6) as r from r")(lambda m: r6(zr(m), "r"))
query("principal_axis_cov", "select mesh_id, round(covar_samp(x, x), 6) as xx, round(covar_samp(x, y), 6) + 0.0 as xy, round(covar_samp(x, z), 6) + 0.0 as xz, round(covar_samp(y, y), 6) as yy, round(covar_samp(y, z), 6) + 0.0 as yz, round(covar_samp(z, z), 6) as zz from v group by all")(lambda m: r6(fields.covariance(m).drop("n"), "xx", "xy", "xz", "yy", "yz", "zz"))
query("principal_projection")(lambda m: r6(fields.principal_projection(m), "value"))
query("face_grad_norm", "select mesh_id, fid, round(g, 6) as g from fg")(lambda m: r6(fields.face_gradients(m, zr(m)), "g"))
query("effective_gradient", "select mesh_id, round(g_eff, 6) as g_eff from geff")(lambda m: r6(fields.effective_gradient(fields.face_gradients(m, zr(m))), "g_eff"))
query("layer_intervals", """select mesh_id, cast(n as int) as n_intervals, round(step, 6) as step, round(1 / n / g_eff, 6) as h_mod from (select *, greatest(1, round_even(1 / step, 0)) as n from
  (select mesh_id, g_eff, least(greatest(cast(0.5 as double) * g_eff, 1e-4), cast(0.2 as double)) as step from geff))""")(lambda m: r6(fields.layer_intervals(fields.effective_gradient(fields.face_gradients(m, zr(m))), HEIGHT), "step", "h_mod"))
query("iso_segments_planar", "select mesh_id, layer, fid, round(x0, 6) + 0.0 as x0, round(y0, 6) + 0.0 as y0, round(z0, 6) + 0.0 as z0, round(x1, 6) + 0.0 as x1, round(y1, 6) + 0.0 as y1, round(z1, 6) + 0.0 as z1, round(len, 6) as len from seg")(
    lambda m: r6(contour.segments(m, zr(m), LEVELS).select("mesh_id", "layer", "fid", *(F.col(f"p{i}.{c}").alias(f"{c}{i}") for i in (0, 1) for c in "xyz"), "len"), "x0", "y0", "z0", "x1", "y1", "z1", "len"))
query("iso_length_by_level", "select mesh_id, layer, level, count(*) as n_segments, round(sum(len), 6) as len_sum, round(sum(g * len), 6) as wgrad_sum from seg join fg using (mesh_id, fid) group by all")(lambda m: r6(contour.level_sums(contour.segments(m, zr(m), LEVELS)), "len_sum", "wgrad_sum"))
query("layer_numbers", "select mesh_id, layer, level, cast(row_number() over (partition by mesh_id order by level) - 1 as int) as layer_number from (select distinct mesh_id, layer, level from seg)")(
    lambda m: contour.slices(_parts(m), 10).select("mesh_id", "layer", "level", "layer_number"))
query("endpoint_buckets", """select mesh_id, layer, x, y, z, count(*) as n_ends from (select mesh_id, layer, round_even(x0, 6) + 0.0 as x, round_even(y0, 6) + 0.0 as y, round_even(z0, 6) + 0.0 as z from seg
  union all select mesh_id, layer, round_even(x1, 6) + 0.0, round_even(y1, 6) + 0.0, round_even(z1, 6) + 0.0 from seg) group by all""")(lambda m: contour.endpoint_buckets(contour.segments(m, zr(m), LEVELS)).withColumns({c: F.col(c) + F.lit(0.0) for c in "xyz"}))
query("one_ring", "select mesh_id, vid, count(*) as degree, string_agg(cast(n as varchar), ',' order by n) as ring from ring group by all")(lambda m: critical.one_rings(m.faces).select("mesh_id", "vid", F.size("ring").cast("long").alias("degree"), F.array_join(F.col("ring").cast("array<string>"), ",").alias("ring")))
query("link_sign_changes", "select mesh_id, vid, changes, critical_type from critf")(lambda m: critical.critical_points(m, zr(m), 1e-12, adaptive=False).select("mesh_id", "vid", "changes", "critical_type"))
query("critical_planar", "select mesh_id, critical_type, count(*) as n from crit group by all")(lambda m: critical.critical_points(m, zr(m)).groupBy("mesh_id", "critical_type").agg(F.count("*").alias("n")))
query("critical_points", """select mesh_id, vid, changes, critical_type, round(case when signal is null or changes is null then 0 else least(greatest(signal * case when changes = 0 then greatest(0, 1 - spread / (mean + 1e-10))
    when changes = 2 then case when up > 0 and down > 0 then cast(least(up, down) as double) / greatest(up, down) else 0.5 end else 1 / (1 + abs(changes - 4) * cast(0.1 as double)) end / (signal + 1), 0), 1) end, 6) as confidence
  from crit left join (select rd.mesh_id, rd.vid, median(abs(d)) filter (abs(d) > eps) as signal, avg(abs(d)) as mean, stddev_pop(d) as spread, count(*) filter (d > eps) as up, count(*) filter (d < -eps) as down
    from rd join aeps using (mesh_id, vid) where not exists (select 1 from bv where bv.mesh_id = rd.mesh_id and bv.vid = rd.vid) group by all) using (mesh_id, vid)""")(lambda m: r6(critical.critical_points(m, zr(m)), "confidence"))
query("annotated", "select mesh_id, vid, cast(case critical_type when 'minimum' then 0 when 'saddle' then 1 when 'maximum' then 2 else -1 end as int) as morse_index, critical_type from crit")(
    lambda m: critical.annotated(critical.critical_points(m, zr(m))).drop("critical_confidence"))
query("persistent", """select mesh_id, vid, case when gap < cast(0.01 as double) then 'regular' else critical_type end as critical_type from crit left join (select mesh_id, vid,
  least(coalesce(r - lag(r) over w, cast('inf' as double)), coalesce(lead(r) over w - r, cast('inf' as double))) as gap from crit join r using (mesh_id, vid) where critical_type <> 'regular' window w as (partition by mesh_id order by r, vid)) using (mesh_id, vid)""")(
    lambda m: critical.persistent(written(critical.critical_points(m, zr(m)), "critical"), zr(m), 0.01).select("mesh_id", "vid", "critical_type"))
query("morse_check", """select mesh_id, cast(mi as bigint) as n_minimum, cast(sa as bigint) as n_saddle, cast(ma as bigint) as n_maximum, chi, ma - sa + mi as morse, abs(ma - sa + mi - chi) <= 2 as valid from
  (select mesh_id, count(*) filter (critical_type = 'minimum') as mi, count(*) filter (critical_type = 'saddle') as sa, count(*) filter (critical_type = 'maximum') as ma from crit group by all)
  join (select mesh_id, n_vertices - n_edges + n_faces as chi from (select mesh_id, count(*) as n_vertices from v group by all)
  join (select mesh_id, count(*) as n_edges from e group by all) using (mesh_id) join (select mesh_id, count(*) as n_faces from f group by all) using (mesh_id)) using (mesh_id)""")(
    lambda m: critical.morse_check(critical.critical_points(m, zr(m)), topology.euler(m)))
query("adaptive_eps", """select mesh_id, vid, round(greatest(1e-12, least(cast(0.1 as double) * gaps[1 + cast(floor(cast(0.1 as double) * (len(gaps) - 1)) as int)], cast(0.01 as double) * (hi - lo))), 9) as eps from
  (select p.mesh_id, p.vid, list(abs(p.r - q.r) order by abs(p.r - q.r)) as gaps, greatest(max(p.r), max(q.r)) as hi, least(min(p.r), min(q.r)) as lo from rv p join rv q on p.mesh_id = q.mesh_id and p.vid = q.vid and p.n < q.n group by all)""")(
    lambda m: critical.adaptive_eps(m.faces, zr(m)).withColumn("eps", F.round("eps", 9)))
query("local_saliency", "select rv.mesh_id, rv.vid, round(median(abs(p.r - rv.r)), 6) as saliency from rv join r p on p.mesh_id = rv.mesh_id and p.vid = rv.vid group by all")(lambda m: r6(critical.saliency(m.faces, zr(m)), "saliency"))
query("value_gaps", """select mesh_id, vid, critical_type, round(least(coalesce(r - lag(r) over w, cast('inf' as double)), coalesce(lead(r) over w - r, cast('inf' as double))), 6) as value_gap
  from crit join r using (mesh_id, vid) where critical_type <> 'regular' window w as (partition by mesh_id order by r, vid)""")(lambda m: r6(critical.value_gaps(critical.critical_points(m, zr(m)), zr(m)), "value_gap"))
query("laplacian_smooth", """select mesh_id, vid, round(case when bv.vid is not null or mean is null then z else cast(0.5 as double) * z + cast(0.5 as double) * mean end, 6) as value from v
  left join (select mesh_id, s as vid, avg(z) as mean from sym join v on v.mesh_id = sym.mesh_id and v.vid = t group by all) a using (mesh_id, vid) left join bv using (mesh_id, vid)""".replace("select mesh_id, s as vid", "select sym.mesh_id, s as vid"))(
    lambda m: r6(fields.smoothed(fields.coordinate(m), topology.both_ways(topology.weighted_edges(m)), topology.boundary_vertices(m.faces), iterations=1), "value"))


def _arcs(m: Mesh) -> DataFrame:
    return topology.both_ways(topology.weighted_edges(m))


for _side, _block in (("lower", "dl"), ("upper", "du")):
    query(f"geodesic_{_side}", f"select mesh_id, vid, round(d, 6) as value from {_block}")(lambda m, s=_side: r6(geodesic.to_side(m.vertices, _arcs(m), topology.side_vertices(m, s)), "value"))
query("nearest_boundary", """select mesh_id, vid, cast(arg_min(boundary_number, (d, boundary_number)) filter (boundary_side = 'lower') as int) as closest_lower_boundary, round(min(d) filter (boundary_side = 'lower'), 6) as dist_to_lower,
  cast(arg_min(boundary_number, (d, boundary_number)) filter (boundary_side = 'upper') as int) as closest_upper_boundary, round(min(d) filter (boundary_side = 'upper'), 6) as dist_to_upper from dn join side using (mesh_id, boundary_number) group by all""")(
    lambda m: r6(geodesic.nearest_loop(m.vertices, _arcs(m), topology.side_vertices(m)), "dist_to_lower", "dist_to_upper"))
query("between_field", "select mesh_id, vid, round(dl.d / (dl.d + du.d + 2.220446049250313e-16), 6) as value from dl join du using (mesh_id, vid)")(
    lambda m: r6(geodesic.between(*(geodesic.to_side(m.vertices, _arcs(m), topology.side_vertices(m, s)) for s in ("lower", "upper"))), "value"))
query("geodesic_to_vertex", "select mesh_id, cast(0 as int) as source, vid, round(d, 6) as d from dv")(lambda m: r6(geodesic.distances(m.vertices, _arcs(m), m.vertices.where("vid in (0, 105)").select("mesh_id", F.lit(0).alias("source"), "vid")), "d"))


def _saddles(m: Mesh) -> DataFrame:
    return critical.critical_points(m, zr(m)).where("critical_type = 'saddle'")


def _radius(m: Mesh, saddles: DataFrame) -> DataFrame:
    return critical.saddle_radii(m, topology.side_vertices(m), saddles.select("mesh_id", "vid"))


query("saddle_radius", """select mesh_id, vid, round(least(dl.d, du.d), 6) as radius from crit join dl using (mesh_id, vid) join du using (mesh_id, vid) where critical_type = 'saddle'""")(lambda m: r6(_radius(m, _saddles(m)), "radius"))
query("distance_to_saddles", "select mesh_id, vid, round(d, 6) as value from ds")(lambda m: r6(geodesic.to_side(m.vertices, _arcs(m), _saddles(m).select("mesh_id", "vid")), "value"))
query("nearest_nodes", """select mesh_id, pid, vid, round(sqrt(d2), 6) as distance from (select p.mesh_id, p.vid as pid, v.vid, (v.x - p.x - cast(0.3 as double)) * (v.x - p.x - cast(0.3 as double)) + (v.y - p.y + cast(0.2 as double)) * (v.y - p.y + cast(0.2 as double)) + (v.z - p.z - cast(0.1 as double)) * (v.z - p.z - cast(0.1 as double)) as d2,
  row_number() over (partition by p.mesh_id, p.vid order by round((v.x - p.x - cast(0.3 as double)) * (v.x - p.x - cast(0.3 as double)) + (v.y - p.y + cast(0.2 as double)) * (v.y - p.y + cast(0.2 as double)) + (v.z - p.z - cast(0.1 as double)) * (v.z - p.z - cast(0.1 as double)), 9), v.vid) as k
  from v p join v on v.mesh_id = p.mesh_id) where k = 1""")(
    lambda m: r6(_nearest(m, m.vertices), "distance"))


def _nearest(m: Mesh, of: DataFrame) -> DataFrame:
    """Nearest vertices of points beside the vertices ``of``."""
    return geodesic.nearest_nodes(m.vertices, of.select("mesh_id", F.col("vid").alias("pid"), (F.col("x") + 0.3).alias("x"), (F.col("y") - 0.2).alias("y"), (F.col("z") + 0.1).alias("z")))


query("collection_length", "select mesh_id, count(distinct layer) as n_levels, round(sum(len), 6) as total_length from seg group by all")(lambda m: r6(contour.collection_length(contour.segments(m, zr(m), LEVELS)), "total_length"))
query("saddle_clusters_by_confidence")(lambda m: critical.saddle_clusters(m, critical.critical_points(m, zr(m)).where("critical_type = 'saddle'").select("mesh_id", "vid", F.col("confidence").alias("score")), 1.8))
query("saddle_clusters", "select mesh_id, vid, kept from grp")(lambda m: critical.saddle_clusters(m, _saddles(m).select("mesh_id", "vid", F.lit(0.0).alias("score")), 1.8))
query("conforming_field_of_saddles", "select mesh_id, vid, round(up / (up + lo + 1e-9), 6) as value from least_")(
    lambda m: r6(critical.conforming_field(m, topology.side_vertices(m), _saddles(m).select("mesh_id", "vid")), "value"))
query("multi_scale_saddles")(lambda m: critical.multi_scale_saddles(m, fields.coordinate(m), 3, 0.6, 1))
query("conforming_field")(lambda m: r6(METHODS["conformal"](Engine(m)), "value"))
query("nearest_vertex_to_centroid", """select mesh_id, boundary_number, vid, round(sqrt(d2), 6) as distance from (select meta.mesh_id, boundary_number, vid, d2, row_number() over (partition by meta.mesh_id, boundary_number order by round(d2, 9), vid) as k from
  (select meta.mesh_id, boundary_number, v.vid, (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) as d2 from meta join v on v.mesh_id = meta.mesh_id) meta) where k = 1""")(
    lambda m: r6(_near_centroid(m), "distance"))


def _near_centroid(m: Mesh) -> DataFrame:
    meta = topology.loop_metadata(m, topology.boundary_loops(m)).withColumnsRenamed({f"c{c}": f"m{c}" for c in "xyz"})
    return export.nearest_vertex(meta, m, ["mesh_id", "boundary_number"])


def _saddle_points(m: Mesh, saddles: DataFrame) -> DataFrame:
    return saddles.join(m.vertices, ["mesh_id", "vid"]).select("mesh_id", F.col("vid").alias("ord"), "vid", "x", "y", "z")


query("saddle_histogram", """select mesh_id, layer, vid, count(*) as n, round(avg(sqrt(d2)), 6) as mean_distance from (select s.mesh_id, s.layer, s.fid, c.vid, (s.x0 - v.x) * (s.x0 - v.x) + (s.y0 - v.y) * (s.y0 - v.y) + (s.z0 - v.z) * (s.z0 - v.z) as d2,
    row_number() over (partition by s.mesh_id, s.layer, s.fid order by round((s.x0 - v.x) * (s.x0 - v.x) + (s.y0 - v.y) * (s.y0 - v.y) + (s.z0 - v.z) * (s.z0 - v.z), 9), c.vid) as k
    from seg s join crit c on c.mesh_id = s.mesh_id and c.critical_type = 'saddle' join v on v.mesh_id = c.mesh_id and v.vid = c.vid) where k = 1 group by all""")(lambda m: r6(_histogram(m, _saddles(m)), "mean_distance"))


def _histogram(m: Mesh, saddles: DataFrame) -> DataFrame:
    """Each layer's first ends as the points of one component."""
    starts = contour.segments(m, zr(m), LEVELS).groupBy("mesh_id", "layer").agg(F.collect_list("p0").alias("points")).withColumn("component_id", F.lit(0))
    return export.nearest_saddles(starts, _saddle_points(m, saddles)).select("mesh_id", "layer", "vid", "n", "mean_distance")


query("arc_length_cumulative", """select mesh_id, boundary_number, vid, round(sum(step) over (partition by mesh_id, boundary_number order by vid), 6) as along from (select mesh_id, boundary_number, vid,
  coalesce(sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w) + (z - lag(z) over w) * (z - lag(z) over w)), 0) as step from loop join v using (mesh_id, vid) window w as (partition by mesh_id, boundary_number order by vid))""")(
    lambda m: r6(_along(m), "along"))


def _along(m: Mesh) -> DataFrame:
    w = Window.partitionBy("mesh_id", "boundary_number").orderBy("vid")
    step = F.coalesce(F.sqrt(sum((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in "xyz")), F.lit(0.0))
    j = topology.boundary_loops(m).join(m.vertices, ["mesh_id", "vid"]).withColumn("step", step)
    return j.select("mesh_id", "boundary_number", "vid", F.sum("step").over(w).alias("along"))


query("color_index", "select mesh_id, vid, cast(trunc(r * 255) as int) as color from r")(lambda m: zr(m).select("mesh_id", "vid", F.floor(F.col("r") * 255).cast("int").alias("color")))


def _parts(m: Mesh, levels: list[float] | None = None) -> DataFrame:
    return contour.components(contour.segments(m, zr(m), levels or LEVELS), contour.orientation_hints(m, zr(m)))


query("segment_components")(lambda m: _parts(m).select("mesh_id", "layer", "component_id", "is_closed", F.size("points").alias("n_points"), F.round("curve_length", 6).alias("curve_length")))
gentle("segment_components_gentle", "select mesh_id, layer, n + 1 as n_points, closed = 1 as is_closed, round(len, 6) as curve_length from part_ join (select mesh_id, layer, root, min(cast(k = 2 as int)) as closed from (select mesh_id, layer, root, x, y, z, count(*) as k from ends join comp using (mesh_id, layer, fid) group by all) group by all) using (mesh_id, layer, root)")(
    lambda m: r6(_parts(m, GENTLE).select("mesh_id", "layer", F.size("points").cast("long").alias("n_points"), "is_closed", "curve_length"), "curve_length"))
gentle("slice_summary", """select mesh_id, count(*) as total_slices, count(*) filter (component_count > 1) as bifurcation_slices, cast(max(component_count) as int) as max_components,
  array_to_string(list(cast(round(level, 2) as varchar) order by level) filter (component_count > 1), ',') as bifurcation_levels from slice_ group by all""")(
    lambda m: contour.summary(contour.slices(_parts(m, GENTLE), 50)).withColumn("bifurcation_levels", F.nullif(F.array_join(F.transform("bifurcation_levels", lambda x: x.cast("string")), ","), F.lit(""))))
gentle("slice_totals_gentle", "select mesh_id, cast(row_number() over (partition by mesh_id order by level) - 1 as int) as layer_number, cast(component_count as int) as component_count, round(total_length, 6) as total_length from slice_")(
    lambda m: r6(contour.slices(_parts(m, GENTLE), 50).select("mesh_id", "layer_number", "component_count", "total_length"), "total_length"))
query("resampled_curves")(lambda m: contour.slices(_parts(m), 50).select("mesh_id", "layer_number", "component_count", F.round("total_length", 6).alias("total_length"), F.size("curve").alias("n_points"), F.round(contour.polyline_length("curve"), 6).alias("length")))
query("adaptive_levels", """select mesh_id, layer, round(lv, 6) as level from alv union all select mesh_id, layer + 1, 1.0 from (select mesh_id, max(layer) as layer, max(lv) as lv from alv group by all) where lv < 1 - 1e-12""")(
    lambda m: r6(levels.adaptive_levels(m, zr(m), HEIGHT).select("mesh_id", F.posexplode("levels").alias("layer", "level")), "level"))
query("contour_breakpoints", """select mesh_id, round(value, 9) as value, count(*) filter (not last) as n_on, count(*) filter (last) as n_off from (
  select mesh_id, f0 as value, false as last from lp union all select mesh_id, f2, true from lp) group by all""")(lambda m: _breakpoints(m))
def _breakpoints(m: Mesh) -> DataFrame:
    """Where segments of faces begin and end; what a face's middle corner changes adds up to none."""
    faces = fields.corners(m, zr(m)).select("mesh_id", "pa", "pb", "pc", F.lit(1.0).alias("g"))
    b = levels.breakpoints(faces, 1e-6).where("n <> 0").withColumn("value", F.round("value", 9))
    on, off = (F.sum(F.when(F.col("after") == k, F.abs("n")).otherwise(0)) for k in (0, 1))
    return b.groupBy("mesh_id", "value").agg(on.alias("n_on"), off.alias("n_off"))


SLICE = "struct<meta:struct<slice_count:bigint,mesh:struct<vertex_count:bigint,face_count:bigint>>,slices:array<struct<layer_number:int,component_count:int,total_length:double,components:array<struct<length:double>>>>>"
gentle("slices_json", """select mesh_id, count(*) over (partition by mesh_id) as slice_count, n_vertices, n_faces, cast(row_number() over (partition by mesh_id order by level) - 1 as int) as layer_number,
  cast(component_count as int) as component_count, round(total_length, 6) as total_length, round(longest, 6) as longest from slice_
  join (select mesh_id, layer, max(len) as longest from part_ group by all) using (mesh_id, layer)
  join (select mesh_id, count(*) as n_vertices from v group by all) using (mesh_id) join (select mesh_id, count(*) as n_faces from f group by all) using (mesh_id)""")(
    lambda m: r6(
        _documents(m).select("mesh_id", F.from_json("document", SLICE).alias("d"))
        .select("mesh_id", F.col("d.meta.slice_count").alias("slice_count"), F.col("d.meta.mesh.vertex_count").alias("n_vertices"), F.col("d.meta.mesh.face_count").alias("n_faces"), F.explode("d.slices").alias("s"))
        .select("mesh_id", "slice_count", "n_vertices", "n_faces", "s.layer_number", "s.component_count", "s.total_length", F.array_max("s.components.length").alias("longest")), "total_length", "longest"))


def _documents(m: Mesh) -> DataFrame:
    sides = topology.side_vertices(m).select("mesh_id", "vid", "boundary_side", "boundary_number")
    saddles, parts = written(_saddle_points(m, _saddles(m)), "saddles"), written(_parts(m, GENTLE), "parts")
    return export.slice_documents(contour.slices(parts, 50), parts, export.component_topology(parts, m, sides, saddles), saddles, m)


FIELD = "struct<meta:struct<vertex_count:bigint,face_count:bigint,field_statistics:struct<min:double,max:double,mean:double,std:double,`range`:double>,bounding_box:struct<min:array<double>,max:array<double>>>,scalar_field:array<double>,faces:array<array<int>>>"
query("field_json", """select mesh_id, count(*) as n_vertices, any_value(n_faces) as n_faces, round(min(z), 6) as min, round(max(z), 6) as max, round(avg(z), 6) as mean, round(stddev_pop(z), 6) as std, round(max(z) - min(z), 6) as "range",
  max(x) as max_x, count(*) as n_values, round(sum(z * (vid + 1)), 6) as weighted, any_value(corner_sum) as corner_sum from v join (select mesh_id, count(*) as n_faces, cast(sum(a + 2 * b + 3 * c) as bigint) as corner_sum from f group by all) using (mesh_id) group by mesh_id""")(
    lambda m: r6(
        export.field_documents(m, fields.coordinate(m)).select("mesh_id", F.from_json("document", FIELD).alias("d"))
        .select("mesh_id", F.col("d.meta.vertex_count").alias("n_vertices"), F.col("d.meta.face_count").alias("n_faces"), "d.meta.field_statistics.*", F.get("d.meta.bounding_box.max", F.lit(0)).alias("max_x"), F.size("d.scalar_field").cast("long").alias("n_values"),
            F.aggregate(F.transform("d.scalar_field", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x).alias("weighted"),
            F.aggregate(F.transform("d.faces", lambda t: t[0] + 2 * t[1] + 3 * t[2]), F.lit(0).cast("long"), lambda s, x: s + x).alias("corner_sum")), "min", "max", "mean", "std", "range", "weighted"))
query("graphml_edges", """select el.mesh_id, '<edge source="' || el.u || '" target="' || el.w || '"><data key="edge_n_faces">' || n_faces || '</data><data key="edge_edge_type">' ||
  case when n_faces = 1 and p.boundary_number = q.boundary_number then 'boundary' else 'interior' end || '</data></edge>' as line from el
  left join sv p on p.mesh_id = el.mesh_id and p.vid = el.u left join sv q on q.mesh_id = el.mesh_id and q.vid = el.w""")(
    lambda m: export.graphml_lines(m.vertices, topology.labelled_edges(m).select("mesh_id", "u", "v", "n_faces", "edge_type")).where("kind = 1").select("mesh_id", "line"))
query("graphml")(lambda m: export.graphml_lines(m.vertices, topology.labelled_edges(m).drop("n_faces")))
query("edge_traces", """select el.mesh_id, el.u, el.w as v, case when n_faces = 1 and p.boundary_number = q.boundary_number then p.boundary_side else 'internal' end as trace
  from el left join sv p on p.mesh_id = el.mesh_id and p.vid = el.u left join sv q on q.mesh_id = el.mesh_id and q.vid = el.w""")(lambda m: vizprep.edge_traces(m, topology.labelled_edges(m)).select("mesh_id", "u", "v", "trace"))
query("node_colors", """select v.mesh_id, v.vid, cast(case boundary_side when 'lower' then 0 when 'upper' then 1 else 0.5 end as double) as color from v left join sv on sv.mesh_id = v.mesh_id and sv.vid = v.vid""")(lambda m: vizprep.node_colors(m, topology.side_vertices(m)).select("mesh_id", "vid", "color"))
_t = "case when hi - lo <= 1e-8 + 1e-5 * abs(hi) then cast(0 as double) else (z - lo) / (hi - lo) end as t"
_hue = ", ".join(f"cast(floor(least(greatest({reduce(lambda s, c: f'({s}) * t + cast({c} as double)', reversed(k), 'cast(0 as double)')}, 0), 1) * 255) as int) as {n}" for k, n in zip(vizprep.TURBO, ("red", "green", "blue"), strict=True))
query("colored_vertices", f"select mesh_id, vid, {_hue}, cast(255 as int) as alpha from (select mesh_id, vid, {_t} from v join zr using (mesh_id)) t")(lambda m: vizprep.colored(fields.coordinate(m)))
for _side, _block in (("lower", "dl"), ("upper", "du")):
    query(f"{_side}_view", f"select mesh_id, vid, x, y, round(z, 6) as z, round(d, 6) as value from v join {_block} using (mesh_id, vid)")(lambda m, s=_side: r6(vizprep.side_view(m, _arcs(m), topology.side_vertices(m), s), "z", "value"))
query("saddles_view", "select mesh_id, vid, x, y, round(z, 6) as z, round(d, 6) as value from v join ds using (mesh_id, vid)")(lambda m: r6(vizprep.saddles_view(m, _arcs(m), critical.critical_points(m, zr(m))), "z", "value"))
query("scaled_field", "select mesh_id, vid, round(case when hi - lo < 1e-12 then 0 else (z - lo) / (hi - lo) end, 6) as value from v join zr using (mesh_id)")(lambda m: r6(vizprep.scaled_field(fields.coordinate(m)), "value"))
query("slice_lines")(lambda m: vizprep.slice_lines(_parts(m), contour.slices(_parts(m), 50)))
for _name in sorted(METHODS):
    query(f"method_{_name}")(lambda m, k=_name: Engine(m, {"iso_slices": {"samples": 50}}).run(k, HEIGHT * 10).slices.select("mesh_id", "layer_number", F.round("level", 6).alias("level"), "component_count", F.round("total_length", 6).alias("total_length")))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in CATALOG.items() if text}
