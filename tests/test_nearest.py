"""Nearest sites against all pairs: inside, outside and far from the sites' box, ties, copies and few sites."""

import math
import random

import pytest

from talweg.operators.nearest import nearest


@pytest.mark.parametrize("n", [1, 3, 400])
def test_nearest(spark, n):
    rng = random.Random(n)
    sites = [(k % 2, i, *(rng.choice([rng.random() * 10, float(rng.randrange(4))]) for _ in "xyz")) for k in range(2) for i in range(n)]
    sites += [(m, i + 5000, x, y, z) for m, i, x, y, z in sites[:5]] + [(0, 9000, 1000.0, 0.0, 0.0)]
    points = [(k % 3, k, *(rng.choice([rng.random() * 12 - 1, float(rng.randrange(-1, 5)), rng.choice([1e4, -500.0, 300.0])]) for _ in "xyz")) for k in range(300)]
    got = nearest(spark.createDataFrame(points, "mesh_id int, pid int, px double, py double, pz double"), spark.createDataFrame(sites, "mesh_id int, site int, x double, y double, z double"), ["pid"]).collect()
    want = {}
    for m, p, *at in points:
        if near := min(((sum((a - b) * (a - b) for a, b in zip(at, xyz, strict=True)), i) for k, i, *xyz in sites if k == m), default=None):
            want[m, p] = near[1], near[0]
    assert {(r["mesh_id"], r["pid"]): r["site"] for r in got} == {k: v[0] for k, v in want.items()}
    assert all(math.isclose(r["d2"], want[r["mesh_id"], r["pid"]][1], rel_tol=1e-12) for r in got) and len(got) == len(want)
