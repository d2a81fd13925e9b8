"""Broadcasts are chosen by measured sizes: what Spark estimates from compressed files says little of the tables made of them."""

import pytest

from talweg.functions.session import by_measure
from talweg.operators import critical, fields, geodesic
from talweg.sources.tubes import tubes

STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def test_no_estimate_plans_a_broadcast(spark):
    s = spark.newSession()
    m = tubes(s, "/root/testdata/sf0.001")
    found = critical.critical_points(m, fields.normalized(fields.coordinate(m)))
    near = geodesic.nearest_nodes(m.vertices, m.vertices.withColumnRenamed("vid", "pid"))
    for df in (found, critical.value_gaps(found, fields.normalized(fields.coordinate(m))), near):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Join" in plan or df is near
        assert "Broadcast" not in plan
    assert s.conf.get(STATIC) == "-1" and s.conf.get(MEASURED) == spark.sparkContext.getConf().get(STATIC, "10485760b")


@pytest.mark.parametrize(("static", "measured", "want"), [("256k", None, "256k"), ("256k", "1m", "1m"), ("-1", None, None)])
def test_a_sessions_own_bound_holds_for_measured_sizes(spark, static, measured, want):
    s = spark.newSession()
    s.conf.set(STATIC, static)
    if measured:
        s.conf.set(MEASURED, measured)
    for _ in range(2):
        by_measure(s)
    assert s.conf.get(STATIC) == "-1" and s.conf.get(MEASURED, None) == want
