"""Every catalog query with SQL gives what DuckDB gives; the others run and have rows."""

import duckdb
import pytest

from talweg.plans import catalog

SF = "/root/testdata/sf0.001"
#: The one mesh of the smallest tables has no saddle that two scales find; the ten of these have.
MORE = {"multi_scale_saddles": "/root/testdata/sf0.01"}


def plain(frame):
    cols = sorted(frame.columns)
    return [tuple(None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (float, int)) or hasattr(v, "dtype") else str(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False)], cols


@pytest.mark.parametrize("name", [n for n, (_, text) in catalog.CATALOG.items() if text])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{SF}/part.parquet'")
    query, text = catalog.CATALOG[name]
    key = lambda rows: [tuple(map(str, r)) for r in rows]
    (got, cols), (want, names) = plain(query(spark, SF).toPandas()), plain(con.sql(text).df())
    assert cols == names
    assert sorted(key(got)) == sorted(key(want))


@pytest.mark.parametrize("name", [n for n, (_, text) in catalog.CATALOG.items() if not text])
def test_has_rows(spark, name):
    assert catalog.CATALOG[name][0](spark, MORE.get(name, SF)).count() > 0
