"""What several steps read is computed once: counted as rows that pass."""

import pytest

from talweg.operators import critical, topology
from talweg.plans import catalog
from talweg.sources.tubes import Mesh, tubes


@pytest.fixture
def counted(spark):
    def make(df):
        n = spark.sparkContext.accumulator(0)

        def f(batches):
            for b in batches:
                n.add(len(b))
                yield b

        return df.mapInPandas(f, df.schema), n

    return make


def test_conforming_field_computes_edges_sides_and_saddles_once(spark, counted):
    m = tubes(spark, "/root/testdata/sf0.001")
    given = m.faces, topology.side_vertices(m), m.vertices.where("vid in (44, 105)").select("mesh_id", "vid")
    (faces, n_faces), (sided, n_sided), (saddles, n_saddles) = (counted(df) for df in given)
    got = critical.conforming_field(Mesh(m.vertices, faces), sided, saddles)
    assert got.count() == m.vertices.count()
    assert (n_faces.value, n_sided.value, n_saddles.value) == tuple(df.count() for df in given)


def test_documents_compute_saddles_once(spark, counted, monkeypatch):
    m = tubes(spark, "/root/testdata/sf0.001", amp=0.05)
    given = m.vertices.where("vid in (44, 105)").select("mesh_id", "vid")
    saddles, n = counted(given)
    monkeypatch.setattr(catalog, "_saddles", lambda _: saddles)
    docs = catalog._documents(m)
    assert docs.count() == m.vertices.select("mesh_id").distinct().count()
    assert '"saddles":[{"index":44' in docs.first()["document"]
    assert n.value == given.count()
