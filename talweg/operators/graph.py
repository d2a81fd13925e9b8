"""Connected components of any number of links in a logarithmic number of rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.session import discard, ship, written

#: Links that one task ties to stars before the rounds.
PART = 250_000


def _arcs(links: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return links.select(F.explode(ends).alias("x")).select("x.*")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars round the least node of each component that they make on their own (union-find)."""
    up: dict = {}
    kind = None

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if kind is not None:
        leaves = [x for x in up if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(leaves, kind), pa.array([up[x] for x in leaves], kind)], ["a", "b"])


def _hung(arcs: DataFrame) -> DataFrame:
    """Every ``b`` of arcs ``a, b``, and ``a`` itself, tied to the least of them all: ``a, b`` with b the lesser, each pair once."""
    least = arcs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    far = arcs.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return far.unionByName(least.where("a <> least").select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, part: int = PART) -> DataFrame:
    """``node, root`` of undirected links ``a, b``: the least node of each component, for every node that has a link to another one.

    Nodes are numbers, texts or bytes. First each task ties its own links, about ``part`` of them, to stars (0: this is left out). Then, in each round, nodes tie their larger neighbours to their least one,
    then nodes tie their lesser neighbours to the least of these; components end as stars round their least
    nodes. A path of n nodes takes about log2 n rounds however it is numbered, a star two. Rounds are
    written tables of at most as many rows as there are links or nodes; the one before is deleted. Counts and minima meet in maps first
    and joins read written tables, so a node of very many links is split over tasks.
    """
    spark = links.sparkSession
    ship(spark)
    given = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = given
    if part:
        now = written(given.coalesce(max(1, -(-given.count() // part))).mapInArrow(_stars, given.schema), "stars")
        discard(given)
    while True:
        # a star's centre is no leaf, and a leaf has one centre
        seen = now.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("n"), F.lit(0).alias("leaf")))).alias("x")).groupBy("x.n").agg(F.sum("x.leaf").alias("leaf"), F.min("x.leaf").alias("only"))
        if seen.where("leaf > 1 or (leaf = 1 and only = 0)").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        arcs = _arcs(now)
        least = arcs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = arcs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        wide = written(large, "large")
        discard(now)
        now = written(_hung(wide), "small")
        discard(wide)
