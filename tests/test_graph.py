"""Components: least nodes, any type, few rounds however a path is numbered."""

import math
import random

import pandas as pd
import pytest

from talweg.operators import graph


def by_hand(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in up}


@pytest.mark.parametrize("part", [0, 50, 250_000])
def test_components_of_random_links(spark, part):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    links = [x for x in links if x[0] != x[1]]
    got = graph.components(spark.createDataFrame(links + links[:5], "a long, b long"), part).collect()
    assert {tuple(r) for r in got} == by_hand(links) and len(got) == len(by_hand(links))


def test_components_of_texts_bytes_and_nothing(spark):
    rows = [("a", "b"), ("x", "x"), ("c", "b"), (None, "q"), ("e", "d")]
    got = {tuple(r) for r in graph.components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    got = {tuple(map(bytes, r)) for r in graph.components(spark.createDataFrame([(b"\xff", b"\x01")], "a binary, b binary")).collect()}
    assert got == {(b"\xff", b"\x01"), (b"\x01", b"\x01")}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shuffled", [True, False])
def test_rounds_of_a_path(spark, monkeypatch, shuffled):
    n, made, write = 1000, [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, what: made.append(what) or write(df, what))
    nodes = list(range(n))
    if shuffled:
        random.Random(1).shuffle(nodes)
    got = graph.components(spark.createDataFrame(pd.DataFrame({"a": nodes[:-1], "b": nodes[1:]})), part=0)
    assert got.groupBy("root").count().collect() == [(0, n)]
    assert made.count("small") < 2 * math.log2(n)
