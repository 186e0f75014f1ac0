import random

import pytest

from ledgerlens.llm import graph
from ledgerlens.llm.graph import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("together", [7, graph.TOGETHER])
def test_parts_and_rounds(spark, monkeypatch, together):
    monkeypatch.setattr(graph, "TOGETHER", together)
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(k + 1, k) for k in range(100, 130)]
    found = components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == brute(edges)


def test_edges_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for part in batches:
            seen.add(len(part))
            yield part

    edges = spark.range(1, 51, 1, 2).selectExpr("id AS u", "id - id % 5 AS v").mapInPandas(told, "u long, v long")
    assert components(edges).count() == 51  # and 0
    assert seen.value == 50


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges += [(100 + k, 101 + k) for k in range(20)] + [(200, k) for k in range(201, 230)]
    edges += [(300, 300), (1, 1), edges[0], (None, 5), (6, None)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
