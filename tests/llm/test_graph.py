import random

from tabkit.llm.graph import components
from tabkit.llm.staging import Scratch


def test_components_of_paths_stars_and_random_edges(spark):
    random.seed(5)
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(1, None), (None, 1), (9, 9)]
    edges += [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(70)] * 2
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in components(df, Scratch(spark, "test")).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
