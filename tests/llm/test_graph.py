import random

from spanforge.llm.graph import connected_components


def test_matches_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(60)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)] + [(7, 7), (3, 2), (3, 2)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(tuple(r) for r in got) == sorted((n, find(n)) for n in linked)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
