import random

from tessera.llm.graph import connected_components


def brute(edges):
    to = {}

    def find(x):
        to.setdefault(x, x)
        while to[x] != x:
            x = to[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return {x: find(x) for x in to}


def test_as_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5)]
    rng.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = brute([e for e in edges if e[0] != e[1]])
    assert {r.id: r.component for r in got} == want and len(got) == len(want)


def test_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
