import random

from worksignal.llm.components import components


def brute(edges):
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def test_components(frame):
    random.seed(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 400)]
    edges += [(random.randrange(1000, 1200), random.randrange(1000, 1200)) for _ in range(120)]
    edges += [(5, 5), (2, 1), (1, 2), (2, 1), (None, 3), (3, None)]
    got = components(frame(edges, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == brute(edges)
    assert components(frame([(1, 1)], "a long, b long")).count() == 0
