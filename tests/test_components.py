"""Components against a plain union-find, with hubs."""

import random

from tracewell.operators import components as module


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(module, "HUB_EDGES", 5)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, 401 + i) for i in range(60)] + [(500 + i, 599) for i in range(40)] + [(i, i + 1) for i in range(700, 760)] + [(7, 7)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    for kind, turn in (("long", int), ("string", "{:05d}".format)):
        df = spark.createDataFrame([(turn(a), turn(b)) for a, b in edges], f"u {kind}, v {kind}")
        assert {r.node: r.root for r in module.components(df).collect()} == {turn(n): turn(find(n)) for n in root}
    assert module.components(df.limit(0)).count() == 0
