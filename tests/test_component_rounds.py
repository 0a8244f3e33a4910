"""The driver holds a plan for every step of the component search; none may read the edges dozens of times."""

import numpy as np

from tidelens.operators import graph


def test_steps_of_a_round_have_small_plans(spark, monkeypatch):
    reads, cut = [], graph.durable

    def counted(df):
        reads.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return cut(df)

    monkeypatch.setattr(graph, "durable", counted)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(20)] + [(200, i) for i in range(201, 215)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}
    assert len(reads) > 2 and max(reads) <= 14
