"""Connected components against union-find, with the bounded last task and with rounds alone."""

import random

import pytest

from chatloom.llm.components import components

RANDOM = random.Random(1)
WALK = RANDOM.sample(range(10**9), 300)
GRAPHS = {
    "star around the least": [(i, 1) for i in range(2, 500)],
    "star around the largest": [(i, 999) for i in range(1, 500)],
    "path": list(zip(WALK, WALK[1:])),
    "random": [(RANDOM.randrange(400), RANDOM.randrange(400)) for _ in range(300)],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3)],
    "empty": [],
}


def plain(edges: list[tuple[int, int]]) -> set[frozenset[int]]:
    group = {}
    for a, b in edges:
        if a != b:
            both = group.get(a, {a}) | group.get(b, {b})
            group |= dict.fromkeys(both, both)
    return {frozenset(x) for x in group.values()}


@pytest.mark.parametrize("few", [0, 40, 1 << 16])
@pytest.mark.parametrize("graph", GRAPHS)
def test_components(spark, graph, few):
    rows = components(spark.createDataFrame(GRAPHS[graph], "a long, b long"), few).collect()
    found = {}
    for r in rows:
        found.setdefault(r["root"], set()).add(r["node"])
    assert len(rows) == len({r["node"] for r in rows})
    assert {frozenset(x) for x in found.values()} == plain(GRAPHS[graph])
