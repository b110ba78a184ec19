"""Strongly connected components and cycles against brute force on random graphs."""

import random

import pytest

from lodestone.operators import graph


def reach(pairs):
    out = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    grown = True
    while grown:
        grown = False
        for seen in out.values():
            more = {c for b in seen for c in out.get(b, ())} - seen
            if more:
                seen |= more
                grown = True
    return out


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 30, 34), (2, 24, 60), (3, 40, 44), (4, 6, 12)])
def test_brute_force(spark, seed, n, m):
    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(100 + i, 101 + i) for i in range(5)}
    edges = spark.createDataFrame(sorted(pairs) + sorted(pairs)[:3], "src long, dst long")
    got = reach(pairs)
    same = {a: {b for b in got.get(a, ()) if a in got.get(b, ())} | {a} for a in {x for p in pairs for x in p}}
    want = {(a, min(s), len(s)) for a, s in same.items() if len(s) > 1}
    assert {tuple(x) for x in graph.components(edges).collect()} == want
    cycles, out = set(), {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    stack = [(a,) for a in out]
    while stack:
        path = stack.pop()
        for b in out.get(path[-1], ()):
            if b == path[0]:
                cycles.add(path)
            elif b > path[0] and b not in path and len(path) < 6:
                stack.append((*path, b))
    assert {tuple(x["cycle"]) for x in graph.cycles(edges, 6).collect()} == cycles


def test_none(spark):
    assert graph.components(spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "src long, dst long")).collect() == []
    assert graph.components(spark.createDataFrame([], "src long, dst long")).collect() == []
