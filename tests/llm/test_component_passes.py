"""Components take few passes, as each is some jobs whose tasks the driver keeps account of; results are the same."""

import random

import pytest

from spindrift.llm import components
from spindrift.llm.common import Scratch


@pytest.fixture
def written(monkeypatch):
    """Names of the tables that are written."""
    names = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, name, df, *a: names.append(name) or keep(self, name, df, *a))
    return names


def _least(edges):
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in parent}


def _found(spark, edges):
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


def test_stars_take_no_round(spark, written):
    edges = [(i, 0) for i in range(1, 50)] + [(100, 200), (100, 300)]
    assert _found(spark, edges) == _least(edges)
    assert written == ["edges0"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(45)) if a != b]
    assert _found(spark, edges) == _least(edges)


def test_round_after_the_last_is_not_run(spark, written):
    """A triangle is a star after one round."""
    assert _found(spark, [(1, 2), (2, 3), (1, 3)]) == {1: 1, 2: 1, 3: 1}
    assert written == ["edges0", "large1", "edges1"]
