"""Components, orders and levels make few passes over all edges, with the same results."""

import random

import pytest

import __spark_entry__ as entry
from spindrift.operators import graph

D = "/root/testdata/sf0.001"


def _strong(edges):
    after = {}
    for s, t in edges:
        after.setdefault(s, set()).add(t)
        after.setdefault(t, set())
    reach = {}
    for n in after:
        seen, stack = {n}, [n]
        while stack:
            for m in after[stack.pop()] - seen:
                seen.add(m)
                stack.append(m)
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in after}


def test_components_where_trimming_stops_early(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", 0)
    rnd = random.Random(1)
    edges = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(40)]
    found = graph.strong_components(spark.createDataFrame(edges, "src long, dst long").coalesce(1)).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == _strong(edges)


@pytest.mark.parametrize("name", ["grf_02_cycle_breaking", "grf_03_topological_levels", "grf_04_dependency_first_order"])
def test_call_table_is_built_once(spark, name):
    """The tables are read to build the calls, and what follows reads these."""
    reads = []
    parquet = type(spark.read).parquet
    type(spark.read).parquet = lambda self, *paths, **options: reads.extend(p for p in paths if p.endswith("lineitem.parquet")) or parquet(self, *paths, **options)
    try:
        out = entry.queries()[name](spark, D)
    finally:
        type(spark.read).parquet = parquet
    assert len(reads) == 1
    assert "lineitem" not in out._jdf.queryExecution().toString()
