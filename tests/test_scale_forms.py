"""Operators whose work must not grow with a diameter, a hot key or what is left out."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph, substrings
from spindrift.sources import scan


@pytest.fixture
def kept(monkeypatch):
    """The number of tables that loops write."""
    n = [0]
    keep = graph.Rounds.keep

    def counted(self, df, name=None):
        n[0] += 1
        return keep(self, df, name)

    monkeypatch.setattr(graph.Rounds, "keep", counted)
    return n


def test_components_of_a_chain_of_10000(spark, kept):
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "src long, dst long")
    found = graph.weak_components(edges)
    assert found.count() == 10_000 and [r[0] for r in found.select("component").distinct().collect()] == [0]
    assert kept[0] <= 60


def test_levels_of_a_chain_of_10000(spark, kept):
    edges = spark.range(9_999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(5, 20_000), (20_000, 9_000), (30_000, 9_999)], "src long, dst long"))
    levels = {r["node"]: r["level"] for r in graph.topological_levels(edges).collect()}
    assert levels[0] == 0 and all(levels[k] == k for k in range(10_000)) and levels[20_000] == 6 and levels[30_000] == 0
    assert kept[0] <= 40


def _levels(edges):
    nodes = {n for e in edges for n in e}
    level = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in edges:
            level[b] = max(level[b], level[a] + 1)
    return level


@pytest.mark.parametrize("seed", range(4))
def test_levels_against_relaxation(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(45)) if a < b} | {(k, k + 1) for k in range(50, 58)}
    df = spark.createDataFrame(sorted(edges) * 2, "src long, dst long")
    assert {r["node"]: r["level"] for r in graph.topological_levels(df).collect()} == _levels(edges)


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 1)], [(1, 1)], [(1, 2), (2, 3), (3, 2), (3, 4)], [(k, (k + 1) % 50) for k in range(50)]])
def test_levels_of_a_cycle_raise(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(spark.createDataFrame(edges, "src long, dst long")).count()


def test_weak_components_with_self_edges(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 9), (7, 8), (8, 7)], "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.weak_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 9, 7: 7, 8: 7}


def test_dependencies_come_first(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(70)})
    df = spark.createDataFrame(edges, "src long, dst long")
    of = graph.strong_components(df)
    place = {r["node"]: r["position"] for r in graph.dependency_order(df, of).collect()}
    part = {r["node"]: r["component"] for r in of.collect()}
    assert sorted(place.values()) == list(range(1, len(place) + 1))
    assert all(place[b] < place[a] for a, b in edges if part[a] != part[b])


def test_unheld_references(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(400)] + ["self.get_value", "Straße.weg", None]
    refs = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 7))) for _ in range(300)] + ["get_", "raße", "none", "aß.", None, "ab"]
    got = {r["ref"] for r in substrings.unheld(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {r for r in refs if r and len(r) >= 3 and not any(n and r in n for n in names)}


def test_names_with_the_same_start_are_not_one_key(spark, monkeypatch):
    """A hundred thousand names share their first characters; each reference meets few of them."""
    names = spark.range(100_000).select(F.format_string("self.field_%06d", "id").alias("name"))
    refs = spark.createDataFrame([(f"self.field_{k:06d}",) for k in range(0, 100_000, 7001)] + [("self.field_x",), ("d_0999",)], "ref string")
    wanted, met = substrings.meeting(refs, names)
    pairs = wanted.join(met, ["gram", "part"]).groupBy("ref").count()
    assert pairs.agg(F.max("count")).first()[0] < 5_000
    assert {r["ref"] for r in substrings.unheld(refs, names).collect()} == {"self.field_x"}
    monkeypatch.setattr(substrings, "PART", 300)
    wanted, met = substrings.meeting(spark.createDataFrame([("self.field_",)], "ref string"), names)
    assert met.groupBy("gram", "part").count().agg(F.max("count")).first()[0] < 600 and wanted.count() > 300


def test_a_scan_opens_only_what_it_takes(spark, tmp_path):
    for name, size in (("a b+c%20.py", 20), ("__pycache__/m.py", 1000), ("lib/x.jar", 1000), ("src/ü.py", 30), ("m.pyc", 5000)):
        path = tmp_path / "root dir" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, 50)
    try:
        found = scan.scan(spark, str(tmp_path / "root dir"))
        assert sorted((r["path"], r["size"], len(r["content"])) for r in found.collect()) == [("a b+c%20.py", 20, 20), ("src/ü.py", 30, 30)]
        with pytest.raises(Exception, match="(?i)max|length"):
            scan.scan(spark, str(tmp_path / "root dir"), include=["*.py"], exclude=[]).unionByName(scan.scan(spark, str(tmp_path), include=["*.jar", "*.txt"])).unionByName(_big(spark, tmp_path)).collect()
    finally:
        spark.conf.unset(key)


def _big(spark, tmp_path):
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "big.py").write_bytes(b"x" * 100)
    return scan.scan(spark, str(tmp_path / "big"))


def _strong(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", range(6))
def test_strong_components_with_runs_and_rings(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(rng.randrange(4, 22))}
    fresh = 100
    for a, b in sorted(edges)[::2]:  # runs of nodes with one edge in and one out, in place of some edges
        edges.discard((a, b))
        way = [a, *range(fresh, fresh + rng.randrange(1, 6)), b]
        fresh += 10
        edges |= set(zip(way, way[1:], strict=False))
    edges |= {(500, 501), (501, 502), (502, 500), (600, 601), (601, 600), (700, 701), (701, 702)}
    df = spark.createDataFrame(sorted(edges) * 2, "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.strong_components(df).collect()} == _strong(edges)


@pytest.mark.parametrize("ring", [False, True])
def test_strong_components_of_10000_in_a_row(spark, kept, ring):
    n = 10_000
    edges = spark.range(n if ring else n - 1).select(((F.col("id") * 7) % n).alias("src"), (((F.col("id") + 1) * 7) % n).alias("dst"))
    found = graph.strong_components(edges)
    assert found.count() == n and found.select("component").distinct().count() == (1 if ring else n)
    assert kept[0] <= 60
