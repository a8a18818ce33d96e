"""Pruned search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import vectors
from spindrift.operators.retrieval import vector_join


def _rows(n, dim, clusters, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, dim)) * 4
    return [(int(k), [float(x) for x in (middles[k % clusters] + rng.normal(size=dim)).astype(np.float32)]) for k in range(n)]


def _brute(rows, queries, k):
    whole = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and None not in v]
    out = set()
    for q, v in queries:
        scored = sorted((-float(np.dot(np.array(v, np.float64), x)), i) for i, x in whole)
        out |= {(q, i, rank) for rank, (_, i) in enumerate(scored[:k], 1)}
    return out


SCHEMA = "id long, embedding array<float>"


@pytest.mark.parametrize(("n", "clusters", "k"), [(900, 12, 5), (40, 1, 7), (3, 1, 8)])
def test_equal_to_all_products(spark, n, clusters, k):
    rows = _rows(n, 10, clusters)
    rows += [(n + 1, None), (n + 2, [1.0] * 9 + [None])]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    queries = table.where("id % 7 = 0 AND embedding IS NOT NULL")
    index = vectors.VectorIndex.build(table, "id", "embedding")
    got = {(r["query"], r["id"], r["rank"]) for r in index.join(queries, "id", "embedding", k).collect()}
    assert got == _brute(rows, [r for r in rows if r[0] % 7 == 0 and r[1] is not None and None not in r[1]], k)
    if clusters > 1:
        assert sum(a for a, _ in index.read) < 0.6 * index.read[0][1]  # most pairs of query and centre are never read


def test_hot_vectors_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rows = [(k, [1.0, 0.0]) for k in range(700)] + [(1000 + k, [float(k), 1.0]) for k in range(30)]
    table = spark.createDataFrame(rows, SCHEMA)
    index = vectors.VectorIndex.build(table, "id", "embedding", 4)
    got = {(r["query"], r["id"], r["rank"]) for r in index.join(table.where("id < 120 OR id > 1025"), "id", "embedding", 3).collect()}
    assert got == _brute(rows, [r for r in rows if r[0] < 120 or r[0] > 1025], 3)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(_rows(5, 3, 1), SCHEMA)
    assert vector_join(empty, some, "id", "embedding", 2).collect() == []
    assert vector_join(some, empty, "id", "embedding", 2).collect() == []


def test_all_of_the_smallest_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    index = vectors.VectorIndex.build(e, "vec_id", "embedding")
    got = {(r["query"], r["vec_id"], r["rank"]) for r in index.join(e, "vec_id", "embedding", 4).collect()}
    assert got == _brute(rows, rows, 4)
    assert index.join(e.where(F.col("vec_id") < 3), "vec_id", "embedding", 4).columns == ["query", "vec_id", "score", "rank"]
