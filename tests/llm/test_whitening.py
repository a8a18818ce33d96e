"""The exact scatter against Python integers, and whitened values against a direct decomposition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, key string, component int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "k", 3) for i, v in rows], SCHEMA).repartition(3)


def _vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim))
    return (rng.normal(size=(n, dim)) @ mix).astype(np.float32)


def _check(spark, rows):
    """All columns of the result against exact integers and a decomposition of the exact covariance."""
    whole = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    ints = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in whole]
    fit = sorted({tuple(x) for _, x in ints})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dim)]
    v = np.array([[(n * sum(x[a] * x[b] for x in fit) - sums[a] * sums[b]) / n**2 for b in range(dim)] for a in range(dim)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    got = {}
    for r in whitening.whiten(_table(spark, rows)).collect():
        got.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r)
    want_ids = sorted((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in ints)
    assert sorted(k for k, parts in got.items() for _ in parts[1]) == want_ids
    signs = {}
    for i, x in ints:
        own = got[i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))]
        assert sorted(own) == list(range(1, min(16, dim) + 1))
        for c, parts in own.items():
            r = parts[0]
            want = float(np.dot([(n * a - s) / n for a, s in zip(x, sums, strict=True)], q[:, c - 1]) / math.sqrt(e[c - 1]))
            if abs(want) > 1e-6:
                assert signs.setdefault(c, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
            assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-7, abs=1e-7)
            assert r["n"] == n and r["explained"] == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9) and r["identity_error"] < 1e-9


def test_against_integers(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(_vectors(700, 20))]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, [1.0] * 19 + [None]), (1004, [float("nan")] * 20), (1005, [float("inf")] + [0.0] * 19), (1006, [])]
    _check(spark, rows)


def test_fewer_dimensions_than_components_and_large_entries(spark):
    rows = [(k, (v * 10.0 ** (k % 9)).tolist()) for k, v in enumerate(_vectors(60, 5, 2))]
    ints = np.array([[math.floor(64 * c) for c in v] for _, v in rows], object)
    scatter = whitening.Scatter(5)
    scatter.add(ints.astype(np.int64))
    scatter.settle()
    assert (scatter.cross == ints.T @ ints).all() and (scatter.sums == ints.sum(0)).all()
    _check(spark, rows)


def test_sums_and_squares_beyond_64_bits():
    rng = random.Random(4)
    x = np.array([[rng.randrange(-(1 << 62), 1 << 62) for _ in range(6)] for _ in range(9000)], np.int64)
    scatter, exact = whitening.Scatter(6), x.astype(object)
    for part in np.array_split(x, 700):
        scatter.add(part)
    scatter.settle()
    assert scatter.n == 9000 and (scatter.cross == exact.T @ exact).all() and (scatter.sums == exact.sum(0)).all()
    model = whitening.Model(9000, [str(s) for s in scatter.sums], [0.0] * 6, [0.0])
    assert (model.deviations(x[:50]) == exact[:50] * 9000 - scatter.sums).all()
    for high in (10, 40, 61):
        d = x[:99] >> (62 - high)
        assert whitening.squares(d) == (d.astype(object) ** 2).sum(1).tolist()


@pytest.mark.parametrize("values", [[0, 1, -1], [127, -128], [128, -128], [-129], [1 << 31], [-(1 << 62), 1 << 62]])
def test_packing(values):
    assert whitening.unpacked([whitening.packed(np.array(values, np.int64))], len(values)).tolist() == [values]


def test_spaces_of_other_lengths_and_no_variance(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(_vectors(90, 4))]
    other = [(100 + k, [1.0, float(k % 2), 5.0]) for k in range(10)] + [(200, [2.5]), (None, [2.5])]
    both = whitening.whiten(_table(spark, rows + other))
    plain = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(_table(spark, rows)).collect()}
    got = {(r["vec_id"], r["component"]): r for r in both.collect()}
    assert {k: got[k]["whitened"] for k in plain} == pytest.approx(plain, abs=1e-9)
    assert sorted(abs(got[100 + k, 1]["whitened"]) for k in range(10)) == pytest.approx([1.0] * 10) and got[100, 2]["whitened"] == 0.0 and got[100, 1]["n"] == 2
    assert got[200, 1]["whitened"] == got[None, 1]["whitened"] == 0.0 and got[200, 1]["explained"] == 0.0 and got[200, 1]["identity_error"] == 0.0
    assert both.where(F.col("deviation") != 0).select("vec_id").distinct().count() == 100


def test_empty(spark):
    assert whitening.whiten(_table(spark, [])).collect() == []
    assert whitening.whiten(_table(spark, [(1, None), (2, [])])).collect() == []
