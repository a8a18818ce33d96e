"""The substring index against scans of all texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import retrieval
from spindrift.operators.grams import GramIndex, coded, decoded, grams_of


def test_coding_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 2, 50, 5000):
        places = np.array(sorted(rng.sample(range(1, 10 ** rng.randrange(5, 9)), n)), np.int64)
        assert decoded(coded(places)).tolist() == places.tolist()
    assert coded(np.array([1, 128, 256, 16640])) == bytes([1, 127, 128, 1, 128, 128, 1])


def test_grams():
    assert [int(g).to_bytes(3, "big") for g in grams_of(b"abab")] == sorted([b"aba", b"bab", b"ab\0", b"b\0\0"])
    assert grams_of(b"").tolist() == []


WORDS = ["alpha", "beta", "gamma", "Straße", "x", "日本語", "akia", "zz top"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(WORDS[:6]) for _ in range(rng.randrange(0, 40))) + (" AKIA key" if k % 97 == 0 else "") + ("\nzz top" if k % 61 == 0 else "")) for k in range(600)]
    return spark.createDataFrame([*rows, (600, None), (601, ""), (602, "q"), (602, "ends with x7"), (603, "akia " * 3)], "key long, text string").repartition(5)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    return GramIndex.build(table, "key", "text", str(tmp_path_factory.mktemp("grams") / "index"))


@pytest.mark.parametrize("query", ["akia", "AKIA zz", "zz top", "x7", "q", "7", "straße 日本", "nowhere", "alpha", "akia nowhere", "key", "x"])
def test_searches_are_those_of_a_scan(table, index, query):
    rows = table.select("key", F.coalesce("text", F.lit("")).alias("text"))
    want = [tuple(r) for r in retrieval.keyword_search(rows, "key", "text", query, 12).collect()]
    assert sorted(tuple(r) for r in index.keyword_search("key", query, 12).collect()) == sorted(want)


def test_every_substring_is_found(table, index):
    rows = [(r["key"], (r["text"] or "").lower()) for r in table.collect()]
    for term in ("zz t", "p", "key", "\nzz", "本", "a k", "ia ", "with x7"):
        assert sorted(r["key"] for r in index.holding([term]).select("key").collect()) == sorted(k for k, t in rows if term in t)


def test_few_buckets_and_places_are_read(index):
    wanted = index.rarest(["akia"])["akia"]
    assert wanted[1] <= 8 and len(wanted[0]) <= 3
    found = index.candidates(["akia"])
    assert found.count() <= wanted[1] < index.n_docs / 50
    plan = index.holding(["akia"])._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() and "PushedFilters: [In(gram" in plan
    assert index.candidates(["a"]) is None  # most texts hold it


def test_empty(spark, tmp_path):
    empty = GramIndex.build(spark.createDataFrame([], "key long, text string"), "key", "text", str(tmp_path / "none"))
    assert empty.keyword_search("key", "any").collect() == [] and empty.holding(["x"]).collect() == []
