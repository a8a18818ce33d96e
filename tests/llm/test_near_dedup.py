import re
from itertools import combinations

import numpy as np
import pytest
from conftest_llm import in_order, pairs, prose
from pyspark.sql import functions as F

from spindrift.llm import near_dedup as nd
from spindrift.llm.common import Scratch, texts
from spindrift.llm.components import connected_components

LAST = (1 << 63) - 1
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    rows = [(LAST if i is None else i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(rows, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    back = lambda x: None if x == LAST else x
    return in_order((back(i), len(s), back(root(i) if s else i), not s or i == root(i)) for i, s in rows)


def got(df):
    return in_order(tuple(r) for r in nd.near_dedup(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_odd(odd):
    assert got(odd) == brute(pairs(odd))


def test_empty(empty):
    assert nd.near_dedup(empty).count() == 0


def test_large_group_of_near_copies(spark):
    """Members of one group that often are no neighbours of each other, and pairs at the threshold."""
    import random

    rng = random.Random(5)
    base = prose(9, 150).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(100 + i, 80)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)


def test_blocks_find_what_pivots_miss(spark, monkeypatch):
    monkeypatch.setattr(nd, "STARS", 0)
    monkeypatch.setattr(nd, "BLOCK", 3)
    rows = [(i, " ".join([*prose(9, 60).split(" ")[: 58 - i % 3], f"z{i}"])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def half_common(n, words=40, share=0.5, first=0):
    """Documents with a share of their text in common, and the rest their own."""
    common = prose(9, int(words * share)).split(" ")
    return [(first + i, " ".join([*common, *(f"w{i}x{k}" for k in range(words - len(common)))])) for i in range(n)]


def test_documents_with_half_their_text_in_common_are_not_paired(spark):
    """They share bands, but each has too many shingles of its own: none is dealt to a block."""
    from spindrift.llm.common import Scratch, texts

    rows = half_common(3000)
    df = texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    members = spark.createDataFrame([(b, b, i, i) for i, _ in rows for b in range(2)], "key long, band int, rep long, component long")
    scratch = Scratch(spark)
    assert nd._linkable(df, members, scratch).count() == 0
    assert spark.read.parquet(scratch.paths["across1"]).count() < 50  # the common shingles only
    out = nd.near_dedup(df)
    assert out.where("kept").count() == 3000


@pytest.mark.parametrize("wide", [0, 20, 10**6])
def test_among_many_of_one_passage_the_links_are_found(spark, monkeypatch, wide):
    """Near copies within a crowd that shares half of its text and so its bands, with blocks only."""
    monkeypatch.setattr(nd, "STARS", 0)
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "WIDE", wide)
    rows = half_common(120)
    rows += [(1000 + i, t + f" more{i}") for i, t in rows[::10]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows)


def test_a_large_component_is_not_paired_with_itself(spark, monkeypatch):
    """A band of one large component and a few others: rows dealt grow with the members."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    text = prose(3, 40)
    rows = [(i, f"{text} v{i % 400}") for i in range(400)] + [(1000, f"other {text}")]
    df = texts(spark.createDataFrame(rows, "doc_id long, text string"))
    sketches = {r["doc_id"]: r for r in nd._sketches(df).collect()}
    reps = spark.createDataFrame([(i, r["n"], r["registers"]) for i, r in sketches.items()], "rep long, n long, registers binary")
    members = spark.createDataFrame([(1, 0, i, 40, 0 if i < 1000 else i) for i, _ in rows], "key long, band int, rep long, n long, component long")
    scratch = Scratch(spark)
    split = nd._sized(members, "split", scratch)
    nd._open_links(df, split, reps, scratch)
    assert split.count() == 401
    assert nd._dealt(split.withColumn("shared", F.lit(1))).count() <= 400 + 101


@pytest.mark.parametrize("n", [1, 3, 40, 2000])
def test_estimate_is_close(n):
    rng = np.random.default_rng(n)
    errors = []
    for _ in range(60):
        every = rng.integers(0, 1 << 63, n + n // 3 + 1, np.int64).astype(np.uint64)
        a, b = np.unique(every[:n]), np.unique(every[n // 3 :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        equal = (np.frombuffer(nd.sketch(a), np.uint16) == np.frombuffer(nd.sketch(b), np.uint16)).sum()
        errors.append(nd.estimate(np.array([equal]))[0] - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (30, 20), (20, 10), (30, 40)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: 10, 20: 10, 30: 10, 40: 10}


def test_components_of_no_and_odd_edges(spark):
    schema = "a long, b long, node string"
    assert connected_components(spark.createDataFrame([], schema)).count() == 0
    edges = [(1, 1, "x"), (None, 2, "x"), (3, None, "x"), (5, 4, "x"), (4, 5, "x"), (5, 4, "y")]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, schema)).collect()}
    assert found == {4: 4, 5: 4}
    chain = [(i, i + 1, "") for i in range(100)]
    assert {r["component"] for r in connected_components(spark.createDataFrame(chain, schema)).collect()} == {0}


def test_sets_are_views():
    import pyarrow as pa

    chunks = [pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), pa.array([[9], [4, 5, 6], [7]], pa.list_(pa.int64())).slice(1)]
    at = nd._views(pa.chunked_array(chunks))
    assert [at(k).tolist() for k in range(5)] == [[1, 2], [], [3], [4, 5, 6], [7]]


def test_blocks_of_long_documents_are_bounded_by_their_shingles(spark):
    """1,024 members of 100,000 shingles each: no pair of blocks holds them all, and every pair of members outside the
    largest component meets once."""
    members = spark.range(1024).select(F.lit(1).alias("key"), F.lit(0).alias("band"), F.col("id").alias("rep"), F.lit(100_000).cast("long").alias("n"), F.greatest(F.col("id"), F.lit(512)).alias("component"))
    dealt = nd._dealt(nd._sized(members, "long", Scratch(spark)).withColumn("shared", F.lit(1 << 62))).join(members.select("rep", "n"), "rep")
    held = [r["n"] for r in dealt.groupBy("i", "j").agg(F.sum("n").alias("n")).collect()]
    assert len(held) > 1000 and max(held) <= 8 * nd.BLOCK_SHINGLES
    rows = dealt.where("rep IN (3, 600, 700, 1023)").select("i", "j", "own", "rep").collect()
    meets = {}
    for a in rows:
        for b in rows:
            if a["rep"] < b["rep"] and (a["i"], a["j"]) == (b["i"], b["j"]) and {a["own"], b["own"]} == {a["i"], a["j"]}:
                meets[a["rep"], b["rep"]] = meets.get((a["rep"], b["rep"]), 0) + 1
    assert meets == {(3, 600): 1, (3, 700): 1, (3, 1023): 1, (600, 700): 1, (600, 1023): 1, (700, 1023): 1}


def test_memory_of_a_block_of_long_sets():
    """Two hundred sets of 100,000 shingles, 160 MB: confirming their pairs takes less than half as much again."""
    import tracemalloc

    import pyarrow as pa

    lists = pa.chunked_array([pa.ListArray.from_arrays(np.arange(0, 201 * 100_000, 100_000, dtype=np.int32), np.arange(200 * 100_000, dtype=np.int64))])
    tracemalloc.start()
    at = nd._views(lists)
    assert all(len(np.intersect1d(at(k), at(k + 1), assume_unique=True)) == 0 for k in range(0, 199, 20))
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
