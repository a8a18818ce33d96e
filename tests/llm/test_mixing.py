"""Weighted fair queueing against a queue that a loop serves."""

import hashlib
import random

import pytest

from spindrift.llm import mixing
from spindrift.llm.common import NO_ID

SCHEMA = "doc_id long, text string, source string, rank int, size string, uid int, target int, words string"


def brute(rows, weights=mixing.WEIGHTS, share=mixing.SHARE, passes=mixing.PASSES, packet=mixing.PACKET):
    """Sorted (doc_id, source, size, source_size, target, taken)."""
    docs = [(NO_ID if i is None else i, s, len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])) for i, t, s in rows]
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total = {s: sum(n for _, x, n in docs if x == s) for s in sources}
    budget = share * sum(total.values())
    # Reshare until none is above its cap.
    target, capped = {}, set()
    while True:
        left = budget - sum(passes * total[s] for s in capped)
        free = sum(weight[s] for s in sources if s not in capped)
        target = {s: float(passes * total[s]) if s in capped else left * weight[s] / free for s in sources}
        above = {s for s in sources if s not in capped and target[s] > passes * total[s]}
        if not above:
            break
        capped |= above
    queue = []
    for rank, s in enumerate(sources):
        served = 0
        order = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, n, k) for k, (i, x, n) in enumerate(docs) if x == s)
        for _ in range(passes):
            for _, _, n, k in order:
                for start in range(0, n, packet):
                    words = min(packet, n - start)
                    served += words
                    queue.append((served / weight[s], rank, served, k, words))
    room, taken = int(budget), [0] * len(docs)
    for _, _, _, k, words in sorted(queue):
        taken[k] += min(words, room)
        room -= min(words, room)
    return sorted(((None if i == NO_ID else i, s, n, total[s], target[s], taken[k]) for k, (i, s, n) in enumerate(docs)), key=str)


def _table(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", 1, 2, "w") for i, t, s in rows], SCHEMA).repartition(3)


def _result(spark, rows, **how):
    return sorted((tuple(r) for r in mixing.mix(_table(spark, rows), **how).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str)


def _same(got, want):
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-12, abs=1e-9)


def test_against_a_served_queue(spark):
    rng = random.Random(3)
    sizes = {"a": 40, "b": 400, "c": 20, "": 90, "Z": 3, "é": 60, None: 50}
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 70, 300])) if rng.random() > 0.05 else None, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = _result(spark, rows)
    _same(got, brute(rows))
    words = sum(g[2] for g in got)
    assert sum(g[5] for g in got) == int(1.5 * words)
    assert all(g[5] <= 2 * g[2] for g in got)
    for s in sizes:
        own = [g for g in got if g[1] == s]
        assert abs(sum(g[5] for g in own) - own[0][4]) <= 2 * mixing.PACKET
    assert got == _result(spark, rows)  # reruns agree


def test_other_weights_and_passes(spark):
    rows = [(k, "w " * (1 + k % 40), f"s{k % 4}") for k in range(200)]
    how = {"weights": (1.0, 5.0), "share": 0.3, "passes": 1, "packet": 7}
    _same(_result(spark, rows, **how), brute(rows, **how))


def test_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "x", "s"), (None, "q w e", None), (None, None, None), (2, "", "t"), (3, " \t\n ", ""), (4, "word " * 5000, "s"), (-7, "\x0bone\x0ctwo\x85three", "t")]
    _same(_result(spark, rows), brute(rows))
    assert mixing.mix(_table(spark, [])).collect() == []
    assert [tuple(r)[2:] for r in mixing.mix(_table(spark, [(1, None, "s"), (2, "", None)])).collect()] == [(0, 0, 0.0, 0)] * 2


def test_the_order_interleaves_sources_by_weight(spark):
    rows = [(k, "w " * 640, f"s{k % 2}") for k in range(40)]
    sized = mixing.sizes(_table(spark, rows))
    queue = mixing.queue(sized, mixing.targets(sized))
    mixed = [tuple(r) for r in mixing.mixture(queue, 12_800).select("finish", "rank", "served", "words").orderBy("finish", "rank", "served").collect()]
    assert sum(m[3] for m in mixed) == 12_800
    for k in range(40, len(mixed), 40):  # at any place three of four packets are of the source of weight 3
        assert abs(sum(m[1] == 1 for m in mixed[:k]) - 0.75 * k) <= 2
