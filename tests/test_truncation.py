"""Truncation of code by line tables, against a walk over each file."""

import random
import re

import pytest

from spindrift.functions.text import LINE_PATTERNS
from spindrift.operators import lines


def importance(line):
    return max([1, *(s for s, p in LINE_PATTERNS if line.strip(" ") and re.match(p, line, re.I | re.A))])


def tokens(rows):
    return len("\n".join(rows)) // 4


def brute(code, budget):
    rows, scores = code.split("\n"), [importance(x) for x in code.split("\n")]
    for level in range(5):
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and scores[j] == scores[i]:
                j += 1
            if scores[i] <= level and j - i >= 3:
                out.append(re.match(r"\s*", rows[i])[0] + f"# ... [{j - i} lines omitted] ...")
            else:
                out += rows[i:j]
            i = j
        if tokens(out) <= budget:
            return "\n".join(out)
    half = len(out) // 2

    def fill(some, share):
        kept, used = [], 0
        for x in some:
            used += (len(x) + 1) // 4
            if used >= (budget - 100) * share:
                break
            kept.append(x)
        return kept

    first, last = fill(out[:half], 0.6), fill(out[half:][::-1], 0.3)[::-1]
    return "\n".join([*first, f"\n# ... [{len(out) - len(first) - len(last)} lines omitted for brevity] ...\n", *last])


def sources():
    rng = random.Random(7)
    kinds = ["import os", "def f(a, b):", "    x = 1", "    return x", "plain words", "", "class Big:", "    if a:", "@deco", "# TODO later"]
    out = ["short", "", "\n\n\n\n", "x = 1\n" * 400, "import os\n" + "\n".join(f"x{i} = {i}" for i in range(50)) + "\ndef f():\n    return 1\n", "\n".join(f"@deco{i} some words here" for i in range(400))]
    for _ in range(30):
        rows: list[str] = []
        while len(rows) < rng.randint(5, 300):
            rows += [rng.choice(kinds)] * rng.choice([1, 1, 2, 3, 5, 9])
        out.append("\n".join(rows))
    return out


@pytest.mark.parametrize("budget", [30, 200, 500])
def test_truncated(spark, budget):
    rows = list(enumerate(sources()))
    docs = spark.createDataFrame([*rows, (999, None)], "k long, code string")
    got = {r["k"]: r["text"] for r in lines.truncated(docs, "k", "code", budget).collect()}
    assert got == {k: brute(c, budget) for k, c in rows} | {999: None}


def test_kept_ranges(spark):
    code = "\n".join([*(f"@deco{i} some words here" for i in range(20)), "import late", *(f"@deco{i} more words here" for i in range(300)), "def kept(): pass"])
    docs = spark.createDataFrame([(1, code), (2, "small"), (3, code)], "k long, code string")
    ranges = spark.createDataFrame([(1, 322, 322), (1, 100, 101), (2, 1, 1), (1, 0, 5)], "k long, first int, last int")
    got = {r["k"]: r["text"] for r in lines.kept_ranges(docs, "k", "code", ranges, 900).collect()}
    rows = code.split("\n")
    want = [*rows[:10], "# ... [lines 11 - 20 omitted] ...", rows[20], "# ... [lines 22 - 99 omitted] ...", rows[99], rows[100], "# ... [lines 102 - 321 omitted] ...", rows[321]]
    assert got[1] == "\n".join(want) and got[2] == "small" and "omitted for brevity" in got[3]


def test_the_registered_query_truncates_every_document(spark):
    from spindrift.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["text"] for r in catalogue.queries()["txt_14_truncate_code"](spark, sf).collect()}
    assert got == {r["doc_id"]: brute(r["text"], 200) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
