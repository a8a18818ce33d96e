"""The audit against filters that are run in every order over lists of documents."""

import re
from itertools import permutations

from conftest_llm import odd_texts, prose

from spindrift.llm.common import NO_ID
from spindrift.llm.filter_audit import filter_audit, word_counts

LABELS = "doc_id long, quality int, toxic int, part string, text string"
DOCS = "doc_id long, text string, lang string, part int, pattern string, words int, digest int, good int, tag int"


def brute(rows, labels):
    docs = [(NO_ID if i is None else i, t or "", lang or "") for i, t, lang in rows]
    first = {}
    for i, t, _ in docs:
        first[t] = min(first.get(t, i), i)
    good, toxic = ({i for i, *marks, _, _ in labels if i is not None and marks[k] == 1} for k in (0, 1))
    fails = []
    for i, t, _ in docs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": re.search(r"[#$%&*|]", t) is not None, "E": first[t] < i}
        fails.append({k for k, v in own.items() if v})
    out = {}
    for part in {p for _, _, p in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [k for k, d in enumerate(docs) if d[2] == part]
            for step, f in enumerate(order, 1):
                all_failing = [k for k, d in enumerate(docs) if d[2] == part and f in fails[k]]
                removed = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), len(all_failing) - len(removed), sum(fails[k] == {f} for k in all_failing),
                    sum(docs[k][0] in good for k in removed), sum(docs[k][0] in toxic for k in removed),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _check(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, 1, "p", 2, 3, 4, 5) for i, t, lang in rows], DOCS).repartition(3)
    got = filter_audit(docs, spark.createDataFrame(labels, LABELS))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got.collect()}
    assert found == brute(rows, labels)


def test_odd_texts_in_all_orders(spark):
    rows = [(i, t, ["en", "de", None, ""][k % 4]) for k, (i, t) in enumerate(odd_texts())]
    rows += [(40 + k, prose(50 + k, 260), "en") for k in range(4)]
    rows += [(50, prose(50, 260), "en"), (51, prose(50, 260), "de"), (52, prose(51, 260) + " $", "en"), (53, "A" * 4 + "b" * 96, "en"), (54, "A" * 3 + "b" * 97, "en")]
    rows += [(55, " ".join(f"w{k % 100}" for k in range(200)), "en"), (56, " ".join(f"w{k % 99}" for k in range(200)), "en"), (57, " ".join(f"w{k}" for k in range(199)), "en")]
    labels = [(i, k % 2, k % 3 == 0, "x", "y") for k, (i, _, _) in enumerate(rows)] + [(3, 1, 1, "x", "y"), (3, None, None, "x", "y"), (None, 1, 1, "x", "y")]
    _check(spark, rows, [(i, q, None if t is None else int(t), a, b) for i, q, t, a, b in labels])


def test_repeated_rows_count_each(spark):
    text = prose(9, 250)
    _check(spark, [(1, text, "en")] * 3 + [(1, "other", "en"), (2, text, "en"), (2, text, "de"), (None, text, None), (None, text, None)], [(1, 1, 0, "x", "y"), (2, 0, 1, "x", "y")])


def test_empty(spark):
    assert filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    _check(spark, [(1, None, None)], [])


def test_word_counts_move_a_row_for_each_distinct_word(spark):
    docs = spark.createDataFrame([(1, 5, "b a  b\tb")], "doc_id long, tag long, text string")
    assert [tuple(r) for r in word_counts(docs).collect()] == [(1, 5, 4, 2)]
