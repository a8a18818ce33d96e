import hashlib
import re
from collections import defaultdict

import pytest
from conftest_llm import in_order, pairs

from spindrift.llm.exact_dedup import exact_dedup, exact_dedup_documents

LAST = (1 << 63) - 1


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(LAST if i is None else i)
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        keep = min(groups[norm])
        out.append((i, None if keep == LAST else keep, len(groups[norm]), (LAST if i is None else i) == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return in_order(out)


def got(df, **k):
    return in_order(tuple(r) for r in exact_dedup(df, **k).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("block", [7, 4096])
def test_odd(odd, block):
    assert got(odd, block_bytes=block) == brute(pairs(odd))


def test_real_in_small_blocks(real):
    assert got(real, block_bytes=300) == brute(pairs(real))


def test_equal_keys_are_told_apart(odd, monkeypatch):
    """Names compare contents: with one key for all blocks the result is the same."""
    from pyspark.sql import functions as F

    monkeypatch.setattr("spindrift.llm.exact_dedup.F.xxhash64", lambda *_: F.lit(1))
    some = odd.where("length(text) < 3000 or text is null")
    assert got(some, block_bytes=500) == brute(pairs(some))


def test_empty(empty):
    assert exact_dedup(empty).count() == 0 and exact_dedup_documents(empty).count() == 0


def test_documents_keep_columns_and_one_row_each(odd):
    out = exact_dedup_documents(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 5 not in ids and 7 not in ids
