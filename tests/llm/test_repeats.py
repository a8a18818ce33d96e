import hashlib

import numpy as np
import pytest
from conftest_llm import in_order, pairs, prose

from spindrift.llm import repeats

LAST = (1 << 63) - 1


def brute(rows, n=50):
    rows = [(LAST if i is None else i, t.encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, t in rows:
        for p in range(len(t) - n + 1):
            s = t[p : p + n]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if first[t[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((None if i == LAST else i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return in_order(out)


def got(df):
    return in_order(tuple(r) for r in repeats.repeated_spans(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_odd(odd):
    assert got(odd) == brute(pairs(odd))


def test_rows_with_one_id_and_different_texts(spark):
    from conftest_llm import prose

    rows = [(1, prose(5, 40)), (2, prose(5, 40) + " x"), (2, prose(6, 40)), (2, prose(5, 30)), (3, prose(6, 50))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("i", [2, None])
def test_each_text_of_an_id_loses_the_phrase(spark, i):
    """Rows with one id and different texts in one task, with the first document there or in another task."""
    passage = prose(5, 40)
    rows = [(1, passage), (i, prose(6, 40) + " " + passage), (i, prose(7, 40) + " " + passage), (i, passage + " " + prose(8, 40))]
    schema = "doc_id long, text string"
    together = spark.createDataFrame(rows, schema).coalesce(1)
    apart = spark.createDataFrame(rows[:1], schema).coalesce(1).unionByName(spark.createDataFrame(rows[1:], schema).coalesce(1))
    assert got(together) == brute(rows)
    assert got(apart) == brute(rows)


def test_real(real):
    some = real.limit(80)
    assert got(some) == brute(pairs(some))


def test_small_chunks_and_heavy_triggers(spark, odd, monkeypatch):
    """Texts parsed piece by piece, and every shared trigger dealt string by string."""
    monkeypatch.setattr(repeats, "FLUSH", 2000)
    monkeypatch.setattr(repeats, "PHRASE_BUCKET", 20_000)
    monkeypatch.setattr(repeats, "DOC_BUCKET", 20_000)
    some = odd.where("length(text) < 3000 or text is null")
    real_heavy = repeats._heavy
    monkeypatch.setattr(repeats, "_heavy", lambda rows: real_heavy(rows, 1, 2))
    assert got(some) == brute(pairs(some))


def test_chunked_parse_is_the_same(monkeypatch):
    from conftest_llm import prose

    text = prose(8, 900).encode()
    whole = repeats.phrases(text)
    monkeypatch.setattr(repeats, "CHUNK", 777)
    cut = repeats.phrases(text)
    covered = lambda p: np.concatenate([np.arange(a, b + 1) for a, b in zip(p[2], p[3], strict=True)])
    assert np.array_equal(covered(whole), covered(cut)) and set(whole[0] & repeats._TRIGGER_BITS) == set(cut[0] & repeats._TRIGGER_BITS)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_orders_name_strings(seed):
    """Pairs of runs in the two orders against the strings themselves, with zero bytes, copies and one-sided phrases."""
    rng = np.random.default_rng(seed)
    side = repeats.MIN_BYTES - repeats.TRIGGER
    triggers = [bytes(rng.integers(0, 2, repeats.TRIGGER, np.uint8)) for _ in range(3)]
    sides = [bytes(rng.integers(0, 2, side, np.uint8)) for _ in range(2)]
    ids, lengths, offsets, contents = [], [], [], []
    for _ in range(60):
        before, after = int(rng.integers(0, side + 1)), int(rng.integers(0, side + 1))
        if before + after < side:
            after = side - before
        left = sides[rng.integers(2)][side - before :]
        content = left + triggers[rng.integers(3)] + sides[rng.integers(2)][:after]
        ids.append(int(rng.integers(0, 8)))
        lengths.append(len(content))
        offsets.append(before)
        contents.append(content)
    places = np.arange(60, dtype=np.uint64) * np.uint64(1000)
    got_ids, got_places = repeats.shared_strings(np.array(ids, np.uint64), places, np.array(lengths, np.uint64), np.array(offsets, np.uint64), b"".join(contents))
    first: dict[tuple[int, bytes], int] = {}
    strings = [(i, int(p) + x, (s - x, c[x : x + 50])) for i, p, s, c in zip(ids, places, offsets, contents, strict=True) for x in range(max(0, s - side), min(s, len(c) - 50) + 1)]
    for i, _, key in strings:
        first[key] = min(first.get(key, i), i)
    want = sorted((i, p) for i, p, key in strings if first[key] < i)
    assert sorted(zip(got_ids.tolist(), got_places.tolist(), strict=True)) == want and want


def test_names_that_collide(spark, monkeypatch):
    """With names of 16 bits, which collide all over, the bits in the key still keep phrases apart."""
    real_phrases = repeats._phrases

    def short(raw, offset):
        trigger, name, *rest = real_phrases(raw, offset)
        return trigger, name & np.uint64(0xFFFF), *rest

    texts = [prose(k, 60) for k in range(40)]
    flat = [real_phrases(np.frombuffer(t.encode(), np.uint8), 0) for t in texts]
    assert len({int(n) & 0xFFFF for p in flat for n in p[1]}) < sum(len(p[1]) for p in flat)
    monkeypatch.setattr(repeats, "_phrases", short)
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)) == brute(rows)


def test_pack():
    a, b = np.arange(5, dtype=np.uint64) << np.uint64(40), np.arange(5, dtype=np.uint64)
    x, y = repeats.unpack([repeats.pack(a, b), repeats.pack(b, a)], 2)
    assert x.tolist() == [*a, *b] and y.tolist() == [*b, *a]


def test_empty(empty):
    assert repeats.repeated_spans(empty).count() == 0


@pytest.mark.parametrize("n", [49, 50])
def test_short(spark, n):
    rows = [(1, "q" * n), (2, "q" * n)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_equal_hashes_of_other_bytes_remove_nothing(monkeypatch):
    """Strings and phrases whose hashes collide, within a text, go only where their bytes are those of a mark."""
    import random

    rng = random.Random(8)
    text = "".join(rng.choice("ab ") for _ in range(3000)).encode()
    text += text[700:900] + b"x" + text[700:760]
    strings = np.array([705, 710, 1500])
    real, names = repeats.rolling, repeats.phrases
    want_strings = {text[s : s + 50] for s in strings.tolist()}
    covered = np.zeros(len(text), bool)
    for p in range(len(text) - 49):
        if text[p : p + 50] in want_strings:
            covered[p : p + 50] = True
    _, name, first, last, _ = names(text)
    whole = np.array([3, 60])
    want_phrases = {text[first[k] : last[k] + 50] for k in whole.tolist()}
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if text[a : b + 50] in want_phrases:
            covered[a : b + 50] = True
    want = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))).tolist()

    def coarse(raw, sizes):
        return [h & np.uint64(7) if s == repeats.MIN_BYTES else h for h, s in zip(real(raw, sizes), sizes, strict=True)]

    assert repeats._removed(text, whole, strings).tolist() == want
    monkeypatch.setattr(repeats, "phrases", lambda t: (lambda x: (x[0], x[1] & np.uint64(3), *x[2:]))(names(t)))
    monkeypatch.setattr(repeats, "rolling", coarse)
    assert repeats._removed(text, whole, strings).tolist() == want
