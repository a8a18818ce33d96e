"""Benchmark decontamination: a broadcast hash set of test n-grams against every window of every document.

Words are maximal runs of ASCII digits and letters and of non-ASCII characters, A-Z lower-cased. A window is
``WINDOW`` consecutive words of a benchmark item; an item with fewer words, but some, is one window. A document word
inside an occurrence of a window is hit.

The benchmark's words get integer codes, so a document becomes an array of codes (0: no benchmark word). A rolling
hash of each window of codes is looked up in the sorted hashes of the test windows, and each hit is verified by
comparing codes, so no hash collision counts. Documents are scanned once and are not shuffled.

The benchmark is broadcast in slices of at most ``SLICE_WINDOWS`` windows. A benchmark within one slice needs one
scan; a larger one is scanned slice by slice, each built and broadcast after the hits of the one before are written and
its broadcast is gone, so neither the driver nor a worker ever holds more than one. The rows are numbered in a written
table beforehand, and the hit positions of a row are merged by its number.

Defined cases: null text has no words and hits nothing, and a null or wordless item has no window; repeated items with
one id count once; repeated documents are each judged; an empty benchmark hits nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, back_id, drop_rows, map_batches, row_texts, texts, utf8, with_rows

WINDOW = 13
#: Windows in one broadcast; at some 200 bytes each this is at most 200 MB in a worker.
SLICE_WINDOWS = 1_000_000
#: A document is contaminated if it has hits and so many times them reach its words.
SHARE = 20
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


class Windows:
    """The test windows of one slice: codes of words, and by length of window sorted hashes and verified contents."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.codes: dict[bytes, int] = {}
        self.lengths: dict[int, tuple[np.ndarray, dict[tuple[int, ...], list[str]]]] = {}
        found: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, text in items:
            codes = [self.codes.setdefault(w, len(self.codes) + 1) for w in words(text)]
            if not codes:
                continue
            n = min(size, len(codes))
            for window in {tuple(codes[i : i + n]) for i in range(len(codes) - n + 1)}:
                found.setdefault(n, {}).setdefault(window, []).append(item)
        for n, windows in found.items():
            hashes = rolling(np.array([c for w in windows for c in w], np.uint64), n)[::n]
            self.lengths[n] = np.unique(hashes), windows


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive codes."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for i in range(n):
        out *= _PRIME
        out += codes[i : i + len(out)]
    return out ^ (out >> np.uint64(29))


def hits(codes: np.ndarray, windows: Windows) -> tuple[np.ndarray, set[str]]:
    """Which of the words are hit, and the items whose windows occur."""
    hit, items = np.zeros(len(codes) + 1, np.int32), set()
    for n, (hashes, contents) in windows.lengths.items():
        if len(codes) < n:
            continue
        found = rolling(codes, n)
        at = np.searchsorted(hashes, found)
        at[at == len(hashes)] = 0
        for i in np.flatnonzero(hashes[at] == found).tolist():
            if of := contents.get(tuple(codes[i : i + n].tolist())):
                items.update(of)
                hit[i] += 1
                hit[i + n] -= 1
    return np.cumsum(hit[:-1]) > 0, items


def _scan(docs: DataFrame, windows: Broadcast, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The hits of the windows in docs (text last, behind some columns that stay)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        code = known.codes.get
        shortest = min(known.lengths, default=1)
        for batch in batches:
            rows = []
            for text in utf8(batch.column(len(columns))):
                found = words(text)
                codes = np.fromiter(map(code, found, repeat(0)), np.uint64, len(found))
                mask, of = hits(codes, known) if len(found) >= shortest else (np.zeros(len(found), bool), set())
                edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8))) if of else ()
                rows.append((len(found), int(mask.sum()), sorted(of), [int(x) for x in edge]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                [*columns, "n_words", "n_hit", "items", "edges"],
            )

    return map_batches(docs.select(*columns, "text"), scan, ", ".join(f"{c} long" for c in columns) + ", n_words long, n_hit long, items array<string>, edges array<long>")


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in slices of at most limit words (and so windows), read item by item."""
    items, n = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))).toLocalIterator()
    for item, text in rows:
        text = text.encode()
        size = len(words(text))
        if items and n + size > limit:
            yield items
            items, n = [], 0
        items.append((item, text))
        n += size
    yield items


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), edges (starts and ends of hit runs of words, in turn), one row a document."""
    rows, spark = texts(docs), docs.sparkSession
    slices = _slices(benchmark, slice_windows)
    first, second = next(slices), next(slices, None)
    shared = lambda items: spark.sparkContext.broadcast(Windows(items, size))
    if second is None:
        return _scan(rows, shared(first))
    scratch = Scratch(spark)
    numbered = scratch.keep("numbered", rows.withColumn("uid", F.monotonically_increasing_id()))
    merged = None
    for k, items in enumerate(chain([first, second], slices)):
        windows = shared(items)
        part = _scan(numbered, windows, ("uid", "doc_id"))
        part = scratch.keep(f"slice{k}", part if merged is None else part.where("n_hit > 0"))
        windows.destroy()
        merged = part if merged is None else merged.unionByName(part)
    grouped = merged.groupBy("uid", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.collect_list("edges").alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, items, runs = (batch.column(k).to_pylist() for k in ("doc_id", "n_words", "items", "runs"))
            out = []
            for length, lists in zip(n, runs, strict=True):
                mask = np.zeros(length + 1, np.int32)
                for edges in lists:
                    np.add.at(mask, edges[::2], 1)
                    np.add.at(mask, edges[1::2], -1)
                hit = np.cumsum(mask[:-1]) > 0
                out.append((int(hit.sum()), np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8))).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([x[1] for x in out], pa.list_(pa.int64()))],
                ["doc_id", "n_words", "n_hit", "items", "edges"])

    return map_batches(grouped, merge, "doc_id long, n_words long, n_hit long, items array<string>, edges array<long>")


def contaminated(share: int = SHARE):
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, edges, one row a document."""
    found = benchmark_hits(docs, benchmark, size)
    return found.select(
        back_id(), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(share).alias("contaminated"), "items", "edges",
    )


def decontaminate_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """docs without contaminated documents, all columns as they were; each row is judged by its own text."""
    rows, name = with_rows(docs)
    bad = benchmark_hits(row_texts(rows, name), benchmark, size).where(contaminated(share))
    return drop_rows(rows, name, bad.select(F.col("doc_id").alias("row")))
