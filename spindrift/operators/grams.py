"""An index of substrings: which texts hold every three bytes, so that a search reads the few that can hold a term.

Two written tables. ``docs`` has the texts, a folder for each bucket, and the place of each in its bucket. ``postings`` has,
sorted by gram, lists of places as variable-length differences, one for each gram and stretch of a bucket, with their lengths. A
gram is three bytes of the text in lower case, and every byte starts one (the text ends in two zero bytes), so a term of
one or two bytes is a range of grams.

A search sums the lengths of the lists of a term's grams, a few rows; the lists of the rarest are intersected, and only the
buckets and places that come out are read and verified on their texts. Where even the rarest grams are in most texts, all
texts are read, which gives the same rows.

Defined cases: null text is empty; an empty term is in every text; equal keys are rows of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators.relational import top_k
from spindrift.operators.retrieval import keyword_score

#: Bytes of text in a bucket; grams of a term whose lists are read; candidates up to which they are broadcast.
BUCKET_BYTES, RAREST, BROADCAST_ROWS = 16 << 20, 3, 300_000
#: Share of all texts from which the texts are read without the index.
MOST = 0.5
_POSTINGS = "bucket int, gram int, n long, places binary"


def grams_of(data: bytes) -> np.ndarray:
    """The distinct grams of a text, sorted."""
    b = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:])


def coded(places: np.ndarray) -> bytes:
    """Ascending integers as differences, seven bits a byte."""
    gaps = np.diff(places, prepend=0).astype(np.uint64)
    width = np.maximum(1, (np.ceil(np.log2(gaps + 1.0)).astype(np.int64) + 6) // 7)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        more = np.where(width[has] > k + 1, 128, 0).astype(np.uint64)
        out[(ends - width)[has] + k] = (gaps[has] >> np.uint64(7 * k) & np.uint64(127)) | more
    return out.tobytes()


def decoded(data: bytes) -> np.ndarray:
    """What was coded."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    last = b < 128
    number = np.concatenate(([0], np.cumsum(last)[:-1])) if len(b) else np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(b) else np.zeros(0, np.int64)
    shift = 7 * (np.arange(len(b)) - first[number]) if len(b) else np.zeros(0, np.int64)
    return np.cumsum(np.bincount(number, (b & 127).astype(np.float64) * np.exp2(shift)).astype(np.int64)) if len(b) else np.zeros(0, np.int64)


def _postings(docs: DataFrame) -> DataFrame:
    """bucket, gram, n, places of stretches of rows (bucket, place, low), which come in the order of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, places = (batch.column(k).to_numpy() for k in (0, 1))
            found = [grams_of(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            for bucket in np.unique(buckets).tolist():
                rows = np.flatnonzero(buckets == bucket)
                grams = np.concatenate([found[i] for i in rows.tolist()] or [np.zeros(0, np.int32)])
                at = np.repeat(places[rows], [len(found[i]) for i in rows.tolist()])
                order = np.lexsort((at, grams))
                grams, at = grams[order], at[order]
                starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(grams))
                lists = [coded(at[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), bucket, np.int32)), pa.array(grams[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int64)), pa.array(lists, pa.binary())],
                    ["bucket", "gram", "n", "places"],
                )

    return docs.select("bucket", "place", "low").mapInArrow(run, _POSTINGS)


class GramIndex:
    """The index at a path: built once, then opened by any session that reads the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.docs = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/docs")
        self.postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, path: str) -> GramIndex:
        """Write the index of docs. Columns: key as it is called, and text."""
        spark = docs.sparkSession
        rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, -(-size // BUCKET_BYTES))
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key, "text"), F.lit(buckets)).cast("int"))
        placed = dealt.withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy(key)))
        placed.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/docs")
        # An empty table has no folder of a bucket to learn the columns from.
        placed.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
        written = spark.read.schema(placed.schema).parquet(f"{path}/docs").withColumn("low", F.lower("text"))
        lists = _postings(written)
        lists.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
        return cls(spark, path)

    @functools.cached_property
    def n_docs(self) -> int:
        return self.docs.count()

    def _lists(self, term: str):
        """The condition on postings for a term: its grams, or the range of those that start with it."""
        data = term.encode()
        if len(data) >= 3:
            b = np.frombuffer(data, np.uint8).astype(np.int64)
            return F.col("gram").isin(*np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]).tolist())
        low = int.from_bytes(data.ljust(3, b"\0"), "big")
        high = int.from_bytes(data.ljust(3, b"\xff"), "big")
        return F.col("gram").between(low, high)

    def rarest(self, terms: list[str]) -> dict[str, tuple[list[int] | None, int]]:
        """For each term the grams to intersect (None: all of its range) and the most texts that can hold it. A gram that no
        text holds is rarest of all."""
        long = [t for t in terms if len(t.encode()) >= 3]
        own = {t: np.unique([int.from_bytes(t.encode()[i : i + 3], "big") for i in range(len(t.encode()) - 2)]).tolist() for t in long}
        wanted = sorted({g for grams in own.values() for g in grams})
        lengths = {r["gram"]: r["n"] for r in self.postings.where(F.col("gram").isin(*wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()} if wanted else {}
        out = {}
        for t in terms:
            if t in own:
                best = sorted(own[t], key=lambda g: (lengths.get(g, 0), g))[:RAREST]
                out[t] = (best, lengths.get(best[0], 0))
            else:
                out[t] = (None, self.postings.where(self._lists(t)).agg(F.sum("n")).first()[0] or 0)
        return out

    def candidates(self, terms: list[str]) -> DataFrame | None:
        """bucket, place of the texts that can hold one of the terms; None if that may be most texts."""
        best = self.rarest([t for t in terms if t])
        if any(not t for t in terms) or sum(n for _, n in best.values()) > MOST * self.n_docs:
            return None

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [decoded(x) for x in batch.column(2).to_pylist()]
                sizes = [len(x) for x in found]
                flat = np.concatenate(found) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(batch.column(1).to_numpy(), sizes)), pa.array(flat.astype(np.int32))], ["bucket", "gram", "place"])

        out = None
        for t, (grams, _) in best.items():
            lists = self.postings.where(F.col("gram").isin(*grams) if grams else self._lists(t)).select("bucket", "gram", "places")
            hits = lists.mapInArrow(places, "bucket int, gram int, place int").groupBy("bucket", "place").agg(F.count(F.lit(1)).alias("n"))
            hits = (hits.where(F.col("n") == len(grams)) if grams else hits).select("bucket", "place")
            out = hits if out is None else out.unionByName(hits)
        out = out.distinct()
        return F.broadcast(out) if sum(n for _, n in best.values()) <= BROADCAST_ROWS else out

    def holding(self, terms: list[str]) -> DataFrame:
        """The rows of docs that hold one of the terms, whatever the case; text as it was given."""
        terms = [t.lower() for t in terms]
        found = self.candidates(terms)
        rows = self.docs if found is None else self.docs.join(found, ["bucket", "place"])
        some = functools.reduce(lambda a, b: a | b, [F.lower("text").contains(t) for t in terms], F.lit(False))
        return rows.where(some)

    def keyword_search(self, key: str, query: str, k: int = 8) -> DataFrame:
        """key, score, rank of the k best texts with a score: the rows of retrieval.keyword_search."""
        scored = self.holding(query.lower().split()).select(key, keyword_score(F.lower("text"), query).alias("score"))
        return top_k(scored, [F.desc("score"), F.col(key)], k)
