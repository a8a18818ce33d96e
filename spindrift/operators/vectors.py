"""Exact nearest vectors by inner product, with partitions that are skipped where they cannot hold a hit.

An index deals the vectors to the nearest of some centres, which are fitted on a bounded sample, and keeps for each centre
the radius of its vectors. By the inequality of Cauchy and Schwarz no vector x of a centre c with radius r has a larger
product with a query q than q·c + |q| r. A query is first held against the centres with the best bounds; the k-th best
score that it finds there rules out every centre whose bound is below, and only the others are read. So the result is that of
all vectors, whatever the centres.

Queries are a table and meet vectors by centre, in blocks of bounded size on both sides, one matrix product for each pair of
blocks; k rows for each query leave it. Nothing is broadcast but the centres.

Defined cases: null vectors, and those with null entries, are left out; equal scores rank by key; fewer vectors than k give
all of them; an empty index or no queries give no rows. Vectors must be of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators.graph import Rounds

#: Vectors that centres are fitted on, centres at most, and rows of one block.
SAMPLE, CENTRES, BLOCK = 8192, 1024, 4096
#: Centres that a query is held against first, and what bounds are widened by, as a share.
FIRST, SLACK = 2, 1e-9


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def centres(sample: np.ndarray, n: int, turns: int = 8) -> np.ndarray:
    """n means of a sample, by Lloyd's iteration from its first rows."""
    found = sample[:n].copy()
    for _ in range(turns):
        near = nearest(sample, found)[0]
        for c in range(len(found)):
            own = sample[near == c]
            if len(own):
                found[c] = own.mean(0)
    return found


def nearest(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    near = np.argmin((found * found).sum(1)[None, :] - 2 * rows @ found.T, axis=1)
    return near, np.sqrt(((rows - found[near]) ** 2).sum(1))


class VectorIndex:
    """rows: centre, key, vector; bounds: centre, radius, n of each centre that has rows."""

    def __init__(self, rows: DataFrame, bounds: DataFrame, found: np.ndarray, key: str):
        self.rows, self.bounds, self.found, self.key = rows, bounds, found, key
        self.read: list[tuple[int, int]] = []  #: after a join, the pairs of queries and centres in each round

    @classmethod
    def build(cls, table: DataFrame, key: str, vector: str, n_centres: int | None = None) -> VectorIndex:
        rounds = Rounds(table.sparkSession)
        kind = dict(table.dtypes)[key]
        whole = table.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        sample = np.array([r["vector"] for r in whole.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()], np.float64)
        if not len(sample):
            empty = rounds.keep(whole.select(F.lit(0).alias("centre"), "key", "vector"))
            return cls(empty, empty.groupBy("centre").agg(F.lit(0.0).alias("radius"), F.count(F.lit(1)).alias("n")), np.zeros((0, 0)), key)
        length = sample.shape[1]
        found = centres(sample, n_centres or min(CENTRES, max(1, int(len(sample) ** 0.5))))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near, distance = nearest(_matrix(batch.column(1), length), found)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0), batch.column(1), pa.array(distance)], ["centre", "key", "vector", "distance"])

        rows = rounds.keep(whole.mapInArrow(assign, f"centre int, key {kind}, vector array<double>, distance double"))
        bounds = rounds.keep(rows.groupBy("centre").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")))
        return cls(rows.drop("distance"), bounds, found, key)

    def _pairs(self, queries: DataFrame, kind: str, first: bool) -> DataFrame:
        """query, vector, centre: of each query (query, vector, least) the centres with the ``FIRST`` best bounds, or of the
        others those whose bound reaches the least score that counts (null: any)."""
        radii = {r["centre"]: r["radius"] for r in self.bounds.collect()}  # a row for each centre
        own = np.array(sorted(radii), np.int32)
        found, radius = self.found[own], np.array([radii[c] for c in own.tolist()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column(1), found.shape[1])
                reach = np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
                bound = q @ found.T + reach
                bound += SLACK * (np.abs(bound) + reach + 1)
                place = np.empty_like(bound, np.int64)
                np.put_along_axis(place, np.argsort(-bound, axis=1, kind="stable"), np.arange(len(own))[None, :], axis=1)
                least = batch.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                row, centre = np.nonzero(place < FIRST if first else (place >= FIRST) & (bound >= least[:, None]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(own[centre])], ["query", "vector", "centre"])

        return queries.select("query", "vector", "least").mapInArrow(run, f"query {kind}, vector array<double>, centre int")

    def _scores(self, pairs: DataFrame, kind: str, k: int) -> DataFrame:
        """query, key, score: the k best of each pair (query, vector, centre) of blocks."""
        key_kind, length = dict(self.rows.dtypes)["key"], self.found.shape[1]
        asked = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("asked"))
        dealt = self.bounds.join(asked, "centre").select("centre", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("asks"))
        dealt = F.broadcast(dealt)  # a row for each centre
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = pairs.join(dealt, "centre").select("centre", every("blocks").alias("block"), F.pmod(F.xxhash64("query"), F.col("asks")).cast("int").alias("ask"), "query", "vector")
        right = self.rows.join(dealt, "centre").select("centre", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), every("asks").alias("ask"), "key", "vector")

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            schema = pa.schema([("query", a.schema.field("query").type), ("key", b.schema.field("key").type), ("score", pa.float64())])
            if not len(a) or not len(b):
                return schema.empty_table()
            rows = b.combine_chunks().sort_by("key")
            scores = _matrix(a.column("vector").combine_chunks(), length) @ _matrix(rows.column("vector").combine_chunks(), length).T
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(a)), top.shape[1])
            return pa.table([a.column("query").take(pa.array(q)), rows.column("key").take(pa.array(top.ravel())), pa.array(scores[q, top.ravel()])], schema=schema)

        keys = ["centre", "block", "ask"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"query {kind}, key {key_kind}, score double")

    def join(self, queries: DataFrame, key: str, vector: str, k: int = 8) -> DataFrame:
        """query, key, score, rank: the k vectors with the largest products with each query."""
        rounds = Rounds(queries.sparkSession)
        kind, key_kind = dict(queries.dtypes)[key], dict(self.rows.dtypes)["key"]
        top = W.partitionBy("query").orderBy(F.desc("score"), "key")
        if not len(self.found):
            return queries.sparkSession.createDataFrame([], f"query {kind}, {self.key} {key_kind}, score double, rank int")
        asked = queries.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("vector"))
        asked = rounds.keep(asked)
        first = rounds.keep(self._pairs(asked.withColumn("least", F.lit(None).cast("double")), kind, True))
        found = rounds.keep(self._scores(first, kind, k).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).drop("rank"))
        least = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        second = rounds.keep(self._pairs(asked.join(least, "query", "left"), kind, False))
        every_pair = asked.count() * self.bounds.count()
        self.read = [(first.count(), every_pair), (second.count(), every_pair)]
        every = found.unionByName(self._scores(second, kind, k))
        ranked = every.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        return ranked.select("query", F.col("key").alias(self.key), "score", "rank")
