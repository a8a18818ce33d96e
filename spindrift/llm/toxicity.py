"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms' 32-bit hashes. The score is the logistic of

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

over its features, so a pair of terms (an insult and a mention of a group) has a weight of its own through the inner
product of their factors, which a linear model lacks. The pair sum costs one pass: half of the squared sum of factors
less the sum of squares.

The machine is fitted on at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of their id among the
labelled rows that are not held out (crc32 of the id as text, mod 4, is 2); of several texts of an id the least counts.
Features are of two kinds: the terms with the largest chi-squared between presence and label there, of ``LEAST_CHI`` at
least, and, whatever they say alone, terms that say something in pairs: of the ``PAIR_TERMS`` most frequent terms that
are in at most ``MOST_SHARE`` of the documents all pairs are counted in the sample, and those whose presence together
tells more than both alone add up to (``PAIR_CHI``) bring both of their terms in, so that the factors can learn an
interaction whose parts are neutral. All bounds are parameters; everything that follows is applied to every
document. Labels, language, source and id are never inputs of a score.

Defined cases: null text is empty and gets the bias as score; without a labelled row each score is 0; several labels
of a document count as toxic if one says so, null labels are left out; repeated rows are each scored; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, back_id, map_batches, small_batches, texts, utf8
from spindrift.llm.decontaminate import words

#: Bounds of the training sample, of the features, and the number of factors.
TRAIN_ROWS, FEATURES, FACTORS = 20_000, 4096, 8
#: Tasks that count pairs; each sends its counts once.
PAIR_TASKS = 8
#: Documents in which a feature occurs at least, and its least chi-squared.
LEAST_DOCS, LEAST_CHI = 5, 20.0
#: Frequent terms whose pairs are counted, the largest share of documents that hold one, and a pair's least chi-squared,
#: which is larger as there are half a million pairs and as some dozens of copies of one text tell no more than that text.
PAIR_TERMS, MOST_SHARE, PAIR_CHI = 1024, 0.5, 250.0
#: Bytes of the word beginnings that are terms too; those of the alphabet of words never hold the mark ``*``.
PREFIXES = (4, 5, 6, 7)
EPOCHS, RATE, DECAY, FACTOR_DECAY, BATCH = 40, 0.03, 1e-6, 1e-4, 256
#: From this score on a document is predicted to be toxic.
THRESHOLD = 0.3


@dataclass
class Machine:
    hashes: np.ndarray  # sorted hashes of the features
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def features(self, text: bytes) -> np.ndarray:
        """Places of the text's features."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        found = term_hashes(text)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return at[self.hashes[at] == found]

    def score(self, text: bytes) -> float:
        at = self.features(text)
        v = self.factors[at]
        raw = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def term_hashes(text: bytes) -> np.ndarray:
    """Distinct hashes of a text's terms, sorted: lower-cased words, and what longer words begin with (inflected forms)."""
    found = set(words(text))
    for n in PREFIXES:
        found |= {w[:n] + b"*" for w in found if len(w) > n and w[-1] != 42}
    return np.unique(np.fromiter(map(zlib.crc32, found), np.int64, len(found)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(rows: list[list[int]], labels: list[int], n_features: int, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the log loss of batches; rows hold the places of features."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w0, w, v = np.array([np.log(rate / (1 - rate))]), np.zeros(n_features), rng.normal(0, 0.05, (n_features, factors))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w0, w, v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            sizes = np.array([len(rows[i]) for i in chosen])
            flat = np.array([f for i in chosen for f in rows[i]], np.int64)
            owner = np.repeat(np.arange(len(chosen)), sizes)
            vs = v[flat]
            sums = np.zeros((len(chosen), factors))
            np.add.at(sums, owner, vs)
            raw = w0[0] + np.bincount(owner, w[flat], len(chosen)) + 0.5 * ((sums**2).sum(1) - np.bincount(owner, (vs**2).sum(1), len(chosen)))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[chosen]) / len(chosen)
            grad_w, grad_v = DECAY * w, FACTOR_DECAY * v
            np.add.at(grad_w, flat, error[owner])
            np.add.at(grad_v, flat, error[owner][:, None] * (sums[owner] - vs))
            step += 1
            for p, g, (m1, m2) in zip((w0, w, v), (np.array([error.sum()]), grad_w, grad_v), moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return float(w0[0]), w, v


def pair_chi(both: np.ndarray, both_toxic: np.ndarray, single: np.ndarray, single_toxic: np.ndarray, n: int, pos: int) -> np.ndarray:
    """For all pairs of terms the chi-squared of toxic documents with both, against the share that both terms give when
    each adds what it says alone (in log odds, as a linear model would); 0 where a pair is too rare, or not above it."""
    odds = lambda k, of: np.log((k + 0.5) / (of - k + 0.5))
    alone = odds(single_toxic, single)
    expected = 1 / (1 + np.exp(-np.clip(alone[:, None] + alone[None, :] - odds(np.float64(pos), np.float64(n)), -30, 30)))
    excess = both_toxic - both * expected
    out = np.where((both >= LEAST_DOCS) & (excess > 0), excess**2 / np.maximum(both * expected * (1 - expected), 1.0), 0.0)
    np.fill_diagonal(out, 0)
    return out


def _telling_pairs(rows: DataFrame, terms: list[int]) -> list[int]:
    """The terms of the pairs that tell the label together. The presence of the terms in the bounded sample is one bit
    matrix; each task counts the pairs of its documents, and the counts of all are added up."""
    if not terms:
        return []
    known, size = np.array(terms, np.int64), len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size, size), np.float32)
        n = np.zeros(2, np.int64)
        for batch in batches:
            here, toxic = np.zeros((batch.num_rows, size), np.float32), np.array(batch.column(1).to_pylist())
            for i, found in enumerate(batch.column(2).to_pylist()):
                here[i, np.isin(known, np.array(found, np.int64))] = 1
            for k, part in enumerate((here, here[toxic == 1])):
                sums[k] += part.T @ part
                n[k] += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([int(n[0])]), pa.array([int(n[1])]), pa.array([zlib.compress(sums.astype(np.uint16 if n[0] < 1 << 16 else np.uint32).tobytes(), 1)]), pa.array([2 if n[0] < 1 << 16 else 4])], ["n", "pos", "counts", "width"])

    small = rows.coalesce(PAIR_TASKS)
    total, n, pos = np.zeros((2, size, size), np.float64), 0, 0
    for r in small.mapInArrow(count, "n long, pos long, counts binary, width long").toLocalIterator():
        n, pos = n + r["n"], pos + r["pos"]
        total += np.frombuffer(zlib.decompress(r["counts"]), np.uint16 if r["width"] == 2 else np.uint32).reshape(2, size, size)
    chi = pair_chi(total[0], total[1], total[0].diagonal(), total[1].diagonal(), n, pos)
    return known[(chi >= PAIR_CHI).any(1)].tolist()


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Machine | None:
    """The machine fitted on the bounded sample of docs that have a label and are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = scratch.keep("sample", sample.select("doc_id", "toxic"))
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([term_hashes(t) for t in utf8(batch.column(1))], pa.list_(pa.int64()))], ["doc_id", "toxic", "terms"])

    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():  # reads ids only; texts move where it must be
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")
    rows = scratch.keep("terms", rows.mapInArrow(hashed, "doc_id long, toxic int, terms array<long>"))
    n, pos = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n:
        return None
    pos = pos or 0
    terms = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= LEAST_DOCS)
    # Chi-squared of the 2 x 2 table of presence and label.
    a, n_t = F.col("k").cast("double"), F.col("n").cast("double")
    numerator = n * F.pow(a * (n - pos) - (n_t - a) * pos, 2) / F.greatest(F.lit(1.0), F.lit(float(pos * (n - pos))))
    chi = numerator / F.greatest(F.lit(1.0), n_t * (n - n_t))
    best = terms.select("term", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "term").limit(features).collect()
    common = terms.where(F.col("n") <= MOST_SHARE * n).orderBy(F.desc("n"), "term").limit(PAIR_TERMS).collect()
    pairs = _telling_pairs(rows, sorted(r["term"] for r in common))
    hashes = np.array(sorted({r["term"] for r in best} | set(pairs)), np.int64)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(hashes, np.array(t, np.int64))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "places"])

    bounded = sorted((r["doc_id"], r["toxic"], r["places"]) for r in rows.mapInArrow(places, "doc_id long, toxic int, places array<int>").collect())
    return Machine(hashes, *fit([r[2] for r in bounded], [r[1] for r in bounded], len(hashes)))


def toxicity(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of docs."""
    if machine is None:
        out = texts(docs).select("doc_id", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(machine)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t) for t in utf8(batch.column(1))], pa.float64())], ["doc_id", "score"])

        out = map_batches(texts(docs), run, "doc_id long, score double")
    out = out.select(back_id(), "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those scored at the threshold or above, all columns as they were; documents do not move."""
    if machine is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t or b"") < threshold for t in utf8(batch.column(at))], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
