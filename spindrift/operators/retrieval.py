"""Vector, keyword and rank-fused search, embeddings and token-budgeted context."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import misc
from spindrift.functions.text import tokens
from spindrift.operators.relational import budget_prefix, top_k
from spindrift.operators.vectors import VectorIndex

DIMENSIONS = 384
WEIGHTS = (0.7, 0.3)


def hash_embedding(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector drawn with the text's hash as seed."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(dimensions)
    return (v / np.linalg.norm(v)).astype(np.float32)


def embed(docs: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, vector; null text is empty."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for batch in batches:
            vectors = [hash_embedding(t or "", dimensions) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, "vector"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<float>")


def vector_search(index: DataFrame, key: str, vector: str, query: list[float], k: int = 8) -> DataFrame:
    """key, score, rank: the k largest inner products with the query; all of them if there are fewer."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = index.select(key, misc.dot(F.col(vector), q).alias("score"))
    return top_k(scored, [F.desc("score"), F.col(key)], k)


def vector_join(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 8) -> DataFrame:
    """query, key, score, rank for a table of queries (key, vector): the k largest products of each with all rows.

    The index is built for this join; who asks more often keeps a :class:`~spindrift.operators.vectors.VectorIndex`.
    """
    return VectorIndex.build(index, key, vector).join(queries, key, vector, k)


def keyword_score(low: Column, query: str) -> Column:
    """For each term of the query: its occurrences, and a half more if it starts the text or a line. low is in lower case.

    Occurrences come from lengths in bytes, which a string knows, and not in characters, which it has to count."""
    out = F.lit(0.0)
    for term in query.lower().split():
        n = (F.octet_length(low) - F.octet_length(F.replace(low, F.lit(term), F.lit("")))) / len(term.encode())
        starts = low.startswith(term) | low.contains(f"\n{term}")
        out = out + F.when(low.contains(term), n + F.when(starts, 0.5).otherwise(0.0)).otherwise(0.0)
    return out


def keyword_search(docs: DataFrame, key: str, text: str, query: str, k: int = 8) -> DataFrame:
    """key, score, rank of the k best texts with a score.

    A text has a score if it holds a term; to ask for that and not for the score keeps the filter cheap, as a filter is
    moved below the score and would compute it a second time."""
    low = docs.select(key, F.lower(text).alias("_low"))
    terms = query.lower().split()
    some = functools.reduce(lambda a, b: a | b, [F.col("_low").contains(t) for t in terms], F.lit(False))
    scored = low.where(some).select(key, keyword_score(F.col("_low"), query).alias("score"))
    return top_k(scored, [F.desc("score"), F.col(key)], k)


def fuse(semantic: DataFrame, keyword: DataFrame, key: str, k: int = 8, weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """key, score, rank: weighted sums of reciprocal ranks of two ranked lists."""
    part = lambda df, w: df.select(key, (F.lit(w) / F.col("rank")).alias("part"))
    both = part(semantic, weights[0]).unionAll(part(keyword, weights[1])).groupBy(key).agg(F.sum("part").alias("score"))
    return top_k(both, [F.desc(F.round("score", 9)), F.col(key)], k)


def search(docs: DataFrame, vectors: DataFrame, key: str, text: str, vector: str, query: str, query_vector: list[float], mode: str = "hybrid", k: int = 8) -> DataFrame:
    """Keyword, semantic or hybrid search; hybrid fuses twice as many hits of each."""
    if mode == "keyword":
        return keyword_search(docs, key, text, query, k)
    if mode == "semantic":
        return vector_search(vectors, key, vector, query_vector, k)
    return fuse(vector_search(vectors, key, vector, query_vector, 2 * k), keyword_search(docs, key, text, query, 2 * k), key, k)


def evidence(hits: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One row: texts of the hits in order of rank, and their citations."""
    joined = hits.select(key, "rank").join(chunks, key)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", "citations")))
    return joined.agg(F.transform(ordered, lambda x: x["text"]).alias("texts"), F.flatten(F.transform(ordered, lambda x: x["citations"])).alias("citations"))


def smart_context(hits: DataFrame, chunks: DataFrame, key: str, max_tokens: int = 8000) -> DataFrame:
    """key, rank, running_tokens, block: hits in order of rank while their tokens stay within the budget."""
    rows = hits.select(key, "rank", "score").join(chunks.select(key, "text"), key)
    kept = budget_prefix(rows, tokens(F.col("text")), ["rank"], max_tokens)
    return kept.select(key, "rank", "running_tokens", F.format_string("[%s] score=%.3f\n%s", F.col(key).cast("string"), "score", "text").alias("block"))


def export_files(files: DataFrame, max_tokens: int, style: str = "xml") -> DataFrame:
    """path, running_tokens, block: files in order of path while their tokens stay within the budget, in one of three
    styles (xml, markdown, json); any other name is xml."""
    kept = budget_prefix(files.select("path", "language", "content"), tokens(F.col("content")), ["path"], max_tokens)
    if style == "markdown":
        block = F.concat(F.lit("### "), "path", F.lit("\n\n```"), "language", F.lit("\n"), "content", F.lit("\n```\n"))
    elif style == "json":
        block = F.to_json(F.struct("path", "language", "content"))
    else:
        block = F.concat(F.lit('<file path="'), "path", F.lit('">\n'), "content", F.lit("\n</file>\n"))
    return kept.select("path", "running_tokens", block.alias("block"))


def select_files(files: DataFrame, paths: list[str] | None = None, module_files: DataFrame | None = None, not_code: tuple[str, ...] = ()) -> DataFrame:
    """Named files, else those of the module documents, else all of code languages."""
    if paths:
        return files.where(F.col("path").isin(*paths))
    if module_files is not None:
        return files.join(module_files.select("path").distinct(), "path", "left_semi")
    return files.where(~F.coalesce(F.col("language").isin(*not_code), F.lit(False)))


def component_sources(wanted: DataFrame, components: DataFrame) -> DataFrame:
    """id, source of wanted components, with a mark for unknown ones."""
    return wanted.select("id").join(components.select("id", "source_code"), "id", "left").select("id", F.coalesce("source_code", F.concat(F.lit("# component not found: "), F.col("id").cast("string"))).alias("source"))
