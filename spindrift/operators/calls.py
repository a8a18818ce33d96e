"""Calls of outside models as table functions: a callable is given, rows and their usage come back.

A callable takes a list of texts and the name of a model and gives as many (answer, prompt tokens, completion tokens);
token counts of None are estimated. It runs in the tasks, batch by batch, so it must be serialisable; what it raises is
tried again and then, with the next model, and in the end is a row with its error: one bad batch does not end a job.
A task that is lost is run again and then calls again; write results before what follows reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.text import chunk_rows
from spindrift.operators.relational import reuse_vectors

Call = Callable[[list[str], str], list[tuple]]
#: Texts in one call, and how often a model is tried.
BATCH, TRIES = 16, 3


def _tried(call: Call, texts: list[str], models: tuple[str, ...], tries: int) -> tuple[list[tuple] | None, str, int, str | None]:
    error, n = None, 0
    for model in models:
        for _ in range(tries):
            n += 1
            try:
                found = call(texts, model)
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} answers to {len(texts)} texts")
                return found, model, n, None
            except Exception as e:  # the callable is not ours; its failure is a result
                error = f"{type(e).__name__}: {e}"[:500]
    return None, models[-1], n, error


def _called(rows: DataFrame, key: str, text: str, call: Call, models: tuple[str, ...], tries: int, batch: int, answer: str, kind: pa.DataType) -> DataFrame:
    own = dict(rows.dtypes)[key]
    schema = f"{key} {own}, answer {answer}, model string, prompt_tokens long, completion_tokens long, is_estimated boolean, attempts int, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [None, kind, pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                piece = part.slice(at, batch)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                found, model, n, error = _tried(call, texts, models, tries)
                out = []
                for i, t in enumerate(texts):
                    result, prompt, completion = found[i] if found else (None, 0, 0)
                    guess = prompt is None or completion is None
                    length = len(result) if isinstance(result, str) else 0
                    out.append((result, model, len(t) // 4 if prompt is None else prompt, length // 4 if completion is None else completion, guess, n, error))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array([r[k] for r in out], types[k + 1]) for k in range(7))], names)

    return rows.select(key, text).mapInArrow(run, schema)


def complete(prompts: DataFrame, key: str, prompt: str, call: Call, models: tuple[str, ...] = ("",), tries: int = TRIES, batch: int = BATCH) -> DataFrame:
    """key, answer, model, prompt_tokens, completion_tokens, is_estimated, attempts, error for each prompt; models are
    tried in turn, each some times."""
    return _called(prompts, key, prompt, call, models, tries, batch, "string", pa.string())


def embed_with(docs: DataFrame, key: str, text: str, call: Call, model: str = "", tries: int = TRIES, batch: int = BATCH) -> DataFrame:
    """key, vector, prompt_tokens, is_estimated, error for each text."""
    out = _called(docs, key, text, call, (model,), tries, batch, "array<float>", pa.list_(pa.float32()))
    return out.select(key, F.col("answer").alias("vector"), "prompt_tokens", "is_estimated", "error")


def usage_rows(calls: DataFrame, repo_id: Column, kind: str, source: str, now: Column) -> DataFrame:
    """A row of token usage for each call that went well."""
    completion = F.col("completion_tokens") if "completion_tokens" in calls.columns else F.lit(0).cast("long")
    return calls.where("error IS NULL").select(repo_id.alias("repo_id"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), "prompt_tokens", completion.alias("completion_tokens"), (F.col("prompt_tokens") + completion).alias("total_tokens"), "is_estimated", now.alias("created_at"))


def read_through(wanted: DataFrame, cache: DataFrame, keys: list[str], value: str, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The wanted rows with their value, from the cache or, where it has none, made; and the cache with what was made.

    make takes the rows that miss and gives keys and value; write what it gives before using both results, or it runs
    twice."""
    known = cache.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).select(*keys, value)
    misses = wanted.join(known.select(*keys), keys, "left_anti")
    made = make(misses).select(*keys, value).where(F.col(value).isNotNull())
    every = known.unionByName(made)
    return wanted.join(every, keys, "left"), cache.select(*keys, value).join(made.select(*keys), keys, "left_anti").unionByName(made)


def rebuild_index(documents: DataFrame, cached: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, path, chunk_no, text, vector, is_new of all chunks of documents (path, text): vectors of the cache (id, text,
    vector) are used again where id and text are equal, others are made by embed (id, text to id, vector)."""
    chunks = chunk_rows(documents, "path", "text")
    looked_up = reuse_vectors(chunks, cached.dropDuplicates(["id", "text"]))
    made = embed(looked_up.where("to_embed").select("id", "text")).select("id", F.col("vector").alias("made"))
    out = looked_up.join(made, "id", "left")
    return out.select("id", "path", "chunk_no", "text", F.coalesce("vector", "made").alias("vector"), F.col("to_embed").alias("is_new"))


def symbol_sources(symbols: DataFrame, files: DataFrame, around: int = 0) -> DataFrame:
    """id, name, kind, file_path, source: the lines of each symbol, with some around, as an explanation is asked for.
    symbols: id, name, kind, file_path, line_start, line_end; files: path, content. Unknown files give null."""
    lines = files.select(F.col("path").alias("file_path"), F.split("content", "\n", -1).alias("_lines"))
    first = F.greatest(F.lit(1), F.col("line_start") - around)
    last = F.least(F.size("_lines"), F.col("line_end") + around)
    piece = F.array_join(F.slice("_lines", first, F.greatest(F.lit(0), last - first + 1)), "\n")
    return symbols.join(lines, "file_path", "left").select("id", "name", "kind", "file_path", F.when(F.col("_lines").isNotNull(), piece).alias("source"))


def clustered(components: DataFrame, tokens: int, limit: int, propose: Callable[[DataFrame], DataFrame], fallback: Callable[[DataFrame], DataFrame], tries: int = TRIES) -> DataFrame:
    """cluster, id of components (id, path): none below the limit of tokens; else what propose gives once it names at
    least two clusters of known components, tried some times; else the fallback."""
    if tokens <= limit:
        return fallback(components.limit(0))
    for _ in range(tries):
        proposed = propose(components).join(components.select("id"), "id", "left_semi").select("cluster", "id")
        first = proposed.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("cluster"))).where("_n = 1").drop("_n")
        if first.select("cluster").distinct().limit(2).count() == 2:
            return first
    return fallback(components)


def documented(nodes: DataFrame, prompt: Callable[[DataFrame, DataFrame | None], DataFrame], answer: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], depth: int = 2) -> DataFrame:
    """module_id, content of modules (module_id, parent_id, depth) down to a depth, children before their parents.

    prompt gives (module_id, prompt) for the modules of a level, with the documents of the level below; answer turns these
    into (module_id, content); keep writes a level before the next one reads it.
    """
    done: DataFrame | None = None
    below: DataFrame | None = None
    for level in range(depth, -1, -1):
        asked = prompt(nodes.where(F.col("depth") == level), below)
        below = keep(answer(asked).select("module_id", "content"))
        done = below if done is None else done.unionByName(below)
    return done


def remaining(order: DataFrame, done: DataFrame) -> DataFrame:
    """Modules (prefix, position) that have no document yet, in processing order, with the share of all that is done
    before each of them."""
    n = order.agg(F.count(F.lit(1)).alias("_n"))
    left = order.join(done.select("prefix"), "prefix", "left_anti").crossJoin(F.broadcast(n))  # one row
    return left.select("prefix", "position", ((F.col("position") - 1) / F.col("_n")).alias("progress"))
