"""Named tools: the questions that an agent may ask about one repository, with their parameters.

A tool is a function of a repository's tables (files, symbols, file_edges, modules, as far as it needs them) and of its
parameters; ``call`` checks these against the declaration and fills in defaults.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import learning, modules, retrieval
from spindrift.sources import scan

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    run: Callable[..., DataFrame]
    required: tuple[str, ...]
    defaults: Mapping[str, Any]


TOOLS: dict[str, Tool] = {}


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    parameters = list(inspect.signature(f).parameters.values())[1:]
    required = tuple(p.name for p in parameters if p.default is p.empty)
    TOOLS[f.__name__] = Tool(f.__name__, inspect.getdoc(f) or "", f, required, {p.name: p.default for p in parameters if p.default is not p.empty})
    return f


def call(name: str, tables: Tables, arguments: Mapping[str, Any] | None = None) -> DataFrame:
    """The answer of a tool; an unknown tool, an unknown parameter or one that is missing raises."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    given, known = dict(arguments or {}), TOOLS[name]
    if missing := [p for p in known.required if p not in given]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    if unknown := sorted(set(given) - set(known.required) - set(known.defaults)):
        raise ValueError(f"{name} takes no {', '.join(unknown)}")
    return known.run(tables, **{**known.defaults, **given})


@tool
def search_code(tables: Tables, query: str, top_k: int = 5) -> DataFrame:
    """The files that hold the words of the query most often."""
    return retrieval.keyword_search(tables["files"], "path", "content", query, top_k)


@tool
def get_file_content(tables: Tables, file_path: str) -> DataFrame:
    """A file and its symbols."""
    own = tables["symbols"].where(F.col("file_path") == file_path)
    listed = own.agg(F.array_sort(F.collect_list(F.struct("line_start", "name", "kind"))).alias("symbols"))
    return tables["files"].where(F.col("path") == file_path).select("path", "content").crossJoin(listed)  # one row


@tool
def get_file_chunk(tables: Tables, file_path: str, offset: int = 1, limit: int = 200) -> DataFrame:
    """Some lines of a file."""
    return tables["files"].where(F.col("path") == file_path).select("path", text.line_slice(F.col("content"), offset, limit).alias("s")).select("path", "s.*")


@tool
def search_in_file(tables: Tables, file_path: str, query: str, context: int = 2, limit: int = 20, case_sensitive: bool = False, use_regex: bool = False) -> DataFrame:
    """The lines of a file that hold the query, with some around."""
    return text.search_lines(tables["files"].where(F.col("path") == file_path), "path", "content", query, context, limit, case_sensitive, use_regex)


@tool
def get_file_tree(tables: Tables) -> DataFrame:
    """Files and directories in order."""
    return scan.browse_tree(tables["files"].select("path", "size")).orderBy(*scan.tree_order())


@tool
def search_symbols(tables: Tables, query: str, kind: str = "") -> DataFrame:
    """Symbols whose name holds the query, whatever its case."""
    hits = tables["symbols"].where(F.lower("name").contains(query.lower()))
    return hits.where(F.col("kind") == kind) if kind else hits


@tool
def get_symbol_definition(tables: Tables, symbol_id: str) -> DataFrame:
    """Where a symbol is defined."""
    return tables["symbols"].where(F.col("id").cast("string") == str(symbol_id))


@tool
def get_file_outline(tables: Tables, file_path: str) -> DataFrame:
    """The symbols of a file in order, methods below their class."""
    return learning.outline(tables["symbols"].where(F.col("file_path") == file_path)).orderBy("line_start", "id")


@tool
def get_project_summary(tables: Tables) -> DataFrame:
    """One row: files, their size, symbols, languages."""
    sizes = tables["files"].agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.array_sort(F.collect_set("language")).alias("languages"))
    return sizes.crossJoin(tables["symbols"].agg(F.count(F.lit(1)).alias("n_symbols")))  # one row each


@tool
def get_modules(tables: Tables) -> DataFrame:
    """The directories with the number of files in and below them."""
    return modules.path_tree(tables["files"])


@tool
def get_dependencies(tables: Tables, file_path: str = "") -> DataFrame:
    """Distinct edges between files, of one file or of all."""
    edges = tables["file_edges"].select("src_path", "dst_path").distinct()
    return edges.where((F.col("src_path") == file_path) | (F.col("dst_path") == file_path)) if file_path else edges


@tool
def get_entry_points(tables: Tables) -> DataFrame:
    """The files that look like entry points."""
    return learning.entry_points(tables["symbols"], tables["file_edges"])


@tool
def get_learning_path(tables: Tables) -> DataFrame:
    """The files in the order in which they are best read."""
    return learning.reading_order(tables["symbols"], tables["file_edges"])
