"""Parsing as table functions: files in, symbol, relationship, import and error rows out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.graph import Rounds, some
from spindrift.sources.parsers import java, lexical
from spindrift.sources.parsers import python as python_parser
from spindrift.sources.parsers.rows import Parsed

Parser = Callable[[str, str], Parsed]
#: Language to (parser, fidelity); put other parsers in to replace these.
REGISTRY: dict[str, tuple[Parser, str]] = {"python": (python_parser.parse, "exact")} | {name: (lambda path, source, n=name: lexical.parse(path, source, n), "lexical") for name in lexical.LANGUAGES}

#: Kinds of symbols that have methods.
TYPE_KINDS = ("class", "interface", "enum", "record", "struct")
SCHEMA = (
    "record string, path string, language string, fidelity string, pos int, id string, name string, kind string, line_start int, line_end int, source_code string, "
    "has_docstring boolean, parameters array<string>, caller string, callee string, is_resolved boolean, module string, error string, scope_start int, scope_end int"
)
RECORDS = ("symbol", "relationship", "import", "site", "variable", "error")
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: Files that a worker is given at a time, their bytes, and rows and characters of source that it gives back at a time.
FILES_AT_ONCE, BYTES_AT_ONCE, ROWS_AT_ONCE, SOURCE_AT_ONCE = 64, 8 << 20, 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Workers get a few files at a time: files are far longer than the rows that the default of 10,000 a batch is meant for."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", FILES_AT_ONCE), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)):
        now = int(re.sub(r"\D*$", "", spark.conf.get(key)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def _in_slices(rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded size, so a long file is not given back at once."""
    names, types = zip(*((n, _TYPES[t]) for n, t in (x.split() for x in schema.split(", "))), strict=True)
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in zip(names, types, strict=True)], list(names))

    for row in rows:
        held.append(row)
        size += len(row.get("source_code") or "")
        if len(held) >= ROWS_AT_ONCE or size >= SOURCE_AT_ONCE:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def parse_files(files: DataFrame, registry: dict[str, tuple[Parser, str]] | None = None, records: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each symbol, relationship, import, call site and variable of the files (path, language, content), told
    apart by record. A call site (in Java and C#) is a call of a method on a name, at its place in the file; a variable is a
    name with its type and the places between which it holds.

    A file that cannot be parsed gives one row with its error; a language without a parser gives none. With records or columns
    workers give back only these.
    """
    known, wanted = registry or REGISTRY, frozenset(records or RECORDS)
    schema = ", ".join(x for x in SCHEMA.split(", ") if not columns or x.split()[0] in columns)

    def rows_of(path: str, language: str, content: str) -> Iterator[dict]:
        parser, fidelity = known[language]
        base = {"path": path, "language": language, "fidelity": fidelity}
        try:
            parsed = parser(path, content)
        except Exception as error:  # one bad file must not end the scan
            if "error" in wanted:
                yield base | {"record": "error", "error": f"{type(error).__name__}: {error}"[:500]}
            return
        for i, s in enumerate(parsed.symbols if "symbol" in wanted else ()):
            yield base | dict(zip(("id", "name", "kind", "line_start", "line_end", "source_code", "has_docstring", "parameters"), s, strict=True)) | {"record": "symbol", "pos": i}
        for i, r in enumerate(parsed.relationships if "relationship" in wanted else ()):
            yield base | dict(zip(("caller", "callee", "line_start", "kind", "is_resolved"), r, strict=True)) | {"record": "relationship", "pos": i}
        for i, m in enumerate(parsed.imports if "import" in wanted else ()):
            yield base | dict(zip(("name", "id", "module", "callee", "line_start"), m, strict=True)) | {"record": "import", "pos": i}
        for s in parsed.sites if "site" in wanted else ():
            yield base | dict(zip(("pos", "caller", "callee", "name", "line_start", "is_resolved"), s, strict=True)) | {"record": "site"}
        for v in parsed.variables if "variable" in wanted else ():
            yield base | dict(zip(("name", "callee", "scope_start", "scope_end"), v, strict=True)) | {"record": "variable"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = (tuple(v.as_py() for v in x) for x in zip(*(batch.column(k) for k in range(3)), strict=True))
            yield from _in_slices((r for p, lang, c in files if lang in known for r in rows_of(p, lang, c or "")), schema)

    bounded_batches(files.sparkSession)
    return files.select("path", "language", "content").mapInArrow(run, schema)


def symbols(parsed: DataFrame) -> DataFrame:
    columns = ["path", "language", "fidelity", "pos", "id", "name", "kind", "line_start", "line_end", "source_code", "has_docstring", "parameters"]
    return parsed.where("record = 'symbol'").select(*columns)


def relationships(parsed: DataFrame) -> DataFrame:
    """path, caller, callee, line, rel_type, is_resolved, language; of equal pairs the first in a file."""
    rows = parsed.where("record = 'relationship'").select("path", "language", "pos", "caller", "callee", F.col("line_start").alias("line"), F.col("kind").alias("rel_type"), "is_resolved")
    first = rows.groupBy("path", "caller", "callee").agg(F.min(F.struct("pos", "line", "rel_type", "is_resolved", "language")).alias("x"))
    return first.select("path", "caller", "callee", "x.line", "x.rel_type", "x.is_resolved", "x.pos", "x.language")


def imports(parsed: DataFrame) -> DataFrame:
    """path, local, full_path, module, imported, line."""
    return parsed.where("record = 'import'").select("path", "language", F.col("name").alias("local"), F.col("id").alias("full_path"), "module", F.col("callee").alias("imported"), F.col("line_start").alias("line"))


def receiver_types(parsed: DataFrame) -> DataFrame:
    """path, language, at, caller, receiver, method, line, type: the type of what each call site is called on.

    A site and a variable meet by file and name; of the scopes that the site lies in the innermost counts, that is the one that
    starts last. A name without a variable that is a type of the file is that type.
    """
    sites = parsed.where("record = 'site'").select("path", "language", F.col("pos").alias("at"), "caller", F.col("callee").alias("receiver"), F.col("name").alias("method"), F.col("line_start").alias("line"), F.col("is_resolved").alias("is_type"))
    scopes = parsed.where("record = 'variable'").select(F.col("path").alias("_path"), F.col("name").alias("_name"), F.col("callee").alias("type"), "scope_start", "scope_end")
    # A scope lies in at most two cells of its own level, whose length is the power of two from its length on; a site is looked
    # up in its cell of each level that scopes of the name have. So not every site of a name meets every scope of it.
    scopes = scopes.where("scope_end > scope_start").withColumn("_level", F.length(F.bin(F.col("scope_end") - F.col("scope_start"))).cast("int"))
    cell = lambda at, level: F.floor(F.col(at) / F.pow(F.lit(2.0), F.col(level))).cast("long")
    levels = scopes.select(F.col("_path").alias("path"), F.col("_name").alias("receiver"), F.col("_level").alias("level")).distinct()
    dealt = scopes.withColumn("_last", F.col("scope_end") - 1).withColumn("_cell", F.explode(F.array_distinct(F.array(cell("scope_start", "_level"), cell("_last", "_level")))))
    asked = sites.join(levels, ["path", "receiver"], "left").withColumn("cell", cell("at", "level"))
    at = F.col("at")
    within = (F.col("path") == F.col("_path")) & (F.col("receiver") == F.col("_name")) & (F.col("level") == F.col("_level")) & (F.col("cell") == F.col("_cell")) & (at >= F.col("scope_start")) & (at < F.col("scope_end"))
    keys = ["path", "language", "at", "caller", "receiver", "method", "line", "is_type"]
    found = asked.join(dealt, within, "left").groupBy(*keys).agg(F.max_by("type", F.struct("scope_start", "type")).alias("type"))
    return found.withColumn("type", F.coalesce("type", F.when(F.col("is_type") | F.col("receiver").rlike("^[A-Z]"), F.col("receiver")))).where("type IS NOT NULL").drop("is_type")


def receiver_calls(parsed: DataFrame) -> DataFrame:
    """path, caller, callee, line, is_resolved: calls on a name, resolved by the type of that name across files.

    A type is looked for in the file, then among its imports, then in its folder, and then anywhere, if only one has the name.
    The method is that of the class, or of the nearest class that it inherits from; without one the callee is the class.
    """
    rounds = Rounds(parsed.sparkSession)
    parsed = rounds.keep(parsed.withColumn("source_code", F.lit(None).cast("string")))
    known = symbols(parsed)
    classes = known.where(F.col("kind").isin(*TYPE_KINDS)).groupBy("language", F.col("name").alias("type"), F.col("path").alias("of")).agg(F.min("id").alias("class"))
    imported = imports(parsed).select("path", F.col("local").alias("type"), "full_path").distinct()
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    tried = receiver_types(parsed).join(classes, ["language", "type"]).join(imported, ["path", "type"], "left")
    by_import = F.concat(F.lit("."), F.col("class")).endswith(F.concat(F.lit("."), F.col("full_path"), F.lit("."), F.col("type")))
    rank = F.when(F.col("of") == F.col("path"), 0).when(F.coalesce(by_import, F.lit(False)), 1).when(folder("of") == folder("path"), 2).otherwise(3)
    one = tried.groupBy("path", "at", "caller", "method", "line").agg(F.min(F.struct(rank.alias("rank"), F.col("class"))).alias("best"), F.count_distinct("class").alias("n"))
    sites = rounds.keep(one.where("best.rank < 3 OR n = 1").select("path", "at", "caller", "method", "line", F.col("best.class").alias("class")))
    methods = rounds.keep(known.where("kind = 'method'").select(F.col("id").alias("callee")).distinct())
    bases = relationships(parsed).where("rel_type = 'inherit'").select("path", F.col("caller").alias("class"), F.col("callee").alias("base"))
    ids = known.where(F.col("kind").isin(*TYPE_KINDS)).select("id", "name")
    unique = ids.groupBy(F.col("name").alias("base")).agg(F.min("id").alias("only"), F.count_distinct("id").alias("n")).where("n = 1").select("base", "only")
    full = F.explode(F.array("full_path", F.concat_ws(".", "full_path", "base"))).alias("id")
    by_import = bases.join(imported.withColumnRenamed("type", "base"), ["path", "base"]).select("class", "base", full).join(ids.select("id").distinct(), "id").groupBy("class", "base").agg(F.min("id").alias("named"))
    up = bases.join(ids.select(F.col("id").alias("base")).distinct().withColumn("same", F.lit(True)), "base", "left").join(unique, "base", "left").join(by_import, ["class", "base"], "left")
    up = rounds.keep(up.select("class", F.when(F.col("same"), F.col("base")).otherwise(F.coalesce("named", "only")).alias("base")).where("base IS NOT NULL AND base <> class").distinct())
    done, level = None, sites.withColumn("at_class", F.col("class"))
    seen = rounds.keep(level.select("path", "at", "at_class"))
    while some(level):  # a round for each step up the hierarchy
        hit = level.withColumn("callee", F.concat("at_class", F.lit("."), "method")).join(methods, "callee", "left_semi")
        hit = rounds.keep(hit.groupBy("path", "at", "caller", "line").agg(F.min("callee").alias("callee")))
        done = hit if done is None else done.unionByName(hit)
        left = level.join(hit.select("path", "at"), ["path", "at"], "left_anti")
        above = left.join(up.withColumnRenamed("class", "at_class"), "at_class").drop("at_class").withColumnRenamed("base", "at_class").distinct()
        level = rounds.keep(above.join(seen, ["path", "at", "at_class"], "left_anti"))
        seen = seen.unionByName(level.select("path", "at", "at_class"))
    if done is None:
        done = sites.select("path", "at", "caller", "line", F.col("class").alias("callee"))
    resolved = done.select("path", "at", "callee").withColumn("is_resolved", F.lit(True))
    out = sites.join(resolved, ["path", "at"], "left")
    return out.select("path", "caller", F.coalesce("callee", "class").alias("callee"), "line", F.coalesce("is_resolved", F.lit(False)).alias("is_resolved")).distinct()


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("record = 'error'").select("path", "language", "error")


OUTLINE = "record string, path string, pos int, kind string, name string, line_start int, line_end int, container string, target string"


def outlines(files: DataFrame, across: bool = False) -> DataFrame:
    """Rows of the small outlines of Python and Java files (path, language, content): symbols (kind, name, lines, container),
    imports (name, line) and edges between names of one file (container, target, kind), told apart by record; across: edges
    to names of other files too, for :func:`package_edges`. A file that cannot be parsed gives one row with record error."""

    def rows_of(path: str, language: str, content: str) -> Iterator[dict]:
        try:
            if language == "java":
                symbols, imported = java.outline(content)
                edges = java.symbol_edges(content, across)
            else:
                symbols, edges = python_parser.outline(content), python_parser.symbol_edges(content, across)
                imported = [(module, line) for _, _, module, _, line in python_parser.parse(path, content).imports]
        except Exception as error:  # one bad file must not end the scan
            yield {"record": "error", "path": path, "name": f"{type(error).__name__}: {error}"[:500]}
            return
        for i, (kind, name, first, last, container) in enumerate(symbols):
            yield {"record": "symbol", "path": path, "pos": i, "kind": kind, "name": name, "line_start": first, "line_end": last, "container": container}
        for i, (name, line) in enumerate(imported):
            yield {"record": "import", "path": path, "pos": i, "name": name, "line_start": line}
        for i, (container, target, kind) in enumerate(edges):
            yield {"record": "edge", "path": path, "pos": i, "kind": kind, "container": container, "target": target}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = (tuple(v.as_py() for v in x) for x in zip(*(batch.column(k) for k in range(3)), strict=True))
            yield from _in_slices((r for p, lang, c in files if lang in ("python", "java") for r in rows_of(p, lang, c or "")), OUTLINE)

    bounded_batches(files.sparkSession)
    return files.select("path", "language", "content").mapInArrow(run, OUTLINE)


def package_edges(files: DataFrame) -> DataFrame:
    """path, container, target, kind of edges between names of one package: those of Python and Java files of one folder and
    extension."""
    found = outlines(files, across=True).where("record IN ('symbol', 'edge')").withColumn("package", F.regexp_replace("path", r"[^/]*(?=\.[^./]*$)", ""))
    found = Rounds(files.sparkSession).keep(found.select("record", "path", "package", "name", "container", "target", "kind"))
    names = found.where("record = 'symbol'").select("package", F.col("name").alias("target")).distinct()
    return found.where("record = 'edge'").join(names, ["package", "target"], "left_semi").select("path", "container", "target", "kind")


def summary(parsed: DataFrame) -> DataFrame:
    """One row: files with symbols, symbols, relationships, languages."""
    return parsed.agg(
        F.count_distinct(F.when(F.col("record") == "symbol", F.col("path"))).alias("n_files"), F.count_if(F.col("record") == "symbol").alias("n_symbols"),
        F.count_if(F.col("record") == "relationship").alias("n_relationships"), F.array_sort(F.collect_set("language")).alias("languages"))


def import_edges(imported: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst between files: a Python module is its file or its package's, a Java class its file."""
    slashed = F.replace("full_path", F.lit("."), F.lit("/"))
    of_module = F.replace("module", F.lit("."), F.lit("/"))
    python = F.array(F.concat(slashed, F.lit(".py")), F.concat(slashed, F.lit("/__init__.py")), F.concat(of_module, F.lit(".py")), F.concat(of_module, F.lit("/__init__.py")))
    candidates = F.when(F.col("language") == "python", python).when(F.col("language") == "java", F.array(F.concat(slashed, F.lit(".java"))))
    tried = imported.where(candidates.isNotNull()).select(F.col("path").alias("src"), "line", F.posexplode(candidates).alias("step", "dst"))
    hits = tried.join(files.select(F.col("path").alias("dst")), "dst").where("src <> dst")
    return hits.groupBy("src", "line").agg(F.min_by("dst", "step").alias("dst")).select("src", "dst").distinct()
