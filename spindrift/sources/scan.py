"""Sources and sinks: source trees as file tables, tree rows, census, JSON and index tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.paths import BROWSE_EXTENSIONS, CODE_EXTENSIONS, PARSED, basename, dirname, excluded, extension, included, language
from spindrift.operators.graph import Rounds, some
from spindrift.operators.relational import prefixes

# Names that a scan leaves out, beside what a caller adds.
EXCLUDE = (
    ".github", ".vscode", ".git", ".gitignore", ".gitmodules", "examples",
    "*.pyc", "*.pyo", "*.pyd", "__pycache__", ".pytest_cache", ".coverage", ".tox", ".nox", ".mypy_cache", ".ruff_cache", ".hypothesis", "poetry.lock", "Pipfile.lock",
    "package-lock.json", "yarn.lock", ".npm", ".yarn", ".pnpm-store", "bun.lock", "bun.lockb",
    "*.class", "*.jar", "*.war", "*.ear", "*.nar", ".gradle/", ".settings/", ".classpath", "gradle-app.setting", "*.gradle", ".project",
    "*.o", "*.obj", "*.dll", "*.dylib", "*.exe", "*.lib", "*.out", "*.a", "*.pdb",
    "*.suo", "*.user", "*.userosscache", "*.sln.docstates", "*.nupkg", "bin/",
    ".svn", ".hg", ".gitattributes",
    "*.svg", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.pdf", "*.mov", "*.mp4", "*.mp3", "*.wav",
    "venv", ".venv", "env", ".env", "virtualenv", ".idea", ".vs", "*.swo", "*.swn", "*.sublime-*",
    "*.log", "*.bak", "*.swp", "*.tmp", "*.temp", ".cache", ".sass-cache", ".DS_Store", "Thumbs.db", "desktop.ini",
    "*.egg-info", "*.egg", "*.whl", "*.so", ".docusaurus", "*.min.js", "*.min.css", "*.map", ".terraform", "*.tfstate*",
    "digest.txt", "*.ini", "tests", "test", "Tests", "Test", "Examples",
)
#: Names that a scan takes (fixed values); a caller's list replaces them.
INCLUDE = [
    "*.py", "*.js", "*.ts", "*.jsx", "*.tsx", "*.java", "*.cpp", "*.c", "*.h", "*.cs", "*.go", "*.rs", "*.php", "*.rb", "*.swift", "*.kt", "*.scala",
    "*.clj", "*.hs", "*.ml", "*.html", "*.css", "*.scss", "*.sass", "*.json", "*.yaml", "*.yml", "*.xml", "*.md", "*.txt", "*.toml", "*.cfg", "*.ini",
]
#: Names that browsing leaves out (fixed values), beside those that start with a dot.
HIDDEN = ("__pycache__", "node_modules", "*.pyc", "*.pyo", "*.class", "dist", "build", "__MACOSX", "venv", "env")
READMES = ("README.md", "README.rst", "README.txt", "README")
#: Files that are named at a time, and bytes of files that are given back at a time, or one file.
FILES_AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20
#: Names that Hadoop has for stores that pyarrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """path (relative), name, language, size, content of the files below root: a caller's include list replaces the
    usual one, excludes are added to it. Files that are left out are not opened. Bytes that are no UTF-8 become replacement characters. With max_files the
    first ones in order of path. Below a root on a file system of this kind of links, what a symbolic link leads to is
    left out, whether within the root or beyond. A directory without files has no row."""
    root = _absolute(root)
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    # Files are chosen by their names alone, before any is opened.
    p = F.col("path")
    chosen = listed(spark, root).where(~excluded(p, [*EXCLUDE, *(exclude or [])]) & included(p, INCLUDE if include is None else include))
    if max_files is not None:
        chosen = chosen.orderBy("path").limit(max_files)

    def read(batches):
        store, base = _store(root)
        for batch in batches:
            rows, held = [], 0
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size > most:
                    raise ValueError(f"{path} has {size} bytes, more than the max length of {most} that spark.sql.sources.binaryFile.maxLength sets")
                with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                    rows.append((path, size, f.read()))
                held += size
                if held >= BYTES_AT_ONCE:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    rows = chosen.select("path", "size").mapInArrow(read, "path string, size long, content binary")
    return rows.select("path", basename(p).alias("name"), language(p).alias("language"), "size", safe_text(F.col("content")).alias("content"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "size", "content"])


def _absolute(root: str) -> str:
    """A local root as the driver sees it; others as they are."""
    return os.path.abspath(re.sub("^/+", "/", root.removeprefix("file:"))) if "://" not in root or root.startswith("file:") else root


def _store(root: str):
    """pyarrow's file system of an absolute root, and the root's path in it."""
    import pyarrow.fs as pafs

    scheme, mark, rest = root.partition("://")
    if not mark:
        return pafs.LocalFileSystem(), root
    store, base = pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{quote(rest)}")
    return store, base.rstrip("/")


def _inside(store, base: str, folder: str) -> Iterator[tuple[str, bool, int]]:
    """name, whether it is a folder, and size of what a folder holds, without links and without names that Spark takes for hidden."""
    import pyarrow.fs as pafs

    if isinstance(store, pafs.LocalFileSystem):
        with os.scandir(f"{base}/{folder}") as found:
            every = [(e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False).st_size if e.is_file(follow_symlinks=False) else 0) for e in found if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)]
    else:
        every = [(e.base_name, e.type == pafs.FileType.Directory, e.size or 0) for e in store.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/")))]
    for name, is_folder, size in every:
        if not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")):
            yield name, is_folder, size


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size of the files below root, without empty ones. Folders are listed by tasks, a job for each level of them, and the list is
    a table: the driver holds no row for a file, which Spark's file sources do."""
    rounds, root = Rounds(spark), _absolute(root)

    def look(batches):
        store, base = _store(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = [(f"{folder}/{name}" if folder else name, size, is_folder) for name, is_folder, size in _inside(store, base, folder)]
                for k in range(0, len(rows), FILES_AT_ONCE):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + FILES_AT_ONCE], strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["path", "size", "is_folder"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    store, base = _store(root)
    if store.get_file_info(base).type.value == 0:
        raise FileNotFoundError(f"Path does not exist: {root}")
    level, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = rounds.keep(level.mapInArrow(look, "path string, size long, is_folder boolean"))
        files = found.where("NOT is_folder AND size > 0").select("path", "size")
        out = files if out is None else out.unionByName(files)
        level = found.where("is_folder").select("path").repartition(tasks, "path")
        if not some(level):
            return out.repartition(tasks, "path")


def write_files(files: DataFrame, root: str) -> None:
    """Each row a file of its own below root: path (relative, distinct), content (a text, null as empty). Tasks write the files where they
    stay, through pyarrow's file systems: no folder for each, and nothing that the driver moves. A task that runs again writes
    the same files again."""

    root = _absolute(root)

    def write(rows):
        store, base = _store(root)
        made = set()
        for path, content in rows:
            whole = f"{base}/{path}"
            folder = os.path.dirname(whole)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(whole, compression=None) as out:
                out.write((content or "").encode())

    files.select("path", "content").foreachPartition(write)


def discover(spark: SparkSession, root: str, languages: tuple[str, ...] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, absolute_path, language of the code files of a scan, in order of path, optionally only of some languages."""
    found = code_files(scan(spark, root, include, exclude).drop("language"), languages)
    return found.select("path", F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("absolute_path"), "language").orderBy("path")


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree of a scan's files with the directories above them, and its totals."""
    return browse_tree(files, max_depth=1 << 20, hidden=True), totals(files)


def support(files: DataFrame) -> DataFrame:
    """One row: code files, those whose language is parsed, and those whose is not."""
    code = code_files(files.drop("language"))
    known = F.col("language").isin(*PARSED)
    return code.agg(F.count(F.lit(1)).alias("n_code"), F.count_if(known).alias("n_supported"), F.count_if(~known).alias("n_unsupported"))


def safe_text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def code_files(files: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Files with a code language, optionally only some languages."""
    out = files.withColumn("language", language(F.col("path"), CODE_EXTENSIONS)).where(F.col("language").isNotNull())
    return out.where(F.col("language").isin(*languages)) if languages else out


def supported(files: DataFrame) -> DataFrame:
    return files.where(F.col("language").isin(*PARSED))


def browse_tree(files: DataFrame, max_depth: int = 10, hidden: bool = False) -> DataFrame:
    """path, parent, name, is_dir, depth, language, size, sort_key of all files and the directories above them."""
    p = F.col("path")
    segments = F.split(p, "/")
    kept = files.where(F.size(segments) <= max_depth)
    if not hidden:
        kept = kept.where(~F.exists(segments, lambda s: s.startswith(".") | s.isin(*HIDDEN)))
    own = kept.select("path", F.lit(False).alias("is_dir"), language(p, BROWSE_EXTENSIONS, "plaintext").alias("language"), "size")
    above = kept.select(F.explode(prefixes(p)).alias("path")).where("path <> ''").distinct()
    every = own.unionByName(above.select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("long").alias("size")))
    return every.select("path", dirname(p).alias("parent"), basename(p).alias("name"), "is_dir", F.size(F.split("path", "/")).alias("depth"), "language", "size")


def tree_order() -> list[Column]:
    """Directories first, then names without regard to case."""
    return [F.col("parent"), ~F.col("is_dir"), F.lower("name"), F.col("name")]


def filter_tree(tree: DataFrame, query: str) -> DataFrame:
    """Files whose name or path holds the query, and the directories above them."""
    q = query.lower()
    hits = tree.where(~F.col("is_dir") & (F.lower("name").contains(q) | F.lower("path").contains(q)))
    above = hits.select(F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    return hits.unionByName(tree.where("is_dir").join(above, "path", "left_semi").select(*hits.columns))


def census(files: DataFrame) -> DataFrame:
    """language, n of code files, most first."""
    return code_files(files).groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


def with_suffix(files: DataFrame, suffixes: list[str]) -> DataFrame:
    return files.where(extension(F.col("path")).isin(*[s.lower() for s in suffixes]))


def readme(files: DataFrame) -> DataFrame:
    """The first of the usual names at the root that exists."""
    names = F.array(*map(F.lit, READMES))
    return files.where(F.col("path").isin(*READMES)).orderBy(F.array_position(names, F.col("path"))).limit(1)


def totals(files: DataFrame) -> DataFrame:
    """One row: n_files, total_kb."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size") / 1024.0, F.lit(0.0)).alias("total_kb"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_components(components: DataFrame, path: str) -> None:
    components.write.mode("overwrite").json(path)


def write_index(vectors: DataFrame, path: str, rows: DataFrame | None = None) -> None:
    """A vector table, one folder for each repository; with rows (repo_id, id and what is known of each vector) these beside
    it as JSON lines, for :func:`read_index`."""
    vectors.write.mode("overwrite").partitionBy("repo_id").parquet(path if rows is None else f"{path}/vectors")
    if rows is not None:
        rows.write.mode("overwrite").partitionBy("repo_id").json(f"{path}/rows")


def read_index(spark: SparkSession, path: str, repo_id, schema: str) -> DataFrame:
    """The vectors of one repository with their rows; schema is that of the rows without repo_id. Vectors without a row, and
    lines that are no JSON, are left out."""
    rows = spark.read.schema(f"{schema}, repo_id string").option("mode", "DROPMALFORMED").json(f"{path}/rows")
    return read_repo(spark, f"{path}/vectors", repo_id).drop("repo_id").join(rows.where(F.col("repo_id") == str(repo_id)).drop("repo_id"), "id")


def read_repo(spark: SparkSession, path: str, repo_id) -> DataFrame:
    """One repository of a table partitioned by repo_id."""
    return spark.read.parquet(path).where(F.col("repo_id") == repo_id)
