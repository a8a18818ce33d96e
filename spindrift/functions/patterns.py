"""Heuristics over file and function names: entry points, connectivity, critical functions, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names and parts of names that the heuristics look for.
ENTRY_FILES = (
    "main.py", "app.py", "server.py", "__main__.py", "run.py", "start.py", "manage.py", "wsgi.py", "asgi.py", "gunicorn.py", "index.js", "app.js",
    "server.js", "main.js", "index.ts", "app.ts", "server.ts", "main.ts", "start.js", "start.ts", "bootstrap.js", "bootstrap.ts", "entry.js",
    "entry.ts", "main.go", "cmd.go", "server.go", "app.go", "root.go", "start.go", "main.rs", "lib.rs", "server.rs", "app.rs", "start.rs", "bin.rs",
    "main.c", "main.cpp", "main.cc", "main.cxx", "app.c", "app.cpp", "start.c", "start.cpp", "entry.c", "entry.cpp", "index.php", "app.php",
    "bootstrap.php", "artisan", "console", "server.php", "start.php",
)
ENTRY_PARTS = (
    "main", "app", "server", "start", "run", "entry", "bootstrap", "init", "cmd", "cli", "daemon", "service", "worker", "launcher",
)
ENTRY_EXTENSIONS = (".py", ".js", ".ts", ".go", ".rs", ".c", ".cpp")
ENTRY_PATHS = (
    "cmd/main", "cmd/root", "cmd/server", "src/main", "src/app", "src/server", "bin/main", "bin/app", "bin/server", "app/main", "app/server",
    "app/start", "scripts/start", "scripts/run",
)
CONNECTED_PARTS = (
    "router", "controller", "service", "handler", "middleware", "api", "core", "engine", "manager", "processor", "client", "mod", "module", "pkg",
    "package", "lib", "util", "utils", "helper", "helpers", "express", "fastapi", "gin", "actix", "rocket", "db", "database", "model", "entity",
    "repo", "repository", "config", "settings", "constants", "types", "interfaces", "console", "text", "style", "render", "display", "format",
    "parse", "parser", "convert", "transform", "process", "table", "tree", "list", "grid", "layout", "widget", "color", "theme", "visual", "graphic",
    "draw", "paint", "file", "io", "stream", "buffer", "cache", "store", "base", "common", "shared", "global", "main", "index",
)
SOURCE_DIRECTORIES = (
    "src/", "lib/", "core/", "pkg/", "cmd/", "internal/", "crates/", "modules/", "include/", "source/", "components/", "services/", "utils/",
)
CRITICAL_NAMES = (
    "main", "index", "app", "server", "start", "init", "run", "new",
)
EXPORTS = (
    "export default", "module.exports =", "exports.", "pub fn main", "pub fn new", "pub fn", "func main", "func new",
    "int main", "void main", "public static void main", 'if __name__ == "__main__"',
)


def any_part(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def is_entry_file(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*ENTRY_FILES) | (any_part(low, ENTRY_PARTS) & any_part(low, ENTRY_EXTENSIONS))


def is_entry_path(path: Column) -> Column:
    return any_part(F.lower(path), ENTRY_PATHS)


def is_connected(name: Column, path: Column) -> Column:
    return any_part(F.lower(name), CONNECTED_PARTS) | any_part(F.lower(path), CONNECTED_PARTS) | any_part(F.lower(path), SOURCE_DIRECTORIES)


def is_critical(name: Column, code: Column | None = None) -> Column:
    """By name, or by an export in the code. Parts are looked for as written in code of lower case, so one with capitals
    never occurs."""
    out = F.lower(name).isin(*CRITICAL_NAMES)
    return out if code is None else out | F.coalesce(any_part(F.lower(code), EXPORTS), F.lit(False))


# What the fallbacks look for in names and paths.
FALLBACK_NAMES = ("main", "app", "server", "start", "index")
FALLBACK_COMMON = ("main", "app", "index")
FALLBACK_EXTENSIONS = (".py", ".js", ".go", ".rs")
FALLBACK_DIRECTORIES = ("src/", "lib/", "app/", "pkg/", "core/")
TEST_PARTS = ("test", "spec", "_test")


def fallback_entry_points(files: DataFrame, k: int = 5) -> DataFrame:
    """path, rank of files that look like entry points or, if there are none, that lie at or just below the root; lowest
    score first, where each slash, a common name and a common extension lower it. files: path, name, pos."""
    name = F.lower("name")
    like = any_part(name, FALLBACK_NAMES) | is_entry_path(F.col("path"))
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    score = -slashes - F.when(any_part(name, FALLBACK_COMMON), 10).otherwise(0) - F.when(any_part(name, FALLBACK_EXTENSIONS), 5).otherwise(0)
    marked = files.select("path", "pos", like.alias("like"), (slashes <= 1).alias("near"), score.alias("score"))
    has = marked.agg(F.coalesce(F.max("like"), F.lit(False)).alias("has"))
    chosen = marked.crossJoin(F.broadcast(has)).where(F.when(F.col("has"), F.col("like")).otherwise(F.col("near")))  # one row
    order = ["score", "pos", "path"]
    return chosen.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order))).select("path", "rank")


def fallback_connected(files: DataFrame, k: int = 10) -> DataFrame:
    """path, rank: files of source directories in order, then other source files that are no tests, up to k."""
    name, path = F.lower("name"), F.lower("path")
    first = any_part(path, FALLBACK_DIRECTORIES)
    second = any_part(name, ENTRY_EXTENSIONS) & ~any_part(name, TEST_PARTS)
    order = ["step", "pos", "path"]
    ranked = files.select("path", "pos", F.when(first, 0).when(second, 1).alias("step")).where(F.col("step").isNotNull())
    return ranked.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order))).select("path", "rank")
