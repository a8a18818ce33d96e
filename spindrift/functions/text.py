"""Column functions over text: chunks, lines, tokens, references, markdown, importance, truncation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.substrings import shuffled, unheld

CHUNK_CHARS = 1200
#: What a line break is when lines are counted as an editor does.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Words in backticks that are no references (fixed values).
NO_REFERENCE = ("true", "false", "none", "null", "undefined", "self", "this")
#: Importance of a line by what it starts with (fixed values); the largest that fits counts.
LINE_PATTERNS = (
    (10, r"^\s*(class\s+\w+|public\s+class|interface\s+\w+|struct\s+\w+)"),
    (9, r"^\s*(def\s+\w+|async\s+def|function\s+\w+|public\s+\w+\s+\w+\s*\()"),
    (8, r"^\s*(public|private|protected)\s+\w+\s+\w+\s*\("),
    (7, r"^\s*(import\s+|from\s+\w+\s+import|using\s+|#include)"),
    (6, r"^\s*@\w+"),
    (5, r"^\s*(\"\"\"|'''|/\*\*)"),
    (5, r"^\s*(#\s*(TODO|FIXME|NOTE|IMPORTANT)|//\s*(TODO|FIXME))"),
    (4, r"^\s*return\s+"),
    (3, r"^\s*\w+\s*=\s*"),
    (3, r"^\s*(if|else|elif|for|while|switch|case|try|except|catch)"),
)


def chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Consecutive pieces of size characters; no piece of an empty or null text. Their concatenation is the text."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * F.lit(size) + 1, F.lit(size)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def chunk_rows(docs: DataFrame, path: str, text: str, size: int = CHUNK_CHARS, kind: str = "chunk") -> DataFrame:
    """id (path::kind:i), path, chunk_no, text for each chunk."""
    out = docs.select(F.col(path).alias("path"), F.posexplode(chunks(F.col(text), size)).alias("chunk_no", "text"))
    return out.select(F.concat("path", F.lit(f"::{kind}:"), F.col("chunk_no").cast("string")).alias("id"), "path", "chunk_no", "text")


def split_lines(text: Column) -> Column:
    """Lines as an editor counts them: any line break ends one, and a last empty line is none."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """Newlines and one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_slice(text: Column, offset: int, limit: int) -> Column:
    """start_line, end_line, total_lines and the text of limit lines from the 1-based line offset on."""
    lines = split_lines(text)
    start = max(1, offset)
    piece = F.slice(lines, start, limit)
    return F.struct(F.lit(start).alias("start_line"), (F.lit(start - 1) + F.size(piece)).alias("end_line"), F.size(lines).alias("total_lines"), F.array_join(piece, "\n").alias("content"))


def search_lines(docs: DataFrame, key: str, text: str, query: str, context: int = 2, limit: int = 20, case_sensitive: bool = False, use_regex: bool = False) -> DataFrame:
    """key, line, start_line, end_line, snippet: the first limit lines of each document that hold the query.

    A query that is no regular expression is searched as text even with use_regex.
    """
    if use_regex:
        try:
            re.compile(query)
        except re.error:
            use_regex = False
    def hit(line: Column) -> Column:
        if use_regex:
            return line.rlike(query if case_sensitive else f"(?i){query}")
        return line.contains(query) if case_sensitive else F.lower(line).contains(query.lower())

    rows = docs.select(F.col(key), split_lines(F.col(text)).alias("_lines"))
    rows = rows.withColumn("_hits", F.slice(F.filter(F.transform("_lines", lambda line, i: F.struct((i + 1).alias("no"), line.alias("line"))), lambda s: hit(s["line"])), 1, limit))
    out = rows.select(key, "_lines", F.explode("_hits.no").alias("line"))
    start, end = F.greatest(F.lit(1), F.col("line") - context), F.least(F.size("_lines"), F.col("line") + context)
    return out.select(key, "line", start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_lines", start, end - start + 1), "\n").alias("snippet"))


def tokens(text: Column, at_least_one: bool = False) -> Column:
    """A token for four characters; with at_least_one a text that is not empty has one."""
    n = F.floor(F.length(text) / 4)
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), n)).otherwise(0) if at_least_one else n


def count_tokens(docs: DataFrame, key: str, text: str, encode: Callable[[str], list] | None = None) -> DataFrame:
    """key, tokens: by an encoder where one is given, else estimated."""
    if encode is None:
        return docs.select(key, tokens(F.col(text)).alias("tokens"))

    @F.pandas_udf("long")
    def exact(s):
        return s.map(lambda t: len(encode(t or "")))

    return docs.select(key, exact(text).alias("tokens"))


def identifier_tails(raw: Column) -> Column:
    """The last segments of the dotted names in a text, in order."""
    return F.transform(F.regexp_extract_all(raw, F.lit(r"([A-Za-z_][\w.]*)"), 1), lambda n: F.substring_index(n, ".", -1))


def code_references(doc: Column) -> Column:
    """Distinct dotted names in backticks, but for NO_REFERENCE, and names after ``class``, sorted."""
    ticks = F.regexp_extract_all(doc, F.lit(r"`([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)`"), 1)
    classes = F.regexp_extract_all(doc, F.lit(r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)"), 1)
    return F.array_sort(F.array_distinct(F.concat(F.filter(ticks, lambda r: ~F.lower(r).isin(*NO_REFERENCE)), classes)))


def link_targets(doc: Column) -> Column:
    """Targets of markdown links that are local files, in order."""
    return F.filter(F.regexp_extract_all(doc, F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), 2), lambda u: ~(u.startswith("http://") | u.startswith("https://") | u.startswith("#")))


def fenced_blocks(docs: DataFrame, key: str, text: str, kind: str = "mermaid") -> DataFrame:
    """key, start_line, content of fenced blocks of a kind that are not empty; start_line is that of the fence."""
    from spindrift.sources.parsers.table import bounded_batches

    bounded_batches(docs.sparkSession)  # whole texts: the default is 10,000 of them at a time
    schema = f"{key} {dict(docs.dtypes)[key]}, start_line int, content string"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, doc in zip(pdf[key], pdf[text], strict=True):
                lines, start = (doc or "").split("\n"), None
                for i, line in enumerate(lines):
                    if start is None:
                        start = i if line.strip().startswith(f"```{kind}") else None
                    elif line.strip() == "```":
                        if i > start + 1:
                            out.append((k, start + 1, "\n".join(lines[start + 1 : i])))
                        start = None
                if start is not None and start + 1 < len(lines):
                    out.append((k, start + 1, "\n".join(lines[start + 1 :])))
            yield pd.DataFrame(out, columns=[key, "start_line", "content"])

    return docs.select(key, text).mapInPandas(run, schema)


def line_importance(line: Column) -> Column:
    """1 to 10; 1 for a blank line."""
    scores = [F.when(line.rlike(f"(?i){p}"), s).otherwise(1) for s, p in LINE_PATTERNS]
    return F.when(F.trim(line) == "", 1).otherwise(F.greatest(*scores))


def doc_issues(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key, issue: references that no component name (column name) contains or ends with, and missing headings."""
    refs = docs.select(key, F.explode(code_references(F.col(text))).alias("ref")).where("length(ref) > 3")
    parts = F.split("name", r"\.")
    known = names.select(F.explode(F.array("name", F.element_at(parts, -1), F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "."))).alias("known")).distinct()
    missing = unheld(refs, known.withColumnRenamed("known", "name"))
    out = refs.join(shuffled(missing), "ref").select(key, F.format_string("[WARNING] Referenced '%s' not found in codebase (may be external)", "ref").alias("issue"))
    for mark, message in (("# ", "Missing main heading"), ("## ", "Missing section headings")):
        out = out.unionByName(docs.where(~F.col(text).contains(mark)).select(key, F.lit(f"[WARNING] {message}").alias("issue")))
    return out


def title(content: Column, path_stem: Column) -> Column:
    """The first heading of a document, else its file name in title case."""
    found = F.regexp_extract(content, r"(?m)^# +(.*)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.initcap(F.translate(path_stem, "_", " ")))


def outline(content: Column) -> Column:
    """Second-level headings with their anchors."""
    slug = lambda h: F.regexp_replace(F.regexp_replace(F.lower(F.trim(h)), r"[^\w一-鿿\- ]", ""), r"\s+", "-")
    return F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^## +(.*)$"), 1), lambda h: F.struct(F.trim(h).alias("title"), slug(h).alias("anchor")))


_THINKING = r"(?is)<(think|thinking|thought|reasoning)>(.*?)</\1>"


def thinking(text: Column) -> Column:
    """thinking, answer: what stands in thinking tags, and the rest."""
    inner = F.regexp_extract_all(text, F.lit(_THINKING), 2)
    return F.struct(F.array_join(F.transform(inner, lambda x: F.trim(x)), "\n").alias("thinking"), F.trim(F.regexp_replace(text, _THINKING, "")).alias("answer"))


def diagram(text: Column) -> Column:
    """A diagram's text with a direction where a graph has none; null if it is no diagram."""
    body = F.trim(text)
    is_one = body.rlike(r"^(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie|journey|mindmap)\b")
    return F.when(is_one, F.regexp_replace(body, r"^(graph|flowchart)[ \t]*(?=\r?\n|$)", "$1 TD"))


def jsdoc_types(comment: Column) -> Column:
    """Distinct type names in a documentation comment's braces after param, returns, type, typedef or interface tags;
    the parts of generics and unions count each."""
    braces = F.regexp_extract_all(comment, F.lit(r"@(?:param|returns?|type|typedef|interface)\s+\{([^}]+)\}"), 1)
    return F.array_distinct(F.flatten(F.transform(braces, lambda b: F.regexp_extract_all(b, F.lit(r"([A-Za-z_$][\w$.]*)"), 1))))


def html_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def preview(text: Column, size: int, mark: str = "...") -> Column:
    """The first size characters, marked if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def clean_doc_comment(comment: Column) -> Column:
    """A block comment without its frame and leading stars."""
    inner = F.regexp_replace(F.regexp_replace(comment, r"^\s*/\*\*?", ""), r"\*/\s*$", "")
    return F.regexp_replace(F.regexp_replace(inner, r"(?m)^[ \t]*\*[ \t]?", ""), r"^\s+|\s+$", "")


def parse_lint(line: Column) -> Column:
    """file, line, col, problem of a lint message ``file:line:col: problem``; nulls for other lines."""
    part = lambda k: F.nullif(F.regexp_extract(line, r"^([^:]*):(\d+):(\d+): (.*)$", k), F.lit(""))
    return F.struct(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), part(4).alias("problem"))


def shifted_line(line: Column, first: int, last: int, n_new: int) -> Column:
    """Where a line is after lines first to last were replaced by n_new; null inside them."""
    return F.when(line < first, line).when(line > last, line + (n_new - (last - first + 1)))


def elided(lines: DataFrame, bodies: DataFrame, least: int = 5) -> DataFrame:
    """Lines (path, no, line) outside long bodies (path, first, last), and a marker for each of these."""
    long = bodies.where(F.col("last") - F.col("first") >= least)
    within = [lines["path"] == long["path"], lines["no"] >= long["first"], lines["no"] <= long["last"]]
    marks = long.select("path", F.col("first").alias("no"), F.format_string("... eliding lines %d-%d ...", "first", "last").alias("line"))
    return lines.join(long, within, "left_anti").unionByName(marks)


def shortened(text: Column, size: int, notice: str = "\n... response truncated ...") -> Column:
    """The first size characters with a notice behind, if there are more; all of it for a size of 0."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(notice))).otherwise(text) if size else text


def replace_once(text: Column, old: str, new: str) -> Column:
    """The text with old replaced, null unless old occurs exactly once."""
    n = (F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)
    return F.when(n == 1, F.replace(text, F.lit(old), F.lit(new)))
