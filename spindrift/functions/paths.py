"""Column functions over file paths and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of each extension of a code file (fixed values).
CODE_EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".hxx": "cpp", ".h++": "cpp",
    ".rs": "rust", ".go": "go", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".cs": "csharp",
}
#: Language of each extension for browsing (fixed values); others are plain text.
BROWSE_EXTENSIONS = {
    ".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".vue": "vue",
    ".html": "html", ".css": "css", ".scss": "scss", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".sql": "sql",
    ".sh": "shell", ".bash": "shell", ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".r": "r", ".xml": "xml", ".toml": "toml", ".ini": "ini",
    ".env": "shell", ".gitignore": "gitignore", ".dockerfile": "dockerfile",
}
#: Languages whose files are parsed, and that hold no code.
PARSED = ("python", "javascript", "typescript", "java", "csharp", "c", "cpp", "php", "go", "rust")
NOT_CODE = ("markdown", "json", "yaml", "xml", "plaintext")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension with its dot in lower case; empty for none or a name that only starts with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def language(path: Column, table: dict[str, str] = CODE_EXTENSIONS, default: str | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(default))


def normalised(path: Column) -> Column:
    """Forward slashes, lower case."""
    return F.lower(F.translate(path, "\\", "/"))


def module_path(path: Column) -> Column:
    """A relative path without extension, with dots for slashes."""
    return F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/\\", "..")


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a shell pattern: * and ? cross slashes, [seq] and [!seq] are sets."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c in "*?":
            out += "(?s:.*)" if c == "*" else "(?s:.)"
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            i = end + 1
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
        else:
            out += re.escape(c)
    return f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """A pattern rules a path out if it matches the path or the name, if it names a directory at the start (a trailing
    slash is dropped, so ``bin/`` also takes ``binary.py``), or if a segment equals it."""
    if not patterns:
        return F.lit(False)
    starts = [re.escape(p.rstrip("/")) if p.endswith("/") else re.escape(p + "/") for p in patterns]
    segments = [re.escape(p) for p in patterns if "/" not in p]
    hit = _matches(path, patterns) | path.rlike(f"^(?:{'|'.join(starts)})")
    return hit | path.rlike(f"(?:^|/)(?:{'|'.join(segments)})(?:/|$)") if segments else hit


def included(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches the path or the name; without patterns all are."""
    return _matches(path, patterns) if patterns else F.lit(True)


def _matches(path: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches the path or the name: one regular expression for all."""
    one = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return path.rlike(one) | basename(path).rlike(one)


def symbol_id(*parts: str) -> Column:
    """sha1 of the parts joined by a bar, null as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def display_id(component: Column) -> Column:
    """An id without a trailing ``.__init__``."""
    return F.regexp_replace(component, r"\.__init__$", "")
