"""Java outlines and symbol edges of one file, from its declarations: types and methods with what holds them."""

from __future__ import annotations

import re

from spindrift.sources.parsers.declarations import Declared, Reader
from spindrift.sources.parsers.tokens import Tokens

_TYPES = ("class", "interface", "enum")
_IMPORT = re.compile(r"^[ \t]*import\s[^;]*;", re.M)


def _held(reader: Reader) -> list[Declared]:
    """Classes, interfaces, enums and their methods, in order."""
    return sorted((d for d in reader.declared if d.kind in _TYPES or (d.kind == "method" and d.owner >= 0)), key=lambda d: d.at)


def _holder(reader: Reader, number: int, kinds: tuple[str, ...]) -> Declared | None:
    """The innermost declaration of some kinds from one outwards."""
    while number >= 0 and reader.declared[number].kind not in kinds:
        number = reader.declared[number].owner
    return reader.declared[number] if number >= 0 else None


def outline(source: str) -> tuple[list[tuple[str, str, int, int, str | None]], list[tuple[str, int]]]:
    """(kind, name, first line, last line, container) of types (kind class) and methods, and (text, line) of imports."""
    tokens = Tokens(source, "java")
    reader, out = Reader(tokens), []
    for d in _held(reader):
        around = _holder(reader, d.owner, _TYPES)
        first, last = tokens.line(tokens.start[d.at]), tokens.line(tokens.start[min(d.end, len(tokens)) - 1])
        out.append(("method" if d.kind == "method" else "class", d.name, first, last, around.name if around else None))
    commented = re.sub(r"/\*.*?(?:\*/|\Z)|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    return out, [(m[0].strip(), tokens.line(m.start() + len(m[0]) - len(m[0].lstrip()))) for m in _IMPORT.finditer(commented)]


def symbol_edges(source: str, across: bool = False) -> list[tuple[str, str, str]]:
    """(container, name, type) of inheritance, calls, creations and field accesses whose target is declared in the file, or
    anywhere; the container is the innermost type or method."""
    tokens = Tokens(source, "java")
    reader = Reader(tokens)
    held = _held(reader)
    known, heads = {d.name for d in held}, {d.at for d in reader.declared}
    edges = [(token, d.name, base, "inherit") for d in held if d.kind != "method" for base, token in d.bases if across or base in known]
    bases = {token for d in reader.declared for _, token in d.bases}
    open_: list[Declared] = []
    left = iter(held)
    coming = next(left, None)
    for i, name in enumerate(tokens.text):
        while coming and coming.at <= i:
            open_.append(coming)
            coming = next(left, None)
        while open_ and open_[-1].end <= i:
            open_.pop()
        if not (across or name in known) or not tokens.is_name(i) or i in heads or i in bases or not open_:
            continue
        after = tokens.after_angles(i + 1, len(tokens))
        called = tokens[i - 1] == "new" or tokens[after] == "("
        if called or tokens[i - 1] == ".":
            edges.append((i, open_[-1].name, name, "call" if called else "use"))
    return [(c, t, k) for _, c, t, k in sorted(edges)]
