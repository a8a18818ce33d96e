import pytest

from spindrift.sources.parsers import lexical, python, table

PY = '''import os.path as osp
from ..core import Base, helper as h
from x import *

@deco
class Child(Base):
    """Doc."""

    def run(self):
        self.stop()
        return h(osp.join("a"))

    class Inner:
        pass

def top(a: Child, b: "int", c: dict[str, Missing]) -> Base | None:
    def nested():
        return unknown.call()
    print(len([]))
    return Child()

async def later():
    top()

def _test_skip():
    pass
'''


def test_python_symbols():
    found = {(s[1], s[2]) for s in python.parse("pkg/sub/mod.py", PY).symbols}
    assert found == {("Child", "class"), ("Inner", "class"), ("top", "function"), ("nested", "function"), ("later", "async_function")}
    child = next(s for s in python.parse("pkg/sub/mod.py", PY).symbols if s[1] == "Child")
    assert child[0] == "pkg.sub.mod.Child" and child[6] is True and child[3] == 6


def test_python_relationships():
    rels = {(r[0], r[1], r[3], r[4]) for r in python.parse("pkg/sub/mod.py", PY).relationships}
    m = "pkg.sub.mod"
    assert (f"{m}.Child", "pkg.core.Base", "inherit", False) in rels
    assert (f"{m}.Child", f"{m}.Child", "call", True) in rels  # self.stop()
    assert (f"{m}.Child", "pkg.core.helper", "call", False) in rels
    assert (f"{m}.Child", "os.path.join", "call", False) in rels
    assert (f"{m}.top", f"{m}.Child", "use", True) in rels
    assert (f"{m}.later", f"{m}.top", "call", True) in rels
    assert (f"{m}.nested", "unknown.call", "call", False) in rels
    assert not any(r[1] in ("print", "len") for r in rels)


def test_python_imports():
    imports = python.parse("pkg/sub/mod.py", PY).imports
    assert ("osp", "os.path", "os.path", None, 1) in imports
    assert ("h", "pkg.core.helper", "pkg.core", "helper", 2) in imports
    assert ("*", "x", "x", "*", 3) in imports


def test_python_outline_and_edges():
    assert [x[:2] for x in python.outline("class Foo:\n  def method(self): pass\ndef func(): pass")] == [("class", "Foo"), ("function", "method"), ("function", "func")]
    edges = python.symbol_edges("class A: pass\nclass B(A):\n  def m(self): return f(1)\ndef f(x: A): pass")
    assert edges == [("B", "A", "inherit"), ("m", "f", "call"), ("f", "A", "use")]


SOURCES = {
    "java": ("src/App.java", 'package a;\nimport java.util.*;\n/** Doc. */\npublic class App extends Base implements Runner {\n  private Store store;\n  // class Fake {}\n  public void main(String[] args) { store.load("class X {"); new Job(); }\n}\ninterface Runner {}\nenum Mode { A, B }\n', {("App", "class"), ("main", "method"), ("Runner", "interface"), ("Mode", "enum")}, {"Base", "Job", "Store"}),
    "javascript": ("a.js", "import x from 'lib';\nclass A extends B { go() { return helper(); } }\nfunction helper() { return new C(); }\nconst arrow = (x) => helper(x);\n", {("A", "class"), ("helper", "function"), ("arrow", "function")}, {"B", "C"}),
    "typescript": ("a.ts", "interface I { f(x: T): void }\nexport class A implements I {\n  constructor(private s: Service) {}\n  run(): void { this.s.go(); }\n}\nenum E { X }\nexport function f(a: number): string { return g(a); }\nfunction g(a) { return a; }\n", {("I", "interface"), ("A", "class"), ("f", "function"), ("E", "enum"), ("run", "function")}, {"Service"}),
    "c": ("a.c", '#include "b.h"\nstruct node { int x; };\nstatic int helper(int a) {\n  return a;\n}\nint main(void) {\n  printf("helper(");\n  return helper(1);\n}\n', {("node", "struct"), ("helper", "function"), ("main", "function")}, set()),
    "cpp": ("a.cpp", "class Shape { public: virtual void draw() {} };\nclass Circle : public Shape {\n};\nint area(int r) {\n  return square(r);\n}\nint square(int r) {\n  return r * r;\n}\n", {("Shape", "class"), ("Circle", "class"), ("area", "function"), ("square", "function")}, set()),
    "csharp": ("a.cs", "using System;\npublic abstract class A : B, IC {\n  private Store store;\n}\npublic interface IC {}\npublic struct S {}\npublic enum E { X }\npublic delegate void D(int x);\n", {("A", "class"), ("IC", "interface"), ("S", "struct"), ("E", "enum"), ("D", "delegate")}, {"B", "Store"}),
    "php": ("a.php", "<?php\nnamespace App\\Models;\nuse Lib\\Base;\nclass User extends Base implements HasName {\n  public function __construct(private Repo $repo) {}\n  public function name() { return helper(); }\n}\ntrait T {}\nfunction helper() { return new Other(); }\n", {("User", "class"), ("name", "method"), ("T", "trait"), ("helper", "function")}, {"Base", "HasName", "Repo", "Other"}),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_lexical(language):
    path, source, symbols, targets = SOURCES[language]
    parsed = lexical.parse(path, source, language)
    found = {(s[1], s[2]) for s in parsed.symbols}
    assert symbols <= found, found
    assert not any("Fake" in n or n == "X" for n, _ in found)
    assert targets <= {r[1].rsplit(".", 1)[-1] for r in parsed.relationships}, parsed.relationships


def test_php_templates_are_skipped():
    assert not lexical.parse("resources/views/a.blade.php", "<?php class A {}", "php").symbols


def test_errors_are_rows(spark):
    files = spark.createDataFrame([("a.py", "python", "def ("), ("b.py", "python", "def f(): pass"), ("c.zz", "zz", "?"), ("d.py", "python", None)], "path string, language string, content string")
    parsed = table.parse_files(files).cache()
    assert [r["path"] for r in table.errors(parsed).collect()] == ["a.py"]
    assert [r["id"] for r in table.symbols(parsed).collect()] == ["b.f"]
