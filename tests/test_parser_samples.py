"""Declarations and calls in small sources of each language that lexers get wrong most easily."""

import pytest

from spindrift.sources.parsers import java, lexical

#: Language, source, symbols that are there (name, kind), names that are no callees.
SAMPLES = [
    ("java", "class A {\n  @Get(value = \"x\", p = f(1))\n  public List<String> m(@P(name = \"q\") String q) { return q; }\n}\n", {("A", "class"), ("m", "method")}, {"m", "Get", "P"}),
    ("java", "class A {\n  A(int x) { init(); }\n  void go() {\n    init();\n    return make(1);\n  }\n}\n", {("A", "class"), ("go", "method")}, {"A", "go"}),
    ("java", "interface S<T> { String load(String k); default int n() { return 1; } }\n", {("S", "interface"), ("load", "method"), ("n", "method")}, {"load", "n"}),
    ("java", "class A {\n  synchronized int[] f(int a,\n      int b) throws E, F {\n    synchronized (this) { g(); }\n    return null;\n  }\n}\n", {("A", "class"), ("f", "method")}, {"f", "synchronized"}),
    ("java", "@interface Mark {}\nenum E { A, B; int k() { return 1; } }\nrecord P(int x) { int y() { return x; } }\n", {("Mark", "annotation"), ("E", "enum"), ("k", "method"), ("P", "record"), ("y", "method")}, {"k", "y"}),
    ("java", "class A {\n  <T extends B<T>> Map<String, List<T>> g(T t) { return h(t); }\n  class In { void deep() { g(1); } }\n}\n", {("A", "class"), ("g", "method"), ("In", "class"), ("deep", "method")}, {"deep"}),
    ("c", "int apply(int (*fn)(int), int x) {\n  return fn(x);\n}\n", {("apply", "function")}, {"apply", "int"}),
    ("c", "static struct node *make(void)\n{\n  return helper(sizeof(int));\n}\n", {("make", "function")}, {"make", "sizeof"}),
    ("c", "struct s { int a; };\nint f(a, b)\n{ if (a) { g(); } while (b) { h(); } return 0; }\n", {("s", "struct"), ("f", "function")}, {"if", "while", "f"}),
    ("c", "/* int fake(void) { */\n#define M(x) do { x; } while (0)\nint real(void) { char *s = \"int no(void) {\"; return 0; }\n", {("real", "function")}, {"no", "fake"}),
    ("cpp", "void Foo::bar(std::function<void(int)> f) const { f(1); other(); }\n", {("bar", "function")}, {"bar"}),
    ("cpp", "Foo::Foo(int x) : a_(x), b_(g(x)) { init(); }\nFoo::~Foo() {}\n", {("Foo", "function")}, {"Foo"}),
    ("cpp", "class A : public B {\n public:\n  virtual void inl() { go(); }\n  void decl();\n};\n", {("A", "class")}, {"inl"}),
    ("cpp", "template <typename T> T max(T a, T b) { return a; }\nauto mk(int a) -> std::vector<int> { return {}; }\n", {("max", "function"), ("mk", "function")}, {"max", "mk"}),
    ("cpp", "namespace n {\nstruct P { int x; };\nint f(int x) noexcept { return g(x); }\n}\n", {("P", "struct"), ("f", "function")}, {"f"}),
    ("javascript", "const f = (a = g(), b = () => 1) => a;\n", {("f", "function")}, {"f"}),
    ("javascript", "class A { m(x = y(2)) { return z(x); } async n({a, b} = {}) { q(); } }\n", {("A", "class")}, {"m", "n"}),
    ("javascript", "describe('x', () => { function inner(a = b(c(1))) { return 1; } });\n", {("inner", "function")}, {"inner"}),
    ("javascript", "export default function* gen(a) { yield* other(a); }\nconst h = async x => run(x);\nlet k = function (a) { return a; };\n", {("gen", "function"), ("h", "function"), ("k", "function")}, {"gen"}),
    ("typescript", "class A { constructor(private s: Service) { boot(); } m(x = y(2)): void { return z(x); } }\n", {("A", "class"), ("m", "function")}, {"m", "constructor"}),
    ("typescript", "export type T<K> = Map<K, V>;\nenum E { X }\nnamespace N { export function f(a: (x: number) => void): string { return g(a); } }\n", {("T", "type"), ("E", "enum"), ("N", "namespace"), ("f", "function")}, {"f"}),
    ("typescript", "abstract class A<T extends B> implements C, D { get v(): number { return w(); } }\ninterface I extends J { f(): void }\n", {("A", "class"), ("I", "interface"), ("v", "function")}, {"v"}),
    ("csharp", "public sealed class A<T> : B, IC where T : new() { }\npublic interface IC { }\npublic record R(int X);\npublic delegate int D(int x);\n", {("A", "class"), ("IC", "interface"), ("R", "record"), ("D", "delegate")}, set()),
    ("php", "<?php\nabstract class A extends B implements C { public function f($a = g(1)) { return h($a); } }\nfunction top(array $x = []) { return new D(); }\n", {("A", "class"), ("f", "method"), ("top", "function")}, {"f", "top"}),
]


@pytest.mark.parametrize(("language", "source", "symbols", "no_callees"), SAMPLES)
def test_samples(language, source, symbols, no_callees):
    parsed = lexical.parse("p/file.x", source, language)
    found = {(s[1], s[2]) for s in parsed.symbols}
    assert symbols <= found, found
    assert {s[1] for s in parsed.symbols} <= {n for n, _ in symbols} | {"x"}, found
    called = {r[1].rsplit(".", 1)[-1] for r in parsed.relationships if r[3] == "call"}
    assert not called & no_callees, parsed.relationships


JAVA = """import java.util.List;
class App extends Base implements Runner {
  App() { init(); }
  void run(@Q(n = "q") String q) { Store s = new Store(); helper(q).go(); s.load(Store.KEY); }
  int helper(String q) { return 1; }
}
interface Runner { void run(String q); }
class Store { int KEY; int load(int k) { return k; } }
"""


def test_java_outline_and_edges():
    symbols, imports = java.outline(JAVA)
    assert [x[:2] + x[4:] for x in symbols] == [
        ("class", "App", None), ("method", "run", "App"), ("method", "helper", "App"), ("class", "Runner", None), ("method", "run", "Runner"), ("class", "Store", None), ("method", "load", "Store")]
    assert imports == [("import java.util.List;", 1)] and symbols[0][2:4] == (2, 6)
    assert java.symbol_edges(JAVA) == [("App", "Runner", "inherit"), ("run", "Store", "call"), ("run", "helper", "call"), ("run", "load", "call")]


def test_long_files_take_time_in_proportion():
    import time

    source = "class A {\n" + "".join(f"  void m{i}(int a) {{ m{i - 1}(a); }}\n" for i in range(4000)) + "}\n"
    start = time.process_time()
    parsed = lexical.parse("A.java", source, "java")
    assert len(parsed.symbols) == 4001 and time.process_time() - start < 10
