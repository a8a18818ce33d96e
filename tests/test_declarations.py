"""What is declared and what is called in sources of each language: symbols and relationships exactly."""

import pytest

from spindrift.sources.parsers import lexical, table

#: Language, source, symbols as name:kind, and relationships as caller>callee:kind with last names; c is call.
CASES = [
    # C#: declarations with and without bodies are no calls; base lists, fields, properties and parameters are uses.
    ("csharp", "class C : B, I { [HttpGet(\"x\")] public User Find(int id, Filter f) { return Load(id); } }", "C:class", "C>B:inherit C>I:inherit C>Filter:use C>Load:call"),
    ("csharp", "public record R(int Count, Address Home) : Q(Make(Count));", "R:record", "R>Q:inherit R>Address:use R>Make:call"),
    ("csharp", "abstract class C { protected abstract void Later(Order o); extern static int Native(int x); }", "C:class", "C>Order:use"),
    ("csharp", "interface I { Task<int> Get(Key k); int P { get; } }", "I:interface", "I>Key:use"),
    ("csharp", "class C { int N => _s.Count(); Store S { get; set; } = Open(); string this[int i] { get => Read(i); set { Write(i); } } }", "C:class", "C>Count:call C>Store:use C>Open:call C>Read:call C>Write:call"),
    ("csharp", "class C { public C(S s) : base(F(s)) { G(); } ~C() { H(); } public static C operator +(C a, C b) => M(a); }", "C:class", "C>S:use C>F:call C>G:call C>H:call C>M:call"),
    ("csharp", "class C { void A() { int Local(int x) { return In(x); } Local(1); var h = new Helper<int>(2) { X = Y() }; } }", "C:class", "C>In:call C>Local:call C>Helper:new C>Y:call"),
    ("csharp", "class C { string a = @\"x \"\" f(\"; string b = $\"{1} g(\"; string d = \"\"\" h( \"\"\"; char e = '\"'; void M() { K(); } }", "C:class", "C>K:call"),
    ("csharp", "#if X\n#region a(b)\nnamespace N;\nenum E { A = 1, B }\npublic delegate void D(int x);\nstruct S { }\n#endregion", "E:enum D:delegate S:struct", ""),
    ("csharp", "static class X { public static T On<T>(this T x, Func<T, int> f) where T : class, new() => f.Do(x); }", "X:class", "X>Func:use X>Do:call"),
    ("csharp", "class C<T> : B<T> where T : IX, new() { event Handler Changed; readonly Dictionary<string, Store> all = new(); }", "C:class", "C>B:inherit C>Handler:use"),
    ("csharp", "namespace A { namespace B { partial class C { class D { void M() => N(); } } } }", "C:class D:class", "D>N:call"),
    ("csharp", "class C { (int a, Foo b) Pair(Bar x) => (1, New(x)); async IAsyncEnumerable<int> S() { await foreach (var i in L()) yield return i; } }", "C:class", "C>Bar:use C>New:call C>L:call"),
    ("csharp", "record struct P(int X, Y Z) { public int Sum() => X.Add(Z); }", "P:record", "P>Y:use P>Add:call"),
    ("csharp", "class C { void M() { if (A()) { lock (B()) { } } using (var x = O()) { } switch (S()) { case 1: T(); break; } x?.Y(); typeof(Z); nameof(M); } }", "C:class", "C>A:call C>B:call C>O:call C>S:call C>T:call C>Y:call"),
    # C++
    ("cpp", "class S : public B<int>, private d::I { public: S(int n) : n_(n), v_(make(n)) { init(); } int size() const; virtual void f() = 0; ~S() = default; int n_{0}; };", "S:class", "S>B:inherit S>I:inherit S>make:call S>init:call"),
    ("cpp", "struct node *mk(void) { return alloc(sizeof(struct node)); }", "mk:function", "mk>alloc:call"),
    ("cpp", "template <typename T, int N = 3> class A final { T go(T t) { return g(t); } };", "A:class", "A>g:call"),
    ("cpp", "int A<int>::size() const noexcept { Guard g(lock()); return count(n_); }", "size:function", "size>lock:call size>count:call"),
    ("cpp", "#define M(x) \\\n  call(x)\nnamespace a::b { void f(std::function<int(int)> g); void f2() { M(1); } }", "f2:function", "f2>M:call"),
    ("cpp", "const char* r = R\"x(int fake() { c(); })x\"; int n = 1'000; char q = '\"'; void f() { g(); }", "f:function", "f>g:call"),
    ("cpp", "extern \"C\" { int api(int x) { return impl(x); } int proto(int); }", "api:function", "api>impl:call"),
    ("cpp", "class F { bool operator()(int a, int b) const { return less(a, b); } F& operator=(const F&) = delete; friend void h(F); };", "F:class", "F>less:call"),
    ("cpp", "enum class C : int { R = f(1), G }; union U { int a; }; struct P { int x; } p; void g() { p.go(); }", "P:struct g:function", "g>go:call"),
    ("cpp", "auto f(int a) -> decltype(a) { if (a < 1) t(a); return a > 2 ? u<int>(a) : v; }", "f:function", "f>t:call f>u:call"),
    ("cpp", "void A::B::c() { auto l = [&](int x) { return k(x); }; for (auto& x : xs()) use(x); new Foo(bar()); }", "c:function", "c>k:call c>xs:call c>use:call c>Foo:new c>bar:call"),
    ("cpp", "typedef struct { int a; } T; using X = Y<int>; static_assert(sizeof(int) == 4, \"\"); [[nodiscard]] int f() { return T{1}.a; }", "f:function", ""),
    ("cpp", "class EXPORT Q : public R { Q_OBJECT signals: void changed(int); public slots: void on() { go(); } };", "Q:class", "Q>R:inherit Q>go:call"),
    ("cpp", "try_it::~try_it() { close(); }\nint main() { try { a(); } catch (const E& e) { b(); } return 0; }", "try_it:function main:function", "try_it>close:call main>a:call main>b:call"),
    ("cpp", "class A { A() = default; A(const A&) = delete; explicit operator bool() const { return ok(); } static A* get() { static A a; return &a; } };", "A:class", "A>ok:call"),
    # C
    ("c", "typedef struct point { int x; } P;\nstruct list { struct list *next; int (*cmp)(const void *); };\nint add(int a);\nint add(int a) { return a; }", "point:struct list:struct add:function", ""),
    ("c", "static int (*pick(int k))(int) { return table(k); }", "pick:function", "pick>table:call"),
    ("c", "int f(a, b) { char c = '\"'; /* g() */ // h()\n#if X(1)\n return k(a);\n#endif\n}", "f:function", "f>k:call"),
    ("c", "void f(void) { struct s x = { .a = g(1) }; do { h(); } while (i(x)); printf(\"j(\"); }", "f:function", "f>g:call f>h:call f>i:call"),
    ("c", "enum e { A = 1 }; static const int t[] = { 1, 2 }; extern int ext(int); int main(int c, char **v) { return ext(c) + run(v); }", "main:function", "main>ext:call main>run:call"),
    # Java
    ("java", "enum E { A(f(1)), B(2) { int z() { return g(); } }; E(int k) { set(k); } int z() { return 1; } }", "E:enum z:method", "E>f:call z>g:call E>set:call"),
    ("java", "record P(int x, Helper h) implements Q { P { check(x); } static P of() { return new P(1, null); } }", "P:record of:method", "P>Q:inherit P>check:call of>P:new"),
    ("java", "@interface M { String value() default \"x\"; int[] n() default {1, 2}; }", "M:annotation value:method n:method", ""),
    ("java", "class A { static { boot(); } private final Store s = open(); int[] a[] = {}, b = make(); { again(); } }", "A:class", "A>boot:call A>Store:use A>open:call A>make:call A>again:call"),
    ("java", "class A { void m() { Runnable r = new Runnable() { public void run() { h.go(); } }; xs.map(x -> x.size()).forEach(this::p); } }", "A:class m:method run:method", "m>Runnable:new run>go:call m>map:call m>size:call m>forEach:call"),
    ("java", "class A { String t = \"\"\"\n class F { void no() { nope(); } }\n\"\"\"; <T extends B<T>> List<T> g(Class<? extends T> c) throws E { return h(c); } }", "A:class g:method", "g>h:call"),
    ("java", "sealed interface S<T> extends A, B permits C { int n(); default int m() { return n(); } private static void p() { q(); } }", "S:interface n:method m:method p:method", "S>A:inherit S>B:inherit S>C:inherit m>n:call p>q:call"),
    ("java", "package x; class A<T> extends a.b.B<T> { @Deprecated(since = f()) A() { super(k()); this.go(); } synchronized <R> R[] z(R... r) { return null; } void go() { } }", "A:class z:method go:method", "A>B:inherit A>k:call A>go:call"),
    # TypeScript and JavaScript
    ("typescript", "abstract class A extends B<C> implements I { abstract run(x: Task): Result; go = async (e: Ev) => { this.on(e) }\n constructor(private r: Repo) { super(); boot() } get v(): number { return w() } }", "A:class v:function", "A>B:inherit A>I:inherit A>Task:use A>Result:use A>Ev:use A>on:call A>Repo:use A>boot:call v>w:call"),
    ("typescript", "interface I extends J { f(x: Task): Result; new (y: Foo): Bar; g?: () => void }", "I:interface", "I>J:inherit I>Task:use I>Result:use I>Foo:use I>Bar:use"),
    ("typescript", "type M = { [k: string]: Deep } | Other<Foo>;\ndeclare function d(a: Foo): void;\nenum E { A = calc(1) }\nnamespace N { export function q(): Bar { return b<Foo>(1) } }", "M:type d:function E:enum N:namespace q:function", "M>Deep:use M>Other:use M>Foo:use d>Foo:use E>calc:call q>Bar:use q>b:call"),
    ("typescript", "export const f = async <T,>(x: T): Promise<T> => go(x), g = (y) => hi(y);", "f:function g:function", "f>go:call g>hi:call"),
    ("javascript", "const o = { m(a) { return q(a) }, async n() { w() }, k: fn(2) }; function f() { const re = /a(b)\\/c(/g; return `x ${deep(`${n(1)}`)} call()` }", "f:function", "f>deep:call f>n:call"),
    ("javascript", "class A extends mixin(B) { #p = 1; static s = mk(); async m(a = d(1)) { return this.q(a) / r(2) / 3 } get v() { return 1 } }", "A:class", "A>mixin:inherit A>mk:call A>d:call A>q:call A>r:call"),
    ("javascript", "export default class extends B { m() { a() } }\nvar F = function named(a) { return new Foo.Bar(a) }; export async function* gen() { if (x) await it(); else (y)(); }", "F:function gen:function", "F>Bar:new gen>it:call"),
    ("javascript", "function f(a = () => g(), { b, c = h() } = {}) { a && i(); return a\n  .j()\n  .k() }", "f:function", "f>g:call f>h:call f>i:call f>j:call f>k:call"),
    # PHP
    ("php", "<?php namespace App; use X\\Y\\Z as Q; abstract class A extends Q implements \\I { use T; public function __construct(private S $s) { parent::__construct(); go($s); } abstract public function l(F $x): B; }", "A:class __construct:method l:method", "App>Z:use A>Z:inherit A>I:inherit A>T:use __construct>S:use __construct>go:call"),
    ("php", "<?php enum S: string implements H { case A = 'a'; const X = f(1); public function l() { return new static(Q::find(1)); } }", "S:enum l:method", "S>H:inherit S>f:call l>Q:call"),
    ("php", "<b>function no() {}</b><?php trait T { function t() { return <<<EOT\n class F { function n() {} }\nEOT; } } # x()\nfunction top($f) { return $f(fn($y) => map($y)); } ?><i>z()</i>", "T:trait t:method top:function", "top>$f:call top>map:call"),
    ("php", "<?php use A\\{B, C as D}; function f() { $x = new D(new B()); return match(true) { default => calc() }; }", "f:function", "m>B:use m>C:use f>C:new f>B:new f>calc:call"),
]


def _last(name):
    return name.rsplit(".", 1)[-1]


@pytest.mark.parametrize(("language", "source", "symbols", "relations"), CASES)
def test_cases(language, source, symbols, relations):
    parsed = lexical.parse("p/m.x", source, language)
    assert {f"{s[1]}:{s[2]}" for s in parsed.symbols} == set(symbols.split())
    assert {f"{_last(r[0])}>{_last(r[1])}:{r[3]}" for r in parsed.relationships} == set(relations.split())


def test_bodies_and_lines():
    source = "package a;\n/** Doc. */\n@Service\nclass A {\n\n  // x\n  int f(\n      int a) {\n    return a;\n  }\n}\n"
    rows = {s[1]: s for s in lexical.parse("a/A.java", source, "java").symbols}
    assert rows["A"][3:5] == (4, 11) and rows["A"][6] and rows["f"][3:5] == (7, 10) and rows["f"][7] == ["int"]
    assert rows["f"][5].startswith("  int f(") and rows["f"][5].endswith("}")


@pytest.mark.parametrize("language", sorted(lexical.LANGUAGES))
def test_broken_sources_end(language):
    for source in ("", "class", "class A {", "class A { void f( { g(", "}}}))]]", "class A : B, { } (", "f(a, b", "`${`${", "/* x", "\"abc", "enum {", "<?php class A { function", "a < b > (c", "template <", "@", "#", "(" * 400, "new new new", "const = = =>", "record R(", "x = /[/", "interface I { a", "case const ::"):
        lexical.parse("a.x", source, language)
        lexical.parse("a.x", "<?php " + source, language)


def _receivers(spark, files):
    rows = spark.createDataFrame([(p, "java", c) for p, c in files.items()], "path string, language string, content string")
    return {(_two(r["caller"]), _two(r["callee"]), r["is_resolved"]) for r in table.receiver_calls(table.parse_files(rows)).collect()}


def _two(name):
    return ".".join(name.split(".")[-2:])


def test_receivers_across_files(spark):
    files = {
        "x/App.java": "package x;\nimport y.Helper;\nclass App {\n  Store h;\n  Helper k = new Helper();\n  void a(Helper h) { h.go(); }\n  void b() { h.put(); { Helper h = null; h.go(); } h.put(); }\n"
        "  void c() { for (Helper h : all()) { h.go(); } h.put(); this.k.up(); Helper.make(); unknown.go(); String s = null; s.go(); }\n  void d() { var v = new Helper(); v.go(); this.b(); }\n}\n",
        "x/Store.java": "package x;\nclass Store { void put() {} }\n",
        "y/Helper.java": "package y;\nclass Helper extends Base { void go() {} static Helper make() { return null; } }\n",
        "y/Base.java": "package y;\nclass Base extends Root { }\n",
        "z/Root.java": "package z;\nclass Root extends Helper { void up() {} }\n",
        "w/Store.java": "package w;\nclass Store { void put() {} void other() {} }\n",
        "w/Use.java": "package w;\nclass Use { void m(Store s) { s.put(); s.none(); } }\n",
    }
    got = _receivers(spark, files)
    assert got == {
        ("App.a", "Helper.go", True), ("App.b", "Store.put", True), ("App.b", "Helper.go", True), ("App.c", "Helper.go", True), ("App.c", "Store.put", True), ("App.c", "Root.up", True),
        ("App.c", "Helper.make", True), ("App.d", "Helper.go", True), ("App.d", "App.b", True), ("Use.m", "Store.put", True), ("Use.m", "Store.Store", False),
    }


def test_receivers_of_nothing(spark):
    assert _receivers(spark, {"a.java": "class A { void f() { g(); } }"}) == set()


def test_parsers_in_sql(spark):
    from spindrift.sources.parsers import functions

    functions.register(spark)
    files = [("a/A.java", "java", "class A { void f() { g(); } }"), ("b.py", "python", "import os\ndef f(): pass"), ("c.py", "python", "def ("), ("d.zz", "zz", "?"), ("e.py", "python", None)]
    spark.createDataFrame([(p, lang, c, 1) for p, lang, c in files], "path string, language string, content string, id int").createOrReplaceTempView("some_files")
    run = lambda record, how="": [tuple(r) for r in spark.sql(f"SELECT * FROM parse_code(TABLE(some_files){how}, '{record}') ORDER BY path, pos").collect()]
    assert [(r[0], r[3], r[5]) for r in run("symbol", " PARTITION BY (language)")] == [("a/A.java", "a.A.A", "class"), ("a/A.java", "a.A.A.f", "method"), ("b.py", "b.f", "function")]
    assert [(r[3], r[4], r[6]) for r in run("relationship")] == [("a.A.A.f", "g", "call")]
    assert [(r[0], r[4]) for r in run("import", " WITH SINGLE PARTITION")] == [("b.py", "os")]
    assert [r[0] for r in run("error")] == ["c.py"]
    for bad in ("SELECT * FROM parse_code(TABLE(some_files), 'none')", "SELECT * FROM parse_code(TABLE(SELECT 1 AS path), 'symbol')"):
        with pytest.raises(Exception, match="argument is one of|no column"):
            spark.sql(bad).collect()
