import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import misc, paths, text
from spindrift.operators import graph, lines, modules, relational, retrieval, store
from spindrift.sources import scan
from spindrift.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_chunks_are_the_text(spark):
    for t, n in (("", 0), ("abc", 1), ("x" * 1200, 1), ("é" * 2500, 3)):
        found = one(spark, text.chunks(F.lit(t)))
        assert len(found) == n and "".join(found) == t
    assert one(spark, text.chunks(F.lit(None).cast("string"))) == []


def test_lines(spark):
    t = "a\r\nb\x0bc d\x85"
    assert one(spark, text.split_lines(F.lit(t))) == t.splitlines()
    assert one(spark, text.split_lines(F.lit(""))) == []
    assert one(spark, text.line_slice(F.lit("a\nb\nc"), 2, 5)) == (2, 3, 3, "b\nc")


@pytest.mark.parametrize(("line", "want"), [("class A:", 10), ("def f():", 9), ("  private int f(", 8), ("import os", 7), ("@x", 6), ('"""doc', 5), ("# TODO x", 5), ("return 1", 4), ("a = 1", 3), ("if x:", 3), ("", 1), ("plain", 1), ("ELSE", 3)])
def test_importance(spark, line, want):
    assert one(spark, text.line_importance(F.lit(line))) == want


def test_fences_and_diagrams(spark):
    docs = spark.createDataFrame([(1, "a\n```mermaid\ngraph\nx-->y\n```\n```mermaid\n```\n")], "id long, md string")
    assert [tuple(r) for r in text.fenced_blocks(docs, "id", "md").collect()] == [(1, 2, "graph\nx-->y")]
    assert one(spark, text.diagram(F.lit("graph\nx"))) == "graph TD\nx"
    assert one(spark, text.diagram(F.lit("no"))) is None


def test_lint_and_edits(spark):
    assert one(spark, text.parse_lint(F.lit("a.py:3:7: F821 undefined"))) == ("a.py", 3, 7, "F821 undefined")
    assert [one(spark, text.shifted_line(F.lit(x), 3, 5, 1)) for x in (2, 4, 9)] == [2, None, 7]
    assert one(spark, text.replace_once(F.lit("a b a"), "a", "c")) is None
    assert one(spark, text.replace_once(F.lit("a b"), "a", "c")) == "c b"
    assert one(spark, text.clean_doc_comment(F.lit("/**\n * Hi\n * there\n */"))) == "Hi\nthere"
    assert one(spark, text.jsdoc_types(F.lit("@param {Array<Foo>|Bar} x @returns {Baz}"))) == ["Array", "Foo", "Bar", "Baz"]


@pytest.mark.parametrize(("path", "stem", "ext"), [("a/b.tar.gz", "b.tar", ".gz"), (".env", ".env", ""), ("x/Make", "Make", ""), ("A.PY", "A", ".py")])
def test_paths(spark, path, stem, ext):
    assert one(spark, paths.stem(F.lit(path))) == stem
    assert one(spark, paths.extension(F.lit(path))) == ext


@pytest.mark.parametrize(("path", "patterns", "out"), [("bin/a.py", ["bin/"], True), ("binary.py", ["bin/"], True), ("src/bin/a.py", ["bin"], True), ("a/x.pyc", ["*.pyc"], True), ("a.py", ["[!b].py"], True), ("b.py", ["[!b].py"], False), ("bin.py", ["bin"], False)])
def test_excluded(spark, path, patterns, out):
    assert one(spark, paths.excluded(F.lit(path), patterns)) is out


def test_urls(spark):
    assert one(spark, misc.url_source(F.lit("https://github.com/o/r.git"), F.lit(None).cast("string")))[:3] == ("o", "r", "github")
    assert one(spark, misc.url_source(F.lit("git@gitlab.com:o/r.git"), F.lit(None).cast("string")))[:3] == ("o", "r", "gitlab")
    assert one(spark, misc.url_source(F.lit(None).cast("string"), F.lit("/w/mine/")))[:3] == (None, "mine", "local")
    assert one(spark, misc.clean_github_url(F.lit("git@github.com:o/r.git"))) == "https://github.com/o/r"
    assert one(spark, misc.clean_github_url(F.lit("https://x.org/o/r"))) is None
    assert one(spark, misc.valid_url(F.lit("ftp://x"))) is False


def test_scan(spark, tmp_path):
    for name, data in (("src/a.py", b"x = '\xff'\n"), ("README.md", b"# Hi"), ("node_modules/x.js", b""), ("b.bin", b"\0"), ("tests/t.py", b"")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    files = scan.scan(spark, str(tmp_path)).cache()
    assert {r["path"]: r["content"] for r in files.collect()} == {"src/a.py": "x = '�'\n", "README.md": "# Hi"}
    assert scan.readme(files).first()["path"] == "README.md"
    assert {(r["path"], r["is_dir"]) for r in scan.browse_tree(files).collect()} == {("src", True), ("src/a.py", False), ("README.md", False)}


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\nbroken\n{"id": "b"}\n')
    assert sorted(r["id"] for r in scan.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string").collect()) == ["a", "b"]


def test_components_on_small_graphs(spark):
    edges = [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (5, 6), (7, 7), (2, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    found = {r["node"]: r["component"] for r in graph.strong_components(df).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    left = graph.break_cycles(df, graph.strong_components(df))
    levels = {r["node"]: r["level"] for r in graph.topological_levels(left).collect()}
    assert all(levels[r["src"]] < levels[r["dst"]] for r in left.collect())
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(df)


def test_dependency_first(spark):
    df = spark.createDataFrame([("g", "app", "lib"), ("g", "lib", "core"), ("g", "app", "core"), ("g", "x", "y"), ("g", "y", "x")], "graph string, src string, dst string")
    assert [r["node"] for r in graph.dependency_first(df).orderBy("position").collect()] == ["core", "lib", "app", "y", "x"]


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.strong_components(empty).count() == 0
    assert graph.topological_levels(empty).count() == 0
    assert graph.type_distribution(spark.createDataFrame([], "kind string")).first()["oop_ratio"] == 0.0


def test_hash_embedding_is_unit_and_stable():
    v = retrieval.hash_embedding("x")
    assert v.shape == (384,) and abs(np.linalg.norm(v) - 1) < 1e-6 and np.array_equal(v, retrieval.hash_embedding("x"))


def test_budget_boundaries(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, 5), (4, 0), (5, 1)], "k long, n long")
    ids = lambda b: [r["k"] for r in relational.budget_prefix(df, F.col("n"), ["k"], b).orderBy("k").collect()]
    assert ids(10) == [1, 2, 3, 4] and ids(4) == [] and ids(100) == [1, 2, 3, 4, 5]


def test_suggest_modules_bounds(spark):
    clusters = spark.createDataFrame([(f"src/d{i}", 10 * i + j) for i in range(15) for j in range(i % 4 + 1)], "cluster string, id long")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    out = modules.suggest_modules(clusters, edges, 10).collect()
    assert len(out) <= 10 and sum(r["n"] for r in out) == clusters.count()


def test_changed_paths(spark):
    diff = spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",), ("D\tgone.py",), ("junk",)], "line string")
    files = spark.createDataFrame([("a.py",), ("new.py",)], "path string")
    assert sorted(r["path"] for r in store.changed_paths(diff, files).collect()) == ["a.py", "new.py"]


def test_expand_view(spark):
    code = ["import x", "", "def f():", "  a", "  b", "", "def g():", "  c"]
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(code, 1)], "k string, no int, line string")
    assert tuple(lines.expand(df, "k", 4, 5).first()) == ("k", 3, 7)


def test_usage_stream(spark, tmp_path):
    rows = spark.createDataFrame([("llm", 3, "2024-01-01 00:10:00"), ("llm", 4, "2024-01-01 00:50:00"), ("embedding", 1, "2024-01-01 02:00:00")], "kind string, total_tokens long, at string").select("kind", "total_tokens", F.to_timestamp("at").alias("created_at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = jobs.usage_stream(stream).writeStream.outputMode("update").format("memory").queryName("usage_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r["kind"], r["total_tokens"]) for r in spark.table("usage_out").collect()} == {("llm", 7), ("embedding", 1)}
