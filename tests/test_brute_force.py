"""Queries and operators that SQL does not hold: against a plain walk, or on small inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import calls, edits, graph, modules, points, relational, retrieval, trees
from spindrift.plans import catalogue, tools
from spindrift.plans import views as v
from spindrift.sources import scan

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def merged_sizes(sizes, most):
    """The two smallest clusters again and again, by a plain search."""
    sizes, into = dict(sizes), {k: k for k in sizes}
    while len(sizes) > most:
        one, two = sorted(sizes, key=lambda k: (sizes[k], k))[:2]
        common = os.path.commonprefix([one.split("/"), two.split("/")])
        name = "/".join(common) or f"{one}_and_{two}"
        n = sizes.pop(one) + sizes.pop(two)
        sizes[name] = sizes.get(name, 0) + n
        into = {k: name if x in (one, two) else x for k, x in into.items()}
    return sizes, into


@pytest.mark.parametrize("most", [1, 3, 8])
def test_suggest_modules(spark, most):
    rng = np.random.default_rng(most)
    paths = [f"{'/'.join('abc'[x] for x in rng.integers(0, 3, rng.integers(1, 4)))}/f{i}.py" for i in range(120)]
    components = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "id long, path string")
    clusters = modules.precluster(components)
    large = {r["cluster"]: r["n"] for r in modules.merge_small(clusters, 2).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    want, _ = merged_sizes(large, most)
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    got = {r["path"]: r["n"] for r in modules.suggest_modules(clusters, edges, most).collect()}
    assert got == want


def test_suggest_modules_of_the_tables(spark):
    rows = QUERIES["mod_08_suggest_modules"](spark, SF).collect()
    assert len(rows) <= 10 and sum(r["n"] for r in rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_hash_embedding(spark):
    got = {r["item_id"]: r["vector"] for r in QUERIES["sch_01_hash_embedding"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        assert np.allclose(got[r["item_id"]], retrieval.hash_embedding(r["text"])) and abs(np.linalg.norm(got[r["item_id"]]) - 1) < 1e-5
    assert len({tuple(x) for x in got.values()}) == len({r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()})


def test_numbered_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 17).select(((F.col("id") * 7919) % 5000).alias("x"))
    got = relational.numbered(rows, ["x"]).collect()
    assert all(r["position"] == r["x"] + 1 for r in got) and len(got) == 5000
    assert relational.numbered(rows.limit(0), ["x"]).count() == 0


def test_budget_with_rows_of_no_cost(spark):
    rows = [(i, 0 if i % 3 == 0 else 5, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "k int, cost int, y string")
    got = sorted((r["k"], r["running_tokens"]) for r in relational.budget_prefix(df, F.col("cost"), ["k"], 23).collect())
    want, total = [], 0
    for k, c, _ in rows:
        total += c
        if total <= 23:
            want.append((k, total))
    assert got == want


def test_components_of_a_cyclic_and_an_empty_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src long, dst long")
    of = graph.strong_components(edges)
    assert {r["node"]: r["component"] for r in of.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {r["node"]: r["level"] for r in graph.component_levels(edges, of).collect()} == {7: 0, 6: 0, 1: 1, 4: 2}
    assert graph.strong_components(edges.limit(0)).count() == 0
    assert graph.reach(edges, edges.select(F.col("src").alias("root")), 0).count() == 0


def test_refine_ends_on_parents_in_a_circle(spark):
    assigned = spark.createDataFrame([("a", "a/x"), ("b", "b/y")], "module string, path string")
    parents = spark.createDataFrame([("a", "b"), ("b", "a")], "module string, parent string")
    edges = spark.createDataFrame([], "src_path string, dst_path string")
    assert modules.refine(assigned, parents, edges).count() == 2


def test_edits_and_undo(spark):
    files = spark.createDataFrame([("a", "one\ntwo\none"), ("b", "x"), ("c", "p q")], "path string, content string")
    none = (None, None, None, None, None, None)
    wanted = [
        ("a", "str_replace", None, "one", "1", None, None, None), ("b", "insert", None, None, "y\nz", 1, None, None), ("c", "view", None, None, None, None, 1, -1),
        ("d", "create", "new", None, None, None, None, None), ("e", "str_replace", *none),
    ]
    schema = "path string, command string, file_text string, old_str string, new_str string, insert_line int, view_first int, view_last int"
    applied = edits.apply_edits(files, spark.createDataFrame(wanted, schema)).cache()
    got = {r["path"]: (r["ok"], r["content"]) for r in applied.collect()}
    assert got == {"a": (False, "one\ntwo\none"), "b": (True, "x\ny\nz"), "c": (True, "p q"), "d": (True, "new"), "e": (False, None)}
    says = {r["path"]: r["message"] for r in applied.collect()}
    assert says["a"] == "the old text occurs 2 times" and says["c"] == "     1\tp q" and says["e"] == "there is no such file"
    after = edits.written(files, applied)
    past = edits.history(spark.createDataFrame([], "path string, seq int, content string"), applied)
    back, left = edits.undo(after, past, spark.createDataFrame([("b",), ("a",)], "path string"))
    assert {r["path"]: r["content"] for r in back.collect()} == {"a": "one\ntwo\none", "b": "x", "c": "p q", "d": "new"}
    assert [r["path"] for r in left.collect()] == ["d"]
    shown = spark.range(1).select(edits.snippet(F.lit("a\nb\nc\nd"), F.lit("a\nb\nX\nY\nd"), 1).alias("s")).first()["s"]
    assert "X\nY" in shown and not shown.startswith("a")


def test_trees_there_and_back(spark):
    deep = '{"n0": {"path": "p0", "components": ["a\\"b"], "children": {' * 1 + '"z": {"children": {"y": {}}}, "k": {"components": null}' + "}}}"
    rows = spark.createDataFrame([(1, deep), (2, "{}"), (3, None), (4, "no object"), (5, '{"only": {}}')], "repo_id long, tree string")
    nodes = trees.module_nodes(rows)
    assert sorted((r["repo_id"], r["module_id"], r["depth"], r["parent_id"]) for r in nodes.collect()) == [(1, "k", 1, "p0"), (1, "p0", 0, None), (1, "y", 2, "z"), (1, "z", 1, "p0"), (5, "only", 0, None)]
    import json

    back = {r["repo_id"]: json.loads(r["tree"]) for r in trees.nested(nodes).collect()}
    assert back[1]["n0"]["components"] == ['a"b'] and list(back[1]["n0"]["children"]) == ["z", "k"] and list(back[1]["n0"]["children"]["z"]["children"]) == ["y"]
    assert trees.module_nodes(trees.nested(nodes)).count() == nodes.count()


def test_directory_tree_as_json(spark):
    import json

    files = spark.createDataFrame([("a/b/x.py", 1), ("a/y.md", 2), ("z.txt", 3)], "path string, size long")
    found = {r["path"]: json.loads(r["json"]) for r in trees.tree_json(scan.browse_tree(files)).collect()}
    assert found[""] == {"a": {"b": {"x.py": "python"}, "y.md": "markdown"}, "z.txt": "plaintext"}


def test_scan_leaves_links_and_excludes_out(spark, tmp_path):
    (tmp_path / "root/sub").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    for name in ("root/a.py", "root/sub/b.py", "out/c.py", "root/sub/d.class", "root/package-lock.json", "root/.env"):
        (tmp_path / name).write_text("x = 1\n")
    os.symlink(tmp_path / "out", tmp_path / "root/link")
    os.symlink(tmp_path / "out/c.py", tmp_path / "root/c.py")
    os.symlink(tmp_path / "root/sub", tmp_path / "root/again")
    found = scan.scan(spark, str(tmp_path / "root"), include=[])
    assert sorted(r["path"] for r in found.collect()) == ["a.py", "sub/b.py"]
    assert [r["absolute_path"] for r in scan.discover(spark, str(tmp_path / "root"), ("python",)).collect()] == [f"{tmp_path}/root/a.py", f"{tmp_path}/root/sub/b.py"]


def test_calls_are_tried_and_their_failures_are_rows(spark):
    def call(texts, model):
        if "bad" in texts[0]:
            raise ValueError("no")
        return [(t.upper(), 1, 2) for t in texts]

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id long, prompt string").coalesce(1)
    got = {r["id"]: r for r in calls.complete(rows, "id", "prompt", call, ("m",), tries=2, batch=1).collect()}
    assert got[1]["answer"] == "GOOD" and got[3]["answer"] == "" and got[2]["answer"] is None and got[2]["attempts"] == 2 and "ValueError: no" in got[2]["error"]
    usage = calls.usage_rows(calls.complete(rows, "id", "prompt", call, ("m",), 1, 1), F.lit(7), "llm", "test", F.lit("now")).collect()
    assert sum(r["total_tokens"] for r in usage) == 6 and {r["repo_id"] for r in usage} == {7}


def test_clustering_gate_retry_and_fallback(spark):
    components = spark.createDataFrame([(i, f"d{i % 3}/f{i}") for i in range(9)], "id long, path string")
    tried = []

    def propose(df):
        tried.append(1)
        names = F.when(F.col("id") < 4, "one").otherwise("two") if len(tried) > 1 else F.lit("all")
        return df.select(names.alias("cluster"), "id").unionByName(spark.createDataFrame([("ghost", 99)], "cluster string, id long"))

    assert calls.clustered(components, 10, 100, propose, modules.precluster).count() == 0 and not tried
    got = calls.clustered(components, 1000, 100, propose, modules.precluster)
    assert {r["cluster"] for r in got.collect()} == {"one", "two"} and got.count() == 9
    assert {r["cluster"] for r in calls.clustered(components, 1000, 100, lambda df: df.select(F.lit("x").alias("cluster"), "id"), modules.precluster).collect()} == {"d0", "d1", "d2"}


def test_documents_of_modules_from_below(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("a", "r", 1), ("b", "r", 1), ("c", "a", 2), ("deep", "c", 3)], "module_id string, parent_id string, depth int")

    def prompt(level, below):
        if below is None:
            return level.select("module_id", F.col("module_id").alias("prompt"))
        inner = below.join(nodes.select("module_id", "parent_id"), "module_id").groupBy(F.col("parent_id").alias("of")).agg(F.array_join(F.array_sort(F.collect_list("content")), "+").alias("x"))
        return level.join(inner, level["module_id"] == inner["of"], "left").select("module_id", F.concat("module_id", F.lit("("), F.coalesce("x", F.lit("")), F.lit(")")).alias("prompt"))

    rounds = graph.Rounds(spark)
    got = calls.documented(nodes, prompt, lambda asked: asked.withColumnRenamed("prompt", "content"), rounds.keep)
    assert {r["module_id"]: r["content"] for r in got.collect()} == {"c": "c", "a": "a(c)", "b": "b()", "r": "r(a(c)+b())"}


def test_incremental_reads(spark):
    repos = spark.createDataFrame([("r1", "c1"), ("r2", "c0"), ("r3", None)], "repo_id string, commit string")
    heads = spark.createDataFrame([("r1", "c1"), ("r2", "c2"), ("r3", "c3"), ("r4", "c4")], "repo_id string, commit string")
    assert [r["repo_id"] for r in points.unchanged(repos, heads).collect()] == ["r1"]
    assert sorted(r["repo_id"] for r in points.to_update(repos, heads).collect()) == ["r2", "r3", "r4"]


def test_every_tool_answers(spark):
    tables = {"files": v.files(spark, SF), "symbols": v.symbols(spark, SF), "file_edges": v.file_edges(spark, SF)}
    path = tables["files"].orderBy("path").first()["path"]
    given = {"query": "a", "file_path": path, "symbol_id": "3"}
    assert len(tools.TOOLS) == 13
    for name, tool in tools.TOOLS.items():
        out = tools.call(name, tables, {p: given[p] for p in tool.required})
        assert out.columns and (out.limit(1).count() or name in ("get_file_outline", "search_in_file")), name
    with pytest.raises(ValueError, match="unknown tool"):
        tools.call("nope", tables)
    with pytest.raises(ValueError, match="needs file_path"):
        tools.call("get_file_content", tables)
    with pytest.raises(ValueError, match="takes no size"):
        tools.call("get_file_tree", tables, {"size": 1})


def test_point_helpers(spark):
    one = spark.range(1)
    url = lambda *x: one.select(points.git_url(*map(F.lit, x)).alias("u")).first()["u"]
    assert url("github", "o", "r", "") == "https://github.com/o/r" and url("local", "o", "r", "/x") == "" and url("gitlab", "o", "r", "http://h/x") == "http://h/x" and url("git", "o", "r", "") == ""
    kinds = one.select(*[points.component_type(F.lit(k), F.lit("p")).alias(str(i)) for i, k in enumerate(["interface", "async_function", "method", None])]).first()
    assert tuple(kinds) == ("class", "function", "method", "module")


def test_appended_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, kind string")
    points.append_rows(rows, str(tmp_path / "usage"))
    points.append_rows(rows, str(tmp_path / "usage"))
    assert spark.read.parquet(str(tmp_path / "usage")).count() == 2
