"""Queries over point reads, nested trees, edits, outside calls (by a stand-in) and named tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import calls, edits, points, trees
from spindrift.operators.modules import path_tree, processing_order
from spindrift.plans import tools
from spindrift.plans import views as v
from spindrift.plans.registry import Registry
from spindrift.sources import scan

R = Registry()


@R.add("hlp_01_repo_attribute", f"{v.ctes('repos')} SELECT owner_id, status FROM repos WHERE id = 7")
def repo_attribute(spark, d):
    return points.attributes(v.repos(spark, d), "id", 7, "owner_id", "status")


@R.add("hlp_02_settings", "SELECT 'https://h' AS base_url, 'k' AS api_key, n_name AS model_name, true AS is_complete FROM nation WHERE n_nationkey = 3")
def settings(spark, d):
    n = v.table(spark, d, "nation")
    rows = n.select(F.concat(F.lit("model"), F.col("n_nationkey").cast("string")).alias("key"), F.to_json(F.struct(F.lit("https://h").alias("base_url"), F.lit("k").alias("api_key"), F.col("n_name").alias("model_name"))).alias("value"))
    return points.config(rows, "model3")


@R.add("prj_02_adapted_symbols", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_brand ELSE 'function' END AS kind, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS line_start FROM part")
def adapted_symbols(spark, d):
    p, k = v.table(spark, d, "part"), F.col("p_size") % 3
    nodes = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.when(k == 0, F.col("p_type")).when(k == 1, "").alias("node_type"),
        F.when(k < 2, F.col("p_brand")).alias("component_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("class_name"))
    return points.adapted_symbols(nodes).select("id", "kind", "line_start")


@R.add("prj_05_display_names", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || '/' || c_name WHEN 1 THEN c_name WHEN 2 THEN c_name ELSE c_custkey::VARCHAR END AS label FROM customer")
def display_names(spark, d):
    c, k = v.table(spark, d, "customer"), F.col("c_custkey") % 4
    kind = F.when(k == 0, "github").when(k == 1, "local").otherwise("git")
    label = points.display_name(kind, F.col("c_mktsegment"), F.when(k < 3, F.col("c_name")), F.concat(F.lit("C:\\work/"), "c_name"), F.when(k == 2, F.col("c_name")), F.col("c_custkey").cast("string"))
    return c.select(F.col("c_custkey").alias("id"), label.alias("label"))


@R.add("set_03_has_types", f"{v.ctes('symbols')} SELECT count(*) FILTER (kind IN ('class', 'struct')) > 0 AS found FROM symbols")
def has_types(spark, d):
    return points.has_types(v.symbols(spark, d), ("class", "struct"))


@R.add("srt_10_recent_jobs", "SELECT event_id AS job_id, ts AS created_at FROM events ORDER BY ts DESC, event_id LIMIT 25")
def recent_jobs(spark, d):
    return points.recent_jobs(v.table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at")), 25)


@R.add("str_05_admitted_jobs", "SELECT event_id AS job_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 60")
def admitted_jobs(spark, d):
    jobs = v.table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"))
    return points.admitted(jobs, 40).select("job_id")


@R.add("hlp_05_last_definitions", f"{v.ctes('symbols')} SELECT file_path, kind AS name, max(id) AS id FROM symbols GROUP BY 1, 2")
def last_definitions(spark, d):
    s = v.symbols(spark, d)
    return points.last_definitions(s.select("id", F.col("kind").alias("name"), "file_path", F.col("id").alias("pos")))


@R.add("hlp_09_support", f"{v.ctes('files')} SELECT count(*) FILTER (doc_id % 4 < 3) AS n_code, count(*) FILTER (doc_id % 4 < 2) AS n_supported, count(*) FILTER (doc_id % 4 = 2) AS n_unsupported FROM files")
def support(spark, d):
    k = F.col("doc_id") % 4
    return scan.support(v.files(spark, d).select(F.concat("path", F.when(k == 0, ".py").when(k == 1, ".java").when(k == 2, ".rb").otherwise(".bin")).alias("path")))


@R.add("hlp_10_structure", f"{v.ctes('files')} SELECT count(*) AS n_files, round(sum(size) / 1024.0, 4) AS total_kb, (SELECT count(*) FROM (SELECT split_part(path, '/', 1) AS p FROM files UNION SELECT split_part(path, '/', 1) || '/' || language FROM files)) AS n_directories FROM files")
def structure(spark, d):
    tree, totals = scan.structure(v.files(spark, d))
    return totals.crossJoin(tree.agg(F.count_if("is_dir").alias("n_directories"))).select("n_files", F.round("total_kb", 4).alias("total_kb"), "n_directories")  # one row each


@R.add("hlp_11_12_module_ids", f"{v.ctes('symbols')} SELECT DISTINCT file_path || '.' || kind AS module_id FROM symbols")
def module_ids(spark, d):
    return points.module_ids(v.symbols(spark, d).select(F.concat_ws(".", "file_path", "kind", F.col("id").cast("string")).alias("id")))


@R.add("hlp_18_remaining_modules", f"{v.ctes('files')}, t AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM files UNION SELECT split_part(path, '/', 1) || '/' || language FROM files UNION SELECT ''), o AS (SELECT prefix, row_number() OVER (ORDER BY CASE WHEN prefix = '' THEN chr(1114111) ELSE prefix || '/' || chr(1114111) END) AS position, count(*) OVER () AS n FROM t) SELECT prefix, position, round((position - 1) / n, 6) AS progress FROM o WHERE NOT ends_with(prefix, '/en')")
def remaining_modules(spark, d):
    order = processing_order(path_tree(v.files(spark, d))).select("prefix", "position")
    return calls.remaining(order, order.where(F.col("prefix").endswith("/en"))).select("prefix", "position", F.round("progress", 6).alias("progress"))


@R.add("hlp_21_shortened", "SELECT doc_id, CASE WHEN length(text) > 100 THEN text[1:100] || ' <cut>' ELSE text END AS text FROM documents")
def shortened(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.shortened(F.col("text"), 100, " <cut>").alias("text"))


@R.add("hlp_25_validation", "SELECT n_nationkey AS id, n_nationkey % 3 = 0 AS key_ok, n_nationkey % 2 = 0 AS model_ok, n_nationkey % 4 = 0 AS top FROM nation")
def validation(spark, d):
    n = F.col("n_nationkey")
    key = F.when(n % 3 == 0, "sk-1234567890").when(n % 3 == 1, "short").otherwise("has a space in it")
    model = F.when(n % 4 == 0, "Claude-Opus").when(n % 2 == 0, "small").otherwise(" ")
    return v.table(spark, d, "nation").select(n.alias("id"), points.valid_key(key).alias("key_ok"), points.valid_model(model).alias("model_ok"), points.is_top_tier(model).alias("top"))


@R.add("hlp_31_node_index", f"{v.ctes('files')} SELECT split_part(path, '/', 1) AS prefix, min(doc_id) AS module_id FROM files GROUP BY 1")
def node_index(spark, d):
    nodes = v.files(spark, d).select(F.col("doc_id").alias("module_id"), F.split_part("path", F.lit("/"), F.lit(1)).alias("prefix"), F.lit("n").alias("name"))
    return points.node_index(nodes.unionByName(nodes.limit(1).withColumn("prefix", F.lit("")))).select("prefix", "module_id")


@R.add("hlp_33_message_json", "SELECT conv_id, turn, json_object('role', coalesce(CASE WHEN turn % 2 = 0 THEN role END, 'user'), 'content', text, 'thinking', NULL, 'citations', NULL, 'timestamp', '2024-01-01')::VARCHAR AS json FROM conversations")
def message_json(spark, d):
    c = v.table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("role")).alias("role"), F.col("text").alias("content"), F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("string").alias("citations"), F.lit(None).cast("string").alias("timestamp"))
    return points.message_json(rows, F.lit("2024-01-01"))


@R.add("inc_01_to_update", f"{v.ctes('repos')} SELECT id AS repo_id FROM repos WHERE id % 3 <> 0")
def to_update(spark, d):
    r = v.repos(spark, d)
    known = r.where("id % 5 <> 1 OR id % 3 = 0").select(F.col("id").alias("repo_id"), F.when(F.col("id") % 3 == 0, "c1").when(F.col("id") % 3 == 1, "c0").otherwise("").alias("commit"))
    return points.to_update(known, r.select(F.col("id").alias("repo_id"), F.lit("c1").alias("commit"))).select("repo_id")


def _trees(spark, d):
    """For each customer a tree of two levels: its segment, and below it two modules that share a component."""
    c = F.col("c_custkey").cast("string")
    text = F.concat(F.lit('{"'), "c_mktsegment", F.lit('": {"path": "m/'), c, F.lit('", "components": ["'), c, F.lit('", "x"], "children": {"b": {"path": "m/'), c, F.lit('/b", "components": ["s1"], "children": {}}, "a": {"components": ["s1", "s2"]}}}}'))
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), text.alias("tree"))


_NODES = "nodes AS (SELECT c_custkey AS repo_id, 'm/' || c_custkey AS module_id, c_mktsegment AS name, NULL AS parent_id, 0 AS depth, c_custkey || ',x' AS components FROM customer UNION ALL SELECT c_custkey, 'm/' || c_custkey || '/b', 'b', 'm/' || c_custkey, 1, 's1' FROM customer UNION ALL SELECT c_custkey, 'a', 'a', 'm/' || c_custkey, 1, 's1,s2' FROM customer)"


@R.add("hlp_13_module_nodes", f"WITH {_NODES} SELECT * FROM nodes")
def module_nodes(spark, d):
    return trees.module_nodes(_trees(spark, d)).select("repo_id", "module_id", "name", "parent_id", "depth", F.array_join("components", ",").alias("components"))


@R.add("mod_02_subtree_files", "SELECT c_custkey AS repo_id, 'm/' || c_custkey AS module_id, c_custkey || '.py,s1.py,s1.py,s2.py' AS files FROM customer UNION ALL SELECT c_custkey, 'm/' || c_custkey || '/b', 's1.py' FROM customer UNION ALL SELECT c_custkey, 'a', 's1.py,s2.py' FROM customer")
def subtree_files(spark, d):
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"))
    symbols = c.select("repo_id", F.explode(F.array(F.col("repo_id").cast("string"), F.lit("s1"), F.lit("s2"))).alias("id")).withColumn("file_path", F.concat("id", F.lit(".py")))
    out = trees.subtree_files(trees.module_nodes(_trees(spark, d)), symbols)
    listed = out.groupBy("repo_id", "module_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]), ",").alias("files"))
    return listed.drop("place")


@R.add("hlp_14_module_documents", "SELECT c_custkey AS repo_id, 'm/' || c_custkey || '/b' AS module_id, 'doc b' AS content FROM customer WHERE c_custkey % 2 = 0")
def module_documents(spark, d):
    c = v.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("repo_id"))
    files = c.select("repo_id", F.explode(F.array(F.lit("docs/b.md"), F.lit("overview.md"), F.lit("a.txt"))).alias("path")).withColumn("content", F.lit("doc b"))
    return trees.module_documents(trees.module_nodes(_trees(spark, d)), files)


@R.add("hlp_29_nested_trees", """SELECT c_custkey AS repo_id, '{"' || c_mktsegment || '": {"path": "m/' || c_custkey || '", "components": ["' || c_custkey || '","x"], "children": {"b": {"path": "m/' || c_custkey || '/b", "components": ["s1"], "children": {}}, "a": {"path": "a", "components": ["s1","s2"], "children": {}}}}}' AS tree FROM customer""")
def nested_trees(spark, d):
    return trees.nested(trees.module_nodes(_trees(spark, d)))


@R.add("mod_14_submodule_specs", "SELECT c_custkey AS id, n AS name, CASE c_custkey % 3 WHEN 0 THEN CASE n WHEN 'a' THEN 'x,1' WHEN 'b' THEN '' ELSE 'z' END WHEN 1 THEN CASE n WHEN 'a' THEN 'x' ELSE 'y' END END AS components FROM customer, (VALUES ('a'), ('b'), ('c')) t(n) WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND n <> 'c')")
def submodule_specs(spark, d):
    k = F.col("c_custkey") % 3
    spec = F.when(k == 0, '{"a": ["x", 1], "b": null, "c": "z"}').when(k == 1, '[{"sub_module_name": "a", "components": ["w"]}, {"name": "b", "core_components": "y"}, 5, {"components": []}, {"module_name": "a", "core_component_ids": ["x"]}]').otherwise("nothing")
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), spec.alias("spec"))
    return trees.submodule_specs(rows, "id", "spec").select("id", "name", F.array_join("components", ",").alias("components"))


@R.add("txt_29_edits", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN (length(text) - length(replace(text, ' ', ''))) = 1 THEN replace(text, ' ', '_') ELSE text END WHEN 1 THEN 'first' || chr(10) || text ELSE text END AS content,
    CASE doc_id % 3 WHEN 0 THEN (length(text) - length(replace(text, ' ', ''))) = 1 WHEN 1 THEN true ELSE false END AS ok FROM documents""")
def edit_files(spark, d):
    docs, k = v.table(spark, d, "documents"), F.col("doc_id") % 3
    files = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    none = F.lit(None)
    wanted = docs.select(
        F.col("doc_id").alias("path"), F.when(k == 0, "str_replace").when(k == 1, "insert").otherwise("create").alias("command"), F.lit("new").alias("file_text"), F.lit(" ").alias("old_str"),
        F.when(k == 0, "_").otherwise("first").alias("new_str"), F.lit(0).alias("insert_line"), none.cast("int").alias("view_first"), none.cast("int").alias("view_last"))
    applied = edits.apply_edits(files, wanted)
    return edits.written(files, applied).join(applied.select("path", "ok"), "path").select(F.col("path").alias("doc_id"), "content", "ok")


@R.add("udf_03_completions", "SELECT item_id, '<' || text[1:20] || '>' AS answer, (length(text) // 4)::BIGINT AS prompt_tokens, 'b' AS model, 4 AS attempts FROM benchmark")
def completions(spark, d):
    def stand_in(texts: list[str], model: str) -> list[tuple]:
        if model == "a":
            raise TimeoutError("no answer")
        return [(f"<{t[:20]}>", None, None) for t in texts]

    return calls.complete(v.table(spark, d, "benchmark"), "item_id", "text", stand_in, ("a", "b")).select("item_id", "answer", "prompt_tokens", "model", "attempts")


@R.add("sch_02_03_inc_03_index", "SELECT doc_id || '::chunk:' || i AS id, doc_id % 2 = 1 OR i % 2 = 1 AS is_new, length(text[i * 1200 + 1 : i * 1200 + 1200])::DOUBLE AS size FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1199) // 1200)) AS i FROM documents)")
def rebuild_index(spark, d):
    def stand_in(texts: list[str], model: str) -> list[tuple]:
        return [([float(len(t))], 1, 0) for t in texts]

    docs = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    chunks = text.chunk_rows(docs, "path", "text")
    cached = chunks.where("path % 2 = 0").select("id", F.when(F.col("chunk_no") % 2 == 0, F.col("text")).otherwise("old").alias("text"), F.array(F.length("text").cast("float")).alias("vector"))
    out = calls.rebuild_index(docs, cached, lambda rows: calls.embed_with(rows, "id", "text", stand_in))
    return out.select("id", "is_new", F.element_at("vector", 1).cast("double").alias("size"))


@R.add("udf_04_read_through", "SELECT n_nationkey AS module_id, CASE WHEN n_nationkey % 2 = 0 THEN 'cached' ELSE 'made ' || n_name END AS content FROM nation")
def read_through(spark, d):
    n = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("module_id"), "n_name")
    cache = n.select("module_id", F.when(F.col("module_id") % 2 == 0, "cached").otherwise("").alias("content"))
    found, _ = calls.read_through(n, cache, ["module_id"], "content", lambda rows: rows.select("module_id", F.concat(F.lit("made "), "n_name").alias("content")))
    return found.select("module_id", "content")


@R.add("udf_05_symbol_sources", f"{v.ctes('files', 'symbols')} SELECT s.id, array_to_string(l[s.line_start:s.line_end], chr(10)) AS source FROM symbols s JOIN (SELECT doc_id, string_split(content, chr(10)) AS l FROM files) f ON f.doc_id = s.id UNION ALL SELECT id, NULL FROM symbols WHERE id NOT IN (SELECT doc_id FROM files)")
def symbol_sources(spark, d):
    s = v.symbols(spark, d).withColumn("file_path", F.col("id").cast("string"))
    return calls.symbol_sources(s, v.files(spark, d).select(F.col("doc_id").cast("string").alias("path"), "content")).select("id", "source")


def _tables(spark, d):
    return {"files": v.files(spark, d), "symbols": v.symbols(spark, d), "file_edges": v.file_edges(spark, d)}


@R.add("udf_02_tool_dependencies", f"{v.ctes('file_edges')} SELECT DISTINCT src_path, dst_path FROM file_edges WHERE src_path = 'Brand#11' OR dst_path = 'Brand#11'")
def tool_dependencies(spark, d):
    return tools.call("get_dependencies", _tables(spark, d), {"file_path": "Brand#11"})


@R.add("udf_02_tool_symbols", f"{v.ctes('symbols')} SELECT id FROM symbols WHERE contains(lower(name), 'bolt') AND kind = 'class'")
def tool_symbols(spark, d):
    return tools.call("search_symbols", _tables(spark, d), {"query": "Bolt", "kind": "class"}).select("id")
