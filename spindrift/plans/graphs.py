"""Queries over call graphs, components, hierarchies and module clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import graph, modules
from spindrift.plans import views as v
from spindrift.plans.registry import Registry
from spindrift.sources import scan

R = Registry()


def _components(spark, d):
    """Symbols as components: lines and documentation from their numbers, a directory path from file and kind."""
    s = v.symbols(spark, d)
    return s.select("id", "name", "kind", "file_path", (F.col("line_start") * 5).alias("lines"), (F.col("id") % 3 == 0).alias("has_docstring"))


_COMPONENTS = "components AS (SELECT id, name, kind, file_path, line_start * 5 AS lines, id % 3 = 0 AS has_docstring FROM symbols)"
_TREE = "parts AS (SELECT path, string_split(path, '/') AS p FROM files), dirs AS (SELECT path, i AS depth, array_to_string(p[1:i], '/') AS prefix FROM (SELECT path, p, unnest(range(0, len(p))) AS i FROM parts))"


@R.add("grf_05_graph_build", f"{v.ctes('calls')} SELECT src, dst FROM calls WHERE src % 5 <> 0 AND dst % 5 <> 0")
def graph_build(spark, d):
    return graph.build_graph(v.symbols(spark, d).where("id % 5 <> 0"), v.call_sites(spark, d))


@R.add("grf_12_in_out_degree", f"{v.ctes('call_sites')} SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM call_sites UNION ALL SELECT src, 0, 1 FROM call_sites) GROUP BY node")
def in_out_degree(spark, d):
    return graph.degrees(v.call_sites(spark, d))


_TOP = "both_ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), top AS (SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY 1 ORDER BY degree DESC, node LIMIT 50)"


@R.add("grf_10_degree_centrality", f"{v.ctes('calls')}, {_TOP} SELECT * FROM top")
def degree_centrality(spark, d):
    return graph.degree_centrality(v.calls(spark, d), 50)


@R.add("grf_10_induced_subgraph", f"{v.ctes('calls')}, {_TOP} SELECT src, dst FROM calls WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)")
def induced_subgraph(spark, d):
    edges = v.calls(spark, d)
    return graph.induced(edges, graph.degree_centrality(edges, 50))


@R.add(
    "grf_01_strong_components",
    f"""{v.ctes("calls")}, reach AS (SELECT src AS a, dst AS b FROM calls UNION SELECT r.a, e.dst FROM reach r JOIN calls e ON e.src = r.b),
    nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls), mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a)
    SELECT node, least(node, coalesce((SELECT min(b) FROM mutual WHERE a = node), node)) AS component FROM nodes""",
)
def strong_components(spark, d):
    return graph.strong_components(v.calls(spark, d))


def _kept_calls(spark, d):
    """The calls as a written table, for queries that read them several times."""
    return graph.Rounds(spark).keep(v.calls(spark, d))


@R.add("grf_02_cycle_breaking", f"""{v.ctes("calls")}, reach AS (SELECT src AS a, dst AS b FROM calls UNION SELECT r.a, e.dst FROM reach r JOIN calls e ON e.src = r.b)
    SELECT src, dst FROM calls WHERE src < dst OR NOT EXISTS (SELECT 1 FROM reach WHERE a = dst AND b = src)""")
def cycle_breaking(spark, d):
    edges = _kept_calls(spark, d)
    return graph.break_cycles(edges, graph.strong_components(edges))


@R.add(
    "grf_03_topological_levels",
    f"""{v.ctes("calls")}, reach AS (SELECT src AS a, dst AS b FROM calls UNION SELECT r.a, e.dst FROM reach r JOIN calls e ON e.src = r.b),
    nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls), back AS (SELECT x.a AS node, min(x.b) AS least FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1),
    c AS (SELECT n.node, least(n.node, coalesce(b.least, n.node)) AS component FROM nodes n LEFT JOIN back b USING (node)),
    e AS (SELECT DISTINCT x.component AS src, y.component AS dst FROM calls JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.component <> y.component),
    walk AS (SELECT DISTINCT component AS node, 0 AS level FROM c WHERE component NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM walk JOIN e ON src = node)
    SELECT c.node, max(level) AS level FROM c JOIN walk w ON w.node = c.component GROUP BY c.node""",
)
def topological_levels(spark, d):
    """Of all calls: the level of each node's component in the graph of components, which has no cycle."""
    edges = _kept_calls(spark, d)
    of = graph.Rounds(spark).keep(graph.strong_components(edges))
    levels = graph.component_levels(edges, of)
    return of.join(levels.withColumnRenamed("node", "component"), "component").select("node", "level")


@R.add(
    "grf_04_dependency_first_order",
    f"""{v.ctes("calls")}, reach AS (SELECT src AS a, dst AS b FROM calls UNION SELECT r.a, e.dst FROM reach r JOIN calls e ON e.src = r.b),
    nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls), back AS (SELECT x.a AS node, min(x.b) AS least FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1),
    c AS (SELECT n.node, least(n.node, coalesce(b.least, n.node)) AS component FROM nodes n LEFT JOIN back b USING (node)),
    e AS (SELECT DISTINCT y.component AS src, x.component AS dst FROM calls JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.component <> y.component),
    walk AS (SELECT DISTINCT component AS node, 0 AS level FROM c WHERE component NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM walk JOIN e ON src = node),
    l AS (SELECT node AS component, max(level) AS level FROM walk GROUP BY node),
    either AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls), around AS (SELECT a AS node, a AS least FROM either UNION SELECT e.b, r.least FROM around r JOIN either e ON e.a = r.node WHERE r.least < e.b),
    g AS (SELECT node, min(least) AS graph FROM around GROUP BY node)
    SELECT graph, node, row_number() OVER (ORDER BY level, component, node DESC) AS position FROM c JOIN l USING (component) JOIN g USING (node)""",
)
def dependency_first_order(spark, d):
    """All calls: callees before their callers, cycles together; graph is the weak component."""
    edges = _kept_calls(spark, d)
    rounds = graph.Rounds(spark)
    of = rounds.keep(graph.strong_components(edges))
    # What holds of components holds of their names, which are nodes: order and weak components need only the edges between them.
    between = rounds.keep(graph.condensed(edges, of))
    order = graph.dependency_order(between, of)
    weak = graph.weak_components(between).select(F.col("node").alias("component"), F.col("component").alias("graph"))
    graphs = of.join(weak, "component", "left").select("node", F.coalesce("graph", "component").alias("graph"))
    return order.join(graphs, "node").select("graph", "node", "position")


@R.add("grf_04_depth_first_orders")
def depth_first_orders(spark, d):
    """The depth-first order of each repository: the calls between parts of one brand, without their cycles."""
    s = v.symbols(spark, d).select("id", "file_path")
    inner = v.calls(spark, d).join(s.select(F.col("id").alias("src"), F.col("file_path").alias("graph")), "src").join(s.select(F.col("id").alias("dst"), F.col("file_path").alias("_of")), "dst").where("graph = _of")
    inner = graph.Rounds(spark).keep(inner.select("src", "dst"))
    acyclic = graph.break_cycles(inner, graph.strong_components(inner))
    every = acyclic.join(s.select(F.col("id").alias("src"), F.col("file_path").alias("graph")), "src").select("src", "dst", "graph")
    return graph.dependency_first(every.unionByName(s.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("file_path").alias("graph"))))


def _reach_sql(depth: int, forward: bool) -> str:
    step = "e.src = w.node" if forward else "e.dst = w.node"
    to = "e.dst" if forward else "e.src"
    return f"""{v.ctes("calls")}, roots(root) AS (SELECT DISTINCT src FROM calls WHERE src % 100 = 0), walk AS (SELECT root, root AS node, 0 AS d FROM roots UNION SELECT w.root, {to}, w.d + 1 FROM walk w JOIN calls e ON {step} WHERE w.d < {depth}),
    first AS (SELECT root, node, min(d) AS d FROM walk GROUP BY 1, 2) SELECT w.root, e.src, e.dst, w.d + 1 AS depth FROM first w JOIN calls e ON {step} WHERE w.d < {depth}"""


@R.add("grf_11_call_graph_down", _reach_sql(2, True))
def call_graph_down(spark, d):
    edges = v.calls(spark, d)
    return graph.reach(edges, edges.where("src % 100 = 0").select(F.col("src").alias("root")), 2)


@R.add("grf_11_call_graph_up", _reach_sql(2, False))
def call_graph_up(spark, d):
    edges = v.calls(spark, d)
    return graph.reach(edges, edges.where("src % 100 = 0").select(F.col("src").alias("root")), 2, down=False)


@R.add("grf_06_type_distribution", f"{v.ctes('symbols')} SELECT count(*) AS total, count(*) FILTER (kind = 'class') AS oop_count, count(*) FILTER (kind IN ('function', 'method')) AS func_count, round(count(*) FILTER (kind = 'class') / count(*), 6) AS oop_ratio, round(count(*) FILTER (kind IN ('function', 'method')) / count(*), 6) AS func_ratio FROM symbols")
def type_distribution(spark, d):
    return graph.type_distribution(v.symbols(spark, d)).select("total", "oop_count", "func_count", F.round("oop_ratio", 6).alias("oop_ratio"), F.round("func_ratio", 6).alias("func_ratio"))


@R.add("grf_07_valid_types", f"{v.ctes('symbols')} SELECT file_path, count(*) FILTER (kind = 'class') = 0 OR (count(*) FILTER (kind = 'class') / count(*) < 0.1 AND count(*) FILTER (kind <> 'class') > 20) OR (count(*) FILTER (kind = 'class') < 5 AND count(*) FILTER (kind <> 'class') > 50) AS with_functions FROM symbols GROUP BY file_path")
def valid_types(spark, d):
    s = v.symbols(spark, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "class").alias("oop_count"), F.count_if(F.col("kind") != "class").alias("func_count"))
    few = (F.col("oop_count") / F.col("total") < 0.1) & (F.col("func_count") > 20)
    return s.select("file_path", ((F.col("oop_count") == 0) | few | ((F.col("oop_count") < 5) & (F.col("func_count") > 50))).alias("with_functions"))


_IMPORTANCE = """imp AS (SELECT c.id, least(100, least(coalesce(u.n, 0) * 5, 30) + CASE WHEN name IN ('main', '__main__', 'run', 'start', 'execute') THEN 20 WHEN NOT starts_with(name, '_') THEN 10 ELSE 0 END + CASE WHEN has_docstring THEN 15 ELSE 0 END
    + CASE WHEN lines BETWEEN 10 AND 200 THEN 10 WHEN lines BETWEEN 5 AND 9 THEN 5 ELSE 0 END + CASE WHEN kind IN ('class', 'interface') THEN 10 ELSE 0 END)::BIGINT AS importance FROM components c LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM calls GROUP BY dst) u ON u.dst = c.id)"""


@R.add("grf_08_importance", f"{v.ctes('symbols', 'calls')}, {_COMPONENTS}, {_IMPORTANCE} SELECT * FROM imp")
def importance(spark, d):
    return graph.importance(_components(spark, d), v.calls(spark, d))


@R.add("grf_09_flt_10_leaf_nodes", f"""{v.ctes("symbols", "calls")}, {_COMPONENTS}, {_IMPORTANCE}, typed AS (SELECT i.* FROM imp i JOIN components c USING (id) WHERE c.kind = 'class' AND NOT regexp_matches(lower(name), 'error|failed|invalid')),
    free AS (SELECT * FROM typed WHERE id NOT IN (SELECT dst FROM calls)), n AS (SELECT (SELECT count(*) FROM typed) AS typed, (SELECT count(*) FROM free) AS free)
    SELECT id, importance FROM typed, n WHERE n.typed < 100 UNION ALL SELECT id, importance FROM (SELECT f.*, row_number() OVER (ORDER BY importance DESC, id) AS r FROM free f), n WHERE n.typed >= 100 AND (n.free < 100 OR r <= 100)""")
def leaf_nodes(spark, d):
    return graph.leaf_nodes(_components(spark, d), v.calls(spark, d), 100)


@R.add("flt_11_final_leaves", f"{v.ctes('symbols')} SELECT id, kind FROM symbols WHERE id % 2 = 0 AND kind = 'class' AND trim(name) <> '' AND NOT regexp_matches(lower(name), 'error|exception|failed|invalid')")
def final_leaves(spark, d):
    s = v.symbols(spark, d)
    return graph.final_leaves(s.where("id % 2 = 0").select("id"), s)


@R.add("grf_13_dependency_info", f"""{v.ctes("calls")}, m AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0), e AS (SELECT src, dst, dst % 3 = 0 AS inside FROM calls WHERE src % 3 = 0),
    o AS (SELECT src AS id, count(*) FILTER (inside) AS internal, count(*) FILTER (NOT inside) AS external FROM e GROUP BY 1), u AS (SELECT dst AS id, count(DISTINCT src) AS used_by FROM e WHERE inside GROUP BY 1)
    SELECT m.id, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, coalesce(used_by, 0) AS used_by, coalesce(used_by, 0) >= 2 AND coalesce(internal, 0) + coalesce(external, 0) <= 1 AS is_core FROM m LEFT JOIN o USING (id) LEFT JOIN u USING (id)""")
def dependency_info(spark, d):
    return graph.dependency_info(v.symbols(spark, d).where("id % 3 = 0"), v.calls(spark, d))


@R.add("grf_16_cluster_density", f"""{v.ctes("symbols", "calls")}, n AS (SELECT file_path AS cluster, count(*) AS n FROM symbols GROUP BY 1), i AS (SELECT a.file_path AS cluster, count(*) AS k FROM calls JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.file_path = b.file_path GROUP BY 1)
    SELECT cluster, n, CASE WHEN n <= 1 THEN 1.0 ELSE round(coalesce(k, 0) / (n * (n - 1)), 3) END AS density FROM n LEFT JOIN i USING (cluster)""")
def cluster_density(spark, d):
    return graph.cluster_density(v.symbols(spark, d).select(F.col("file_path").alias("cluster"), "id"), v.calls(spark, d))


@R.add("grf_14_graph_export", f"""{v.ctes("symbols", "calls")} SELECT 'node' AS "group", '{{"id":"' || id || '","label":"' || name || '","classes":"node-' || kind || '"}}' AS element FROM symbols UNION ALL SELECT 'edge', '{{"id":"' || src || '->' || dst || '","source":"' || src || '","target":"' || dst || '"}}' FROM calls""")
def graph_export(spark, d):
    return graph.graph_export(v.symbols(spark, d), v.calls(spark, d))


@R.add("grf_15_call_summary", f"""{v.ctes("symbols", "calls")}, e AS (SELECT src, dst, a.name AS sn, b.name AS dn FROM calls JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst)
    SELECT s.id, (SELECT string_agg(DISTINCT dn, ',' ORDER BY dn) FROM e WHERE src = s.id) AS calls, (SELECT string_agg(DISTINCT sn, ',' ORDER BY sn) FROM e WHERE dst = s.id) AS called_by FROM symbols s""")
def call_summary(spark, d):
    out = graph.call_summary(v.symbols(spark, d), v.calls(spark, d))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return out.select("id", text("calls"), text("called_by"))


@R.add("mod_01_path_tree", f"{v.ctes('files')}, {_TREE} SELECT prefix, depth, count(*) AS n_below, count(*) FILTER (depth = len(string_split(path, '/')) - 1) AS n_direct FROM dirs GROUP BY 1, 2")
def path_tree(spark, d):
    return modules.path_tree(v.files(spark, d)).select("prefix", "depth", "n_below", "n_direct")


@R.add("mod_03_09_processing_order", f"""{v.ctes("files")}, {_TREE}, t AS (SELECT DISTINCT prefix FROM dirs) SELECT prefix, row_number() OVER (ORDER BY CASE WHEN prefix = '' THEN chr(1114111) ELSE prefix || '/' || chr(1114111) END) AS position FROM t""")
def processing_order(spark, d):
    return modules.processing_order(modules.path_tree(v.files(spark, d))).select("prefix", "position")


@R.add("mod_15_tree_depth", f"{v.ctes('files')} SELECT max(len(string_split(path, '/')) - 1) AS depth FROM files")
def tree_depth(spark, d):
    return modules.tree_depth(modules.path_tree(v.files(spark, d)))


def _listed(spark, d):
    """Documents as components in directories of uneven size."""
    f = v.files(spark, d)
    sub = F.when(F.col("doc_id") % 50 < 3, F.concat(F.lit("/x"), (F.col("doc_id") % 50).cast("string"))).otherwise(F.lit(""))
    return f.select(F.col("doc_id").alias("id"), F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/"), "language", sub, F.lit("/f"), F.col("doc_id").cast("string")).alias("path"))


_LISTED = "listed AS (SELECT doc_id AS id, split_part(path, '/', 1) || '/' || language || CASE WHEN doc_id % 50 < 3 THEN '/x' || (doc_id % 50)::VARCHAR ELSE '' END AS cluster FROM files)"


@R.add("mod_06_precluster", f"{v.ctes('files')}, {_LISTED} SELECT cluster, count(*) AS n FROM listed GROUP BY cluster")
def precluster(spark, d):
    return modules.precluster(_listed(spark, d)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@R.add("mod_07_merge_small", f"""{v.ctes("files")}, {_LISTED}, n AS (SELECT cluster, count(*) AS n FROM listed GROUP BY 1), big AS (SELECT cluster FROM n WHERE n >= 5),
    into_ AS (SELECT n.cluster, (SELECT max_by(b.cluster, length(b.cluster)) FROM big b WHERE starts_with(n.cluster, b.cluster || '/')) AS up FROM n WHERE n < 5) SELECT coalesce(up, l.cluster) AS cluster, count(*) AS n FROM listed l LEFT JOIN into_ i USING (cluster) GROUP BY 1""")
def merge_small(spark, d):
    return modules.merge_small(modules.precluster(_listed(spark, d)), 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@R.add("mod_08_suggest_modules")
def suggest_modules(spark, d):
    edges = v.table(spark, d, "documents").select((F.col("doc_id") - 1).alias("src"), F.col("doc_id").alias("dst"))
    return modules.suggest_modules(modules.precluster(_listed(spark, d)), edges, 10)


_PARENTS = "m AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS module FROM files2), up AS (SELECT DISTINCT module, CASE WHEN contains(module, '/') THEN regexp_replace(module, '/[^/]*$', '') END AS parent FROM m)"


@R.add("mod_04_grf_17_refine", f"""{v.ctes("files")}, files2 AS (SELECT doc_id, path AS p0, split_part(path, '/', 1) || '/' || language || '/k' || doc_id % 40 || '/f' || doc_id AS path FROM files), {_PARENTS},
    e AS (SELECT a.module AS src, b.module AS dst FROM files2 x JOIN files2 y ON y.doc_id = x.doc_id + 40 JOIN m a ON a.path = x.path JOIN m b ON b.path = y.path WHERE a.module <> b.module),
    c AS (SELECT u.module, u.parent, (SELECT count(*) FROM m WHERE m.module = u.module) AS files, (SELECT count(*) FROM e WHERE src = u.module) AS n, (SELECT count(*) FROM e WHERE src = u.module AND dst = u.parent) AS k FROM up u WHERE parent IS NOT NULL),
    step AS (SELECT module, parent FROM c WHERE files <= 2 OR (n > 0 AND k / n >= 0.6)), walk AS (SELECT module, module AS cur, 0 AS d FROM up UNION ALL SELECT w.module, s.parent, d + 1 FROM walk w JOIN step s ON s.module = w.cur),
    final AS (SELECT module, max_by(cur, d) AS into_ FROM walk GROUP BY module) SELECT into_ AS module, path FROM m JOIN final USING (module)""")
def refine(spark, d):
    f = v.files(spark, d)
    own = f.select("doc_id", F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/"), "language", F.lit("/k"), (F.col("doc_id") % 40).cast("string"), F.lit("/f"), F.col("doc_id").cast("string")).alias("path"))
    assigned = own.select(F.regexp_replace("path", "/[^/]*$", "").alias("module"), "path")
    parents = assigned.select("module").distinct().select("module", F.when(F.col("module").contains("/"), F.regexp_replace("module", "/[^/]*$", "")).alias("parent"))
    edges = own.select((F.col("doc_id") + 40).alias("doc_id"), F.col("path").alias("src_path")).join(own.select("doc_id", F.col("path").alias("dst_path")), "doc_id").select("src_path", "dst_path")
    return modules.refine(assigned, parents, edges)


@R.add("mod_10_components_by_file", f"{v.ctes('symbols')} SELECT file_path, string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR) AS listing, count(*) AS n FROM symbols GROUP BY file_path")
def components_by_file(spark, d):
    return modules.components_by_file(v.symbols(spark, d))


@R.add("mod_11_complex_modules", f"{v.ctes('symbols')} SELECT line_start AS cluster, count(DISTINCT file_path) > 1 AS is_complex FROM symbols GROUP BY 1")
def complex_modules(spark, d):
    return modules.complex_modules(v.symbols(spark, d).select(F.col("line_start").alias("cluster"), "file_path"))


@R.add("mod_12_module_files", "SELECT p_type AS module, p_brand AS path, row_number() OVER (PARTITION BY p_type ORDER BY min(p_partkey)) AS position FROM part GROUP BY 1, 2")
def module_files(spark, d):
    docs = v.table(spark, d, "part").select(F.col("p_type").alias("module"), "p_partkey", F.array("p_brand").alias("files"))
    return modules.module_files(docs, "p_partkey")


@R.add("mod_05_module_stats", f"{v.ctes('symbols')} SELECT kind AS module, count(*) AS n_files, sum(n)::BIGINT AS n_symbols FROM (SELECT kind, file_path, count(*) AS n FROM symbols GROUP BY 1, 2) GROUP BY kind")
def module_stats(spark, d):
    members = v.symbols(spark, d).groupBy(F.col("kind").alias("module"), F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_symbols"))
    return modules.module_stats(members)


@R.add("join_15_known_members", f"{v.ctes('calls')} SELECT src AS module, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS ids FROM calls WHERE dst % 2 = 0 GROUP BY src")
def known_members(spark, d):
    listed = v.calls(spark, d).groupBy(F.col("src").alias("module")).agg(F.array_sort(F.collect_list("dst")).alias("ids"))
    out = modules.known_members(listed, v.symbols(spark, d).where("id % 2 = 0"))
    return out.select("module", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@R.add("hlp_17_parent_overview", f"{v.ctes('files')} SELECT DISTINCT split_part(path, '/', 1) || '/' || language AS prefix, language AS name, language = 'en' AS has_doc FROM files WHERE split_part(path, '/', 1) = 'src1'")
def parent_overview(spark, d):
    tree = modules.path_tree(v.files(spark, d))
    docs = tree.where(F.col("prefix").endswith("/en")).select("prefix", F.lit("doc").alias("content"))
    return modules.parent_overview(tree, docs, "src1").select("prefix", "name", "has_doc")


@R.add("sch_09_citation_map", f"{v.ctes('symbols', 'calls')} SELECT src AS module, string_agg(name || ':' || line_start, ',' ORDER BY dst) AS citations FROM calls JOIN symbols ON id = dst GROUP BY src")
def citation_map(spark, d):
    from spindrift.operators.relational import citation_map as cite

    listed = v.calls(spark, d).groupBy(F.col("src").alias("module")).agg(F.array_sort(F.collect_list("dst")).alias("symbol_ids"))
    out = cite(listed, v.symbols(spark, d))
    return out.select("module", F.array_join(F.transform("citations", lambda c: F.concat(c["name"], F.lit(":"), c["line_start"].cast("string"))), ",").alias("citations"))


@R.add("src_06_tree_rows", f"{v.ctes('files')}, {_TREE} SELECT path AS node, false AS is_dir FROM files UNION ALL SELECT DISTINCT prefix, true FROM dirs WHERE prefix <> ''")
def tree_rows(spark, d):
    return scan.browse_tree(v.files(spark, d).select("path", "size")).select(F.col("path").alias("node"), "is_dir")
