"""Queries over joins, filters, aggregates, windows, ranks, set operations and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import misc
from spindrift.functions.paths import dirname
from spindrift.functions.text import preview, tokens
from spindrift.operators import conversations, learning, relational, store
from spindrift.operators.substrings import unheld
from spindrift.plans import views as v
from spindrift.plans.registry import Registry
from spindrift.streaming import jobs as job_states
from spindrift.streaming import tracker

R = Registry()


@R.add(
    "agg_02_usage_summary",
    f"""{v.ctes("usage")} SELECT coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, coalesce(sum(total_tokens) FILTER (is_estimated), 0)::BIGINT AS estimated_tokens,
    coalesce(sum(total_tokens) FILTER (kind = 'llm'), 0)::BIGINT AS llm_tokens, coalesce(sum(total_tokens) FILTER (kind = 'llm' AND is_estimated), 0)::BIGINT AS llm_estimated,
    coalesce(sum(total_tokens) FILTER (kind = 'embedding'), 0)::BIGINT AS embedding_tokens, coalesce(sum(total_tokens) FILTER (kind = 'embedding' AND is_estimated), 0)::BIGINT AS embedding_estimated FROM usage""",
)
def usage_summary(spark, d):
    return relational.usage_summary(v.usage(spark, d))


@R.add(
    "agg_01_usage_by_repo_with_switch",
    f"""{v.ctes("usage")} SELECT c_custkey AS repo_id, coalesce(CASE WHEN (SELECT coalesce(bool_or(source = 'purchase'), false) FROM usage) THEN own ELSE every END, 0)::BIGINT AS tokens
    FROM customer LEFT JOIN (SELECT repo_id, sum(total_tokens) AS every, sum(total_tokens) FILTER (source = 'purchase') AS own FROM usage GROUP BY repo_id) u ON u.repo_id = c_custkey""",
)
def usage_by_repo(spark, d):
    repos = v.table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"))
    return relational.usage_by_repo(repos, v.usage(spark, d), "purchase")


@R.add(
    "join_02_agg_03_repo_overview",
    f"""{v.ctes("repos")} SELECT r.id AS repo_id, r.status, c_name AS owner_name, coalesce(n, 0) AS n_symbols, coalesce(m, 0) AS n_files
    FROM repos r LEFT JOIN customer ON c_custkey = owner_id LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) s ON s.l_orderkey = r.id
    LEFT JOIN (SELECT l_orderkey, count(*) AS m FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1) f ON f.l_orderkey = r.id""",
)
def repo_overview(spark, d):
    repos = v.repos(spark, d).withColumnRenamed("id", "repo_id")
    users = v.table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner_name"))
    items = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("repo_id"), "l_suppkey")
    out = relational.repo_overview(repos, users, {"n_symbols": items, "n_files": items.distinct()})
    return out.select("repo_id", "status", "owner_name", "n_symbols", "n_files")


@R.add("srt_01_recent_repos", f"{v.ctes('repos')} SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM repos QUALIFY rank <= 20")
def recent_repos(spark, d):
    return relational.top_k(v.repos(spark, d), [F.desc("created_at"), F.col("id")], 20).select("id", "rank")


@R.add("join_01_symbols_by_file", f"{v.ctes('symbols')} SELECT id, name, kind, file_path, row_number() OVER (PARTITION BY file_path ORDER BY line_start, id) AS position FROM symbols WHERE file_path = 'Brand#2'")
def symbols_by_file(spark, d):
    own = v.symbols(spark, d).where(F.col("file_path") == "Brand#2")
    return relational.top_k_per_key(own, ["file_path"], ["line_start", "id"], 1 << 30, "position").select("id", "name", "kind", "file_path", "position")


@R.add("join_01_symbols_by_repo", f"{v.ctes('symbols')} SELECT s.id, s.name, f.n AS file_symbols FROM symbols s JOIN (SELECT file_path, count(*) AS n FROM symbols GROUP BY 1) f USING (file_path)")
def symbols_by_repo(spark, d):
    s = v.symbols(spark, d)
    return s.join(s.groupBy("file_path").agg(F.count(F.lit(1)).alias("file_symbols")), "file_path").select("id", "name", "file_symbols")


@R.add("hlp_03_symbol_definition", f"{v.ctes('symbols')} SELECT id, name, file_path, line_start, line_end FROM symbols WHERE id = 7")
def symbol_definition(spark, d):
    return v.symbols(spark, d).where("id = 7").select("id", "name", "file_path", "line_start", "line_end")


@R.add("flt_06_symbol_search", f"{v.ctes('symbols')} SELECT id, name, kind, row_number() OVER (ORDER BY file_path, line_start, id) AS rank FROM symbols WHERE contains(lower(name), lower('RING')) AND kind = 'class' QUALIFY rank <= 50")
def symbol_search(spark, d):
    hits = v.symbols(spark, d).where(F.lower("name").contains("RING".lower()) & (F.col("kind") == "class"))
    return relational.top_k(hits, ["file_path", "line_start", "id"], 50).select("id", "name", "kind", "rank")


@R.add("flt_07_file_search", f"{v.ctes('files')} SELECT path, row_number() OVER (ORDER BY path) AS rank FROM files WHERE contains(lower(path), 'src1/en') QUALIFY rank <= 20")
def file_search(spark, d):
    return relational.top_k(v.files(spark, d).where(F.lower("path").contains("src1/en")), ["path"], 20).select("path", "rank")


@R.add("flt_02_null_safe_module", f"{v.ctes('symbols')} SELECT id FROM symbols WHERE nullif(kind, 'class') IS NOT DISTINCT FROM NULL")
def null_safe(spark, d):
    return v.symbols(spark, d).where(F.nullif("kind", F.lit("class")).eqNullSafe(F.lit(None))).select("id")


@R.add("flt_03_04_edge_types", f"{v.ctes('usage')} SELECT source, count(*) AS n FROM usage WHERE source IN ('click', 'view', 'error') AND created_at IS NOT NULL GROUP BY source")
def edge_types(spark, d):
    return v.usage(spark, d).where(F.col("source").isin("click", "view", "error") & F.col("created_at").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@R.add("flt_05_login_lookup", "SELECT c_custkey AS id FROM customer WHERE (c_name = 'Customer#000000003' OR c_mktsegment = 'MACHINERY') AND c_acctbal > 0")
def login_lookup(spark, d):
    c = v.table(spark, d, "customer")
    return c.where(((F.col("c_name") == "Customer#000000003") | (F.col("c_mktsegment") == "MACHINERY")) & (F.col("c_acctbal") > 0)).select(F.col("c_custkey").alias("id"))


@R.add("flt_09_symbols_in_range", f"{v.ctes('symbols')} SELECT id FROM symbols WHERE line_start <= 30 AND line_end >= 25")
def symbols_in_range(spark, d):
    return v.symbols(spark, d).where("line_start <= 30 AND line_end >= 25").select("id")


@R.add("flt_12_repo_filter", f"{v.ctes('files')}, langs AS (SELECT split_part(path, '/', 1) AS repo, list(DISTINCT language) AS languages FROM files GROUP BY 1) SELECT repo FROM langs WHERE (contains(repo, '1') OR list_contains(languages, 'de')) AND list_has_any(languages, ['fr', 'es'])")
def repo_filter(spark, d):
    langs = v.files(spark, d).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("repo")).agg(F.collect_set("language").alias("languages"))
    return langs.where((F.col("repo").contains("1") | F.exists("languages", lambda x: x == "de")) & F.arrays_overlap("languages", F.array(F.lit("fr"), F.lit("es")))).select("repo")


@R.add("agg_05_files_by_language", f"{v.ctes('files')} SELECT language, count(*) AS n_files, sum(size)::BIGINT AS total_size, sum(size // 4)::BIGINT AS tokens FROM files GROUP BY language")
def files_by_language(spark, d):
    return v.files(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_size"), F.sum(F.floor(F.col("size") / 4)).alias("tokens"))


@R.add("agg_04_global_counts", "SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_users, (SELECT count(*) FROM orders) AS repos")
def global_counts(spark, d):
    users = v.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active_users"))
    return users.crossJoin(v.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("repos")))


@R.add("agg_06_file_complexity", f"{v.ctes('symbols')} SELECT file_path, sum(CASE kind WHEN 'class' THEN 10 WHEN 'function' THEN 3 ELSE 2 END)::BIGINT AS complexity FROM symbols GROUP BY file_path")
def file_complexity(spark, d):
    return relational.complexity(v.symbols(spark, d))


@R.add("agg_09_languages", f"{v.ctes('files')} SELECT string_agg(language, ',' ORDER BY language) AS languages FROM (SELECT DISTINCT language FROM files)")
def languages(spark, d):
    return v.files(spark, d).agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@R.add("agg_10_call_dedup_first", f"{v.ctes('call_sites')} SELECT src, dst, min(pos) AS pos FROM call_sites GROUP BY src, dst")
def call_dedup_first(spark, d):
    return relational.first_per_key(v.call_sites(spark, d), ["src", "dst"], ["pos"])


@R.add("agg_11_citation_dedup", f"{v.ctes('symbols')} SELECT file_path, name, min(id) AS id FROM symbols GROUP BY file_path, name")
def citation_dedup(spark, d):
    return relational.first_per_key(v.symbols(spark, d).select("file_path", "name", "id"), ["file_path", "name"], ["id"])


@R.add("agg_13_repo_counters", f"{v.ctes('repos')} SELECT count(*) FILTER (status = 'F') AS completed, count(*) FILTER (status = 'O') AS running, count(DISTINCT owner_id) AS owners FROM repos")
def repo_counters(spark, d):
    return v.repos(spark, d).agg(F.count_if(F.col("status") == "F").alias("completed"), F.count_if(F.col("status") == "O").alias("running"), F.count_distinct("owner_id").alias("owners"))


@R.add("agg_14_prompt_tokens", f"{v.ctes('files')}, first AS (SELECT split_part(path, '/', 1) AS module, language, min_by(content, doc_id) AS content FROM files GROUP BY 1, 2) SELECT module, (2000 + sum(length(content) // 4))::BIGINT AS tokens FROM first GROUP BY module")
def prompt_tokens(spark, d):
    f = v.files(spark, d).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("module"), "language", "doc_id", "content")
    first = f.groupBy("module", "language").agg(F.min_by("content", "doc_id").alias("content"))
    return first.groupBy("module").agg((F.lit(2000) + F.sum(tokens(F.col("content")))).alias("tokens"))


@R.add("agg_16_running_usage", f"{v.ctes('usage')} SELECT repo_id, source, sum(total_tokens)::BIGINT AS tokens FROM usage GROUP BY repo_id, source")
def running_usage(spark, d):
    return v.usage(spark, d).groupBy("repo_id", "source").agg(F.sum("total_tokens").alias("tokens"))


@R.add("join_03_file_edges_from_calls", f"""{v.ctes("symbols", "call_sites")} SELECT s.file_path AS src_path, t.file_path AS dst_path, max_by(CASE WHEN c.pos % 3 = 0 THEN 'inherit' ELSE 'call' END, (c.pos, c.src, c.dst)) AS edge_type
    FROM call_sites c JOIN symbols s ON s.id = c.src JOIN symbols t ON t.id = c.dst WHERE s.file_path <> t.file_path GROUP BY 1, 2""")
def file_edges_from_calls(spark, d):
    edges = v.call_sites(spark, d).withColumn("edge_type", F.when(F.col("pos") % 3 == 0, "inherit").otherwise("call"))
    return relational.lift_edges(v.symbols(spark, d), edges)


@R.add("join_04_module_edges", f"""{v.ctes("file_edges")}, m AS (SELECT DISTINCT file_path, 'm' || (length(file_path) % 2)::VARCHAR || right(file_path, 1) AS module FROM symbols)
    SELECT a.module AS src_module, b.module AS dst_module, count(*) AS n FROM file_edges JOIN m a ON a.file_path = src_path JOIN m b ON b.file_path = dst_path WHERE a.module <> b.module GROUP BY 1, 2""")
def module_edges(spark, d):
    p = v.symbols(spark, d).select(F.col("file_path").alias("path")).distinct()
    modules = p.select("path", F.concat(F.lit("m"), (F.length("path") % 2).cast("string"), F.right("path", F.lit(1))).alias("module"))
    return relational.module_edges(v.file_edges(spark, d), modules)


@R.add("join_05_flt_08_changed_modules", f"{v.ctes('files')}, m AS (SELECT split_part(path, '/', 1) AS module, lower(path) AS p FROM files), c AS (SELECT DISTINCT lower(language || '/' || doc_id::VARCHAR) AS tail FROM files WHERE doc_id % 97 = 5) SELECT DISTINCT module FROM m JOIN c ON ends_with(p, tail)")
def changed_modules(spark, d):
    f = v.files(spark, d)
    changed = f.where("doc_id % 97 = 5").select(F.concat_ws("/", "language", F.col("doc_id").cast("string")).alias("path"))
    return relational.suffix_matches(changed, f.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("module"), "path"))


@R.add("join_06_longest_prefix", f"""{v.ctes("files")}, m(prefix) AS (VALUES ('src1'), ('src1/en'), ('src2'), ('src3/de'))
    SELECT path, coalesce((SELECT max_by(prefix, length(prefix)) FROM m WHERE path = prefix OR starts_with(path, prefix || '/')), '') AS prefix FROM files""")
def longest_prefix(spark, d):
    modules = spark.createDataFrame([("src1",), ("src1/en",), ("src2",), ("src3/de",)], "prefix string")
    return relational.longest_prefix(v.files(spark, d), modules)


@R.add("join_07_callee_resolution", """WITH f AS (SELECT p_brand || '.' || p_name || p_partkey % 7 AS id, p_name AS name, p_partkey AS pos FROM part), u AS (SELECT id, max(name) AS name, max(pos) AS pos FROM f GROUP BY id),
    named AS (SELECT key, max_by(id, (pos, step)) AS id FROM (SELECT id AS key, id, pos, 0 AS step FROM u UNION ALL SELECT name, id, pos, 1 FROM u) GROUP BY key),
    tails AS (SELECT split_part(id, '.', -1) AS key, min_by(id, pos) AS id FROM u GROUP BY 1), lookup AS (SELECT * FROM named UNION ALL SELECT * FROM tails t WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.key = t.key)),
    c AS (SELECT DISTINCT p_type AS caller, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'x.' || p_name || p_partkey % 9 ELSE 'none' || p_size END AS callee FROM part)
    SELECT caller, callee, coalesce(a.id, b.id, callee) AS target, coalesce(a.id, b.id) IS NOT NULL AS is_resolved FROM c LEFT JOIN lookup a ON a.key = callee LEFT JOIN lookup b ON contains(callee, '.') AND b.key = split_part(callee, '.', -1)""")
def callee_resolution(spark, d):
    p = v.table(spark, d, "part")
    functions = p.select(F.concat("p_brand", F.lit("."), "p_name", (F.col("p_partkey") % 7).cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    functions = functions.groupBy("id").agg(F.max("name").alias("name"), F.max("pos").alias("pos"))
    k = F.col("p_partkey")
    callee = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(F.lit("x."), "p_name", (k % 9).cast("string"))).otherwise(F.concat(F.lit("none"), F.col("p_size").cast("string")))
    return relational.resolve_callees(functions, p.select(F.col("p_type").alias("caller"), callee.alias("callee")).distinct())


@R.add("join_08_first_component_by_name", f"{v.ctes('symbols')} SELECT name, min_by(id, (file_path, line_start, id)) AS id FROM symbols GROUP BY name")
def first_component(spark, d):
    return relational.first_per_key(v.symbols(spark, d), ["name"], ["file_path", "line_start", "id"]).select("name", "id")


@R.add("join_10_symbol_references", f"{v.ctes('calls', 'symbols')} SELECT s.id, s.name, s.file_path FROM calls JOIN symbols s ON s.id = src WHERE dst = 5")
def symbol_references(spark, d):
    return v.calls(spark, d).where("dst = 5").join(v.symbols(spark, d), F.col("src") == F.col("id")).select("id", "name", "file_path")


@R.add("join_11_symbol_callers", f"{v.ctes('call_sites', 'symbols')} SELECT s.id, s.name, count(*) AS n_sites FROM call_sites JOIN symbols s ON s.id = src WHERE dst = 5 GROUP BY 1, 2")
def symbol_callers(spark, d):
    return v.call_sites(spark, d).where("dst = 5").join(v.symbols(spark, d), F.col("src") == F.col("id")).groupBy("id", "name").agg(F.count(F.lit(1)).alias("n_sites"))


@R.add("join_11_symbol_callees", f"{v.ctes('calls', 'symbols')} SELECT s.id, s.name FROM calls JOIN symbols s ON s.id = dst WHERE src = 5")
def symbol_callees(spark, d):
    return v.calls(spark, d).where("src = 5").join(v.symbols(spark, d), F.col("dst") == F.col("id")).select("id", "name")


@R.add("join_12_module_assignments", f"{v.ctes('symbols')} SELECT kind AS module, file_path, count(*) AS n_symbols, min(id) AS first_symbol FROM symbols GROUP BY 1, 2")
def module_assignments(spark, d):
    return v.symbols(spark, d).groupBy(F.col("kind").alias("module"), "file_path").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("id").alias("first_symbol"))


@R.add("join_13_unknown_references", f"{v.ctes('symbols')}, r(ref) AS (VALUES ('ring'), ('widget'), ('unheard'), ('red widget'), ('nothing')) SELECT ref FROM r WHERE NOT EXISTS (SELECT 1 FROM symbols WHERE contains(name, ref)) AND length(ref) > 3")
def unknown_references(spark, d):
    refs = spark.createDataFrame([("ring",), ("widget",), ("unheard",), ("red widget",), ("nothing",)], "ref string").where("length(ref) > 3")
    return unheld(refs, v.symbols(spark, d))


@R.add("join_13_unknown_words", f"{v.ctes('symbols')}, r AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS ref FROM documents) SELECT ref FROM r WHERE length(ref) > 3 AND NOT EXISTS (SELECT 1 FROM symbols WHERE contains(name, ref))")
def unknown_words(spark, d):
    """Every word of the documents that no symbol's name holds."""
    words = v.table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("ref")).where("length(ref) > 3")
    return unheld(words, v.symbols(spark, d))


@R.add("join_14_progress_overlay", f"""{v.ctes("jobs")}, last AS (SELECT job_id, max_by(status, (ts, seq)) AS status, max_by(progress, (ts, seq)) AS progress FROM jobs GROUP BY job_id), run AS (SELECT * FROM last WHERE status IN ('queued', 'running'))
    SELECT c_custkey AS repo_id, coalesce(r.status, 'idle') AS status, coalesce(r.progress, 0) AS progress, r.status IS NOT NULL AS is_running FROM customer LEFT JOIN run r ON r.job_id = c_custkey""")
def progress_overlay(spark, d):
    repos = v.table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.lit("idle").alias("status"), F.lit(0).alias("progress"))
    running = job_states.active(job_states.latest_states(v.jobs(spark, d))).withColumnRenamed("job_id", "repo_id")
    return relational.overlay_progress(repos, running)


@R.add("join_16_vector_reuse", "SELECT d.doc_id AS id, (c.doc_id IS NULL) AS to_embed FROM documents d LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0) c ON c.doc_id = d.doc_id AND c.text = d.text")
def vector_reuse(spark, d):
    chunks = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cached = chunks.where("id % 3 = 0").withColumn("vector", F.array(F.lit(0.0)))
    return relational.reuse_vectors(chunks, cached).select("id", "to_embed")


@R.add("win_01_export_budget", f"{v.ctes('files')} SELECT path, running_tokens FROM (SELECT path, sum(length(content) // 4) OVER (ORDER BY path)::BIGINT AS running_tokens FROM files) WHERE running_tokens <= 20000")
def export_budget(spark, d):
    return relational.budget_prefix(v.files(spark, d).select("path", "content"), tokens(F.col("content")), ["path"], 20_000).select("path", "running_tokens")


@R.add("win_01_budget_per_module", f"{v.ctes('files')} SELECT path, running_tokens FROM (SELECT path, sum(length(content) // 4) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path)::BIGINT AS running_tokens FROM files) WHERE running_tokens <= 3000")
def budget_per_module(spark, d):
    f = v.files(spark, d).select("path", "content", F.split_part("path", F.lit("/"), F.lit(1)).alias("module"))
    return relational.budget_prefix(f, tokens(F.col("content")), ["path"], 3000, ["module"]).select("path", "running_tokens")


@R.add("cnv_02_win_03_conversation_context", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations QUALIFY n <= 5), s AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS t FROM r)
    SELECT conv_id, turn, role, text FROM s WHERE t <= 400""")
def conversation_context(spark, d):
    return conversations.context(v.table(spark, d, "conversations"), 5, 400)


@R.add("cnv_03_win_06_conversation_list", """SELECT conv_id, count(*) AS n_messages, coalesce(CASE WHEN length(first) > 50 THEN first[1:50] || '...' ELSE first END, 'New conversation') AS title, coalesce(last[1:100], '') AS preview
    FROM (SELECT conv_id, turn, min_by(text, turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS first, max_by(text, turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id, first, last""")
def conversation_list(spark, d):
    return conversations.overview(v.table(spark, d, "conversations"))


@R.add("cnv_01_append_message", "SELECT * FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'next' FROM conversations WHERE conv_id < 5 GROUP BY conv_id")
def append_message(spark, d):
    c = v.table(spark, d, "conversations")
    new = c.where("conv_id < 5").select("conv_id").distinct().select("conv_id", F.lit("user").alias("role"), F.lit("next").alias("text"), F.lit(0).alias("seq"))
    return conversations.append(c, new)


@R.add("txt_23_previews", "SELECT doc_id, CASE WHEN length(text) > 50 THEN text[1:50] || '...' ELSE text END AS title FROM documents")
def previews(spark, d):
    return v.table(spark, d, "documents").select("doc_id", preview(F.col("text"), 50).alias("title"))


@R.add("win_08_file_outline", f"""{v.ctes("symbols")} SELECT id, CASE WHEN kind = 'method' THEN last_value(CASE WHEN kind = 'class' THEN id END IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line_start, id ROWS UNBOUNDED PRECEDING) END AS parent_id FROM symbols""")
def file_outline(spark, d):
    return learning.outline(v.symbols(spark, d)).select("id", "parent_id")


@R.add("srt_09_tree_order", f"{v.ctes('files')} SELECT path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY language, lower(path), path) AS position FROM files")
def tree_order(spark, d):
    f = v.files(spark, d)
    return relational.top_k_per_key(f.select("path", dirname(dirname(F.col("path"))).alias("top"), "language"), ["top"], ["language", F.lower("path"), "path"], 1 << 30, "position").select("path", "position")


@R.add("set_01_02_id_sets", f"{v.ctes('calls')} SELECT node, bool_or(is_src) AS is_src, bool_or(is_dst) AS is_dst FROM (SELECT src AS node, true AS is_src, false AS is_dst FROM calls UNION ALL SELECT dst, false, true FROM calls) GROUP BY node EXCEPT SELECT p_partkey, true, true FROM part")
def id_sets(spark, d):
    c = v.calls(spark, d)
    ends = c.select(F.col("src").alias("node"), F.lit(True).alias("is_src"), F.lit(False).alias("is_dst")).unionByName(c.select(F.col("dst").alias("node"), F.lit(False).alias("is_src"), F.lit(True).alias("is_dst")))
    out = ends.groupBy("node").agg(F.bool_or("is_src").alias("is_src"), F.bool_or("is_dst").alias("is_dst"))
    return out.exceptAll(v.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.lit(True).alias("is_src"), F.lit(True).alias("is_dst")))


@R.add("dml_01_insert_ignore", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, min('order ' || o_orderkey::VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def insert_ignore(spark, d):
    old = v.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = v.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"))
    return store.insert_ignore(old, new, ["id"], ["name"])


@R.add("dml_02_insert_replace", "SELECT o_custkey AS id, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def insert_replace(spark, d):
    old = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("none").alias("status"))
    new = v.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    return store.insert_replace(old, new, ["id"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@R.add("dml_03_04_upsert", "SELECT coalesce(a.c_custkey, b.k) AS id, coalesce(b.url, a.c_name) AS url, coalesce(a.c_nationkey, b.n) AS created FROM customer a FULL JOIN (SELECT s_suppkey * 3 AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS url, s_nationkey AS n FROM supplier) b ON b.k = a.c_custkey")
def upsert(spark, d):
    old = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("url"), F.col("c_nationkey").alias("created"))
    k = F.col("s_suppkey")
    new = v.table(spark, d, "supplier").select((k * 3).alias("id"), F.when(k % 2 == 0, F.col("s_name")).alias("url"), F.col("s_nationkey").alias("created"))
    return store.upsert(old, new, ["id"], keep=("created",))


@R.add("dml_05_update", f"{v.ctes('repos')} SELECT id, CASE WHEN owner_id = 7 THEN 'X' ELSE status END AS status FROM repos")
def update(spark, d):
    return v.repos(spark, d).select("id", F.when(F.col("owner_id") == 7, "X").otherwise(F.col("status")).alias("status"))


@R.add("dml_06_cascade_delete", "SELECT 'orders' AS part, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey % 10 <> 3")
def cascade_delete(spark, d):
    o = v.table(spark, d, "orders").withColumnRenamed("o_orderkey", "repo_id")
    li = v.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "repo_id")
    left = store.cascade_delete({"orders": o, "lineitem": li}, "repo_id", o.where("repo_id % 10 = 3").select("repo_id"))
    counts = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@R.add("dat_02_cch_01_ttl_cache", f"{v.ctes('usage')} SELECT repo_id, count(*) AS n_valid FROM usage WHERE created_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS GROUP BY repo_id")
def ttl_cache(spark, d):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return store.valid_cache(v.usage(spark, d), now, 7).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_valid"))


@R.add("cch_02_03_missing_stages", f"{v.ctes('repos')} SELECT c_custkey AS owner_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM repos WHERE owner_id = c_custkey)")
def missing_stages(spark, d):
    wanted = v.table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"))
    return store.missing(wanted, v.repos(spark, d), ["owner_id"])


@R.add("inc_02_update_plan", f"{v.ctes('files')} SELECT count(DISTINCT split_part(path, '/', 1)) AS n_modules, max(length(content)) AS largest_diff, CASE WHEN count(DISTINCT split_part(path, '/', 1)) BETWEEN 1 AND 12 AND max(length(content)) <= 12000 THEN 'incremental' ELSE 'full' END AS mode FROM files WHERE doc_id % 200 = 1")
def update_plan(spark, d):
    f = v.files(spark, d).where("doc_id % 200 = 1")
    return store.update_plan(f.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("module")).distinct(), f.select(F.col("content").alias("diff")))


@R.add("str_02_latest_job_state", f"{v.ctes('jobs')} SELECT job_id, max_by(status, (ts, seq)) AS status, least(greatest(max_by(progress, (ts, seq)), 0), 100) AS progress FROM jobs GROUP BY job_id")
def latest_job_state(spark, d):
    return job_states.latest_states(v.jobs(spark, d)).select("job_id", "status", "progress")


@R.add("str_03_running_jobs", f"{v.ctes('jobs')} SELECT job_id FROM jobs GROUP BY job_id HAVING max_by(status, (ts, seq)) IN ('queued', 'running')")
def running_jobs(spark, d):
    return job_states.active(job_states.latest_states(v.jobs(spark, d))).select("job_id")


@R.add("str_02_job_transitions", f"{v.ctes('jobs')} SELECT job_id, seq, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS previous FROM jobs) WHERE status IS DISTINCT FROM previous")
def job_transitions(spark, d):
    return job_states.transitions(v.jobs(spark, d))


@R.add("str_04_progress_throttle", f"{v.ctes('jobs')} SELECT job_id, seq FROM (SELECT *, lag(progress) OVER w AS p, lag(ts) OVER w AS t FROM jobs WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)) WHERE t IS NULL OR progress IS DISTINCT FROM p OR ts >= t + INTERVAL 3600 SECONDS")
def progress_throttle(spark, d):
    return store.throttled(v.jobs(spark, d), "job_id", "ts", "progress", ["seq"], 3600).select("job_id", "seq")


@R.add("str_06_usage_windows", f"{v.ctes('usage')} SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start, kind, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS n FROM usage GROUP BY 1, 2")
def usage_windows(spark, d):
    return job_states.usage_stream(v.usage(spark, d))

def _tracked(spark, d):
    """The job rows as a stream that comes in three parts."""
    jobs = v.jobs(spark, d).select("job_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "status", "progress")
    end = jobs.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("job_id"), F.lit(0).cast("long").alias("seq"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit("end").alias("status"), F.lit(0).alias("progress"))
    return tracker.replayed(jobs, "ts", end, lambda s: tracker.track(s, 3600, "1 hour", 30 * 86_400)).where("job_id >= 0")


@R.add("str_02_streamed_transitions", f"{v.ctes('jobs')} SELECT job_id, seq, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS previous FROM jobs) WHERE status IS DISTINCT FROM previous")
def streamed_transitions(spark, d):
    return _tracked(spark, d).where("is_transition").select("job_id", "seq", "previous", "status")


@R.add("str_04_streamed_progress", f"{v.ctes('jobs')} SELECT job_id, seq FROM (SELECT *, lag(progress) OVER w AS p, lag(ts) OVER w AS t FROM jobs WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)) WHERE t IS NULL OR progress IS DISTINCT FROM p OR ts >= t + INTERVAL 3600 SECONDS")
def streamed_progress(spark, d):
    return _tracked(spark, d).where("is_progress").select("job_id", "seq")


@R.add("str_06_streamed_windows", f"{v.ctes('usage')} SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start, kind, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS n FROM usage GROUP BY 1, 2")
def streamed_windows(spark, d):
    usage = v.usage(spark, d).select(F.col("created_at").cast("timestamp").alias("created_at"), "kind", "total_tokens")
    end = usage.agg(F.max("created_at").alias("t")).select((F.col("t") + F.expr("INTERVAL 2 DAYS")).alias("created_at"), F.lit("end").alias("kind"), F.lit(0).cast(dict(usage.dtypes)["total_tokens"]).alias("total_tokens"))
    found = tracker.replayed(usage, "created_at", end, job_states.usage_stream).where("kind <> 'end'")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))



@R.add("dat_01_05_iso_dates", f"{v.ctes('repos')} SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(created_at, '%Y-%m-%d') AS day FROM repos")
def iso_dates(spark, d):
    return v.repos(spark, d).select("id", misc.iso_utc(F.col("created_at")).alias("iso"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@R.add("dat_03_cooldown", f"{v.ctes('jobs')} SELECT job_id, max(ts) <= TIMESTAMP '2024-01-30 23:57:00' - INTERVAL 3 MINUTES AS may_retry FROM jobs GROUP BY job_id")
def cooldown(spark, d):
    now = F.lit("2024-01-30 23:57:00").cast("timestamp_ntz")
    return v.jobs(spark, d).groupBy("job_id").agg(misc.cooled_down(F.max("ts"), now).alias("may_retry"))


@R.add("mth_01_dat_04_progress", f"{v.ctes('jobs')} SELECT seq, round(CASE seq % 5 + 1 WHEN 1 THEN 0.4 * s WHEN 2 THEN 0.4 + 0.2 * s WHEN 3 THEN 0.6 + 0.3 * s WHEN 4 THEN 0.9 + 0.05 * s ELSE 0.95 + 0.05 * s END, 6) AS overall FROM (SELECT seq, least(greatest(progress / 100.0, 0), 1) AS s FROM jobs)")
def overall_progress(spark, d):
    return v.jobs(spark, d).select("seq", F.round(misc.overall_progress(F.col("seq") % 5 + 1, F.col("progress") / 100.0), 6).alias("overall"))


@R.add("mth_02_backoff", "SELECT event_id, least(pow(2.0, event_id % 9), 60.0) AS delay FROM events")
def backoff(spark, d):
    return v.table(spark, d, "events").select("event_id", misc.retry_delay(F.col("event_id") % 9).alias("delay"))


@R.add("mth_03_hlp_04_ids", f"{v.ctes('files')} SELECT doc_id, sha1(path) AS file_id, sha256(path)[1:16] AS cache_key, sha1(path || '|' || language || '|' || coalesce(CASE WHEN doc_id % 2 = 0 THEN 'x' END, '')) AS symbol_id FROM files")
def ids(spark, d):
    from spindrift.functions.paths import symbol_id

    f = v.files(spark, d).withColumn("container", F.when(F.col("doc_id") % 2 == 0, "x"))
    return f.select("doc_id", F.sha1("path").alias("file_id"), F.substring(F.sha2("path", 256), 1, 16).alias("cache_key"), symbol_id("path", "language", "container").alias("symbol_id"))


@R.add("json_01_02_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce(props->>'$.absent', 'none') AS absent FROM events")
def props(spark, d):
    return v.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("absent"))


@R.add("prj_06_masked", "SELECT c_custkey AS id, c_name[1:4] || '...' || right(c_name, 4) AS masked FROM customer")
def masked(spark, d):
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), misc.masked(F.col("c_name")).alias("masked"))


@R.add("prj_03_url_source", "SELECT page_id, split_part(trim(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\.git)?/*$', ''), '^\\w+://[^/]*/?', ''), '/'), '/', -1) AS repo, 'git' AS repo_type FROM pages")
def url_source(spark, d):
    p = v.table(spark, d, "pages").select("page_id", misc.url_source(F.col("url"), F.lit("/x")).alias("s"))
    return p.select("page_id", "s.repo", "s.repo_type")


@R.add("hlp_27_free_port", "SELECT min(p) AS port FROM (SELECT unnest(range(9100, 9200))::INT AS p) WHERE p NOT IN (SELECT 9100 + n_nationkey FROM nation)")
def free_port(spark, d):
    return store.free_port(v.table(spark, d, "nation").select((F.col("n_nationkey") + 9100).cast("int").alias("port")))


@R.add("lrn_01_entry_points", f"""{v.ctes("file_edges")}, i AS (SELECT dst_path AS f, count(*) AS n FROM file_edges GROUP BY 1), o AS (SELECT src_path AS f, count(*) AS n FROM file_edges GROUP BY 1),
    s AS (SELECT file_path, CASE WHEN coalesce(i.n, 0) > 3 THEN 2 * i.n ELSE 0 END + CASE WHEN coalesce(o.n, 0) < 3 THEN 5 ELSE 0 END + 20 * count(*) FILTER (lower(name) IN ('main', '__main__', 'cli', 'run')) + CASE WHEN regexp_matches(lower(file_path), 'main|app|index|cli|run') THEN 10 ELSE 0 END AS score
    FROM symbols LEFT JOIN i ON i.f = file_path LEFT JOIN o ON o.f = file_path GROUP BY file_path, i.n, o.n) SELECT file_path, score, row_number() OVER (ORDER BY score DESC, file_path) AS rank FROM s WHERE score > 10 QUALIFY rank <= 10""")
def entry_points(spark, d):
    return learning.entry_points(v.symbols(spark, d), v.file_edges(spark, d)).select("file_path", "score", "rank")


@R.add("lrn_02_win_05_reading_order", f"""{v.ctes("file_edges")}, i AS (SELECT dst_path AS f, count(DISTINCT src_path) AS n FROM file_edges GROUP BY 1), o AS (SELECT src_path AS f, count(DISTINCT dst_path) AS n FROM file_edges GROUP BY 1),
    c AS (SELECT file_path, sum(CASE kind WHEN 'class' THEN 10 WHEN 'function' THEN 3 ELSE 2 END)::BIGINT AS complexity FROM symbols GROUP BY 1), p AS (SELECT file_path, 3 * coalesce(i.n, 0) - coalesce(o.n, 0) - complexity // 5 AS priority, complexity FROM c LEFT JOIN i ON i.f = file_path LEFT JOIN o ON o.f = file_path)
    SELECT file_path, priority, complexity, CASE WHEN complexity < 15 THEN 'beginner' WHEN complexity < 40 THEN 'intermediate' ELSE 'advanced' END AS difficulty, row_number() OVER (ORDER BY priority DESC, file_path) AS rank FROM p QUALIFY rank <= 30""")
def reading_order(spark, d):
    return learning.reading_order(v.symbols(spark, d), v.file_edges(spark, d)).select("file_path", "priority", "complexity", "difficulty", "rank")


@R.add("agg_07_key_concepts", f"{v.ctes('symbols')} SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS rank FROM (SELECT name, count(*) AS n FROM symbols WHERE kind IN ('class', 'function') AND NOT starts_with(name, '_') AND name <> '' GROUP BY name) QUALIFY rank <= 20")
def key_concepts(spark, d):
    return learning.key_concepts(v.symbols(spark, d))


@R.add("agg_08_difficulty_levels", f"""{v.ctes("symbols")}, c AS (SELECT file_path || '#' || line_start % 9 AS file_path, sum(CASE kind WHEN 'class' THEN 10 WHEN 'function' THEN 3 ELSE 2 END) AS x FROM symbols GROUP BY 1),
    l AS (SELECT file_path, CASE WHEN x < 15 THEN 'beginner' WHEN x < 40 THEN 'intermediate' ELSE 'advanced' END AS difficulty FROM c) SELECT difficulty, file_path, row_number() OVER (PARTITION BY difficulty ORDER BY file_path) AS rank FROM l QUALIFY rank <= 10""")
def difficulty_levels(spark, d):
    s = v.symbols(spark, d).withColumn("file_path", F.concat("file_path", F.lit("#"), (F.col("line_start") % 9).cast("string")))
    return learning.by_difficulty(s)


@R.add("lrn_04_module_path", f"{v.ctes('symbols')} SELECT file_path, sum(CASE kind WHEN 'class' THEN 10 WHEN 'function' THEN 3 ELSE 2 END)::BIGINT AS complexity, row_number() OVER (ORDER BY sum(CASE kind WHEN 'class' THEN 10 WHEN 'function' THEN 3 ELSE 2 END), file_path) AS rank FROM symbols WHERE starts_with(file_path, 'Brand#1') GROUP BY file_path")
def module_learning_path(spark, d):
    s = v.symbols(spark, d)
    return learning.module_path(s, s.where(F.col("file_path").startswith("Brand#1"))).select("file_path", "complexity", "rank")
