"""Queries over reports, prompts and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import modules, reports
from spindrift.plans import views as v
from spindrift.plans.registry import Registry

R = Registry()


@R.add("agg_12_issue_counts", "SELECT count(*) AS n_files, count(*) FILTER (doc_id % 5 = 0) AS n_errors, count(*) FILTER (doc_id % 3 = 0) AS n_warnings, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS n_ok FROM documents")
def issue_counts(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id")
    issues = docs.where("doc_id % 5 = 0").withColumn("issue", F.lit("[ERROR] x")).unionByName(docs.where("doc_id % 3 = 0").withColumn("issue", F.lit("[WARNING] y")))
    return reports.issue_counts(docs, issues, "doc_id")


@R.add("agg_15_metadata", f"{v.ctes('symbols')} SELECT count(*) AS n_components, count(*) FILTER (kind = 'class') AS n_leaves, 2 AS depth FROM symbols")
def metadata(spark, d):
    s = v.symbols(spark, d)
    return reports.metadata(s, s.where("kind = 'class'"), modules.path_tree(v.files(spark, d)))


@R.add("mod_16_token_gate", "SELECT sum(length(text) // 4)::BIGINT AS tokens, sum(length(text) // 4) > 36369 AS cluster FROM documents")
def token_gate(spark, d):
    return reports.needs_clustering(v.table(spark, d, "documents").select(F.col("text").alias("source_code")))


@R.add("hlp_16_module_payload", f"{v.ctes('symbols')} SELECT kind AS module, (SELECT string_agg(name, ',' ORDER BY id) FROM (SELECT id, name FROM symbols t WHERE t.kind = s.kind ORDER BY id LIMIT 20)) AS key_symbols, count(DISTINCT file_path) AS n_files FROM symbols s GROUP BY kind")
def module_payload(spark, d):
    s = v.symbols(spark, d)
    out = reports.module_payload(s.select(F.col("kind").alias("module"), F.col("id").alias("position"), "id"), s)
    return out.select("module", F.array_join("key_symbols", ",").alias("key_symbols"), F.size("files").cast("long").alias("n_files"))


@R.add("hlp_19_suggestion_lines", f"{v.ctes('symbols')}, g AS (SELECT file_path AS cluster, list(id::VARCHAR ORDER BY id::VARCHAR) AS ids FROM symbols GROUP BY 1) SELECT cluster, '- ' || cluster || ': ' || array_to_string(ids[1:5], ', ') || CASE WHEN len(ids) > 5 THEN ' ... and ' || (len(ids) - 5) || ' more' ELSE '' END AS line FROM g")
def suggestion_lines(spark, d):
    return reports.suggestion_lines(v.symbols(spark, d).select(F.col("file_path").alias("cluster"), "id"))


@R.add("hlp_20_summary_inputs", "SELECT to_json({'modules': (SELECT list(n_name ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 20)), 'docs': (SELECT list({'id': doc_id, 'content': text} ORDER BY doc_id) FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 10))})::VARCHAR AS prompt")
def summary_inputs(spark, d):
    return reports.summary_inputs(v.table(spark, d, "nation").select(F.col("n_name").alias("name")), v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@R.add("ctx_06_component_prompt", f"{v.ctes('symbols')} SELECT file_path, '# File: ' || file_path || chr(10) || string_agg(line, chr(10) ORDER BY line) AS section FROM (SELECT file_path, '- ' || name || CASE WHEN id % 2 = 0 THEN ': doc' ELSE '' END AS line FROM symbols WHERE id % 3 = 0) GROUP BY file_path")
def component_prompt(spark, d):
    s = v.symbols(spark, d).withColumn("docstring", F.when(F.col("id") % 2 == 0, "doc\nmore"))
    return reports.component_prompt(s.where("id % 3 = 0"), s)


@R.add("hlp_26_restored_jobs", "SELECT c_custkey AS job_id FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 = 0")
def restored_jobs(spark, d):
    k = v.table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"))
    saved = k.withColumn("status", F.when(F.col("job_id") % 4 == 0, "completed").otherwise("processing"))
    return reports.restored_jobs(saved, k.where("job_id % 3 = 0")).select("job_id")


@R.add("hlp_28_navigation", f"{v.ctes('files')}, p AS (SELECT DISTINCT split_part(path, '/', 1) AS a, language FROM files), t AS (SELECT DISTINCT a AS prefix FROM p UNION ALL SELECT a || '/' || language FROM p) SELECT prefix, replace(prefix, '/', '_') || '.md' AS href, row_number() OVER (ORDER BY prefix) AS position FROM t")
def navigation(spark, d):
    return reports.navigation(modules.path_tree(v.files(spark, d))).select("prefix", "href", "position")


@R.add("prj_07_set_page_list", "SELECT 'overview' AS page, 'overview' AS kind UNION ALL SELECT n_name, 'module' FROM nation UNION ALL SELECT * FROM (SELECT doc_id::VARCHAR, 'ai' FROM documents ORDER BY doc_id LIMIT 12)")
def page_list(spark, d):
    n = v.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("prefix"))
    return reports.pages(n, v.table(spark, d, "documents").select(F.col("doc_id").alias("id"))).select("page", "kind")


@R.add("txt_25_php_names", "SELECT n_name AS path, CASE n_nationkey % 4 WHEN 0 THEN 'Abs\\X' WHEN 1 THEN 'Lib\\Base' WHEN 2 THEN 'Lib\\Base\\Sub' ELSE 'App\\Own' END AS resolved FROM nation")
def php_names(spark, d):
    n = v.table(spark, d, "nation")
    k = F.col("n_nationkey") % 4
    names = n.select(F.col("n_name").alias("path"), F.lit("App").alias("namespace"), F.when(k == 0, "\\Abs\\X").when(k == 1, "B").when(k == 2, "B\\Sub").otherwise("Own").alias("name"))
    uses = n.select(F.col("n_name").alias("path"), F.lit("B").alias("alias"), F.lit("Lib\\Base").alias("fqn"))
    return reports.resolve_php_names(names, uses).select("path", "resolved")
