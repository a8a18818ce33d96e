"""Queries over single texts: fences, diagrams, comments, lint lines, urls, answers and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import misc, text
from spindrift.operators import reports, retrieval
from spindrift.plans import views as v
from spindrift.plans.registry import Registry

R = Registry()
_PART = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part"


def _parts(spark, d):
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))


@R.add("txt_03_file_chunks", f"{v.ctes('files')} SELECT path || '::file:' || i AS id, path, i::INT AS chunk_no, substr(content, i * 1200 + 1, 1200) AS text FROM (SELECT path, content, unnest(range(0, (length(content) + 1199) // 1200)) AS i FROM files)")
def file_chunks(spark, d):
    return text.chunk_rows(v.files(spark, d), "path", "content", kind="file")


@R.add("txt_09_identifier_tails", f"SELECT id, [string_split(type, '.')[-1], 'z' || size] AS tails FROM ({_PART})")
def identifier_tails(spark, d):
    p = _parts(spark, d)
    return p.select("id", text.identifier_tails(F.concat(F.lit("("), "type", F.lit(" + a.b.z"), F.col("size").cast("string"), F.lit(" 7)"))).alias("tails"))


@R.add("txt_12_fences", "SELECT doc_id, (1 + len(string_split(text, chr(10))))::INT AS start_line, 'graph TD' || chr(10) || '  A' || doc_id || ' --> B' AS content FROM documents WHERE doc_id % 4 <> 0")
def fences(spark, d):
    """Documents with a diagram behind their text, every fourth one with an empty one."""
    body = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("graph TD\n  A"), F.col("doc_id").cast("string"), F.lit(" --> B\n")))
    docs = v.table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n```mermaid\n"), body, F.lit("```\nend")).alias("md"))
    return text.fenced_blocks(docs, "doc_id", "md")


@R.add("txt_20_diagrams", f"SELECT id, CASE size % 3 WHEN 0 THEN 'graph TD' || chr(10) || name WHEN 1 THEN 'flowchart LR' || chr(10) || name END AS diagram FROM ({_PART})")
def diagrams(spark, d):
    kind = F.when(F.col("size") % 3 == 0, "graph\n").when(F.col("size") % 3 == 1, "  flowchart LR\n").otherwise("prose ")
    return _parts(spark, d).select("id", text.diagram(F.concat(kind, "name")).alias("diagram"))


@R.add("txt_21_jsdoc_types", f"SELECT id, list_distinct(['Array', type, 'T' || size, 'Promise']) AS n FROM ({_PART})".replace("list_distinct(", "len(list_distinct(").replace("]) AS", "])) AS"))
def jsdoc_types(spark, d):
    t = F.concat(F.lit("/** @param {Array<"), "type", F.lit("|T"), F.col("size").cast("string"), F.lit(">} a\n * @returns {Promise<"), "type", F.lit(">} {no} */"))
    return _parts(spark, d).select("id", F.size(text.jsdoc_types(t)).cast("long").alias("n"))


@R.add("txt_26_doc_comments", f"SELECT id, name || chr(10) || 'of ' || brand AS doc FROM ({_PART})")
def doc_comments(spark, d):
    comment = F.concat(F.lit("/**\n   * "), "name", F.lit("\n   * of "), "brand", F.lit("\n   */"))
    return _parts(spark, d).select("id", text.clean_doc_comment(comment).alias("doc"))


@R.add("txt_27_lint", f"SELECT id, brand || '.py' AS file, CASE WHEN size < 10 THEN size WHEN size > 20 THEN size - 6 END::INT AS line, 3 AS col, 'E1 ' || name AS problem FROM ({_PART})")
def lint(spark, d):
    """Messages of a linter whose lines move as lines 10 to 20 become five; lines in between are gone."""
    p = _parts(spark, d).select("id", text.parse_lint(F.concat("brand", F.lit(".py:"), F.col("size").cast("string"), F.lit(":3: E1 "), "name")).alias("m"))
    return p.select("id", "m.file", text.shifted_line(F.col("m.line"), 10, 20, 5).alias("line"), "m.col", "m.problem")


@R.add("txt_28_elided", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS no, len(l) AS n FROM l)
    SELECT doc_id, no::INT AS no FROM x WHERE NOT (n >= 8 AND no BETWEEN 2 AND n - 1) UNION ALL SELECT doc_id, 2 FROM l WHERE len(l) >= 8""")
def elided(spark, d):
    """The lines of each document without its inner ones, where these are six or more."""
    lines = v.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("path", (F.col("at") + 1).alias("no"), "line")
    bodies = v.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit(2).alias("first"), (F.size(F.split("text", "\n", -1)) - 1).alias("last"))
    return text.elided(lines, bodies).select(F.col("path").alias("doc_id"), "no")


@R.add("prj_04_github_urls", f"SELECT id, CASE size % 3 WHEN 2 THEN NULL ELSE 'https://github.com/' || lower(type) || '/r' || id END AS url, lower(type) || '--r' || id AS job_id, lower(type) || '/r' || id AS full_name FROM ({_PART})")
def github_urls(spark, d):
    p = _parts(spark, d).select("id", "size", F.concat(F.lower("type"), F.lit("/r"), F.col("id").cast("string")).alias("name"))
    raw = F.when(F.col("size") % 3 == 0, F.concat(F.lit(" git@github.com:"), "name", F.lit(".git"))).when(F.col("size") % 3 == 1, F.concat(F.lit("http://www.github.com/"), "name", F.lit("/"))).otherwise(F.concat(F.lit("https://elsewhere.org/"), "name"))
    job = misc.job_id_of(F.col("name"))
    return p.select("id", misc.clean_github_url(raw).alias("url"), job.alias("job_id"), misc.full_name_of(job).alias("full_name"))


@R.add("jsn_03_answers", f"SELECT id, size AS value FROM ({_PART})")
def answers(spark, d):
    answer = F.concat(F.lit("```json\n{\"value\": "), F.col("size").cast("string"), F.lit("}\n```"))
    return _parts(spark, d).select("id", F.from_json(misc.unfenced(answer), "value int")["value"].alias("value"))


@R.add("hlp_30_export_default", f"""{v.ctes("files")} SELECT path, '<file path="' || path || '">' || chr(10) || content || chr(10) || '</file>' || chr(10) AS block FROM (SELECT path, content, sum(length(content) // 4) OVER (ORDER BY path) AS t FROM files) WHERE t <= 4000""")
def export_default(spark, d):
    return retrieval.export_files(v.files(spark, d), 4000, "cursor").select("path", "block")


@R.add("ctx_04_export_json", f"""{v.ctes("files")} SELECT path, language, content FROM (SELECT path, language, content, sum(length(content) // 4) OVER (ORDER BY path) AS t FROM files) WHERE t <= 4000""")
def export_json(spark, d):
    """The exported objects, read back."""
    out = retrieval.export_files(v.files(spark, d), 4000, "json")
    return out.select(F.from_json("block", "path string, language string, content string").alias("x")).select("x.path", "x.language", "x.content")


@R.add("hlp_32_stage_progress", "SELECT o_orderkey AS id, least(greatest(coalesce(o_custkey % 7 / nullif(o_orderkey % 5, 0)::DOUBLE, 0), 0), 1) AS progress FROM orders")
def stage_progress(spark, d):
    o = v.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), reports.stage_progress(F.col("o_custkey") % 7, F.col("o_orderkey") % 5).alias("progress"))


@R.add("arr_01_map_01_names", f"{v.ctes('symbols')} SELECT file_path, count(DISTINCT kind) AS n_kinds, count(*) FILTER (kind = 'class') AS n_classes, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM symbols GROUP BY file_path")
def kind_maps(spark, d):
    """Kinds of a file's symbols as a map of counts, and its keys as a sorted array."""
    counts = v.symbols(spark, d).groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("m"))
    keys = F.array_sort(F.map_keys("m"))
    return maps.select("file_path", F.size(keys).cast("long").alias("n_kinds"), F.coalesce(F.try_element_at("m", F.lit("class")), F.lit(0)).cast("long").alias("n_classes"), F.array_join(keys, ",").alias("kinds"))
