"""Queries over text, patterns, search, exports, parsing and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import misc, patterns, text
from spindrift.functions.paths import basename, dirname, excluded, extension, included, language, stem
from spindrift.operators import lines, retrieval
from spindrift.operators.grams import GramIndex
from spindrift.operators.graph import Rounds
from spindrift.operators.relational import top_k
from spindrift.plans import views as v
from spindrift.plans.registry import Registry
from spindrift.sources import scan
from spindrift.sources.parsers import table as parsers

R = Registry()
QUERY = "the and"
#: Terms that few documents hold.
RARE = "license token"
_TOKENS = "(length(text) // 4)"


def _docs(spark, d):
    return v.table(spark, d, "documents")


@R.add("txt_01_02_doc_chunks", "SELECT doc_id::VARCHAR || '::chunk:' || i AS id, doc_id, i::INT AS chunk_no, text[i * 1200 + 1 : i * 1200 + 1200] AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1199) // 1200)) AS i FROM documents)")
def doc_chunks(spark, d):
    rows = text.chunk_rows(_docs(spark, d).select(F.col("doc_id").cast("string").alias("doc"), "text"), "doc", "text")
    return rows.select("id", F.col("path").cast("long").alias("doc_id"), "chunk_no", "text")


@R.add("txt_04_line_slice", "SELECT doc_id, array_to_string(l[2:4], chr(10)) AS content, len(l) AS total_lines, least(len(l), 4) AS end_line FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS l FROM documents) WHERE len(l) >= 2")
def line_slice(spark, d):
    out = _docs(spark, d).select("doc_id", text.line_slice(F.col("text"), 2, 3).alias("s")).where("s.total_lines >= 2")
    return out.select("doc_id", "s.content", "s.total_lines", "s.end_line")


@R.add("txt_05_win_07_search_in_file", """WITH l AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS l FROM documents), h AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l),
    r AS (SELECT doc_id, i::INT AS line, greatest(1, i - 2)::INT AS start_line, least(len(l), i + 2)::INT AS end_line, l FROM h WHERE contains(lower(l[i]), 'token') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 20) SELECT doc_id, line, start_line, end_line, array_to_string(l[start_line:end_line], chr(10)) AS snippet FROM r""")
def search_in_file(spark, d):
    return text.search_lines(_docs(spark, d), "doc_id", "text", "Token")


@R.add("txt_05_search_regex", """WITH l AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS l FROM documents), h AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l) SELECT doc_id, i::INT AS line FROM h WHERE regexp_matches(l[i], '[0-9]{3,}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 20""")
def search_regex(spark, d):
    return text.search_lines(_docs(spark, d), "doc_id", "text", "[0-9]{3,}", use_regex=True).select("doc_id", "line")


@R.add("txt_06_07_lines_and_tokens", f"SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, {_TOKENS}::BIGINT AS tokens, CASE WHEN text = '' THEN 0 ELSE greatest(1, {_TOKENS}) END::BIGINT AS tokens_at_least_one FROM documents")
def lines_and_tokens(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", text.line_count(t).cast("long").alias("n_lines"), text.tokens(t).alias("tokens"), text.tokens(t, True).cast("long").alias("tokens_at_least_one"))


_LINES = "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, i::INT AS no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l))"
_SCORE = "CASE WHEN trim(line) = '' THEN 1 ELSE greatest(1, " + ", ".join(f"CASE WHEN regexp_matches(line, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {s} ELSE 1 END" for s, p in text.LINE_PATTERNS) + ") END"


def _code_lines(spark, d):
    return lines.numbered(_docs(spark, d), "doc_id", "text")


_AS_CODE = "CASE no % 6 WHEN 0 THEN 'def ' || line WHEN 1 THEN 'x = ' || line WHEN 2 THEN 'import ' || line ELSE line END"


def _as_code(df):
    k = F.col("no") % 6
    return df.withColumn("line", F.concat(F.when(k == 0, "def ").when(k == 1, "x = ").when(k == 2, "import ").otherwise(""), "line"))


@R.add("txt_13_line_importance", f"{_LINES}, c AS (SELECT doc_id, no, {_AS_CODE} AS line FROM n) SELECT doc_id, no, {_SCORE} AS importance FROM c")
def line_importance(spark, d):
    return _as_code(_code_lines(spark, d)).select("doc_id", "no", text.line_importance(F.col("line")).alias("importance"))


@R.add("win_09_low_runs", f"{_LINES}, s AS (SELECT doc_id, no, {_SCORE} AS importance FROM n), g AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id, importance ORDER BY no) AS g FROM s WHERE importance <= 4) SELECT doc_id, importance, min(no) AS first, max(no) AS last, count(*) AS n FROM g GROUP BY doc_id, importance, g HAVING count(*) >= 3")
def low_runs(spark, d):
    return lines.low_runs(_code_lines(spark, d), "doc_id")


@R.add("win_07_around", f"{_LINES} SELECT doc_id, no, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM n")
def around(spark, d):
    return lines.around(_code_lines(spark, d), "doc_id", 1).select("doc_id", "no", "context")


@R.add("win_11_head_tail", f"{_LINES}, m AS (SELECT *, no <= count(*) OVER (PARTITION BY doc_id) // 2 AS f, (length(line) + 1) // 4 AS cost FROM n), r AS (SELECT *, sum(cost) OVER (PARTITION BY doc_id, f ORDER BY no) AS a, sum(cost) OVER (PARTITION BY doc_id, f ORDER BY no DESC) AS b FROM m) SELECT doc_id, no, CASE WHEN f THEN 'head' ELSE 'tail' END AS part FROM r WHERE (f AND a < 120) OR (NOT f AND b < 60)")
def head_tail(spark, d):
    return lines.head_tail_split(_code_lines(spark, d), "doc_id", 200)


_BREAK = "CASE WHEN no = 1 OR no = size OR regexp_matches(line, '^\\s*(def |class |async def |@)') THEN 3 WHEN trim(line) = '' AND trim(after) = '' THEN 2 WHEN trim(line) = '' THEN 1 ELSE 0 END"


@R.add("win_10_expand_view", f"""{_LINES}, c AS (SELECT doc_id, no, {_AS_CODE} AS line FROM n), w AS (SELECT *, lead(line, 1, 'x') OVER (PARTITION BY doc_id ORDER BY no) AS after, max(no) OVER (PARTITION BY doc_id) AS size FROM c), s AS (SELECT *, {_BREAK} AS score FROM w),
    a AS (SELECT doc_id, max_by(no, score * 1000 + no) AS a FROM s WHERE no <= 5 AND score > 0 GROUP BY 1), b AS (SELECT doc_id, max_by(no, score * 1000 - no) AS b FROM s WHERE no BETWEEN 8 AND 38 AND score > 0 GROUP BY 1)
    SELECT doc_id, coalesce(a, 5) AS start, coalesce(b, least(8, size)) AS stop FROM (SELECT DISTINCT doc_id, size FROM s) LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def expand_view(spark, d):
    return lines.expand(_as_code(_code_lines(spark, d)), "doc_id", 5, 8)


@R.add("txt_14_truncate_code")
def truncate_code(spark, d):
    return lines.truncated(_docs(spark, d), "doc_id", "text", 200)


_MARKDOWN = """t AS (SELECT doc_id, trim(translate(text[1:40], chr(10) || chr(9), '  ')) AS head, string_split(text, ' ') AS w FROM documents),
    m AS (SELECT doc_id, head, '# ' || head || chr(10) || '## ' || head || chr(10) || '`' || w[1] || '` `None` `' || w[2] || '.' || w[3] || '` [x](' || w[4] || ') [y](https://z) class ' || w[5] AS md FROM t WHERE len(w) >= 5 AND head <> '')"""
_REFS = r"list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(md, '`([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)`', 1), lambda r: lower(r) NOT IN ('true', 'false', 'none', 'null', 'undefined', 'self', 'this')), regexp_extract_all(md, 'class\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1))))"


def _markdown(spark, d):
    """A page with a title, a heading, references and a link, all of them from the words of each document."""
    head = F.trim(F.translate(F.substring("text", 1, 40), "\n\t", "  "))
    rows = _docs(spark, d).select("doc_id", head.alias("head"), F.split("text", " ", -1).alias("w")).where("size(w) >= 5 AND head <> ''")
    word = lambda i: F.element_at("w", i)
    md = F.concat(F.lit("# "), "head", F.lit("\n## "), "head", F.lit("\n`"), word(1), F.lit("` `None` `"), word(2), F.lit("."), word(3), F.lit("` [x]("), word(4), F.lit(") [y](https://z) class "), word(5))
    return rows.select("doc_id", md.alias("md"))


@R.add(
    "txt_10_11_17_markdown",
    f"WITH {_MARKDOWN} SELECT doc_id, array_to_string({_REFS}, ',') AS refs, array_to_string(list_filter(regexp_extract_all(md, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 2), lambda u: NOT starts_with(u, 'http') AND NOT starts_with(u, '#')), ',') AS links,"
    " head AS title, regexp_replace(regexp_replace(lower(head), '[^\\w\\x{4e00}-\\x{9fff}\\- ]', '', 'g'), '\\s+', '-', 'g') AS anchor FROM m",
)
def markdown(spark, d):
    md = F.col("md")
    return _markdown(spark, d).select(
        "doc_id", F.array_join(text.code_references(md), ",").alias("refs"), F.array_join(text.link_targets(md), ",").alias("links"), text.title(md, F.lit("x")).alias("title"), F.element_at(text.outline(md), 1)["anchor"].alias("anchor"))


@R.add("txt_11_link_targets", "SELECT page_id, len(l) AS n_links, array_to_string(list_sort(list_distinct(l)), ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages)")
def page_links(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)
    return v.table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("links"))


@R.add("txt_16_doc_issues", """WITH k AS (SELECT 'pkg.mod.part_' || p_partkey || '_x' AS known FROM part), m AS (SELECT doc_id, 'mod.part_' || doc_id * 7 AS ref FROM documents)
    SELECT doc_id, '[WARNING] Referenced ' || chr(39) || ref || chr(39) || ' not found in codebase (may be external)' AS issue FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE contains(known, ref))
    UNION ALL SELECT doc_id, '[WARNING] Missing main heading' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, '[WARNING] Missing section headings' FROM documents WHERE doc_id % 3 <> 2""")
def doc_issues(spark, d):
    k = F.col("doc_id") % 3
    md = F.concat(F.when(k == 0, "").when(k == 1, "# T\n").otherwise("# T\n## A\n"), F.lit("`mod.part_"), (F.col("doc_id") * 7).cast("string"), F.lit("` and `abc` and `none`"))
    names = v.symbols(spark, d).select(F.concat(F.lit("pkg.mod.part_"), F.col("id").cast("string"), F.lit("_x")).alias("name"))
    return text.doc_issues(_docs(spark, d).select("doc_id", md.alias("md")), "doc_id", "md", names)


@R.add("txt_22_html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages")
def html_escape(spark, d):
    return v.table(spark, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@R.add("txt_19_thinking", "SELECT conv_id, turn, trim(text) AS answer, 'hm' AS thinking FROM conversations")
def thinking(spark, d):
    c = v.table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.thinking(F.concat(F.lit("<think> hm </think>"), "text")).alias("x")).select("conv_id", "turn", "x.answer", "x.thinking")


@R.add("txt_24_path_parts", f"{v.ctes('files')} SELECT doc_id, parse_filename(p, true) AS stem, parse_filename(p) AS name, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, '.py' AS ext, 'python' AS language FROM (SELECT doc_id, path || '.py' AS p FROM files)")
def path_parts(spark, d):
    p = F.col("p")
    f = v.files(spark, d).select("doc_id", F.concat("path", F.lit(".py")).alias("p"))
    return f.select("doc_id", stem(p).alias("stem"), basename(p).alias("name"), dirname(p).alias("dir"), extension(p).alias("ext"), language(p).alias("language"))


@R.add("src_02_03_scan_globs", f"{v.ctes('files')} SELECT doc_id FROM (SELECT doc_id, path || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.bin' END AS p FROM files) WHERE (ends_with(p, '.py') OR ends_with(p, '.md')) AND NOT list_contains(string_split(p, '/'), 'fr') AND NOT starts_with(p, 'src1')")
def scan_globs(spark, d):
    k = F.col("doc_id") % 3
    f = v.files(spark, d).select("doc_id", F.concat("path", F.when(k == 0, ".py").when(k == 1, ".md").otherwise(".bin")).alias("path"))
    return f.where(included(F.col("path"), ["*.py", "*.md"]) & ~excluded(F.col("path"), ["fr", "src1*", "*.tmp"])).select("doc_id")


@R.add("src_16_17_census", f"{v.ctes('files')} SELECT CASE doc_id % 3 WHEN 0 THEN 'python' ELSE 'java' END AS language, count(*) AS n FROM files WHERE doc_id % 3 < 2 GROUP BY 1")
def census(spark, d):
    k = F.col("doc_id") % 3
    return scan.census(v.files(spark, d).select(F.concat("path", F.when(k == 0, ".py").when(k == 1, ".java").otherwise(".zzz")).alias("path")))


@R.add("src_19_totals", f"{v.ctes('files')} SELECT count(*) AS n_files, round(sum(size) / 1024.0, 4) AS total_kb FROM files")
def totals(spark, d):
    return scan.totals(v.files(spark, d)).select("n_files", F.round("total_kb", 4).alias("total_kb"))


@R.add("flt_13_tree_filter", f"{v.ctes('files')}, h AS (SELECT path FROM files WHERE contains(lower(path), 'src2/es')) SELECT path, false AS is_dir FROM h UNION ALL SELECT DISTINCT 'src2', true FROM h UNION ALL SELECT DISTINCT 'src2/es', true FROM h")
def tree_filter(spark, d):
    tree = scan.browse_tree(v.files(spark, d).select("path", "size"))
    return scan.filter_tree(tree, "src2/ES").select("path", "is_dir")


@R.add("pat_01_02_03_file_heuristics", """SELECT p_partkey AS id, regexp_matches(n, 'main|app|server|start|run|entry|bootstrap|init|cmd|cli|daemon|service|worker|launcher') AS is_entry, contains(p, 'src/app') AS is_entry_path FROM (SELECT p_partkey, lower(p_name || '_app.py') AS n, CASE WHEN p_size % 2 = 0 THEN 'src/app/' ELSE 'x/' END AS p FROM part)""")
def file_heuristics(spark, d):
    p = v.table(spark, d, "part")
    name = F.concat("p_name", F.lit("_app.py"))
    path = F.when(F.col("p_size") % 2 == 0, "src/app/").otherwise("x/")
    return p.select(F.col("p_partkey").alias("id"), patterns.is_entry_file(name).alias("is_entry"), patterns.is_entry_path(path).alias("is_entry_path"))


@R.add("pat_04_critical_functions", "SELECT p_partkey AS id, p_size % 7 = 0 OR p_size % 5 = 0 AS critical FROM part")
def critical_functions(spark, d):
    p = v.table(spark, d, "part")
    name = F.when(F.col("p_size") % 7 == 0, "Main").otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), patterns.is_critical(name, F.when(F.col("p_size") % 5 == 0, "EXPORT DEFAULT x")).alias("critical"))


@R.add("pat_05_06_fallbacks", f"""{v.ctes('files')}, f AS (SELECT doc_id, path || CASE WHEN doc_id % 9 = 0 THEN '/main.py' ELSE '/x.go' END AS path FROM files)
    SELECT path, row_number() OVER (ORDER BY doc_id) AS rank, 'entry' AS kind FROM f WHERE doc_id % 9 = 0 QUALIFY rank <= 5 UNION ALL SELECT path, row_number() OVER (ORDER BY doc_id) AS rank, 'connected' FROM f QUALIFY rank <= 10""")
def fallbacks(spark, d):
    f = v.files(spark, d).select(F.concat("path", F.when(F.col("doc_id") % 9 == 0, "/main.py").otherwise("/x.go")).alias("path"), F.col("doc_id").alias("pos"))
    f = f.withColumn("name", basename(F.col("path")))
    return patterns.fallback_entry_points(f).withColumn("kind", F.lit("entry")).unionByName(patterns.fallback_connected(f).withColumn("kind", F.lit("connected")))


def _query_vector(spark, d):
    return v.table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_VECTOR_TOP = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], e::DOUBLE[]) AS score FROM embeddings, q)"


@R.add("sch_04_vector_topk", f"WITH {_VECTOR_TOP} SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 8")
def vector_topk(spark, d):
    return retrieval.vector_search(v.table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 8).select("vec_id", "rank")


@R.add("sch_04_vector_join", "WITH s AS (SELECT q.vec_id AS query, r.vec_id, list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0) SELECT query, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 5")
def vector_join(spark, d):
    e = v.table(spark, d, "embeddings")
    return retrieval.vector_join(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5).select("query", "vec_id")


def _keyword_sql(k: int, query: str = QUERY) -> str:
    terms = " + ".join(f"CASE WHEN contains(t, '{w}') THEN (length(t) - length(replace(t, '{w}', ''))) / {len(w)} + CASE WHEN starts_with(t, '{w}') OR contains(t, chr(10) || '{w}') THEN 0.5 ELSE 0 END ELSE 0 END" for w in query.split())
    return f"k AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, {terms} AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)) WHERE score > 0 QUALIFY rank <= {k})"


@R.add("sch_05_keyword_search", f"WITH {_keyword_sql(8)} SELECT doc_id, score, rank FROM k")
def keyword_search(spark, d):
    return retrieval.keyword_search(_docs(spark, d), "doc_id", "text", QUERY, 8)


_INDEXES: dict[tuple[str, str], GramIndex] = {}


def _index(spark, d) -> GramIndex:
    """The index of a folder's documents; it is built once in an application."""
    known = (spark.sparkContext.applicationId, d)
    if known not in _INDEXES:
        _INDEXES[known] = GramIndex.build(_docs(spark, d), "doc_id", "text", Rounds(spark).path())
    return GramIndex(spark, _INDEXES[known].path)


@R.add("sch_05_indexed_search", f"WITH {_keyword_sql(8, RARE)} SELECT doc_id, score, rank FROM k")
def indexed_search(spark, d):
    return _index(spark, d).keyword_search("doc_id", RARE, 8)


@R.add("txt_05_indexed_lines", """WITH l AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS l FROM documents), h AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)
    SELECT doc_id, i::INT AS line FROM h WHERE contains(lower(l[i]), 'apache') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 20""")
def indexed_lines(spark, d):
    return text.search_lines(_index(spark, d).holding(["apache"]), "doc_id", "text", "Apache").select("doc_id", "line")


@R.add("sch_06_hybrid_search", f"WITH {_VECTOR_TOP}, {_keyword_sql(16)}, v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 16), f AS (SELECT doc_id, sum(p) AS score FROM (SELECT doc_id, 0.7 / rank AS p FROM v UNION ALL SELECT doc_id, 0.3 / rank FROM k) GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f QUALIFY rank <= 8")
def hybrid_search(spark, d):
    vectors = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = retrieval.search(_docs(spark, d), vectors, "doc_id", "text", "embedding", QUERY, _query_vector(spark, d))
    return out.select("doc_id", F.round("score", 6).alias("score"), "rank")


@R.add("ctx_05_win_02_smart_context", f"WITH {_keyword_sql(20)} SELECT doc_id, rank, running_tokens FROM (SELECT doc_id, rank, sum(length(text) // 4) OVER (ORDER BY rank)::BIGINT AS running_tokens FROM k JOIN documents USING (doc_id)) WHERE running_tokens <= 8000")
def smart_context(spark, d):
    docs = _docs(spark, d)
    hits = retrieval.keyword_search(docs, "doc_id", "text", QUERY, 20)
    return retrieval.smart_context(hits, docs, "doc_id", 8000).select("doc_id", "rank", "running_tokens")


@R.add("ctx_01_02_export_xml", f"""{v.ctes("files")} SELECT path, '<file path="' || path || '">' || chr(10) || content || chr(10) || '</file>' || chr(10) AS block FROM (SELECT path, content, sum(length(content) // 4) OVER (ORDER BY path) AS t FROM files WHERE language <> 'fr') WHERE t <= 5000""")
def export_xml(spark, d):
    chosen = retrieval.select_files(v.files(spark, d), not_code=("fr",))
    return retrieval.export_files(chosen, 5000).select("path", "block")


@R.add("ctx_03_export_markdown", f"""{v.ctes("files")} SELECT path, '### ' || path || chr(10) || chr(10) || '```' || language || chr(10) || content || chr(10) || '```' || chr(10) AS block FROM (SELECT *, sum(length(content) // 4) OVER (ORDER BY path) AS t FROM files) WHERE t <= 5000""")
def export_markdown(spark, d):
    return retrieval.export_files(v.files(spark, d), 5000, "markdown").select("path", "block")


@R.add("ctx_07_component_source", "SELECT i AS id, coalesce(text, '# component not found: ' || i) AS source FROM (SELECT unnest(range(-2, 30)) AS i) LEFT JOIN documents ON doc_id = i")
def component_source(spark, d):
    return retrieval.component_sources(spark.range(-2, 30), _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("source_code")))


@R.add("sch_08_evidence", f"WITH {_keyword_sql(5)} SELECT string_agg(text, '|' ORDER BY rank) AS texts FROM k JOIN documents USING (doc_id)")
def evidence(spark, d):
    docs = _docs(spark, d).withColumn("citations", F.array(F.col("doc_id")))
    out = retrieval.evidence(retrieval.keyword_search(docs, "doc_id", "text", QUERY, 5), docs, "doc_id")
    return out.select(F.array_join("texts", "|").alias("texts"))


@R.add("sch_01_hash_embedding")
def hash_embedding(spark, d):
    return retrieval.embed(v.table(spark, d, "benchmark"), "item_id", "text")


@R.add("mth_04_unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 3) AS norm FROM embeddings")
def unit_vectors(spark, d):
    e = v.table(spark, d, "embeddings").select("vec_id", misc.unit(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.sqrt(misc.dot(F.col("u"), F.col("u"))), 3).alias("norm"))


@R.add("hlp_23_usage_normalised", "SELECT event_id, (props->>'$.k')::BIGINT AS prompt, 5::BIGINT AS completion, (props->>'$.k')::BIGINT + 5 AS total FROM events")
def usage_normalised(spark, d):
    record = F.concat(F.lit('{"input_tokens": '), F.get_json_object("props", "$.k"), F.lit(', "completion_tokens": 5}'))
    return v.table(spark, d, "events").select("event_id", misc.usage_of(record).alias("u")).select("event_id", "u.prompt", "u.completion", "u.total")


@R.add("hlp_22_24_endpoints", "SELECT n_nationkey AS id, 'https://h/' || CASE WHEN n_nationkey % 2 = 0 THEN 'v2' ELSE 'api/v1' END || '/chat' AS url, n_nationkey % 3 = 0 AS retry FROM nation")
def endpoints(spark, d):
    n = F.col("n_nationkey")
    base = F.when(n % 2 == 0, "https://h/v2/").otherwise("https://h/api")
    message = F.when(n % 3 == 0, "Request timed out").otherwise("bad key")
    return v.table(spark, d, "nation").select(n.alias("id"), misc.endpoint(base, "/chat").alias("url"), misc.is_retryable(message).alias("retry"))


@R.add("mod_13_json_repair", "SELECT p_partkey AS id, p_name AS a, CASE WHEN p_partkey % 5 < 4 THEN p_size END AS b FROM part")
def json_repair(spark, d):
    p, k = v.table(spark, d, "part"), F.col("p_partkey") % 5
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    good = F.concat(F.lit('{"a": "'), name, F.lit('", "b": '), size, F.lit("}"))
    single = F.concat(F.lit("```json\n{'a': '"), name, F.lit("', 'b': "), size, F.lit(",}\n```"))
    raw = F.when(k == 0, good).when(k == 1, F.concat(F.lit("```\n"), good, F.lit("\n```"))).when(k == 2, single).when(k == 3, F.concat(F.lit("Sure: "), good, F.lit(" done"))).otherwise(F.concat(F.lit('{"a": "'), name, F.lit('",}')))
    found = misc.repaired_json(raw, "a string, b int")
    return p.select(F.col("p_partkey").alias("id"), found["a"].alias("a"), found["b"].alias("b"))


def _sources(spark, d):
    """One small Python and Java file for each nation."""
    n = v.table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    python = F.concat(F.lit("import os\nfrom .base import Base\n\nclass C"), k, F.lit("(Base):\n    def m(self):\n        return self.n()\n\ndef f"), k, F.lit("(x: C"), k, F.lit("):\n    return os.path.join(x.m(), g())\n\ndef g():\n    pass\n"))
    java = F.concat(F.lit("package a;\nimport java.util.List;\nclass D"), k, F.lit(" extends E {\n  private Helper h;\n  void run() { h.go(); new Other(); }\n}\nclass E {}\n"))
    one = n.select(F.concat(F.lit("pkg/mod"), k, F.lit(".py")).alias("path"), F.lit("python").alias("language"), python.alias("content"))
    return one.unionByName(n.select(F.concat(F.lit("a/D"), k, F.lit(".java")).alias("path"), F.lit("java").alias("language"), java.alias("content")))


@R.add("par_01_04_15_parse_symbols", "SELECT 'pkg.mod' || n_nationkey || '.' || name AS id, kind FROM nation, (VALUES ('C', 'class'), ('f', 'function')) v(n, kind), LATERAL (SELECT n || n_nationkey AS name) UNION ALL SELECT 'pkg.mod' || n_nationkey || '.g', 'function' FROM nation UNION ALL SELECT 'a.D' || n_nationkey || '.' || x, k FROM nation, (VALUES ('E', 'class')) w(x, k) UNION ALL SELECT 'a.D' || n_nationkey || '.D' || n_nationkey, 'class' FROM nation UNION ALL SELECT 'a.D' || n_nationkey || '.D' || n_nationkey || '.run', 'method' FROM nation")
def parse_symbols(spark, d):
    return parsers.symbols(parsers.parse_files(_sources(spark, d))).select("id", "kind")


@R.add("par_14_import_maps", "SELECT 'pkg/mod' || n_nationkey || '.py' AS path, local, full_path FROM nation, (VALUES ('os', 'os'), ('Base', 'pkg.base.Base')) v(local, full_path)")
def import_maps(spark, d):
    return parsers.imports(parsers.parse_files(_sources(spark, d).where("language = 'python'"))).select("path", "local", "full_path")


@R.add("par_13_import_edges", "SELECT 'pkg/mod' || n_nationkey || '.py' AS src, 'pkg/base.py' AS dst FROM nation")
def import_edges(spark, d):
    files = _sources(spark, d)
    base = spark.createDataFrame([("pkg/base.py", "python", "class Base: pass")], files.schema)
    every = files.unionByName(base)
    return parsers.import_edges(parsers.imports(parsers.parse_files(every)), every)


@R.add("par_09_python_outline", "SELECT n_nationkey AS id, 'class:C' || n_nationkey || ',function:m,function:f' || n_nationkey || ',function:g' AS outline FROM nation")
def python_outline(spark, d):
    found = parsers.outlines(_sources(spark, d).where("language = 'python'"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "kind", "name").alias("x")))), lambda r: r["x"]), ",")
    return found.where("record = 'symbol'").groupBy("path").agg(listed.alias("outline")).select(F.regexp_extract("path", r"mod(\d+)", 1).cast("int").alias("id"), "outline")


@R.add("srt_02_recent_conversations", "SELECT conv_id, row_number() OVER (ORDER BY max(turn) DESC, conv_id) AS rank FROM conversations GROUP BY conv_id QUALIFY rank <= 10")
def recent_conversations(spark, d):
    last = v.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return top_k(last, [F.desc("last"), F.col("conv_id")], 10).select("conv_id", "rank")
