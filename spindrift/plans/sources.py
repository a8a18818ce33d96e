"""Queries over scans of files, and over tables that are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions.paths import module_path
from spindrift.operators import points, store
from spindrift.operators.graph import Rounds
from spindrift.plans import views as v
from spindrift.plans.registry import Registry
from spindrift.sources import scan
from spindrift.sources.parsers import table as parsers

R = Registry()
#: Files that are written to one folder.
FILES = 1000
_SUFFIX = "CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.zzz' END"


def _suffixed(spark, d):
    k = F.col("doc_id") % 3
    return v.files(spark, d).select("doc_id", F.concat("path", F.when(k == 0, ".py").when(k == 1, ".java").otherwise(".zzz")).alias("path"), "size")


@R.add("src_01_09_scan", "SELECT doc_id, octet_length(encode(text)) + 1 AS size, md5(text || chr(10)) AS content_md5 FROM documents")
def scanned(spark, d):
    """Every document as a file of its own, in folders of bounded size, read back by a scan."""
    root = Rounds(spark).path()
    # Rows are numbered before they move, so a task that runs again writes the same names.
    docs = v.table(spark, d, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    docs = docs.withColumn("folder", F.floor(F.col("row") / FILES)).repartition("folder")
    path = F.concat_ws("/", "folder", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("."), F.col("row").cast("string"), F.lit(".txt")))
    scan.write_files(docs.select(path.alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("content")), root)
    found = scan.scan(spark, root)
    return found.select(F.regexp_extract("path", r"/(-?\d*)\.", 1).try_cast("long").alias("doc_id"), "size", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@R.add("src_04_05_08_code_files", f"{v.ctes('files')} SELECT path, language FROM (SELECT path || {_SUFFIX} AS path, CASE doc_id % 3 WHEN 0 THEN 'python' ELSE 'java' END AS language FROM files WHERE doc_id % 3 < 2) ORDER BY path LIMIT 25")
def code_files(spark, d):
    """The first code files of two languages in order of path."""
    return scan.code_files(_suffixed(spark, d), ("python", "java")).orderBy("path").limit(25).select("path", "language")


@R.add("src_07_supported", "SELECT doc_id, lang AS language FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'ruby' WHEN 'fr' THEN 'csharp' ELSE 'markdown' END AS lang FROM documents) WHERE lang IN ('python', 'csharp')")
def supported(spark, d):
    named = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "de", "ruby").when(F.col("lang") == "fr", "csharp").otherwise("markdown")
    return scan.supported(v.table(spark, d, "documents").select("doc_id", named.alias("language")))


@R.add("src_12_13_json_lines", f"{v.ctes('symbols')} SELECT id, name, kind FROM symbols")
def json_lines(spark, d):
    """Components written as JSON lines, with lines among them that are none, and read back."""
    path = Rounds(spark).path()
    known = v.symbols(spark, d).select("id", "name", "kind")
    scan.write_components(known, path)
    known.select(F.concat(F.lit("{broken "), "name").alias("value")).write.mode("append").text(path)
    return scan.read_jsonl(spark, path, "id long, name string, kind string")


@R.add("src_14_15_index", "SELECT vec_id AS id, source, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm FROM embeddings JOIN documents ON doc_id = vec_id WHERE label = 2")
def index(spark, d):
    """Vectors of all labels, one repository each, with the rows of their documents beside them; one of them read back."""
    path = Rounds(spark).path()
    vectors = v.table(spark, d, "embeddings").select(F.col("label").alias("repo_id"), F.col("vec_id").alias("id"), "embedding")
    rows = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    scan.write_index(vectors, path, vectors.select("repo_id", "id").join(rows, "id"))
    found = scan.read_index(spark, path, 2, "id long, source string")
    return found.select("id", "source", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("norm"))


@R.add("src_18_readme", "SELECT 'README.txt' AS path, doc_id FROM documents WHERE doc_id = 1")
def readme(spark, d):
    path = F.when(F.col("doc_id") == 1, "README.txt").when(F.col("doc_id") == 2, "readme.md").when(F.col("doc_id") == 3, "README").otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit("/README.md")))
    return scan.readme(v.table(spark, d, "documents").select(path.alias("path"), "doc_id"))


@R.add("prj_01_module_paths", f"{v.ctes('files')} SELECT doc_id, replace(path, '/', '.') AS module FROM files")
def module_paths(spark, d):
    f = _suffixed(spark, d)
    return f.select("doc_id", module_path(F.col("path")).alias("module"))


@R.add("hlp_15_discovered", f"{v.ctes('symbols')} SELECT DISTINCT replace(file_path, '#', '') AS module, 'java' AS language FROM symbols")
def discovered(spark, d):
    """A source file for each brand, found again by language, with its absolute path."""
    root = Rounds(spark).path()
    named = v.symbols(spark, d).select(F.regexp_replace("file_path", "#", "").alias("module")).distinct()
    named.select("module", F.concat(F.lit("class "), "module", F.lit(" {}")).alias("value")).repartition("module").write.partitionBy("module").text(root)
    listed = scan.scan(spark, root).select("path")
    absolute = scan.code_files(listed.select(F.regexp_replace("path", r"\.txt$", ".java").alias("path")), ("java",))
    both = absolute.select(F.regexp_extract("path", "module=([^/]+)/", 1).alias("module"), "language")
    return both.distinct()


@R.add("flt_14_15_excluded_code", "SELECT p_partkey AS id, 'Store' || p_partkey AS callee FROM part WHERE p_size % 3 = 2")
def excluded_code(spark, d):
    """A PHP file for each part, a third of them templates: of its types only that which is not built in is used."""
    name = F.col("p_partkey").cast("string")
    k = F.col("p_size") % 3
    path = F.concat(F.when(k == 0, "app/resources/views/p").otherwise("app/p"), name, F.when(k == 1, ".blade.php").otherwise(".php"))
    text = F.concat(F.lit("<?php class C"), name, F.lit(" { private string $a; private ?DateTime $b; private Store"), name, F.lit(" $c; }"))
    files = v.table(spark, d, "part").select(path.alias("path"), F.lit("php").alias("language"), text.alias("content"))
    used = parsers.relationships(parsers.parse_files(files)).where("rel_type = 'use'")
    return used.select(F.regexp_extract("caller", r"C(\d+)$", 1).cast("long").alias("id"), "callee")


@R.add("hlp_06_dispatch", "SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0")
def dispatch(spark, d):
    """Languages without a parser give no rows."""
    lang = F.when(F.col("p_size") % 2 == 0, "python").otherwise("cobol")
    files = v.table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), lang.alias("language"), F.lit("def f(): pass").alias("content"))
    return parsers.symbols(parsers.parse_files(files)).select(F.regexp_extract("path", r"m(\d+)", 1).cast("long").alias("id"))


@R.add("dml_07_08_appended", f"{v.ctes('usage')} SELECT repo_id, kind, total_tokens, CASE WHEN is_estimated THEN 'second' END AS batch FROM usage")
def appended(spark, d):
    """Usage rows appended in two parts, the second with a column more; rows of the first have none in it."""
    path = Rounds(spark).path()
    usage = v.usage(spark, d).select("repo_id", "kind", "total_tokens", "is_estimated")
    points.append_rows(usage.where("NOT is_estimated OR is_estimated IS NULL").drop("is_estimated"), path)
    points.append_rows(usage.where("is_estimated").drop("is_estimated").withColumn("batch", F.lit("second")), path)
    found = spark.read.option("mergeSchema", True).parquet(path)
    return store.add_missing_columns(found, {"batch": "string"}).select("repo_id", "kind", "total_tokens", "batch")
