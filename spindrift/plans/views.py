"""The driver's tables read as the engine's domain: files, symbols, calls, repositories, usage, jobs, modules.

Each view is a function of (spark, sf_dir); ``SQL`` holds the same views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, language, size, content."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, kind, file_path, line_start, line_end."""
    kind = F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "class").when(F.col("p_type").isin("MEDIUM", "PROMO"), "function").otherwise("method")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_brand").alias("file_path"),
        F.col("p_size").alias("line_start"), (F.col("p_size") + 10).alias("line_end"))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, pos: consecutive lines of an order, one row for each occurrence."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    joined = items.withColumnRenamed("l_partkey", "src").join(after, ["l_orderkey", "l_linenumber"])
    return joined.select("src", "dst", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, distinct."""
    return call_sites(spark, sf_dir).select("src", "dst").distinct()


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_path, dst_path of calls between different files, one row for each call."""
    of = symbols(spark, sf_dir).select("id", "file_path")
    lifted = calls(spark, sf_dir).join(of.select(F.col("id").alias("src"), F.col("file_path").alias("src_path")), "src").join(of.select(F.col("id").alias("dst"), F.col("file_path").alias("dst_path")), "dst")
    return lifted.where("src_path <> dst_path").select("src_path", "dst_path")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, kind, source, total_tokens, is_estimated, created_at."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("repo_id"), F.when(F.col("event_type").isin("click", "view"), "llm").otherwise("embedding").alias("kind"), F.col("event_type").alias("source"),
        F.round(F.col("value") * 100).cast("long").alias("total_tokens"), (F.get_json_object("props", "$.k").cast("long") % 2 == 1).alias("is_estimated"), F.col("ts").alias("created_at"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, seq, status, ts, progress: events as the states of a job for each user."""
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").otherwise("running")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), "ts", F.get_json_object("props", "$.k").cast("int").alias("progress"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, owner_id, status, created_at."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


SQL = {
    "files": "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id::VARCHAR AS path, lang AS language, n_chars AS size, text AS content FROM documents)",
    "symbols": "symbols AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'class' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'function' ELSE 'method' END AS kind, p_brand AS file_path, p_size AS line_start, p_size + 10 AS line_end FROM part)",
    "call_sites": "call_sites AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, a.l_orderkey * 10 + a.l_linenumber AS pos FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)",
    "calls": "calls AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)",
    "file_edges": "file_edges AS (SELECT s.file_path AS src_path, d.file_path AS dst_path FROM calls JOIN symbols s ON s.id = src JOIN symbols d ON d.id = dst WHERE s.file_path <> d.file_path)",
    "usage": "usage AS (SELECT user_id AS repo_id, CASE WHEN event_type IN ('click', 'view') THEN 'llm' ELSE 'embedding' END AS kind, event_type AS source, round(value * 100)::BIGINT AS total_tokens, (props->>'$.k')::BIGINT % 2 = 1 AS is_estimated, ts AS created_at FROM events)",
    "jobs": "jobs AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts, (props->>'$.k')::INT AS progress FROM events)",
    "repos": "repos AS (SELECT o_orderkey AS id, o_custkey AS owner_id, o_orderstatus AS status, o_orderdate AS created_at FROM orders)",
}
_NEEDS = {"file_edges": ("calls", "symbols")}


def ctes(*names: str) -> str:
    """``WITH`` and the named views, with those that they read first."""
    order: list[str] = []
    for name in names:
        for x in (*_NEEDS.get(name, ()), name):
            if x not in order:
                order.append(x)
    return "WITH RECURSIVE " + ", ".join(SQL[x] for x in order)
