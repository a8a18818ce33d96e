"""Point reads, small projections and lookups over the tables of repositories, users, jobs and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attributes(rows: DataFrame, key: str, value, *columns: str) -> DataFrame:
    """Some columns of the rows with a key: an equality that reaches the scan, and only these columns are read."""
    return rows.where(F.col(key) == value).select(*columns)


def setting(settings: DataFrame, key: str, schema: str | None = None) -> DataFrame:
    """value of a setting (columns key, value), parsed where a schema is given; null if it is no JSON of this kind."""
    found = settings.where(F.col("key") == key).select("value")
    return found if schema is None else found.select(F.from_json("value", schema).alias("value"))


def config(settings: DataFrame, key: str, fields: tuple[str, ...] = ("base_url", "api_key", "model_name")) -> DataFrame:
    """The fields of a model's configuration (JSON), and is_complete if none of them is missing or empty."""
    found = setting(settings, key, "map<string,string>")
    value = lambda f: F.try_element_at("value", F.lit(f))
    ok = F.lit(True)
    for f in fields:
        ok = ok & (F.coalesce(F.trim(value(f)), F.lit("")) != "")
    return found.select(*[value(f).alias(f) for f in fields], ok.alias("is_complete"))


def display_name(repo_type: Column, owner: Column, repo: Column, source: Column, name: Column, key: Column) -> Column:
    """owner/repo for the known hosts, the folder for local ones, else name, repository or id."""
    filled = lambda c: F.nullif(c, F.lit(""))
    folder = F.substring_index(F.translate(source, "\\", "/"), "/", -1)
    hosted = F.when(repo_type.isin("github", "gitlab", "bitbucket") & filled(owner).isNotNull() & filled(repo).isNotNull(), F.concat(owner, F.lit("/"), repo))
    local = F.when((repo_type == "local") & filled(source).isNotNull(), F.coalesce(filled(folder), filled(repo), filled(name)))
    return F.coalesce(hosted, local, filled(name), filled(repo), key)


def git_url(repo_type: Column, owner: Column, repo: Column, source: Column) -> Column:
    """Where a repository can be cloned from; empty if nowhere."""
    hosts = F.when(repo_type == "github", "https://github.com/").when(repo_type == "gitlab", "https://gitlab.com/").when(repo_type == "bitbucket", "https://bitbucket.org/")
    known = F.when((owner != "") & (repo != ""), F.concat(hosts, owner, F.lit("/"), repo))
    return F.coalesce(F.when(repo_type == "local", "").when(source.startswith("http"), source).otherwise(known), F.lit(""))


def adapted_symbols(nodes: DataFrame) -> DataFrame:
    """Symbols of parser nodes (id, name, file_path, node_type, component_type, start_line, end_line, class_name)."""
    kind = F.coalesce(F.nullif("node_type", F.lit("")), F.nullif("component_type", F.lit("")), F.lit("function"))
    return nodes.select("id", kind.alias("kind"), "name", "file_path", F.coalesce("start_line", F.lit(0)).alias("line_start"), F.coalesce("end_line", F.lit(0)).alias("line_end"), F.col("class_name").alias("container"), F.lit(None).cast("string").alias("signature"))


def module_ids(components: DataFrame) -> DataFrame:
    """Distinct ids without their last segment, of those that have several."""
    return components.where(F.col("id").contains(".")).select(F.regexp_replace("id", r"\.[^.]+$", "").alias("module_id")).distinct()


def component_type(kind: Column, path: Column) -> Column:
    """class, function or method as they are, interface-like kinds as classes, else the module of a file or the kind."""
    return F.when(kind.isin("interface", "struct", "enum", "record", "trait", "abstract class"), "class").when(kind.isin("async_function"), "function").when(kind.isNull() & path.isNotNull(), "module").otherwise(kind)


def last_definitions(symbols: DataFrame) -> DataFrame:
    """file_path, name, id: within a file the last definition of a name wins. symbols: id, name, file_path, pos."""
    return symbols.groupBy("file_path", "name").agg(F.max_by("id", F.col("pos")).alias("id"))


def has_types(components: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """One row: whether any of the wanted kinds occurs."""
    kinds = components.agg(F.collect_set("kind").alias("kinds"))
    return kinds.select(F.arrays_overlap("kinds", F.array(*map(F.lit, wanted))).alias("found"))


def recent_jobs(jobs: DataFrame, k: int) -> DataFrame:
    """The k jobs that were made last, latest first."""
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(k)


def admitted(jobs: DataFrame, waiting: int, size: int = 100) -> DataFrame:
    """The jobs that still find a place in a queue of bounded size in which some wait: first come, first served."""
    return jobs.orderBy("created_at", "job_id").limit(max(0, size - waiting))


def with_defaults(messages: DataFrame, now: Column) -> DataFrame:
    """Messages with the defaults of their fields: a user's, empty, made now."""
    return messages.withColumn("role", F.coalesce("role", F.lit("user"))).withColumn("content", F.coalesce("content", F.lit(""))).withColumn("timestamp", F.coalesce("timestamp", now))


def message_json(messages: DataFrame, now: Column) -> DataFrame:
    """conv_id, turn, json of messages (role, content, thinking, citations, timestamp), null fields included."""
    fields = F.struct("role", "content", "thinking", "citations", "timestamp")
    return with_defaults(messages, now).select("conv_id", "turn", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def valid_key(key: Column, least: int = 10) -> Column:
    """Whether a key is long enough and has no space in it."""
    return F.coalesce((F.length(F.trim(key)) >= least) & ~F.trim(key).contains(" "), F.lit(False))


def valid_model(model: Column) -> Column:
    return F.coalesce(F.trim(model) != "", F.lit(False))


def is_top_tier(model: Column, names: tuple[str, ...] = ("opus", "sonnet-4", "gpt-4", "gpt-5", "gemini-2.5-pro", "o1", "o3")) -> Column:
    """Whether a model's name holds one of the names of the large ones."""
    return F.coalesce(F.lower(model).rlike("|".join(n.replace(".", r"\.") for n in names)), F.lit(False))


def node_index(nodes: DataFrame) -> DataFrame:
    """prefix, module_id, name of modules by their path, the root left out; of equal prefixes the first id."""
    return nodes.where("prefix <> ''").groupBy("prefix").agg(F.min(F.struct("module_id", "name")).alias("x")).select("prefix", "x.module_id", "x.name")


def unchanged(repos: DataFrame, heads: DataFrame) -> DataFrame:
    """Repositories (repo_id, commit) whose commit is that of their head: nothing is to be done for them."""
    return repos.where("commit <> ''").join(heads.select("repo_id", "commit"), ["repo_id", "commit"], "left_semi")


def to_update(repos: DataFrame, heads: DataFrame) -> DataFrame:
    """repo_id, commit (known so far), head of those that have moved, or were never analysed."""
    out = heads.select("repo_id", F.col("commit").alias("head")).join(repos.select("repo_id", F.nullif("commit", F.lit("")).alias("commit")), "repo_id", "left")
    return out.where(~F.col("commit").eqNullSafe(F.col("head"))).select("repo_id", "commit", "head")


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows behind those of a table."""
    rows.write.mode("append").parquet(path)
