"""Reports and prompts as data: documentation checks, metadata, listings, prompts, job lists, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.text import tokens
from spindrift.operators.modules import tree_depth
from spindrift.operators.relational import numbered


def issue_counts(files: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """One row: files checked, errors, warnings, and files without an issue. issues: key, issue."""
    per = issues.groupBy(key).agg(F.count_if(F.col("issue").startswith("[ERROR]")).alias("e"), F.count_if(F.col("issue").startswith("[WARNING]")).alias("w"))
    joined = files.select(key).join(per, key, "left").na.fill(0, ["e", "w"])
    return joined.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_warnings"), F.count_if((F.col("e") == 0) & (F.col("w") == 0)).alias("n_ok"))


def metadata(components: DataFrame, leaves: DataFrame, tree: DataFrame) -> DataFrame:
    """One row: components, leaves, depth of the module tree."""
    return components.agg(F.count(F.lit(1)).alias("n_components")).crossJoin(leaves.agg(F.count(F.lit(1)).alias("n_leaves"))).crossJoin(tree_depth(tree))


def needs_clustering(components: DataFrame, limit: int = 36_369) -> DataFrame:
    """One row: tokens of all sources, and whether they are over the limit from which clustering pays."""
    return components.agg(F.coalesce(F.sum(tokens(F.col("source_code"))), F.lit(0)).alias("tokens")).withColumn("cluster", F.col("tokens") > limit)


def module_payload(members: DataFrame, components: DataFrame, most: int = 20) -> DataFrame:
    """module, key_symbols (the first ones in list order), files (distinct, sorted). members: module, position, id."""
    joined = members.join(components.select("id", "name", "file_path"), "id")
    ordered = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("position", "name"))), 1, most), lambda x: x["name"])
    return joined.groupBy("module").agg(ordered.alias("key_symbols"), F.array_sort(F.collect_set("file_path")).alias("files"))


def suggestion_lines(clusters: DataFrame, most: int = 5) -> DataFrame:
    """cluster, line: a suggested group with its first members and the number of others."""
    grouped = clusters.groupBy("cluster").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("ids"))
    head = F.array_join(F.slice("ids", 1, most), ", ")
    rest = F.size("ids") - most
    return grouped.select("cluster", F.concat(F.format_string("- %s: ", "cluster"), head, F.when(rest > 0, F.format_string(" ... and %d more", rest)).otherwise("")).alias("line"))


def summary_inputs(modules: DataFrame, documents: DataFrame, n_modules: int = 20, n_docs: int = 10) -> DataFrame:
    """One row: JSON of the first module names and the first documents, as a summary prompt takes them."""
    names = modules.orderBy("name").limit(n_modules).agg(F.array_sort(F.collect_list("name")).alias("modules"))
    docs = documents.orderBy("id").limit(n_docs).agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("docs"))
    return names.crossJoin(docs).select(F.to_json(F.struct("modules", "docs")).alias("prompt"))


def component_prompt(members: DataFrame, components: DataFrame) -> DataFrame:
    """file_path, section: the components of a module by file, with the first line of their documentation."""
    own = components.join(members.select("id"), "id", "left_semi")
    doc = F.substring(F.trim(F.substring_index(F.coalesce("docstring", F.lit("")), "\n", 1)), 1, 80)
    line = F.concat(F.lit("- "), "name", F.when(doc != "", F.concat(F.lit(": "), doc)).otherwise(""))
    return own.groupBy("file_path").agg(F.concat(F.lit("# File: "), F.first("file_path"), F.lit("\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("section"))


def restored_jobs(saved: DataFrame, cache: DataFrame) -> DataFrame:
    """Completed jobs, and those that the cache knows and the list does not. saved: job_id, status; cache: job_id."""
    done = saved.where(F.col("status") == "completed").select("job_id", "status")
    return done.unionByName(cache.select("job_id", F.lit("completed").alias("status")).join(done, "job_id", "left_anti"))


def navigation(tree: DataFrame) -> DataFrame:
    """prefix, label, href, position of a two-level menu from tree rows (prefix, parent, name, depth)."""
    rows = tree.where(F.col("depth").between(1, 2))
    label = F.initcap(F.translate("name", "_-", "  "))
    return numbered(rows.select("prefix", label.alias("label"), F.concat(F.translate("prefix", "/", "_"), F.lit(".md")).alias("href")), ["prefix"])


def stage_progress(stage_done: Column, total: Column) -> Column:
    """Share of stages that are done, clamped to 0 and 1."""
    return F.least(F.greatest(F.coalesce(F.try_divide(stage_done, total), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def pages(modules: DataFrame, ai_docs: DataFrame, most: int = 12) -> DataFrame:
    """page, kind, position: the overview, modules but the root, and the first generated documents."""
    overview = modules.sparkSession.createDataFrame([("overview", "overview", 0)], "page string, kind string, position int")
    listed = numbered(modules.where((F.col("name") != "root") & (F.col("prefix") != "")).select(F.col("name").alias("page"), F.lit("module").alias("kind"), "prefix"), ["prefix", "page"]).select("page", "kind", F.col("position").cast("int").alias("position"))
    docs = ai_docs.orderBy("id").limit(most).select(F.col("id").cast("string").alias("page"), F.lit("ai").alias("kind"), F.row_number().over(W.orderBy("id")).alias("position"))
    return overview.unionByName(listed).unionByName(docs)


def resolve_php_names(names: DataFrame, uses: DataFrame) -> DataFrame:
    """path, name, resolved: a leading backslash is absolute; a first segment that a file's use statements know as an alias
    stands for what it imports; others lie in the file's namespace. names: path, namespace, name. uses: path, alias, fqn."""
    first = F.substring_index("name", "\\", 1)
    joined = names.withColumn("alias", first).join(uses.select("path", "alias", "fqn"), ["path", "alias"], "left")
    rest = F.expr("substring(name, length(alias) + 1)")
    within = F.when(F.coalesce("namespace", F.lit("")) != "", F.concat("namespace", F.lit("\\"), "name")).otherwise(F.col("name"))
    resolved = F.when(F.col("name").startswith("\\"), F.expr("substring(name, 2)")).when(F.col("fqn").isNotNull(), F.concat("fqn", rest)).otherwise(within)
    return joined.select("path", "name", resolved.alias("resolved"))
