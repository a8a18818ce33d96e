"""Nested module trees (JSON objects: name to path, components, children) as rows, and rows as nested trees.

A tree is unfolded level by level: each round parses the children that the round before found, so trees of any depth
take as many rounds as they have levels and no recursive type. Rows carry their place in the tree as an array of child
positions, which sorts rows in pre-order and tells ancestors by its beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.graph import Rounds, some

_OBJECT = "map<string,string>"
#: Rows of modules, components or symbols that one task takes: such rows shrink so much when they move that tasks of equal bytes would not do.
ROWS = 100_000


def _parts(*tables: DataFrame) -> int:
    return max(1, -(-sum(t.count() for t in tables) // ROWS))


def _entries(json: Column) -> Column:
    return F.map_entries(F.coalesce(F.from_json(json, _OBJECT), F.create_map().cast(_OBJECT)))


def module_nodes(trees: DataFrame, key: str = "repo_id", tree: str = "tree") -> DataFrame:
    """key, module_id (its path, else its name), name, parent_id, depth (from 0), place, components of each module of
    nested trees. A tree that is null or no object has no module."""
    rounds = Rounds(trees.sparkSession)
    trees = trees.select(key, F.col(tree).alias("tree")).repartition(_parts(trees), key)
    level = trees.select(key, F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<int>").alias("place"), F.col("tree").alias("children"))
    out, depth = None, 0
    while out is None or some(level):
        found = level.select(key, "parent_id", "place", F.posexplode(_entries(F.col("children"))).alias("at", "entry"))
        info = lambda path, kind: F.from_json("entry.value", f"struct<{path}:{kind}>")[path]
        node = found.select(
            key, F.coalesce(F.nullif(info("path", "string"), F.lit("")), F.col("entry.key")).alias("module_id"), F.col("entry.key").alias("name"), "parent_id", F.lit(depth).alias("depth"),
            F.concat("place", F.array("at")).alias("place"), F.coalesce(info("components", "array<string>"), F.array().cast("array<string>")).alias("components"), info("children", "string").alias("children"))
        node = rounds.keep(node)
        out = node.drop("children") if out is None else out.unionByName(node.drop("children"))
        level = node.where("children IS NOT NULL").select(key, F.col("module_id").alias("parent_id"), "place", "children")
        depth += 1
    return out


def module_names(nodes: DataFrame, key: str = "repo_id") -> DataFrame:
    """key, module_id, name, components: of modules with one id the last in pre-order."""
    last = nodes.groupBy(key, "module_id").agg(F.max_by(F.struct("name", "components"), F.col("place")).alias("x"))
    return last.select(key, "module_id", "x.name", "x.components")


def subtree_files(nodes: DataFrame, symbols: DataFrame, key: str = "repo_id") -> DataFrame:
    """key, module_id, place, position, path: the files of a module's known components, sorted, then those of its children
    in tree order. A file that several of them hold occurs as often. No task takes more than a bounded number of components or
    modules, however many there are."""
    listed = nodes.select(key, "place", F.explode("components").alias("id"))
    known = symbols.select(key, "id", F.col("file_path").alias("path"))
    parts = _parts(listed, known)
    own = listed.repartition(parts, key, "id").join(known.repartition(parts, key, "id"), [key, "id"]).where("path <> ''").select(key, "place", "path").repartition(parts, key, "place").distinct()
    at = F.explode(F.sequence(F.lit(1), F.size("place")))
    upward = own.select(key, "place", "path", at.alias("n")).select(key, F.slice("place", F.lit(1), F.col("n")).alias("above"), "place", "path")
    lists = upward.select(key, F.col("above").alias("place"), F.struct(F.col("place").alias("below"), "path").alias("file")).repartition(parts, key, "place")
    lists = lists.groupBy(key, "place").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return nodes.select(key, "module_id", "place").repartition(parts, key, "place").join(lists, [key, "place"]).select(key, "module_id", "place", F.posexplode("files").alias("position", "x")).select(key, "module_id", "place", "position", F.col("x.path").alias("path"))


def module_documents(nodes: DataFrame, files: DataFrame, key: str = "repo_id") -> DataFrame:
    """key, module_id, content: the document ``name.md`` of each module that has one. files: key, path, content; one
    folder for each key."""
    docs = files.select(key, F.regexp_extract("path", r"^(?:.*/)?([^/]*)\.md$", 1).alias("name"), "content").where("name <> ''")
    return module_names(nodes, key).join(docs, [key, "name"]).select(key, "module_id", "content")


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def nested(nodes: DataFrame, key: str = "repo_id") -> DataFrame:
    """key, tree: the nested trees of module rows, from the deepest level up."""
    rounds = Rounds(nodes.sparkSession)
    rows = rounds.keep(nodes.select(key, "module_id", "name", "place", "components"))
    depth = rows.agg(F.max(F.size("place"))).first()[0] or 0
    below = None
    for level in range(depth, 0, -1):
        here = rows.where(F.size("place") == level)
        text = F.concat(_quoted(F.col("name")), F.lit(': {"path": '), _quoted(F.col("module_id")), F.lit(', "components": '), F.to_json("components"), F.lit(', "children": {'), F.coalesce("inner", F.lit("")), F.lit("}}"))
        here = here.withColumn("inner", F.lit(None).cast("string")) if below is None else here.join(below, [key, "place"], "left")
        here = here.select(key, F.slice("place", F.lit(1), F.size("place") - 1).alias("place"), F.element_at("place", -1).alias("at"), text.alias("text"))
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), ", ")
        below = rounds.keep(here.groupBy(key, "place").agg(inner.alias("inner")))
    if below is None:
        return nodes.select(key).distinct().select(key, F.lit("{}").alias("tree"))
    return below.select(key, F.concat(F.lit("{"), "inner", F.lit("}")).alias("tree"))


def tree_json(tree: DataFrame) -> DataFrame:
    """path, json of each row of a directory tree (path, parent, name, is_dir): a directory's children by name, files as
    their language or null. One level for each round, from the deepest up."""
    rounds = Rounds(tree.sparkSession)
    rows = rounds.keep(tree.select("path", "parent", "name", "is_dir", "language"))
    depth = rows.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    below = done = None
    for level in range(depth, 0, -1):
        here = rows.where(F.size(F.split("path", "/")) == level)
        here = here.withColumn("inner", F.lit(None).cast("string")) if below is None else here.join(below, here["path"] == below["of"], "left").drop("of")
        json = F.when(F.col("is_dir"), F.concat(F.lit("{"), F.coalesce("inner", F.lit("")), F.lit("}"))).otherwise(F.coalesce(_quoted(F.col("language")), F.lit("null")))
        here = rounds.keep(here.select("path", "parent", "name", json.alias("json")))
        done = here.select("path", "json") if done is None else done.unionByName(here.select("path", "json"))
        entry = F.struct("name", F.concat(_quoted(F.col("name")), F.lit(": "), "json").alias("text"))
        below = rounds.keep(here.groupBy(F.col("parent").alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), ", ").alias("inner")))
    root = below.where("of = ''").select(F.lit("").alias("path"), F.concat(F.lit("{"), "inner", F.lit("}")).alias("json")) if below is not None else None
    return done.unionByName(root) if done is not None else rows.select("path", F.lit("{}").alias("json")).limit(0)


def submodule_specs(raw: DataFrame, key: str, spec: str) -> DataFrame:
    """key, name, components of proposed submodules, given as an object (name to list, one component or null) or as a list
    of objects with either naming of the fields. Of equal names the last counts; other forms have no row."""
    text = F.ltrim(F.col(spec))
    as_list = lambda v: F.when(v.isNull(), F.array().cast("array<string>")).when(F.ltrim(v).startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.array(v))
    pairs = F.transform(_entries(text), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    present = lambda m, k, empty: F.when(~F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("")).isin(*empty), F.try_element_at(m, F.lit(k)))
    first = lambda m, names, empty: F.coalesce(*[present(m, k, empty) for k in names])
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    items = F.transform(F.filter(items, lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, _OBJECT))
    named = F.transform(items, lambda m: F.struct(first(m, ("sub_module_name", "module_name", "name"), ("",)).alias("name"), first(m, ("core_component_ids", "components", "core_components"), ("", "[]")).alias("value")))
    both = F.when(text.startswith("{"), pairs).when(text.startswith("["), F.filter(named, lambda x: x["name"].isNotNull()))
    rows = raw.select(key, F.posexplode(both).alias("at", "x"))
    last = rows.groupBy(key, F.col("x.name").alias("name")).agg(F.max_by(F.struct("x.value"), F.col("at")).alias("v"))
    return last.select(key, "name", as_list(F.col("v.value")).alias("components"))
