"""Directory hierarchies and module clustering: flat rows (id, parent, prefix), never nested types."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.paths import basename, dirname
from spindrift.operators.graph import Rounds, some
from spindrift.operators.relational import numbered, prefixes


def path_tree(paths: DataFrame) -> DataFrame:
    """prefix, parent, name, depth, n_direct, n_below for each directory; the root is an empty prefix and holds all."""
    below = paths.select(F.posexplode(prefixes(F.col("path"))).alias("depth", "prefix"), F.col("path"))
    grouped = below.groupBy("prefix", "depth").agg(F.count(F.lit(1)).alias("n_below"), F.count_if(dirname(F.col("path")) == F.col("prefix")).alias("n_direct"))
    parent = F.when(F.col("prefix") != "", dirname(F.col("prefix")))
    return grouped.select("prefix", parent.alias("parent"), F.when(F.col("prefix") == "", "root").otherwise(basename(F.col("prefix"))).alias("name"), "depth", "n_direct", "n_below")


def precluster(components: DataFrame) -> DataFrame:
    """cluster (directory, root for none), id of components with a path."""
    where = dirname(F.translate(F.col("path"), "\\", "/"))
    return components.where(F.col("path") != "").select(F.when(where == "", "root").otherwise(where).alias("cluster"), "id")


def merge_small(clusters: DataFrame, min_size: int = 3) -> DataFrame:
    """Members of clusters under min_size go to the nearest ancestor directory that is a cluster of that size; where there
    is none they stay. Only large clusters take members, so the outcome does not depend on an order."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") >= min_size).select("cluster")
    small = sizes.where(F.col("n") < min_size).select("cluster")
    above = small.select("cluster", F.explode(prefixes(F.col("cluster"))).alias("up")).where("up <> ''")
    target = above.join(large.withColumnRenamed("cluster", "up"), "up").groupBy("cluster").agg(F.max_by("up", F.length("up")).alias("into"))
    return clusters.join(target, "cluster", "left").select(F.coalesce("into", "cluster").alias("cluster"), "id")


def suggest_modules(clusters: DataFrame, edges: DataFrame, max_modules: int = 10) -> DataFrame:
    """module, path, n, density: small clusters (under 2) merged, then the two smallest again and again until at most
    max_modules are left.

    Merging the two smallest is one step after another by its nature. It runs on the table of cluster sizes, one row for
    each directory with code of one repository, with a heap of them (n log n); members never leave the cluster. A merged
    pair is named after the common directories or else ``a_and_b``, and joins a cluster that has this name already.
    """
    merged = Rounds(clusters.sparkSession).keep(merge_small(clusters, 2))
    start = [(r["cluster"], r["n"]) for r in merged.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    names, sizes, up = [name for name, _ in start], [n for _, n in start], [-1] * len(start)  # by number of a cluster
    live = {name: k for k, name in enumerate(names)}
    heap = [(n, name, live[name]) for name, n in start]
    heapq.heapify(heap)

    def smallest() -> int:
        while True:
            n, name, k = heapq.heappop(heap)
            if live.get(name) == k and sizes[k] == n:  # else it was merged, or has grown, since it was put there
                return live.pop(name)

    while len(live) > max_modules:
        one, two = smallest(), smallest()
        common = []
        for a, b in zip(names[one].split("/"), names[two].split("/"), strict=False):
            if a != b:
                break
            common.append(a)
        name = "/".join(common) or f"{names[one]}_and_{names[two]}"
        if name not in live:
            live[name] = len(names)
            names.append(name)
            sizes.append(0)
            up.append(-1)
        k = up[one] = up[two] = live[name]
        sizes[k] += sizes[one] + sizes[two]
        heapq.heappush(heap, (sizes[k], name, k))

    def top(k: int) -> int:
        path = []
        while up[k] >= 0:
            path.append(k)
            k = up[k]
        for x in path:
            up[x] = k
        return k

    into = {name: names[top(k)] for k, (name, _) in enumerate(start)}
    named = merged.sparkSession.createDataFrame(list(into.items()), "cluster string, path string")
    members = merged.join(named, "cluster").select(F.col("path").alias("cluster"), "id")
    from spindrift.operators.graph import cluster_density

    dense = cluster_density(members, edges)
    identifier = F.regexp_replace(F.translate("cluster", "/.", "__"), "^_", "")
    return dense.select(F.when(identifier == "", "core").otherwise(identifier).alias("module"), F.col("cluster").alias("path"), "n", "density")


def refine(assignments: DataFrame, parents: DataFrame, file_edges: DataFrame, min_files: int = 2, ratio: float = 0.6) -> DataFrame:
    """module, path after merging modules into their parents: few files, or most outgoing edges lead to the parent.

    assignments: module, path. parents: module, parent; modules directly below the root do not merge. Chains of merges
    are followed by doubling, in a logarithmic number of rounds.
    """
    rounds = Rounds(assignments.sparkSession)
    of = assignments.select("module", "path")
    out = file_edges.join(of.select(F.col("path").alias("src_path"), F.col("module").alias("src")), "src_path").join(of.select(F.col("path").alias("dst_path"), F.col("module").alias("dst")), "dst_path").where("src <> dst")
    up = parents.where(F.col("parent").isNotNull() & (F.col("parent") != ""))
    edges = out.join(up.withColumnRenamed("module", "src"), "src").groupBy(F.col("src").alias("module")).agg(F.count(F.lit(1)).alias("n_out"), F.count_if(F.col("dst") == F.col("parent")).alias("n_up"))
    sizes = of.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"))
    merge = up.join(sizes, "module").join(edges, "module", "left").where((F.col("n_files") <= min_files) | (F.coalesce(F.col("n_up") / F.col("n_out"), F.lit(0.0)) >= ratio))
    step = rounds.keep(merge.select("module", F.col("parent").alias("into")))
    for _ in range(64):  # a chain doubles its reach with each round; parents in a circle have no end
        further = step.select(F.col("module").alias("into"), F.col("into").alias("next"))
        moved = rounds.keep(step.join(further, "into", "left").select("module", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved")))
        step = moved.select("module", "into")
        if not some(moved.where("moved")):
            break
    return of.join(step, "module", "left").select(F.coalesce("into", "module").alias("module"), "path")


def processing_order(tree: DataFrame) -> DataFrame:
    """Rows of a path tree with the position of their post-order: children in order of name, before their parent."""
    # A parent's key is its children's with a larger character behind.
    key = F.when(F.col("prefix") == "", F.lit("\U0010ffff")).otherwise(F.concat("prefix", F.lit("/\U0010ffff")))
    return numbered(tree, [key])


def components_by_file(components: DataFrame) -> DataFrame:
    """file_path and the ids in it, in order, as lines of text."""
    return components.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "\n").alias("listing"), F.count(F.lit(1)).alias("n"))


def complex_modules(members: DataFrame) -> DataFrame:
    """cluster, is_complex: whether its components lie in more than one file. members: cluster, file_path."""
    return members.groupBy("cluster").agg((F.count_distinct("file_path") > 1).alias("is_complex"))


def module_files(documents: DataFrame, position: str) -> DataFrame:
    """module, path, position: files that the documents of a module list, each once, in order of first mention."""
    from pyspark.sql import Window as W

    first = documents.select("module", F.col(position).alias("_doc"), F.posexplode("files").alias("_at", "path")).groupBy("module", "path").agg(F.min(F.struct("_doc", "_at")).alias("_first"))
    return first.select("module", "path", F.row_number().over(W.partitionBy("module").orderBy("_first")).alias("position"))


def module_stats(members: DataFrame) -> DataFrame:
    """module, n_files, n_symbols. members: module, path, n_symbols."""
    return members.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_symbols").alias("n_symbols"))


def tree_depth(modules: DataFrame) -> DataFrame:
    """One row: the largest number of path segments."""
    return modules.agg(F.coalesce(F.max(F.size(F.filter(F.split("prefix", "/"), lambda x: x != ""))), F.lit(0)).alias("depth"))


def parent_overview(tree: DataFrame, documents: DataFrame, target: str) -> DataFrame:
    """The direct children of target with their documents, if any. documents: prefix, content."""
    return tree.where(F.col("parent") == target).join(documents, "prefix", "left").select("prefix", "name", "content", F.col("content").isNotNull().alias("has_doc"))


def known_members(listed: DataFrame, components: DataFrame) -> DataFrame:
    """module, ids: the listed ids (array) that are components, in list order; modules without any go."""
    out = listed.select("module", F.posexplode("ids").alias("pos", "id")).join(components.select("id"), "id", "left_semi")
    return out.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
