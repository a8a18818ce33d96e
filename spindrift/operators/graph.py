"""Graph analytics over edge tables (src, dst): degrees, components, levels, traversal, importance, leaves.

Loops run on tables that are written between rounds (see :class:`Rounds`), so lineage stays short and a lost executor
costs one task. No operator collects a graph to the driver.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OOP = ("class", "interface", "struct", "enum", "record", "abstract class")
FUNCTIONS = ("function", "async_function", "method")
#: Types that are always valid, and those that are added where classes are rare.
VALID, ADDED = (*OOP, "annotation"), ("function", "async_function")
#: Parts of an identifier that rule it out, and the one that a class may have.
BAD_PARTS, EXEMPT_PART = ("error", "exception", "failed", "invalid"), "exception"
ENTRY_NAMES = ("main", "__main__", "run", "start", "execute")
LEAF_LIMIT = 400
#: One in so many is rare: what rare nodes or edges would save does not pay for a pass over all edges, unless these are few.
RARE, SMALL = 16, 1_000_000


class Rounds:
    """Tables of a loop, written to the folder that driver and executors share: spark.checkpoint.dir. Where it is unset a
    local master takes a folder of its own, and a cluster is refused, as no folder of one machine would do.

    A table that is kept under a name takes the place of the one before; that one's files go when the next one is there,
    as what was read from them may still be part of a plan that is built in between.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = os.path.join(tempfile.gettempdir(), f"spindrift-{os.getuid()}")
        self.spark, self.root = spark, f"{root.rstrip('/')}/rounds-{spark.sparkContext.applicationId}"
        self.named: dict[str, list] = {}

    def _store(self, path: str):
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hpath, hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self) -> str:
        """A new path in the folder; it goes when the application ends."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        hpath, store = self._store(path)
        store.deleteOnExit(hpath)
        return path

    def keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        if name:
            held = self.named.setdefault(name, [])
            held.append(path)
            if len(held) > 2:
                hpath, store = self._store(held.pop(0))
                store.delete(hpath, True)
        return self.spark.read.schema(df.schema).parquet(path)


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def build_graph(components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Distinct edges whose ends are known components (column id); self edges stay."""
    ids = components.select("id")
    known = dependencies.select("src", "dst").distinct()
    return known.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out: edges counted as often as they occur."""
    ends = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def degree_centrality(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes with the most distinct neighbours: node, degree."""
    ends = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return ends.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (column node)."""
    keep = nodes.select("node")
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def _single(rounds: Rounds, edges: DataFrame) -> DataFrame:
    """Nodes with one edge in and one out; edges are distinct."""
    ins, outs = edges.groupBy(F.col("dst").alias("node")).count(), edges.groupBy(F.col("src").alias("node")).count()
    return rounds.keep(ins.where("count = 1").select("node").join(outs.where("count = 1").select("node"), "node"))


def _run_ends(rounds: Rounds, edges: DataFrame, single: DataFrame, n: int, forward: bool) -> DataFrame:
    """node, end, hops, least, more: for each single node the first node that is none on its only way, how far that is, and
    the least single node up to it, in rounds whose hops double. On a ring of single nodes there is no end: more stays, and
    least is that of the ring."""
    here, there = ("src", "dst") if forward else ("dst", "src")
    way = edges.join(single.withColumnRenamed("node", here), here, "left_semi").select(F.col(here).alias("node"), F.col(there).alias("end"))
    ends = single.select(F.col("node").alias("end"), F.lit(True).alias("more"))
    way = rounds.keep(way.join(ends, "end", "left").select("node", "end", F.lit(1).cast("long").alias("hops"), F.col("node").alias("least"), F.coalesce("more", F.lit(False)).alias("more")))
    turn = 0
    while some(way.where("more")) and 1 << turn <= 2 * n:
        turn += 1
        step = way.select(F.col("node").alias("end"), F.col("end").alias("_end"), F.col("hops").alias("_hops"), F.col("least").alias("_least"), F.col("more").alias("_more"))
        jumped = way.join(step, "end", "left").select(
            "node", F.coalesce("_end", "end").alias("end"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.least("least", "_least").alias("least"), F.coalesce("_more", F.lit(False)).alias("more")
        )
        way = rounds.keep(jumped, f"way{forward}")
    return way


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """src, dst: distinct edges between different components, as their names."""
    of = components.select("node", "component")
    lifted = edges.join(of.select(F.col("node").alias("src"), F.col("component").alias("c1")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst")
    return lifted.where("c1 <> c2").select(F.col("c1").alias("src"), F.col("c2").alias("dst")).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for each node of an edge.

    Runs of nodes with one edge in and one out are contracted first, by doubling, where such nodes are not rare: a run is in a
    component if both of its ends are in it, and a ring of such nodes is one. The rest is coloured. So neither a long chain nor a
    long cycle without branches takes more than a logarithmic number of rounds.
    """
    rounds = Rounds(edges.sparkSession)
    every = rounds.keep(edges.select("src", "dst").distinct())
    ends = lambda here: every.groupBy(F.col(here).alias("node")).agg(F.count_if(F.col("src") != F.col("dst")).alias("n"))
    ins, outs = ends("dst").withColumnRenamed("n", "n_in"), ends("src").withColumnRenamed("n", "n_out")
    counted = rounds.keep(ins.join(outs, "node", "full"))
    nodes = counted.select("node")
    single = rounds.keep(counted.where("n_in = 1 AND n_out = 1").select("node"))
    proper = every.where("src <> dst")
    n = nodes.count()
    if RARE * single.count() <= n:
        return _coloured(proper, nodes)
    back, on = (_run_ends(rounds, proper, single, n, forward) for forward in (False, True))
    last = back.where("NOT more").select(F.col("node").alias("src"), F.col("end").alias("head"))
    kept = proper.join(single.withColumnRenamed("node", "dst"), "dst", "left_anti").join(last, "src", "left")
    core = rounds.keep(kept.select(F.coalesce("head", "src").alias("src"), "dst").distinct())
    ends = core.select(F.col("src").alias("node")).unionByName(core.select(F.col("dst").alias("node"))).distinct()
    found = rounds.keep(_coloured(core.where("src <> dst"), ends))
    of = lambda end, name: found.select(F.col("node").alias(end), F.col("component").alias(name))
    runs = back.where("NOT more").select("node", F.col("end").alias("head")).join(on.select("node", F.col("end").alias("tail")), "node")
    runs = runs.join(of("head", "one"), "head", "left").join(of("tail", "two"), "tail", "left")
    on_runs = runs.select("node", F.when(F.col("one") == F.col("two"), F.col("one")).otherwise(F.col("node")).alias("component"))
    rings = back.where("more").select("node", F.col("least").alias("component"))
    known = rounds.keep(found.select("node", "component").unionByName(on_runs).unionByName(rings))
    names = known.groupBy("component").agg(F.min("node").alias("least"))
    named = known.join(names, "component").select("node", F.col("least").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _coloured(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The components of a graph by colours. edges: distinct, between different nodes, written; nodes: all of the graph.

    Forward and backward colouring: nodes that have no way in or out within their colour are components of their own
    and go first, as long as many do; then the smallest label flows forward, each colour's root takes the nodes from which it
    can be reached within the colour, and the rest is coloured anew.
    """
    rounds = Rounds(edges.sparkSession)
    done: list[DataFrame] = []
    left = edges.count()
    while left:
        # Trim: a node without edges in or out is alone.
        while True:
            into, out_of = rounds.keep(edges.select(F.col("dst").alias("src")).distinct(), "into"), rounds.keep(edges.select(F.col("src").alias("dst")).distinct(), "out")
            before, edges = left, rounds.keep(edges.join(into, "src", "left_semi").join(out_of, "dst", "left_semi").select("src", "dst"), "inner")
            left = edges.count()
            if left == before or (left > SMALL and RARE * (before - left) < before):
                break
        if not left:
            break
        live = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colour = rounds.keep(live.withColumn("colour", F.col("node")))
        while True:
            flow = edges.join(colour.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            moved = rounds.keep(colour.join(flow, "node", "left").select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") < F.col("colour")).alias("changed")), "moved")
            colour = moved.select("node", "colour")
            if not some(moved.where("changed")):
                break
            # What reaches a colour's node reaches all of that colour: ways double, and only the colours in use are looked up.
            used = colour.select(F.col("colour").alias("node")).distinct()
            lower = colour.where("colour < node").join(used, "node", "left_semi").select(F.col("node").alias("colour"), F.col("colour").alias("lower"))
            colour = rounds.keep(colour.join(lower, "colour", "left").select("node", F.coalesce("lower", "colour").alias("colour")), "lowered")
        back = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour"))
        back = rounds.keep(back)
        reached = rounds.keep(colour.where("node = colour"))
        frontier = reached
        while some(frontier):
            step = back.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = rounds.keep(step.join(reached.select("node"), "node", "left_anti"))
            reached = rounds.keep(reached.unionByName(frontier), f"reached{len(done)}")
        done.append(reached.select("node", F.col("colour").alias("component")))
        gone = reached.select("node")
        edges = rounds.keep(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        left = edges.count()
    if not done:
        return nodes.select("node", F.col("node").alias("component"))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    # A colour's root is its smallest forward label; the component is named after its smallest node.
    names = found.groupBy("component").agg(F.min("node").alias("least"))
    found = found.join(names, "component").select("node", F.col("least").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for each node of an edge, whichever way edges lead.

    Stars are contracted: each node's larger neighbours are linked to the least node around it, then each node's smaller
    ones. The number of rounds is logarithmic in the nodes of a component, not its diameter.
    """
    rounds = Rounds(edges.sparkSession)
    nodes = rounds.keep(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    now = rounds.keep(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = rounds.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = rounds.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "now")
        after = state(now)
        if after == before:
            return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = after


def break_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges without those within a component that do not lead to a larger node, so what is left has no cycle."""
    of = components.select("node", "component")
    both = edges.join(of.select(F.col("node").alias("src"), F.col("component").alias("c1")), "src", "left").join(of.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst", "left")
    inside = F.coalesce(F.col("c1") == F.col("c2"), F.lit(False)) | (F.col("src") == F.col("dst"))
    return both.where(~inside | (F.col("src") < F.col("dst"))).select("src", "dst")


def topological_levels(edges: DataFrame) -> DataFrame:
    """node, level of a graph without cycles: 0 where nothing leads in, else one more than the largest level before.

    Runs of nodes with one edge in and one out are contracted first, by doubling, into one edge as long as the run, so a chain
    takes a logarithmic number of rounds. Then levels grow along the edges, a round for each edge of the longest way that is
    left, in one table. A graph with a cycle raises.
    """
    rounds = Rounds(edges.sparkSession)
    every = rounds.keep(edges.select("src", "dst").distinct())
    nodes = rounds.keep(every.select(F.col("src").alias("node")).unionByName(every.select(F.col("dst").alias("node"))).distinct())
    if some(every.where("src = dst")):
        raise ValueError("the graph has a cycle")
    n = nodes.count()
    single = _single(rounds, every)
    back = _run_ends(rounds, every, single, n, forward=False).withColumnRenamed("end", "head")
    if some(back.where("more")):
        raise ValueError("the graph has a cycle")
    kept = every.join(single.withColumnRenamed("node", "dst"), "dst", "left_anti")
    lengths = kept.join(back.select(F.col("node").alias("src"), "head", "hops"), "src", "left")
    ways = rounds.keep(lengths.select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("hops", F.lit(0)) + 1).alias("length")).groupBy("src", "dst").agg(F.max("length").alias("length")))
    level = rounds.keep(nodes.join(single, "node", "left_anti").select("node", F.lit(0).cast("long").alias("level"), F.lit(True).alias("new")))
    turn = 0
    while some(level.where("new")):
        turn += 1
        if turn > n:
            raise ValueError("the graph has a cycle")
        moved = ways.join(level.where("new").select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("level") + F.col("length")).alias("way"))
        grown = level.join(moved, "node", "left")
        level = rounds.keep(grown.select("node", F.greatest("level", F.coalesce("way", "level")).alias("level"), F.coalesce(F.col("way") > F.col("level"), F.lit(False)).alias("new")), "level")
    on_runs = back.join(level.select(F.col("node").alias("head"), "level"), "head").select("node", (F.col("level") + F.col("hops")).alias("level"))
    return level.select("node", "level").unionByName(on_runs).select("node", F.col("level").cast("int").alias("level"))


def component_levels(edges: DataFrame, components: DataFrame) -> DataFrame:
    """node (a component), level of the graph whose nodes are the components and which so has no cycle.

    A component without edges to others has level 0.
    """
    rounds = Rounds(edges.sparkSession)
    lifted = rounds.keep(condensed(edges, components))
    levels = topological_levels(lifted)
    return components.select(F.col("component").alias("node")).distinct().join(levels, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))


def topological_order(edges: DataFrame) -> DataFrame:
    """node, level, with the order that (level, node) gives."""
    return topological_levels(edges).orderBy("level", "node")


def dependency_order(edges: DataFrame, components: DataFrame) -> DataFrame:
    """node, position: every node behind all that it depends on (dst before src), nodes of one cycle together, the largest of
    them first.

    The order is by the longest way down to a node that depends on nothing, then by component; it is given by ranges, so no task and no group sees the whole graph. Of the valid orders it is not the depth-first one, which is
    :func:`dependency_first` for graphs that fit into one task each.
    """
    from spindrift.operators.relational import numbered

    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    levels = component_levels(turned, components).withColumnRenamed("node", "component")
    return numbered(components.select("node", "component").join(levels, "component"), [F.col("level"), F.col("component"), F.desc("node")]).select("node", "position")


def dependency_first(edges: DataFrame, group: str = "graph") -> DataFrame:
    """group, node, position: depth-first order with dependencies (dst) before dependents (src), for each group.

    Roots, on which nothing depends, and dependencies are taken in ascending order; nodes that no root reaches follow.
    A group is one graph (one repository) and is walked in one task. A self edge only adds its node.
    """
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for src, dst in zip(pdf["src"], pdf["dst"], strict=True):
            after.setdefault(src, set()).add(dst)
            after.setdefault(dst, set())
        depended = {d for n, v in after.items() for d in v if d != n}
        seen, order = set(), []
        for root in [*sorted(n for n in after if n not in depended), *sorted(after)]:
            stack = [(root, None)]
            while stack:
                node, rest = stack.pop()
                if rest is None:
                    if node in seen:
                        continue
                    seen.add(node)
                    rest = iter(sorted(after[node]))
                for child in rest:
                    if child not in seen:
                        stack.append((node, rest))
                        stack.append((child, None))
                        break
                else:
                    order.append(node)
        return pd.DataFrame({group: pdf[group].iloc[0], "node": order, "position": range(len(order))})

    kind = dict(edges.dtypes)
    return edges.groupBy(group).applyInPandas(walk, f"{group} {kind[group]}, node {kind['src']}, position long")


def reach(edges: DataFrame, roots: DataFrame, depth: int, down: bool = True) -> DataFrame:
    """root, src, dst, depth: edges met from each root (column root) in breadth-first order within depth steps.

    An edge counts at the depth at which it is first walked; nodes are expanded once for each root.
    """
    rounds = Rounds(edges.sparkSession)
    if depth < 1:
        return edges.select(F.col("src").alias("root"), "src", "dst", F.lit(0).alias("depth")).limit(0)
    step = edges.select("src", "dst") if down else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = frontier = rounds.keep(roots.select("root", F.col("root").alias("node")).distinct())
    found = None
    for d in range(1, depth + 1):
        walked = rounds.keep(frontier.join(step.withColumnRenamed("src", "node"), "node").select("root", F.col("node").alias("src"), "dst", F.lit(d).alias("depth")).distinct())
        found = walked if found is None else found.unionByName(walked)
        frontier = rounds.keep(walked.select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti"))
        seen = rounds.keep(seen.unionByName(frontier))
    if not down:
        found = found.select("root", F.col("dst").alias("src"), F.col("src").alias("dst"), "depth")
    return found


def type_distribution(components: DataFrame) -> DataFrame:
    """One row: total, oop_count, func_count and their ratios (0 without components)."""
    out = components.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind").isin(*OOP)).alias("oop_count"), F.count_if(F.col("kind").isin(*FUNCTIONS)).alias("func_count"))
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    return out.withColumn("oop_ratio", ratio("oop_count")).withColumn("func_ratio", ratio("func_count"))


def includes_functions(distribution: DataFrame) -> DataFrame:
    """One row: whether functions are valid types too (no classes, few among many functions, or hardly any)."""
    few = (F.col("oop_ratio") < 0.1) & (F.col("func_count") > 20)
    hardly = (F.col("oop_count") < 5) & (F.col("func_count") > 50)
    return distribution.select(((F.col("oop_count") == 0) | few | hardly).alias("with_functions"))


def importance(components: DataFrame, edges: DataFrame) -> DataFrame:
    """id, importance 0 to 100: use by others, entry names, documentation, length and kind.

    components: id, name, kind, has_docstring, lines.
    """
    used = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("used_by"))
    c = components.join(used, "id", "left")
    score = (
        F.least(F.coalesce("used_by", F.lit(0)) * 5, F.lit(30))
        + F.when(F.col("name").isin(*ENTRY_NAMES), 20).when(~F.col("name").startswith("_"), 10).otherwise(0)
        + F.when(F.col("has_docstring"), 15).otherwise(0)
        + F.when(F.col("lines").between(10, 200), 10).when(F.col("lines").between(5, 9), 5).otherwise(0)
        + F.when(F.col("kind").isin("class", "interface"), 10).when(F.col("kind").isin("struct", "enum"), 5).otherwise(0)
    )
    return c.select("id", F.least(score, F.lit(100)).cast("long").alias("importance"))


def allowed_names(components: DataFrame) -> DataFrame:
    """Components whose identifier does not speak of failure; classes may speak of exceptions."""
    low = F.lower("name")
    bad = low.rlike("|".join(BAD_PARTS))
    return components.where(~bad | (low.contains(EXEMPT_PART) & (F.col("kind") == "class")))


def leaf_nodes(components: DataFrame, edges: DataFrame, limit: int = LEAF_LIMIT) -> DataFrame:
    """id, importance of the leaves: valid types with allowed names; where they reach the limit, those on which nothing
    depends; where these do, the most important ones."""
    functions = includes_functions(type_distribution(components))
    typed = allowed_names(components).crossJoin(F.broadcast(functions))  # one row
    typed = typed.where(F.col("kind").isin(*VALID) | (F.col("with_functions") & F.col("kind").isin(*ADDED))).drop("with_functions")
    scored = importance(typed, edges).withColumnRenamed("importance", "score")
    if scored.limit(limit).count() < limit:
        return scored.select("id", F.col("score").alias("importance"))
    free = scored.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    if free.limit(limit).count() >= limit:
        free = free.orderBy(F.desc("score"), "id").limit(limit)
    return free.select("id", F.col("score").alias("importance"))


def final_leaves(leaves: DataFrame, components: DataFrame) -> DataFrame:
    """Leaves after the second filter: not blank, no failure in the name at all, and of the kinds class, interface or
    struct, or functions where there is none of these."""
    kept = leaves.join(components.select("id", "name", "kind"), "id").where((F.trim("name") != "") & ~F.lower("name").rlike("|".join(BAD_PARTS)))
    kinds = ("class", "interface", "struct")
    has = components.agg(F.coalesce(F.max(F.col("kind").isin(*kinds)), F.lit(False)).alias("has"))
    return kept.crossJoin(F.broadcast(has)).where(F.col("kind").isin(*kinds) | (~F.col("has") & (F.col("kind") == "function"))).select("id", "kind")


def dependency_info(module: DataFrame, edges: DataFrame) -> DataFrame:
    """For each component (id) of a module: internal, external and used_by counts, and is_core (used by two or more and
    with at most one dependency)."""
    ids = module.select("id")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("inside")), "dst", "left")
    deps = out.groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("inside")).alias("internal"), F.count_if(F.col("inside").isNull()).alias("external"))
    used = out.where("inside").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("used_by"))
    full = ids.join(deps, "id", "left").join(used, "id", "left").na.fill(0)
    return full.withColumn("is_core", (F.col("used_by") >= 2) & (F.col("internal") + F.col("external") <= 1))


def cluster_density(members: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, n, density: edges within a cluster over n (n - 1); 1 for a single member. members: cluster, id."""
    inside = edges.join(members.select(F.col("id").alias("src"), "cluster"), "src").join(members.select(F.col("id").alias("dst"), F.col("cluster").alias("c2")), "dst").where("cluster = c2").groupBy("cluster").agg(F.count(F.lit(1)).alias("inside"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(inside, "cluster", "left")
    density = F.when(F.col("n") <= 1, 1.0).otherwise(F.coalesce("inside", F.lit(0)) / (F.col("n") * (F.col("n") - 1)))
    return sizes.select("cluster", "n", F.round(density, 3).alias("density"))


def graph_export(components: DataFrame, edges: DataFrame) -> DataFrame:
    """JSON elements of nodes (with a class for their kind) and edges of a graph view."""
    nodes = components.select(F.lit("node").alias("group"), F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("name").alias("label"), F.concat(F.lit("node-"), "kind").alias("classes"))).alias("element"))
    links = edges.select(F.lit("edge").alias("group"), F.to_json(F.struct(F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")).alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"))).alias("element"))
    return nodes.unionByName(links)


def call_summary(components: DataFrame, edges: DataFrame) -> DataFrame:
    """For each component the sorted names that it calls and is called by, and whether it calls itself."""
    names = components.select("id", "name")
    both = edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    calls = both.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst_name")).alias("calls"), F.max(F.col("src") == F.col("dst")).alias("is_recursive"))
    called = both.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src_name")).alias("called_by"))
    empty = F.array().cast("array<string>")
    out = components.join(calls, "id", "left").join(called, "id", "left")
    return out.select("id", "name", F.coalesce("calls", empty).alias("calls"), F.coalesce("called_by", empty).alias("called_by"), F.coalesce("is_recursive", F.lit(False)).alias("is_recursive"))
