"""Joins, aggregates, ranked picks and budgets over repository tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators.graph import Rounds
from spindrift.operators.prefix import running_sums


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order; equal keys keep one row (a stable dedup)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_k(df: DataFrame, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of a total order with their rank; sorts k rows, not the table."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank, F.row_number().over(W.orderBy(*order)))


def top_k_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; the engine limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def budget_prefix(df: DataFrame, tokens: Column, order: list[str], budget: int, keys: list[str] | None = None) -> DataFrame:
    """Rows in ascending order while the running sum of tokens, which are not negative, stays within the budget.

    With keys, for each key, by running sums over sorted ranges, so that a key with most of the rows spans many tasks.
    Without, only the first budget + 1 rows that have tokens can matter, so these are taken first and the running sum
    never sees the whole table; rows without tokens, of which there may be many, look up the sum before them in these.
    """
    if keys:
        return running_sums(df, {"running_tokens": tokens}, order, keys).where(F.col("running_tokens") <= budget)
    one = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    head = df.where(tokens > 0).orderBy(*order).limit(budget + 1).withColumn("running_tokens", F.sum(tokens).over(one))
    sums = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), "running_tokens")))
    steps = head.agg(sums.alias("_steps"))  # one row
    free = df.where(~F.coalesce(tokens > 0, F.lit(False))).crossJoin(F.broadcast(steps))
    before = F.filter("_steps", lambda x: x["at"] < F.struct(*order))
    running = F.coalesce(F.try_element_at(before, F.lit(-1))["running_tokens"], F.lit(0))
    free = free.withColumn("running_tokens", running).drop("_steps")
    return head.unionByName(free).where(F.col("running_tokens") <= budget)


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """df with its place, from 1, in a total order. No task sees all rows: they are sorted by ranges and written, and each
    range starts behind the rows of those before it, of which only the counts are collected (one for each partition)."""
    placed = Rounds(df.sparkSession).keep(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    starts, before = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["part"], before))
        before += r["n"]
    ranges = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    out = placed.withColumn("_part", part).join(F.broadcast(ranges), "_part")  # a row for each partition
    return out.withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_start", "_place")


def usage_summary(usage: DataFrame) -> DataFrame:
    """Totals and estimated totals over all rows and for each kind, in one pass; no rows give zeros."""
    sums = [F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(F.when(F.col("is_estimated"), F.col("total_tokens"))), F.lit(0)).alias("estimated_tokens")]
    for kind in ("llm", "embedding"):
        own = F.col("kind") == kind
        sums.append(F.coalesce(F.sum(F.when(own, F.col("total_tokens"))), F.lit(0)).alias(f"{kind}_tokens"))
        sums.append(F.coalesce(F.sum(F.when(own & F.col("is_estimated"), F.col("total_tokens"))), F.lit(0)).alias(f"{kind}_estimated"))
    return usage.agg(*sums)


def usage_by_repo(repos: DataFrame, usage: DataFrame, preferred: str) -> DataFrame:
    """repo_id, tokens: of the preferred source for every repo if any row has it, of all sources otherwise; 0 if none."""
    sums = usage.groupBy("repo_id").agg(F.sum("total_tokens").alias("every"), F.sum(F.when(F.col("source") == preferred, F.col("total_tokens"))).alias("own"), F.max(F.col("source") == preferred).alias("has"))
    switch = usage.agg(F.coalesce(F.max(F.col("source") == preferred), F.lit(False)).alias("switch"))
    out = repos.join(sums, "repo_id", "left").crossJoin(F.broadcast(switch))  # the switch is one row
    return out.select("repo_id", F.coalesce(F.when(F.col("switch"), F.col("own")).otherwise(F.col("every")), F.lit(0)).alias("tokens"))


def repo_overview(repos: DataFrame, users: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """Repos with their owner's name and the number of rows that each of counts (keyed by repo_id) has for them."""
    out = repos.join(users, "owner_id", "left")
    for name, df in counts.items():
        out = out.join(df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name)), "repo_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def lift_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbol edges (src, dst, edge_type, pos) as file edges: both ends known, different files, one row for a pair of
    files with the edge type that comes last."""
    of = symbols.select("id", "file_path")
    both = edges.join(of.select(F.col("id").alias("src"), F.col("file_path").alias("src_path")), "src").join(of.select(F.col("id").alias("dst"), F.col("file_path").alias("dst_path")), "dst")
    both = both.where("src_path <> dst_path")
    return both.groupBy("src_path", "dst_path").agg(F.max_by("edge_type", F.struct("pos", "src", "dst")).alias("edge_type"))


def module_edges(file_edges: DataFrame, modules: DataFrame) -> DataFrame:
    """src_module, dst_module, n over edges between files of different modules. modules: module, path."""
    src = modules.select(F.col("path").alias("src_path"), F.col("module").alias("src_module"))
    dst = modules.select(F.col("path").alias("dst_path"), F.col("module").alias("dst_module"))
    return file_edges.join(src, "src_path").join(dst, "dst_path").where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("n"))


def suffix_matches(changed: DataFrame, module_files: DataFrame) -> DataFrame:
    """Distinct modules with a file whose path (lower case, forward slashes) ends in a changed path.

    A suffix of a path at a slash is looked up by equality; other suffixes (in the middle of a name) need the ends of
    equal length, so changed paths are grouped by their few lengths and compared by ``right``.
    """
    tidy = lambda c: F.lower(F.translate(F.col(c), "\\", "/"))
    wanted = changed.select(tidy("path").alias("tail")).distinct().withColumn("n", F.length("tail"))
    lengths = F.broadcast(wanted.select("n").distinct())  # at most as many rows as a path has characters
    ends = module_files.select("module", tidy("path").alias("p")).crossJoin(lengths).where("length(p) >= n").select("module", "n", F.expr("right(p, n)").alias("tail"))
    return ends.join(wanted, ["n", "tail"], "left_semi").select("module").distinct()


def prefixes(path: Column) -> Column:
    """All directories above a path, the root as an empty string first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def longest_prefix(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """path, prefix: the deepest module (column prefix) that is the path or a directory above it, else empty."""
    candidates = paths.select("path", F.explode(F.array_union(prefixes(F.col("path")), F.array("path"))).alias("prefix"))
    found = candidates.join(modules.select("prefix").distinct(), "prefix").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return paths.select("path").join(found, "path", "left").select("path", F.coalesce("prefix", F.lit("")).alias("prefix"))


def resolve_callees(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """calls with the id that their callee resolves to, and is_resolved.

    functions: id, name, pos. A key of the lookup is an id, a name or an id's last segment. An id or a name that is
    defined later wins over an earlier one; a last segment only counts where nothing earlier holds the key. A callee
    that is no key is looked up by its own last segment.
    """
    last = F.substring_index("id", ".", -1)
    named = functions.select(F.col("id").alias("key"), "id", "pos", F.lit(0).alias("step")).unionByName(functions.select(F.col("name").alias("key"), "id", "pos", F.lit(1).alias("step")))
    named = named.groupBy("key").agg(F.max_by("id", F.struct("pos", "step")).alias("id"))
    tails = functions.select(last.alias("key"), "id", "pos").groupBy("key").agg(F.min_by("id", "pos").alias("id"))
    lookup = named.unionByName(tails.join(named, "key", "left_anti"))
    direct = lookup.select(F.col("key").alias("callee"), F.col("id").alias("direct"))
    by_tail = lookup.select(F.col("key").alias("_tail"), F.col("id").alias("by_tail"))
    tail = F.when(F.col("callee").contains("."), F.substring_index("callee", ".", -1))
    out = calls.join(direct, "callee", "left").withColumn("_tail", tail).join(by_tail, "_tail", "left")
    found = F.coalesce("direct", "by_tail")
    return out.select("caller", "callee", F.coalesce(found, "callee").alias("target"), found.isNotNull().alias("is_resolved"))


def reuse_vectors(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """chunks with the cached vector where id and text are equal, and to_embed where none is."""
    return chunks.join(cached.select("id", "text", "vector"), ["id", "text"], "left").withColumn("to_embed", F.col("vector").isNull())


def overlay_progress(repos: DataFrame, running: DataFrame) -> DataFrame:
    """repos with the state of running jobs laid over; running rows win column by column."""
    new = running.select("repo_id", F.col("status").alias("_status"), F.col("progress").alias("_progress"))
    out = repos.join(new, "repo_id", "left")
    return out.select("repo_id", F.coalesce("_status", "status").alias("status"), F.coalesce("_progress", "progress").alias("progress"), F.col("_status").isNotNull().alias("is_running"))


def complexity(symbols: DataFrame) -> DataFrame:
    """file_path, complexity: class 10, function 3, method 2."""
    score = F.when(F.col("kind") == "class", 10).when(F.col("kind") == "function", 3).when(F.col("kind") == "method", 2).otherwise(0)
    return symbols.groupBy("file_path").agg(F.sum(score).cast("long").alias("complexity"))


def difficulty(complexity: Column) -> Column:
    return F.when(complexity < 15, "beginner").when(complexity < 40, "intermediate").otherwise("advanced")


def citation_map(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """module, citations: the locations of the symbols (id) that each module lists (symbol_ids), in list order."""
    listed = modules.select("module", F.posexplode("symbol_ids").alias("pos", "id"))
    place = F.struct("pos", "file_path", "name", "line_start", "line_end")
    return listed.join(symbols, "id").groupBy("module").agg(F.array_sort(F.collect_list(place)).alias("citations"))
