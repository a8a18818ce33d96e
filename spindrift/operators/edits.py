"""File edits as tables: a batch of edits on files, with the history that undoes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines around a change that are shown with it.
AROUND = 4


def occurrences(text: Column, part: Column) -> Column:
    """How often a part, which is not empty, occurs in a text without overlaps."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")


def numbered_view(text: Column, first: Column, last: Column) -> Column:
    """The lines first to last (1-based; -1 is the end) of a text with their numbers; null for a range that is none."""
    lines = F.split(text, "\n", -1)
    end = F.when(last == -1, F.size(lines)).otherwise(last)
    ok = (first >= 1) & (first <= F.size(lines)) & (end <= F.size(lines)) & (end >= first)
    piece = F.slice(lines, F.when(ok, first).otherwise(1), F.when(ok, end - first + 1).otherwise(0))
    shown = F.transform(piece, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 6, " "), F.lit("\t"), x))
    return F.when(ok, F.array_join(shown, "\n"))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, command, ok, message, content (after), before of each edit.

    files: path, content. edits: path, command (create, view, str_replace, insert), file_text, old_str, new_str,
    insert_line, view_first, view_last; one for each path. A replacement needs its old text exactly once, an insertion a
    line between 0 and the last one, a creation a path that is new, all others one that is there. What fails, or only
    looks, leaves the content as it is; a view's text is its message.
    """
    joined = edits.join(files.select("path", F.col("content").alias("before")), "path", "left")
    there, command = F.col("before").isNotNull(), F.col("command")
    lines = F.split("before", "\n", -1)
    n = occurrences(F.col("before"), F.col("old_str"))
    new = F.coalesce("new_str", F.lit(""))
    at = F.coalesce("insert_line", F.lit(-1))
    inside = at.between(0, F.size(lines))
    inserted = F.array_join(F.concat(F.slice(lines, F.lit(1), F.when(inside, at).otherwise(0)), F.split(new, "\n", -1), F.slice(lines, F.when(inside, at + 1).otherwise(1), F.size(lines))), "\n")
    view = numbered_view(F.col("before"), F.coalesce("view_first", F.lit(1)), F.coalesce("view_last", F.lit(-1)))
    content = F.when((command == "create") & ~there, F.coalesce("file_text", F.lit("")))
    content = content.when((command == "str_replace") & (n == 1), F.replace("before", "old_str", new)).when((command == "insert") & there & inside, inserted)
    message = (
        F.when((command == "create") & there, "the file exists already").when((command != "create") & ~there, "there is no such file")
        .when((command == "str_replace") & (n == 0), "the old text does not occur").when((command == "str_replace") & (n > 1), F.format_string("the old text occurs %d times", n))
        .when((command == "insert") & ~inside, F.format_string("there is no line %d to insert after", at)).when((command == "view") & view.isNull(), "there are no such lines")
        .when(~command.isin("create", "view", "str_replace", "insert"), "no such command")
    )
    out = joined.select("path", "command", message.isNull().alias("ok"), F.when(message.isNull() & (command == "view"), view).otherwise(message).alias("message"), F.coalesce(content, "before").alias("content"), "before")
    return out


def written(files: DataFrame, applied: DataFrame) -> DataFrame:
    """path, content of the files after the edits."""
    changed = applied.where(F.col("ok") & (F.col("command") != "view")).select("path", "content")
    return files.select("path", "content").join(changed.select("path"), "path", "left_anti").unionByName(changed)


def history(old: DataFrame, applied: DataFrame) -> DataFrame:
    """path, seq, content: the history with what the edits replaced on top; a created file starts with its own text."""
    last = old.groupBy("path").agg(F.max("seq").alias("_last"))
    kept = applied.where(F.col("ok") & (F.col("command") != "view")).select("path", F.coalesce("before", "content").alias("content"))
    new = kept.join(last, "path", "left").select("path", (F.coalesce("_last", F.lit(0)) + 1).cast("int").alias("seq"), "content")
    return old.select("path", "seq", "content").unionByName(new)


def undo(files: DataFrame, past: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and history after the last edit of each of the paths was undone; a path without history stays."""
    newest = past.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("seq")))).where("_n = 1").join(paths.select("path").distinct(), "path", "left_semi")
    back = newest.select("path", F.col("content").alias("_old"))
    out = files.join(back, "path", "left").select("path", F.coalesce("_old", "content").alias("content"))
    return out, past.join(newest.select("path", "seq"), ["path", "seq"], "left_anti")


def snippet(before: Column, after: Column, around: int = AROUND) -> Column:
    """The lines of a text after an edit around the first one that differs, and as many behind the change."""
    a, b = F.split(before, "\n", -1), F.split(after, "\n", -1)
    same = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int") - 1
    start = F.greatest(F.lit(1), same + 1 - around)
    return F.array_join(F.slice(b, start, same + around + F.greatest(F.lit(0), F.size(b) - F.size(a)) - start + 2), "\n")
