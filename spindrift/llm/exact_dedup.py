"""Exact duplicates by deterministic block naming.

A text is cut into blocks of ``block_bytes``. The distinct blocks of the whole corpus are sorted and numbered, which
gives each block an integer name; equal names mean equal bytes, as the names come from comparing contents and not from
a hash. The order is by partition, hash and content: a total one, the same for the same corpus and number of partitions,
and it saves the second move of all text that an order by content alone would take, as the distinct blocks are there. Then the names of adjacent blocks are paired, the distinct pairs are numbered again, and so on, until each
document has one name: its identity. A document of n blocks needs ceil(log2 n) rounds, and a round only holds the
documents that still have more than one name.

Only the first round moves text, and each distinct block crosses the network once per map task at most (partial
aggregation), so a block that a third of the documents share is no hot key. Later rounds move three integers a block.

Defined cases: null text is empty, and empty texts are equal to each other; a null id counts as the largest; of rows
that repeat both id and text each gets ``kept`` by its id alone, so both are kept (``exact_dedup_documents`` drops
the repetition); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, back_id, hinted, one_of_each, row_texts, texts, with_rows

#: Most documents are one block; it bounds what a row of the first shuffle holds.
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _named(rows: DataFrame, *content: str) -> DataFrame:
    """Distinct rows with integer names: their place in the sorted order of their partition, partitions in order."""
    return rows.select(*content).distinct().sortWithinPartitions(*content).withColumn("name", F.monotonically_increasing_id())


def block_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_sha256, depth, name, one row for each row of docs: (depth, name) is the identity of its text.

    Identities are equal exactly where the normalised texts are.
    """
    scratch = Scratch(docs.sparkSession)
    rows = texts(docs).select("doc_id", F.encode(normalised(F.col("text")), "UTF-8").alias("bytes"))
    n = F.greatest(F.lit(1), F.ceil(F.length("bytes") / F.lit(block_bytes))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("bytes"), i * F.lit(block_bytes) + 1, F.lit(block_bytes)))
    # uid tells repeated rows apart; it is given before rows are cut, as it counts rows where it is evaluated.
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "bytes", n.alias("n_blocks"))
    cut = rows.select("uid", "doc_id", F.sha2("bytes", 256).alias("text_sha256"), "n_blocks", F.posexplode(blocks).alias("at", "block"))
    # The key sorts blocks and finds their names again; the naming itself compares contents.
    cut = cut.withColumn("key", F.xxhash64("block"))
    places = scratch.keep("places", cut.select("uid", "doc_id", "text_sha256", "n_blocks", "at", "key"))
    names = scratch.keep("names", _named(cut, "key", "block").select("key", "name"))
    columns = ["uid", "doc_id", "text_sha256", "n_blocks", "at", "name"]
    if names.groupBy("key").count().where("count > 1").limit(1).count():
        # Two contents under one key: the names are found again by content.
        level = cut.join(_named(cut, "key", "block"), ["key", "block"]).select(*columns)
    else:
        level = places.join(names, "key").select(*columns)
    level = scratch.keep("level0", level)
    depth, done = 0, [level.where("n_blocks = 1").select("doc_id", "text_sha256", F.lit(0).alias("depth"), "name")]
    more = level.where("n_blocks > 1")
    while more.limit(1).count():
        depth += 1
        even = F.col("at") % 2 == 0
        pairs = more.groupBy("uid", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
            F.first("doc_id").alias("doc_id"),
            F.first("text_sha256").alias("text_sha256"),
            F.first("n_blocks").alias("n_blocks"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = scratch.keep(f"pairs{depth}", pairs)
        names = scratch.keep(f"names{depth}", _named(pairs, "left", "right"))
        level = pairs.join(names, ["left", "right"]).withColumn("n_blocks", F.ceil(F.col("n_blocks") / 2).cast("int"))
        level = scratch.keep(f"level{depth}", level.select(*columns))
        done.append(level.where("n_blocks = 1").select("doc_id", "text_sha256", F.lit(depth).alias("depth"), "name"))
        more = level.where("n_blocks > 1")
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The smallest id of a group stays."""
    scratch = Scratch(docs.sparkSession)
    ids = scratch.keep("identities", block_identities(docs, block_bytes))
    groups = ids.groupBy("depth", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    out = ids.join(hinted(scratch.keep("groups", groups), 32), ["depth", "name"], "left")
    out = out.withColumn("keep_id", F.coalesce("keep_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    return out.select(back_id(), back_id("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that equal one with a smaller id, and without repeated rows; columns as they were.

    Rows are judged one by one: of equal texts one row stays, and an id that rows share, or lack, drops no other text.
    """
    rows, name = with_rows(docs)
    copies = exact_dedup(row_texts(rows, name), block_bytes).where("group_size > 1")
    return one_of_each(rows, name, copies.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")))
