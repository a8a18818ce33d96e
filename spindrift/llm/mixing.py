"""Mixing sources to target weights by weighted fair queueing.

The documents of each source stand in a shuffled order (by a digest of their id, so that reruns agree) and are served in
packets of at most ``PACKET`` words, ``PASSES`` times over. A packet's virtual finish time is the number of words of its
source up to its end, divided by the source's weight. All packets are sorted by it over all sources, by ranges, and the
order is truncated where its words reach the budget; the packet that crosses it is cut. A source of weight 3 so is three
times as far as one of weight 1 at any place of the mix, and a source that has been served ``PASSES`` times leaves its
share to the others, by weight: nothing else decides what is taken.

``target`` says what this comes to: the budget is shared by weight, no source has more than ``PASSES`` times its size, and
the excess is shared again until none is above. It is found from running sums over the sources, sorted by the level at
which each is used up. What a source gives differs from its target by a packet or two.

No source is in one task: cumulative words of a source are running sums over ranges, and of the global order only the
range that holds the end is summed row by row.

Defined cases: sources are weighted in the order of their code points, a null source last, an empty one as any other; null
text has size 0, and documents of size 0 are never taken; a null id counts as the largest; rows that repeat an id, a
source and a size are interchangeable, one of them may be taken more often than another; an empty table and one without a
word give no packets and targets of 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.common import NO_ID, Scratch, back_id, hinted
from spindrift.operators import prefix
from spindrift.operators.relational import numbered

#: Weights of the sources, repeating; share of all words that the mix takes; how often a document is taken at most.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Words of one packet.
PACKET = 64
_SPACE = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Maximal runs of what is not white space."""
    inner = F.btrim(text, F.lit(_SPACE))
    return F.when(F.coalesce(inner, F.lit("")) == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def shuffled(doc_id: Column) -> Column:
    """A document's place in the shuffled order: 60 bits of the MD5 of its id."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, size of each row, as a written table."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    return Scratch(docs.sparkSession).keep("sizes", rows.withColumn("uid", F.monotonically_increasing_id()))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """rank, source, source_size, weight, target of each source, as a written table.

    A source is used up at the level ``cap / weight``; at the level of one source, those before it give their caps and those
    behind it their weight times the level. Sources whose level is reached within the budget give their caps, and what is
    left is shared by the weights of the others.
    """
    scratch = Scratch(sized.sparkSession)
    sources = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(passes))
    sources = scratch.keep("sources", sources.withColumn("level", F.col("cap") / F.col("weight")))
    words, all_weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (words or 0)
    below = prefix.running_sums(sources, {"caps": F.col("cap"), "weights": F.col("weight")}, ["level", "rank"])
    full = below.where(F.col("caps") + F.col("level") * (F.lit(all_weights) - F.col("weights")) <= F.lit(budget))
    last = full.agg(F.max("level"), F.sum("cap"), F.sum("weight")).first()  # one row
    used_up, given, gone = (x or 0 for x in last) if last[0] is not None else (-1.0, 0, 0)
    rest = (all_weights or 0) - gone
    level = (budget - given) / rest if rest > 0 else 0.0
    target = F.when(F.col("level") <= F.lit(float(used_up)), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))))
    return scratch.keep("targets", sources.select("rank", "source", "source_size", "weight", target.alias("target")))


def queue(sized: DataFrame, sources: DataFrame, passes: int = PASSES, packet: int = PACKET) -> DataFrame:
    """finish, rank, served, uid, pass, start, words: every packet with its virtual finish time.

    served is the words of the source up to the packet's end, start the packet's first word in its document.
    """
    own = sources.select(F.col("source").alias("_source"), "rank", "source_size", "weight")
    docs = sized.where("size > 0").join(hinted(own, 64), F.col("source").eqNullSafe(F.col("_source"))).withColumn("place", shuffled(F.col("doc_id")))
    docs = prefix.running_sums(docs.select("uid", "doc_id", "place", "size", "rank", "source_size", "weight"), {"upto": F.col("size")}, ["place", "doc_id", "size", "uid"], ["rank"])
    rounds = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    pieces = rounds.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))).alias("start"))
    words = F.least(F.lit(packet), F.col("size") - F.col("start"))
    served = F.col("pass") * F.col("source_size") + F.col("upto") - F.col("size") + F.col("start") + words
    return pieces.select((served / F.col("weight")).alias("finish"), "rank", served.alias("served"), "uid", "pass", "start", words.alias("words"))


def mixture(packets: DataFrame, budget: int) -> DataFrame:
    """The packets in the order of their finish times, up to the budget; ``words`` of the last may be cut. Columns of queue
    and the range; within a range rows are sorted."""
    order = ["finish", "rank", "served"]
    placed = prefix.ranged(packets, order)
    ranges = Scratch(packets.sparkSession).keep("ranges", prefix.before_ranges(placed, {"words": F.col("words")}))
    reached = ranges.where((F.col("_before_words") < budget) & (F.col("_before_words") + F.col("_own_words") >= budget)).first()  # one range
    if reached is None:
        return placed if budget > 0 else placed.limit(0)
    at, before = reached[prefix.RANGE], reached["_before_words"]
    end = placed.where(F.col(prefix.RANGE) == at)
    upto = F.sum("words").over(W.partitionBy(prefix.RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    end = end.withColumn("_left", F.lit(budget - before) + F.col("words") - upto)
    end = end.where("_left > 0").withColumn("words", F.least("words", "_left")).drop("_left")
    return placed.where(F.col(prefix.RANGE) < at).unionByName(end)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, packet: int = PACKET) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, one row for each row of docs; taken counts repeated words."""
    scratch = Scratch(docs.sparkSession)
    sized = sizes(docs)
    sources = targets(sized, weights, share, passes)
    budget = int(share * (sized.agg(F.sum("size")).first()[0] or 0))
    taken = mixture(queue(sized, sources, passes, packet), budget).groupBy("uid").agg(F.sum("words").alias("taken"))
    taken = scratch.keep("taken", taken)
    own = sources.select(F.col("source").alias("_source"), "source_size", "target")
    out = sized.join(hinted(own, 64), F.col("source").eqNullSafe(F.col("_source"))).join(taken, "uid", "left")
    return out.select(back_id(), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
