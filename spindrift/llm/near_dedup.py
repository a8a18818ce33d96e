"""Near duplicates by HyperMinHash.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Its sketch has ``REGISTERS`` buckets; a shingle's
hash picks a bucket, and the least value there is stored as its number of leading zeros and ten bits of mantissa, two
bytes a bucket. Buckets that are empty are filled from further hash rounds, and in the end each by a hash function of
its own, so that a sketch of a short text has the same law as that of a long one.

1. Documents with equal sets form a class at once; what follows sees one representative of each.
2. The registers are cut into ``BANDS`` bands, and equal bands make candidates. At a similarity of 0.75 a pair
   shares no band with a probability of 5e-6. In each band the documents are paired with one pivot, never all with
   all; every band draws its own pivot, so a document of a large group meets several.
3. For a pair, equal registers, corrected for the chance that different minima look alike, estimate the similarity.
   Pairs within ``MARGIN`` (five standard errors) of the threshold and above are confirmed on the full sets.
4. Confirmed links give components. Step 2 is repeated with other pivots for the bands that hold several components.
   Then each band that still does is taken again: the members outside its largest component are compared with each other
   and with that component, never the latter with itself, in blocks of bounded size; pairs are confirmed where they meet,
   and only links leave a block. Pairs within a component need no link. Where more than ``WIDE`` members are outside, the
   work would grow with their square, so first only those members stay that can have a link to another component at all:
   shingles that occur in one component only are in no such intersection, so a document with more than a quarter of them
   has none, and this is repeated while it drops members. A crowd of documents that share half of their text, say, ends
   here, by counts of shingles and without a pair.

No band, block or class has a cap. Counts and minima are combined on the map side; components are joins. Sets are only
built again for the documents of candidate pairs and of wide bands.

Defined cases: null text and text without words is an empty set, linked with nothing; fewer than five words are one
shingle; a null id counts as the largest; repeated rows share an id and so a component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, back_id, hinted, map_batches, one_of_each, row_texts, small_batches, texts, utf8, with_rows
from spindrift.llm.components import stars as components

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
REGISTERS, BANDS, MANTISSA = 128, 32, 10
#: Shares of registers below the threshold down to which pairs are confirmed on their sets.
MARGIN = 0.2
#: Turns of step 2, each with other pivots.
STARS = 2
#: Documents of one block in step 4, and shingles of all of them: what a task holds is bounded by both.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Members of a band outside its largest component up to which they are paired without a count of their shingles.
WIDE = 128
#: Members are filtered again while a turn leaves less than this share of them.
TURN = 0.9
#: Word hashes that a worker remembers.
CACHE_WORDS = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_ROUNDS = 6
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, _ROUNDS + REGISTERS, np.int64).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, known: _Hashes, size: int = WORDS) -> np.ndarray:
    """Distinct hashes of the shingles of a text, sorted."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(codes))
    out = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _P + codes[i : i + len(out)]
    return np.unique(mix(out))


def _compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros (of 57 bits) and mantissa of register values, in 16 bits."""
    fraction, exponent = np.frexp(values.astype(np.float64))
    return ((57 - np.clip(exponent, 0, 57)).astype(np.uint16) << np.uint16(MANTISSA)) | np.clip((fraction - 0.5) * (2 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)


def sketch(found: np.ndarray) -> bytes:
    """The registers of a set of hashes, which must not be empty."""
    out, filled = np.zeros(REGISTERS, np.uint64), np.zeros(REGISTERS, bool)
    shift, low = np.uint64(57), np.uint64((1 << 57) - 1)
    for seed in _SEEDS[:_ROUNDS]:
        x = mix(found ^ seed)
        x.sort()
        bucket = (x >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        new = first[~filled[bucket[first]]]
        out[bucket[new]] = x[new] & low
        filled[bucket[new]] = True
        if filled.all():
            break
    else:
        for k in np.flatnonzero(~filled):
            out[k] = (mix(found ^ _SEEDS[_ROUNDS + k]) & low).min()
    return _compress(out).tobytes()


def collision_rate() -> float:
    """Probability that two different random minima have the same register: sum over leading zeros of the squared
    probability of each, over the mantissa's values."""
    return sum(0.25 ** (z + 1) for z in range(57)) / (1 << MANTISSA)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, corrected for collisions."""
    share, chance = equal / REGISTERS, collision_rate()
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _sketches(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            out = []
            for text in utf8(batch.column(1)):
                found = shingles(text, known)
                if len(found):
                    out.append((len(found), int(mix(found ^ _P).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(found + _P)).view(np.int64)), sketch(found)))
                else:
                    out.append((0, 0, 0, b""))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], ["doc_id", "n", "s1", "s2", "registers"])

    return map_batches(rows, run, "doc_id long, n long, s1 long, s2 long, registers binary")


def _near(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, ra, rb) whose estimate is within the margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3)]
            ok = estimate((sides[0] == sides[1]).sum(1)) >= PERCENT / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    small_batches(pairs.sparkSession)
    return pairs.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _confirmed(rows: DataFrame, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose full sets are similar enough, as a written table."""
    ids = scratch.keep(f"{name}_ids", pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = _sets(rows, ids)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return scratch.keep(name, both.where(100 * F.col("common") >= PERCENT * (F.col("total") - F.col("common"))).select("a", "b"))


def _sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, items: the full sets of some documents, built again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, known).view(np.int64) for t in utf8(batch.column(1))], pa.list_(pa.int64()))], ["doc_id", "items"])

    return map_batches(rows.join(hinted(ids, 16), "doc_id"), run, "doc_id long, items array<long>")


def _by_blocks(members: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn over the rows of each pair of blocks (key, i, j), which come to it one after another from sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in ("key", "i", "j")]
            changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for a, b in pairwise([0, *changes.tolist(), batch.num_rows]):
                if a == b:
                    continue
                now = tuple(k[a] for k in keys)
                if held and now != last:
                    yield from fn(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()

    small_batches(members.sparkSession)
    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _views(lists: pa.ChunkedArray) -> Callable[[int], np.ndarray]:
    """The numbers of a list column by place, as views of what Arrow holds; nothing is copied or turned into objects."""
    ends = np.cumsum([len(chunk) for chunk in lists.chunks])
    offsets, values = [chunk.offsets.to_numpy() for chunk in lists.chunks], [chunk.values.to_numpy() for chunk in lists.chunks]

    def at(place: int) -> np.ndarray:
        k = int(np.searchsorted(ends, place, "right"))
        start, end = offsets[k][place - (ends[k - 1] if k else 0) :][:2]
        return values[k][start:end]

    return at


def _cross(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of pairs of different components, with an estimate within the margin, that share no band before
    this one, so that each pair is met in one band only."""
    i, j, band = (table.column(k)[0].as_py() for k in ("i", "j", "band"))
    own, rep, component, n, shared = (table.column(k).to_numpy() for k in ("own", "rep", "component", "n", "shared"))
    shared = np.minimum(n, shared)
    registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for x in left.tolist():
        y = right[component[right] != component[x]]
        if i == j:
            y = y[rep[y] > rep[x]]
        most = np.minimum(shared[y], shared[x])  # an intersection holds no more
        y = y[100 * most >= PERCENT * (n[y] + n[x] - most)]
        if len(y):
            equal = registers[y] == registers[x]
            first = equal.reshape(len(y), BANDS, -1).all(2).argmax(1) == band
            y = y[first & (estimate(equal.sum(1)) >= PERCENT / 100 - MARGIN)]
            if len(y):
                found.append((np.full(len(y), x), y))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*found, strict=True)) if found else (empty, empty)


def _linkable(rows: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """The members (key, band, rep, component) of some bands that can be linked with other components, with the number of
    shingles that occur in several components (shared).

    Shingles are counted, map side first, and never listed: of each only the least and the greatest component.
    """
    ids = scratch.keep("wide_ids", members.select(F.col("rep").alias("doc_id")).distinct())
    sets = scratch.keep("wide_sets", _sets(rows, ids).withColumnRenamed("doc_id", "rep"))
    members, left, turn = members.withColumn("shared", F.lit(0).cast("long")), ids.count(), 0
    while left:
        turn += 1
        own = sets.join(members.select("rep", "component").distinct(), "rep")
        items = own.select("rep", "component", F.explode("items").alias("item"))
        across = items.groupBy("item").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("item")
        across = scratch.keep(f"across{turn}", across)
        shared = items.join(across, "item").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
        sizes = own.groupBy("rep").agg(F.min(F.size("items")).alias("n"))  # the least, where an id has several texts
        able = scratch.keep(f"able{turn}", sizes.join(shared, "rep").where(100 * F.col("shared") >= PERCENT * F.col("n")).select("rep", "shared"))
        members = scratch.keep(f"wide{turn}", members.drop("shared").join(able, "rep"))
        before, left = left, able.count()
        if left > TURN * before:
            break
    return members


def _sized(members: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """Members with the size of their band and its largest component, as a written table, of the bands that hold several
    components."""
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("size", "component", "shingles")).alias("largest"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"))
    sizes = scratch.keep(f"{name}_sizes", sizes.where("size > largest.size"))
    return scratch.keep(name, members.join(sizes, "key"))


def _wider():
    """Whether more than WIDE members of a band are outside its largest component."""
    return F.col("size") - F.col("largest.size") > WIDE


def _of_reps(ids: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, n, registers of some representatives. ids comes from a written table, whose size tells the engine how to join."""
    return classes.select("rep", "n", "registers").join(ids.select("rep").distinct(), "rep")


def _dealt(split: DataFrame) -> DataFrame:
    """Members to pairs of blocks (i, j), own being theirs: blocks outside the largest component to all, of it to the others.
    A band that fits into one block, by its members and by their shingles, is one."""
    blocks = lambda size, shingles: F.greatest(F.ceil(size / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    is_largest = F.col("component") == F.col("largest.component")
    few = blocks(F.col("size") - F.col("largest.size"), F.col("shingles") - F.col("largest.shingles"))
    many = blocks(F.col("largest.size"), F.col("largest.shingles"))
    one = blocks(F.col("size"), F.col("shingles")) <= 1
    own = F.when(one, 0).when(is_largest, few + F.pmod(F.xxhash64("rep"), many)).otherwise(F.pmod(F.xxhash64("rep"), few)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(one, 0).when(is_largest, few - 1).otherwise(few + many - 1)))
    dealt = split.select("key", "band", "rep", "component", "shared", own.alias("own"), other.alias("other"))
    return dealt.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "shared")


def _open_links(rows: DataFrame, split: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links between different components within a band, enough of them to connect what is linked there.

    split: members of open bands, as _sized gives them. Those that can be linked are dealt to pairs of blocks; the members of a band's
    largest component are only paired with the others. The registers tell which members are in a pair to confirm at all;
    only the sets of these go to the blocks, where pairs are confirmed one by one and skipped once their components are
    connected. No pair leaves a block unless it is a link.
    """
    split = split.withColumn("shared", F.lit(1 << 62))
    wide = split.where(_wider()).select("key", "band", "rep", "component", "n")
    if wide.limit(1).count():
        split = split.where(~_wider()).unionByName(_sized(_linkable(rows, wide, scratch), "wide_split", scratch))
        split = scratch.keep("narrowed", split)
    reps = _of_reps(split, classes)
    dealt = _dealt(split)

    def involved(table: pa.Table) -> pa.Table:
        x, y = _cross(table)
        return table.select(["key", "band", "i", "j", "own", "rep", "component", "shared"]).take(pa.array(np.unique(np.concatenate([x, y]))))

    schema = "key long, band int, i int, j int, own int, rep long, component long, shared long"
    active = scratch.keep("active", _by_blocks(dealt.join(reps, "rep").select("key", "band", "i", "j", "own", "rep", "component", "shared", "n", "registers"), involved, schema))
    ids = scratch.keep("active_ids", active.select(F.col("rep").alias("doc_id")).distinct())
    full = active.join(reps, "rep").join(_sets(rows, ids).withColumnRenamed("doc_id", "rep"), "rep")

    def confirm(table: pa.Table) -> pa.Table:
        x, y = _cross(table)
        rep, component = (table.column(k).to_numpy() for k in ("rep", "component"))
        items = _views(table.column("items"))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        out: list[tuple[int, int]] = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            one, two = root(component[a]), root(component[b])
            if one != two:
                one_set, other = items(a), items(b)
                common = len(np.intersect1d(one_set, other, assume_unique=True))
                if 100 * common >= PERCENT * (len(one_set) + len(other) - common):
                    parent[max(one, two)] = min(one, two)
                    out.append((int(min(rep[a], rep[b])), int(max(rep[a], rep[b]))))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    linked = _by_blocks(full.select("key", "band", "i", "j", "own", "rep", "component", "shared", "n", "registers", "items"), confirm, "a long, b long")
    return scratch.keep("open_links", linked.distinct())


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = texts(docs)
    sketches = scratch.keep("sketches", _sketches(rows))
    least = F.min(F.struct("doc_id", "registers")).alias("least")
    classes = sketches.where("n > 0").groupBy("n", "s1", "s2").agg(least, F.count(F.lit(1)).alias("copies"))
    classes = scratch.keep("classes", classes.select("n", "s1", "s2", "copies", F.col("least.doc_id").alias("rep"), F.col("least.registers").alias("registers")))

    width = 2 * REGISTERS // BANDS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * F.lit(width) + 1, F.lit(width))))
    keys = classes.select("rep", "n", F.posexplode(band).alias("band", "key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    members = scratch.keep("members", keys.join(scratch.keep("shared", shared), "key"))

    def with_registers(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.keep(f"{name}_pairs", pairs)
        reps = _of_reps(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))), classes)
        x = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
        y = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
        alike = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
        return pairs.join(x, "a").join(y, "b").where(alike)

    def labelled(of: DataFrame, name: str) -> DataFrame:
        """of with the component so far of its column name."""
        if found is None:
            return of.withColumn("component", F.col(name))
        return of.join(found.withColumnRenamed("node", name), name, "left").withColumn("component", F.coalesce("component", name))

    found = tried = None

    def grown(links: DataFrame) -> DataFrame:
        """The components with further links; the links before are in them as stars."""
        return components(links if found is None else found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    def link(pairs: DataFrame, name: str) -> None:
        """Confirm pairs that were not tried before, and renew the components."""
        nonlocal found, tried
        new = scratch.keep(name, pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if new.limit(1).count():
            tried = new if tried is None else tried.unionByName(new)
            found = grown(_confirmed(rows, new, scratch, f"{name}_links"))

    for turn in range(STARS):
        tagged = labelled(members, "rep").select("key", "band", "rep", "n", "component")
        tagged = tagged if found is None else scratch.keep(f"tagged{turn}", tagged)
        pivot = F.min_by(F.struct("rep", "component"), F.xxhash64("rep", "key", F.lit(turn))).alias("pivot")
        stars = tagged.groupBy("key").agg(pivot, F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "pivot")
        stars = tagged.join(scratch.keep(f"pivots{turn}", stars), "key").where(F.col("component") != F.col("pivot.component"))
        stars = stars.select(F.least("rep", "pivot.rep").alias("a"), F.greatest("rep", "pivot.rep").alias("b")).distinct()
        link(_near(with_registers(stars, f"stars{turn}")), f"stars{turn}")
    tagged = scratch.keep("tagged", labelled(members, "rep").select("key", "band", "rep", "n", "component"))
    more = _open_links(rows, _sized(tagged, "split", scratch), classes, scratch)
    if more.limit(1).count():
        found = grown(more)
    # A document that is alone in its class and linked with none is its own component; only others are looked up.
    of_class = labelled(classes.select("n", "s1", "s2", "copies", "rep"), "rep").where("copies > 1 OR component <> rep").select("n", "s1", "s2", "component")
    of_class = scratch.keep("of_class", of_class)
    out = sketches.select("doc_id", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).select(back_id(), "n_shingles", back_id("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def near_dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; columns as they were.

    Rows are judged one by one: an id that rows share, or lack, links and drops no other text.
    """
    rows, name = with_rows(docs)
    return one_of_each(rows, name, near_dedup(row_texts(rows, name)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")))
