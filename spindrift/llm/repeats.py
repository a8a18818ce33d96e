"""Removal of repeated substrings by prefix-free parsing.

Every byte goes that a ``MIN_BYTES``-byte string covers which also starts in a document with a smaller id.

Parsing. A rolling hash of ``TRIGGER`` bytes runs over each text; the trigger of a 50-byte string is the place of its
least hash (the leftmost of equals). Triggers depend on nothing but the string, so equal strings have equal triggers at
the same offset, wherever they stand, and texts are cut at the same places. Consecutive strings with one trigger form a
phrase with what follows it: the dictionary holds what ends with the trigger, the parse what starts with it, and a string
is a suffix of the one (down to the trigger's end) with a prefix of the other. As no suffix that ends with its trigger is
a proper prefix of another, the order of all strings is that of their dictionary suffixes and, among equal ones, of the
parse behind them.

1. Names: a phrase is named by its trigger (48 bits) and its contents (80 bits of two hashes). Of each name only the
   document with the smallest id matters. Each task keeps the first one of its own and marks the others at once, so a
   passage in a third of the documents costs one entry a task and not one a document. Entries meet by trigger: a phrase
   whose name occurs in a smaller document is repeated as a whole, and a trigger with several phrases is open.
2. Suffix arrays: only phrases at open triggers (some hundredths) are spelled out, each distinct one once, for its first
   document. Their dictionary sides are sorted from the trigger backwards, their parse sides from the trigger on, by
   bytes. In the first order the phrases that share a suffix are neighbours, in the second those that share a
   continuation, so a run in each names a string; sorting these pairs of runs puts equal strings side by side, and those
   not in their smallest document are repeated. Nothing is compared by hash here.
3. Both kinds of marks go back to their documents, where the covered bytes are removed.

In highly repetitive text most phrases are copies and end in step 1 with a few bytes each. Marks and phrases travel
packed in arrays; the number of buckets follows from the size of the texts and each bucket is a partition of its own, so
a task's memory does not grow with it. Triggers with very many different phrases are found beforehand on a sample of
documents, and their entries are dealt by phrase and spelled out string by string; the sample only decides how rows are
dealt and never what is found.

Names of phrases in different documents are the only place where hashes decide: of 1e18 pairs of different phrases at one trigger, more than 100 TB of text
hold, any two share the 80 bits with a probability of about 1e-6. Triggers that share their 48 bits only open each other.

Defined cases: null text is empty; shorter texts lose nothing; a null id counts as the largest; rows with one id never
remove from each other, whether or not their texts are equal; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, back_id, map_batches, small_batches, text_bytes, texts

MIN_BYTES, TRIGGER = 50, 20
#: Text of one bucket of phrases and of one bucket of documents, text that a task parses before it sends, and of one pass.
PHRASE_BUCKET, DOC_BUCKET, FLUSH, CHUNK = 6 << 20, 12 << 20, 8 << 20, 1 << 20
#: Share of documents (one in so many) in the sample for heavy triggers, phrases from which one is heavy, and their bound.
SAMPLE, HEAVY, MOST_HEAVY = 256, 256, 100_000
#: Phrases whose sides are packed at a time.
PACK = 1 << 15
_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFF)
#: Bits of a phrase's key that are its trigger's; the others belong to its name.
_TRIGGER_BITS = ~np.uint64(0xFFFF)
#: Kinds of packed rows.
ENTRY, HEAVY_ENTRY, WHOLE, OPEN, STRINGS = range(5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.uint64]:
    out = [_P]
    with np.errstate(over="ignore"):
        for _ in range(n.bit_length()):
            out.append(out[-1] * out[-1])
    return out


_POWER = _powers(MIN_BYTES)


def rolling(raw: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all substrings of each size, from those of powers of two."""
    doubled = [raw.astype(np.uint64) + np.uint64(1)]
    while 2 << (len(doubled) - 1) <= max(sizes):
        k, h = len(doubled) - 1, doubled[-1]
        doubled.append(h[: -(1 << k)] * _POWER[k] + h[1 << k :])
    out = []
    for size in sizes:
        n, at, total = len(raw) - size + 1, 0, None
        for k in range(len(doubled) - 1, -1, -1):
            if size >> k & 1:
                part = doubled[k][at : at + n]
                total = part if total is None else total * _POWER[k] + part
                at += 1 << k
        out.append(total)
    return out


def phrases(text: bytes) -> tuple[np.ndarray, ...]:
    """Of each phrase: its key (bits of the trigger's hash, and of a second one of its contents), name, starts of its first
    and its last string, and place of the trigger."""
    parts = [_phrases(np.frombuffer(text, np.uint8, min(CHUNK + MIN_BYTES - 1, len(text) - at), at), at) for at in range(0, len(text) - MIN_BYTES + 1, CHUNK)]
    if not parts:
        return *[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 3
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _phrases(raw: np.ndarray, offset: int) -> tuple[np.ndarray, ...]:
    triggers, strings = rolling(raw, (TRIGGER, MIN_BYTES))
    triggers = _mix(triggers)
    least = (triggers & ~_LOW) | np.arange(len(triggers), dtype=np.uint64)
    width, n = MIN_BYTES - TRIGGER + 1, 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if width > n:
        least = np.minimum(least[: n - width], least[width - n :])
    at = (least & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    at = at[first]
    # The first and the last string overlap and so spell the phrase; the name also holds where the trigger is in it.
    name = _mix(strings[first] * np.uint64(3) + _mix(strings[last]) + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (last - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    # A hash of another make: of the pieces of TRIGGER bytes that cover both strings.
    second = np.zeros(len(at), np.uint64)
    for start in (first, last):
        for step in (0, TRIGGER, MIN_BYTES - TRIGGER):
            second = second * _P + triggers[start + step]
    return (triggers[at] & _TRIGGER_BITS) | (_mix(second) & ~_TRIGGER_BITS), name, first + offset, last + offset, at + offset


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, equally long, byte by byte of each number, which compresses well."""
    return b"".join(a.view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)


def unpack(blobs: list[bytes], n: int) -> list[np.ndarray]:
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(n, 8, -1).transpose(0, 2, 1)).view(np.uint64)[..., 0] for b in blobs]
    return list(np.concatenate(parts, axis=1)) if parts else [np.zeros(0, np.uint64)] * n


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _spread(buckets: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows (bucket, kind, packed arrays), one for each bucket."""
    order = np.argsort(buckets, kind="stable")
    edges = [*_runs(buckets[order]).tolist(), len(order)]
    return [(int(buckets[order[a]]), kind, pack(*(x[order[a:b]] for x in arrays))) for a, b in zip(edges, edges[1:], strict=False)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])


PACKED = "bucket int, kind int, blob binary"


def _doc_buckets(docs: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each document id, as crc32(id as text) mod n."""
    known, where = np.unique(docs.view(np.int64), return_inverse=True)
    return np.fromiter((zlib.crc32(str(d).encode()) % n for d in known.tolist()), np.int64, len(known))[where]


def _place(text: bytes, tagged: bool) -> int:
    """What tells rows with one id apart, in the high half of a place."""
    return zlib.crc32(text) << 32 if tagged else 0


def _parsed(rows: DataFrame, buckets: int, heavy: np.ndarray, tagged: bool) -> DataFrame:
    """ENTRY and HEAVY_ENTRY rows (trigger, name, id, place of the phrase) and WHOLE rows (id, place) of copies."""

    def flush(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        held.sort(key=lambda x: (x[0], _place(x[1], tagged)))
        found = []
        for doc, text in held:
            trigger, name, *_ = phrases(text)
            place = np.arange(len(name), dtype=np.uint64) | np.uint64(_place(text, tagged))
            found.append((trigger, name, np.full(len(name), doc, np.int64).view(np.uint64), place))
        trigger, name, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(name, kind="stable")  # ids, and texts of an id, ascend within a name
        # Names that two triggers share are kept apart; such a run may be split, which costs an entry more.
        start = np.union1d(_runs(name[order]), _runs(trigger[order]))
        lead = np.repeat(doc[order[start]], np.diff(np.append(start, len(order))))
        copy = doc[order] != lead
        # One mark of a name, or one entry, is enough for each document and, where rows share ids, for each of its texts.
        tag = place[order] >> np.uint64(32)
        same = np.concatenate(([False], (name[order][1:] == name[order][:-1]) & (trigger[order][1:] == trigger[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (tag[1:] == tag[:-1]))) if len(order) else copy
        sent, marked = order[~copy & ~same], order[copy & ~same]
        out = []
        is_heavy = np.isin(trigger[sent] & _TRIGGER_BITS, heavy) if len(heavy) else np.zeros(len(sent), bool)
        plain, dealt = sent[~is_heavy], sent[is_heavy]
        n = np.uint64(buckets)
        if len(plain):
            out += _spread((_mix(trigger[plain] & _TRIGGER_BITS) % n).astype(np.int64), ENTRY, trigger[plain], name[plain], doc[plain], place[plain])
        if len(dealt):
            out += _spread((_mix(name[dealt]) % n).astype(np.int64), HEAVY_ENTRY, trigger[dealt], name[dealt], doc[dealt], place[dealt])
        if len(marked):
            out += _spread((_mix(name[marked]) % n).astype(np.int64), WHOLE, doc[marked], place[marked])
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc, text))
                size += len(text)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return map_batches(rows.select("doc_id", F.encode("text", "UTF-8").alias("text")), run, PACKED)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of each bucket in turn; they come sorted by bucket."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: r["bucket"])


def _dealt(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Each of n buckets in a partition of its own."""
    return df.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", *order)


def _resolved(entries: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    """WHOLE and OPEN marks (id, place) by bucket of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            blobs: dict[int, list[bytes]] = {}
            for r in rows:
                blobs.setdefault(r["kind"], []).append(r["blob"])
            marks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WHOLE: [], OPEN: []}
            if WHOLE in blobs:
                marks[WHOLE].append(tuple(unpack(blobs[WHOLE], 2)))
            for kind in (ENTRY, HEAVY_ENTRY):
                if kind not in blobs:
                    continue
                trigger, name, doc, place = unpack(blobs[kind], 4)
                order = np.lexsort((doc.view(np.int64), name, trigger))
                trigger, name, doc, place = trigger[order], name[order], doc[order], place[order]
                start = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (trigger[1:] != trigger[:-1]))))
                lead = np.repeat(doc[start], np.diff(np.append(start, len(doc))))
                whole = doc != lead
                if kind == ENTRY:
                    groups = _runs(trigger & _TRIGGER_BITS)
                    several = np.add.reduceat(np.isin(np.arange(len(doc)), start).astype(np.int64), groups) > 1
                    opened = np.repeat(several, np.diff(np.append(groups, len(doc)))) & ~whole
                else:
                    opened = ~whole
                marks[WHOLE].append((doc[whole], place[whole]))
                marks[OPEN].append((doc[opened], place[opened]))
            out = []
            for kind, parts in marks.items():
                if parts and (n := sum(len(p[0]) for p in parts)):
                    doc, place = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                    order = np.lexsort((place, doc.view(np.int64)))
                    out += _spread(_doc_buckets(doc[order], doc_buckets), kind, doc[order], place[order])
                    del n
            if out:
                yield _batch(out)

    return map_batches(_dealt(entries, buckets), run, PACKED)


class _Marks:
    """Marks of one bucket of documents, looked up by id."""

    def __init__(self, blobs: list[bytes]):
        doc, place = unpack(blobs, 2)
        doc = doc.view(np.int64)
        order = np.argsort(doc, kind="stable")
        self.doc, self.place = doc[order], place[order]

    def of(self, doc: int, tag: int) -> np.ndarray:
        """Places of a row's marks."""
        a, b = np.searchsorted(self.doc, (doc, doc + 1)) if doc < (1 << 63) - 1 else (np.searchsorted(self.doc, doc), len(self.doc))
        places = self.place[a:b]
        return (places[places >> np.uint64(32) == np.uint64(tag >> 32)] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _at_documents(rows: DataFrame, marks: DataFrame, doc_buckets: int) -> DataFrame:
    """Texts and marks of each bucket of documents together, marks first."""
    docs = rows.select(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(doc_buckets)).cast("int").alias("bucket"), F.lit(99).alias("kind"), F.encode("text", "UTF-8").alias("blob"), "doc_id")
    both = marks.select("bucket", "kind", "blob", F.lit(None).cast("long").alias("doc_id")).unionByName(docs)
    small_batches(rows.sparkSession)
    return _dealt(both, doc_buckets, "kind")


def _with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, _Marks], Iterator[tuple[int, bytes]]]]:
    for bucket, rows in _by_bucket(batches):
        blobs: dict[int, list[bytes]] = {}
        first = None
        for r in rows:
            if r["kind"] == 99:
                first = r
                break
            blobs.setdefault(r["kind"], []).append(r["blob"])
        marks = {k: _Marks(blobs.get(k, [])) for k in (WHOLE, OPEN, STRINGS)}
        texts_of = ((r["doc_id"], r["blob"]) for r in ([first] if first else [])), ((r["doc_id"], r["blob"]) for r in rows)
        yield bucket, marks, (x for part in texts_of for x in part)


def _spelled(rows: DataFrame, marks: DataFrame, buckets: int, doc_buckets: int, heavy: np.ndarray, tagged: bool) -> DataFrame:
    """Phrases at open triggers: rows (bucket, kind = number of phrases, packed ids, places, lengths and offsets of the
    trigger, then contents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, of, docs in _with_marks(batches):
            keys, ids, places, contents, offsets = [], [], [], [], []
            for doc, text in docs:
                tag = _place(text, tagged)
                opened = of[OPEN].of(doc, tag)
                if not len(opened):
                    continue
                trigger, _, first, last, at = phrases(text)
                trigger &= _TRIGGER_BITS
                is_heavy = np.isin(trigger[opened], heavy) if len(heavy) else np.zeros(len(opened), bool)
                for t, a, b, c, alone in zip(trigger[opened].tolist(), first[opened].tolist(), last[opened].tolist(), at[opened].tolist(), is_heavy.tolist(), strict=True):
                    for x, y in ((p, p) for p in range(a, b + 1)) if alone else ((a, b),):
                        content = text[x : y + MIN_BYTES]
                        keys.append(zlib.crc32(content) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF if alone else t)
                        ids.append(doc)
                        places.append(x | tag)
                        contents.append(content)
                        offsets.append(c - x)
            if not keys:
                continue
            bucket = (_mix(np.array(keys, np.uint64)) % np.uint64(buckets)).astype(np.int64)
            ids, places, offsets = np.array(ids, np.int64).view(np.uint64), np.array(places, np.uint64), np.array(offsets, np.uint64)
            order = np.argsort(bucket, kind="stable")
            edges = [*_runs(bucket[order]).tolist(), len(order)]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                own = order[a:b]
                some = [contents[i] for i in own.tolist()]
                out.append((int(bucket[own[0]]), len(own), pack(ids[own], places[own], np.fromiter(map(len, some), np.uint64, len(some)), offsets[own]) + b"".join(some)))
            yield _batch(out)

    return _at_documents(rows, marks, doc_buckets).mapInArrow(run, PACKED)


def _suffix_order(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings of up to width bytes, given as rows of big-endian numbers (zero-padded), and for each place in it
    the number of bytes that its string shares with the one before."""
    order = np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)])
    octets = words[order].astype(">u8").view(np.uint8).reshape(len(order), -1)[:, :width]
    differs = octets[1:] != octets[:-1]
    common = np.where(differs.any(1), differs.argmax(1), width) if len(order) > 1 else np.zeros(0, np.int64)
    return order, np.concatenate(([0], common)) if len(order) else common


def _run_starts(common: np.ndarray, least: int) -> np.ndarray:
    """For each place of an order the first one of its run of strings that share least bytes."""
    return np.maximum.accumulate(np.where(common < least, np.arange(len(common)), 0))


def shared_strings(ids: np.ndarray, places: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Id and place of each string start of the phrases whose string a phrase of a smaller id also holds.

    lengths and offsets (of the trigger) are of the phrases, which stand one after another in text. A string with k bytes
    before its trigger is the dictionary suffix of these and the trigger, and the first ``MIN_BYTES`` - k bytes of the
    parse. Its name is the pair of runs of phrases that share the one and the other.
    """
    lengths, offsets = lengths.astype(np.int64), offsets.astype(np.int64)
    doc = ids.view(np.int64)
    n, side = len(lengths), MIN_BYTES - TRIGGER
    raw = np.frombuffer(text + bytes(MIN_BYTES), np.uint8)
    start = np.cumsum(lengths) - lengths
    trigger = start + offsets

    def packed(steps: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The bytes at some steps from each trigger as big-endian numbers, zero outside of [low, high)."""
        octets = np.zeros((n, -(-len(steps) // 8) * 8), np.uint8)
        for k in range(0, n, PACK):
            part = slice(k, k + PACK)
            inside = (steps >= low[part, None]) & (steps < high[part, None])
            octets[part, : len(steps)] = np.where(inside, raw[np.where(inside, trigger[part, None] + steps, 0)], 0)
        return octets.view(">u8").astype(np.uint64)

    backwards = np.concatenate((np.arange(TRIGGER - 1, -1, -1), np.arange(-1, -side - 1, -1)))
    parse, parse_common = _suffix_order(packed(np.arange(MIN_BYTES), np.zeros(n, np.int64), lengths - offsets), MIN_BYTES)
    dictionary, dictionary_common = _suffix_order(packed(backwards, -offsets, np.full(n, TRIGGER)), MIN_BYTES)
    in_parse, in_dictionary = np.empty(n, np.int64), np.empty(n, np.int64)
    in_parse[parse], in_dictionary[dictionary] = np.arange(n), np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(side + 1):
        # Phrases with a string that has k bytes before the trigger.
        own = np.flatnonzero((k <= offsets) & (offsets - k + MIN_BYTES <= lengths))
        if len(own) < 2:
            continue
        name = _run_starts(dictionary_common, TRIGGER + k)[in_dictionary[own]] * n + _run_starts(parse_common, MIN_BYTES - k)[in_parse[own]]
        order = np.lexsort((doc[own], name))
        run = _runs(name[order])
        lead = np.repeat(doc[own][order[run]], np.diff(np.append(run, len(order))))
        hit = own[order[doc[own][order] != lead]]
        found.append((ids[hit], places[hit] + (offsets[hit] - k).astype(np.uint64)))
    if not found:
        return ids[:0], places[:0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sorted_dictionary(spelled: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    """STRINGS marks (id, start) by bucket of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            parts, contents = [], []
            for r in rows:
                head = 32 * r["kind"]
                parts.append(r["blob"][:head])
                contents.append(r["blob"][head:])
            ids, places = shared_strings(*unpack(parts, 4), b"".join(contents))
            if len(ids):
                yield _batch(_spread(_doc_buckets(ids, doc_buckets), STRINGS, ids, places))

    return map_batches(_dealt(spelled, buckets), run, PACKED)


def _removed(text: bytes, whole: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Edges of the removed runs: starts and ends in turn.

    A mark is of one place; the other places of the text with the same phrase or string are found by hash and kept if their
    bytes are those of a mark.
    """
    step = np.zeros(len(text) + 1, np.int64)
    if len(whole):
        _, name, first, last, _ = phrases(text)
        mark = np.isin(name, name[whole])
        more = mark.copy()
        more[whole] = False
        if more.any():
            known = {text[a : b + MIN_BYTES] for a, b in zip(first[whole].tolist(), last[whole].tolist(), strict=True)}
            for k in np.flatnonzero(more).tolist():
                mark[k] = text[first[k] : last[k] + MIN_BYTES] in known
        np.add.at(step, first[mark], 1)
        np.add.at(step, last[mark] + MIN_BYTES, -1)
    if len(strings):
        raw = np.frombuffer(text, np.uint8)
        (hashes,) = rolling(raw, (MIN_BYTES,))
        marked, where = np.unique(hashes[strings], return_index=True)
        at = np.flatnonzero(np.isin(hashes, marked))
        one = strings[where][np.searchsorted(marked, hashes[at])]  # a marked string with this hash
        same = np.ones(len(at), bool)
        for k in range(MIN_BYTES):
            same &= raw[at + k] == raw[one + k]
        if not same.all():  # another hash collides with that one
            known = {text[s : s + MIN_BYTES] for s in strings.tolist()}
            same[~same] = [text[p : p + MIN_BYTES] in known for p in at[~same].tolist()]
        at = at[same]
        np.add.at(step, at, 1)
        np.add.at(step, at + MIN_BYTES, -1)
    covered = np.concatenate(([False], np.cumsum(step[:-1]) > 0, [False]))
    return np.flatnonzero(covered[1:] != covered[:-1])


def _heavy(rows: DataFrame, sample: int = SAMPLE, heavy: int = HEAVY) -> np.ndarray:
    """Triggers with very many different phrases in a sample of documents; they are dealt differently, not judged so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).to_pylist():
                trigger, name, *_ = phrases(text)
                yield pa.RecordBatch.from_arrays([pa.array((trigger & _TRIGGER_BITS).view(np.int64)), pa.array(name.view(np.int64))], ["trigger", "name"])

    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).select("doc_id", F.encode("text", "UTF-8").alias("text"))
    found = map_batches(some, run, "trigger long, name long").distinct().groupBy("trigger").count().where(F.col("count") >= heavy)
    return np.sort(np.array([r["trigger"] for r in found.orderBy(F.desc("count"), "trigger").limit(MOST_HEAVY).collect()], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, edges (starts and ends of removed runs in turn), one row for
    each row of docs; with keep_text also what is kept, as bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = texts(docs)
    size = text_bytes(rows)
    buckets, doc_buckets = max(1, -(-size // PHRASE_BUCKET)), max(1, -(-size // DOC_BUCKET))
    tagged = bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())
    heavy = _heavy(rows)
    marks = scratch.keep("marks", _resolved(_parsed(rows, buckets, heavy, tagged), buckets, doc_buckets))
    spelled = _spelled(rows, marks.where(F.col("kind") == OPEN), buckets, doc_buckets, heavy, tagged)
    strings = scratch.keep("strings", _sorted_dictionary(spelled, buckets, doc_buckets))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, edges array<long>" + ", kept binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()][: len(names)]
        for _, of, docs_of in _with_marks(batches):
            out: list[tuple] = []
            held = 0
            for doc, text in docs_of:
                tag = _place(text, tagged)
                edges = _removed(text, of[WHOLE].of(doc, tag), of[STRINGS].of(doc, tag)).tolist()
                cuts = [0, *edges, len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((doc, len(text), len(text) - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges, *((kept,) * keep_text)))
                held += len(kept) * keep_text
                if len(out) >= 512 or held >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    final = _at_documents(rows, marks.where(F.col("kind") == WHOLE).unionByName(strings), doc_buckets).mapInArrow(run, schema)
    return final.select(back_id(), *[x.split()[0] for x in schema.split(", ")[1:]])
