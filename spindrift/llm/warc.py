"""WARC archives: written with an index, read back by coalesced byte ranges.

``write_archives`` writes a gzip member for each record (WARC/1.1) and gives the index: file, offset, length, url and
digest per record. ``read_records`` takes any selection of the index, deals it out by stretches of a file, sorts it by
offset and reads neighbouring records with one request, so a selection costs requests in proportion to the stretches it
touches and not to its records.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest page_id is a response and the
others are revisits of it. Only digests are grouped (combined on the map side), so a payload that a third of the pages
share is no hot key; the few digests with copies go to the pages by a join whose small side is broadcast while its
counted size is bounded, and is shuffled beyond.

A task writes to files of its own name and attempt; the index is what a finished task has returned, so files of lost
attempts are never read. Paths go through pyarrow's file systems, so the root may be in any store that they know.

Defined cases: null html is an empty payload; a null url becomes ``urn:page:<id>``; a null page_id counts as the
largest and comes back null; rows that repeat page_id and payload are each written, as responses if theirs is the
largest id; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import NO_ID, Scratch, back_id, hinted, map_batches, scratch_path

#: Smaller payloads are never revisits.
MIN_REVISIT = 1000
#: A file is closed once it holds so many bytes.
FILE_BYTES = 512 << 20
#: Bytes between two records that are read along, most bytes of one read, and bytes of a file that one task deals with.
GAP_BYTES, READ_BYTES, STRETCH_BYTES = 64 << 10, 8 << 20, 32 << 20
LEVEL = 5
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Names that Hadoop has for stores that pyarrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it. Paths are as Spark writes them: spaces and percent signs are signs."""
    scheme, mark, rest = path.partition("://")
    if not mark or scheme == "file":
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{quote(rest)}")


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_id(page_id: int, digest: str) -> str:
    return f"<urn:page:{page_id}:{_base32(digest)}>"


def build_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record without compression; a revisit holds the HTTP head only."""
    revisit = refers_to is not None
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.lower(): v for k, v in (x.split(": ", 1) for x in lines if ": " in x)}
    warc = fields(head.decode().split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    if not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("latin-1").split("\r\n")[1:]), payload


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(root: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        store, base = _store(root)
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nsoftware: spindrift\r\n\r\n\r\n"
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    if out is None:
                        one = uuid.uuid4()
                        name, at = f"{one.hex}.warc.gz", 0
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        at += out.write(_gzip(info % (str(one).encode(), DATE.encode())))
                    packed = _gzip(build_record(page_id, url, html, digest, refers_to))
                    out.write(packed)
                    rows.append((name, at, len(packed), page_id, url, digest, len(html), "response" if refers_to is None else "revisit", refers_to))
                    at += len(packed)
                    if at >= file_bytes:
                        out.close()
                        out = None
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, root: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages below root; the index, as a written table."""
    scratch = Scratch(pages.sparkSession)
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1("html"))
    big = F.octet_length("html") >= min_revisit
    copies = rows.where(big).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = scratch.keep("copies", copies.select("digest", "first_id"))
    typed = rows.join(hinted(copies, 64), "digest", "left")
    refers_to = F.when(big & (F.col("first_id") != F.col("page_id")), F.col("first_id"))
    typed = typed.select("page_id", "url", "html", "digest", refers_to.alias("refers_to"))
    return scratch.keep("index", map_batches(typed, _writer(root, file_bytes), INDEX))


def read_records(selected: DataFrame, root: str, payload: bool = False) -> DataFrame:
    """The records of the selected rows of the index, checked against their digests; with payload also ``html``.

    A revisit holds no payload; its digest and size are those of the response it refers to, from its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            rows, i = [], 0
            while i < len(places):
                file, start, length = places[i]
                end, j = start + length, i + 1
                while j < len(places) and places[j][0] == file and places[j][1] - end <= GAP_BYTES and places[j][1] + places[j][2] - start <= READ_BYTES:
                    end, j = max(end, places[j][1] + places[j][2]), j + 1
                with store.open_input_file(f"{base}/{file}") as f:
                    stretch = f.read_at(end - start, start)
                for _, offset, size in places[i:j]:
                    rows.append(_row(zlib.decompress(stretch[offset - start : offset - start + size], 31), payload))
                i = j
            names = [x.split()[0] for x in schema.split(", ")]
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types[: len(names)])], names)

    schema = RECORD + ", html string" * payload
    stretches = selected.agg(F.sum("length")).first()[0] or 0
    n = max(selected.sparkSession.sparkContext.defaultParallelism, -(-stretches // STRETCH_BYTES))
    places = selected.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch"))
    places = places.repartition(n, "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return map_batches(places, read, schema)


def _row(raw: bytes, payload: bool) -> tuple:
    warc, http, body = parse_record(raw)
    page_id = int(warc["warc-record-id"].split(":")[2])
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    refers_to = None
    size = int(http["content-length"])
    if warc["warc-type"] == "revisit":
        refers_to, body = int(warc["warc-refers-to"].split(":")[2]), None
    elif (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
        raise ValueError(f"the payload of {warc['warc-record-id']} is not what was written")
    row = (page_id, warc["warc-target-uri"], size, digest, warc["warc-type"], refers_to)
    return (*row, body.decode("utf-8", "replace") if body is not None else None) if payload else row


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives of pages, written and read back."""
    root = root or scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, root)
    return read_records(index, root).select(back_id("page_id"), "payload_bytes", "payload_digest", "record_type", back_id("refers_to"))
