"""The history of a repository as a source: what changed between two commits, from the object files of a ``.git`` folder.

``spark.dataSource.register(RepositoryChanges)`` makes ``spark.read.format("repository_changes").option("old", ..).option("new",
..).load(path)`` known; :func:`changes` does both. Trees are compared by their hashes, so folders that are the same in both
commits are never opened, and each top-level entry that differs is a partition of its own. Objects are read where they are: loose
ones, and packed ones with their chains of deltas.

The source gives additions, deletions and modifications. Renames are a join over these (:func:`with_renames`): an added file
whose content is that of a deleted one is it under a new name. A file that was moved and edited at once is a deletion and an
addition.

Defined cases: an empty ``old`` compares with nothing, so every file is added; a reference may be a branch, a tag, HEAD or a full
hash, and an unknown one raises; submodules count as files; a path that changes between file and folder is a deletion and
additions.
"""

from __future__ import annotations

import mmap
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "status string, path string, old_id string, new_id string"
# Types of packed objects, and their names.
_COMMIT, _TREE, _BLOB, _TAG, _BY_OFFSET, _BY_NAME = 1, 2, 3, 4, 6, 7
_NAMES = {b"commit": _COMMIT, b"tree": _TREE, b"blob": _BLOB, b"tag": _TAG}
_FOLDER = "40000"


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A little-endian number of seven bits a byte, and the place behind it."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def patched(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base: copies of the base's stretches, and new bytes."""
    _, at = _number(delta, 0)
    size, at = _number(delta, at)
    out = bytearray()
    while at < len(delta):
        code = delta[at]
        at += 1
        if code & 128:
            start = length = 0
            for k in range(4):
                if code >> k & 1:
                    start |= delta[at] << 8 * k
                    at += 1
            for k in range(3):
                if code >> 4 + k & 1:
                    length |= delta[at] << 8 * k
                    at += 1
            out += base[start : start + (length or 0x10000)]
        else:
            out += delta[at : at + code]
            at += code
    if len(out) != size:
        raise ValueError("a delta does not give the size that it states")
    return bytes(out)


class Objects:
    """The objects of a repository by hash; its packs are mapped and not read."""

    def __init__(self, path: str):
        inner = os.path.join(path, ".git")
        self.folder = inner if os.path.isdir(inner) else path
        self.packs: list[tuple[mmap.mmap, mmap.mmap]] = []
        packs = os.path.join(self.folder, "objects", "pack")
        for name in sorted(os.listdir(packs)) if os.path.isdir(packs) else []:
            if name.endswith(".idx"):
                self.packs.append((self._mapped(os.path.join(packs, name)), self._mapped(os.path.join(packs, name[:-4] + ".pack"))))

    @staticmethod
    def _mapped(path: str) -> mmap.mmap:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def resolve(self, name: str) -> str:
        """The hash of a commit that a name stands for."""
        packed = {}
        path = os.path.join(self.folder, "packed-refs")
        if os.path.exists(path):
            with open(path) as f:
                packed = {p[1]: p[0] for p in (line.split() for line in f) if len(p) == 2 and p[0][0] not in "#^"}
        for _ in range(8):  # a symbolic name may stand for another
            if len(name) == 40 and all(c in "0123456789abcdef" for c in name):
                kind, data = self.read(name)
                if kind != _TAG:
                    return name
                name = data.split(b"\n", 1)[0].split()[1].decode()
                continue
            for full in (name, f"refs/{name}", f"refs/tags/{name}", f"refs/heads/{name}", f"refs/remotes/{name}"):
                path = os.path.join(self.folder, full)
                if os.path.isfile(path):
                    with open(path) as f:
                        found = f.read().strip()
                    break
                if full in packed:
                    found = packed[full]
                    break
            else:
                raise ValueError(f"the repository has no reference {name}")
            name = found.removeprefix("ref: ")
        raise ValueError(f"the reference {name} stands for itself")

    def read(self, name: str) -> tuple[int, bytes]:
        """Kind and content of an object."""
        path = os.path.join(self.folder, "objects", name[:2], name[2:])
        if os.path.exists(path):
            with open(path, "rb") as f:
                head, _, body = zlib.decompress(f.read()).partition(b"\0")
            return _NAMES[head.split()[0]], body
        wanted = bytes.fromhex(name)
        for index, pack in self.packs:
            if (at := self._offset(index, wanted)) is not None:
                return self._packed(pack, at)
        raise ValueError(f"the repository has no object {name}")

    @staticmethod
    def _offset(index: mmap.mmap, wanted: bytes) -> int | None:
        """Where an object is in a pack, by its index of version 2."""
        if index[:8] != b"\377tOc\0\0\0\2":
            raise ValueError("an index of a pack has another version than 2")
        fan = lambda k: struct.unpack_from(">I", index, 8 + 4 * k)[0]
        low, high, n = fan(wanted[0] - 1) if wanted[0] else 0, fan(wanted[0]), fan(255)
        names = 8 + 1024
        while low < high:
            middle = (low + high) // 2
            found = index[names + 20 * middle : names + 20 * middle + 20]
            if found == wanted:
                offsets = names + 24 * n
                at = struct.unpack_from(">I", index, offsets + 4 * middle)[0]
                return at if at < 1 << 31 else struct.unpack_from(">Q", index, offsets + 4 * n + 8 * (at & 0x7FFFFFFF))[0]
            low, high = (middle + 1, high) if found < wanted else (low, middle)
        return None

    def _packed(self, pack: mmap.mmap, at: int) -> tuple[int, bytes]:
        """An object of a pack; a chain of deltas is followed to its base and applied from there."""
        deltas: list[bytes] = []
        while True:
            start, byte = at, pack[at]
            kind = byte >> 4 & 7
            at += 1
            while byte & 128:
                byte = pack[at]
                at += 1
            if kind == _BY_OFFSET:
                byte = pack[at]
                back = byte & 127
                at += 1
                while byte & 128:
                    byte = pack[at]
                    back = (back + 1 << 7) | (byte & 127)
                    at += 1
                deltas.append(self._inflated(pack, at))
                at = start - back
                continue
            if kind == _BY_NAME:
                base = pack[at : at + 20].hex()
                deltas.append(self._inflated(pack, at + 20))
                kind, data = self.read(base)
            else:
                data = self._inflated(pack, at)
            for delta in reversed(deltas):
                data = patched(data, delta)
            return kind, data

    @staticmethod
    def _inflated(pack: mmap.mmap, at: int) -> bytes:
        stream, out = zlib.decompressobj(), []
        while not stream.eof:
            out.append(stream.decompress(pack[at : at + 65536]))
            at += 65536
        return b"".join(out)

    def tree_of(self, commit: str) -> str:
        return self.read(commit)[1].split(b"\n", 1)[0].split()[1].decode()

    def entries(self, tree: str | None) -> dict[str, tuple[str, str]]:
        """Mode and hash of each entry of a tree by name; of nothing none."""
        out, at, data = {}, 0, self.read(tree)[1] if tree else b""
        while at < len(data):
            mode, _, rest = data[at : at + 4096].partition(b" ")
            end = data.index(b"\0", at)
            name = data[at + len(mode) + 1 : end].decode("utf-8", "replace")
            out[name] = (mode.decode().lstrip("0"), data[end + 1 : end + 21].hex())
            at = end + 21
        return out


def compared(objects: Objects, old: str | None, new: str | None, prefix: str = "") -> Iterator[tuple[str, str, str | None, str | None]]:
    """(status, path, old hash, new hash) of the files that differ between two trees, in order of path within a folder."""
    waiting = [(old, new, prefix)]
    while waiting:
        old, new, prefix = waiting.pop()
        before, after = objects.entries(old), objects.entries(new)
        for name in sorted(before.keys() | after.keys()):
            a, b = before.get(name), after.get(name)
            if a == b:
                continue
            trees = [x[1] if x and x[0] == _FOLDER else None for x in (a, b)]
            if any(trees):
                waiting.append((*trees, f"{prefix}{name}/"))
            files = [x[1] if x and x[0] != _FOLDER else None for x in (a, b)]
            if any(files):
                yield "M" if all(files) else "D" if files[0] else "A", prefix + name, *files


class _Part(InputPartition):
    def __init__(self, name: str, old: tuple[str, str] | None, new: tuple[str, str] | None):
        super().__init__(name)
        self.name, self.old, self.new = name, old, new


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.old, self.new = options["path"], options.get("old", ""), options.get("new", "HEAD")

    def partitions(self) -> list[_Part]:
        """The top-level entries that differ."""
        objects = Objects(self.path)
        trees = [objects.entries(objects.tree_of(objects.resolve(x)) if x else None) for x in (self.old, self.new)]
        parts = [_Part(name, trees[0].get(name), trees[1].get(name)) for name in sorted(trees[0].keys() | trees[1].keys())]
        return [p for p in parts if p.old != p.new] or [_Part("", None, None)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        sides = (partition.old, partition.new)
        files = [x[1] if x and x[0] != _FOLDER else None for x in sides]
        if any(files):
            yield "M" if all(files) else "D" if files[0] else "A", partition.name, *files
        trees = [x[1] if x and x[0] == _FOLDER else None for x in sides]
        if any(trees):
            yield from compared(Objects(self.path), *trees, f"{partition.name}/")


class RepositoryChanges(DataSource):
    """status (A, D, M), path, old_id, new_id; options path, old (empty for nothing) and new (HEAD)."""

    @classmethod
    def name(cls) -> str:
        return "repository_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def changes(spark: SparkSession, path: str, old: str = "", new: str = "HEAD") -> DataFrame:
    """The changes between two commits of the repository at a path that all executors see."""
    spark.dataSource.register(RepositoryChanges)
    return spark.read.format("repository_changes").option("old", old).option("new", new).load(path)


def with_renames(changed: DataFrame) -> DataFrame:
    """status, path, old_path, old_id, new_id: as changed, with an added file that has a deleted one's content as R; of
    several files with one content the first goes with the first, and so on."""
    nth = lambda status, key: F.row_number().over(W.partitionBy(key).orderBy("path"))
    added = changed.where("status = 'A'").withColumn("nth", nth("A", "new_id")).select(F.col("path").alias("to"), F.col("new_id").alias("id"), "nth")
    gone = changed.where("status = 'D'").withColumn("nth", nth("D", "old_id")).select(F.col("path").alias("from"), F.col("old_id").alias("id"), "nth")
    pairs = added.join(gone, ["id", "nth"]).select("id", "from", "to")
    rest = changed.join(pairs.select(F.lit("A").alias("status"), F.col("to").alias("path")).unionByName(pairs.select(F.lit("D").alias("status"), F.col("from").alias("path"))), ["status", "path"], "left_anti")
    moved = pairs.select(F.lit("R").alias("status"), F.col("to").alias("path"), F.col("from").alias("old_path"), F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    return rest.select("status", "path", F.lit(None).cast("string").alias("old_path"), "old_id", "new_id").unionByName(moved)


def head(path: str, name: str = "HEAD") -> str:
    """The hash of the commit that a name stands for now, to hold against the one that was analysed."""
    return Objects(path).resolve(name)
