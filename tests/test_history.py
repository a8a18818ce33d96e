"""Changes between commits, against recorded states of a repository that the test writes object by object."""

import hashlib
import shutil
import struct
import subprocess
import zlib

import pytest

from spindrift.sources import history


def _loose(folder, kind, data):
    raw = f"{kind} {len(data)}".encode() + b"\0" + data
    name = hashlib.sha1(raw).hexdigest()
    path = folder / "objects" / name[:2] / name[2:]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(zlib.compress(raw))
    return name


def _tree(folder, files):
    """A tree of paths to contents."""
    entries, below = {}, {}
    for path, content in files.items():
        first, _, rest = path.partition("/")
        if rest:
            below.setdefault(first, {})[rest] = content
        else:
            entries[first] = ("100644", _loose(folder, "blob", content.encode()))
    for name, inner in below.items():
        entries[name] = ("40000", _tree(folder, inner))
    data = b"".join(f"{m} {n}".encode() + b"\0" + bytes.fromhex(h) for n, (m, h) in sorted(entries.items(), key=lambda x: x[0] + "/" * (x[1][0] == "40000")))
    return _loose(folder, "tree", data)


def _commit(folder, files, branch):
    name = _loose(folder, "commit", f"tree {_tree(folder, files)}\nauthor a <a> 0 +0000\n\nm\n".encode())
    ref = folder / "refs" / "heads" / branch
    ref.parent.mkdir(parents=True, exist_ok=True)
    ref.write_text(name + "\n")
    return name


OLD = {"a.py": "one", "b/c.py": "two", "b/d/e.py": "three", "b/d/same.py": "same", "gone.txt": "moved text", "dir/x": "1", "f": "file", "twin1": "t", "twin2": "t", "z/same/u": "u"}
NEW = {"a.py": "ONE", "b/c.py": "two", "b/d/e.py": "3", "b/d/same.py": "same", "new/place.txt": "moved text", "dir": "now a file", "f/g": "folder", "add.md": "added", "ütwin": "t", "z/same/u": "u"}
WANT = {("M", "a.py", None), ("M", "b/d/e.py", None), ("R", "new/place.txt", "gone.txt"), ("D", "dir/x", None), ("A", "dir", None), ("D", "f", None), ("A", "f/g", None), ("A", "add.md", None), ("R", "ütwin", "twin1"), ("D", "twin2", None)}


@pytest.fixture
def repository(tmp_path):
    folder = tmp_path / "repo" / ".git"
    folder.mkdir(parents=True)
    old, new = _commit(folder, OLD, "old"), _commit(folder, NEW, "main")
    (folder / "HEAD").write_text("ref: refs/heads/main\n")
    return tmp_path / "repo", old, new


def _rows(df):
    return {(r["status"], r["path"], r["old_path"]) for r in history.with_renames(df).collect()}


def test_changes_and_renames(spark, repository):
    path, old, new = repository
    assert _rows(history.changes(spark, str(path), old, "HEAD")) == WANT
    assert _rows(history.changes(spark, str(path), "old", new)) == WANT
    assert history.head(str(path)) == new
    assert {(r["status"], r["path"]) for r in history.changes(spark, str(path)).collect()} == {("A", p) for p in NEW}
    assert history.changes(spark, str(path), "main", "HEAD").collect() == []
    with pytest.raises(Exception, match="no reference nowhere"):
        history.changes(spark, str(path), "nowhere").collect()


def test_same_folders_are_not_opened(repository, monkeypatch):
    path, old, new = repository
    objects, opened = history.Objects(str(path)), []
    read = objects.read
    monkeypatch.setattr(objects, "read", lambda name: opened.append(name) or read(name))
    rows = list(history.compared(objects, objects.tree_of(old), objects.tree_of(new)))
    top = objects.entries(objects.tree_of(old))
    assert len(rows) == 12 and top["b"][1] in opened and top["z"][1] not in opened


def _delta(base, target):
    """A copy of the first half of the base, and the rest of the target as it is."""
    size = lambda n: (bytes([n & 127 | 128]) + size(n >> 7)) if n > 127 else bytes([n])
    half = len(base) // 2
    assert target.startswith(base[:half]) and half < 0x10000
    new = target[half:]
    copy = bytes([128 | 16 | 32]) + struct.pack("<H", half)
    inserts = b"".join(bytes([len(new[k : k + 127])]) + new[k : k + 127] for k in range(0, len(new), 127))
    return size(len(base)) + size(len(target)) + copy + inserts


def test_packed_objects_with_chains_of_deltas(tmp_path):
    base = bytes(range(256)) * 3
    second, third = base[:384] + b"second" * 50, base[:342] + b"third" * 90
    packs = tmp_path / ".git" / "objects" / "pack"
    packs.mkdir(parents=True)
    body, offsets, names = b"PACK" + struct.pack(">II", 2, 4), {}, {}

    def put(kind, data, target, head=b""):
        nonlocal body
        at, n = len(body), len(data)
        first = kind << 4 | n & 15
        n >>= 4
        out = bytearray()
        while n:
            out.append(first | 128)
            first, n = n & 127, n >> 7
        out.append(first)
        body += bytes(out) + head + zlib.compress(data)
        name = hashlib.sha1(b"blob %d\0" % len(target) + target).digest()
        offsets[name], names[target] = at, name
        return at

    first = put(3, base, base)
    at = len(body)
    back = at - first
    code = [back & 127]
    back >>= 7
    while back:
        back -= 1
        code.insert(0, 128 | back & 127)
        back >>= 7
    put(6, _delta(base, second), second, bytes(code))
    put(7, _delta(second, third[:342] + b"third" * 90), third, names[second])
    put(3, b"", b"")
    order = sorted(offsets)
    fan = b"".join(struct.pack(">I", sum(n[0] <= k for n in order)) for k in range(256))
    index = b"\377tOc" + struct.pack(">I", 2) + fan + b"".join(order) + b"\0" * 4 * len(order) + b"".join(struct.pack(">I", offsets[n]) for n in order)
    (packs / "pack-1.pack").write_bytes(body)
    (packs / "pack-1.idx").write_bytes(index)
    objects = history.Objects(str(tmp_path))
    for target, name in names.items():
        assert objects.read(name.hex()) == (3, target)
    with pytest.raises(ValueError, match="no object"):
        objects.read("0" * 40)


@pytest.mark.skipif(shutil.which("git") is None, reason="compares with an outside program")
def test_against_a_packed_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    run("init", "-q")
    for k in range(30):
        (tmp_path / f"d{k % 4}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 4}" / f"f{k}.txt").write_text("".join(f"line {i} of {k}\n" for i in range(200)))
    run("add", "-A")
    run("commit", "-q", "-m", "one")
    run("tag", "-a", "first", "-m", "t")
    for k in range(0, 30, 3):
        path = tmp_path / f"d{k % 4}" / f"f{k}.txt"
        path.write_text(path.read_text() + "more\n")
    run("mv", "d1/f1.txt", "d2/moved.txt")
    run("rm", "-q", "d1/f5.txt")
    run("add", "-A")
    run("commit", "-q", "-m", "two")
    run("gc", "-q", "--aggressive")
    want = set()
    for line in run("diff", "--name-status", "-M100%", "first", "HEAD").splitlines():
        status, *paths = line.split("\t")
        want.add((status[0], paths[-1], paths[0] if len(paths) > 1 else None))
    assert _rows(history.changes(spark, str(tmp_path), "first")) == want and len(want) == 12
