"""A scan lists files in tasks: the driver holds no row for each."""

import os

from spindrift.sources import scan


def _put(root, name, text="x"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_the_plan_names_no_file(spark, tmp_path):
    for k in range(400):
        _put(tmp_path / "r", f"{k % 7}/d{k % 3}/{k}.txt", str(k))
    found = scan.scan(spark, str(tmp_path / "r"))
    assert len(found.inputFiles()) < 150
    assert {(r["path"], r["size"], r["content"]) for r in found.collect()} == {(f"{k % 7}/d{k % 3}/{k}.txt", len(str(k)), str(k)) for k in range(400)}


def test_links_hidden_and_odd_names(spark, tmp_path):
    root = tmp_path / "a b%20"
    for name in ("x+y.py", "deep/er/ü z.py", "_hidden/h.py", ".dot/h.py", "k=1/_x=2/p.py", "empty.txt"):
        _put(root, name, "" if name == "empty.txt" else "v")
    (root / "none").mkdir()
    _put(tmp_path, "out/o.py")
    os.symlink(tmp_path / "out", root / "link")
    os.symlink(tmp_path / "out/o.py", root / "l.py")
    os.symlink(root / "deep", root / "loop")
    os.symlink(root, tmp_path / "root")
    want = {"x+y.py", "deep/er/ü z.py", "k=1/_x=2/p.py"}  # as Spark's file sources have it, empty files are none
    for at in (f"file://{root}", f"{root}/", str(tmp_path / "root")):
        assert {r["path"] for r in scan.scan(spark, at).collect()} == want
    assert [r["path"] for r in scan.scan(spark, str(root), max_files=2).collect()] == sorted(want)[:2]
    (tmp_path / "bare").mkdir()
    assert scan.scan(spark, str(tmp_path / "bare")).count() == 0
