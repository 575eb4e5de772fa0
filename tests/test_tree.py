import os
import time

import pytest
from pyspark.sql import functions as F

from larkspur.sources import tree
from larkspur.sources.tree import _Lister


@pytest.fixture
def large(tmp_path):
    """600 files in 40 folders, 150 of them in one."""
    for k in range(450):
        folder = tmp_path / f"a{k % 8}" / f"b{k % 40}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}{'.py' if k % 3 else '.txt'}").write_text(str(k))
    for k in range(150):
        (tmp_path / f"flat{k}.py").write_text("flat")
    return tmp_path


def test_the_driver_lists_a_bounded_number_of_folders(spark, large, monkeypatch):
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda f: opened.append(f) or scandir(f))
    lister = _Lister({"path": str(large), "extensions": ".py", "folders": "12", "filesPerPartition": "20"})
    parts = lister.parts()
    assert len(opened) <= 12 and any(p.deep for p in parts)
    # the flat folder is cut into shares, every file is in one part
    monkeypatch.undo()
    assert sum(p.folder == str(large) for p in parts) == 8
    rows = [r[1] for p in parts for r in lister.rows(p)]
    assert len(rows) == len(set(rows)) == 450 and set(rows) == {p.relative_to(large).as_posix() for p in tree.walk(str(large), [".py"])}


def test_filters_of_two_scans_don_t_mix(spark, large):
    df = tree.read_tree(spark, str(large), [".py", ".txt"])
    assert df.count() == 600 and df.filter("ext = '.py' AND rel LIKE 'flat1%'").count() == 61
    both = df.filter(F.col("ext") == ".txt").union(df.filter(~F.col("ext").isin(".txt", ".md")))
    assert both.count() == 600 and {r.ext: r["count"] for r in both.groupBy("ext").count().collect()} == {".py": 450, ".txt": 150}


def test_nested_includes_and_exclusions(tmp_path):
    for name in ("a/x.py", "a/in/y.py", "a/in/out/z.py", "b/w.py", ".h/v.py", "a/.u.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    listed = lambda **more: sorted(p.relative_to(tmp_path).as_posix() for p in tree.walk(str(tmp_path), [".py"], **more))
    assert listed() == ["a/.u.py", "a/in/out/z.py", "a/in/y.py", "a/x.py", "b/w.py"]
    assert listed(include=["a", "a/in", "none"], exclude=["a/in/out"]) == ["a/.u.py", "a/in/y.py", "a/x.py"]


def test_a_stream_of_changes_goes_on_after_a_restart(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "deep").mkdir(parents=True)
    (root / "a.py").write_text("one")
    (root / "deep/b.py").write_text("two")
    (root / "c.md").write_text("not asked for")

    def run():
        time.sleep(0.3)
        made = tree.stream_tree(spark, str(root), [".py"], lag=0.1).select("rel", "content")
        made.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.rel, r.content) for r in spark.read.schema("rel string, content string").json(str(tmp_path / "out")).collect())

    first = [("a.py", "one"), ("deep/b.py", "two")]
    assert run() == first
    assert run() == first
    (root / "a.py").write_text("changed")
    old = tmp_path / "old.py"
    old.write_text("moved here")
    os.utime(old, (1, 1))
    old.rename(root / "deep/old.py")
    assert run() == sorted([*first, ("a.py", "changed"), ("deep/old.py", "moved here")])
