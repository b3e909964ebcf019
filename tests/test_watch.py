"""Watching a vault as a stream: what is listed and opened, restarts, states of paths."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from notelake.operators.index import Snapshot
from notelake.sources import changes
from notelake.streaming import watch


@pytest.fixture
def root(tmp_path):
    for p in ("a.md", "sub/b.md", "sub/deep/c.md", "other/d.md", ".obsidian/x.md"):
        (tmp_path / "v" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / p).write_text(f"note {p}")
    old = time.time() - 60
    for d, _, fs in os.walk(tmp_path / "v"):
        for n in [*fs, "."]:
            os.utime(os.path.join(d, n), (old, old))
    return tmp_path / "v"


def reader(root, log):
    return changes.ChangeReader({"path": str(root), "log": str(log)})


def events(r, start, end):
    return sorted((row[2], row[6]) for p in r.partitions({"n": start}, {"n": end}) for row in r.read(p))


def test_unchanged_folders_are_not_listed(root, tmp_path, monkeypatch):
    listed, scandir = [], os.scandir
    monkeypatch.setattr(changes.os, "scandir", lambda p: (isinstance(p, str) and listed.append(os.path.relpath(p, root))) or scandir(p))
    r = reader(root, tmp_path / "log")
    assert r.latestOffset() == {"n": 1} and sorted(listed) == [".", "other", "sub", "sub/deep"]
    assert events(r, 0, 1) == [(p, "added") for p in ("a.md", "other/d.md", "sub/b.md", "sub/deep/c.md")]
    listed.clear()
    assert r.latestOffset() == {"n": 1} and listed == []
    (root / "sub" / "b.md").write_text("changed in place")  # the folder's time stays
    assert r.latestOffset() == {"n": 2} and listed == [] and events(r, 1, 2) == [("sub/b.md", "updated")]
    (root / "sub" / "new.md").write_text("new")
    (root / "other" / "d.md").unlink()
    assert r.latestOffset() == {"n": 3} and sorted(listed) == ["other", "sub"]
    assert events(r, 2, 3) == [("other/d.md", "removed"), ("sub/new.md", "added")]
    # A new reader goes on from the log: what it knows isn't listed again, but for folders that may have changed since.
    listed.clear()
    again = reader(root, tmp_path / "log")
    shutil.rmtree(root / "sub")
    assert again.latestOffset() == {"n": 4} and set(listed) <= {".", "other"}
    assert events(again, 3, 4) == [(p, "removed") for p in ("sub/b.md", "sub/deep/c.md", "sub/new.md")]
    assert events(again, 1, 3) == [("other/d.md", "removed"), ("sub/b.md", "updated"), ("sub/new.md", "added")]


def test_the_log_is_shortened(root, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "WHOLE", 3)
    r = reader(root, tmp_path / "log")
    for i in range(8):
        (root / "a.md").write_text("x" * (i + 1))
        n = r.latestOffset()["n"]
        r.commit({"n": n})
    assert n == 8 and len(os.listdir(tmp_path / "log")) <= 4
    again = reader(root, tmp_path / "log")
    again.latestOffset()
    assert {k: v[3] for k, v in again.known.items()} == {k: v[3] for k, v in r.known.items()}


def test_a_restart_resumes(spark, root, tmp_path, monkeypatch):
    index, state, told = str(tmp_path / "index"), str(tmp_path / "state"), []

    def run():
        q = watch.start_watch(spark, str(root), index, state, report=told.append, available_now=True)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    s = Snapshot(spark, index)
    assert {r.rel_path for r in s.read().collect()} == {"a.md", "sub/b.md", "sub/deep/c.md", "other/d.md"} and told[-1]["updated"] == 4
    first = s.meta()
    (root / "sub" / "b.md").write_text("other words now")
    (root / "a.md").unlink()
    (root / "big.txt").write_text("no note")
    told.clear()
    run()
    assert sum(t["updated"] for t in told) == 1 and sum(t["removed"] for t in told) == 1
    assert {r.rel_path for r in s.read().collect()} == {"sub/b.md", "sub/deep/c.md", "other/d.md"} and s.get("sub/b.md")["top_terms"] == ["now", "other", "words"]
    # The base files of the first batch are still those that count: only the change was written.
    assert s.meta()["base"] == first["base"] or len(s.meta()["deltas"]) == 0
    told.clear()
    run()
    assert told == []


def test_states_of_paths(spark, tmp_path):
    """Each change once, though batches repeat; removed and added again; a removal of what was never there."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", "added", 1), ("b", "removed", 1), ("a", "updated", 2), ("a", "updated", 2), ("c", "added", 2), ("a", "removed", 3), ("a", "added", 4), ("a", "added", 1)]
    schema = "rel_path string, change string, number long, mtime double, length long"
    for i, (p, c, n) in enumerate(rows):
        spark.createDataFrame([(p, c, n, float(n), n)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = watch.path_states(src).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = [(r.rel_path, r.number, r.change, r.times) for r in spark.table("states").orderBy("rel_path", "number").select("rel_path", "number", "change", F.col("times")).collect()]
    assert got == [("a", 1, "added", 1), ("a", 2, "updated", 2), ("a", 3, "removed", 3), ("a", 4, "added", 4), ("c", 2, "added", 1)]
