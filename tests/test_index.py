"""The index: what an update writes, what a lookup reads, compaction, and writers at once."""

import os

import pytest
from pyspark.sql import functions as F

from notelake.operators import index


def rows(spark, paths, text="old"):
    return spark.createDataFrame([(p, 1.0, len(text), text) for p in paths], "rel_path string, mtime double, size long, text string")


def size(folder, kind):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) if f"/{kind}-" in d for f in fs if f.endswith(".parquet"))


def content(s):
    return {r.rel_path: r.text for r in s.read().collect()}


def test_changes_are_merged_on_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 100)
    monkeypatch.setattr(index, "MOST_SHARE", 1.0)
    s = index.Snapshot(spark, str(tmp_path / "i"))
    s.write(rows(spark, [f"n{i}" for i in range(1000)]))
    assert s.meta()["buckets"] == 10 and len(s.meta()["base"]) == 10
    base = size(tmp_path / "i", "base")
    want = {f"n{i}": "old" for i in range(1000)}
    for k in range(3):
        new = [f"n{k}", f"x{k}"]
        s.apply(rows(spark, new, f"new{k}"), rows(spark, [f"n{500 + k}"]).select("rel_path"), s.meta())
        want |= dict.fromkeys(new, f"new{k}")
        del want[f"n{500 + k}"]
    assert content(s) == want and size(tmp_path / "i", "base") == base and len(s.meta()["deltas"]) == 3
    # A path that has gone may come back.
    s.apply(rows(spark, ["n500"], "again"), rows(spark, []).select("rel_path"), s.meta())
    assert s.get("n500")["text"] == "again" and s.get("n501") is None and s.get("n0")["text"] == "new0" and s.get("x2")["text"] == "new2" and s.get("none") is None


def test_only_touched_buckets_are_written_anew(spark, tmp_path, monkeypatch):
    for k, v in (("BUCKET_ROWS", 50), ("MOST_DELTAS", 2), ("MOST_SHARE", 100.0)):
        monkeypatch.setattr(index, k, v)
    s = index.Snapshot(spark, str(tmp_path / "i"))
    s.write(rows(spark, [f"n{i}" for i in range(1000)]))
    first = s.meta()["base"]
    for k in range(3):
        s.apply(rows(spark, ["n7"], f"v{k}"), rows(spark, ["n8"]).select("rel_path"), s.meta())
    m = s.meta()
    assert m["deltas"] == [] and 1 <= sum(m["base"][b] != f for b, f in first.items()) <= 2
    assert content(s) == {f"n{i}": "v2" if i == 7 else "old" for i in range(1000) if i != 8}
    for _ in range(2):
        s.apply(rows(spark, ["n9"]), None, s.meta())
    named = {*s.meta()["base"].values(), *s.meta()["deltas"]}
    assert {x for x in os.listdir(tmp_path / "i") if x.startswith(("base-", "delta-"))} == named


def test_a_lookup_reads_one_row_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 20_000)
    s = index.Snapshot(spark, str(tmp_path / "i"))
    many = spark.range(200_000).select(F.concat(F.lit("folder/"), F.sha2(F.col("id").cast("string"), 256)).alias("rel_path"), F.lit(1.0).alias("mtime"), F.lit(1).cast("long").alias("size"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("text"))
    s.write(many)
    path = many.where("id = 77777" if "id" in many.columns else "true").first().rel_path
    d = s.found(path)
    assert len(d.inputFiles()) == 1 and d.count() == 1
    plan = d._jdf.queryExecution()
    assert d.collect()[0].rel_path == path
    scan = plan.executedPlan().collectLeaves().head()
    metrics = {str(k): scan.metrics().apply(k).value() for k in ("numFiles", "numOutputRows")}
    # Of a file of about 20,000 rows, one row group of few MB is read, not the whole.
    assert metrics["numFiles"] == 1 and 0 < metrics["numOutputRows"] < 20_000, metrics
    assert s.get("folder/none") is None


def test_the_later_of_two_writers_raises(spark, tmp_path):
    s, t = (index.Snapshot(spark, str(tmp_path / "i")) for _ in range(2))
    s.write(rows(spark, ["a", "b"]))
    before = t.meta()
    s.apply(rows(spark, ["a"], "s"), None, s.meta())
    with pytest.raises(index.ConcurrentUpdate):
        t.apply(rows(spark, ["b"], "t"), None, before)
    assert content(s) == {"a": "s", "b": "old"} and not [x for x in os.listdir(tmp_path / "i") if x.startswith("next-")]


def test_without_rows(spark, tmp_path):
    s = index.Snapshot(spark, str(tmp_path / "i"))
    s.write(rows(spark, []))
    assert s.read().count() == 0 and s.get("a") is None
    s.apply(rows(spark, ["a"]), None, s.meta())
    assert content(s) == {"a": "old"}
    s.apply(rows(spark, []), rows(spark, ["a"]).select("rel_path"), s.meta())
    assert content(s) == {}
