"""One document from many tasks: order, memory of the driver, failures."""

import csv
import json
import os
import resource

import pytest
from pyspark.sql import functions as F

from notelake.operators import export, parse
from notelake.sources.document import write_document
from notelake.sources.vault import view


def test_order_and_signs(spark, tmp_path):
    path = str(tmp_path / "d.json")
    rows = spark.range(1000, numPartitions=7).withColumn("line", F.format_string('{"id": %d, "x": "é\n"}', "id")).select("id", F.replace("line", F.lit("\n"), F.lit("\\n")).alias("line"))
    assert write_document(rows.orderBy(F.desc("id")).select("line"), path, head='{"a": [\n', between=",\n", tail="\n]}\n") == 1000
    assert [r["id"] for r in json.load(open(path, encoding="utf-8"))["a"]] == list(range(999, -1, -1))
    assert write_document(rows.limit(0).select("line"), path, head="[", between=",", tail="]") == 0
    assert open(path, encoding="utf-8").read() == "[]" and os.listdir(tmp_path) == ["d.json"]


def test_csv_as_the_library_writes_it(spark, tmp_path):
    values = [("a", 'say "x", y'), ("b", None), ("c", "two\nlines"), ("d", " é ")]
    export.write_csv_file(spark.createDataFrame(values, "k string, v string").repartition(3).orderBy("k"), str(tmp_path / "t.csv"))
    with open(tmp_path / "t.csv", encoding="utf-8", newline="") as f:
        assert list(csv.reader(f)) == [["k", "v"], *[[k, v or ""] for k, v in values]]


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    rows = spark.range(100, numPartitions=5).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="broken"):
        write_document(rows, str(tmp_path / "d.txt"), between="\n")
    assert os.listdir(tmp_path) == []


def test_a_million_notes(spark, tmp_path):
    """The driver's Python holds no rows: its peak memory stays where it was."""
    base = view(spark, "/root/testdata/sf0.001").limit(1).first()
    many = spark.range(1_000_000).select(F.lit("v").alias("vault"), F.format_string("n%07d", "id").alias("title"), F.format_string("f/n%07d.md", "id").alias("rel_path"), F.lit("some words #tag").alias("content"), F.lit(base.modified).alias("modified"))
    rows = parse.parse_v1(many).select("vault", "name", "rel_path", "word_count", "tags")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    lines = rows.orderBy("name").select(F.to_json(F.struct(*rows.columns)).alias("line"))
    assert write_document(lines, str(tmp_path / "all.json"), head="[\n", between=",\n", tail="\n]\n") == 1_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB
    with open(tmp_path / "all.json", encoding="utf-8") as f:
        n, last = 0, ""
        for line in f:
            if line.startswith("{"):
                name = line[line.index('"name":"') + 8 :][:8]
                assert name > last
                n, last = n + 1, name
    assert n == 1_000_000
