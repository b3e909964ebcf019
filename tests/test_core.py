"""Note operators on inline inputs with known answers, and all queries against DuckDB at the smallest scale."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from notelake.functions.text import jaccard, lines, round_half_even
from notelake.operators import edits, graph, index, parse, recommend, runs
from notelake.plans.queries import QUERIES, SQL
from notelake.sources import vault
from notelake.streaming import watch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def notes(spark, *texts):
    return spark.createDataFrame([("v", f"f/n{i}.md", f"n{i}", t) for i, t in enumerate(texts)], "vault string, rel_path string, title string, content string")


def test_frontmatter(spark):
    texts = ["---\nkeywords: [alpha, beta, alpha]\nrelated:\n  - gamma\ntitle: x\n- lost\n---\nBody\n", "---\nkeywords: [a]\nno end", "plain", "﻿---\nkeywords: [a]\n---\n", "---\r\naliases: one\r\n---\r\nB"]
    rows = parse.split_frontmatter(notes(spark, *texts)).withColumn("fm", parse.frontmatter(F.col("block"))).orderBy("rel_path").collect()
    assert [r.has_frontmatter for r in rows] == [True, False, False, False, True]
    assert rows[0].fm.keywords == ["alpha", "beta"] and rows[0].fm.related == ["gamma"] and rows[0].fm.aliases is None and rows[0].body == "Body"
    assert rows[4].fm.aliases == ["one"]


def test_links(spark):
    r = notes(spark, "[[note]] [[note|alias]] [[note#section]] [[note.md]] [[ ]] [[#h]]").select(parse.links_v2(F.col("content")).alias("a"), parse.links_v1(F.col("content")).alias("b")).first()
    assert r.a == ["note"] * 4 and sorted(r.b) == ["", "note", "note.md"]


def test_text(spark):
    r = spark.sql("select 'a\r\nb c\n' as x").select(lines(F.col("x")).alias("l"), jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("j"), round_half_even(F.lit(0.0625)).alias("r")).first()
    assert r.l == ["a", "b", "c"] and r.j == 0.5 and r.r == 0.062


def test_vault_source(spark, tmp_path):
    (tmp_path / "note.md").write_text("hello [[_x]]")
    (tmp_path / "_x.MD").write_bytes(b"\xef\xbb\xbfab\xff\r\nc")
    (tmp_path / "large.md").write_text("x" * (1024 * 1024 + 1))
    (tmp_path / "note.txt").write_text("n")
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / ".obsidian" / "config.json").write_text("{}")
    files = vault.scan(spark, str(tmp_path), max_file_mb=1)
    assert vault.skip_counts(files).first().asDict() == {"non_md": 1, "too_large": 1, "no_permission": 0}
    got = {r.title: r for r in vault.notes_of(files).collect()}
    assert set(got) == {"note", "_x"} and got["_x"].content == "﻿ab�\r\nc"
    e = parse.encoding(vault.contents(files)).first()
    assert (e.bom, e.non_utf8, e.eol_crlf, e.eol_none) == (1, 1, 1, 1)
    assert vault.exclude(vault.notes_of(files), [], ["no*"]).count() == 1


def test_quantiles(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (0.1,), (0.1,), (0.1,), (1.0,)], "raw double")
    # Four notes make six pairs, so no pair is zero here.
    q = {r.raw: r.q for r in recommend.quantiles(df, 4).collect()}
    assert q[0.1] == pytest.approx(0.2) and q[0.5] == pytest.approx(0.7) and q[1.0] == 1.0
    assert 0.0 not in q and recommend.quantiles(df.limit(0), 3).first().q == 0.5


def test_recommendations_match_dense_definition(spark):
    d = notes(spark, "alpha beta gamma [[n1]]", "alpha beta delta [[n1]]", "alpha zeta", "omega [[n0]]", "omega psi", "")
    p = parse.parse_v2(d)
    sparse = {(r.l, r.r): round(r.confidence, 12) for r in recommend.pairs(p).collect()}
    dense = {(r.l, r.r): round(r.confidence, 12) for r in recommend.pairs(p, recommend.Scoring(min_related=0.0)).collect()}
    assert len(dense) == 15 and sparse == {k: v for k, v in dense.items() if v >= 0.3}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "u long, v long")
    c = {r.node: r.component for r in graph.components(e).collect()}
    assert c == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_index_and_watch(spark, tmp_path):
    root, at = tmp_path / "v", str(tmp_path / "index")
    root.mkdir()
    for i in range(3):
        (root / f"n{i}.md").write_text(f"note {i}")
    assert watch.update_once(spark, str(root), at)["updated"] == 3
    (root / "n0.md").unlink()
    (root / "n1.md").write_text("longer than before")
    got = watch.update_once(spark, str(root), at)
    assert (got["total"], got["unchanged"], got["updated"], got["removed"], got["hit_rate"]) == (2, 1, 1, 1, 0.5)
    s = index.Snapshot(spark, at)
    assert s.read().count() == 2 and s.fresh(60) and not s.fresh(60, time.time() + 100)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    out = watch.stream_latest(spark, str(tmp_path / "in"), events.schema, "latest")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, watch.latest_state(events).collect()))


def test_apply_and_rollback(tmp_path):
    (tmp_path / "a.md").write_text("A [[old]] [[old#h|x]]\n")
    (tmp_path / "old.md").write_text("---\nkeywords: [k]\n---\nO\n")
    v = edits.Vault(str(tmp_path))
    assert v.acquire("me", 0) and not v.acquire("you", 30) and v.acquire("you", 100)
    items = [
        {"id": "1", "type": "append_related_links_section", "target_path": "a.md", "markdown_block": "## Related\n<!-- " + edits.ANCHOR + " -->\n- [[b]]\n"},
        {"id": "2", "type": "add_frontmatter_fields", "target_path": "old.md", "fields": {"keywords": ["z"], "aliases": ["o"]}},
        {"id": "3", "type": "append_related_links_section", "target_path": "none.md", "markdown_block": ""},
    ]
    log = v.apply(items, "run1")
    assert len(log["changes"]) == 2 and [c["reason"] for c in log["conflicts"]] == ["missing"]
    assert "aliases:\n  - o\n---" in (tmp_path / "old.md").read_text() and "z" not in (tmp_path / "old.md").read_text()
    assert not v.apply(items[:1], "run2")["changes"]
    (tmp_path / "old.md").write_text("edited")
    back = v.rollback("run1")
    assert back["restored"] == ["a.md"] and len(back["conflicts"]) == 1 and (tmp_path / "a.md").read_text().startswith("A [[old]]")
    v.apply([{"id": "4", "type": "rename_note", "target_path": "old.md", "new_title": "new"}], "run3")
    assert (tmp_path / "a.md").read_text() == "A [[new]] [[new#h|x]]\n" and (tmp_path / "new.md").exists()
    with pytest.raises(ValueError):
        v.rollback("run1", item="1", path="a.md")


def test_retention(spark):
    r = spark.createDataFrame([("a", 3600.0, 10), ("b", 1800.0, 10), ("c", 300.0, 10)], "run_id string, mtime double, size long")
    keep = lambda **k: {x.run_id for x in runs.retention(r, 4000.0, **k).where("keep").collect()}
    assert keep(max_runs=2) == {"a", "b"} and keep(max_age=1000) == {"a"} and keep(max_bytes=20) == {"a", "b"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    con.execute(SQL[name])
    cols = [d[0] for d in con.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(r[cols.index(c)] for c in sorted(cols)) for r in con.fetchall()]
    got = [tuple(r[c] for c in sorted(cols)) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert os.path.exists(e.__file__)
