"""Whole jobs where a part was left out before."""

from itertools import combinations
from math import log, sqrt

import pytest

from notelake.operators import export, parse, recommend, run, similarity
from notelake.plans.queries import QUERIES
from notelake.sources.vault import view
from notelake.streaming import watch

SF = "/root/testdata/sf0.001"


def test_similar_pairs_from_default_minimum(spark):
    texts = {"red apple": "alpha beta gamma", "red pear": "alpha beta delta", "red plum": "omega psi", "red fig": "", "blue sky": "alpha chi", "blue sea": "omega psi chi"}
    tags = {"red apple": ["x"], "red pear": ["x", "y"], "red plum": ["x"], "red fig": ["x"], "blue sky": [], "blue sea": ["y"]}
    df = spark.createDataFrame([("v", k, v, tags[k]) for k, v in texts.items()], "vault string, name string, content string, tags array<string>")
    words = {k: v.split() for k, v in texts.items()}
    weight = {k: {w: 1 / len(ws) * log(len(words) / sum(w in x for x in words.values())) for w in ws} for k, ws in words.items()}
    share = lambda a, b: len(set(a) & set(b)) / len({*a, *b}) if a and b else 0
    want = {}
    for a, b in combinations(sorted(texts), 2):
        u, v = weight[a], weight[b]
        size = sqrt(sum(x * x for x in u.values())) * sqrt(sum(x * x for x in v.values()))
        s = 0.6 * (sum(u[w] * v[w] for w in u if w in v) / size if size else 0) + 0.2 * share(a.split(), b.split()) + 0.2 * share(tags[a], tags[b])
        assert abs(s - 0.3) > 1e-6
        if s >= 0.3:
            want[a, b] = round(s, 9)
    got = {(r.l, r.r): round(r.similarity, 9) for r in similarity.similar_pairs(df).collect()}
    assert got == want and any(s < 0.45 for s in want.values())


@pytest.mark.parametrize("name", ["similar_pairs", "similar_stats", "related_unlinked", "confidence_pairs"])
def test_registered_from_default_minimum(spark, name):
    narrow, whole = QUERIES[name](spark, SF), QUERIES[f"{name}_all"](spark, SF)
    if name == "similar_stats":
        a, b = narrow.first(), whole.first()
        assert b.pairs > a.pairs and 300_000 <= b.lowest < 450_000 and (b.high, b.medium, b.highest) == (a.high, a.medium, a.highest)
    else:
        a, b = set(narrow.collect()), set(whole.collect())
        assert a < b


def test_stream_reads_all_or_raises(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming import StreamingQuery

    events = spark.read.parquet(f"{SF}/events.parquet").limit(60)
    events.repartition(12).write.parquet(str(tmp_path / "in"))
    with pytest.raises(TimeoutError):
        watch.stream_latest(spark, str(tmp_path / "in"), events.schema, "cut", timeout=1)
    limits, wait = [], StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda q, timeout=None: limits.append(timeout) or wait(q, timeout))
    out = watch.stream_latest(spark, str(tmp_path / "in"), events.schema, "whole")
    assert limits == [None] and out.agg({"events": "sum"}).first()[0] == 60


def test_report_lists_all_merges(spark, tmp_path, monkeypatch):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "n.md").write_text("note")
    merged = spark.createDataFrame([(f"c{i:02}", [f"a{i}.md", f"b{i}.md"], 0.9) for i in range(25)], "component string, candidates array<string>, average_confidence double")
    monkeypatch.setattr(recommend, "merges", lambda *_: merged)
    monkeypatch.setattr(run, "items", lambda *_: spark.createDataFrame([], "id string, number long, reason string, payload string"))
    s = run.run(spark, str(tmp_path / "v"), str(tmp_path / "o"))
    text = (tmp_path / "o" / "runs" / s["run_id"] / "report.md").read_text()
    assert [f"- a{i}.md, b{i}.md (0.9)" in text for i in range(25)] == [True] * 25


def test_knowledge_report_sections(spark):
    text = export.report(parse.parse_v1(view(spark, SF)).limit(40), "2024-06-30 00:00:00", orphans=1)
    for head in ("Top tags", "Hubs", "Most linked", "Orphans, last changed first", "Changed within", "Actions"):
        assert f"## {head}\n- " in text
