"""The run over a vault from end to end, the control plane and the command line."""

import csv
import json
import os
import time
from datetime import UTC, datetime

import pytest

from notelake.__main__ import main
from notelake.operators import control, edits, run


@pytest.fixture
def root(tmp_path):
    v = tmp_path / "v"
    v.mkdir()
    texts = {
        "alpha-note": "---\nkeywords: [k]\n---\nalpha beta gamma delta #one [[beta]] [[gone]]\n", "beta": "alpha beta gamma delta #one [[alpha-note]]\n", "gamma": "omega psi chi #two\n",
        "delta": "alpha beta gamma delta epsilon #one\n", "empty": "", "crlf": "﻿x\r\ny\r\n",
    }
    for k, t in texts.items():
        (v / f"{k}.md").write_bytes(t.encode())
    (v / "pic.png").write_bytes(b"\x00")
    return v


def test_run_apply_rollback(spark, root, tmp_path, capsys):
    out = tmp_path / "out"
    first = run.run(spark, str(root), str(out))
    assert first["io"]["skipped"] == {"non_md": 1, "too_large": 0, "no_permission": 0} and first["incremental"]["incremental_updated"] == 6 and not first["cache"]["present"]
    folder = out / "runs" / first["run_id"]
    h = json.loads((folder / "health.json").read_text())["stats"]
    assert h == {"total_notes": 6, "frontmatter_notes": 1, "total_links": 3, "broken_link_candidates": 1, "orphan_notes": 4}
    items = json.loads((folder / "action-items.json").read_text())["items"]
    assert [x["id"] for x in items] == [f"act_{i:04d}" for i in range(1, len(items) + 1)]
    assert items[0]["type"] == "create_stub_note" and items[0]["payload"] == {"title": "gone"} and items[0]["reason"]["content_sim"] == 0
    block = next(x for x in items if x["type"].startswith("append") and x["target_path"] == "alpha-note.md")
    assert edits.ANCHOR in block["payload"]["markdown_block"] and block["payload"]["items"][0]["title"] in ("beta", "delta") and block["confidence"] >= 0.3
    meta = next(x for x in items if x["type"] == "add_frontmatter_fields" and x["target_path"] == "alpha-note.md")
    assert "keywords" not in meta["payload"]["fields"] and meta["payload"]["fields"]["aliases"] == ["alpha note"]
    assert "Orphan notes: 4" in (folder / "report.md").read_text()
    again = run.run(spark, str(root), str(out), {"performance": {"fast_path_max_age_sec": 600}}, lang="zh")
    assert again["fast_path"] and again["cache"]["hit_rate"] == 1.0 and "孤立" in (out / "runs" / again["run_id"] / "report.md").read_text()
    slow = run.run(spark, str(root), str(out), {"performance": {"fast_path_max_age_sec": 0}})
    assert not slow["fast_path"] and slow["incremental"]["hit_rate"] == 1.0
    before = {p.name: p.read_bytes() for p in root.glob("*.md")}
    args = ["--vault", str(root), "--out", str(out), "--run-id", first["run_id"], "--config", str(tmp_path / "none")]
    assert main(["apply", *args, "--yes"]) == 0
    assert edits.ANCHOR in (root / "alpha-note.md").read_text() and not (root / ".nosync").exists() and not (root / ".notelake" / "lease.json").exists()
    assert main(["rollback", *args]) == 0 and {p.name: p.read_bytes() for p in root.glob("*.md")} == before
    assert main(["rollback", *args, "--item", "a", "--file", "b"]) == 2
    capsys.readouterr()


def test_memory_guard(spark, root, tmp_path):
    got = run.run(spark, str(root), str(tmp_path / "out"), {"performance": {"max_mem_mb": 0.0001}})
    assert got["downgrades"] == ["recommend_skipped_mem_limit"]


def test_time_budget(spark, root, tmp_path):
    """A budget that is too small gives no part of the recommendations, and says so; one that is large enough changes nothing."""
    full, cut, free = (run.run(spark, str(root), str(tmp_path / f"o{t}"), {"performance": {"timeout_sec": t}}) for t in (300.0, 0.1, 0))
    kinds = lambda t, s: sorted((i["type"], i["target_path"]) for i in json.loads((tmp_path / f"o{t}" / "runs" / s["run_id"] / "action-items.json").read_text())["items"])
    assert cut["downgrades"] == ["recommend_timeout"] and full["downgrades"] == free["downgrades"] == []
    assert {k for k, _ in kinds(0.1, cut)} == {"create_stub_note"} and kinds(300.0, full) == kinds(0, free)
    assert {k for k, _ in kinds(0, free)} > {"create_stub_note"}


def test_jobs_are_cancelled(spark):
    from pyspark.sql import functions as F

    from notelake.operators.budget import TimeOver, limited, pool

    @F.udf("long")
    def nap(x):
        time.sleep(2)
        return x

    began = time.monotonic()
    with pytest.raises(TimeOver), limited(spark, 0.5, "nap"):
        spark.range(64, numPartitions=64).select(nap("id")).collect()
    assert time.monotonic() - began < 12
    with limited(spark, 60), pool(spark, "p"):
        assert spark.range(3).count() == 3 and spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "p"
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None and spark.range(3).count() == 3


def test_empty_vault(spark, tmp_path):
    (tmp_path / "v").mkdir()
    got = run.run(spark, str(tmp_path / "v"), str(tmp_path / "out"))
    assert got["io"]["scanned_files"] == 0 and got["cache"]["hit_rate"] == 0.0


def test_commands(spark, root, tmp_path, capsys):
    common = ["--vault", str(root), "--out", str(tmp_path / "x"), "--config", str(tmp_path / "none")]

    def said(*args):
        assert main([args[0], *args[1:], *common], spark) == 0
        return json.loads(capsys.readouterr().out)

    d = said("doctor")
    assert d["notes"] == 6 and d["encoding"]["utf8_bom"] == 1 and d["line_endings"] == {"lf": 4, "crlf": 1, "mixed": 0, "none": 1}
    assert said("stats")["all"]["total_notes"] == 6
    assert [x["name"] for x in said("search", "--keyword", "OMEGA")] == ["gamma"]
    assert {x["name"] for x in said("orphans")} == {"crlf", "delta", "empty", "gamma"} and said("hubs")[0]["name"] == "alpha-note"
    assert said("quality", "--worst")["summary"]["notes"] == 6
    assert all(x["similarity"] >= 0.3 for x in said("similar", "all")) and isinstance(said("similar", "find", "--note", "beta"), list)
    said("export")
    with open(tmp_path / "x" / "notes.csv", newline="") as f:
        rows = list(csv.reader(f))
    assert len(rows) == 7 and len(rows[0]) == 10 and rows[1][0] == "alpha-note"
    with open(tmp_path / "x" / "links.csv", newline="") as f:
        assert list(csv.reader(f))[1:] == [["alpha-note", "beta", "Bidirectional"], ["beta", "alpha-note", "Bidirectional"]]
    doc = json.loads((tmp_path / "x" / "analysis.json").read_text())
    assert len(doc["all_notes"]) == 6 and doc["statistics"]["tags"]["top_tags"][0] == {"tag": "one", "notes": 3}
    assert "## Grades" in (tmp_path / "x" / "quality.md").read_text()
    assert main(["init-config", str(tmp_path / "c.toml")]) == 0
    made = control.load_config(str(tmp_path / "c.toml"))
    assert control.scoring_of(made) == control.scoring_of({}) and control.setting(made, "apply.git", "policy") == "require_clean" and not control.write_template(str(tmp_path / "c.toml"))


def test_rename(tmp_path):
    (tmp_path / "a.md").write_text("[[old]]\n")
    (tmp_path / "old.md").write_text("[[old#x]]\n")
    (tmp_path / "taken.md").write_text("T")
    v, item = edits.Vault(str(tmp_path)), {"id": "1", "type": "rename_note", "risk_class": "B1", "target_path": "old.md"}
    assert v.apply([item | {"new_title": "taken"}], "r0")["conflicts"][0]["reason"] == "target exists" and (tmp_path / "taken.md").read_text() == "T"
    assert v.apply([item | {"target_path": "no.md", "new_title": "n"}], "r1")["conflicts"][0]["reason"] == "missing"
    v.apply([item | {"new_title": "new"}], "r2")
    assert (tmp_path / "new.md").read_text() == "[[new#x]]\n" and not (tmp_path / "old.md").exists()
    assert not v.rollback("r2")["conflicts"]
    assert (tmp_path / "a.md").read_text() == "[[old]]\n" and (tmp_path / "old.md").read_text() == "[[old#x]]\n" and not (tmp_path / "new.md").exists()


def test_risk_class(tmp_path):
    (tmp_path / "a.md").write_text("A")
    item = {"id": "1", "type": "add_frontmatter_fields", "risk_class": "read-only", "target_path": "a.md", "payload": {"fields": {"keywords": ["x"]}}}
    assert edits.Vault(str(tmp_path)).apply([item])["changes"] == []


def test_locks(tmp_path):
    p, now = tmp_path / "l.json", datetime(2024, 1, 1, tzinfo=UTC)
    look = lambda text: (p.write_text(text), control.check_lock(str(p), now))[1]
    assert control.check_lock(str(p), now)["details"] == "missing" and look("{")["details"] == "unreadable" and look("[]")["details"] == "unknown"
    assert look('{"expires_at": "2023-12-31T00:00:00Z"}')["stale"] is True and look('{"expiresAt": "2024-01-02"}')["stale"] is False
    assert look('{"created_at": "2023-12-31T23:59:00+00:00", "ttl_sec": 30}')["stale"] is True and look('{"createdAt": "2023-12-31T23:59:50Z", "ttlSec": "30"}')["stale"] is False


def test_prune(spark, tmp_path):
    now = time.time()
    for name, age in (("a", 40 * 86400), ("b", 20 * 86400), ("c", 300)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run-log.json").write_text("x" * 1000)
        for q in (tmp_path / name / "run-log.json", tmp_path / name):
            os.utime(q, (now - age, now - age))
    assert control.prune(spark, str(tmp_path), {"storage": {"auto_prune": False}}, now)["removed"] == 0
    got = control.prune(spark, str(tmp_path), {"storage": {"compress_runs": True}}, now)
    assert (got["removed"], got["compressed"]) == (1, 1) and sorted(x.name for x in tmp_path.iterdir()) == ["b.zip", "c"]
    assert control.prune(spark, str(tmp_path / "none"))["removed"] == 0


def test_git_policy(tmp_path):
    r = str(tmp_path)
    if control.git(r, "init") is None:
        pytest.skip("no git")
    for k, v in (("user.name", "t"), ("user.email", "t@example.org")):
        control.git(r, "config", k, v)
    (tmp_path / "a.md").write_text("a")
    assert control.GitPolicy(r).before() == 10
    control.git(r, "add", "-A")
    control.git(r, "commit", "-m", "one")
    assert control.GitPolicy(r).before() == 0
    (tmp_path / "a.md").write_text("b")
    p = control.GitPolicy(r, "auto_stash")
    assert p.before() == 0 and (tmp_path / "a.md").read_text() == "a" and p.after([], "") == 0 and (tmp_path / "a.md").read_text() == "b"
    assert control.GitPolicy(r, "none", True).after(["a.md"], "two") == 0 and control.git(r, "log", "--format=%s").split() == ["two", "one"]
