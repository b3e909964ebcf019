"""Edits of notes: columns against the plain functions, inverse edits, renames together, the ways of apply, and what a rerun opens."""

import itertools
import json
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from notelake.__main__ import main
from notelake.operators import control, edits, index, parse, quality, similarity
from notelake.sources import vault
from notelake.streaming import watch

MARK = f"<!-- {edits.ANCHOR} -->"
TEXTS = [
    "", "plain", "plain\n", "---\nkeywords: [a]\n---\nbody\n", "---\nkeywords:\n  - a\n  - b\n\n  deep: x\nother: 1\n- item\naliases: z\n---\nB", "---\nno end\n", "---\n---\n",
    f"a\n## Related\n{MARK}\n- [[x]]\n-y\n\nrest\n", f"{MARK}\n\n\nx", f"t\n{MARK}\n- a", f"# One\n{MARK}\ntext\n", f" {MARK}\n", "a\r\nb\x0bc\n", f"### H\r\n{MARK}\r\n  - a\r\n \r\nz",
    "[[old]] [[old|x]] [[Old]] [[ old.MD #h|y#z]] [[a|old]] [[]] [[[old]]] [[old#h]] $1 \\ [[b]]",
]


#: What an edit makes of TEXTS[i], where it isn't the text itself.
WANT = {
    "removed": {7: 'a\nrest\n', 8: '\nx', 9: 't', 10: '# One\ntext\n', 13: 'z'},
    "bare": {3: '---\n---\nbody\n', 4: '---\nother: 1\n- item\n---\nB'},
    "renamed": {14: '[[new $0]] [[new $0|x]] [[Old]] [[new $0#h|y#z]] [[a|old]] [[]] [[[new $0]]] [[new $0#h]] $1 \\ [[c]]'},
    "fields": {0: '---\nkeywords:\n  - k\naliases:\n  - q\\"uote\n  - "a: b"\n  - "c#d"\n---', 1: '---\nkeywords:\n  - k\naliases:\n  - q\\"uote\n  - "a: b"\n  - "c#d"\n---\nplain', 3: '---\nkeywords: [a]\naliases:\n  - q\\"uote\n  - "a: b"\n  - "c#d"\n---\nbody\n', 4: '---\nkeywords:\n  - a\n  - b\n\n  deep: x\nother: 1\n- item\naliases: z\n---\nB', 5: '---\nkeywords:\n  - k\naliases:\n  - q\\"uote\n  - "a: b"\n  - "c#d"\n---\n---\nno end\n', 6: '---\nkeywords:\n  - k\naliases:\n  - q\\"uote\n  - "a: b"\n  - "c#d"\n---\n', 14: '---\nkeywords:\n  - k\naliases:\n  - q\\"uote\n  - "a: b"\n  - "c#d"\n---\n[[old]] [[old|x]] [[Old]] [[ old.MD #h|y#z]] [[a|old]] [[]] [[[old]]] [[old#h]] $1 \\ [[b]]'},
}


def test_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    fields = {"keywords": ["k"], "aliases": ['q"uote', "a: b", "c#d"], "related": []}
    names = {"old": "new $0", "b": "c"}
    cols = {
        "removed": edits.remove_block(F.col("t")), "added": edits.append_block(F.col("t"), F.lit(edits.ANCHOR), F.lit(f"{MARK}\n- z\n")),
        "fields": edits.add_fields(F.col("t"), {k: F.array(*map(F.lit, v)).cast("array<string>") for k, v in fields.items()}),
        "bare": edits.remove_keys(F.col("t"), ["keywords", "aliases"]), "renamed": edits.rename_links(F.col("t"), F.create_map(*[F.lit(x) for kv in names.items() for x in kv])),
    }
    got = df.select("i", "t", *[c.alias(k) for k, c in cols.items()]).collect()
    for r in got:
        assert r.added == (r.t if edits.ANCHOR in r.t else r.t + ("" if r.t.endswith("\n") else "\n") + f"{MARK}\n- z\n")
        for k in ("removed", "bare", "renamed"):
            assert r[k] == WANT[k].get(r.i, r.t), (k, r.t)
        if r.i in WANT["fields"]:
            assert r.fields == WANT["fields"][r.i]
    # The same edits on the texts of files, and the inverse ones.
    files = edits.edited(spark, [{"text": r.t, "fields": fields} for r in got])
    assert [t for t, _ in files] == [r.fields for r in got] and all("related" not in k for _, k in files)
    back = edits.edited(spark, [{"text": t, "drop": k} for t, k in files if k])
    assert all("q\\" not in t for t, _ in back)
    plain = [r for r in got if edits.ANCHOR not in r.t and r.t.endswith("\n")]
    assert [t for t, _ in edits.edited(spark, [{"text": r.added, "without": edits.ANCHOR} for r in plain])] == [r.t if "\r" not in r.t and "\x0b" not in r.t else "a\nb\nc\n" for r in plain]
    assert edits.edited(spark, []) == []


def test_rename_all_touches_only_what_changes(spark):
    df = spark.createDataFrame([("v", "a.md", "[[x]] [[y]]"), ("v", "b.md", "none"), ("w", "a.md", "[[x]]")], "vault string, rel_path string, content string")
    renames = spark.createDataFrame([("v", "x", "X1"), ("v", "y", "Y1")], "vault string, old string, new string")
    assert [tuple(r) for r in edits.rename_all(df, renames).collect()] == [("v", "a.md", "[[X1]] [[Y1]]")]


def test_one_of_two_items_goes_back(tmp_path):
    (tmp_path / "n.md").write_text("text\n")
    items = [
        {"id": "1", "type": "append_related_links_section", "target_path": "n.md", "payload": {"anchor": edits.ANCHOR, "markdown_block": f"## Related\n{MARK}\n- [[b]] (0.50)\n"}},
        {"id": "2", "type": "add_frontmatter_fields", "target_path": "n.md", "payload": {"fields": {"keywords": ["k"], "aliases": ["a"]}}, "dependencies": ["1", "9"]},
    ]
    v = edits.Vault(str(tmp_path))
    v.apply(items, "r")
    got = v.rollback("r", item="1")
    assert got["restored"] == ["n.md"] and not got["conflicts"]
    assert (tmp_path / "n.md").read_text() == "---\nkeywords:\n  - k\naliases:\n  - a\n---\ntext\n"
    assert v.rollback("r", item="1")["conflicts"][0]["reason"] == "anchor missing" and v.rollback("r", item="no")["conflicts"][0]["reason"] == "no such change"
    got = v.rollback("r", path="n.md")
    assert [c["reason"] for c in got["conflicts"]] == ["anchor missing"] and got["missing_dependencies"] == ["9"]
    assert (tmp_path / "n.md").read_text() == "---\n---\ntext\n"  # keys go, the rules stay


def test_renames_go_together(tmp_path):
    for k, t in {"a": "[[b]] [[c|x]]", "b": "[[a]]", "c": ""}.items():
        (tmp_path / f"{k}.md").write_text(t)
    (tmp_path / "D.MD").write_text("[[b.md#h]]")
    v = edits.Vault(str(tmp_path))
    item = lambda i, s, t: {"id": i, "type": "rename_note_and_update_links", "risk_class": "B1", "target_path": s, "payload": {"source_path": s, "target_path": t}}
    assert v.apply([item("1", "a.md", "x/A.md"), item("2", "b.md", "c.md")], "r0")["changes"] == [] and (tmp_path / "a.md").exists()
    log = v.apply([item("1", "a.md", "x/A.md"), item("2", "b.md", "B.md")], "r1")
    assert not log["conflicts"] and (tmp_path / "x" / "A.md").read_text() == "[[B]] [[c|x]]" and (tmp_path / "B.md").read_text() == "[[A]]" and (tmp_path / "D.MD").read_text() == "[[B#h]]"
    assert not v.rollback("r1")["conflicts"] and (tmp_path / "b.md").read_text() == "[[a]]" and (tmp_path / "a.md").exists()


def test_prompts():
    items = [{"id": str(i), "type": "t", "target_path": f"f{i % 2}"} for i in range(30)]
    said, answers = [], iter(["what", "preview", "YES"])
    assert edits.confirm(items, lambda _: next(answers), said.append) and said[0] == "30 actions in 2 files" and len(said) == 3 + 20
    assert not edits.confirm(items, lambda _: "n", said.append) and edits.starved(lambda _, a=iter(["x", "append"]): next(a)) == "append"


def test_busy_vault(spark, tmp_path, monkeypatch, capsys):
    root, out = tmp_path / "v", tmp_path / "out" / "runs" / "r"
    root.mkdir()
    out.mkdir(parents=True)
    (root / "n.md").write_text("x")
    items = [{"id": "1", "type": "add_frontmatter_fields", "risk_class": "A", "target_path": "n.md", "payload": {"fields": {"keywords": ["k"]}}}]
    items.append({"id": "2", "type": "append_related_links_section", "risk_class": "A", "target_path": "n.md", "payload": {"markdown_block": f"{MARK}\n"}})
    (out / "action-items.json").write_text(json.dumps({"items": items}))
    monkeypatch.setattr(control, "wait_quiet", lambda *_, **__: False)
    monkeypatch.setattr(edits, "starved", lambda: "abort")
    args = ["apply", "--vault", str(root), "--out", str(tmp_path / "out"), "--run-id", "r", "--config", str(tmp_path / "none")]
    assert main(args, spark) == 11 and (root / "n.md").read_text() == "x"
    assert main([*args, "--yes"], spark) == 0 and (root / "n.md").read_text() == f"x\n{MARK}\n"
    monkeypatch.setattr(control, "wait_quiet", lambda *_, **__: True)
    monkeypatch.setattr(edits, "confirm", lambda _: False)
    assert main(args, spark) == 0 and "keywords" not in (root / "n.md").read_text()
    assert main([*args, "--yes"], spark) == 0 and "keywords" in (root / "n.md").read_text()
    capsys.readouterr()


def test_unchanged_files_are_not_opened(spark, tmp_path):
    root, at = tmp_path / "v", str(tmp_path / "index")
    (root / "a" / "b" / "c").mkdir(parents=True)
    for p in ("x.md", "a/y.md", "a/b/z.md", "a/b/c/w.md"):
        (root / p).write_text("old words")
    assert watch.update_once(spark, str(root), at)["updated"] == 4
    st = os.stat(root / "x.md")
    (root / "x.md").write_text("new words")  # same size; with its old time it isn't read again
    os.utime(root / "x.md", ns=(st.st_atime_ns, st.st_mtime_ns))
    (root / "a" / "y.md").write_text("longer than before")
    got = watch.update_once(spark, str(root), at)
    assert (got["unchanged"], got["updated"]) == (3, 1)
    s = index.Snapshot(spark, at)
    assert s.get("x.md")["top_terms"] == ["old", "words"] and s.get("a/y.md")["top_terms"] == ["before", "longer", "than"] and s.get("none") is None


def test_a_crash_keeps_the_index(spark, tmp_path):
    s = index.Snapshot(spark, str(tmp_path / "index"))
    rows = lambda n: spark.range(n).selectExpr("cast(id as string) as rel_path")
    assert s.meta() is None and s.read() is None
    s.write(rows(1), 5.0)
    s._point, keep = (lambda *_: (_ for _ in ()).throw(OSError)), s._point
    with pytest.raises(OSError):
        s.write(rows(2), 6.0)
    assert s.read().count() == 1 and s.meta()["last_updated"] == 5.0
    s._point = keep
    for n in (3, 4):
        s.write(rows(n))
    assert s.read().count() == 4 and len([x for x in os.listdir(tmp_path / "index") if x.startswith("base-")]) == 2


def test_scan_throttle(monkeypatch):
    naps = []
    monkeypatch.setattr(vault.time, "sleep", naps.append)
    monkeypatch.setattr(vault.time, "monotonic", lambda: 100.0)
    for done in (1, 2, 3):
        vault.throttle(done, 100.0, 0.002, 0)
        vault.throttle(done, 100.0, 0, 2.0)
        vault.throttle(done, 90.0, 0, 2.0)
    assert naps == [0.002, 0.5, 0.002, 1.0, 0.002, 1.5]


def test_a_throttled_scan_takes_its_time(spark, tmp_path):
    for n in ("a.md", "b.md", "c.txt"):
        (tmp_path / n).write_text("x")
    began = time.monotonic()
    assert vault.scan(spark, str(tmp_path), max_files_per_sec=2).count() == 3 and time.monotonic() - began > 1.4


def test_configuration(tmp_path):
    root = tmp_path / "v"
    root.mkdir()
    own, near = root / "notelake.toml", tmp_path / "notelake.toml"
    near.write_text("[storage]\nmax_run_logs = 7\nauto_prune = 'off'\n")
    assert control.load_config(str(near), str(root))["storage"]["max_run_logs"] == 7
    own.write_text("[storage]\ncompress_runs = 'Yes'\nmax_run_days = '12'\nmax_total_mb = 'x'\n[scoring]\nw_content = 1\n")
    c = control.load_config(str(near), str(root))
    get = lambda k: control.setting(c, "storage", k)
    assert (get("max_run_logs"), get("compress_runs"), get("max_run_days"), get("max_total_mb")) == (50, True, 12, 200) and control.scoring_of(c).w_content == 1.0
    assert not control.setting(control.load_config(str(near)), "storage", "auto_prune") and control.load_config(str(tmp_path / "no")) == {}
    (tmp_path / "env.sh").write_text("# c\nexport A=\"x y\"\nexport B='z'\nC=1\nexport D\n")
    assert control.load_env(str(tmp_path / "env.sh")) == {"A": "x y", "B": "z"} and control.load_env("none") == {}


def test_titles_of_two_vaults(spark):
    rows = [("A", "same.md", "same", "[[other]] #t red fox jumps"), ("B", "same.md", "same", "[[other]] red fox jumps"), ("B", "other.md", "other", "word red fox"), ("B", "x/same.md", "same", "later [[none]]")]
    n = parse.parse_v1(spark.createDataFrame([(*r, None) for r in rows], "vault string, rel_path string, title string, content string, modified timestamp_ntz"))
    assert sorted((r.vault, r.name, r.rel_path) for r in n.collect()) == [("A", "same", "same.md"), ("B", "other", "other.md"), ("B", "same", "x/same.md")]
    plan = n.select("vault", "name", "tags")._jdf.queryExecution().executedPlan().toString()
    sent = plan[plan.index("Exchange") :].splitlines()[0]
    assert "content" not in sent
    scored = quality.scores(n.withColumn("modified", F.lit("2024-06-01").cast("timestamp_ntz")), "2024-06-30")
    assert {r.vault for r in quality.find_notes(scored, "same").collect()} == {"A", "B"} and [r.name for r in quality.find_notes(scored, "THE").collect()] == ["other"]


@pytest.mark.parametrize("minimum", [0.1, 0.3, 0.5])
def test_similar_pairs_lose_none(spark, minimum):
    """Against all pairs: notes without common words, with and without title words and tags."""
    import random

    rnd = random.Random(3)
    w = ["red", "fox", "blue", "sea", "hill", "boat", "tree", "sun"]
    rows = [(rnd.choice("AB"), f"{i}.md", " ".join(rnd.sample(w, 2)) + f" {i}", " ".join(rnd.choice(w) + rnd.choice(["", "x", "y"]) for _ in range(rnd.choice([0, 1, 3, 9]))) + "".join(f" #t{k}" for k in rnd.sample(range(4), rnd.randint(0, 3)))) for i in range(60)]
    n = parse.parse_v1(spark.createDataFrame(rows, "vault string, rel_path string, title string, content string"))
    weight, sets = {}, {(r.vault, r.name): (set(r.tw), set(r.tg)) for r in similarity._sets(n).collect()}
    for r in similarity.vectors(n).collect():
        weight.setdefault((r.vault, r.name), {})[r.word] = r.weight
    share = lambda a, b: len(a & b) / len(a | b) if a and b else 0
    unit = {k: {w: x / math.hypot(*v.values()) for w, x in v.items() if x} for k, v in weight.items()}
    want = {}
    for (v, a), (u, b) in itertools.combinations(sorted(sets), 2):
        if u == v:
            x, y = unit.get((v, a), {}), unit.get((v, b), {})
            cosine = round(sum(x[w] * y[w] for w in x if w in y), 9)
            score = round(cosine * 0.6 + share(sets[v, a][0], sets[v, b][0]) * 0.2 + share(sets[v, a][1], sets[v, b][1]) * 0.2, 9)
            if score >= minimum:
                want[v, a, b] = score
    assert want and {(r.vault, r.l, r.r): round(r.similarity, 9) for r in similarity.similar_pairs(n, minimum).collect()} == want
    # The same in many small blocks, and as sums.
    small = similarity.AllPairs(n, size=7)
    assert {(r.part, r.l, r.r): round(r.similarity, 9) for r in small.pairs(minimum).collect()} == want
    s, all_rows = small.stats(minimum).first(), similarity.stats(similarity.similar_pairs(n, minimum)).first()
    assert [round(x, 9) for x in s] == [round(x, 9) for x in all_rows] and s.pairs == len(want)
