"""Command line: python -m notelake COMMAND. Answers are JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from notelake.operators import control, edits, export, graph, quality, similarity, stats
from notelake.operators.edits import Vault
from notelake.operators.parse import parse_v1
from notelake.operators.run import doctor, run
from notelake.sources.vault import exclude, notes_of, scan
from notelake.streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notelake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "doctor", "watch", "apply", "rollback", "prune", "stats", "search", "orphans", "hubs", "popular", "quality", "similar", "export"):
        s = sub.add_parser(name)
        s.add_argument("--vault", nargs="+", required=True, help="one or more vaults")
        s.add_argument("--config", default="notelake.toml")
        s.add_argument("--out", default="reports")
        s.add_argument("--lang")
        s.add_argument("--top", type=int)
        s.add_argument("--as-of", default=datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))
        s.add_argument("--run-id")
        if name == "watch":
            s.add_argument("--interval", type=float, default=5)
            s.add_argument("--once", action="store_true")
        if name == "apply":
            s.add_argument("--yes", action="store_true", help="don't ask")
            s.add_argument("--append-only", action="store_true", help="related sections only")
        if name == "rollback":
            s.add_argument("--item")
            s.add_argument("--file")
        if name == "search":
            s.add_argument("--keyword")
            s.add_argument("--tags", default="")
            s.add_argument("--min-links", type=int)
            s.add_argument("--max-links", type=int)
        if name == "quality":
            s.add_argument("--worst", action="store_true")
            s.add_argument("--grade", help="kept after the limit")
            s.add_argument("--note", help="exact name, else part of one")
            s.add_argument("--issues", action="store_true", help="the weakest notes and what to mend")
        if name == "similar":
            s.add_argument("what", choices=["find", "duplicates", "unlinked", "merge", "all"])
            s.add_argument("--note")
            s.add_argument("--threshold", type=float)
    sub.add_parser("init-config").add_argument("path", nargs="?", default="notelake.toml")
    return p


def _apply(a, config: dict) -> tuple[int, dict]:
    """Codes: 0 done, 2 conflicts, 10 dirty tree, 11 no quiet window, 12 lease held by another, 20 stash failed. Where the vault never gets quiet,
    related sections alone can still be applied: at once with --yes, else as answered."""
    root, run_id = a.vault[0], a.run_id
    vault, policy = Vault(root), control.GitPolicy(root, control.setting(config, "apply.git", "policy"), control.setting(config, "apply.git", "auto_commit"))
    if code := policy.before():
        return code, {"error": "working tree not clean"}
    try:
        append_only = a.append_only
        if not control.wait_quiet(root, most=control.setting(config, "apply", "max_wait_sec")):
            choice = "append" if a.yes else edits.starved()
            if choice == "abort":
                return 11, {"error": "vault is busy"}
            append_only = append_only or choice == "append"
        doc = json.loads((Path(a.out) / "runs" / run_id / "action-items.json").read_text(encoding="utf-8"))
        chosen = vault.chosen(doc["items"], append_only)
        if not a.yes and not edits.confirm(chosen):
            return 0, {"applied": 0, "conflicts": []}
        if not vault.acquire(f"apply-{run_id}"):
            return 12, {"error": "lease held"}
        marker = Path(root) / control.setting(config, "apply", "offline_lock_marker")
        made = not marker.exists()
        marker.touch()
        try:
            log = vault.apply(chosen, run_id, append_only)
        finally:
            vault.release(f"apply-{run_id}")
            if made and control.setting(config, "apply", "offline_lock_cleanup"):
                marker.unlink(missing_ok=True)
    except BaseException:
        policy.after([], "")
        raise
    code = policy.after(sorted({c["path"] for c in log["changes"]}), f"Apply {run_id}")
    return code or (2 if log["conflicts"] else 0), {"applied": len(log["changes"]), "conflicts": log["conflicts"]}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    if a.command == "init-config":
        say({"path": a.path, "created": control.write_template(a.path)})
        return 0
    config, root = control.load_config(a.config, a.vault[0]), a.vault[0]
    if a.command in ("apply", "rollback") and not a.run_id or a.command == "rollback" and a.item and a.file:
        say({"error": "name a run, and an item or a file, not both"})
        return 2
    if a.command == "apply":
        code, told = _apply(a, config)
        say(told)
        return code
    if a.command == "rollback":
        told = Vault(root).rollback(a.run_id, a.item, a.file)
        say(told)
        return 20 if told["conflicts"] else 0
    spark = spark or SparkSession.builder.appName("notelake").getOrCreate()
    if a.command == "run":
        say(run(spark, root, a.out, config, a.lang) | {"pruned": control.prune(spark, str(Path(a.out) / "runs"), config)})
    elif a.command == "doctor":
        say(doctor(spark, root, [str(Path(root) / ".notelake" / "lease.json")], control.setting(config, "scan", "max_file_mb")))
    elif a.command == "watch":
        watch(spark, root, str(Path(a.out) / "index"), a.interval, a.once, say)
    elif a.command == "prune":
        say(control.prune(spark, str(Path(a.out) / "runs"), config))
    else:
        _analyse(a, spark, say)
    return 0


#: Rows shown where --top isn't given.
LIMITS = {"find": 5, "duplicates": 20, "unlinked": 20, "merge": 10, "all": 20}


def _analyse(a, spark: SparkSession, say) -> None:
    env = control.load_env("notelake.env.sh")
    listed = lambda key, default: [x.strip() for x in env.get(key, default).split(",") if x.strip()]
    notes = notes_of(scan(spark, *a.vault)).withColumn("modified", F.col("modified").cast("timestamp_ntz"))
    n = parse_v1(exclude(notes, listed("EXCLUDE_FOLDERS", ".obsidian,.trash"), listed("EXCLUDE_NOTES", "")))
    top = a.top or LIMITS.get(getattr(a, "what", ""), 10)
    rows = lambda d: say([r.asDict(True) for r in d.limit(top).collect()])
    if a.command == "stats":
        say({"all": stats.vault_stats(n, a.as_of).first().asDict(), "vaults": [r.asDict() for r in stats.rollup(n).collect()]})
    elif a.command == "search":
        found = stats.search(n, a.keyword, [t for t in a.tags.split(",") if t], a.min_links, a.max_links)
        rows(found.select("vault", "name", "rel_path", "word_count").orderBy("vault", "name"))
    elif a.command in ("orphans", "hubs", "popular"):
        d = graph.degrees(n).join(n.select("vault", "name", "modified"), ["vault", "name"])
        best = {"orphans": "modified", "hubs": "out_degree", "popular": "in_degree"}[a.command]
        rows((d.where("total = 0") if a.command == "orphans" else d).orderBy(F.desc(best), "name", "vault"))
    elif a.command == "quality":
        s = quality.scores(n, a.as_of)
        if a.note:
            return rows(quality.find_notes(s, a.note))
        if a.issues:
            return rows(quality.top_issues(s, top))
        best = s.orderBy(F.col("total").asc() if a.worst else F.col("total").desc(), "name", "vault").limit(top)
        say({"summary": quality.summary(s).first().asDict(), "notes": [r.asDict() for r in best.collect() if not a.grade or r.grade == a.grade]})
    elif a.command == "similar":
        if a.what == "find":
            return rows(similarity.to_note(n, a.note, a.threshold or 0.3, top=top))
        least = a.threshold or {"duplicates": 0.7, "merge": 0.6}.get(a.what, 0.3)
        p = similarity.similar_pairs(n, least)
        d = similarity.linked_flag(p, n).where("not linked") if a.what == "unlinked" else similarity.merge_suggestions(p, n, least) if a.what == "merge" else p
        rows(d.orderBy(F.desc("similarity"), "vault", "l", "r"))
    else:
        export.export_all(n, a.out, a.as_of, a.lang or "en")
        say({"out": a.out})


if __name__ == "__main__":
    sys.exit(main())
