"""A run over a vault: scan, incremental index, analysis, recommendations, plan, and the documents written from them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import round_half_even
from notelake.sources.document import write_document
from notelake.sources.vault import contents, notes_of, scan, skip_counts

from . import control, graph, recommend
from .budget import TimeOver, limited
from .edits import ANCHOR
from .export import write_json
from .index import Snapshot, update
from .parse import encoding, parse_v2

_TEXT = {
    "en": {
        "title": "Vault report", "made": "Made at", "vault": "Vault", "summary": "Summary", "total_notes": "Notes", "frontmatter_notes": "Notes with front-matter", "total_links": "Links",
        "broken_link_candidates": "Broken link targets", "orphan_notes": "Orphan notes", "actions": "Proposed actions", "next": "Next steps", "next_orphan": "Link orphan notes to related ones.",
        "next_broken": "Create or correct broken link targets.", "merges": "Merge candidates", "low": "Suggestions below a confidence of",
    },
    "zh": {
        "title": "知识库报告", "made": "生成时间", "vault": "知识库", "summary": "概要", "total_notes": "笔记", "frontmatter_notes": "含前置元数据的笔记", "total_links": "链接",
        "broken_link_candidates": "失效链接", "orphan_notes": "孤立笔记", "actions": "建议操作", "next": "下一步", "next_orphan": "为孤立笔记添加链接。",
        "next_broken": "创建或修正失效的链接目标。", "merges": "合并候选", "low": "置信度低于此值的建议",
    },
}


def items(broken: DataFrame, rel: DataFrame, meta: DataFrame, merged: DataFrame, c: recommend.Scoring = recommend.Scoring()) -> DataFrame:  # noqa: B008
    """The plan's rows with reason and payload as JSON."""
    zero = rel.sparkSession.range(1).select(*[F.lit(0.0).alias(k) for k in ("raw", "content_sim", "title_sim", "link_overlap")], F.lit(1.0).alias("factor")).select(F.to_json(recommend.reason(c))).first()[0]
    why = rel.where("rank = 1").select("rel_path", F.to_json(recommend.reason(c)).alias("reason"))
    item = F.struct("rank", F.col("target_title").alias("title"), round_half_even(F.col("confidence")).alias("confidence"), "target_path")
    listed = rel.groupBy("rel_path").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rank")).alias("items"))  # at most three a note
    blocks = recommend.related_blocks(rel).select("rel_path", "markdown_block").join(listed, "rel_path")
    parts = [
        ("create_stub_note", broken.select(F.col("target").alias("key"), F.lit(zero).alias("reason"), F.to_json(F.struct(F.col("target").alias("title"))).alias("payload"))),
        ("append_related_links_section", blocks.join(why, "rel_path").select(F.col("rel_path").alias("key"), "reason", F.to_json(F.struct(F.lit(ANCHOR).alias("anchor"), "markdown_block", "items")).alias("payload"))),
        ("add_frontmatter_fields", meta.join(why, "rel_path", "left").select(F.col("rel_path").alias("key"), F.coalesce("reason", F.lit(zero)).alias("reason"), F.to_json(F.struct(F.struct("keywords", "aliases", "related").alias("fields"))).alias("payload"))),
        ("merge_preview", merged.select(F.col("component").alias("key"), F.lit(zero).alias("reason"), F.to_json(F.struct("candidates", "average_confidence")).alias("payload"))),
    ]
    details = None
    for kind, d in parts:
        d = d.withColumn("type", F.lit(kind))
        details = d if details is None else details.unionByName(d)
    return recommend.plan(broken, rel, meta, merged, with_key=True).join(details, ["type", "key"]).drop("key")


def write_items(rows: DataFrame, head: dict, path: str) -> int:
    """One JSON document; the items are written by the tasks, in the order of their numbers."""
    plain = [c for c in rows.columns if c not in ("number", "reason", "payload")]
    own = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    line = F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(', "reason": '), "reason", F.lit(', "payload": '), "payload", F.lit(', "dependencies": []}'))
    lines = rows.orderBy("number").withColumn("own", own).select(line.alias("line"))
    return write_document(lines, path, head=json.dumps(head, ensure_ascii=False)[:-1] + ', "items": [\n  ', between=",\n  ", tail="\n]}\n")


def report(stats: dict, actions: int, merged: Iterable[dict], low: int, threshold: float, vault: str, made: str, lang: str = "en") -> Iterator[str]:
    """Lines of Markdown, with all merge candidates; languages without a catalogue fall back to English."""
    t = _TEXT.get(lang, _TEXT["en"])
    rows = [*stats.items(), ("actions", actions)]
    yield from (f"# {t['title']}", "", f"{t['made']}: {made}", f"{t['vault']}: {vault}", "", f"## {t['summary']}", "", *[f"- {t[k]}: {v}" for k, v in rows], "", f"## {t['next']}", "", f"- {t['next_orphan']}", f"- {t['next_broken']}")
    for i, m in enumerate(merged):
        if not i:
            yield from ("", f"## {t['merges']}", "")
        yield f"- {', '.join(m['candidates'])} ({m['average_confidence']})"
    if low:
        yield from ("", f"{t['low']} {threshold}: {low}")


def _recommend(notes: DataFrame, c: recommend.Scoring) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Suggestions, metadata, merges (all written), and how many are of low confidence."""
    pairs = recommend.AllPairs(notes, c)
    rel = graph.saved(pairs.suggestions())
    meta, merged = graph.saved(recommend.metadata(notes, rel, c)), graph.saved(recommend.merges(pairs, c))
    return rel, meta, merged, recommend.low_confidence(meta, rel, c).first()[0]


def run(spark: SparkSession, root: str, out: str, config: dict | None = None, lang: str | None = None) -> dict:
    """Writes health.json, action-items.json, run-summary.json and report.md below out/runs/<run id>, the index below out/index, and
    returns the run summary. An index younger than fast_path_max_age_sec is used without a scan. Recommendations that take longer than
    timeout_sec are given up as a whole, which the summary's downgrades tell."""
    config, began = config or {}, time.perf_counter()
    made, run_id = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ") + "-" + uuid.uuid4().hex[:6]
    c, folder, ms = control.scoring_of(config), Path(out) / "runs" / run_id, {}
    folder.mkdir(parents=True, exist_ok=True)

    def clock(stage: str, since: float) -> float:
        ms[f"{stage}_ms"] = int((time.perf_counter() - since) * 1000)
        return time.perf_counter()

    snapshot = Snapshot(spark, str(Path(out) / "index"))
    present, fast = snapshot.meta() is not None, snapshot.fresh(control.setting(config, "performance", "fast_path_max_age_sec"))
    skipped, at = dict.fromkeys(("non_md", "too_large", "no_permission"), 0), began
    if fast:
        n = snapshot.read().count()
        changes = {"total": n, "unchanged": n, "updated": 0, "removed": 0, "hit_rate": 1.0 if n else 0.0}
        at = clock("scan", at)
    else:
        files = scan(spark, root, **{k: control.setting(config, "scan", k) for k in ("max_file_mb", "sleep_ms", "max_files_per_sec")})
        skipped = skip_counts(files).first().asDict()
        at = clock("scan", at)
        terms = control.setting(config, "performance", "top_terms")
        changes = update(snapshot, files, lambda d: parse_v2(notes_of(d), terms))
    notes = snapshot.read()
    at = clock("parse", at)
    h = graph.health(notes).first()
    stats = {"total_notes": h.notes, "frontmatter_notes": h.frontmatter_notes, "total_links": h.total_links, "broken_link_candidates": h.broken_targets, "orphan_notes": h.orphans}
    at = clock("analyze", at)
    downs, limit = [], control.setting(config, "performance", "max_mem_mb")
    if limit and (notes.agg(F.sum(F.size("top_terms"))).first()[0] or 0) * 16 > limit * 1024 * 1024:
        downs.append("recommend_skipped_mem_limit")
    if not downs:
        try:
            with limited(spark, control.setting(config, "performance", "timeout_sec"), "recommend"):
                rel, meta, merged, low = _recommend(notes, c)
        except TimeOver:
            downs.append("recommend_timeout")
    if downs:  # the result without any note; none of its jobs has rows to read
        rel, meta, merged, low = _recommend(spark.createDataFrame([], notes.schema), c)
    at = clock("recommend", at)
    actions = write_items(items(graph.broken(notes), rel, meta, merged, c), {"version": "1", "vault": root, "generated_at": made}, str(folder / "action-items.json"))
    at = clock("plan", at)
    write_json({"version": "1", "vault": root, "generated_at": made, "stats": stats}, str(folder / "health.json"))
    shown = (r.asDict() for r in merged.orderBy("component").toLocalIterator())
    with open(folder / "report.md", "w", encoding="utf-8", newline="\n") as f:
        f.writelines(f"{line}\n" for line in report(stats, actions, shown, low, c.low, root, made, lang or control.setting(config, "i18n", "language")))
    clock("report", at)
    why = skipped | {"unchanged": changes["unchanged"]}
    summary = {
        "version": "1", "run_id": run_id, "fast_path": fast, "timing": {"total_ms": int((time.perf_counter() - began) * 1000), "stages": ms},
        "io": {"scanned_files": changes["total"], "skipped": skipped, "skipped_by_reason": why}, "cache": {"present": present, "hit_rate": changes["hit_rate"], "incremental_updated": changes["updated"]},
        "incremental": {"hit_rate": changes["hit_rate"], "incremental_updated": changes["updated"], "removed": changes["removed"], "skipped_by_reason": why}, "downgrades": downs,
    }
    write_json(summary, str(folder / "run-summary.json"))
    return summary


def doctor(spark: SparkSession, root: str, locks: list[str] = (), max_file_mb: float = 5) -> dict:
    """Files, skips, encodings, line ends and lock files of a vault."""
    files = scan(spark, root, max_file_mb=max_file_mb)
    e = encoding(contents(files)).first()
    return {
        "vault": root, "notes": files.where("skipped is null").count(), "skipped": skip_counts(files).first().asDict(), "encoding": {"utf8_bom": e.bom, "non_utf8": e.non_utf8},
        "line_endings": {k: e[f"eol_{k}"] for k in ("lf", "crlf", "mixed", "none")}, "locks": [control.check_lock(p) for p in locks],
    }
