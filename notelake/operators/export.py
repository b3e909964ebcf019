"""Export frames and documents: notes, orphans, tags and links as CSV rows; reports as Markdown; JSON documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.sources.document import write_document

from . import graph, quality, stats
from .edits import write_atomic


def notes_rows(notes: DataFrame) -> DataFrame:
    d = notes.join(graph.degrees(notes), ["vault", "name"])
    return d.select(
        "vault", "name", "rel_path", "word_count", "out_degree", "in_degree", F.col("total").alias("total_links"), F.array_join(F.array_sort("tags"), ", ").alias("tags"),
        F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"), F.when(F.col("total") == 0, "Yes").otherwise("No").alias("orphan"),
    )


def orphan_rows(notes: DataFrame) -> DataFrame:
    return notes_rows(notes).where("orphan = 'Yes'").select("name", "rel_path", "word_count", "tags", "modified").orderBy(F.desc("modified"), "name")


def tag_rows(notes: DataFrame) -> DataFrame:
    n = notes.count()
    return stats.tag_frequency(notes).select("tag", "notes", F.format_string("%.1f%%", F.col("notes") * 100.0 / F.lit(max(n, 1))).alias("share"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(document: dict, path: str) -> None:
    write_atomic(Path(path), json.dumps(document, ensure_ascii=False, indent=2, default=str) + "\n")


_TEXT = {
    "en": {"title": "Vault report", "notes": "Notes", "words": "Words", "links": "Links", "orphans": "Orphans", "tags": "Top tags", "hubs": "Hubs", "popular": "Most linked", "orphan_list": "Orphans, last changed first", "more": "more", "time": "Changed within", "days": "days", "actions": "Actions", "link": "Link orphans to related notes", "tag": "Tag untagged notes"},
    "zh": {"title": "知识库报告", "notes": "笔记", "words": "字数", "links": "链接", "orphans": "孤立笔记", "tags": "常用标签", "hubs": "枢纽笔记", "popular": "被引用最多的笔记", "orphan_list": "孤立笔记（按修改时间）", "more": "更多", "time": "时间分布", "days": "天", "actions": "建议操作", "link": "为孤立笔记添加链接", "tag": "为无标签笔记添加标签"},
}


def report(notes: DataFrame, as_of: str, lang: str = "en", top: int = 10, orphans: int = 20) -> str:
    """Markdown report from one-row totals and top lists, which say how many orphans they leave out; unknown languages fall back to English."""
    t = _TEXT.get(lang, _TEXT["en"])
    s = stats.vault_stats(notes, as_of).first()
    out = [f"# {t['title']}", "", f"- {t['notes']}: {s.total_notes:,}", f"- {t['words']}: {s.total_words:,}", f"- {t['links']}: {s.total_links:,}", f"- {t['orphans']}: {s.orphans:,}", "", f"## {t['tags']}"]
    out += [f"- #{r.tag} ({r.notes})" for r in stats.tag_frequency(notes).orderBy(F.desc("notes"), "tag").limit(top).collect()]
    out += ["", f"## {t['hubs']}"]
    out += [f"- [[{r.name}]] ({r.out_degree})" for r in graph.degrees(notes).orderBy(F.desc("out_degree"), "name").limit(top).collect()]
    out += ["", f"## {t['popular']}"]
    out += [f"- [[{r.name}]] ({r.in_degree})" for r in graph.degrees(notes).orderBy(F.desc("in_degree"), "name").limit(top).collect()]
    out += ["", f"## {t['orphan_list']}"]
    out += [f"- [[{r.name}]] ({r.word_count}), {(r.modified or '')[:10]}" for r in orphan_rows(notes).limit(orphans).collect()]
    if s.orphans > orphans:
        out.append(f"- {t['more']}: {s.orphans - orphans:,}")
    out += ["", f"## {t['time']}"]
    out += [f"- {k} {t['days']}: {s[f'within_{k}']:,} ({s[f'within_{k}'] * 100 / max(s.total_notes, 1):.1f}%)" for k in (7, 30, 90)]
    out += ["", f"## {t['actions']}", f"- {t['link']}: {s.orphans:,}", f"- {t['tag']}: {s.untagged:,}"]
    return "\n".join(out) + "\n"


def notes_table(notes: DataFrame) -> DataFrame:
    """The ten columns of the notes file, by name. Where a source gives no time of creation, that column holds the last change."""
    d = notes_rows(notes)
    return d.orderBy("name").select(
        F.col("name").alias("Note Name"), F.col("word_count").alias("Word Count"), F.col("out_degree").alias("Outgoing Links"), F.col("in_degree").alias("Incoming Links"),
        F.col("total_links").alias("Total Links"), F.col("tags").alias("Tags"), F.col("orphan").alias("Is Orphan"), F.col("modified").alias("Created Date"), F.col("modified").alias("Modified Date"), F.col("rel_path").alias("Path"),
    )


def orphans_table(notes: DataFrame) -> DataFrame:
    return orphan_rows(notes).select(F.col("name").alias("Note Name"), F.col("word_count").alias("Word Count"), F.col("tags").alias("Tags"), F.col("modified").alias("Modified Date"), F.col("rel_path").alias("Path"))


def tags_table(notes: DataFrame) -> DataFrame:
    return tag_rows(notes).orderBy(F.desc("notes"), "tag").select(F.col("tag").alias("Tag"), F.col("notes").alias("Count"), F.col("share").alias("Percentage"))


def links_table(notes: DataFrame) -> DataFrame:
    return graph.labelled_edges(notes).orderBy("src", "dst").select(F.col("src").alias("Source Note"), F.col("dst").alias("Target Note"), F.col("kind").alias("Link Type"))


TABLES = {"notes": notes_table, "orphans": orphans_table, "tags": tags_table, "links": links_table}


def write_csv_file(rows: DataFrame, path: str) -> int:
    """One CSV file in the order of the rows, written by the tasks."""
    return write_document(rows, path, kind="csv")


def analysis(notes: DataFrame, as_of: str, top: int = 20, tags: int = 50) -> dict:
    """The statistics part of the analysis document; lists are top-k reports."""
    s = stats.vault_stats(notes, as_of).first().asDict()
    d = graph.degrees(notes).join(notes.select("vault", "name", "word_count"), ["vault", "name"])
    best = lambda by: [r.asDict() for r in d.orderBy(F.desc(by), "name").limit(top).collect()]
    return {
        "statistics": s, "top_notes": {"most_outgoing": best("out_degree"), "most_incoming": best("in_degree")},
        "tags": {"total_unique": s["unique_tags"], "untagged_count": s["untagged"], "top_tags": [r.asDict() for r in stats.tag_frequency(notes).orderBy(F.desc("notes"), "tag").limit(tags).collect()]},
        "time_distribution": stats.recency(notes, as_of).first().asDict(),
    }


def write_analysis(notes: DataFrame, as_of: str, path: str) -> None:
    """meta, statistics and all_notes in one document; notes are written by the tasks."""
    head = '{"meta": ' + json.dumps({"as_of": as_of}) + ', "statistics": ' + json.dumps(analysis(notes, as_of), ensure_ascii=False, default=str) + ', "all_notes": [\n  '
    rows = notes_rows(notes).orderBy("name", "vault")
    write_document(rows.select(F.to_json(F.struct(*rows.columns)).alias("line")), path, head=head, between=",\n  ", tail="\n]}\n")


def quality_report(notes: DataFrame, as_of: str, top: int = 10) -> str:
    """Markdown: totals, grades, best and weakest notes, and advice where over 20 % of the notes (30 % for freshness) score below 50."""
    scored = graph.saved(quality.scores(notes, as_of))
    s = quality.summary(scored).first()
    n = max(s.notes, 1)
    out = ["# Note quality", "", f"- Notes: {s.notes}", *[f"- {k}: {s[c] or 0:.1f}" for k, c in (("Mean", "mean"), ("Median", "median"), ("Highest", "highest"), ("Lowest", "lowest"))], "", "## Grades", ""]
    for g in "ABCDF":
        share = s[f"grade_{g.lower()}"] * 100 / n
        out.append(f"**{g}**: {s[f'grade_{g.lower()}']} ({share:.1f}%) {'█' * int(share / 2)}")
    for title, test, order in (("Excellent (90 and more)", "total >= 90", F.desc("total")), ("To improve (below 70)", "total < 70", F.asc("total"))):
        rows = scored.where(test).orderBy(order, "name").limit(top).collect()
        if rows:
            out += ["", f"## {title}", ""]
            for i, r in enumerate(rows, 1):
                out.append(f"{i}. **{r.name}** {r.total:.1f} ({r.grade}): words {r.words:.0f}, links {r.links:.0f}, tags {r.tags:.0f}, freshness {r.freshness:.0f}" + (f"; {', '.join(r.hints)}" if r.hints else ""))
    advice = {"words": (0.2, "Extend short notes, or merge them into related ones."), "links": (0.2, "Link isolated notes; add index notes."), "tags": (0.2, "Give notes fitting tags."), "freshness": (0.3, "Review old notes; archive what is out of date.")}
    told = [f"- {text} ({s[f'low_{k}']})" for k, (share, text) in advice.items() if s[f"low_{k}"] > share * s.notes]
    return "\n".join([*out, "", "## Advice", "", *(told or ["- Nothing stands out."])]) + "\n"


def export_all(notes: DataFrame, folder: str, as_of: str, lang: str = "en", tables: list[str] = tuple(TABLES), as_json: bool = True) -> list[str]:
    """Writes the chosen tables, the analysis document and both reports; returns the file names."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    done = []
    for k in tables:
        write_csv_file(TABLES[k](notes), str(out / f"{k}.csv"))
        done.append(f"{k}.csv")
    if as_json:
        write_analysis(notes, as_of, str(out / "analysis.json"))
        done.append("analysis.json")
    write_atomic(out / "report.md", report(notes, as_of, lang))
    write_atomic(out / "quality.md", quality_report(notes, as_of))
    return [*done, "report.md", "quality.md"]
