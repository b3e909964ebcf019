"""Statistics over parsed (v1) notes: totals, tags, recency, search, multi-vault rollup. as_of is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph


def age_days(as_of: str) -> Column:
    """Whole days since the note was modified, rounded down."""
    return F.floor(F.timestamp_diff("HOUR", F.col("modified"), F.lit(as_of).cast("timestamp_ntz")) / 24)


def recency(notes: DataFrame, as_of: str) -> DataFrame:
    d = age_days(as_of)
    return notes.agg(*[F.count_if(d <= k).alias(f"within_{k}") for k in (7, 30, 90)])


def tag_frequency(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("notes"))


def vault_stats(notes: DataFrame, as_of: str) -> DataFrame:
    """One row of totals; the average word count is rounded down, 0 for no notes. The narrow columns are saved once, as five parts read them."""
    notes = graph.saved(notes.select("vault", "name", "outgoing", "tags", "word_count", "modified"))
    n = notes.agg(
        F.count("*").alias("total_notes"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"), F.coalesce(F.sum(F.size("outgoing")), F.lit(0)).cast("long").alias("total_links"),
        F.count_if(F.size("tags") == 0).alias("untagged"), F.coalesce(F.expr("sum(word_count) div nullif(count(*), 0)"), F.lit(0)).alias("avg_word_count"),
        F.try_divide(F.sum(F.size("outgoing")).cast("double"), F.count("*")).alias("avg_links"),
    )
    orphans = graph.degrees(notes).agg(F.count_if(F.col("total") == 0).alias("orphans"))
    tags = tag_frequency(notes).agg(F.count("*").alias("unique_tags"))
    for p in (recency(notes, as_of), orphans, tags, graph.reciprocal_pairs(notes)):  # one-row frames
        n = n.join(F.broadcast(p))
    return n


def search(notes: DataFrame, keyword: str | None = None, tags: list[str] = (), min_links: int | None = None, max_links: int | None = None) -> DataFrame:
    """Notes that meet all criteria: keyword in name or content (case-folded), all tags, total links between the bounds."""
    out = notes
    if keyword is not None:
        out = out.where(F.contains(F.lower("name"), F.lit(keyword.lower())) | F.contains(F.lower("content"), F.lit(keyword.lower())))
    if tags:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    if min_links is not None or max_links is not None:
        d = graph.degrees(notes).where(F.col("total").between(min_links or 0, max_links if max_links is not None else (1 << 62))).select("vault", "name")
        out = out.join(d, ["vault", "name"], "left_semi")
    return out


def rollup(notes: DataFrame) -> DataFrame:
    """Notes, words, links, orphans and distinct tags of each vault, and of all (vault null)."""
    n = graph.saved(notes.select("vault", "name", "outgoing", "tags", "word_count"))
    lone = graph.degrees(n).where("total = 0").select("vault", "name", F.lit(1).alias("lone"))
    n = n.join(lone, ["vault", "name"], "left")
    sums = [F.count("*").alias("notes"), F.sum("word_count").alias("words"), F.sum(F.size("outgoing")).cast("long").alias("links"), F.count("lone").alias("orphans")]
    tags = n.select("vault", F.explode("tags").alias("tag")).rollup("vault").agg(F.countDistinct("tag").alias("unique_tags")).withColumnRenamed("vault", "v2")
    out = n.rollup("vault").agg(*sums)
    # A handful of vaults, one row each.
    return out.join(F.broadcast(tags), F.col("vault").eqNullSafe(F.col("v2")), "left").drop("v2").fillna(0, ["unique_tags"])


def order_statistic(df: DataFrame, column: str, rank: int, parts: int = 1024) -> float | None:
    """The value of a rank (from 0, nulls left out), None beyond the last. Selection by range counts: each pass counts the rows of equal ranges and goes
    on with the one range that holds the rank, so no task sorts or holds more than the counts of `parts` ranges, and half a dozen passes do."""
    v = F.col("v")
    d = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull())
    n, lo, hi = d.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if rank >= n:
        return None
    while lo < hi:
        at = F.least(F.floor((v - lo) / (hi - lo) * parts), F.lit(parts - 1))
        ranges = d.groupBy(at.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # `parts` rows at most
        for r in sorted(ranges):
            if rank < r.n:
                break
            rank -= r.n
        d, lo, hi = d.where(at == r.part), r.lo, r.hi
    return lo
