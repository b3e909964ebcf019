"""Quality scores of notes: words, links, tags, freshness, total, grade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, stats
from .stats import age_days


@dataclass(frozen=True)
class Standards:
    min_words: int = 100
    ideal_words: int = 500
    min_links: int = 2
    ideal_links: int = 5
    min_tags: int = 1
    ideal_tags: int = 3
    fresh_days: int = 90


WEIGHTS = {"words": 0.25, "links": 0.35, "tags": 0.15, "freshness": 0.25}


def _ramp(x: Column, low: int, ideal: int) -> Column:
    """0 to 50 below low, 50 to 100 up to ideal."""
    return F.when(x < low, x / low * 50).when(x < ideal, 50 + (x - low) / (ideal - low) * 50).otherwise(100.0)


def scores(notes: DataFrame, as_of: str, s: Standards = Standards()) -> DataFrame:  # noqa: B008
    d = notes.join(graph.degrees(notes), ["vault", "name"])
    age, t = age_days(as_of), s.fresh_days
    fresh = F.when(age <= 7, 100.0).when(age <= 30, 90.0).when(age <= t, 70.0).when(age <= 2 * t, 50.0).otherwise(30.0)
    d = d.select(
        "vault", "name", "word_count", "out_degree", "in_degree", F.size("tags").cast("long").alias("n_tags"), _ramp(F.col("word_count"), s.min_words, s.ideal_words).alias("words"),
        F.when(F.col("total") == 0, 0.0).otherwise(_ramp(F.col("total"), s.min_links, s.ideal_links)).alias("links"),
        F.when(F.size("tags") == 0, 0.0).otherwise(_ramp(F.size("tags"), s.min_tags, s.ideal_tags)).alias("tags"), fresh.alias("freshness"),
    )
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    d = d.withColumn("total", total)
    grade = F.when(F.col("total") >= 90, "A").when(F.col("total") >= 80, "B").when(F.col("total") >= 70, "C").when(F.col("total") >= 60, "D").otherwise("F")
    hints = F.filter(F.array(
        F.when(F.col("word_count") < 0.7 * s.ideal_words, "words"), F.when(F.col("links") < 50, "links"), F.when(F.col("n_tags") == 0, "no_tags"), F.when(F.col("n_tags") > 2 * s.ideal_tags, "many_tags"), F.when(F.col("freshness") <= 50, "stale"),
    ), lambda x: x.isNotNull())
    return d.withColumns({"grade": grade, "hints": hints})


def summary(scored: DataFrame) -> DataFrame:
    """One row: count, mean, upper median, extremes, grade counts, notes below 50 in each dimension."""
    scored = graph.saved(scored.select("total", "grade", *WEIGHTS))
    n = scored.count()
    median = F.lit(stats.order_statistic(scored, "total", n // 2)).cast("double").alias("median")  # the upper one
    return scored.agg(
        F.count("*").alias("notes"), F.avg("total").alias("mean"), F.min("total").alias("lowest"), F.max("total").alias("highest"),
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"], *[F.count_if(F.col(k) < 50).alias(f"low_{k}") for k in WEIGHTS], median,
    )


def top_issues(scored: DataFrame, limit: int = 10) -> DataFrame:
    """The weakest notes that have something to mend, worst first."""
    return scored.where(F.size("hints") > 0).orderBy("total", "name", "vault").limit(limit)


def find_notes(scored: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """The note of that exact name (one a vault), else up to ten whose name holds it, case-folded."""
    exact = scored.where(F.col("name") == name)
    some = scored.where(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("name", "vault").limit(limit)
    return exact if not exact.select("name").isEmpty() else some
