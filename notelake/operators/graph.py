"""The link graph of notes: resolved and broken links, degrees, orphans, reciprocal edges, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def link_rows(parsed: DataFrame) -> DataFrame:
    """One row a link, repetitions kept."""
    return parsed.select("rel_path", "title", F.explode("links").alias("target"))


def resolved(parsed: DataFrame) -> DataFrame:
    return link_rows(parsed).join(parsed.select(F.col("title").alias("target")).distinct(), "target")


def broken(parsed: DataFrame) -> DataFrame:
    return link_rows(parsed).join(parsed.select(F.col("title").alias("target")), "target", "left_anti").select("target").distinct()


def orphans_v2(parsed: DataFrame) -> DataFrame:
    """Notes without links of their own whose title nobody links to."""
    return parsed.where(F.size("links") == 0).join(resolved(parsed).select(F.col("target").alias("title")).distinct(), "title", "left_anti")


def health(parsed: DataFrame) -> DataFrame:
    """One row: notes, front-matter notes, links, resolved links, broken targets, orphans. The narrow columns are saved once, as eight reads follow."""
    parsed = saved(parsed.select("rel_path", "title", "has_frontmatter", "links"))
    sums = parsed.agg(F.count("*").alias("notes"), F.count_if("has_frontmatter").alias("frontmatter_notes"), F.coalesce(F.sum(F.size("links")), F.lit(0)).cast("long").alias("total_links"))
    parts = [resolved(parsed).agg(F.count("*").alias("resolved_links")), broken(parsed).agg(F.count("*").alias("broken_targets")), orphans_v2(parsed).agg(F.count("*").alias("orphans"))]
    for p in parts:  # one-row frames
        sums = sums.join(F.broadcast(p))
    return sums


def edges_v1(notes: DataFrame) -> DataFrame:
    """vault, src, dst: distinct edges between notes of one vault that exist, self-links included. A target that very many notes
    link to makes one side of the join uneven, which adaptive execution splits, as names are unique on the other."""
    out = notes.select("vault", F.col("name").alias("src"), F.explode("outgoing").alias("dst"))
    return out.join(notes.select("vault", F.col("name").alias("dst")), ["vault", "dst"]).select("vault", "src", "dst")


def degrees(notes: DataFrame) -> DataFrame:
    """vault, name, out_degree (unresolved links count), in_degree, total."""
    into = edges_v1(notes).groupBy("vault", F.col("dst").alias("name")).agg(F.count("*").alias("in_degree"))
    d = notes.select("vault", "name", F.size("outgoing").cast("long").alias("out_degree")).join(into, ["vault", "name"], "left").fillna(0, ["in_degree"])
    return d.withColumn("total", F.col("out_degree") + F.col("in_degree"))


def labelled_edges(notes: DataFrame) -> DataFrame:
    """Edges with `Bidirectional` or `Unidirectional`."""
    e = edges_v1(notes)
    back = e.select("vault", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back"))
    kind = F.when(F.col("back"), "Bidirectional").otherwise("Unidirectional")
    return e.join(back, ["vault", "src", "dst"], "left").select("vault", "src", "dst", kind.alias("kind"))


def reciprocal_pairs(notes: DataFrame) -> DataFrame:
    """One row: pairs of notes that link to each other; a self-link counts once before halving."""
    return labelled_edges(notes).agg(F.expr("count_if(kind = 'Bidirectional') div 2").alias("bidirectional"))


def saved(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there. Where that is unset, a folder below the warehouse serves, which executors share too."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """For jobs of many steps: shuffle files of frames made within are deleted when a query of theirs has ended, as each step is read from
    what it has written. Without it they stay until the driver's JVM happens to collect garbage, while the executors' disks fill up. Should a
    later query need a file that has gone, Spark runs its stage again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (u, v), by star contraction; rounds are cut by reliable checkpoints."""
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        e = saved(large.join(least, "u").select(F.explode(pairs).alias("x")).select("x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
