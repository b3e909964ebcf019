"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Windows of an item are runs of `size` of its words (a shorter item is one window). Words are ordered by rarity over all documents;
as a window must be contained whole, its prefix is its one rarest word. Documents keep only the positions of such words,
candidates must lie within the document (length and position bounds), and the window is then compared word by word.

Benchmark words are sent as literals in batches of at most `batch` distinct words, so what is broadcast is bounded
and nothing is left out. Defined results: null and word-less texts have no words and are clean; null item_ids count like others, as
the string `null`; repeated items and rows change nothing but their own rows; documents are matched by id and text, so a doc_id may repeat;
an empty table of documents gives no rows, without items all documents are clean. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Everything of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _UPPER.lower()))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _only(ws: Column | str, among: list[str]) -> Column:
    return F.filter(ws, lambda w: w.isin(among))


def _positions(ws: Column | str, among: list[str]) -> Column:
    return F.filter(F.transform(ws, lambda w, i: F.when(w.isin(among), i)), lambda i: i.isNotNull())


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _batches(frame: DataFrame, batch: int) -> list[list[str]]:
    """Distinct words of a benchmark column `w`, in lists of bounded length."""
    out: list[list[str]] = [[]]
    for r in frame.select("w").distinct().orderBy("w").toLocalIterator():
        if len(out[-1]) >= batch:
            out.append([])
        out[-1].append(r[0])
    return out


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item, win (words), of each distinct window of each item."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("ws")).where("size(ws) > 0")
    n = F.size("ws")
    wins = F.when(n < size, F.array("ws")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.slice("ws", i, size)))
    return w.select("item", F.explode(wins).alias("win")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, batch: int = 20_000) -> DataFrame:
    """doc_id, n_words, hits (array of hit word intervals start, length), items (sorted item ids) of each row of docs."""
    wins = checkpoint(item_windows(benchmark, size))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), words(F.col("text")).alias("ws"))
    vocabulary = _batches(wins.select(F.explode("win").alias("w")), batch)
    counted = _all([d.select(F.explode(_only("ws", b)).alias("w")).groupBy("w").count() for b in vocabulary])
    freq = checkpoint(counted)

    places = wins.select("item", "win", F.posexplode("win").alias("k", "w")).join(freq, "w", "left")
    rarest = places.groupBy("item", "win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "w", "k")).alias("r"))
    prefix = checkpoint(rarest.where("r.c > 0").select("item", "win", F.col("r.w").alias("w"), F.col("r.k").alias("k")))
    cand = []
    for b in _batches(prefix, batch):
        c = d.select("doc_id", "h", "ws", _positions("ws", b).alias("at"))
        c = c.select("doc_id", "h", "ws", F.explode("at").alias("p")).withColumn("w", F.col("ws")[F.col("p")])
        # The neighbourhood that any window around this word can touch; the rest of the text stays behind.
        lo = F.greatest(F.col("p") - (size - 1), F.lit(0))
        cand.append(c.select("doc_id", "h", "w", "p", lo.alias("lo"), F.slice("ws", lo + 1, 2 * size).alias("near")))
    start = F.col("p") - F.col("k")
    hits = (
        _all(cand).join(prefix, "w").where((start >= 0) & (F.slice("near", F.greatest(start - F.col("lo"), F.lit(0)) + 1, F.size("win")) == F.col("win")))
        .select("doc_id", "h", start.alias("start"), F.size("win").alias("length"), "item")
    )
    by_doc = hits.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "length")).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    sizes = d.select("doc_id", "h", F.size("ws").cast("long").alias("n_words"))
    out = sizes.join(by_doc.withColumnsRenamed({"doc_id": "d2", "h": "h2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    none = F.expr("cast(array() as array<struct<start:int,length:int>>)")
    return out.select("doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "h")


def n_hit(hits: Column) -> Column:
    """Number of distinct positions that the intervals cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))).cast("long")
