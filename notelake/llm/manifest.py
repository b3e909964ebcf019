"""Merkle manifest of a dataset: digests of rows, a tree a group, a root, and a proof for each row.

Rows are ranked within their group (a source) without a global sort: counts of key prefixes, from long ones to short ones, give each block of
neighbouring keys the rank of its first row, and a window ranks the rows of a block. A block with more than `limit` different rows
(repeated or null doc_ids) is cut by further digits, down to the digest of the row; rows equal in all columns are counted, not sorted. The rank,
written in digits of base `fanout`, keys the nodes of a trie: a node is the digest of all nodes that differ from it in one last digit, so the
longest prefixes are reduced first, and each step handles a `fanout`-th of the rows before. On the way back each run of siblings gets
the runs above it, which are the proofs of all its rows.

Defined results: null doc_ids rank before all others, rows of equal doc_id by their digest; a null group is one group and ranks before all
others; a group of one row has no level of its own; an empty table gives no rows. Other columns are carried along or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

_BROADCAST_ROWS = 100_000
_COPIES = 1 << 16
LEVELS = "array<struct<pos:int,run:array<string>>>"


def digest(*columns: Column) -> Column:
    """Lower-case SHA-256 of columns: `-` for null, else number of bytes, `:`, value, all concatenated."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def id_key(doc_id: Column) -> Column:
    """Text that sorts as doc_id, null first: a flag and 16 digits."""
    shifted = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.when(doc_id.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), shifted))


def _before(*by: str, order: str) -> W:
    return W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _starts(counts: DataFrame, length: int, step: int) -> DataFrame:
    """counts: g, p (prefixes of at most length digits), n. Adds start, the rows of g before p, and total, all rows of g."""
    if length <= step:
        return counts.withColumns({"start": F.coalesce(F.sum("n").over(_before("g", order="p")), F.lit(0)), "total": F.sum("n").over(W.partitionBy("g"))})
    own = counts.withColumns({"q": F.substring("p", 1, length - step)})
    above = _starts(own.groupBy("g", F.col("q").alias("p")).agg(F.sum("n").alias("n")), length - step, step).select("g", F.col("p").alias("q"), F.col("start").alias("s"), "total")
    own = own.withColumn("own", F.coalesce(F.sum("n").over(_before("g", "q", order="p")), F.lit(0)))
    return own.join(above, ["g", "q"]).withColumn("start", F.col("s") + F.col("own")).drop("s", "own", "q")


def ranked(rows: DataFrame, length: int = 14, step: int = 3, limit: int = 1 << 16) -> DataFrame:
    """rows: g, key, n (copies) and others. Adds rank (of the first copy, by key within g) and total (rows of g)."""
    with_p = lambda df, k: df.withColumn("p", F.substring("key", 1, k))
    counted = lambda df: df.groupBy("g", "p").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    rest = with_p(rows, length)
    blocks = checkpoint(counted(rest))
    at = _starts(blocks.drop("rows"), length, step).join(blocks.drop("n"), ["g", "p"]).drop("n")
    out = None
    while True:
        at = checkpoint(at)
        large = at.where(F.col("rows") > limit).drop("rows")
        n = large.count()
        side = F.broadcast(large) if n <= _BROADCAST_ROWS else large
        light = rest.join(side, ["g", "p"], "left_anti") if n else rest
        light = light.join(at.drop("rows"), ["g", "p"]).withColumn("rank", F.col("start") + F.coalesce(F.sum("n").over(_before("g", "p", order="key")), F.lit(0))).drop("p", "start")
        out = light if out is None else out.unionByName(light)
        if not n:
            return out
        # Blocks that are too large, by more digits.
        rest = rest.join(side, ["g", "p"]).withColumnRenamed("p", "q")
        length += step
        rest = with_p(rest, length)
        finer = rest.groupBy("g", "q", "p").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.first("start").alias("start"), F.first("total").alias("total"))
        at = finer.withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(_before("g", "q", order="p")), F.lit(0))).drop("n", "q")
        rest = checkpoint(rest.drop("q", "start", "total"))


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each copy, with ranks of their own; in two steps, so that no array is long."""
    rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _COPIES))))
    rest = F.least(F.col("n") - F.col("s") * _COPIES, F.lit(_COPIES)) - 1
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), rest))).withColumn("rank", F.col("rank") + F.col("s") * _COPIES + F.col("i")).drop("s", "i", "n")


def _reduce(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes: g, rank, total, d and others. Runs of siblings level by level (g, p, total, items), and the top of each g (g, top)."""
    runs, tops = [], None
    while True:
        others = [c for c in nodes.columns if c not in ("g", "rank", "total", "d")]
        run = nodes.groupBy("g", F.floor(F.col("rank") / fanout).alias("p")).agg(F.sort_array(F.collect_list(F.struct("rank", "d", *others))).alias("items"), F.max("total").alias("total"))
        run = checkpoint(run)
        runs.append(run)
        parent = F.sha2(F.array_join(F.col("items.d"), ""), 256)
        single = run.where(F.col("total") <= fanout).select("g", F.when(F.col("total") == 1, F.col("items")[0]["d"]).otherwise(parent).alias("top"))
        tops = single if tops is None else tops.unionByName(single)
        more = run.where(F.col("total") > fanout)
        if more.isEmpty():
            return runs, tops
        nodes = more.select("g", F.col("p").alias("rank"), F.ceil(F.col("total") / fanout).alias("total"), parent.alias("d"))


def _descend(runs: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The runs of the lowest level with the columns of tops (g, levels, ...): levels gets the runs above each run, the nearest first."""
    extra = [c for c in tops.columns if c not in ("g", "levels")]
    above = None
    for run in reversed(runs):
        own = run.where(F.col("total") <= fanout).join(tops, "g")
        if above is not None:
            parent = above.select("g", F.col("p").alias("q"), F.col("items.d").alias("run"), "levels", *extra)
            step = F.array(F.struct((F.col("p") % fanout).cast("int").alias("pos"), "run"))
            under = run.where(F.col("total") > fanout).withColumn("q", F.floor(F.col("p") / fanout)).join(parent, ["g", "q"])
            own = own.unionByName(under.withColumn("levels", F.concat(step, "levels")).drop("q", "run"))
        above = own
    return above


def _with_own_run(runs: DataFrame, fanout: int) -> DataFrame:
    """A row for each item of the runs; levels begins with its own run, unless it is alone in its group."""
    x = F.col("item")
    rows = runs.withColumn("item", F.explode("items"))
    own = F.array(F.struct((x["rank"] % fanout).cast("int").alias("pos"), F.col("items.d").alias("run")))
    return rows.withColumn("levels", F.when(F.col("total") > 1, F.concat(own, "levels")).otherwise(F.col("levels")))


def manifest(leaves: DataFrame, fanout: int = 16, limit: int = 1 << 16) -> DataFrame:
    """leaves: source, doc_id, leaf (digest) and others, functions of the row. Adds rank, subroot, root and levels: the runs of siblings from
    the leaf to the root, each with the position of the own node."""
    carry = [c for c in leaves.columns if c not in ("source", "doc_id", "leaf")]
    group = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), "source"))
    rows = leaves.groupBy(group.alias("g"), "doc_id", "leaf").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in carry])
    rows = checkpoint(rows).withColumn("key", F.concat(id_key(F.col("doc_id")), "leaf"))
    nodes = _copies(ranked(rows, limit=limit)).drop("key").withColumnRenamed("leaf", "d")
    runs, subroots = _reduce(nodes, fanout)
    subroots = checkpoint(subroots)
    one = subroots.select(F.lit("").alias("g"), F.hex(F.col("g")).alias("key"), F.lit(1).cast("long").alias("n"), F.col("g").alias("of"), F.col("top").alias("d"))
    top_runs, root = _reduce(ranked(one, limit=limit).drop("key", "n"), fanout)
    roots = _with_own_run(_descend(top_runs, root.select("g", F.array().cast(LEVELS).alias("levels"), F.col("top").alias("root")), fanout), fanout)
    tops = checkpoint(roots.select(F.col("item.of").alias("g"), "levels", F.col("item.d").alias("subroot"), "root"))
    out = _with_own_run(_descend(runs, tops, fanout), fanout)
    source = F.when(F.col("g") == "", F.lit(None)).otherwise(F.expr("substring(g, 2)"))
    return out.select(source.alias("source"), "item.doc_id", F.col("item.d").alias("leaf"), *[F.col(f"item.{c}") for c in carry], F.col("item.rank").alias("rank"), "subroot", "root", "levels")


def proof_of(levels: Column) -> Column:
    """SHA-256 of the siblings, level by level, left to right."""
    rest = lambda x: F.array_join(F.concat(F.slice(x["run"], 1, x["pos"]), F.slice(x["run"], x["pos"] + 2, F.size(x["run"]))), "")
    return F.sha2(F.array_join(F.transform(levels, rest), ""), 256)


def fold(levels: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    left = lambda x: F.array_join(F.slice(x["run"], 1, x["pos"]), "")
    right = lambda x: F.array_join(F.slice(x["run"], x["pos"] + 2, F.size(x["run"])), "")
    return F.aggregate(levels, leaf, lambda acc, x: F.sha2(F.concat(left(x), acc, right(x)), 256))
