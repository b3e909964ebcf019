"""Run storage: totals and retention by age, count and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import saved


def retention(runs: DataFrame, now: float, max_age: float | None = None, max_runs: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """runs (run_id, mtime, size) with keep. Newest first, ties by run_id; sizes add up over runs that age and count leave. Rows are sorted by
    range, and running sums start from the totals of the partitions before."""
    young = F.lit(True) if max_age is None else F.lit(now) - F.col("mtime") <= max_age
    r = runs.withColumn("young", young).orderBy(F.desc("mtime"), F.desc("run_id")).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    r = saved(r)
    r = _running(r, F.col("young").cast("int"), "n")
    r = r.withColumn("few", F.col("young") & (F.lit(True) if max_runs is None else F.col("n") <= max_runs))
    r = _running(r, F.when(F.col("few"), F.col("size")).otherwise(0), "upto")
    return r.select("run_id", "mtime", "size", (F.col("few") & (F.lit(True) if max_bytes is None else F.col("upto") <= max_bytes)).alias("keep"))


def _running(r: DataFrame, x, name: str) -> DataFrame:
    """Running sum of x in the order of _p and _i."""
    r = r.withColumn("_x", x)
    sums = r.groupBy("_p").agg(F.sum("_x").alias("s"))
    start = sums.select("_p", F.coalesce(F.sum("s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # one row a partition
    own = F.sum("_x").over(W.partitionBy("_p").orderBy("_i").rowsBetween(W.unboundedPreceding, W.currentRow))
    return r.withColumn("_o", own).join(F.broadcast(start), "_p").withColumn(name, F.col("_o") + F.col("_s")).drop("_x", "_o", "_s")
