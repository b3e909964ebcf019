"""Watching a vault, the state of its paths, and keyed latest state of an event stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from notelake.operators.budget import pool
from notelake.operators.graph import saved
from notelake.operators.index import ConcurrentUpdate, Snapshot, update
from notelake.operators.parse import parse_v2
from notelake.sources.changes import ChangeSource
from notelake.sources.vault import notes_of, scan, skip_reason


def update_once(spark: SparkSession, root: str, index: str) -> dict:
    """Scans the vault, refreshes its index, and returns the counts of changes."""
    return update(Snapshot(spark, index), scan(spark, root), lambda files: parse_v2(notes_of(files)))


def changes(spark: SparkSession, root: str, log: str, pruned: str = ".obsidian") -> DataFrame:
    """The changes of a vault as a stream: vault, root, rel_path, mtime, length, readable, change (added, updated, removed), number."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("vault_changes").option("path", root).option("log", log).option("pruned", pruned).load()


class _PathState(StatefulProcessor):
    """Per path: the last change, and how many there were. A change that is known already (a batch read again) gives no row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number long, mtime double, length long, there boolean, times long")

    def handleInputRows(self, key, rows: Iterator[Row], timer) -> Iterator[Row]:  # noqa: N802
        number, _, _, there, times = self.last.get() if self.last.exists() else (0, None, None, False, 0)
        for r in sorted(rows, key=lambda x: x.number):
            if r.number <= number:
                continue
            now = r.change != "removed"
            if not now and not there:
                continue
            kind = "removed" if not now else "updated" if there else "added"
            number, there, times = r.number, now, times + 1
            self.last.update((number, r.mtime, r.length, there, times))
            yield Row(rel_path=key[0], number=number, change=kind, mtime=r.mtime, length=r.length, times=times)

    def close(self) -> None:
        pass


def path_states(events: DataFrame) -> DataFrame:
    """rel_path, number, change, mtime, length, times: every change of a path once, judged by the path's own state. Needs the RocksDB state store."""
    schema = "rel_path string, number long, change string, mtime double, length long, times long"
    return events.groupBy("rel_path").transformWithState(_PathState(), schema, "Append", "None")


def apply_changes(spark: SparkSession, index: str, batch: DataFrame, max_file_mb: float = 5, tries: int = 3) -> dict:
    """Brings an index up to date with changes (the last of each path counts) and returns how many notes were updated and removed. Only changed files
    are opened, and only changed rows written."""
    last = batch.groupBy("rel_path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "rel_path"]), "number").alias("x")).select("rel_path", "x.*")
    last = saved(last.withColumn("skipped", F.when(F.col("change") != "removed", skip_reason(max_file_mb))))
    put, gone = last.where("change <> 'removed' and skipped is null"), last.where("change = 'removed' or skipped is not null")
    snapshot = Snapshot(spark, index)
    new = parse_v2(notes_of(put))
    for left in reversed(range(tries)):
        before = snapshot.meta()
        try:
            if before is None:
                snapshot.write(new, rows=put.count())
            else:
                snapshot.apply(new, gone.select("rel_path"), before)
            break
        except ConcurrentUpdate:
            if not left:
                raise
    return {"updated": put.count(), "removed": last.where("change = 'removed'").count()}


def start_watch(spark: SparkSession, root: str, index: str, state: str, interval: float = 5, report: Callable[[dict], None] = print, available_now: bool = False) -> StreamingQuery:
    """Keeps the index up to date with the vault. state: folder of the stream's checkpoint and of the source's log; with the same one a restart goes on
    where the last run ended. available_now: ends when the present changes are done."""

    def one(batch: DataFrame, n: int) -> None:
        with pool(batch.sparkSession, "watch"):
            if not batch.isEmpty():
                report(apply_changes(batch.sparkSession, index, batch) | {"batch": n})

    out = changes(spark, root, f"{state}/log").writeStream.option("checkpointLocation", f"{state}/checkpoint").foreachBatch(one)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=f"{interval} seconds")).start()


def watch(spark: SparkSession, root: str, index: str, interval: float = 5, once: bool = False, report: Callable[[dict], None] = print) -> None:
    """once: one whole scan against the index; else a stream of changes, until it is stopped."""
    if once:
        report(update_once(spark, root, index))
        return
    q = start_watch(spark, root, index, f"{index}-watch", interval, report)
    try:
        q.awaitTermination()
    finally:
        q.stop()


def latest_state(events: DataFrame, key: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest row of each key, for batches and streams (complete or update mode)."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_type", "value", at), F.struct(at, tie)).alias("x"), F.count("*").alias("events")).select(key, "events", "x.*")


def stream_latest(spark: SparkSession, path: str, schema, name: str, timeout: float | None = None) -> DataFrame:
    """Runs latest_state over all files of a folder as a stream until they are read, and returns the state table. Where a timeout (seconds) is given
    and ends first, TimeoutError is raised: the table would hold a part of the files."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = latest_state(src).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    try:
        if q.awaitTermination(timeout) is False:
            raise TimeoutError(f"files of {path} are left after {timeout} s")
    finally:
        q.stop()
    return spark.table(name)
