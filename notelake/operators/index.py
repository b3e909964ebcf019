"""Incremental index: parsed notes in Parquet, their difference from a new scan, and the fast path.

Rows lie in buckets by the hash of their path. A change adds one small folder of new rows and of paths that have gone; reading merges them, the
last one of a path counts. Once such folders are many or large, only the buckets that they touch are written anew, so what an update writes
follows what has changed, not the vault.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import saved

SCHEMA_VERSION = 2
#: Rows of a bucket when the base is written, folders of changes and their share of the base's bytes before buckets are written anew.
BUCKET_ROWS, MOST_DELTAS, MOST_SHARE = 250_000, 8, 0.25


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """rel_path and change: unchanged (same mtime and size), updated, removed. A note that is new counts as updated."""
    a = old.select("rel_path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("had"))
    b = new.select("rel_path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("has"))
    kind = F.when(F.col("has").isNull(), "removed").when(F.col("had") & (F.col("m0") == F.col("m1")) & (F.col("s0") == F.col("s1")), "unchanged").otherwise("updated")
    return a.join(b, "rel_path", "full").select("rel_path", kind.alias("change"))


def counts(changes: DataFrame) -> DataFrame:
    """One row: total, unchanged, updated, removed, hit_rate (three digits)."""
    c = lambda k: F.count_if(F.col("change") == k).alias(k)
    total = F.count_if(F.col("change") != "removed")
    return changes.agg(total.alias("total"), c("unchanged"), c("updated"), c("removed"), F.coalesce(F.bround(F.try_divide(F.count_if(F.col("change") == "unchanged"), total).cast("decimal(38,18)"), 3).cast("double"), F.lit(0.0)).alias("hit_rate"))


class ConcurrentUpdate(RuntimeError):
    """Another writer has published since this one read the index."""


class Snapshot:
    """Folders of data, and numbered pointers (manifests) that name the current ones. Data is written first, then a pointer appears by a rename
    that never replaces one, so a crash leaves the former index and of two writers the later raises ConcurrentUpdate. Data that the last two
    pointers name is kept for readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _names(self) -> list[str]:
        root = self._path(self.root)
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def _pointers(self) -> list[int]:
        return sorted(int(n[8:]) for n in self._names() if n.startswith("pointer-") and n[8:].isdigit())

    def _manifest(self, n: int) -> dict:
        f = self._fs.open(self._path(f"{self.root}/pointer-{n}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")) | {"number": n}
        finally:
            f.close()

    def meta(self) -> dict | None:
        """The current manifest: version, number, buckets, base (folder of each bucket), deltas, last_updated, pending."""
        known = self._pointers()
        return self._manifest(known[-1]) if known else None

    def _current(self) -> dict | None:
        m = self.meta()
        return m if m is not None and m["version"] == SCHEMA_VERSION else None

    def _bucket(self, m: dict):
        return F.pmod(F.xxhash64("rel_path"), F.lit(m["buckets"])).cast("int")

    def _base(self, m: dict, buckets: set[int] | None = None) -> DataFrame:
        """Rows of the base files, with their bucket b."""
        folders, out = defaultdict(list), None
        for b, folder in m["base"].items():
            if buckets is None or int(b) in buckets:
                folders[folder].append(int(b))
        for folder, own in sorted(folders.items()):
            d = self.spark.read.parquet(f"{self.root}/{folder}").where(F.col("b").isin(own))
            out = d if out is None else out.unionByName(d)
        return out

    def _changes(self, m: dict) -> DataFrame:
        """The last change of each path."""
        d = self.spark.read.parquet(*[f"{self.root}/{x}" for x in m["deltas"]])
        last = d.groupBy("rel_path").agg(F.max_by(F.struct(*[c for c in d.columns if c != "rel_path"]), "_seq").alias("x"))
        return last.select("rel_path", "x.*").drop("_seq")

    def _merged(self, m: dict, buckets: set[int] | None = None) -> DataFrame | None:
        base = self._base(m, buckets)
        if not m["deltas"]:
            return base
        new = self._changes(m).withColumn("b", self._bucket(m))
        new = new if buckets is None else new.where(F.col("b").isin(list(buckets)))
        kept = new.where("not _gone").drop("_gone")
        return kept if base is None else base.join(new.select("rel_path", "b"), ["rel_path", "b"], "left_anti").unionByName(kept)

    def read(self) -> DataFrame | None:
        m = self._current()
        return None if m is None else self._merged(m).drop("b")

    def found(self, path: str) -> DataFrame | None:
        """At most one row: the note of that path. Reads the one bucket of the path, whose file is sorted by path and has a Bloom filter on it, and
        the folders of changes, which are small and have both too."""
        m = self._current()
        if m is None:
            return None
        b = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(path)), F.lit(m["buckets"]))).first()[0]
        own = F.col("rel_path") == path
        base = self.spark.read.option("basePath", f"{self.root}/{m['base'][str(b)]}").parquet(f"{self.root}/{m['base'][str(b)]}/b={b}").where(own).drop("b") if str(b) in m["base"] else None
        if not m["deltas"]:
            return base
        d = self.spark.read.parquet(*[f"{self.root}/{x}" for x in m["deltas"]]).where(own)
        if base is not None:
            d = d.unionByName(base.withColumns({"_seq": F.lit(0).cast("long"), "_gone": F.lit(False)}))
        return d.orderBy(F.desc("_seq")).limit(1).where("not _gone").drop("_seq", "_gone")

    def get(self, path: str) -> dict | None:
        """The row of one note."""
        d = self.found(path)
        row = d.first() if d is not None else None
        return row.asDict(True) if row else None

    def _files(self, d: DataFrame):
        return d.write.option("parquet.bloom.filter.enabled#rel_path", "true").option("parquet.block.size", 8 << 20)

    def _written(self, d: DataFrame, m: dict) -> dict[str, str]:
        """Writes rows as base files, one a bucket, and returns the folder of each bucket that has rows."""
        folder = f"base-{uuid.uuid4().hex[:12]}"
        d = d.withColumn("b", self._bucket(m)).repartition(m["buckets"], "b").sortWithinPartitions("b", "rel_path")
        self._files(d).partitionBy("b").parquet(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        return {n[2:]: folder for n in names if n.startswith("b=")}

    def write(self, notes: DataFrame, now: float | None = None, pending: int = 0, rows: int | None = None) -> None:
        """All rows anew. rows: about how many there are, where that is known."""
        before = self.meta()
        n = notes.count() if rows is None else rows
        m = {"version": SCHEMA_VERSION, "buckets": max(1, math.ceil(n / BUCKET_ROWS)), "deltas": []}
        self._publish(before, m | {"base": self._written(notes, m)} if n else m | self._empty(notes, m), now, pending)

    def _empty(self, notes: DataFrame, m: dict) -> dict:
        """Without rows, a folder of changes without any holds the schema."""
        return {"base": {}, "deltas": [self._delta(notes, None, 1)]}

    def _delta(self, new: DataFrame, gone: DataFrame | None, seq: int) -> str:
        folder = f"delta-{uuid.uuid4().hex[:12]}"
        d = new.withColumn("_gone", F.lit(False))
        if gone is not None:
            d = d.unionByName(gone.select("rel_path", F.lit(True).alias("_gone")), allowMissingColumns=True)
        self._files(d.withColumn("_seq", F.lit(seq).cast("long")).sortWithinPartitions("rel_path")).parquet(f"{self.root}/{folder}")
        return folder

    def _bytes(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.root}/{folder}")).getLength()

    def apply(self, new: DataFrame | None, gone: DataFrame | None, before: dict, now: float | None = None) -> None:
        """Adds changed rows and paths (rel_path) that have gone to the index as it was in `before`."""
        m = {k: before[k] for k in ("version", "buckets", "base", "deltas")}
        if new is not None:
            m["deltas"] = [*m["deltas"], self._delta(new, gone, before["number"] + 1)]
            large = sum(map(self._bytes, m["deltas"])) > MOST_SHARE * sum(map(self._bytes, set(m["base"].values())))
            if len(m["deltas"]) > MOST_DELTAS or large:
                m = self._compacted(m)
        self._publish(before, m, now, 0)

    def _compacted(self, m: dict) -> dict:
        """Writes the buckets anew that changes touch; of the others, the files stay."""
        touched = {r.b for r in self._changes(m).select(self._bucket(m).alias("b")).distinct().collect()}  # numbers of buckets
        rows = self._merged(m, touched)
        if rows is None or rows.select("rel_path").isEmpty():
            return m
        rest = {b: f for b, f in m["base"].items() if int(b) not in touched}
        return m | {"base": rest | self._written(rows.drop("b"), m), "deltas": []}

    def _publish(self, before: dict | None, m: dict, now: float | None, pending: int) -> None:
        n = (before["number"] if before else 0) + 1
        try:
            self._point(n, m | {"last_updated": float(time.time() if now is None else now), "pending": pending})
        except Exception:
            old = {*before.get("deltas", []), *before.get("base", {}).values()} if before else set()
            for folder in {*m["deltas"], *m["base"].values()} - old:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise
        for old in [k for k in self._pointers() if k < n][:-1]:
            self._fs.delete(self._path(f"{self.root}/pointer-{old}"), True)
        named = set()
        for k in self._pointers():
            x = self._manifest(k)
            named |= {*x.get("deltas", []), *x.get("base", {}).values(), x.get("data")}
        if self._pointers()[-1] == n:  # else another writer is at work on data that no pointer names yet
            for name in self._names():
                if name.split("-")[0] in ("base", "delta", "snapshot") and name not in named:
                    self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _point(self, n: int, meta: dict) -> None:
        """Makes pointer n, which must not be there."""
        tmp = self._path(f"{self.root}/next-{uuid.uuid4().hex[:12]}")
        f = self._fs.create(tmp, True)
        f.write(json.dumps(meta).encode())
        f.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self._gateway.new_array(kind, 1)
        none[0] = kind.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(files.makeQualified(tmp), files.makeQualified(self._path(f"{self.root}/pointer-{n}")), none)
        except Exception as e:
            self._fs.delete(tmp, True)
            if n in self._pointers():
                raise ConcurrentUpdate(f"index {n} was published by another writer") from e
            raise

    def delete(self) -> None:
        """The whole index."""
        self._fs.delete(self._path(self.root), True)

    def fresh(self, max_age: float, now: float | None = None) -> bool:
        """Whether the index is young enough to skip the scan, with nothing pending."""
        m = self._current()
        return m is not None and not m["pending"] and (time.time() if now is None else now) - m["last_updated"] <= max_age


def update(snapshot: Snapshot, files: DataFrame, parse, now: float | None = None) -> dict:
    """Compares a listing (rel_path, mtime, length) with the index, parses what changed (parse: listed files to note rows), adds that,
    and returns the counts. Files that didn't change are neither opened nor written again."""
    listed, before = saved(files.withColumn("size", F.col("length"))), snapshot._current()
    if before is None:
        n = listed.where("skipped is null").count()
        snapshot.write(parse(listed), now, rows=n)
        return {"total": n, "unchanged": 0, "updated": n, "removed": 0, "hit_rate": 0.0}
    old = snapshot._merged(before).select("rel_path", "mtime", "size")
    changes = saved(diff(old, listed.where("skipped is null")))
    found = counts(changes).first().asDict()
    if found["updated"] or found["removed"]:
        new = parse(listed.join(changes.where("change = 'updated'").select("rel_path"), "rel_path", "left_semi"))
        snapshot.apply(new, changes.where("change = 'removed'").select("rel_path"), before, now)
    else:
        snapshot.apply(None, None, before, now)
    return found
