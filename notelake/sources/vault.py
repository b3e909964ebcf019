"""Vaults of Markdown notes: listing of folder trees by tasks, the contents of listed notes, and a note view over document tables.

A scan goes breadth-first: folders that are still to be listed are the rows of a frontier, dealt evenly to tasks. A task lists folders and goes on with
those below until it has listed `share` of them; what is left is the next frontier. So a deep or lopsided tree is shared, each folder is
listed once, and a small vault takes one job. Times and sizes that don't come with a listing are asked for in a further step, dealt by the number of files.
Nothing is opened, and hidden names other than pruned ones are listed, which Spark's file sources leave out.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.graph import saved

from .places import Local, Store, place_of

FILES = "vault string, root string, rel_path string, mtime double, length long, readable boolean"
_BATCH = 1 << 23
#: Opens a root; another one than place_of reaches stores that Arrow has no scheme for.
Places = Callable[[str], Local | Store]


def throttle(done: int, began: float, pause: float, rate: float) -> None:
    """Waits after each file: a fixed pause, or until the task is no faster than its rate."""
    if pause > 0:
        time.sleep(pause)
    elif rate > 0 and (ahead := done / rate - (time.monotonic() - began)) > 0:
        time.sleep(ahead)


def _walked(batches: Iterator[pa.RecordBatch], places: Places, pruned: set[str], share: int) -> Iterator[tuple]:
    """(root, path, time, size, whether it is a folder that is still to be listed) below the folders of the batches."""
    done = 0
    for b in batches:
        left = list(zip(b.column("root").to_pylist(), b.column("rel_path").to_pylist(), strict=True))[::-1]
        while left:
            root, folder = left.pop()
            if done >= share:
                yield root, folder, None, None, True
                continue
            done += 1
            try:
                for name, is_folder, mtime, size in places(root).listed(folder):
                    path = f"{folder}/{name}" if folder else name
                    if not is_folder:
                        yield root, path, mtime, size, False
                    elif name not in pruned:
                        left.append((root, path))
            except OSError:
                continue  # a folder that can't be read, or has gone


def _frames(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    some = []
    for r in rows:
        some.append(r)
        if len(some) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)


def listing(spark: SparkSession, roots: list[str], pruned: set[str], places: Places = place_of, share: int = 64) -> DataFrame:
    """root, rel_path, mtime, length (null where they have to be asked for) of all files below the roots."""
    names, types = ["root", "rel_path", "mtime", "length", "folder"], [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_()]
    left, n, out = spark.createDataFrame([(r, "") for r in roots], "root string, rel_path string"), len(roots), None
    most = 4 * spark.sparkContext.defaultParallelism
    while n:
        found = left.repartition(min(n, most)).mapInArrow(lambda b: _frames(_walked(b, places, pruned, share), names, types), "root string, rel_path string, mtime double, length long, folder boolean")
        found = saved(found)
        out = found if out is None else out.unionByName(found)
        left = found.where("folder").select("root", "rel_path")
        n = left.count()
    return out.where("not folder").drop("folder")


def scan(
    spark: SparkSession, *roots: str, max_file_mb: float = 5, pruned: str = ".obsidian", sleep_ms: float = 0, max_files_per_sec: float = 0, places: Places = place_of, share: int = 64
) -> DataFrame:
    """All files of one or more vaults, with the reason why a file is skipped (null for notes). Names, sizes and times only. pruned: folder names;
    max_files_per_sec: of a task."""
    files = listing(spark, list(roots), set(filter(None, pruned.split(","))), places, share)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        began, done = time.monotonic(), 0
        for b in batches:
            for root, path, mtime, size in zip(*(b.column(c).to_pylist() for c in ("root", "rel_path", "mtime", "length")), strict=True):
                vault, readable = root.rstrip("/").rpartition("/")[2], True
                if mtime is None or size is None:
                    try:
                        mtime, size = places(root).stat(path)
                    except OSError:
                        mtime = size = None
                        readable = False
                done += 1
                throttle(done, began, sleep_ms / 1000, max_files_per_sec)
                yield vault, root, path, mtime, size, readable

    names, types = ["vault", "root", "rel_path", "mtime", "length", "readable"], [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_()]
    n = min(files.count() // 1000 + 1, 4 * spark.sparkContext.defaultParallelism)
    rows = files.repartition(n).mapInArrow(lambda b: _frames(asked(b), names, types), FILES)
    return saved(rows).withColumn("skipped", skip_reason(max_file_mb))


def skip_reason(max_file_mb: float = 5) -> Column:
    """Why a listed file is no note; null for notes."""
    return F.when(~F.col("readable"), "no_permission").when(~F.lower("rel_path").endswith(".md"), "non_md").when(F.col("length") > int(max_file_mb * 1024 * 1024), "too_large")


def skip_counts(files: DataFrame) -> DataFrame:
    """One row: non_md, too_large, no_permission."""
    return files.agg(*[F.count_if(F.col("skipped") == k).alias(k) for k in ("non_md", "too_large", "no_permission")])


def contents(files: DataFrame, places: Places = place_of) -> DataFrame:
    """Listed notes that aren't skipped, with their bytes. A file that has gone or can't be read since is left out. Only these files are opened, a few MB
    of them at a time."""
    listed = files.where("skipped is null").select("vault", "root", "rel_path", "mtime", "length")
    names = [*listed.columns, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, data, size = [], [], 0
            for i, (root, rel) in enumerate(zip(b.column("root").to_pylist(), b.column("rel_path").to_pylist(), strict=True)):
                try:
                    data.append(places(root).read(rel))
                except OSError:
                    continue
                at.append(i)
                size += len(data[-1])
                if size > _BATCH:
                    yield _rows(b, at, data, names)
                    at, data, size = [], [], 0
            if at:
                yield _rows(b, at, data, names)

    return listed.mapInArrow(run, "vault string, root string, rel_path string, mtime double, length long, content binary")


def _rows(b: pa.RecordBatch, at: list[int], data: list[bytes], names: list[str]) -> pa.RecordBatch:
    part = b.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=names)


def notes_of(files: DataFrame, places: Places = place_of) -> DataFrame:
    """Notes with decoded content (malformed UTF-8 replaced), title, digest and times."""
    name = F.element_at(F.split("rel_path", "/"), -1)
    return contents(files, places).select(
        "vault", "rel_path", F.regexp_replace(name, r"(?i)\.md$", "").alias("title"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("mtime"), F.timestamp_micros((F.col("mtime") * 1000000).cast("long")).alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"),
    )


def exclude(notes: DataFrame, folders: list[str] = (".obsidian", ".trash"), names: list[str] = ()) -> DataFrame:
    """Drops notes below a folder of the list, and notes whose title equals a name or matches it as a glob."""
    out = notes.where(~F.arrays_overlap(F.split("rel_path", "/"), F.array(*map(F.lit, folders)))) if folders else notes
    for n in names:
        out = out.where(~(F.col("title").rlike(glob(n)) if "*" in n else F.col("title") == n))
    return out


def glob(pattern: str) -> str:
    """Regular expression of a shell pattern (*, ?, [...])."""
    import fnmatch

    return "^(?s:" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + ")$"


def note_view(documents: DataFrame, n: int, linked: str = "doc_id % 5 <> 0", end: str = "", days: int = 240) -> DataFrame:
    """Notes made of documents: synthesised front-matter, links and tags around the text; vault = lang, folder = source. linked: which notes
    have links of their own; end: what all notes end with; days: how far back the last changes are spread."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string") if isinstance(c, Column) else F.lit(c)
    cat = lambda *p: F.concat(*map(s, p))
    front = F.when(i % 3 == 0, cat("---\nkeywords: [", F.col("lang"), ", ", F.col("source"), "]\n---\n")).otherwise("")
    links = F.when(F.expr(linked), cat("[[note-", (i * 7 + 3) % n, "]] [[note-", (i * 13 + 5) % (2 * n), "|alias]]\n")).otherwise("")
    tags = F.when(i % 4 == 0, "").otherwise(cat("#", F.col("lang"), " #", F.col("source")))
    return documents.select(
        i.alias("doc_id"), F.col("lang").alias("vault"), cat(F.col("source"), "/note-", i, ".md").alias("rel_path"), cat("note-", i).alias("title"),
        F.concat(front, F.coalesce("text", F.lit("")), F.lit("\n"), links, tags, F.lit(end)).alias("content"),
        (F.lit("2024-06-30 00:00:00").cast("timestamp_ntz") - F.make_dt_interval((i % days).cast("int"))).alias("modified"),
    )


def view(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return note_view(docs, docs.count(), **how)
