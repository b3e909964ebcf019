"""Shared pieces of the training-data operators: hashing of whole texts, chunk counts,
checkpoints and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: ASCII white space, 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SLICE = 1 << 18
_MUL = 0x9E3779B97F4A7C15 | 1
_ROLL = 0xD6E8FEB86659FD93 | 1


def table(sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """spark.checkpoint.dir of the session. Where it is unset, a folder below the warehouse, which all executors share as well."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """For jobs of many steps: shuffle files of frames made within are deleted when a query of theirs has ended, as each step is read from
    its checkpoint. Without it they stay until the driver's JVM happens to collect garbage, while the executors' disks fill up. Should a
    later query need a file that has gone, Spark runs its stage again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parts_for(df: DataFrame, mb: float) -> int:
    """How many parts of about mb MB df makes, 1 at least, by the optimizer's estimate; where that knows nothing (frames from
    memory or checkpoints), by the bytes of its strings, counted."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        strings = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
        size = sum(df.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in strings]).first())
    return max(1, math.ceil(size / (mb * 1e6)))


def bucket_runs(u: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes dealt to equal ranges: the buckets that occur, and the bounds of their runs (one more). Buckets below 2**32."""
    b = ((u >> U64(32)) * U64(buckets)) >> U64(32)
    starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    return b[starts].astype(np.int64), np.append(starts, len(u))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche over uint64 (wraps)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(_MUL))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept up to 4 M entries."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 18, 1 << (max(1, n) - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def spans_of(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-separators."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~separators[buf]
    edges = np.flatnonzero(np.diff(word))
    return edges[0::2], edges[1::2]


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """64-bit hash of each white-space word of texts. Returns hashes, word bounds per text (len+1),
    starts and ends in the joined bytes, and the joined bytes. Works through slices that end at white space,
    so that the arrays beside the result stay small for any text."""
    joined = b" ".join(texts)
    if lower:
        joined = joined.lower()
    buf = np.frombuffer(joined, np.uint8)
    n, at = len(buf), 0
    hs, ss, es = [], [], []
    tab = _byte_table()
    while at < n:
        end = min(at + _SLICE, n)
        if end < n:
            gaps = np.flatnonzero(SPACE[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < n and not SPACE[buf[end]]:
                    end += 1
        part = buf[at:end]
        s, e = spans_of(part, SPACE)
        if len(s):
            up, down = _powers(_MUL, len(part) + 1)
            pre = np.zeros(len(part) + 1, U64)
            np.cumsum(tab[part] * up[:-1], out=pre[1:])
            hs.append(mix64((pre[e] - pre[s]) * down[s]))
            ss.append(s + at)
            es.append(e + at)
        at = end
    if hs:
        h, s, e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
    else:
        h, s, e = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 1, out=starts[1:])
    return h, np.searchsorted(s, starts), s, e, joined


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every run of k consecutive word hashes; len(h)-k+1 values."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    up, down = _powers(_ROLL, n + 1)
    pre = np.zeros(n + 1, U64)
    np.cumsum(h * up[:-1], out=pre[1:])
    return mix64((pre[k:] - pre[:-k]) * down[: n - k + 1] + U64(k))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start+count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)


def planes(a: np.ndarray) -> bytes:
    """Bytes of a fixed-width array, plane by plane: sorted or small numbers compress well in shuffles."""
    if not len(a):
        return b""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    w = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(w, -1).T).view(dtype).ravel()


def packed(table: pa.Table) -> bytes:
    """A table as compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links, undirected, to (node, component): the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars around the smallest nodes; each round is
    cut by a checkpoint. Nodes without a link don't appear. Null ends are dropped. Only two scalars a round reach
    the driver."""
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpoint(e)
    before = None
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
