"""Removal of passages that an earlier document already holds.

Every window of a fixed number of words gets Rabin-Karp hashes. Documents are dealt into chunks by doc_id and text, and windows meet in
buckets of their hash, in two rounds. First a chunk sends 48 bits of each of its distinct windows, and learns which of them other chunks have
too. Then it sends 128 bits of those windows only, once each, with the smallest doc_id that has it, and learns which of
its windows start in an earlier document elsewhere. The chunk merges the windows of each document into maximal removal intervals. A
window that a third of all documents share costs one entry a chunk, so no key grows with its number of occurrences.

A bucket gets one row a chunk. Beyond `fan` chunks, they meet in groups of `fan` first: a group merges the windows of its chunks
and takes part in the next level as one chunk with finer buckets, so rows never shrink to single windows.

Windows are equal if 128 bits of hash are, made of 64-bit hashes of the words: at 10^13 windows a false meeting has a probability of about
10^-13. Defined results: null and empty texts have no words; documents with fewer words than a window lose nothing; rows of equal
doc_id don't take words from each other; a null doc_id counts as larger than all others, so such rows can lose words, but take none; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bucket_runs, hash_words, mix64, parts_for, planes, ranges, unplanes, window_hashes

_LAST = np.iinfo(np.int64).max
_SECOND = U64(0xC2B2AE3D27D4EB4F)
SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text binary"
#: Rows between chunks and buckets: 48-bit keys, or both hashes with a doc_id.
_MET, _FIRST, _LATE = "c int, b long, k binary", "c int, b long, k binary, k2 binary, d binary", "c int, b long, k binary, k2 binary"


class _Chunk:
    """Rows of a chunk in doc_id order, with word bounds and, of each window, its start, row and two hashes."""

    def __init__(self, table: pa.Table, k: int, second: bool = True):
        ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        texts = [t or b"" for t in table.column("text").to_pylist()]
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.texts = ids[self.order], [texts[i] for i in self.order]
        words, self.bounds, *_ = hash_words(self.texts)
        counts = np.maximum(np.diff(self.bounds) - k + 1, 0)
        self.starts = ranges(self.bounds[:-1], counts)
        self.own = np.repeat(np.arange(len(ids)), counts)
        of = lambda h: window_hashes(h, k)[self.starts] if len(self.starts) else np.zeros(0, U64)
        self.h1 = of(words)
        self.h2 = of(mix64(words ^ _SECOND)) if second else None


def _pack48(k: np.ndarray) -> bytes:
    return np.ascontiguousarray(k.astype("<u8").view(np.uint8).reshape(len(k), 8)[:, :6].T).tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    x = np.zeros((len(b) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(b, np.uint8).reshape(6, -1).T
    return x.view("<u8").ravel().astype(U64)


def _column(table: pa.Table, name: str, of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and the row of each."""
    parts = [of(x) for x in table.column(name).to_pylist()]
    none = np.zeros(0, U64)
    return np.concatenate([none, *parts]) if parts else none, np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def _signed(x: bytes) -> np.ndarray:
    return unplanes(x, np.int64).view(U64)


def _hashes(x: bytes) -> np.ndarray:
    return unplanes(x, U64)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys, and the group number of each sorted row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _met_rows(c: int, k: np.ndarray, buckets: int) -> pa.Table:
    b, at = bucket_runs(k << U64(16), buckets)
    packed = [_pack48(k[at[i] : at[i + 1]]) for i in range(len(b))]
    return pa.table({"c": pa.array(np.full(len(b), c), pa.int32()), "b": pa.array(b, pa.int64()), "k": pa.array(packed, pa.binary())})


def _first_rows(c: int, h1: np.ndarray, h2: np.ndarray, d: np.ndarray, buckets: int) -> pa.Table:
    """Rows of windows in the order of their hashes, with the smallest doc_id of each."""
    order, run = _runs(h1, h2)
    at = np.flatnonzero(np.diff(run, prepend=-1))
    first = order[at]
    least = np.minimum.reduceat(d[order], at) if len(at) else d[:0]
    b, cut = bucket_runs(h1[first], buckets)
    part = lambda x: pa.array([planes(x[cut[i] : cut[i + 1]]) for i in range(len(b))], pa.binary())
    return pa.table({"c": pa.array(np.full(len(b), c), pa.int32()), "b": pa.array(b, pa.int64()), "k": part(h1[first]), "k2": part(h2[first]), "d": part(least)})


def _merge_met(table: pa.Table, c: int, buckets: int) -> pa.Table:
    return _met_rows(c, np.unique(_column(table, "k", _unpack48)[0]), buckets)


def _merge_first(table: pa.Table, c: int, buckets: int) -> pa.Table:
    h1, h2, d = (_column(table, n, f)[0] for n, f in (("k", _hashes), ("k2", _hashes), ("d", _signed)))
    return _first_rows(c, h1, h2, d.view(np.int64), buckets)


def _answers(table: pa.Table, row: np.ndarray, **packed) -> pa.Table:
    """The chosen values of each row, sent back to its chunk; rows without any are left out."""
    at = np.searchsorted(row, np.arange(table.num_rows + 1))
    some = [i for i in range(table.num_rows) if at[i + 1] > at[i]]
    own = table.select(["c", "b"]).take(pa.array(some, pa.int64()))
    return pa.table({"c": own.column("c").cast(pa.int32()), "b": own.column("b"), **{n: pa.array([f(v[at[i] : at[i + 1]]) for i in some], pa.binary()) for n, (v, f) in packed.items()}})


def _meet(table: pa.Table, back: pa.Table | None) -> pa.Table:
    """Keys that occur in two rows of a bucket, or that the level above met."""
    k, row = _column(table, "k", _unpack48)
    known = _column(back, "k", _unpack48)[0] if back is not None else k[:0]
    u, inv, n = np.unique(np.concatenate([k, known]), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[inv[: len(k)]] > 1)
    return _answers(table, row[twice], k=(k[twice], _pack48))


def _judge(table: pa.Table, back: pa.Table | None) -> pa.Table:
    """Windows whose smallest doc_id here is larger than that of another row, or that are late on the level above."""
    (h1, row), h2, d = _column(table, "k", _hashes), _column(table, "k2", _hashes)[0], _column(table, "d", _signed)[0].view(np.int64)
    late = [_column(back, n, _hashes)[0] if back is not None else h1[:0] for n in ("k", "k2")]
    order, run = _runs(np.concatenate([h1, late[0]]), np.concatenate([h2, late[1]]))
    at = np.flatnonzero(np.diff(run, prepend=-1))
    # What is late above ranks before every doc_id.
    rank = np.concatenate([d, np.full(len(late[0]), np.iinfo(np.int64).min)])[order]
    least = np.minimum.reduceat(rank, at)[run] if len(at) else rank
    gone = np.sort(order[rank > least])
    return _answers(table, row[gone], k=(h1[gone], planes), k2=(h2[gone], planes))


def _levels(sent: DataFrame, n: int, fan: int, buckets: int, schema: str, schema_back: str, merge: Callable, meet: Callable) -> DataFrame:
    """Answers to the rows (c, b, ...) of n chunks."""
    if n <= fan:
        return sent.groupBy("b").applyInArrow(lambda t: meet(t, None), schema_back)
    fine = buckets * fan

    def up(table: pa.Table) -> pa.Table:
        return merge(table, table.column("g")[0].as_py(), fine)

    grouped = sent.withColumn("g", F.floor(F.col("c") / fan).cast("int"))
    above = _levels(grouped.groupBy("g", "b").applyInArrow(up, schema), -(-n // fan), fan, fine, schema, schema_back, merge, meet)
    above = above.withColumnRenamed("c", "g").withColumn("b", F.floor(F.col("b") / fan).cast("long"))
    return grouped.groupBy("g", "b").cogroup(above.groupBy("g", "b")).applyInArrow(meet, schema_back)


def remove_repeats(docs: DataFrame, window: int = 50, chunk_mb: float = 4.0, fan: int = 1024) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word intervals, end exclusive) and kept_text of each row."""
    n = parts_for(docs, chunk_mb)
    buckets = min(n, fan)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("c", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def entries(table: pa.Table) -> pa.Table:
        return _met_rows(table.column("c")[0].as_py(), np.unique(_Chunk(table, window, second=False).h1 >> U64(16)), buckets)

    def shared(table: pa.Table, met: pa.Table) -> pa.Table:
        if not table.num_rows or not met.num_rows:
            return _first_rows(0, *[np.zeros(0, U64)] * 2, np.zeros(0, np.int64), buckets)
        x, keys = _Chunk(table, window), np.unique(_column(met, "k", _unpack48)[0])
        k = x.h1 >> U64(16)
        some = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k)
        return _first_rows(table.column("c")[0].as_py(), x.h1[some], x.h2[some], x.ids[x.own[some]], buckets)

    def cut(table: pa.Table, late: pa.Table) -> pa.Table:
        x = _Chunk(table, window)
        h1, h2 = (_column(late, name, _hashes)[0] for name in ("k", "k2"))
        order, run = _runs(np.concatenate([x.h1, h1]), np.concatenate([x.h2, h2]))
        at = np.flatnonzero(np.diff(run, prepend=-1))
        d = np.concatenate([x.ids[x.own], np.full(len(h1), np.iinfo(np.int64).min)])[order]
        gone_at = order[d > (np.minimum.reduceat(d, at)[run] if len(at) else d)]
        s = x.starts[gone_at]
        cover = np.zeros(int(x.bounds[-1]) + 1, np.int32)
        np.add.at(cover, s, 1)
        np.add.at(cover, s + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        pre = np.concatenate(([0], np.cumsum(gone)))
        removed = pre[x.bounds[1:]] - pre[x.bounds[:-1]]
        spans, kept = [], []
        for i, t in enumerate(x.texts):
            words = t.split()
            if removed[i]:
                g = gone[x.bounds[i] : x.bounds[i + 1]]
                e = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(e[0::2], e[1::2], strict=True)])
                words = [words[j] for j in np.flatnonzero(~g)]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(x.order)), "n_words": pa.array(np.diff(x.bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_text": pa.array(kept, pa.binary()),
        })

    met = _levels(base.groupBy("c").applyInArrow(entries, _MET), n, fan, buckets, _MET, _MET, _merge_met, _meet)
    first = base.groupBy("c").cogroup(met.groupBy("c")).applyInArrow(shared, _FIRST)
    late = _levels(first, n, fan, buckets, _FIRST, _LATE, _merge_first, _judge)
    out = base.groupBy("c").cogroup(late.groupBy("c")).applyInArrow(cut, SCHEMA)
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))
