"""Removal of byte strings that occur twice or more, by sorting suffixes column by column.

Each window of `window` bytes has an anchor: its `seed`-byte substring of the smallest hash, the first of equals. Consecutive windows of one
anchor make a piece, a string of fewer than 2 * `window` bytes. Equal windows have equal anchors at equal offsets, so they meet among the
pieces of one anchor, aligned at it, in one column. Such a collection of pieces is sorted from its last column to its first: a round inserts
the next symbol of every piece, which is the column's part of the collection's Burrows-Wheeler transform in the order so far; its
stable sort by symbol is the new order, and the common prefix of two neighbours is one more than the least of those between
them before. A window is repeated if a neighbour shares as many bytes as it is long. As only equal columns can match, a round touches each
piece once, and the work is linear in the bytes of the pieces.

The sequential files of the construction are Spark's shuffle files: chunks of documents (dealt by doc_id and text) send each bucket of
anchors one row of packed, compressed pieces, and get back which windows are repeated. Before, chunks exchange 48-bit hashes of their
anchors and send only pieces whose anchor occurs again. Pieces that are equal within a chunk go once. An anchor with more than `heavy`
different pieces (the edge of a passage that a third of all documents share) is split: its windows go as pieces of their own, dealt by
the hash of the whole window, so equal ones meet, one of each chunk. Beyond `fan` chunks, chunks meet in groups first, level by level.

Pieces are told apart by 48 bits of their anchor and 64 bits of their content; bytes decide what is repeated. Defined results: null
and empty texts have no bytes; texts shorter than a window lose nothing; rows are documents, so all rows of a repeated or null doc_id with
equal texts lose what they share; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _byte_table, _powers, U64, bucket_runs, mix64, parts_for, planes, unplanes  # isort: skip
from .substring import _hashes, _column, _levels, _pack48, _unpack48  # isort: skip

SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_SEEN, _SEEN_BACK = "c int, b long, k binary, n binary", "c int, b long, k binary, hot binary"
_PIECES, _BACK = "c int, b long, k binary, h binary, left binary, size binary, many binary, body binary", "c int, b long, h binary, n binary, bits binary"
_BASE, _SLICE = 0xA0761D6478BD642F | 1, 1 << 18
#: No byte of UTF-8 text.
_OUT = 255


@dataclass
class _Pieces:
    """Pieces of a chunk: anchor hash (mixed once more, as anchors have small hashes), content hash, first window, bytes before the anchor, windows."""

    k: np.ndarray
    h: np.ndarray
    start: np.ndarray
    left: np.ndarray
    n: np.ndarray


class _Chunk:
    """Texts of a chunk, joined by a byte that no text has."""

    def __init__(self, table: pa.Table, window: int, seed: int):
        self.texts = [t or b"" for t in table.column("text").to_pylist()]
        self.joined = bytes([_OUT]).join(self.texts)
        self.buf = np.frombuffer(self.joined, np.uint8)
        sizes = np.fromiter((len(t) for t in self.texts), np.int64, len(self.texts))
        self.at = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.window, self.seed = window, seed

    def _sums(self, a: int, b: int):
        up, down = _powers(_BASE, b - a + 1)
        pre = np.zeros(b - a + 1, U64)
        np.cumsum(_byte_table()[self.buf[a:b]] * up[:-1], out=pre[1:])
        return pre, down

    def slices(self):
        """(a, b, valid windows from a on) in steps whose positions fit in 18 bits."""
        step = _SLICE - self.window
        for a in range(0, max(0, len(self.buf) - self.window + 1), step):
            b = min(len(self.buf), a + step + self.window - 1)
            out = np.concatenate(([0], np.cumsum(self.buf[a:b] == _OUT)))
            yield a, b, out[self.window :] == out[: b - a - self.window + 1]

    def pieces(self) -> _Pieces:
        w, s, parts = self.window, self.seed, []
        for a, b, valid in self.slices():
            pre, down = self._sums(a, b)
            grams = mix64((pre[s:] - pre[:-s]) * down[: b - a - s + 1])
            least = (grams & ~U64(_SLICE - 1)) | np.arange(len(grams), dtype=U64)
            width, span = 1, w - s + 1
            while 2 * width <= span:
                least, width = np.minimum(least[:-width], least[width:]), 2 * width
            least = np.minimum(least[: len(valid)], least[span - width : span - width + len(valid)])
            anchor = np.where(valid, (least & U64(_SLICE - 1)).astype(np.int64), -1)
            first = np.flatnonzero(np.diff(anchor, prepend=-2))
            n = np.diff(np.append(first, len(anchor)))
            some = anchor[first] >= 0
            first, n, at = first[some], n[some], anchor[first[some]]
            parts.append(_Pieces(mix64(grams[at]) >> U64(16), self._identity(pre, down, first, n + w - 1, at - first), first + a, at - first, n))
        none = _Pieces(*[np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64)])
        return _Pieces(*[np.concatenate([getattr(p, f) for p in [none, *parts]]) for f in ("k", "h", "start", "left", "n")])

    @staticmethod
    def _identity(pre, down, first, size, left) -> np.ndarray:
        return mix64((pre[first + size] - pre[first]) * down[first] + mix64(size.astype(U64) << U64(20) | left.astype(U64)))

    def window_hashes(self):
        """(start, identity) of every window, slice by slice."""
        for a, b, valid in self.slices():
            pre, down = self._sums(a, b)
            first = np.flatnonzero(valid)
            yield first + a, self._identity(pre, down, first, np.full(len(first), self.window), np.zeros(len(first), np.int64))

    def singles(self, p: _Pieces) -> _Pieces:
        """Each window of the pieces as a piece of its own, known by its content."""
        inside = np.zeros(len(self.buf) + 1, np.int8)
        np.add.at(inside, p.start, 1)
        np.add.at(inside, p.start + p.n, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        found = [(s[inside[s]], h[inside[s]]) for s, h in self.window_hashes()]
        start, h = (np.concatenate([np.zeros(0, t), *[x[i] for x in found]]) for i, t in ((0, np.int64), (1, U64)))
        return _Pieces(h >> U64(16), h, start, np.zeros(len(h), np.int64), np.ones(len(h), np.int64))


def _seen_rows(c: int, k: np.ndarray, n: np.ndarray, buckets: int) -> pa.Table:
    """Rows of anchors, sorted, with the number of their pieces."""
    b, at = bucket_runs(k << U64(16), buckets)
    part = lambda x, f: pa.array([f(x[at[i] : at[i + 1]]) for i in range(len(b))], pa.binary())
    return pa.table({"c": pa.array(np.full(len(b), c), pa.int32()), "b": pa.array(b, pa.int64()), "k": part(k, _pack48), "n": part(n, planes)})


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All anchors and the row of each, the distinct ones, and how many pieces each of these has."""
    (k, row), n = _column(table, "k", _unpack48), _column(table, "n", _counts)[0]
    u, inv = np.unique(k, return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, inv, n.astype(np.int64))
    return k, row, u, total


def _counts(x: bytes) -> np.ndarray:
    return unplanes(x, np.uint32).astype(U64)


def _merge_seen(table: pa.Table, c: int, buckets: int) -> pa.Table:
    _, _, u, total = _summed(table)
    return _seen_rows(c, u, np.minimum(total, 1 << 31).astype(np.uint32), buckets)


def _meet_seen(heavy: int):
    def meet(table: pa.Table, back: pa.Table | None) -> pa.Table:
        """Anchors of two rows of a bucket or met above, and those with too many pieces."""
        k, row, u, total = _summed(table)
        known, hot = (np.unique(_column(back, n, _unpack48)[0]) if back is not None else k[:0] for n in ("k", "hot"))
        at = np.searchsorted(u, k)
        much = (total > heavy) | np.isin(u, hot)
        met = (np.bincount(at, minlength=len(u)) > 1) | np.isin(u, known)
        cut = np.searchsorted(row, np.arange(table.num_rows + 1))
        rows = [(at[cut[i] : cut[i + 1]], k[cut[i] : cut[i + 1]]) for i in range(table.num_rows)]
        keys = lambda flag: pa.array([_pack48(x[flag[j]]) for j, x in rows], pa.binary())
        return pa.table({"c": table.column("c").cast(pa.int32()), "b": table.column("b").cast(pa.int64()), "k": keys(met & ~much), "hot": keys(much)})

    return meet


def _piece_rows(c: int, p: _Pieces, many: np.ndarray, body, window: int, buckets: int) -> pa.Table:
    """Rows of pieces sorted by anchor. body: the bytes of the i-th piece."""
    b, at = bucket_runs(p.k << U64(16), buckets)
    pack = zstandard.ZstdCompressor(level=3).compress
    each = lambda f: pa.array([f(slice(at[i], at[i + 1])) for i in range(len(b))], pa.binary())
    return pa.table({
        "c": pa.array(np.full(len(b), c), pa.int32()), "b": pa.array(b, pa.int64()), "k": each(lambda s: _pack48(p.k[s])), "h": each(lambda s: planes(p.h[s])),
        "left": each(lambda s: planes(p.left[s].astype(np.int32))), "size": each(lambda s: planes((p.n[s] + window - 1).astype(np.int32))), "many": each(lambda s: planes(many[s].astype(np.uint8))),
        "body": each(lambda s: pack(b"".join(body(i) for i in range(s.start, s.stop)))),
    })


def _received(table: pa.Table, window: int):
    """Pieces of all rows (start: the first byte in the joined bodies), their rows, flags, and the bytes."""
    (k, row), h = _column(table, "k", _unpack48), _column(table, "h", _hashes)[0]
    small = lambda name, t: _column(table, name, lambda x: unplanes(x, t).astype(U64))[0].astype(np.int64)
    left, size, many = small("left", np.int32), small("size", np.int32), small("many", np.uint8) > 0
    body = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table.column("body").to_pylist())
    return _Pieces(k, h, np.cumsum(size) - size, left, size - window + 1), row, many, body


def _merge_pieces(window: int):
    def merge(table: pa.Table, c: int, buckets: int) -> pa.Table:
        p, _, many, body = _received(table, window)
        order = np.lexsort((p.h, p.k))
        new = np.flatnonzero(np.append(True, (np.diff(p.k[order]) != 0) | (np.diff(p.h[order]) != 0))[: len(order)])
        some = order[new]
        twice = (np.add.reduceat(many[order].astype(np.int64), new) > 0) | (np.diff(np.append(new, len(order))) > 1) if len(new) else many
        q = _Pieces(p.k[some], p.h[some], p.start[some], p.left[some], p.n[some])
        return _piece_rows(c, q, twice, lambda i: body[q.start[i] : q.start[i] + q.n[i] + window - 1], window, buckets)

    return merge


def repeated_windows(body: bytes, start: np.ndarray, left: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Of pieces aligned at their anchors: whether each window occurs in another piece too, all windows one after another."""
    m, width = len(start), int(left.max()) if len(left) else 0
    first = width - left
    size = n + window - 1
    rounds = int((first + size).max()) if m else 0
    grid = np.full((m, rounds), _OUT, np.uint8)
    buf = np.frombuffer(body, np.uint8)
    for i in range(m):
        grid[i, first[i] : first[i] + size[i]] = buf[start[i] : start[i] + size[i]]
    columns = np.ascontiguousarray(grid.T)
    del grid
    found, base = np.zeros(int(n.sum()), bool), np.cumsum(n) - n
    order, common = np.arange(m), np.zeros(m + 1, np.int16)
    for c in range(rounds - 1, -1, -1):
        bwt = columns[c][order]
        to = np.argsort(bwt, kind="stable")
        symbol, order = bwt[to], order[to]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != _OUT)) + 1
        after = np.zeros(m + 1, np.int16)
        if len(same):
            ends = np.empty(2 * len(same), np.int64)
            ends[0::2], ends[1::2] = to[same - 1] + 1, to[same] + 1
            after[same] = np.minimum.reduceat(common, ends)[::2] + 1
        common = after
        long = common >= window
        hit = order[long[:-1] | long[1:]]
        if len(hit):
            own = c - first[hit]
            inside = (own >= 0) & (own < n[hit])
            found[base[hit[inside]] + own[inside]] = True
    return found


def _meet_pieces(window: int):
    def meet(table: pa.Table, back: pa.Table | None) -> pa.Table:
        """Windows that occur in two pieces, in a piece that is there twice, or that are repeated on the level above."""
        p, row, many, body = _received(table, window)
        found = repeated_windows(body, p.start, p.left, p.n, window) | np.repeat(many, p.n)
        base = np.append(0, np.cumsum(p.n))
        if back is not None and back.num_rows:
            h, n, bits = _answers(back)
            piece, at = _matches(p.h, p.n, h, n)
            cut = np.append(0, np.cumsum(n))
            for i, j in zip(piece, at, strict=True):
                found[base[i] : base[i + 1]] |= bits[cut[j] : cut[j + 1]]
        some = np.add.reduceat(found, base[:-1], dtype=np.int64) > 0 if len(p.n) else np.zeros(0, bool)
        rows = [np.flatnonzero(some & (row == i)) for i in range(table.num_rows)]
        bits = lambda r: np.packbits(np.concatenate([found[base[i] : base[i + 1]] for i in r])).tobytes() if len(r) else b""
        return pa.table({
            "c": table.column("c").cast(pa.int32()), "b": table.column("b").cast(pa.int64()), "h": pa.array([planes(p.h[r]) for r in rows], pa.binary()),
            "n": pa.array([planes(p.n[r].astype(np.int32)) for r in rows], pa.binary()), "bits": pa.array([bits(r) for r in rows], pa.binary()),
        })

    return meet


def _answers(back: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identities of pieces with repeated windows, sorted, the number of windows, and one flag a window."""
    h, n, bits = _column(back, "h", _hashes)[0], [], []
    for a, x in zip(back.column("n").to_pylist(), back.column("bits").to_pylist(), strict=True):
        n.append(unplanes(a, np.int32).astype(np.int64))
        bits.append(np.unpackbits(np.frombuffer(x, np.uint8), count=int(n[-1].sum())).astype(bool))
    n = np.concatenate([np.zeros(0, np.int64), *n])
    flags = np.concatenate([np.zeros(0, bool), *bits])
    order, cut = np.argsort(h, kind="stable"), np.append(0, np.cumsum(n))
    return h[order], n[order], np.concatenate([flags[:0], *[flags[cut[i] : cut[i + 1]] for i in order]])


def _matches(h: np.ndarray, n: np.ndarray, known: np.ndarray, known_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pieces that answers name, and of their answers."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    own = np.flatnonzero((known[at] == h) & (known_n[at] == n))
    return own, at[own]


def remove_repeated_bytes(docs: DataFrame, window: int = 200, seed: int = 64, chunk_mb: float = 4.0, heavy: int = 20_000, fan: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs, end exclusive) and kept (the remaining bytes) of each row."""
    n = parts_for(docs, chunk_mb)
    buckets = min(n, fan)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    base = base.withColumn("c", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def seen(table: pa.Table) -> pa.Table:
        p = _Chunk(table, window, seed).pieces()
        pair = np.unique(np.stack([p.k, p.h], 1), axis=0)[:, 0] if len(p.k) else p.k
        k, count = np.unique(pair, return_counts=True)
        return _seen_rows(table.column("c")[0].as_py(), k, count.astype(np.uint32), buckets)

    def cut(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f: pa.array([], t) for f, t in (("c", pa.int32()), ("b", pa.int64()), *[(x, pa.binary()) for x in ("k", "h", "left", "size", "many", "body")])})
        x = _Chunk(table, window, seed)
        p = x.pieces()
        met, hot = (np.unique(_column(back, name, _unpack48)[0]) for name in ("k", "hot"))
        u, at, times = np.unique(p.k, return_inverse=True, return_counts=True)
        much = np.isin(u, hot)
        keep = (((times > 1) | np.isin(u, met)) & ~much)[at]
        one = x.singles(_Pieces(*[getattr(p, f)[much[at]] for f in ("k", "h", "start", "left", "n")])) if much.any() else _Pieces(*[getattr(p, f)[:0] for f in ("k", "h", "start", "left", "n")])
        p = _Pieces(*[np.concatenate([getattr(p, f)[keep], getattr(one, f)]) for f in ("k", "h", "start", "left", "n")])
        order = np.lexsort((p.left, p.h, p.k))
        new = np.flatnonzero(np.append(True, (np.diff(p.k[order]) != 0) | (np.diff(p.h[order]) != 0))[: len(order)])
        many = np.diff(np.append(new, len(order))) > 1
        q = _Pieces(*[getattr(p, f)[order[new]] for f in ("k", "h", "start", "left", "n")])
        return _piece_rows(table.column("c")[0].as_py(), q, many, lambda i: x.joined[q.start[i] : q.start[i] + q.n[i] + window - 1], window, buckets)

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        x = _Chunk(table, window, seed)
        gone = [np.zeros(0, np.int64)]
        if back.num_rows:
            h, n_bits, bits = _answers(back)
            p, at = x.pieces(), np.append(0, np.cumsum(n_bits))
            own, answer = _matches(p.h, p.n, h, n_bits)
            gone += [s + np.flatnonzero(bits[at[j] : at[j + 1]]) for s, j in zip(p.start[own], answer, strict=True)]
            if len(one := h[n_bits == 1]):
                gone += [s[np.isin(w, one)] for s, w in x.window_hashes()]
        starts = np.unique(np.concatenate(gone))
        new = np.flatnonzero(np.append(True, np.diff(starts) > window)[: len(starts)])
        begin, end = starts[new], starts[np.append(new[1:], len(starts)) - 1] + window if len(new) else starts
        own = np.searchsorted(x.at, begin, side="right") - 1
        rows = np.searchsorted(own, np.arange(len(x.texts) + 1))
        spans, removed, kept = [], [], []
        for i, t in enumerate(x.texts):
            s = slice(rows[i], rows[i + 1])
            a, b = begin[s] - x.at[i], end[s] - x.at[i]
            spans.append([{"start": int(f), "end": int(g)} for f, g in zip(a, b, strict=True)])
            removed.append(int((b - a).sum()))
            kept.append(b"".join(t[f:g] for f, g in zip([0, *b], [*a, len(t)], strict=True)) if len(a) else t)
        return pa.table({
            "doc_id": table.column("doc_id").cast(pa.int64()), "n_bytes": pa.array([len(t) for t in x.texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
        })

    met = _levels(base.groupBy("c").applyInArrow(seen, _SEEN), n, fan, buckets, _SEEN, _SEEN_BACK, _merge_seen, _meet_seen(heavy))
    sent = base.groupBy("c").cogroup(met.groupBy("c")).applyInArrow(cut, _PIECES)
    back = _levels(sent, n, fan, buckets, _PIECES, _BACK, _merge_pieces(window), _meet_pieces(window))
    return base.groupBy("c").cogroup(back.groupBy("c")).applyInArrow(finish, SCHEMA)
