"""Alignment of two tokenizers over the same bytes: minimal groups of tokens, links between overlapping tokens, and counts of linked pairs.

Texts are cut into segments at spaces that no token of either tokenizer crosses (a space between a printing character and another one: the
first tokenizer splits there by its pattern, the second has no piece with a space mark after another character), so a segment's tokens are the same
in every text, and each distinct segment of a chunk is encoded once. Over all segments of a chunk, tokens are the nodes of a bipartite graph, an
edge for each two that share a byte; union-find gives its components, which are the minimal groups, and the members of a component expand to
its links. Chunks of documents (dealt by doc_id and text) are encoded once and written as packed rows; each sends each distinct pair once, with the number of their documents that hold it
linked; Spark adds these up, finds the highest count of each first id, and sends each chunk the counts of its pairs. Beyond `fan` chunks, sums and
answers go by groups of chunks first, so that no pair has more rows in one task than `fan` or a `fan`-th of the chunks.

Defined results: texts that are null or empty, or whose tokens don't spell a space and the text, have no tokens; rows are documents, so equal rows
count as often as they are there; an empty table gives no rows. Other columns are ignored. Pairs hold as many rows in a chunk as it has different ones;
a text without any such space is one segment, encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import checkpoint, packed, parts_for, planes, ranges, unpacked, unplanes

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: A space between characters that no tokenizer takes for white space, and another one.
_CUT = re.compile(r"(?<=[!-~\w])(?= \S)")
_MARK = "▁"
#: Segments encoded at once, and segments of documents whose links are held at once.
_BATCH, _LINKS = 4096, 1 << 18


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printing Latin-1 ones themselves, the others from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _first(path: str):
    """Tokenizer with byte-level tokens, and the bytes of each id."""
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    value = _byte_values()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(value[c] for c in token) if all(c in value for c in token) else b""
    return t, out


@lru_cache(maxsize=2)
def _second(path: str):
    """Piece tokenizer, the bytes of each id, and whether texts may be cut at spaces."""
    t = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [t.id_to_piece(i) for i in range(t.vocab_size())]
    one = re.compile(r"<0x([0-9A-F]{2})>")
    out = [bytes([int(m[1], 16)]) if t.is_byte(i) and (m := one.fullmatch(p)) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
    return t, out, not any(_MARK in p.lstrip(_MARK) for p in pieces)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over all edges at once: the smallest node of each node's component."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if np.array_equal(low, high):
            return parent
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


class _Segments:
    """Tokens, groups and links of distinct segments; each has a stretch of every flat array. Encoded batch by batch into arrays."""

    def __init__(self, segments: list[str], path_a: str, path_b: str):
        self.paths = path_a, path_b
        parts = [self._encode(segments[i : i + _BATCH]) for i in range(0, len(segments), _BATCH)] or [self._encode([])]
        self.whole, a, self.n_a, size_a, b, self.n_b, size_b = (np.concatenate([p[i] for p in parts]) for i in range(7))
        del parts
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        # Every stretch between two ends lies in one token of either side: these are the edges.
        ends = np.union1d(end_a, end_b)
        u, v = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        group = components(len(a) + len(b), u, v + len(a))
        self.a, self.b, self.group_a, self.group_b = a, b, group[: len(a)], group[len(a) :]
        own, n = np.repeat(np.arange(len(segments)), self.n_a), len(segments)
        self.n_links = np.bincount(own[u], minlength=n)
        self.n_groups = np.bincount(own[np.flatnonzero(self.group_a == np.arange(len(a)))], minlength=n)
        self.link_at = np.cumsum(self.n_links) - self.n_links
        #: Distinct pairs, and the pair of each link.
        self.pairs, code = np.unique(a[u].astype(np.int64) << 32 | b[v], return_inverse=True)
        self.code = code.astype(np.int32)

    def _encode(self, segments: list[str]):
        """Whether the tokens spell each segment, and ids, numbers and bytes of both sides, of those that they spell."""
        (tok_a, bytes_a), (tok_b, bytes_b, _) = _first(self.paths[0]), _second(self.paths[1])
        ids = [[e.ids for e in tok_a.encode_batch_fast(segments, add_special_tokens=False)], tok_b.encode([s[1:] for s in segments], num_threads=1)] if segments else [[], []]
        spelt = [s.encode() for s in segments]
        want, text = np.fromiter(map(len, spelt), np.int64, len(spelt)), b"".join(spelt)
        whole, out = np.ones(len(segments), bool), []
        for of, own in zip((bytes_a, bytes_b), ids, strict=True):
            flat = list(chain.from_iterable(own))
            n = np.fromiter(map(len, own), np.int64, len(own))
            tokens = [of[i] for i in flat]
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            at = np.append(0, np.cumsum(n))
            got = np.diff(np.append(0, np.cumsum(size))[at])
            if not np.array_equal(got, want) or b"".join(tokens) != text:  # some are not spelt
                whole &= [b"".join(tokens[i:j]) == s for i, j, s in zip(at, at[1:], spelt, strict=False)]
            out += [np.array(flat, np.int32), n, size.astype(np.int32)]
        if not whole.all():
            for i in (0, 3):
                keep = np.repeat(whole, out[i + 1])
                out[i : i + 3] = out[i][keep], np.where(whole, out[i + 1], 0), out[i + 2][keep]
        return [whole, *out]

    def texts(self) -> list[bytes]:
        """Groups of each segment, written out: ids with the sign that comes after each, in the order of groups and sides."""
        ends = [[f"{i}{sign}".encode() for i in range(1 + max(self.a.max(initial=0), self.b.max(initial=0)))] for sign in ",|;"]
        at_a, at_b, out = np.append(0, np.cumsum(self.n_a)), np.append(0, np.cumsum(self.n_b)), []
        for lo in range(0, len(self.n_a), _BATCH):
            hi = min(lo + _BATCH, len(self.n_a))
            own_a, own_b = slice(at_a[lo], at_a[hi]), slice(at_b[lo], at_b[hi])
            key = np.concatenate([self.group_a[own_a] * 2, self.group_b[own_b] * 2 + 1])
            order = np.argsort(key, kind="stable")
            key, ids = key[order], np.concatenate([self.a[own_a], self.b[own_b]])[order]
            after = np.append(key[1:], -2)
            sign = np.where(after == key, 0, np.where(after == key + (key % 2 == 0), 1, 2))
            signed = [ends[k][i] for k, i in zip(sign.tolist(), ids.tolist(), strict=True)]
            tokens = np.append(0, np.cumsum(self.n_a[lo:hi] + self.n_b[lo:hi])).tolist()
            out += [b"".join(signed[i:j])[:-1] for i, j in zip(tokens, tokens[1:], strict=False)]
        return out


class _Chunk:
    """Documents of a chunk as runs of distinct segments."""

    def __init__(self, table: pa.Table, path_a: str, path_b: str):
        known: dict[str, int] = {}
        cut = _CUT.split if _second(path_b)[2] else lambda t: [t]
        docs = [np.fromiter((known.setdefault(s, len(known)) for s in cut(f" {t.as_py()}")), np.int32) if t.as_py() else np.zeros(0, np.int32) for c in table.column("text").chunks for t in c]
        self.seg = _Segments(list(known), path_a, path_b)
        self.docs = [d if self.seg.whole[d].all() else d[:0] for d in docs]

    def links(self):
        """For some documents after another: index, pair (as its position in seg.pairs) and number of links, of all distinct pairs of each."""
        size, lo = 0, 0
        for i, d in enumerate(self.docs):
            size += len(d)
            if size >= _LINKS or i + 1 == len(self.docs):
                yield self._links(lo, i + 1)
                size, lo = 0, i + 1

    def _links(self, lo: int, hi: int):
        n = np.fromiter(map(len, self.docs[lo:hi]), np.int64, hi - lo)
        # The distinct segments of a document first, then their links.
        segments = max(1, len(self.seg.whole))
        at, times = np.unique(np.repeat(np.arange(lo, hi), n) * segments + np.concatenate([np.zeros(0, np.int32), *self.docs[lo:hi]]), return_counts=True)
        doc, seg = np.divmod(at, segments)
        k = self.seg.n_links[seg]
        code = self.seg.code[ranges(self.seg.link_at[seg], k)]
        pairs = max(1, len(self.seg.pairs))
        key, inv = np.unique(np.repeat(doc, k) * pairs + code, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inv, np.repeat(times, k))
        return *np.divmod(key, pairs), total


def align_documents(docs: DataFrame, path_a: str, path_b: str, chunk_mb: float = 4.0, fan: int = 1024) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    n = parts_for(docs, chunk_mb)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("c", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def encoded(table: pa.Table) -> pa.Table:
        x = _Chunk(table, path_a, path_b)
        texts, seg, hashes = x.seg.texts(), x.seg, []
        for d in x.docs:
            h = hashlib.sha256()
            for i in range(0, len(d), _BATCH):
                h.update(b";" * (i > 0) + b";".join([texts[j] for j in d[i : i + _BATCH].tolist()]))
            hashes.append(h.hexdigest() if len(d) else "")
        each = lambda of: pa.array([int(of[d].sum()) for d in x.docs], pa.int64())
        parts = [np.zeros((3, 0), np.int64), *[np.stack(p) for p in x.links()]]
        doc, pair, times = np.concatenate(parts, axis=1)
        at = pa.array(np.searchsorted(doc, np.arange(len(x.docs) + 1)).astype(np.int32))
        rows = pa.table({
            "doc_id": table.column("doc_id").cast(pa.int64()), "n_a": each(seg.n_a), "n_b": each(seg.n_b), "n_groups": each(seg.n_groups), "n_links": each(seg.n_links), "groups_sha256": pa.array(hashes, pa.string()),
            "pair": pa.ListArray.from_arrays(at, pa.array(pair.astype(np.int32))), "times": pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
        })
        n = np.bincount(pair, minlength=len(seg.pairs))  # 0: pairs of segments whose texts aren't spelt as a whole
        data = {"pair": [planes(seg.pairs)], "n": [planes(n)], "rows": [packed(rows)]}
        return pa.table({"c": pa.array([table.column("c")[0].as_py()], pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in data.items()}})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, pair, n in zip(*(batch.column(k).to_pylist() for k in ("c", "pair", "n")), strict=True):
                pair, n = unplanes(pair, np.int64), unplanes(n, np.int64)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"c": pa.array(np.full(len(some), c), pa.int32()), "pair": pa.array(pair[some]), "n": pa.array(n[some])})

    def finish(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        pairs, t = unplanes(chunk.column("pair")[0].as_py(), np.int64), unpacked(chunk.column("rows")[0].as_py())
        n_docs, best = np.zeros((2, len(pairs)), np.int64)
        at = np.searchsorted(pairs, counts.column("pair").to_numpy())
        n_docs[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        pair, times = (t.column(k).combine_chunks().flatten().to_numpy() for k in ("pair", "times"))
        if not n_docs[pair].all():
            raise ValueError("a chunk's pairs have no counts")
        at = t.column("pair").combine_chunks().offsets.to_numpy()
        sums = lambda of: np.diff(np.append(0, np.cumsum(times * of[pair]))[at])
        out = t.drop(["pair", "times"]).append_column("n_best", pa.array(sums(best))).append_column("count_sum", pa.array(sums(n_docs)))
        return out.select([f.split()[0] for f in SCHEMA.split(", ")])

    chunks = checkpoint(base.groupBy("c").applyInArrow(encoded, "c int, pair binary, n binary, rows binary"))
    sent = chunks.select("c", "pair", "n").mapInArrow(listed, "c int, pair long, n long")
    if n > fan:
        own = sent.withColumn("g", F.floor(F.col("c") / fan))
        part = own.groupBy("g", "pair").agg(F.sum("n").alias("n"))
        back = own.select("c", "g", "pair").join(part.select("g", "pair").join(_counted(part), "pair"), ["g", "pair"]).drop("g")
    else:
        back = sent.select("c", "pair").join(_counted(sent), "pair")
    return chunks.select("c", "pair", "rows").groupBy("c").cogroup(back.select("c", "pair", "n", "best").groupBy("c")).applyInArrow(finish, SCHEMA)


def _counted(pairs: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (1 where no other pair of its first id has more)."""
    total = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    a = F.shiftright("pair", 32)
    return total.withColumn("best", (F.col("n") == F.max("n").over(W.partitionBy(a))).cast("long"))
