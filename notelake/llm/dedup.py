"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct n-word shingles. Every shingle is a Poisson process over [0, inf) whose points
are dealt to m registers; a register keeps the smallest point x of the set as floor(1 - log_b x), truncated to
[0, q + 1]. Registers are mergeable by maximum, and two sets agree in a register with a probability close to their Jaccard
similarity. Bands of registers give buckets; the joint likelihood of all registers given the known set sizes
discards pairs that are clearly below the threshold; what is left is confirmed on the full shingle sets.

Defined results: null, empty and word-less texts have an empty set and link with nothing; documents shorter than n words
have the whole sequence as their one shingle; repeated rows of one doc_id count as one node; rows with a null doc_id get
a null component and are kept; an empty table gives no rows. Only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpoint, connected_components, hash_words, mix64, ranges, released_shuffles, window_hashes

#: Registers, rows a band, base, rate and largest value of the sketch.
M, ROWS, BASE, RATE, Q = 128, 4, 1.001, 20.0, (1 << 16) - 2
_GOLD = 0x9E3779B97F4A7C15


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the bounds per text."""
    h, bounds, *_ = hash_words(texts, lower=True)
    words = np.diff(bounds)
    w = window_hashes(h, n)
    out, sizes = [], np.zeros(len(texts) + 1, np.int64)
    for i, k in enumerate(words):
        if k >= n:
            x = np.sort(w[bounds[i] : bounds[i + 1] - n + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif k:
            x = window_hashes(h[bounds[i] : bounds[i + 1]], int(k))
        else:
            continue
        out.append(x)
        sizes[i + 1] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(sizes)


def registers(sets: np.ndarray, bounds: np.ndarray, m: int = M) -> np.ndarray:
    """SetSketch registers (uint16) of each set. The points of an element come in ascending order, so only those below a
    limit that fills all registers with near certainty are made; sets with an open register go on to a wider limit."""
    docs, size = len(bounds) - 1, np.diff(bounds)
    low = np.full(docs * m, np.inf)
    want, todo = np.log(m) + 7.0, np.flatnonzero(size)
    while len(todo):
        own = np.repeat(todo, size[todo])
        h = sets[np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in todo])]
        limit = (want / (size * RATE + (size == 0)))[own]
        x, k = np.zeros(len(h)), 0
        while len(h):
            k += 1
            p = mix64(h + U64(k * _GOLD & (1 << 64) - 1))
            x = x - np.log(((p >> U64(16)).astype(np.float64) + 0.5) * 2.0**-48) / (m * RATE)
            ok = x < limit
            h, x, own, limit = h[ok], x[ok], own[ok], limit[ok]
            np.minimum.at(low, own * m + (p[ok] % U64(m)).astype(np.int64), x)
        todo = todo[np.isinf(low.reshape(docs, m)[todo]).any(axis=1)]
        want *= 2
    low[np.isinf(low)] = 1e300
    return np.clip(np.floor(1.0 - np.log(low) / np.log(BASE)), 0, Q + 1).astype(np.uint16).reshape(docs, m)


def band_keys(reg: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of registers, salted by the band."""
    docs, m = reg.shape
    r = reg.reshape(docs, m // rows, rows).astype(U64)
    key = mix64(np.arange(1, m // rows + 1, dtype=U64) * U64(_GOLD))[None, :].repeat(docs, 0)
    for j in range(rows):
        key = mix64(key ^ (r[:, :, j] + U64(1 + (j << 20))))
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(plus, minus, equal, u, v, j):
    """Joint log likelihood of register comparisons (larger, smaller, equal) at Jaccard similarity j;
    u and v are the shares of the set sizes."""
    a, b = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-12)
    return plus * np.log(a) + minus * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))


def plausible(plus, minus, equal, nu, nv, threshold: float, margin: float = 28.0):
    """False only where the registers speak against j >= threshold with a likelihood ratio beyond margin/2 (over five
    standard deviations), or the sizes alone forbid it."""
    u = nu / (nu + nv)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    best = np.full(np.shape(u), -np.inf)
    for g in np.linspace(0, 1, 41):
        best = np.maximum(best, log_likelihood(plus, minus, equal, u, v, np.minimum(g, most)))
    there = np.full(np.shape(u), -np.inf)
    for g in np.linspace(threshold, 1, 9):
        there = np.maximum(there, log_likelihood(plus, minus, equal, u, v, np.minimum(g, most)))
    return (most >= threshold - 1e-9) & (2 * (best - there) <= margin)


#: Partners that meet one text in a task; members, and shingles, that a block of a bucket holds about.
_PARTNERS, _BLOCK, _WEIGHT = 64, 256, 400_000
_SIG = "doc_id long, n_shingles long, f1 long, f2 long, sketch binary, bands array<long>"


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, set size, 128-bit set fingerprint, registers and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                texts, total, start = [], 0, at
                while at < len(ids) and (not texts or total < 1 << 20):
                    t = col[at].as_py() or b""
                    texts.append(t)
                    total += len(t)
                    at += 1
                sets, bounds = shingle_sets(texts, n)
                pre = np.zeros((2, len(sets) + 1), U64)
                np.cumsum(mix64(sets), out=pre[0, 1:])
                np.cumsum(mix64(sets ^ U64(_GOLD)), out=pre[1, 1:])
                f = (pre[:, bounds[1:]] - pre[:, bounds[:-1]]).view(np.int64)
                reg = registers(sets, bounds)
                keys = band_keys(reg)
                full = np.diff(bounds) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, at - start), pa.array(np.diff(bounds)), pa.array(f[0]), pa.array(f[1]),
                        pa.array([r.tobytes() for r in reg], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * keys.shape[1]))), pa.int32()), pa.array(keys[full].ravel())),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "sketch", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _SIG)


def _verified(docs: DataFrame, pairs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) those whose full sets have num * union <= den * intersection. The text of a is sent once to each block
    of 64 partners, and partners stream past its set, so that no task holds more than one text and one batch."""
    num, den = threshold
    k = pairs.groupBy(F.col("a").alias("ka")).agg(F.ceil(F.count("*") / _PARTNERS).cast("int").alias("k"))
    salted = pairs.join(k, F.col("a") == F.col("ka")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).alias("salt"))
    need = salted.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("role")).unionByName(
        salted.select(F.col("a").alias("id"), "a", "salt", F.lit(0).alias("role")).distinct()
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sent = texts.join(need.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("a", "salt", "role", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            a, s, role, ids, col = (batch.column(i) for i in range(5))
            a, s, role = a.to_numpy(False), s.to_numpy(False), role.to_numpy(False)
            at, left, right = 0, [], []
            while at < len(a):
                texts, total, start = [], 0, at
                while at < len(a) and (not texts or total < 1 << 20):
                    texts.append(col[at].as_py() or b"")
                    total += len(texts[-1])
                    at += 1
                sets, bounds = shingle_sets(texts, n)
                for i in range(at - start):
                    mine = sets[bounds[i] : bounds[i + 1]]
                    if key != (k := (a[start + i], s[start + i])):
                        key, own = k, []
                    if role[start + i] == 0:
                        own.append(mine.copy())
                        continue
                    for x in own:
                        both = 0
                        if len(mine) and len(x):
                            small, large = (mine, x) if len(mine) < len(x) else (x, mine)
                            p = np.minimum(np.searchsorted(large, small), len(large) - 1)
                            both = int((large[p] == small).sum())
                        if both and den * both >= num * (len(mine) + len(x) - both):
                            left.append(int(k[0]))
                            right.append(ids[start + i].as_py())
                            break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id").mapInArrow(run, "u long, v long").distinct()


class _Block:
    """Documents of two blocks of one bucket: side (0 left, 1 right), registers, sizes, components."""

    def __init__(self, key: tuple, rows: list[tuple], threshold: float):
        self.threshold = threshold
        columns = list(zip(*rows, strict=True))
        self.doc, self.comp, self.side, self.spare = (np.array(x) for x in columns[:4])
        self.reg = np.frombuffer(b"".join(columns[4]), np.uint16).reshape(len(rows), -1).astype(np.int32)
        self.n = np.array(columns[5], np.float64)
        self.bands = band_keys(self.reg)
        self.band = int(np.flatnonzero(self.bands[0] == key[0])[0])

    def partners(self):
        """(row, rows) of another component that share this band first and that the registers don't refute."""
        right = np.flatnonzero(self.side == 1)
        for i in np.flatnonzero(self.side == 0):
            r = right[self.comp[right] != self.comp[i]]
            r = r[~self.spare[r] | (self.doc[r] > self.doc[i])]  # two spare documents meet twice, as left and right
            if self.band and len(r):
                r = r[~(self.bands[r, : self.band] == self.bands[i, : self.band]).any(axis=1)]
            if not len(r):
                continue
            x, y = self.reg[i], self.reg[r]
            same = (x == y).sum(1)
            # Six standard deviations below the threshold; what is near is judged by the likelihood.
            near = same >= len(x) * self.threshold - 6 * np.sqrt(len(x) * self.threshold * (1 - self.threshold))
            r, y, same = r[near], y[near], same[near]
            if len(r):
                r = r[plausible((x > y).sum(1), (x < y).sum(1), same, self.n[i], self.n[r], self.threshold)]
                if len(r):
                    yield int(i), r


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal keys of sorted batches, each as its rows."""
    key, rows = None, []
    for batch in batches:
        for k, *row in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), *(batch.column(c).to_pylist() for c in rest), strict=True):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(tuple(row))
    if rows:
        yield key, rows


def _open_links(docs: DataFrame, members: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Links (u, v) between different components within buckets. members: key, doc, comp, sketch, n_shingles.

    Members of a bucket's largest component need not meet each other, so only the rest of it (spare) meets all members: spare documents
    are dealt to blocks on the left, all to blocks on the right, by number and by shingles. A group of near copies that the first round linked
    has few spare ones, so its members are sent on about once. A first pass over registers finds the documents of a block
    pair that have a plausible partner there; only their texts are sent, and the pairs are confirmed on full sets where
    they meet. Pairs never become rows, and a block reports a spanning forest of its links."""
    num, den = threshold
    keys, rest = ("key", "bi", "bj"), ("doc", "comp", "side", "spare", "sketch", "n_shingles")
    blocks_of = lambda rows, shingles: F.greatest(F.ceil(rows / _BLOCK), F.ceil(shingles / _WEIGHT)).cast("int")
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"))
    most = parts.groupBy("key").agg(
        F.max(F.struct("rows", "comp", "shingles")).alias("top"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")
    ).where("rows > top.rows").select(
        "key", F.col("top.comp").alias("base"), blocks_of(F.col("rows") - F.col("top.rows"), F.col("shingles") - F.col("top.shingles")).alias("ni"),
        blocks_of(F.col("rows"), F.col("shingles")).alias("nj"),
    )
    dealt = members.join(most, "key").withColumn("spare", F.col("comp") != F.col("base"))
    at = F.xxhash64("doc")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = dealt.where("spare").select("key", F.pmod(at, F.col("ni")).cast("int").alias("bi"), every("nj").alias("bj"), "doc", "comp", F.lit(0).alias("side"), *rest[3:])
    right = dealt.select("key", every("ni").alias("bi"), F.pmod(at, F.col("nj")).cast("int").alias("bj"), "doc", "comp", F.lit(1).alias("side"), *rest[3:])
    dealt = left.unionByName(right)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches, keys, rest):
            if len(rows) > 1:
                b = _Block(key, rows, num / den)
                some = sorted({x for i, r in b.partners() for x in (i, *r.tolist())})
                if some:
                    yield pa.RecordBatch.from_pylist([dict(zip((*keys, *rest), (*key, *rows[x]), strict=True)) for x in some], schema=arrow)

    arrow = pa.schema([("key", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("doc", pa.int64()), ("comp", pa.int64()), ("side", pa.int32()), ("spare", pa.bool_()), ("sketch", pa.binary()), ("n_shingles", pa.int64())])
    schema = "key long, bi int, bj int, doc long, comp long, side int, spare boolean, sketch binary, n_shingles long"
    picked = checkpoint(dealt.repartition(*keys).sortWithinPartitions(*keys, "side", "doc").mapInArrow(pick, schema))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sent = texts.join(picked.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select(*keys, *rest, "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches, keys, (*rest, "text")):
            b = _Block(key, rows, num / den)
            sets, bounds = shingle_sets([r[6] or b"" for r in rows], n)
            size = np.diff(bounds)
            root = {c: c for c in b.comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            u, v = [], []
            for i, r in b.partners():
                r = np.array([j for j in r.tolist() if find(b.comp[j]) != find(b.comp[i])], np.int64)
                mine = sets[bounds[i] : bounds[i + 1]]
                r = r[size[r] > 0]
                if not len(mine) or not len(r):
                    continue
                x = sets[ranges(bounds[r], size[r])]
                p = np.minimum(np.searchsorted(mine, x), len(mine) - 1)
                both = np.add.reduceat((mine[p] == x).astype(np.int64), np.cumsum(size[r]) - size[r])
                for j in r[den * both >= num * (len(mine) + size[r] - both)].tolist():
                    c, d = find(b.comp[i]), find(b.comp[j])
                    if c != d:
                        root[max(c, d)] = min(c, d)
                        u.append(int(b.doc[i]))
                        v.append(int(b.doc[j]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return sent.repartition(*keys).sortWithinPartitions(*keys, "side", "doc").mapInArrow(confirm, "u long, v long")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept for each row of docs.

    1. Exact copies (equal sets) become one class with the smallest doc_id for its representative.
    2. Representatives are put into buckets by bands. The pivot of a bucket is the member whose buckets hold most documents
       (ties: the smallest id), so that a group of near copies meets the text it comes from, whatever its id. Each
       representative is verified against the pivot that it meets in most bands; the confirmed links give components.
    3. In buckets that still hold several components, pairs across components that the likelihood doesn't refute are
       verified too, block by block: nothing is capped, and pairs never become rows.
    """
    with released_shuffles(docs.sparkSession):
        return _near_duplicates(docs, n, threshold)


def _near_duplicates(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    sig = checkpoint(signatures(docs, n))
    full = sig.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes, ["f1", "f2", "n_shingles"]).where("doc_id = rep").select("rep", "n_shingles", "sketch", "bands").dropDuplicates(["rep", "n_shingles", "sketch"])
    reps = checkpoint(reps)
    keyed = reps.select(F.explode("bands").alias("key"), F.col("rep").alias("doc"))
    shared = checkpoint(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"))
    weighed = shared.join(shared.groupBy("doc").agg(F.sum("size").alias("weight")), "doc")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", -F.col("doc"))).alias("x")).select("key", (-F.col("x.col2")).alias("pivot"))
    members = checkpoint(shared.select("key", "doc").join(pivots, "key"))
    votes = members.where("doc <> pivot").groupBy(F.col("doc").alias("b"), F.col("pivot").alias("a")).count()
    best = votes.groupBy("b").agg(F.max(F.struct("count", -F.col("a"))).alias("x")).select((-F.col("x.col2")).alias("a"), "b")
    links = checkpoint(_verified(docs, best, n, threshold))
    comp = connected_components(links)
    labelled = members.join(comp, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    sk = reps.select(F.col("rep").alias("doc"), "sketch", "n_shingles")
    more = checkpoint(_open_links(docs, labelled.join(mixed, "key").join(sk, "doc"), n, threshold))
    if not more.isEmpty():
        comp = connected_components(links.unionByName(more))
    of_class = classes.join(comp, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.col("n_shingles").alias("k"), F.coalesce("component", "rep").alias("component"))
    s = sig.select("doc_id", "n_shingles", "f1", "f2")
    out = s.join(of_class, (s.f1 == of_class.f1) & (s.f2 == of_class.f2) & (s.n_shingles == of_class.k), "left")
    c = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), c).alias("component_id"), F.coalesce(c == F.col("doc_id"), F.lit(True)).alias("kept"))
