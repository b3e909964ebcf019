"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt to inverted lists around k-means centres. Within each probed list, vectors are randomly rotated and laid out in
column blocks; after each block a hypothesis test on the partial distance gives up candidates that can hardly come
below the present k-th distance, so most candidates are never read in full. Survivors are scored on the original vectors in double precision.

The centres are fitted on a bounded sample (sample_rows, documented; the index holds every row), and the number of probed
lists is the smallest that covers `target` of the true neighbours of sample queries. Equal vectors form one class with their
k + 1 smallest ids, so a vector that a third of the rows share is searched and answered once. Lists lie end to end and are cut into
shards of equal rows, so no task holds a whole hot list; a query visits a shard once, its nearest lists first, each list under the
bound that the ones before it left, and only its best k + 1 of the shard become rows. The queries of a shard are cut into blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length
than the most common one (ties: the longer), nor rows with a null id; repeated rows of one id and vector count once; fewer candidates than k are all returned; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

_COLS, _EPS, _BLOCK, _SHARD_BYTES = 16, 2.1, 4096, 8_000_000
#: Rows that are broadcast at most.
_SMALL = 100_000


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        n = np.bincount(own, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest centres of each row, nearest first, ties to the smaller index."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 2048):
        d = (c * c).sum(1)[None, :] - 2 * x[at : at + 2048] @ c.T
        out[at : at + 2048] = np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def scan(x: np.ndarray, columns: list[np.ndarray], q: np.ndarray, rotated: np.ndarray, want: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one list that survive all tests, with exact distances. columns: rotated vectors in blocks of dimensions,
    dimension-major. known: distances found in lists before; with `want` of them, their want-th is the first bound."""
    n, dim = x.shape
    head = np.arange(0 if len(known) >= want else min(n, max(2 * want, 32)))
    exact = np.sqrt(((x[head] - q) ** 2).sum(1))
    near = np.concatenate([known, exact])
    if n <= len(head):
        return head, exact
    tau = np.partition(near, want - 1)[want - 1]
    alive, part, done = np.arange(len(head), n), np.zeros(n - len(head)), 0
    for block in columns:
        d = block[:, alive] - rotated[done : done + len(block), None]
        part = part + (d * d).sum(0)
        done += len(block)
        slack = (1 + _EPS / np.sqrt(done)) if done < dim else 1 + 1e-6
        ok = np.sqrt(part * (dim / done)) <= tau * slack
        alive, part = alive[ok], part[ok]
        if not len(alive):
            break
    return np.concatenate([head, alive]), np.concatenate([exact, np.sqrt(((x[alive] - q) ** 2).sum(1))])


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def nearest_neighbours(
    vectors: DataFrame, queries=None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int = 20_000, max_lists: int = 1024, rows_a_list: int = 200, target: float = 0.985,
) -> DataFrame:
    """query_id, rank, vec_id, score. queries: a predicate over vec_id that names the query rows (default: divisible by 100)."""
    queries = F.col("vec_id") % 100 == 0 if queries is None else queries
    want = k + 1
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = dims[0][0]
    v = v.where(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    total = dims[0][1]

    first = W.partitionBy("v").orderBy("vec_id")
    members = v.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= want)
    classes = members.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0])

    share = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 24)) < min(1 << 24, int((1 << 24) * sample_rows / total))
    x = np.array([r[0] for r in v.where(share).select("v").limit(2 * sample_rows).collect()] or [r[0] for r in v.select("v").limit(1).collect()])
    x = np.unique(x, axis=0)
    lists = int(min(max_lists, max(1, min(len(x), total // rows_a_list))))
    centres = kmeans(x, lists)
    # Probes: as many lists as hold `target` of the true neighbours of some sample rows.
    pick = np.random.default_rng(1).choice(len(x), min(len(x), 200), replace=False)
    d = ((x**2).sum(1)[None, :] - 2 * x[pick] @ x.T).astype(np.float64)
    d[np.arange(len(pick)), pick] = np.inf
    true = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, : min(k, max(1, len(x) - 1))]
    order = nearest(x[pick], centres, lists)
    place = np.argsort(order, axis=1)
    at = np.take_along_axis(place, nearest(x, centres, 1)[:, 0][true], axis=1)
    probes = int(min(lists, np.quantile(at, target) + 2))
    rot = rotation(dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = nearest(_matrix(b.column("v")), centres, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column("cid"), b.column("v"), b.column("ids")], names=["list", "cid", "v", "ids"])

    placed = checkpoint(classes.select("cid", "v", "ids").mapInArrow(assign, "list int, cid long, v array<double>, ids array<long>"))
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # at most max_lists rows
        sizes[r[0]] = r[1]
    # Lists lie end to end, neighbours (along the main axis of the centres) together, and are cut into shards of equal rows.
    axis = centres @ np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    starts = np.zeros(lists, np.int64)
    along = np.argsort(axis, kind="stable")
    starts[along] = np.cumsum(sizes[along]) - sizes[along]
    shards = max(1, -(-int(sizes.sum()) * 8 * dim // _SHARD_BYTES))
    rows_a_shard = max(1, -(-int(sizes.sum()) // shards))
    asked = v.where(queries).select(F.col("vec_id").alias("query_id"), "v").distinct().join(placed.select("cid", "v"), "v")
    asked = checkpoint(asked.select("query_id", F.col("cid").alias("qid")))
    qclasses = placed.join(asked.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").select("cid", "v")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest(_matrix(b.column("v")), centres, lists)
            n = np.maximum(probes, (np.cumsum(sizes[near], axis=1) < 8 * want).sum(1) + 1).clip(max=lists)
            qid, out = b.column("cid").to_pylist(), ([], [], [])
            for r in range(len(near)):
                mine: dict[int, list[int]] = {}
                for c in near[r, : n[r]].tolist():
                    if sizes[c]:
                        for shard in range(starts[c] // rows_a_shard, (starts[c] + sizes[c] - 1) // rows_a_shard + 1):
                            mine.setdefault(int(shard), []).append(c)
                out[0].extend(mine)
                out[1].extend(mine.values())
                out[2].extend([r] * len(mine))
            row = pa.array(out[2], pa.int64())
            columns = [pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int32())), pa.array(qid, pa.int64()).take(row), b.column("v").take(row)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "lists", "qid", "v"])

    probed = qclasses.mapInArrow(probe, "shard int, lists array<int>, qid long, v array<double>")
    # Queries of a shard are searched in blocks; a shard's rows go to each of its blocks.
    asking = probed.groupBy("shard").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("of"))
    asking = F.broadcast(asking) if shards <= _SMALL else asking  # at most one row a shard
    by_list = lambda x: F.array(*map(F.lit, x.tolist()))[F.col("list")]  # noqa: E731  max_lists numbers
    place = by_list(starts) + F.pmod(F.xxhash64("cid"), by_list(np.maximum(1, sizes)))
    left = placed.withColumn("shard", F.floor(place / rows_a_shard).cast("int")).join(asking, "shard")
    left = left.select("shard", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("j"), "list", "cid", "v", "ids")
    right = probed.join(asking, "shard").select("shard", F.pmod(F.xxhash64("qid"), F.col("of")).cast("int").alias("j"), "lists", "qid", "v")

    def search(mine: pa.Table, asking: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if mine.num_rows and asking.num_rows:
            mine = mine.sort_by([("list", "ascending"), ("cid", "ascending")])
            x, ids, own = _matrix(mine.column("v")), mine.column("ids").to_pylist(), mine.column("list").to_numpy()
            at = np.searchsorted(own, np.arange(lists + 1))
            turned = np.ascontiguousarray((x @ rot).T)
            qs = _matrix(asking.column("v"))
            for qid, probing, q, r in zip(asking.column("qid").to_pylist(), asking.column("lists").to_pylist(), qs, qs @ rot, strict=True):
                rows, score, known = [], [], np.zeros(0)
                for c in probing:
                    lo, hi = at[c], at[c + 1]
                    if lo < hi:
                        some, d = scan(x[lo:hi], [turned[a : a + _COLS, lo:hi] for a in range(0, dim, _COLS)], q, r, want, known)
                        rows.append(some + lo)
                        score.append(d)
                        known = np.sort(np.concatenate([known, d]))[:want]
                if rows:
                    rows, score = np.concatenate(rows), np.concatenate(score)
                    found = sorted((score[b], i) for b in np.flatnonzero(score <= known[-1]) for i in ids[rows[b]])[:want]
                    out[0].extend([qid] * len(found))
                    out[1].extend(i for _, i in found)
                    out[2].extend(float(s) for s, _ in found)
        return pa.table({"qid": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["shard", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "qid long, vec_id long, score double")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("score", "vec_id"))).where(F.col("r") <= want).drop("r")
    pairs = asked.join(top, "qid").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
