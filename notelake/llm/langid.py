"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed byte 2-, 3- and 4-grams inside words (case of A-Z folded, other non-letters of
ASCII read as blanks). Embeddings and the softmax are trained together by stochastic gradient descent in numpy, in steps that can't
overshoot on short texts, on a bounded sample of labelled rows; a temperature and a rejection threshold are calibrated on a fifth of the sample that training
does not see. As the model is linear after the average, prediction adds up one row of a table for each gram of the whole text, slice by slice.

The sample has at most per_lang rows of each language, picked by a hash of doc_id among
rows with a label and crc32(doc_id) mod 4 other than 2; only their gram counts reach the driver.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; with nothing to learn from, every text is `und`;
of equally likely languages the first by name is predicted; rows with a null doc_id are never learned from and count as held out; rows are judged one
by one, repeated ones alike; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, ORDERS, DIM = 14, (2, 3, 4), 16
_SLICE = 1 << 17
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD_BYTES = _FOLD.tobytes()
_LETTER = re.compile(rb"[A-Za-z]")


def grams(buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of a folded buffer: start positions and bucket ids of all grams that hold no inner blank."""
    for at in range(0, len(buf), _SLICE):
        b = buf[at : at + _SLICE + max(ORDERS) - 1].astype(np.uint32)
        blank = b == 32
        h = b.copy()
        inner = np.zeros(len(b), bool)
        for k in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint32(0x01000193) + b[k - 1 :]
            if k > 2:
                inner = inner[:-1] | blank[k - 2 : len(b) - 1]
            else:
                inner = blank[:-1] & blank[1:]
            if k in ORDERS:
                ok = np.flatnonzero(~inner[: min(_SLICE, len(h))])
                x = h[ok] * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
                yield ok + at, ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a blank before and after each text, and the start of each such stretch (and the end). No gram reaches from one into the next,
    as it would hold both blanks."""
    buf = np.frombuffer(b"".join([b" " + t + b" " for t in texts]).translate(_FOLD_BYTES), np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    return buf, np.concatenate(([0], np.cumsum(lens)))


def add_up(texts: list[bytes], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of rows[gram] over each text, and the number of grams."""
    buf, starts = _join(texts)
    total, count = np.zeros((len(texts), rows.shape[1])), np.zeros(len(texts))
    for pos, ids in grams(buf):
        if not len(pos):
            continue
        first, last = np.searchsorted(starts, pos[0], "right") - 1, np.searchsorted(starts, pos[-1], "right") - 1
        cuts = np.searchsorted(pos, starts[first : last + 2])
        cuts[0], cuts[-1] = 0, len(pos)
        n = np.diff(cuts)
        some = np.flatnonzero(n)
        for c in range(rows.shape[1]):
            total[first + some, c] += np.add.reduceat(rows[ids, c], cuts[:-1][some])
        count[first : last + 1] += n
    return total, count


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text) is not None or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


@dataclass
class Model:
    """table: for each bucket its embedding times the weights or, beyond DIM languages, the embedding alone, so that tasks hold 1 MB and DIM
    numbers a language (head) at most."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    head: np.ndarray | None = None

    def probabilities(self, averages: np.ndarray) -> np.ndarray:
        """Of each language, from averages of rows of the table."""
        z = averages if self.head is None else averages @ self.head
        return _softmax((z + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], epochs: int = 10, rate: float = 0.5, seed: int = 7) -> Model:
    """bags: bucket ids and counts of each text; y: index of its language."""
    rng = np.random.default_rng(seed)
    k, n = len(langs), len(bags)
    if not n:
        return Model(langs, np.zeros((1 << BITS, max(1, k)), np.float32), np.zeros(max(1, k)))
    emb = rng.normal(0, 0.1, (1 << BITS, DIM))
    w, bias = rng.normal(0, 0.1, (DIM, k)), np.zeros(k)
    order = rng.permutation(n)
    back = order[: n // 5] if n >= 50 else order
    train = order[n // 5 :] if n >= 50 else order
    for epoch in range(epochs):
        for at in range(0, len(train), 16):
            part = train[at : at + 16] if epoch == 0 else rng.choice(train, min(16, len(train)), replace=False)
            part = [i for i in part if len(bags[i][0])]
            if not part:
                continue
            ids = np.concatenate([bags[i][0] for i in part])
            share = np.concatenate([bags[i][1] / bags[i][1].sum() for i in part])
            cuts = np.cumsum([0, *[len(bags[i][0]) for i in part[:-1]]])
            x = np.add.reduceat(emb[ids] * share[:, None], cuts)
            g = _softmax(x @ w + bias)
            g[np.arange(len(part)), y[part]] -= 1
            gx = g @ w.T
            # Steps that can't overshoot: what a text's average, or its scores, move by is bounded, however short it is and however many texts of the
            # batch share a gram, and however far the embeddings or the weights have grown.
            lr = rate * (1 - epoch / epochs)
            w -= lr / max(1.0, float((x * x).sum(1).max())) * x.T @ g
            bias -= 0.05 * lr * g.sum(0)
            lens = np.diff(np.append(cuts, len(ids)))
            step = np.minimum(30 * lr, lr / np.add.reduceat(share * share, cuts)) / max(1.0, float((w * w).sum(0).max()))
            _, at_gram, texts = np.unique(ids, return_inverse=True, return_counts=True)
            move = np.repeat(gx * step[:, None], lens, 0) * (share / np.sqrt(texts[at_gram]))[:, None]
            np.subtract.at(emb, ids, move)
    if not (np.isfinite(emb).all() and np.isfinite(w).all()):
        raise FloatingPointError("training didn't stay finite")
    table, head = ((emb @ w).astype(np.float32), None) if k <= DIM else (emb.astype(np.float32), w)
    z = np.array([(table[i] * (c / max(1, c.sum()))[:, None]).sum(0) for i, c in (bags[j] for j in back)])
    z = (z if head is None else z @ head) + bias
    grid = np.exp(np.linspace(-3, 3, 61))
    temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(back)), y[back]] + 1e-12).mean()))
    p = _softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y[back]]
    # No more than one in two thousand correct texts may go, and never one that is more likely right than wrong.
    threshold = float(min(np.quantile(right, 0.0005) * 0.8, 0.5)) if len(right) else 0.0
    return Model(langs, table, bias, temperature, threshold, head)


def _held(modulus: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(True))


def train(docs: DataFrame, per_lang: int = 600, modulus: int = 4, held: int = 2) -> Model:
    """Learns every language of the labelled rows, from a bounded sample of each."""
    own = docs.select("doc_id", "text", "lang").where(~_held(modulus, held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return fit([], np.zeros(0, np.int64), [])
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1 << 24, int((1 << 24) * per_lang / counts[k])))])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, ids, cnt = [], [], []
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                c = np.zeros(1 << BITS, np.int64)
                for _, g in grams(_join([text])[0]):
                    c += np.bincount(g, minlength=len(c))
                some = np.flatnonzero(c)
                lang.append(name)
                ids.append(some.astype(np.uint16).tobytes())
                cnt.append(c[some].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(ids, pa.binary()), pa.array(cnt, pa.binary())], names=["lang", "ids", "cnt"])

    picked = own.where(F.col("lang").isin(langs)).where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 24)) < share[F.col("lang")])
    rows = picked.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(bags, "lang string, ids binary, cnt binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.ids), bytes(r.cnt)))
    at = {k: i for i, k in enumerate(langs)}
    return fit([(np.frombuffer(r.ids, np.uint16).astype(np.int64), np.frombuffer(r.cnt, np.uint32).astype(np.float64)) for r in rows], np.array([at[r.lang] for r in rows]), langs)


def identify(docs: DataFrame, model: Model, modulus: int = 4, held: int = 2, columns: list[str] | None = None) -> DataFrame:
    """docs with held_out, lang_pred, score (calibrated probability) and rejected. Input columns of these names are replaced.
    columns: those of docs to return, with doc_id (default: all). The text crosses to Python once and comes back only if asked for."""
    keep = [c for c in columns or docs.columns if c not in ("held_out", "lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at, col = 0, batch.column(source).cast(pa.binary())
            while at < len(col):
                texts, total, start = [], 0, at
                while at < len(col) and (not texts or total < 1 << 20):
                    texts.append(col[at].as_py() or b"")
                    total += len(texts[-1])
                    at += 1
                s, n = add_up(texts, m.table)
                p = m.probabilities(s / np.maximum(n, 1)[:, None])
                best = p.argmax(1)
                lang = [m.langs[b] if m.langs and has_letter(t) else "und" for b, t in zip(best, texts, strict=True)]
                score = np.where([x == "und" for x in lang], 0.0, p.max(1))
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score), pa.array((score < m.threshold) | np.array([x == "und" for x in lang]))],
                    names=[*keep, "lang_pred", "score", "rejected"],
                )

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    source = keep.index("text") if "text" in keep else len(keep)
    out = docs.select(*keep, *[F.col("text")] * ("text" not in keep)).mapInArrow(run, schema)
    return out.withColumn("held_out", _held(modulus, held))
