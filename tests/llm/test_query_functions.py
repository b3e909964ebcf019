"""The query functions over whole sf0.001, digests included, against brute-force versions."""

import hashlib
import re

import numpy as np
import pytest
from notelake.llm import pii, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def test_op4(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4_personal_data(spark, SF).collect()}
    assert got.keys() == docs.keys() and any(r.spans for r in got.values())
    kinds = [*pii.BASE, *pii.EXTRA]
    for d, text in docs.items():
        want, r = base(text), got[d]
        listed = [f"{kind}:{a}:{e}" for a, _, e, kind in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in PATTERNS]
        assert r.base_sha256 == sha(",".join(listed))
        spans = [(k, int(a), int(e)) for k, a, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])) and {f"{k}:{a}:{e}" for k, a, e in spans} >= set(listed)
        for k, a, e in spans:
            assert k in kinds and 0 <= a < e <= len(text)


def test_trees_as_columns(spark):
    """The plan's expression gives the scores that numpy gives, and picks by the kind's threshold."""
    trees = pii.model(spark)
    rows = spark.createDataFrame(pii.examples(300, seed=41) + pii.examples(300, seed=43, held_out=True), "text string, y boolean")
    rows = rows.select("y", F.explode(pii.candidates(F.col("text"))).alias("x"))
    rows = rows.select("y", "x.kind", F.array(*pii.features(F.col("x"))).alias("f"), trees.score(pii.features(F.col("x"))).alias("s"), trees.picks(F.col("x")).alias("picked")).collect()
    p = trees.predict(np.array([r.f for r in rows]))
    assert np.allclose([r.s for r in rows], p) and [r.picked for r in rows] == [bool(s >= trees.thresholds[r.kind]) for s, r in zip(p, rows, strict=True)]
    for kind in pii.EXTRA:  # on sentences of neither training nor calibration
        own = [(r.picked, r.y) for r in rows if r.kind == kind]
        assert np.mean([y for picked, y in own if picked]) >= 0.95 and np.mean([picked for picked, y in own if y]) >= 0.6


def test_personal_data_of_an_empty_table(spark):
    assert pii.find_personal(spark.createDataFrame([], "doc_id long, text string, base string, added int")).count() == 0


def test_op2(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in queries.op2_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i, v in rows if i % 100 == 0 and v.any()}
    hits = total = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = sorted((s, i) for s, i, v in zip(d, ids, x, strict=True) if i != q and v.any())[:10]
        found.sort()
        assert [k for k, *_ in found] == list(range(1, len(best) + 1)) and sorted((s, i) for _, i, s in found) == [(s, i) for _, i, s in found]
        for _, i, s in found:
            assert s == pytest.approx(d[ids == i][0], rel=1e-12)
        hits, total = hits + len({i for _, i in best} & {i for _, i, _ in found}), total + len(best)
    assert hits / total >= 0.95


def test_op6(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_bpe(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
