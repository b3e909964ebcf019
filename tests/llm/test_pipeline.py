"""Stages of the corpus pipeline take effect, each on what the one before kept."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "12345 --", "en", "s", 8), (10_002, None, None, None, None)], docs.schema)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    leak = spark.createDataFrame([(10_003, f"so {bench} {bench} mail jo@x.org", "en", "s", 8)], docs.schema)
    copy = docs.orderBy("doc_id").limit(1).withColumn("doc_id", F.lit(10_004).cast("long"))
    at = docs.unionByName(extra).unionByName(leak).unionByName(copy)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontaminate", "personal_data", "encode"]
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    before = ids(at)
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).checkpoint()
        now = ids(at)
        gone, before = before - now, now
        if name == "language":
            assert {10_001, 10_002} <= gone
        elif name == "near_duplicates":
            assert 10_004 in gone
        elif name == "decontaminate":
            assert 10_003 in gone
        else:
            assert not gone
        if name != "encode":
            assert tuple(at.columns) == corpus_pipeline.COLUMNS
    assert at.where("n_tokens <> size(ids)").count() == 0


def words(text, pattern):
    return re.findall(pattern, (text or "").encode().lower())


def test_the_whole_run_against_brute_force(spark):
    """run() over all documents: near-duplicates and benchmark passages by plain sets, tokens by the tokenizers library."""
    from tokenizers import Tokenizer

    kept = corpus_pipeline.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    sets = {}
    for r in kept:
        w = words(r.text, rb"[^\x20\x09-\x0D]+")
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    for a, s in sorted(sets.items()):
        for b, t in sets.items():
            if a < b and s and 100 * len(s & t) >= 80 * len(s | t):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    alnum = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [words(r.text, alnum) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wins = {b" ".join(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {x.count(b" ") + 1 for x in wins}
    clean = []
    for r in kept:
        w = words(r.text, alnum)
        if group[r.doc_id] == r.doc_id and not any(b" ".join(w[i : i + k]) in wins for k in sizes for i in range(len(w) - k + 1)):
            clean.append(r)
    assert 0 < len(clean) < len(kept)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    text = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, spark.createDataFrame(clean), SF).collect()}
    want = {d: t.encode(x, add_special_tokens=False).ids for d, x in text.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {d: r.ids for d, r in got.items()} == want
    assert all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(t.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() for r in got.values())


def test_empty_and_clashing_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    clash = docs.selectExpr("*", "'x' as ids", "0 as row", "1 as h", "'y' as base", "true as rejected")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs, clash = stage(spark, docs, SF).checkpoint(), stage(spark, clash, SF).checkpoint()
        assert sorted(map(repr, docs.collect())) == sorted(map(repr, clash.collect())), name
        clash = clash.selectExpr("*", "'x' as extra", "0 as row", "'y' as added") if name != "encode" else clash
