"""Whole jobs of the training-data operators where a part was left out before."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from notelake.llm import langid, pii, queries, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_decide_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    a, b = "one red fox ran over the old green hill today", "some other words about a boat on the wide sea"
    rows = [(None, a), (None, a), (7, a), (7, b), (8, b), (9, "too short"), (9, "too short"), (10, "five plain words are here"), (10, "five plain words are here"), (None, f"so {bench}"), (11, f"so {bench}"), (11, "a clean text of some more words")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    got = lambda d: sorted(map(tuple, d.select(F.coalesce("doc_id", F.lit(-1)), "text").collect()))
    short, five, leak = "too short", "five plain words are here", f"so {bench}"
    assert got(corpus_pipeline.near_duplicates(spark, df, SF)) == sorted([(7, a), (7, b), (9, short), (10, five), (11, leak), (11, "a clean text of some more words")])
    want = sorted((-1 if i is None else i, t) for i, t in rows if t != leak)
    assert got(corpus_pipeline.decontaminate(spark, df, SF)) == want


def test_secrets_are_redacted_whole(spark):
    hexes = "0123456789abcdef"
    dotted = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
    texts = {
        f"an token: {hexes * 20} so": "an [SECRET] so",
        f"an api_key = {hexes * 2000}": "an [SECRET]",
        f"an token: {dotted} so": "an [SECRET] so",
        "an secret = dGhpcyBpcyBhIHNlY3JldDEyMzQ1Njc4OTA== so": "an [SECRET] so",
        "an token: 0123456789abcdef0123456789abcdef. So": "an [SECRET]. So",
    }
    df = pii.find_personal(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {r[0]: r[1] for r in df.select("text", pii.redact(F.col("text"), F.filter("added", lambda x: x["kind"] == "secret"))).collect()}
    assert got == texts


def test_records_that_share_an_id(spark):
    head = "record_id string, type string, url string, ts timestamp, headers map<string,string>, payload_digest string, payload_length long"
    at = lambda s: f"2024-01-01 00:00:0{s}"
    rows = [("p", "response", "http://a.com/", at(0), {"etag": "1"}, "d1", 1), ("p", "response", "http://b.com/", at(0), {"etag": "2"}, "d2", 2)]
    rows += [(None, "revisit", u, at(s), {"etag": e}, None, None) for u, s, e in (("http://a.com/", 1, "1"), ("http://b.com/", 1, "2"), ("http://b.com/", 2, "2"))]
    rows += [("r", "revisit", "http://a.com/", at(s), {"etag": "1", "date": "x"}, None, None) for s in (3, 4, 4)]
    df = spark.createDataFrame([(*r[:3], None, *r[4:], r[3]) for r in rows], head.replace("ts timestamp", "t0 string") + ", at string")
    df = df.withColumn("ts", F.col("at").cast("timestamp"))
    got = warc.resolve_revisits(df).select("record_id", "url", F.second("ts"), "status", "payload_digest").collect()
    b, n = "http://b.com/", "resolved"
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, "http://a.com/", 1, n, "d1"), (None, b, 1, n, "d2"), (None, b, 2, n, "d2"), ("r", "http://a.com/", 3, n, "d1"), ("r", "http://a.com/", 4, n, "d1")]))


def test_warc_goes_on_after_broken_records():
    make = lambda i, z: warc.encode_record(f"urn:{i}", "response", "http://a.com/", "2024-01-01T00:00:00Z", {}, b"x" * 99, compress=z)
    ids = lambda data: [r["record_id"] for r in warc.decode_records(data)]
    plain, packed = [make(i, False) for i in range(3)], [make(i, True) for i in range(3)]
    for bad in (plain[1].replace(b"Content-Length: ", b"Content-Length: 9999"), plain[1].replace(b"Content-Length: ", b"Content-Length: x"), plain[1][:150], b"noise\n"):
        assert ids(plain[0] + bad + b"\r\n" + plain[2]) == ["urn:0", "urn:2"]
    flipped = bytearray(packed[1])
    flipped[len(flipped) // 2] ^= 255
    for bad in (bytes(flipped), packed[1][:40], b"noise"):
        assert ids(packed[0] + bad + packed[2]) == ["urn:0", "urn:2"]


def test_every_language_is_learned(spark):
    rows = [(i, f"word{i % 105} text", f"l{i % 105}") for i in range(1050)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) == 105


@pytest.mark.filterwarnings("error::RuntimeWarning")
@pytest.mark.parametrize("k", [4, 20, 105])
@pytest.mark.parametrize("alike", [False, True])
def test_short_texts_stay_finite(spark, k, alike):
    """Texts of two words, of languages with syllables of their own, or all with the same grams."""
    rnd = random.Random(k)
    syllables = [[rnd.choice("bcdfghjklmnprstvwz") + rnd.choice("aeiou") + rnd.choice(["", "n", "s", "r"]) for _ in range(12)] for _ in range(k)]
    words = [["".join(rnd.choice(x) for _ in range(rnd.randint(2, 3))) for _ in range(40)] for x in syllables]
    text = lambda i: f"word{i} text" if alike else " ".join(rnd.choice(words[i]) for _ in range(2))
    rows = [(j, text(j % k), f"l{j % k:03}") for j in range(k * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = langid.identify(df, langid.train(df)).where("held_out").collect()
    assert len(got) > 20 * k and all(0 <= r.score <= 1 for r in got)
    assert alike or np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_language_query_against_a_plain_scorer(spark):
    """op10 over whole sf0.001, with the learned model but grams counted one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.train(docs)

    def bucket(g):
        h = g[0]
        for b in g[1:]:
            h = (h * 0x01000193 + b) & 0xFFFFFFFF
        x = (h * 0x9E3779B1 + (len(g) * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF
        return (((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - langid.BITS)

    want = {}
    for r in docs.collect():
        held = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        t = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]", b" ", (r.text or "").encode()).lower() if r.text else b""
        if not any(c.isalpha() for c in r.text or ""):
            want[r.doc_id] = (held, "und", 0.0)
            continue
        t = b" " + t + b" "
        grams = [t[i : i + k] for k in (2, 3, 4) for i in range(len(t) - k + 1)]
        grams = [g for g in grams if b" " not in g[1:-1] and g != b"  "]
        z = m.table[[bucket(g) for g in grams]].astype(float).sum(0) / len(grams)
        p = np.exp(((z if m.head is None else z @ m.head) + m.bias) / m.temperature)
        want[r.doc_id] = (held, m.langs[int(p.argmax())], float(p.max() / p.sum()))
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op10_language(spark, SF).collect()}
    assert got.keys() == want.keys()
    for d, (held, lang, score) in want.items():
        assert got[d][:2] == (held, lang) and abs(got[d][2] - score) < 1e-6, (d, got[d], want[d])
