"""Each operator against a brute-force version, on small fixtures and on edge rows."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from notelake.llm import ann, bpe, chat, decontam, dedup, langid, pii, queries, substring, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, ws string, score double, ids string"


def corpus(n=60, seed=1):
    """Random texts with exact copies, near copies, shared passages, nulls, empties, one very long text, repeated rows and extra columns."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passage = text(60)
    rows = [text(rnd.choice([1, 3, 5, 40, 120])) for _ in range(n)]
    for i in range(5, n, 7):
        rows[i] = rows[4]
    for i in range(6, n, 9):
        w = rows[2 if len(rows[2].split()) > 30 else 0].split() or ["x"]
        w[rnd.randrange(len(w))] = "edited"
        rows[i] = " ".join(w)
    for i in range(3, n, 8):
        rows[i] = f"{rows[i]} {passage}\t{rows[i].upper()}"
    rows += [None, "", " \n\t ", "é ß Σ", text(30_000), "x" * 20_000, "1 2 3", passage]
    out = [(i, t, rnd.choice(["en", "de", None]), "s", None, i, "w", 0.5, "z") for i, t in enumerate(rows)]
    return [*out, out[0], (None, passage, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(t, n):
    w = WORD.findall((t or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_near_duplicates(docs, empty):
    rows = [(r.doc_id, shingles(r.text, 4)) for r in docs.collect() if r.doc_id is not None]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = dedup.near_duplicates(docs, 4).collect()
    assert len(got) == docs.count()
    size = {d: len(s) for d, s in rows}
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], find(r.doc_id), find(r.doc_id) == r.doc_id)
        else:
            assert r.component_id is None and r.kept
    assert dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_many_blocks(docs, monkeypatch):
    """Small blocks of members, shingles and partners give the same components."""
    want = sorted(map(repr, dedup.near_duplicates(docs, 4).collect()))
    monkeypatch.setattr(dedup, "_BLOCK", 2)
    monkeypatch.setattr(dedup, "_WEIGHT", 150)
    monkeypatch.setattr(dedup, "_PARTNERS", 2)
    assert sorted(map(repr, dedup.near_duplicates(docs, 4).collect())) == want


def test_registers_are_mergeable_and_locality_sensitive():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 2000).astype(np.uint64)
    a, b = np.sort(base[:1800]), np.sort(base[200:])
    reg = dedup.registers(np.concatenate([a, b, np.union1d(a, b)]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 2000]))
    assert (np.maximum(reg[0], reg[1]) == reg[2]).all()
    assert abs((reg[0] == reg[1]).mean() - 0.8) < 0.15
    x, y = reg[0].astype(int), reg[1].astype(int)
    assert dedup.plausible(np.array((x > y).sum()), np.array((x < y).sum()), np.array((x == y).sum()), 1800.0, 1800.0, 0.8)
    assert not dedup.plausible(np.array(60), np.array(60), np.array(8), 1800.0, 1800.0, 0.8)


@pytest.mark.parametrize(("chunk", "fan"), [(4.0, 1024), (0.02, 1024), (0.02, 4), (0.02, 2)])
def test_repeats(docs, empty, chunk, fan):
    rows = docs.collect()
    order = lambda d: math.inf if d is None else d
    first = {}
    for r in rows:
        w = WORD.findall((r.text or "").encode())
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, math.inf), order(r.doc_id))
    want = []
    for r in rows:
        w = WORD.findall((r.text or "").encode())
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < order(r.doc_id):
                gone[i : i + 50] = [True] * 50
        want.append((str(r.doc_id), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    got = substring.remove_repeats(docs, 50, chunk_mb=chunk, fan=fan).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert any(r.n_removed for r in got) and substring.remove_repeats(empty).count() == 0


def spans(t):
    """Base spans, straight from their definition."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for n, (k, p) in enumerate(kinds.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if k == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), n, f"{k}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


PRIVATE = [
    "a@b.cc@d.ee a@b.c.d-x_y@e.ff", "1.2.3.4.5 001.002.3.255 256.1.1.1 1.2.3 4.5.6.7", "+1 (555) 123-4567) +12345678901234567 +1", "4785 3805-9239 1139 4111111111111111 1 2 3", "", None,
    "é@x é+49 170 1234567 4111 1111 1111 1111 😀 u.v@w.de", "x" * 50_000 + "@", "1" * 3000, "a@b.c " * 1500, "9" * 60 + ".1.1.1 000000000000000000000001.1.1.1", "call (212) 555-0199, ssn 123-45-6789, jo [at] mail [dot] com",
]


def test_personal_data(spark):
    df = spark.createDataFrame([(i % 4 or None, x, "b") for i, x in enumerate(PRIVATE)], "doc_id long, text string, base string")
    found = pii.find_personal(df)
    got = found.select("text", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("added")).alias("added"), pii.redact(F.coalesce("text", F.lit("")), F.concat("base", "added")).alias("clean")).collect()
    for r in got:
        assert r.base == spans(r.text)
    last = next(r for r in got if r.text and "ssn" in r.text)
    assert {x.split(":")[0] for x in last.added.split(",")} >= {"phone_local", "ssn", "email_text"}
    assert "123-45" not in last.clean and last.clean.startswith("call [PHONE_LOCAL]")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_bpe(docs, empty, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.no_padding()
    t.no_truncation()
    rnd = random.Random(3)
    parts = ["a", "th", "in", "é", "ß", "Σ", "İ", "中", "😀", "'s", "'", "<|endoftext|>", " ", "\n", "\x1c", "\x85", "　", "1", "!", "...", "é", "aaaa", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["a" * 5000, "".join(rnd.choice("thinaer") for _ in range(9000))]
    texts += [" ".join(rnd.choice(["the", "naïve", "中文", "İs", "a\u0301", "Σ", "x1!"]) for _ in range(30_000)), "z" * 70_000 + " \u0301é <|endoftext|> " + "ok " * 30_000]
    rows = docs.select("doc_id", "text", "ids").unionByName(spark.createDataFrame([(None, x, "") for x in texts], "doc_id long, text string, ids string"))
    for r in bpe.encode_documents(rows, TOKENIZER).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(empty, TOKENIZER).count() == 0


def test_special_tokens_of_any_form():
    """Files whose special tokens look otherwise."""
    import json

    with open(TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    from tokenizers import Tokenizer

    for a in spec["added_tokens"]:
        if a["content"] == "<|endoftext|>":
            a["content"] = "[SEP]"
    text = json.dumps(spec)
    t = Tokenizer.from_str(text)
    t.no_padding()
    t.no_truncation()
    for x in ("a [SEP] b", "[SEP][SEP]", "the <|endoftext|> end", "no [sep] here"):
        assert bpe.Codec(text).encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_bpe_streams_with_bounded_memory():
    c = bpe.Codec(open(TOKENIZER, encoding="utf-8").read())
    rnd = random.Random(5)
    word = "".join(rnd.choice("thinaeroslc") for _ in range(4000)).encode()
    symbols = [c.first[x] for x in word[:-1]] + [c.last[word[-1]]]
    read, late = 0, 0

    def source():
        nonlocal read
        for s in symbols:
            read += 1
            yield s

    out, done = [], 0
    for token in c.stream(source()):
        out.append(token)
        done += len(c.parts[token])
        late = max(late, read - done)
    assert out == c.encode_word(word.decode()) and late <= c.lookahead + 2 * c.longest
    ids = c.encode("Grüße, 中文! <|endoftext|>x").tolist()
    for forms, want in ((False, "grüße , 中文 ! <|endoftext|>x "), (True, c.decode(ids))):
        for step in (1, 2, 5):  # the machine gives the same text however its tokens arrive
            machine = bpe.Decoder(c, forms)
            assert "".join([*(machine.feed(ids[i : i + step]) for i in range(0, len(ids), step)), machine.finish()]) == want
    half = bpe.Decoder(c, False)
    first, second = "é".encode()
    assert half.feed([c.first[first]]) == "" and half.feed([c.last[second]]) == "é "


def test_decontamination(docs, empty, spark):
    passage = docs.where("doc_id = 67").first().text.split()
    items = [(1, " ".join(passage[3:30])), (2, "X y"), (3, None), (4, "--"), (2, "X y"), (5, "a a a a a a a a a a a a"), (None, " ".join(passage[40:52]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = docs.select("doc_id", "text", "h", "ws").unionByName(spark.createDataFrame([(900, "b. " + "a " * 30 + "x-Y é", 1, "")], "doc_id long, text string, h long, ws string"))
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    wins = {(str(i) if i is not None else "null", tuple(w[k : k + 10])) for i, t in items for w in [find(t)] if w for k in range(max(1, len(w) - 9))}
    want = []
    for r in more.collect():
        w, hit, names = find(r.text), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    names.add(i)
        want.append((str(r.doc_id), len(w), len(hit), ",".join(sorted(names))))
    for batch in (20_000, 3):
        out = decontam.contamination(more, bench, batch=batch)
        got = out.select("doc_id", "n_words", decontam.n_hit(F.col("hits")).alias("n"), F.array_join("items", ",").alias("i")).collect()
        assert sorted({(str(r[0]), r[1], r[2], r[3]) for r in got}) == sorted(set(want))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_language(docs, empty, spark):
    rnd = random.Random(2)
    w = {"en": ["the", "and", "with", "ing"], "de": ["der", "und", "mit", "ung"], "fr": ["les", "et", "avec", "eau"]}
    rows = [(i, " ".join(rnd.choice(w[k]) + rnd.choice(w[k]) for _ in range(30)), k, "x") for i in range(600) for k in [rnd.choice(list(w))]]
    df = spark.createDataFrame([*rows, (900, None, "en", ""), (901, "12 -- 3", "en", ""), (902, "zz the", None, ""), (None, "the and", "en", "")], "doc_id long, text string, lang string, score string")
    got = langid.identify(df, langid.train(df)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in got if r.doc_id in truth) <= 2
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[900].score == 0 and by[900].rejected and by[902].lang_pred in w
    assert langid.identify(docs, langid.train(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, langid.train(docs)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 24))
    x = (centre[rng.integers(0, 8, 3000)] + 0.4 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[1000:2000] = x[7]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    odd = [(5000, None, ""), (5100, [0.0] * 24, ""), (5200, [float("nan")] * 24, ""), (5300, [1.0] * 3, ""), (None, [1.0] * 24, ""), rows[3]]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, v string")
    by = {}
    for r in ann.nearest_neighbours(df, rows_a_list=100).collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    assert set(by) == set(range(0, 3000, 100))
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and q not in [f[1] for f in found]
        assert np.allclose([f[2] for f in found], d[[f[1] for f in found]])
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hits >= 0.95 * 10 * len(by)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.nearest_neighbours(few).collect()] == [(1, 1)]
    assert ann.nearest_neighbours(few.limit(0)).count() == 0


def test_chat(spark):
    t = [(0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "good"), (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "so"), (2, 0, "user", "x"), (4, 0, "user", "y"), (5, 0, "user", "y"), (0, 0, "system", "s"), (None, 0, "user", "n"), (6, None, None, None)]
    df = spark.createDataFrame([(*r, "pair") for r in t], "conv_id long, turn long, role string, text string, part string")
    pairs = spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(4)], "pair_id long, chosen long, rejected long")
    out = chat.preference_format(chat.sides_of(df, pairs))
    a = {r.pair_id: r for r in out.collect()}
    one = a[0]
    assert one.prompt == "<|turn|>system\ns<|end|>\n<|turn|>user\nq<|end|>\n" and (one.n_prompt, one.n_chosen, one.n_rejected) == (2, 1, 2)
    assert [one.chosen[s.start : s.end] for s in one.chosen_spans] == ["good<|end|>"] and [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["bad<|end|>"]
    assert one.rejected.endswith("<|turn|>user\nso<|end|>\n")
    assert a[2].prompt and not a[2].chosen and not a[2].rejected and a[1].chosen and not a[1].rejected and a[3].n_chosen == 1
    none = df.limit(0)
    assert chat.preference_format(chat.sides_of(none, pairs)).count() == chat.preference_format(chat.weakened(none)).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_weaker_answers(spark):
    """Against plain lists: blocks, prefixes, masks, crowded and null turns, conversations without an answer."""
    rnd = random.Random(8)
    rows = [(c, rnd.choice([None, *range(0, 150 if c == 3 else 8)]), rnd.choice(["user", "assistant", None]), rnd.choice(["a b c", "one", "", None, "x  y", f"w{i} z"])) for i in range(900) for c in [rnd.choice([0, 1, 2, 3, 3, -5])]]
    rows += [(7, 0, "user", f"u{i:03}") for i in range(200)] + [(8, 0, "user", "alone"), (9, 0, "assistant", ""), (None, 0, "user", "x"), (8, 0, "user", "alone")]
    rows += [(10, 0, "user", "q"), (10, 1, "assistant", "first answer"), (10, 2, "user", "more"), (10, 3, "assistant", "a last and longer answer"), (10, 4, "user", "bye")]
    want = {}
    for conv in {r[0] for r in rows} - {None}:
        t = sorted({(-1 if n is None else n, role or "", text or "") for c, n, role, text in rows if c == conv})
        k = {x: 1 + sum(y[0] == x[0] and y < x for y in t) for x in t}
        t.sort(key=lambda x: (x[0] // 64, (k[x] - 1) // 64, x[0], k[x]))
        block = [(x[0] // 64, (k[x] - 1) // 64) for x in t]
        last = max((i for i, x in enumerate(t) if x[1] == "assistant"), default=None)
        weak = [x[2] if i != last else " ".join(x[2].split(" ")[: len(x[2].split(" ")) // 2]) for i, x in enumerate(t)][: len(t) if last is None else last + 1]
        cut = next((i for i, x in enumerate(t) if i >= len(weak) or weak[i] != x[2]), len(t))
        for i, x in enumerate(t):
            at = want.setdefault((conv, *block[i]), {"prompt": [], "chosen": [], "rejected": []})
            at["prompt" if i < cut else "chosen"].append((x[1], x[2]))
            if cut <= i < len(weak):
                at["rejected"].append((x[1], weak[i]))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, block int")
    got = chat.preference_format(chat.weakened(df)).collect()
    assert len(got) == len(want) and any(r.part for r in got) and any(r.block > 1 for r in got)
    for r in got:
        for side, said in want[r.pair_id, r.block, r.part].items():
            assert r[side] == "".join(f"<|turn|>{role}\n{text}<|end|>\n" for role, text in said) and r[f"n_{side}"] == len(said)
            if side != "prompt":
                assert [r[side][s.start : s.end] for s in r[f"{side}_spans"]] == [f"{text}<|end|>" for role, text in said if role == "assistant"]
    ten = next(r for r in got if r.pair_id == 10)
    assert ten.n_prompt == 3 and "a last<|end|>" in ten.rejected and ten.chosen.endswith("bye<|end|>\n") and ten.n_rejected == 1


def test_warc_revisits(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        kind = rnd.choice(["response", "response", "revisit"])
        url = rnd.choice(["http://A.com/x", "https://www.a.com/x#f", "http://b.com", "http://b.com/", "http://c.com/?q=1", None])
        tag = rnd.choice(['"1"', '"2"', 'W/"1"', None])
        rows.append((f"r{i:03}", kind, url, rnd.choice([None, *range(60)]) if i % 50 == 0 else rnd.randrange(60), {"etag": tag, "content-type": "t" + str(i), "expires": str(i)} if tag else {"expires": str(i)}, f"d{i % 3}" if kind == "response" else None, i))
    df = spark.createDataFrame([*rows, rows[0]], "record_id string, type string, url string, s int, headers map<string,string>, payload_digest string, payload_length long").withColumn("ts", F.timestamp_seconds("s"))
    canon = {None: None, "http://A.com/x": "a", "https://www.a.com/x#f": "a", "http://b.com": "b", "http://b.com/": "b", "http://c.com/?q=1": "c"}
    weak = lambda t: t.removeprefix("W/")
    for blocks in (64, 2):
        got = {r.record_id: r for r in warc.resolve_revisits(df, blocks).collect()}
        assert set(got) == {r[0] for r in rows if r[1] == "revisit"}
        for i, kind, url, s, head, *_ in rows:
            if kind != "revisit":
                continue
            src = max(((r[3], r[0], r) for r in rows if r[1] == "response" and canon[url] and s is not None and r[3] is not None and canon[r[2]] == canon[url] and r[3] < s), default=None, key=lambda z: z[:2])
            g = got[i]
            if src is None:
                assert g.status == "orphan"
                continue
            old = src[2][4]
            ok = weak(head["etag"]) == weak(old["etag"]) if "etag" in head and "etag" in old else True
            assert g.status == ("resolved" if ok else "mismatch")
            if ok:
                assert g.refers_to == src[1] and g.headers == {**old, **{k: v for k, v in head.items() if k in warc.PERMITTED}}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    head = {"content-type": "text/html", "etag": '"1"'}
    for z in (True, False):
        data = warc.encode_record("urn:1", "response", "http://a.com/", "2024-01-01T00:00:00Z", head, b"<p>\r\n\r\nx</p>", compress=z) + warc.encode_record("urn:2", "revisit", "http://a.com/", "2024-01-02T00:00:00Z", {}, b"", "urn:1", compress=z)
        (tmp_path / f"{z}.warc").write_bytes(data + b"broken")
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [r.record_id for r in rows] == ["urn:1"] * 2 + ["urn:2"] * 2
    assert rows[0].payload == b"<p>\r\n\r\nx</p>" and rows[0].headers == head and rows[2].refers_to == "urn:1" and rows[2].type == "revisit"


def test_records_survive_their_bytes(spark):
    big = bytes(range(256)) * 20_000
    rows = [(f"r{i}", "response" if i % 2 else "revisit", None if i == 3 else f"http://a.com/{i}?x=é", 60 * i, {"a": "b c", "etag": '"x: y"'} if i % 3 else {}, big if i == 5 else f"{i}\r\n\r\n".encode() if i % 2 else b"") for i in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id string, type string, url string, at long, headers map<string,string>, payload binary, content string")
    for z in (True, False):
        got = warc.records_of(warc.to_warc(df, compress=z)).selectExpr("record_id", "type", "url", "unix_seconds(ts)", "headers", "payload").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    assert warc.records_of(warc.to_warc(df.limit(0))).count() == 0


def test_digest_columns(spark):
    """The thin queries on the smallest tables: shapes, and digests that follow from the operators' outputs."""
    sf = "/root/testdata/sf0.001"
    out = queries.op3_repeated_passages(spark, sf)
    first = out.orderBy("doc_id").first()
    kept = substring.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")).where(F.col("doc_id") == first.doc_id).first().kept_text
    assert first.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
