"""Repeated bytes, Merkle manifest and tokenizer alignment against brute-force versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from notelake.llm import align, manifest, queries, suffix

DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, c string, rank long, key string"
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    """rows of doc_id and text, with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, None, "en", 1, t, "g", "c", 1, "k") for i, t in rows], DOCS).repartition(3)


def byte_rows():
    rnd = random.Random(3)
    text = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    passage = text(260)
    rows = [text(rnd.choice([0, 5, 150, 300, 900])) for _ in range(40)]
    for i in range(0, 40, 3):
        rows[i] += passage + rows[i][:50]
    for i in range(1, 40, 5):
        rows[i] = rows[(i * 7) % 40][20:] + "é"
    rows += [None, "", "a" * 1000, "ab" * 300, passage, passage[:200], passage[:199], text(5000) + rows[0] + text(3000), "x" * 200, "y" * 201]
    return [*enumerate(rows), (0, rows[0]), (None, rows[3]), (None, rows[3]), (None, None)]


def repeats(rows, w):
    count = Counter(x[i : i + w] for _, t in rows for x in [(t or "").encode()] for i in range(len(x) - w + 1))
    for d, t in rows:
        x = (t or "").encode()
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if count[x[i : i + w]] > 1:
                gone[i : i + w] = [True] * w
        starts = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        yield str(d), len(x), sum(gone), starts, bytes(b for b, g in zip(x, gone, strict=True) if not g)


@pytest.mark.parametrize("how", [{}, {"chunk_mb": 0.002}, {"chunk_mb": 0.002, "heavy": 3}, {"chunk_mb": 0.001, "heavy": 3, "fan": 2}])
def test_repeated_bytes(spark, how):
    rows = byte_rows()
    got = suffix.remove_repeated_bytes(frame(spark, rows), **how).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted(repeats(rows, 200))
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in itertools.pairwise(r.spans))


def test_repeated_bytes_of_an_empty_table(spark):
    assert suffix.remove_repeated_bytes(frame(spark, [])).collect() == []


def test_long_texts_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_SLICE", 1 << 10)
    rnd = random.Random(1)
    x = bytes(rnd.randrange(97, 101) for _ in range(9000))
    x += x[100:1500] + x[2000:2300]
    chunk = suffix._Chunk(suffix.pa.table({"text": [x, x[:50], b"", x[300:900]]}), 200, 64)
    p = chunk.pieces()
    covered = sorted(i for s, n in zip(p.start, p.n, strict=True) for i in range(s, s + n))
    assert covered == [*range(len(x) - 199), *range(len(x) + 53, len(x) + 53 + 401)]
    for k, s, left in zip(p.k, p.start, p.left, strict=True):
        same = [chunk.joined[a + b : a + b + 64] for key, a, b in zip(p.k, p.start, p.left, strict=True) if key == k]
        assert set(same) == {chunk.joined[s + left : s + left + 64]}


def test_columns_are_sorted_to_common_prefixes():
    rnd = random.Random(4)
    left = np.array([rnd.randrange(4) for _ in range(60)])
    n = np.array([rnd.randrange(1, 5) for _ in left])
    bodies = [bytes(rnd.choice(b"ab") for _ in range(k + 5)) for k in n]
    start = np.cumsum([0, *map(len, bodies[:-1])])
    windows = [(b[i : i + 6], i - a) for b, a, k in zip(bodies, left, n, strict=True) for i in range(k)]
    count = Counter(windows)
    assert suffix.repeated_windows(b"".join(bodies), start, left, n, 6).tolist() == [count[w] > 1 for w in windows]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(digests, fanout=16):
    """The top, and for each leaf its runs from below with its positions."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(at):
            paths[i].append((p % fanout, level[p // fanout * fanout :][:fanout]))
        at, level = [p // fanout for p in at], [sha("".join(level[s : s + fanout])) for s in range(0, len(level), fanout)]
    return level[0], paths


def manifest_of(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for r in rows:
        leaf = sha("".join(map(part, r)))
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, sha("".join(map(part, (*r[:4], low(r[4]))))) if changed else leaf, r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: tree([x[2] for x in groups[s].sort() or groups[s]]) for s in names}
    root, above = tree([tops[s][0] for s in names])
    for s, high in zip(names, above, strict=True):
        for x, own in zip(groups[s], tops[s][1], strict=True):
            levels, folded = own + high, x[3]
            proof = sha("".join("".join(run[:i] + run[i + 1 :]) for i, run in levels))
            for i, run in levels:
                folded = sha("".join([*run[:i], folded, *run[i + 1 :]]))
            yield str(x[4]), x[2], tops[s][0], root, proof, folded, folded == root


def manifest_rows(n, sources):
    rnd = random.Random(n)
    names = [None, "", "é", "a", "ab", *[f"s{j}" for j in range(sources)]]
    rows = [(rnd.choice([i * 7919 - 3000, i, i]), rnd.choice(names), rnd.choice([None, "en"]), rnd.choice([None, i, -i]), rnd.choice([None, "", f"Text É {i}"])) for i in range(n)]
    rows += [rows[0]] * 20 + [(None, "a", None, None, f"T{i % 30}") for i in range(60)] + [(5, "only", None, None, None)]
    return [*rows, (-(1 << 63), "a", "x", 1, "Z"), ((1 << 63) - 1, "a", "x", 1, "Z")]


@pytest.mark.parametrize(("n", "sources", "how"), [(700, 2, {}), (150, 40, {}), (500, 2, {"limit": 10})])
def test_manifest(spark, n, sources, how):
    rows = manifest_rows(n, sources)
    got = queries.tampered_manifest(spark.createDataFrame([(*r, "g", "c", 1, "k") for r in rows], DOCS).repartition(3), **how).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted(manifest_of(rows))


def test_manifest_of_one_row_and_of_none(spark):
    row = (3, None, None, None, "ABC")
    got = queries.tampered_manifest(spark.createDataFrame([(*row, "g", "c", 1, "k")], DOCS)).collect()
    assert [(str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got] == list(manifest_of([row]))
    assert queries.tampered_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_ranks_copies_in_steps(spark, monkeypatch):
    monkeypatch.setattr(manifest, "_COPIES", 4)
    rows = [(1, "a", None, None, "x")] * 30 + [(0, "a", None, None, "y"), (2, "a", None, None, "z")]
    got = queries.tampered_manifest(spark.createDataFrame([(*r, "g", "c", 1, "k") for r in rows], DOCS)).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted(manifest_of(rows))


def alignment_of(rows):
    first, second = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    found = []
    for d, t in rows:
        out = None
        if t:
            a, b = first.encode(f" {t}", add_special_tokens=False).ids, second.encode(t)
            spelt_a = [bytes(value[c] for c in first.id_to_token(i)) for i in a]
            spelt_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(spelt_a) == f" {t}".encode() == b"".join(spelt_b):
                ends = [list(itertools.accumulate(map(len, x), initial=0)) for x in (spelt_a, spelt_b)]
                owner = [[i for i, w in enumerate(x) for _ in w] for x in (spelt_a, spelt_b)]
                links = [(a[i], b[j]) for i, j in sorted(set(zip(*owner, strict=True)))]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                within = lambda ids, end, x, y: ",".join(str(i) for i, e in zip(ids, end[1:], strict=True) if x < e <= y)
                out = len(a), len(b), links, [f"{within(a, ends[0], x, y)}|{within(b, ends[1], x, y)}" for x, y in itertools.pairwise(cuts)]
        found.append((d, out))
    count = Counter(p for _, x in found if x for p in set(x[2]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for d, x in found:
        yield (str(d), 0, 0, 0, 0, 0, 0, "") if x is None else (
            str(d), x[0], x[1], len(x[3]), len(x[2]), sum(count[p] == best[p[0]] for p in x[2]), sum(count[p] for p in x[2]), sha(";".join(x[3])),
        )


@pytest.mark.parametrize("how", [{}, {"chunk_mb": 0.002}, {"chunk_mb": 0.002, "fan": 3}])
def test_alignment(spark, how):
    rnd = random.Random(5)
    odd = ["▁", "a▁b", "<s> </s> <unk> <|endoftext|> x", "<0x41> a", " ", "  ", "\n", "a  b\n c \t d", "日本語のテキスト です。", "👩‍👩‍👧 ok 😀", "x y　z\u0085w \x1c v", "don't we'll  I'M 1234567 3.14 é", "x" * 5000]
    parts = [" ", " ", "a", "B", "é", "\n", "\t", "1", "'s", " ", "日", "😀", ".", "▁", "́", "_", "\x1f", "​", "<s>"]
    odd += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(300)] + ["tail ", " lead", "the same words " * 40]
    rows = [*enumerate(odd), (None, None), (7, ""), (None, "a b"), (None, "a b"), (0, odd[0])]
    got = align.align_documents(frame(spark, rows), BYTE_BPE, PIECES, **how).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == sorted(alignment_of(rows))


def test_alignment_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op13_tokenizer_alignment(spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == sorted(alignment_of(rows))


def test_alignment_of_an_empty_table(spark):
    assert align.align_documents(frame(spark, []), BYTE_BPE, PIECES).collect() == []


def test_components_of_random_graphs():
    rnd = random.Random(9)
    u, v = np.array([rnd.randrange(80) for _ in range(60)]), np.array([rnd.randrange(80) for _ in range(60)])
    parent = list(range(80))
    for a, b in zip(u, v, strict=True):
        x, y = parent[a], parent[b]
        parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert align.components(80, u, v).tolist() == parent
