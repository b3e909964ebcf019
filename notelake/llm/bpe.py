"""BPE encoding and decoding as streaming transducers.

A token sequence is the BPE encoding of its text exactly when every token encodes to itself and every two neighbours encode to
themselves. So each prefix has one last token: the one that ends there and fits the last token of what precedes it.
The encoder keeps those last tokens for the unsettled end of the input only. Once more symbols are pending than the merge
list's sufficient lookahead, it emits the tokens that all live ends share. A text is read in stretches that end at white space, where
no word reaches over, and the tokens of a stretch go through the decoder at once: an incremental machine from token bytes to text that
keeps an unfinished character only. Beside the text and its result memory is that of one stretch; words within the
lookahead run through the same transducer without its emission step, as nothing is settled before their end.

Defined results: null texts are empty; an empty text has no tokens and decodes to an empty text; special tokens inside a text
are one token each, as in the tokenizers library; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRETCH = 1 << 16
_GAP = re.compile("[\t-\r ]")
_WHITE = "\t\n\x0b\x0c\r\x85 \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Codec:
    """Transducers for a tokenizer file of byte-level BPE with an end-of-word suffix."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        cut = len(self.suffix)
        joined = [(self.vocab[a], self.vocab[b], self.vocab[(a[:-cut] if cut and a.endswith(self.suffix) else a) + b]) for a, b in merges]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in reversed([*enumerate(joined)])}
        self.parts = {i: (i,) for i in [*self.first, *self.last]}
        self.made: dict[int, tuple[int, int, int]] = dict.fromkeys(self.parts, (-1, 0, 0))  # rank, left and right part
        for r, (a, b, c) in enumerate(joined):
            if c not in self.parts and a in self.parts and b in self.parts:
                self.parts[c] = self.parts[a] + self.parts[b]
                self.made[c] = (r, a, b)
        self.longest = max(map(len, self.parts.values()))
        self.trie: dict = {}
        for t, symbols in self.parts.items():
            if self.merge(symbols) == (t,):
                node = self.trie
                for s in symbols:
                    node = node.setdefault(s, {})
                node[-1] = t
        self.fits: dict[int, bool] = {}
        self.lookahead = self._sufficient_lookahead(joined)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tables: dict[bool, list[bytes]] = {}

    def bytes_of(self, forms: bool) -> list[bytes]:
        """What each token adds to the decoded bytes."""
        if forms not in self.tables:
            back, cut = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}, len(self.suffix)
            plain = lambda t: b"".join([back.get(c) or c.encode() for c in t])
            end = lambda t: plain(t[:-cut]) + b" " if cut and t.endswith(self.suffix) else plain(t)
            self.tables[forms] = [b" " + t.encode() if forms else t.encode() if t in self.special else end(t) for t in self.tokens]
        return self.tables[forms]

    def merge(self, symbols: tuple[int, ...]) -> tuple[int, ...]:
        """Applies the merge list to a short sequence: the first merge of the lowest rank again and again."""
        s = list(symbols)
        while len(s) > 1:
            r, at, c = min(((*(self.rank.get((s[i], s[i + 1])) or (1 << 60, 0)), i) for i in range(len(s) - 1)), key=lambda x: (x[0], x[2]))[0::2] + (0,)
            if r == 1 << 60:
                break
            s[at : at + 2] = [self.rank[s[at], s[at + 1]][1]]
        return tuple(s)

    def _sufficient_lookahead(self, joined: list[tuple[int, int, int]]) -> int:
        """Symbols after which a boundary can no longer change. A merge (u, v) can only be undone from the right by an earlier
        merge whose left side ends v, and that one in turn by a still earlier one: the longest such chain, plus a token."""
        chain: dict[int, int] = {}
        right: dict[int, int] = {}
        most = 0
        for a, b, c in joined:
            right.setdefault(c, b)
            here, x = 0, b
            while True:
                here = max(here, chain.get(x, 0))
                if x not in right or right[x] == x:
                    break
                x = right[x]
            length = len(self.parts.get(b, ())) + here
            most = max(most, length)
            chain[a] = max(chain.get(a, 0), length)
        return most + self.longest

    def _fit(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            ok = self.fits[key] = self._stay_apart(a, b)
        return ok

    def _stay_apart(self, a: int, b: int) -> bool:
        """Undoes the merges on both sides of the boundary from the latest on; no pair met across it may have been merged
        earlier than what was undone. Of equal ranks the left one comes first."""
        rank, made, limit = self.rank, self.made, 1 << 60
        while True:
            x = rank.get((a, b))
            if x is not None and x[0] < limit:
                return False
            p, q = made[a], made[b]
            if p[0] > q[0]:
                limit, a = p[0], p[2]
            elif q[0] >= 0:
                limit, b = q[0] + 1, q[1]
            else:
                return True

    def stream(self, symbols) -> Iterator[int]:
        """Tokens of a stream of symbols, each as soon as it is settled or the lookahead is full."""
        trie, fit = self.trie, self._fit
        before, base = -1, 0  # the last emitted token, and where it ends
        ends: dict[int, int] = {0: -1}  # position: last token of the prefix that ends there
        live: list[tuple[int, dict]] = []  # walks down the trie: start and node
        at = 0
        for s in symbols:
            live.append((at, trie))
            walks, at = live, at + 1
            live = []
            for start, node in walks:
                node = node.get(s)
                if node is not None:
                    live.append((start, node))
                    t = node.get(-1)
                    if t is not None and at not in ends:
                        left = ends[start] if start > base or before < 0 else before
                        if left < 0 or fit(left, t):
                            ends[at] = t
            live = [x for x in live if x[0] in ends]
            if at - base > self.lookahead + self.longest:
                common = None
                for p in {x for x, _ in live} | ({at} & ends.keys()):
                    path = self._path(ends, p, base)
                    common = path if common is None else [x for x, y in zip(common, path, strict=False) if x == y]
                for t in common or ():
                    yield t
                    before, base = t, base + len(self.parts[t])
                for p in [p for p in ends if p < base]:
                    del ends[p]
        for t in self._path(ends, at, base):
            yield t

    def _path(self, ends: dict[int, int], at: int, base: int) -> list[int]:
        out = []
        while at > base:
            out.append(ends[at])
            at -= len(self.parts[out[-1]])
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        b = word.encode()
        first, n = self.first, len(b)
        if n <= self.longest * 4:
            return self._short([first[x] for x in b[:-1]] + [self.last[b[-1]]])
        return list(self.stream(first[x] if i + 1 < n else self.last[x] for i, x in enumerate(b)))

    def _short(self, s: list[int]) -> list[int]:
        """stream() for input within the lookahead: nothing is emitted before the end."""
        trie, fits, fit, parts, n = self.trie, self.fits, self._fit, self.parts, len(s)
        ends = [-1] * (n + 1)
        for i in range(n):
            left = ends[i]
            if i and left < 0:
                continue
            node = trie
            for j in range(i, n):
                node = node.get(s[j])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None and ends[j + 1] < 0:
                    if i:
                        ok = fits.get(left << 20 | t)
                        if not (fit(left, t) if ok is None else ok):
                            continue
                    ends[j + 1] = t
        out = []
        while n:
            t = ends[n]
            out.append(t)
            n -= len(parts[t])
        out.reverse()
        return out

    def pieces(self, text: str) -> list[str]:
        """Words that are encoded on their own."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        return self.words.findall(text.replace("Σ", "σ").lower())

    def __missing(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.encode_word(word), np.int32).tobytes()
        if len(word) < 64:
            if len(self.young) >= 150_000:  # two generations: what was used lately stays
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def stretches(self, text: str) -> Iterator[str]:
        """The text in stretches of about 64 K characters that end at white space, where no word reaches over."""
        at = 0
        while at < len(text):
            end = at + _STRETCH
            if end < len(text):
                m = _GAP.search(text, end)
                end = m.end() if m else len(text)
            yield text[at:end] if at or end < len(text) else text
            at = end

    def encode_stream(self, text: str) -> Iterator[bytes]:
        """Token ids (int32 bytes) of one stretch after another; nothing but the word cache is kept between them."""
        special = self.special
        for stretch in self.stretches(text):
            out: list[bytes] = []
            for k, part in enumerate(self.split.split(stretch) if special and any(s in stretch for s in special) else (stretch,)):
                if k % 2:
                    out.append(np.int32(special[part]).tobytes())
                    continue
                get = self.young.get
                out += [get(w) or self.__missing(w) for w in self.pieces(part)]
            yield b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_stream(text)), np.int32)

    def decode(self, ids) -> str:
        """As the library does for a file without a decoder: the vocabulary's forms, joined by one space."""
        machine = Decoder(self)
        return machine.feed(ids) + machine.finish()


class Decoder:
    """Incremental machine from tokens to text: the bytes of each token go into a UTF-8 decoder, which gives out the characters that
    are complete and keeps the bytes of one that isn't. It holds nothing else, so its memory doesn't grow with the text.

    forms=True gives the text of the library for a file without a decoder: the vocabulary's own forms, one space before each but the first. forms=False
    turns byte symbols back into bytes and word ends into spaces."""

    def __init__(self, codec: Codec, forms: bool = True):
        self.table = codec.bytes_of(forms)
        self.first = forms
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        table = self.table
        data = b"".join([table[i] for i in ids])
        if self.first and data:
            data, self.first = data[1:], False
        return self.utf8.decode(data)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    key = hash(shared.value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """docs with ids (array of token ids) and, if asked for, decoded. path: a tokenizers file, read on the driver and sent
    to the executors. Input columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            at, col = 0, batch.column(len(keep))
            while at < len(col):
                ids, texts, total, start = [], [], 0, at
                while at < len(col) and (not ids or total < 1 << 19):
                    t = (col[at].as_py() or b"").decode("utf-8", "replace")
                    parts, machine, out = [], Decoder(codec), []
                    for x in codec.encode_stream(t):
                        parts.append(x)
                        if decode:
                            out.append(machine.feed(np.frombuffer(x, np.int32).tolist()))
                    ids.append(np.frombuffer(b"".join(parts), np.int32))
                    texts.append("".join([*out, machine.finish()]) if decode else None)
                    total += len(t)
                    at += 1
                part = batch.slice(start, at - start)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32())), pa.array(texts, pa.string())],
                    names=[*keep, "ids", "decoded"],
                )

    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    out = docs.select(*keep, F.col("text").cast("binary").alias("__text")).mapInArrow(run, schema)
    return out if decode else out.drop("decoded")
