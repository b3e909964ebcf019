"""Personal data by candidate generation and gradient-boosted trees, in DataFrame operations only.

Base kinds (email, ip, card, phone) are exact patterns with validity checks; all their spans stay. High-recall generators
propose further, possibly overlapping spans (spelled-out addresses, national phone numbers, identity numbers, bank
accounts, secrets); boosted trees score each from its format and context, and a threshold for each kind picks what is added.

The trees are trained here: synthetic sentences with known answers run through the same generators and features, a bounded
table of candidates (a few thousand) comes to the driver, and the fitted trees go back into the plan as CASE expressions. The
threshold of a kind is the lowest score with a precision of 0.98 on sentences of other wordings and formats, which training doesn't see; a kind
that doesn't reach it gets the score of its best precision.

Offsets are code points, end exclusive. Defined results: a null text is an empty one; an empty table gives no rows; no order or key is needed, so
null or repeated doc_ids and other columns don't matter; overlapping spans of two kinds both stay.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no valid span of the kind.
NEED = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": BASE["ip"], "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]"}
EXTRA = {
    "email_text": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}+ ?(?:[(\[]at[)\]]| at ) ?[a-z0-9-]{2,63} ?(?:[(\[]dot[)\]]| dot ) ?[a-z]{2,12}(?![a-z])",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z])(?:api[_-]?key|secret|token|passwd|password|pwd)[\"']? ?[:=] ?[\"']?[A-Za-z0-9/+_.=~%$-]{8,}(?<!\.)",
}
#: Cheap conditions for the generators to run at all.
GATE = {"email_text": r"(?i)[(\[ ]dot[)\] ]", "phone_local": r"[0-9][ .-][0-9]{3}", "ssn": r"[0-9][- ][0-9]{2}[- ][0-9]", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "secret": r"(?i)(?:key|secret|token|passw|pwd)[\w\"']* ?[:=]"}
_SPAN = "array<struct<kind:string,start:int,end:int,m:string,before:string,after:string>>"
_STEP = 256


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, kind: str, pattern: str, need: str) -> Column:
    """All non-overlapping matches with code-point offsets, 24 characters before and 8 after. Offsets are prefix sums over
    blocks of 256, so a text with very many matches stays cheap."""

    def with_lengths(x: Column) -> Column:
        lens = F.zip_with(x["found"], F.slice(x["rest"], F.lit(1), F.size(x["found"])), lambda m, r: F.length(m) + F.length(r))
        return _let(F.struct(x["found"].alias("found"), x["rest"].alias("rest"), lens.alias("lens")), with_blocks)

    def with_blocks(x: Column) -> Column:
        n = F.floor((F.size(x["lens"]) - 1) / _STEP).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n), lambda b: F.aggregate(F.slice(x["lens"], b * _STEP + 1, F.lit(_STEP)), F.lit(0), lambda a, v: a + v))
        bases = _let(sums, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), F.lit(0), lambda a, v: a + v)))
        return _let(F.struct(x["found"].alias("found"), x["rest"].alias("rest"), x["lens"].alias("lens"), bases.alias("bases")), spans)

    def spans(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            b = F.floor(i / _STEP).cast("int")
            end = x["bases"][b] + F.aggregate(F.slice(x["lens"], b * _STEP + 1, i - b * _STEP + 1), F.lit(0), lambda a, v: a + v)
            return F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("m"), F.right(x["rest"][i], F.lit(24)).alias("before"), F.left(x["rest"][i + 1], F.lit(8)).alias("after"))

        return F.transform(x["found"], one)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("rest"))
    none = F.expr(f"cast(array() as {_SPAN})")
    some = _let(found, lambda x: F.when(F.size(x["found"]) > 0, with_lengths(x)).otherwise(none))
    return F.when(F.regexp(text, F.lit(need)), some).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(x: Column) -> Column:
    m, kind = x["m"], x["kind"]
    parts = F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), -3, 3), F.lit("999")), F.lit(999)) <= 255))
    n = F.length(_digits(m))
    return F.when(kind == "ip", parts).when(kind == "card", n.between(14, 19) & F.call_function("luhn_check", _digits(m))).when(kind == "phone", n.between(10, 15)).otherwise(True)


def base_spans(text: Column) -> Column:
    return F.filter(F.concat(*[matches(text, k, p, NEED[k]) for k, p in BASE.items()]), valid)


def candidates(text: Column) -> Column:
    return F.concat(*[matches(text, k, p, GATE[k]) for k, p in EXTRA.items()])


def features(x: Column) -> list[Column]:
    """Format and context of a candidate, as doubles."""
    m, near = x["m"], F.lower(F.concat(x["before"], F.lit(" "), x["m"]))
    digits = F.length(_digits(m))
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    hint = lambda p: F.regexp(near, F.lit(p))
    return [c.cast("double") for c in (
        *[x["kind"] == k for k in EXTRA],
        F.length(m), digits, letters, F.length(m) - digits - letters,
        F.size(F.array_distinct(F.split(m, ""))),
        F.size(F.array_distinct(F.split(_digits(m), ""))),
        F.length(F.regexp_replace(m, r"[^()\[\]]", "")), F.length(F.regexp_replace(m, "[^-]", "")), F.length(F.regexp_replace(m, "[^.]", "")),
        F.length(F.regexp_replace(m, "[a-z]", "")) - digits,
        hint(r"call|phone|tel|mobile|fax|cell|dial|reach"), hint(r"ssn|social|security|tax"), hint(r"iban|account|bank|transfer"), hint(r"mail|contact|write|@"),
        hint(r"token|secret|key|password|passwd|pwd"), hint(r"version|page|isbn|order|range|years|score|part|chapter|serial"),
        F.regexp(m, F.lit(r"^\(?0")), F.regexp(m, F.lit(r"^(?:000|666|9)")), F.regexp(m, F.lit(r"[0-9].*[A-Za-z].*[0-9]")), F.regexp(m, F.lit("[\"']")),
        F.regexp(x["after"], F.lit(r"^[.,;\s]|^$")), F.regexp(x["before"], F.lit(r"\s$|^$")),
    )]


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, cut, (feature, cut) of either side, four leaves)."""

    start: float
    trees: list[tuple]
    thresholds: dict[str, float]

    def picks(self, x: Column) -> Column:
        """Whether a candidate reaches the threshold of its kind."""
        least = reduce(lambda c, k: c.when(x["kind"] == k, F.lit(self.thresholds[k])), self.thresholds, F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(2.0))
        return self.score(features(x)) >= least

    def score(self, f: list[Column]) -> Column:
        def tree(t) -> Column:
            i, a, (j, b), (k, c), v = t
            return F.when(f[i] <= a, F.when(f[j] <= b, v[0]).otherwise(v[1])).otherwise(F.when(f[k] <= c, v[2]).otherwise(v[3]))

        z = reduce(lambda s, t: s + tree(t), self.trees, F.lit(self.start))
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for i, a, (j, b), (k, c), v in self.trees:
            z += np.where(x[:, i] <= a, np.where(x[:, j] <= b, v[0], v[1]), np.where(x[:, k] <= c, v[2], v[3]))
        return 1 / (1 + np.exp(-z))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    best, at = -1.0, (0, 0.0)
    for i in range(x.shape[1]):
        values = np.unique(x[:, i])
        for cut in (values[:-1] + values[1:])[:: max(1, len(values) // 12)] / 2:
            left = x[:, i] <= cut
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
            if gain > best:
                best, at = gain, (i, float(cut))
    return at


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, rate: float = 0.4) -> Trees:
    """Newton boosting on the logistic loss."""
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    model = Trees(float(np.log(mean / (1 - mean))), [], {})
    for _ in range(rounds):
        p = model.predict(x)
        g, h = y - p, p * (1 - p)
        root = _split(x, g, h)
        left = x[:, root[0]] <= root[1]
        sides = [_split(x[s], g[s], h[s]) if s.any() else (0, 0.0) for s in (left, ~left)]
        leaves = []
        for s, (i, cut) in zip((left, ~left), sides, strict=True):
            for low in (True, False):
                part = s & ((x[:, i] <= cut) == low)
                leaves.append(float(np.clip(rate * g[part].sum() / (h[part].sum() + 1), -3, 3)) if part.any() else 0.0)
        model.trees.append((*root, *sides, tuple(leaves)))
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, precision: float = 0.98) -> dict[str, tuple[float, float, float]]:
    """Sets the threshold of each kind, and returns it with the precision and recall on these rows."""
    p, out = model.predict(x), {}
    for i, kind in enumerate(EXTRA):
        own, right = p[x[:, i] > 0], y[x[:, i] > 0]
        found = []
        for t in np.unique(np.append(np.floor(own * 1e4) / 1e4, 0.5)):
            keep = own >= t
            if keep.any():
                found.append((float(max(t, 0.3)), float(right[keep].mean()), float(right[keep].sum() / max(right.sum(), 1))))
        good = [f for f in found if f[1] >= precision]
        out[kind] = good[0] if good else max(found, key=lambda f: f[1]) if found else (1.0, 0.0, 0.0)
        model.thresholds[kind] = out[kind][0]
    return out


def examples(n: int = 1500, seed: int = 13, held_out: bool = False) -> list[tuple[str, bool]]:
    """Sentences with one candidate each, and whether it is personal data. held_out: of wordings and formats that the others don't have."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rnd.choice(["an", "er", "th", "lo", "mi", "ka", "so", "re"]) for _ in range(rnd.randint(1, 4)))
    h = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    pad = lambda s: " ".join([*(w() for _ in range(rnd.randint(1, 6))), s, *(w() for _ in range(rnd.randint(0, 5)))])
    made = [
        lambda: (f"{rnd.choice(['mail', 'contact', 'write to', ''])} {w()}.{w()} {rnd.choice(['[at]', '(at)', 'at'])} {w()} {rnd.choice(['[dot]', '(dot)', 'dot'])} {rnd.choice(['com', 'org', 'net', 'de'])}", True),
        lambda: (f"we met at {w()} dot {w()}{w()}", False),
        lambda: (f"{rnd.choice(['call', 'tel', 'phone:', 'mobile', 'fax', 'dial'])} {rnd.choice([f'({d(3)}) {d(3)}-{d(4)}', f'{d(3)}-{d(3)}-{d(4)}', f'0{d(2)} {d(4)} {d(4)}', f'{d(3)}.{d(3)}.{d(4)}'])}", True),
        lambda: (f"({d(3)}) {d(3)}-{d(4)}", True),
        lambda: (f"{rnd.choice(['version', 'pages', 'order', 'range', 'score', 'serial', 'part', ''])} {rnd.choice([f'{d(3)}.{d(3)}.{d(3)}', f'{d(2)} {d(3)} {d(3)}', f'{d(4)}-{d(4)}-{d(4)}', f'{d(2)}.{d(4)}.{d(3)}'])}", False),
        lambda: (f"{rnd.choice(['ssn', 'social security', 'SSN:', 'tax id'])} {rnd.choice('12345')}{d(2)}-{d(2)}-{d(4)}", True),
        lambda: (f"{rnd.choice(['part', 'serial', 'isbn', 'chapter', ''])} {rnd.choice(['000', '666', '9' + d(2)])}{rnd.choice('- ')}{d(2)}{rnd.choice('- ')}{d(4)}", False),
        lambda: (f"{rnd.choice(['iban', 'account', 'bank transfer to', ''])} {rnd.choice(['DE', 'FR', 'GB', 'ES'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", True),
        lambda: (f"{rnd.choice(['part', 'serial', 'order'])} {rnd.choice(['AB', 'QX', 'ZZ'])}{d(2)}{''.join(rnd.choice('ABCDEFGH') for _ in range(12))}", False),
        lambda: (f"{rnd.choice(['token', 'secret', 'api_key', 'password'])} {rnd.choice(['=', ':'])} {rnd.choice(['', chr(34)])}{rnd.choice([h(40), h(32), d(3) + w() + d(4) + w() + d(2)])}", True),
        lambda: (f"{rnd.choice(['token', 'secret', 'password'])}: {w()}{w()}{w()}{w()}{w()}{w()}{w()}", False),
    ]
    if held_out:
        made = [
            lambda: (f"{rnd.choice(['my mail is', 'send it to', 'address:', 'ask'])} {w()}{d(2)} {rnd.choice(['(at)', '[at]'])} {w()}-{w()} {rnd.choice(['(dot)', '[dot]'])} {rnd.choice(['edu', 'fr', 'io'])}", True),
            lambda: (f"{rnd.choice(['look', 'she stayed', 'it starts'])} at {w()} dot {w()}{w()}{w()}", False),
            lambda: (f"{rnd.choice(['reach us under', 'cell', 'my telephone is', 'mobile number'])} {rnd.choice([f'({d(3)}) {d(3)} {d(4)}', f'{d(3)} {d(3)} {d(4)}', f'0{d(3)}-{d(3)}-{d(4)}'])}", True),
            lambda: (f"{rnd.choice(['chapter', 'isbn', 'years', 'version'])} {rnd.choice([f'{d(3)}.{d(3)}.{d(4)}', f'{d(4)} {d(4)} {d(4)}', f'{d(3)}-{d(4)}-{d(4)}'])}", False),
            lambda: (f"{rnd.choice(['my social security number is', 'tax number'])} {rnd.choice('1234567')}{rnd.choice('0123')}{d(1)} {d(2)} {d(4)}", True),
            lambda: (f"{rnd.choice(['range', 'order', 'lot'])} {rnd.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", False),
            lambda: (f"{rnd.choice(['pay to account', 'his bank is', 'IBAN:'])} {rnd.choice(['NL', 'IT', 'CH', 'AT'])}{d(2)}{d(4)}{d(4)}{d(4)}{d(4)}", True),
            lambda: (f"{rnd.choice(['page', 'model', 'chapter'])} {rnd.choice(['XK', 'MM', 'PQ'])}{d(2)} {''.join(rnd.choice('JKLMNOPR') for _ in range(4))} {''.join(rnd.choice('JKLMNOPR') for _ in range(4))} {''.join(rnd.choice('JKLMNOPR') for _ in range(4))}", False),
            lambda: (f"{rnd.choice(['passwd', 'pwd', 'api-key', 'secret'])}{rnd.choice(['=', ': '])}{rnd.choice([h(24), h(64), d(2) + w() + '-' + d(3) + w() + d(1)])}", True),
            lambda: (f"{rnd.choice(['a secret', 'this token', 'no password'])}: {w()}{w()}{w()}{w()}{w()}", False),
        ]
    out = []
    for i in range(n):
        s, y = made[i % len(made)]()
        out.append((pad(s.strip()), y))
    return out


_MODEL: list[Trees] = []


def scored(spark: SparkSession, sentences: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and answers of the candidates of fixed sentences."""
    rows = spark.createDataFrame(sentences, "text string, y boolean").select("y", F.explode(candidates(F.col("text"))).alias("x")).select(F.col("y").cast("double"), F.array(*features(F.col("x"))).alias("f")).collect()
    return np.array([r[1] for r in rows]), np.array([r[0] for r in rows])


def model(spark: SparkSession) -> Trees:
    """Trained and calibrated once a process: it depends on nothing but the fixed examples."""
    if not _MODEL:
        trees = boost(*scored(spark, examples()))
        calibrate(trees, *scored(spark, examples(seed=29, held_out=True)))
        _MODEL.append(trees)
    return _MODEL[0]


def find_personal(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """docs with base (array of kind, start, end, m, before, after) and added (kind, start, end) spans. Input columns of these names are replaced."""
    trees = trees or model(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    picked = F.filter(candidates(text), trees.picks)
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    return docs.withColumns({"base": F.transform(base_spans(text), bare), "added": F.transform(picked, bare)})


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of BASE and EXTRA, joined by commas."""
    kinds = F.array(*map(F.lit, [*BASE, *EXTRA]))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.array_position(kinds, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """Replaces each maximal union of overlapping spans by the kind of its first span in brackets."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    piece = "struct<at:int,out:array<string>>"
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")).cast(piece)

    def step(a: Column, x: Column) -> Column:
        fresh = F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("["), F.upper(x["k"]), F.lit("]")))).alias("out")).cast(piece)
        longer = F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")).cast(piece)
        return F.when(x["s"] >= a["at"], fresh).otherwise(longer)

    done = F.aggregate(keyed, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
