"""Pairs in tiles against plain definitions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from notelake.operators import parse, recommend, tiles


def lists(rows):
    return tiles.Sets.of(pa.chunked_array([pa.array(rows, pa.list_(pa.int64()))]))


@pytest.mark.parametrize("dense", [1, 256, 1 << 40])
def test_overlap(monkeypatch, dense):
    """Common items by matrix product, by both ways, and one by one in small steps."""
    monkeypatch.setattr(tiles, "_DENSE", dense)
    monkeypatch.setattr(tiles, "_STEP", 50)
    rnd = random.Random(dense)
    a, b = ([rnd.sample(range(k), rnd.randint(0, 6)) for _ in range(m)] for k, m in ((9, 30), (12, 20)))
    x, y = lists(a), lists(b)
    assert tiles.overlap(x, y).astype(int).tolist() == [[len(set(u) & set(v)) for v in b] for u in a]
    assert tiles.ratio(tiles.overlap(x, y), x, y) == pytest.approx(np.array([[len(set(u) & set(v)) / len({*u, *v}) if u or v else 0 for v in b] for u in a]))
    assert tiles.overlap(lists([[1]]), lists([[2], []])) is None
    w = [tiles.Sets.entries(np.concatenate([np.array(r, np.int64) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([len(r) for r in rows]), np.concatenate([np.array(r, float) for r in rows])) for rows in (a, b)]
    assert tiles.overlap(*w) == pytest.approx(np.array([[sum(i * i for i in set(u) & set(v)) for v in b] for u in a]))


def corpus(spark, n=50):
    rnd = random.Random(n)
    words = ["alpha", "beta", "gamma", "delta", "zeta", "omega", "psi", "chi"]
    rows = [("v", rnd.choice(["x/", "y/", ""]) + f"n{i}.md", f"{rnd.choice(words)} {rnd.choice(words)}", " ".join(rnd.sample(words, rnd.randint(0, 4))) + "".join(f" [[n{rnd.randrange(4)}]]" for _ in range(rnd.randint(0, 2)))) for i in range(n)]
    return parse.parse_v2(spark.createDataFrame(rows, "vault string, rel_path string, title string, content string"))


def brute(parsed, c):
    """Confidence of each pair, and the number of pairs of each similarity."""
    rows = {r.rel_path: r for r in parsed.collect()}
    share = lambda a, b: len(set(a) & set(b)) / len({*a, *b}) if {*a, *b} else 0.0
    raw = {(a, b): share(rows[a].top_terms, rows[b].top_terms) for a, b in itertools.combinations(sorted(rows), 2)}
    values = sorted(raw.values())
    q = {v: ((values.index(v) + len(values) - 1 - values[::-1].index(v)) / 2) / max(len(values) - 1, 1) for v in set(values)}
    out = {}
    for (a, b), v in raw.items():
        x, y = rows[a], rows[b]
        factor = 1.0 if a.split("/")[0] == b.split("/")[0] else c.penalty
        score = (q[v] if c.norm == "quantile" else v) * c.w_content + share(x.title_tokens, y.title_tokens) * c.w_title + share(x.link_set, y.link_set) * c.w_link
        out[a, b] = min(max(score * factor, c.clamp_min), c.clamp_max)
    return out, {v: values.count(v) for v in q}


@pytest.mark.parametrize("norm", ["quantile", "none"])
@pytest.mark.parametrize("size", [2000, 6])
def test_recommendations_against_all_pairs(spark, norm, size):
    parsed, c = corpus(spark).persist(), recommend.Scoring(norm=norm)
    want, hist = brute(parsed, c)
    p = recommend.AllPairs(parsed, c, size)
    assert {round(r.raw, 12): r.pairs for r in p.quantiles().collect()} == {round(v, 12): k for v, k in hist.items()}
    full = {(r.l, r.r): round(r.confidence, 12) for r in p.pairs().collect()}
    assert full == {k: round(v, 12) for k, v in want.items() if v >= c.min_related}
    assert {(r.l, r.r) for r in p.pairs(0.6).collect()} == {k for k, v in want.items() if v >= 0.6}
    for top in (1, 3):
        got = {(r.rel_path, r.rank): (r.target_path, round(r.confidence, 12)) for r in p.suggestions(top).collect()}
        best = {}
        for (a, b), v in want.items():
            if v >= c.min_related:
                best.setdefault(a, []).append((-v, b))
                best.setdefault(b, []).append((-v, a))
        assert got == {(k, i + 1): (t, round(-v, 12)) for k, x in best.items() for i, (v, t) in enumerate(sorted(x)[:top])}
        assert got == {(r.rel_path, r.rank): (r.target_path, round(r.confidence, 12)) for r in recommend.related(recommend.pairs(parsed, c), c, top).collect()}


def test_no_row_a_pair(spark):
    """What the tasks return for statistics and suggestions doesn't grow with the pairs."""
    p = recommend.AllPairs(corpus(spark, 120), recommend.Scoring(min_related=0.0), 10)
    assert p.histogram().count() < 100 and p.pairs(0.0).count() == 120 * 119 // 2
    assert p.suggestions().count() == 360


def test_no_notes_and_one(spark):
    for n in (0, 1):
        p = recommend.AllPairs(corpus(spark, n))
        assert p.pairs(0.0).count() == p.suggestions().count() == 0


def test_order_statistics(spark):
    from notelake.operators import stats

    rnd = random.Random(2)
    values = [rnd.choice([rnd.random() * 100, 7.5, -3.0, 1e-300 * rnd.random(), 1e9]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").persist()
    for rank in (0, 1, 77, 200, 398, 399):
        assert stats.order_statistic(df, "x", rank, parts=8) == sorted(values)[rank]
    assert stats.order_statistic(df, "x", 400) is None and stats.order_statistic(df.limit(0), "x", 0) is None


@pytest.mark.parametrize("size", [2000, 6])
def test_merges_without_pair_rows(spark, size):
    parsed, c = corpus(spark).persist(), recommend.Scoring(merge=0.75)
    p = recommend.AllPairs(parsed, c, size)
    rows = lambda m: sorted((r.component, tuple(r.candidates), r.average_confidence) for r in m.collect())
    want = rows(recommend.merges(p.pairs(c.merge), c))
    assert want and rows(p.merges()) == want


def test_pairs_leave_a_task_in_slices(spark, monkeypatch):
    """The rows that one unit of tiles returns are handed on tile by tile, in slices, instead of being gathered."""
    from notelake.operators import tiles

    p, seen = recommend.AllPairs(corpus(spark, 60), recommend.Scoring(), 10), []
    monkeypatch.setattr(recommend, "over_units", lambda packs, kernel, schema: seen.append((packs, kernel)) or tiles.over_units(packs, kernel, schema))
    assert p.pairs(0.0, reasons=False).columns == ["l", "r", "confidence"]
    packs, kernel = seen[-1]
    loaded = [(r.b, tiles.unpacked(r.data)) for r in sorted(packs.collect(), key=lambda r: r.b)]
    out = kernel(loaded, loaded)
    assert not isinstance(out, pa.Table)
    sizes = [t.num_rows for t in out]
    assert len(sizes) >= len(loaded) and sum(sizes) == 60 * 59 // 2 and max(sizes) < 60 * 59 // 4


def test_top_terms_are_counted_where_the_text_is(spark):
    from pyspark.sql import functions as F

    from notelake.functions.text import tokens

    texts = ["b10 B10 aaa Aaa zz zzz", None, "", "é abc-abc_ABC Kab İabc xyz" * 3, " ".join(f"w{i % 97} v{i % 13}x" for i in range(900))]
    d = spark.createDataFrame([("v" if i else None, f"n{i}.md", f"n{i}", t) for i, t in enumerate(texts)], "vault string, rel_path string, title string, content string")
    words = {r.rel_path: r.w or [] for r in d.select("rel_path", tokens(F.col("content")).alias("w")).collect()}
    p = parse.parse_v2(d).select("rel_path", "top_terms")
    want = {k: sorted(set(w), key=lambda x: (-w.count(x), x))[:30] for k, w in words.items()}
    assert {r.rel_path: r.top_terms for r in p.collect()} == want
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
