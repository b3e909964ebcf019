"""Related notes, metadata and merge suggestions over parsed (v2) notes.

The confidence of a pair needs the quantile of its content similarity among all n(n-1)/2 pairs. All pairs are judged in tiles (see
tiles.py), so none of them becomes a row: a first pass counts, in each task, how many pairs have which number of common terms and which sizes,
integers of which there are a few hundred combinations; their quantiles are known to the second pass, which returns the best suggestions of
each note, or the pairs at a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.functions.text import jaccard, round_half_even

from .edits import ANCHOR
from .graph import components, saved
from .overlaps import overlaps
from .tiles import Sets, alike, blocks, common, distinct, over_units, overlap, pair_rows, repeated, stars, tiles


@dataclass(frozen=True)
class Scoring:
    w_content: float = 0.6
    w_title: float = 0.3
    w_link: float = 0.1
    clamp_min: float = 0.0
    clamp_max: float = 1.0
    min_related: float = 0.3
    merge: float = 0.85
    low: float = 0.45
    penalty: float = 0.9
    norm: str = "quantile"


def quantiles(raw: DataFrame, n: int) -> DataFrame:
    """raw, pairs, q of every distinct similarity over all pairs of n notes, 0 included. raw: one row a pair, or rows that count pairs. One
    row a distinct value is left, so the window is over a few hundred rows."""
    total = n * (n - 1) // 2
    hist = raw.groupBy("raw").agg((F.sum("pairs") if "pairs" in raw.columns else F.count("*")).alias("pairs"))
    zero = hist.agg(F.lit(0.0).alias("raw"), (F.lit(total) - F.coalesce(F.sum("pairs"), F.lit(0))).cast("long").alias("pairs"))
    h = hist.unionByName(zero).where("pairs > 0")
    before = F.sum("pairs").over(W.orderBy("raw").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("pairs")
    q = ((2 * before + F.col("pairs") - 1) / F.lit(2.0)) / F.lit(float(max(total - 1, 1))) if total > 1 else F.lit(1.0)
    return h.select("raw", "pairs", q.alias("q"))


_PARTS = "raw double, content_sim double, title_sim double, link_overlap double, factor double, confidence double"
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]
#: Entries of a tile's table of confidences; beyond it, pairs are judged one by one.
_TABLE = 1 << 20


class _Notes:
    """A block of notes: paths, top folders, and the sets that pairs are judged by."""

    def __init__(self, t: pa.Table):
        self.path = t.column("path").to_numpy(zero_copy_only=False)
        self.folder = t.column("folder").to_numpy()
        self.terms, self.title, self.links = (Sets.of(t.column(c)) for c in ("terms", "title", "links"))


class AllPairs:
    """All pairs of parsed notes under one scoring; rel_path is their key."""

    def __init__(self, parsed: DataFrame, c: Scoring = Scoring(), size: int = 2000):  # noqa: B008
        ids = lambda col: F.array_distinct(F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.xxhash64(x)))
        self.c, self.titles = c, parsed.select(F.col("rel_path").alias("r"), F.col("title").alias("r_title"))
        folder = F.xxhash64(F.split_part("rel_path", F.lit("/"), F.lit(1)))
        near = F.xxhash64("vault") if "vault" in parsed.columns else F.lit(0).cast("long")
        rows = parsed.select(
            F.lit("").alias("part"), F.col("rel_path").alias("path"), near.alias("near"), folder.alias("folder"), ids(F.col("top_terms")).alias("terms"), ids(F.col("title_tokens")).alias("title"), ids(F.col("link_set")).alias("links")
        )
        # Written before it is counted and dealt, as the terms of a note are dear and their hashes few.
        self._rows, self._size, self._blocks, self._hist, self._table = saved(rows), size, None, None, None

    @property
    def blocks(self) -> DataFrame:
        if self._blocks is None:
            self._blocks = blocks(self._rows.drop("near"), "path", lambda t: t, self._size)
        return self._blocks

    def histogram(self) -> DataFrame:
        """both, size, pairs: how many pairs have so many common terms, and terms in the two notes together."""
        if self._hist is None:
            self._hist = saved(overlaps(self._rows.select("part", "path", "near", "terms"), "path", 8 * self._size))
        union = F.col("size") - F.col("both")
        return self._hist.withColumn("raw", F.when(union > 0, F.col("both") / F.nullif(union, F.lit(0))).otherwise(F.lit(0.0)))

    def quantiles(self) -> DataFrame:
        """raw, pairs, q of every distinct similarity."""
        hist = self.histogram()
        total = hist.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        return quantiles(hist.select("raw", "pairs"), round((1 + (1 + 8 * total) ** 0.5) / 2))

    def _content(self) -> np.ndarray | None:
        """Quantile by common terms and terms together, a few hundred numbers; None where raw similarities count."""
        if self.c.norm != "quantile":
            return None
        if self._table is None:
            rows = self.histogram().join(self.quantiles().select("raw", "q"), "raw").select("both", "size", "q").collect()
            self._table = np.zeros((max((r.both for r in rows), default=0) + 1, max((r["size"] for r in rows), default=0) + 1))
            for r in rows:
                self._table[r.both, r["size"]] = r.q
            self._steps = np.array(sorted({(r.both / max(r["size"] - r.both, 1), r.q) for r in rows})).reshape(-1, 2)
        return self._table

    def _tile(self):
        """Function of two blocks and whether they are the same: their tile."""
        c, content = self.c, self._content()
        steps = None if content is None else self._steps
        return lambda x, y, same: _Tile(x, y, c, content, steps, same)

    def pairs(self, least: float | None = None, reasons: bool = True) -> DataFrame:
        """l, r, l_title, r_title, raw, content_sim, title_sim, link_overlap, factor, confidence of pairs (l < r) of a confidence of `least` or more;
        by default of the smaller threshold of the scoring. Without reasons l, r and confidence alone, which no join follows."""
        least = min(self.c.min_related, self.c.merge) if least is None else least
        tile = self._tile()

        def keep(lefts, rights):
            for (a, x), (b, y) in tiles(lefts, rights, _Notes):
                found, parts = tile(x, y, a == b).at_least(least)
                names = _NAMES if reasons else _NAMES[-1:]
                yield from pair_rows(x.path, y.path, np.flatnonzero(np.triu(found, 1) if a == b else found), dict(zip(names, parts[-len(names) :], strict=True)))

        if not reasons:
            return over_units(self.blocks, keep, "l string, r string, confidence double")
        found = over_units(self.blocks, keep, f"l string, r string, {_PARTS}")
        left = self.titles.select(F.col("r").alias("l"), F.col("r_title").alias("l_title"))
        return found.join(left, "l").join(self.titles, "r").select("l", "r", "l_title", "r_title", *found.columns[2:])

    def merges(self) -> DataFrame:
        """As merges() of the pairs at the merge threshold, none of which becomes a row: a tile returns, for each of its notes with such a pair, a note that the
        pairs lead to, and the sum and number of the pairs that are counted at it."""
        tile, least = self._tile(), self.c.merge

        def link(lefts, rights):
            for (a, x), (b, y) in tiles(lefts, rights, _Notes):
                found, parts = tile(x, y, a == b).at_least(least)
                found = np.triu(found, 1) if a == b else found
                pair = np.divmod(np.flatnonzero(found), len(y.path))
                total, n = (np.bincount(pair[0], v, len(x.path)) for v in (parts[-1][pair], None))
                row, col = stars(found, a == b)
                keys = pa.array(x.path if a == b else np.concatenate([x.path, y.path]), pa.string())
                to = row if a == b else np.concatenate([row, col])
                rest = len(to) - len(n)
                total, n = np.append(total, np.zeros(rest)), np.append(n, np.zeros(rest, np.int64))
                some = np.flatnonzero((to != np.arange(len(to))) | (n > 0))
                yield pa.table({"u": keys.take(pa.array(some)), "v": keys.take(pa.array(to[some])), "total": pa.array(total[some]), "pairs": pa.array(n[some].astype(np.int64))})

        e = saved(over_units(self.blocks, link, "u string, v string, total double, pairs long"))
        return _clusters(components(e.select("u", "v")), e)


    def suggestions(self, top: int = 3) -> DataFrame:
        """As related(): the best suggestions of each note. A unit returns the best of each of its notes, whose bar rises from tile to
        tile, so rows are notes times units in a line, whatever number of pairs reaches the threshold. Only pairs whose common terms can
        reach the bar of one of the two notes are judged."""
        c, tile = self.c, self._tile()

        def best(lefts, rights):
            notes = {}
            for (a, x), (b, y) in tiles(lefts, rights, _Notes):
                for k, n in ((a, x), (b, y)):
                    notes[k] = notes.get(k) or _Best(n.path, top, c.min_related)
                tile(x, y, a == b).judge(notes[a], notes[b])
            return pa.concat_tables([n.found() for n in notes.values()] or [_rows([], [], [])])

        found = over_units(self.blocks, best, f"l string, r string, {_PARTS}")
        rank = F.row_number().over(W.partitionBy("l").orderBy(F.desc("confidence"), "r"))
        rows = found.withColumn("rank", rank).where(F.col("rank") <= top).join(self.titles, "r")
        why = ["raw", "content_sim", "title_sim", "link_overlap", "factor"]
        return rows.select(F.col("l").alias("rel_path"), F.col("r").alias("target_path"), F.col("r_title").alias("target_title"), "confidence", *why, "rank")


class _Best:
    """The best pairs of the notes of a block so far, and the bar of each note: what its last of them has, or the threshold."""

    def __init__(self, path: np.ndarray, top: int, least: float):
        self.path, self.top, self.begun = path, top, False
        self.bar, self.scores = np.full(len(path), least), np.full((len(path), top), -np.inf)
        self.kept, self.rows = [_rows([], [], [])], 0

    def raised(self, rows: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The scores of the best after pairs (ordered by row, the best first) were added."""
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        new = np.full(self.scores.shape, -np.inf)
        new[rows[place < self.top], place[place < self.top]] = score[place < self.top]
        return np.sort(np.concatenate([self.scores, new], 1), 1)[:, self.top :]

    def add(self, rows: np.ndarray, paths: np.ndarray, others: np.ndarray, parts: list[np.ndarray]) -> None:
        """others: positions of the paths, in their order."""
        some = np.flatnonzero(parts[-1] >= self.bar[rows])
        some = some[np.lexsort((others[some], -parts[-1][some], rows[some]))]
        r = rows[some]
        some = some[np.arange(len(r)) - np.searchsorted(r, r) < self.top]
        r = rows[some]
        self.scores = self.raised(r, parts[-1][some])
        self.bar = np.maximum(self.bar, self.scores[:, 0])
        self.kept.append(_rows(self.path[r], paths[others[some]], [p[some] for p in parts]))
        self.rows += len(r)
        if self.rows > 3 * self.scores.size:
            self.kept = [_best(pa.concat_tables(self.kept), self.top)]
            self.rows = self.kept[0].num_rows

    def found(self) -> pa.Table:
        return _best(pa.concat_tables(self.kept), self.top)


class _Cells:
    """A value for each pair of a tile, by its place in a table."""

    def __init__(self, values: np.ndarray, cell: np.ndarray):
        self.values, self.cell = values, cell

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.values[self.cell[at]]


class _Tile:
    """Pairs of two blocks. Confidences depend on common terms, sizes, folders and titles, of which few differ, and for few pairs on common links: pairs are judged
    by a table where it stays small, else one by one."""

    def __init__(self, x: _Notes, y: _Notes, c: Scoring, content: np.ndarray | None, steps: np.ndarray | None, same: bool):
        self.x, self.y, self.c, self.content, self.steps, self.same = x, y, c, content, steps, same
        self.shape = len(x.path), len(y.path)
        self.both, self.links, self.title = overlap(x.terms, y.terms), common(x.links, y.links), alike(*(repeated(x.title),) * 2 if same else (x.title, y.title))

    def parts(self, row: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
        both, links = np.zeros(len(row)) if self.both is None else self.both[row, col].astype(np.float64), np.zeros(len(row))
        pair, n = self.links
        if len(pair):
            at = np.minimum(np.searchsorted(pair, row * self.shape[1] + col), len(pair) - 1)
            links = np.where(pair[at] == row * self.shape[1] + col, n[at], 0.0)
        return self._parts(row, col, both, links)

    def _parts(self, row: np.ndarray, col: np.ndarray, both: np.ndarray, links: np.ndarray) -> list[np.ndarray]:
        x, y, c = self.x, self.y, self.c
        raw, link = (np.divide(k, u, out=np.zeros(len(row)), where=u > 0) for k, u in ((both, x.terms.n[row] + y.terms.n[col] - both), (links, x.links.n[row] + y.links.n[col] - links)))
        sim = raw
        if self.content is not None:
            sim = self.content[np.minimum(both.astype(np.int64), self.content.shape[0] - 1), np.minimum(x.terms.n[row] + y.terms.n[col], self.content.shape[1] - 1)]
        title = self.title[row, col]
        factor = np.where(x.folder[row] != y.folder[col], c.penalty, 1.0)
        confidence = np.minimum(np.maximum((sim * c.w_content + title * c.w_title + link * c.w_link) * factor, c.clamp_min), c.clamp_max)
        return [raw, sim, title, link, factor, confidence]

    def at_least(self, least: float) -> tuple[np.ndarray, list[_Cells]]:
        """Which pairs have a confidence of `least` or more, and the parts of any pair."""
        n, m = self.shape
        (rows, row), (cols, col) = distinct(self.x.terms.n, self.x.folder, self.title.row), distinct(self.y.terms.n, self.y.folder, self.title.col)
        top = 1 + int(min(self.x.terms.n.max(initial=0), self.y.terms.n.max(initial=0)))
        if len(rows) * len(cols) * top > _TABLE:
            parts, cell = self._every(), np.arange(n * m).reshape(n, m)
            return parts[-1].reshape(n, m) >= least, [_Cells(p, cell) for p in parts]
        r, c, both = (v.ravel() for v in np.meshgrid(rows, cols, np.arange(top), indexing="ij"))
        parts = self._parts(r, c, both.astype(np.float64), np.zeros(len(r)))
        cell = ((np.arange(len(rows))[:, None] * len(cols) + col[None, :]) * top).astype(np.int32)[row]
        if self.both is not None:
            cell += self.both.astype(np.int32)
        if len(self.links[0]):
            r, c = np.divmod(self.links[0], m)
            cell[r, c] = len(parts[0]) + np.arange(len(r))
            parts = [np.append(p, q) for p, q in zip(parts, self.parts(r, c), strict=True)]
        return (parts[-1] >= least)[cell], [_Cells(p, cell) for p in parts]

    def _every(self) -> list[np.ndarray]:
        """Parts of all pairs, some rows at a time."""
        n, m = self.shape
        step = max(1, _TABLE // max(m, 1))
        some = [self.parts(*np.divmod(np.arange(lo * m, min(lo + step, n) * m), m)) for lo in range(0, n, step)]
        return [np.concatenate(p) for p in zip(*some, strict=True)] or [np.zeros(0)] * len(_NAMES)

    def _least_share(self, bar: np.ndarray, title: np.ndarray, factor: float) -> np.ndarray:
        """Common terms over terms in the two notes together that a pair without common links needs for a bar, a hair less."""
        if factor <= 0:
            return np.full(len(bar), -1.0, np.float32)
        need = (bar / factor - title * self.c.w_title) / self.c.w_content - 1e-9
        raw = need
        if self.steps is not None:
            raw = np.append(self.steps[:, 0], np.inf)[np.searchsorted(self.steps[:, 1], need)]
        raw = np.maximum(raw, 0)
        return (np.where(np.isinf(raw), 2.0, raw / (1 + np.where(np.isinf(raw), 0, raw))) - 1e-5).astype(np.float32)

    def judge(self, mine: _Best, other: _Best) -> None:
        c, n = self.c, self.shape
        if not n[0] or not n[1]:
            return
        loose = min(c.w_content, c.w_title, c.w_link) < 0 or c.w_content == 0 or c.clamp_min >= c.min_related
        if not loose:
            both = np.zeros(n, np.float32) if self.both is None else self.both
            title = self.title.values
            if self.same:
                title = np.array(np.broadcast_to(self.title.full(), n))
                np.fill_diagonal(title, 0.0)
        for axis, best in ((0, mine),) if self.same else ((0, mine), (1, other)):
            if loose:
                at = np.arange(n[0] * n[1])
            else:
                if not best.begun:
                    self._begin(axis, best)
                most = title.max(1 - axis) if self.same else title.max(1 - axis)[self.title.col if axis else self.title.row]
                own, others = (self.y, self.x) if axis else (self.x, self.y)
                far, close = (self._least_share(best.bar, most, f)[:, None] for f in (c.penalty, 1.0))
                first, code = distinct(others.terms.n, others.folder)
                # common terms that a pair needs, by note and sort of the other; where no note has terms it may be less than it should
                least = (np.where(own.folder[:, None] == others.folder[first], close, far) * (own.terms.n[:, None] + others.terms.n[first])).astype(np.float32)
                found = both >= (np.ascontiguousarray(least.T)[code] if axis else least.take(code, axis=1))
                found.ravel()[self.links[0]] = True
                at = np.flatnonzero(found)
            row, col = np.divmod(at, n[1])
            if self.same:
                row, col = row[row != col], col[row != col]
            parts = self.parts(row, col)
            if axis:
                best.add(col, self.x.path, row, parts)
            else:
                best.add(row, self.y.path, col, parts)

    def _begin(self, axis: int, best: _Best) -> None:
        """A first bar, from each note's pairs with a few of the others. These aren't kept, as they are met again."""
        best.begun = True
        some = np.arange(0, self.shape[1 - axis], 16)
        one, two = np.repeat(np.arange(self.shape[axis]), len(some)), np.tile(some, self.shape[axis])
        if self.same:
            one, two = one[one != two], two[one != two]
        score = self.parts(two, one)[-1] if axis else self.parts(one, two)[-1]
        order = np.lexsort((-score, one))
        best.bar = np.maximum(best.bar, best.raised(one[order], score[order])[:, 0])


def _rows(left, right, parts) -> pa.Table:
    values = parts or [[]] * len(_NAMES)
    return pa.table({"l": pa.array(left, pa.string()), "r": pa.array(right, pa.string()), **{n: pa.array(v, pa.float64()) for n, v in zip(_NAMES, values, strict=True)}})


def _best(t: pa.Table, top: int) -> pa.Table:
    """The best rows of each l, ties to the smaller r."""
    t = t.sort_by([("l", "ascending"), ("confidence", "descending"), ("r", "ascending")])
    code = t.column("l").combine_chunks().dictionary_encode().indices.to_numpy() if t.num_rows else np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, np.diff(code) != 0)[: len(code)])
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return t.filter(pc.less(pa.array(place), top))


def pairs(parsed: DataFrame, c: Scoring = Scoring(), least: float | None = None) -> DataFrame:  # noqa: B008
    """AllPairs.pairs(), written once."""
    return saved(AllPairs(parsed, c).pairs(least))


def related(p: DataFrame, c: Scoring = Scoring(), top: int = 3) -> DataFrame:  # noqa: B008
    """rel_path, rank, target_path, target_title, confidence and reason parts: the best suggestions of each note."""
    own = p.where(F.col("confidence") >= c.min_related)
    why = ["raw", "content_sim", "title_sim", "link_overlap", "factor"]
    both = own.select(F.col("l").alias("rel_path"), F.col("r").alias("target_path"), F.col("r_title").alias("target_title"), "confidence", *why).unionByName(
        own.select(F.col("r").alias("rel_path"), F.col("l").alias("target_path"), F.col("l_title").alias("target_title"), "confidence", *why)
    )
    best = W.partitionBy("rel_path").orderBy(F.desc("confidence"), "target_path")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def reason(c: Scoring = Scoring()) -> Column:  # noqa: B008
    """Reason of a suggestion row: parts to three digits, weights, normaliser and filter texts."""
    r = lambda x: round_half_even(F.col(x)).alias(x)
    return F.struct(
        r("content_sim"), r("title_sim"), r("link_overlap"), F.when(F.col("factor") < 1, F.array(F.format_string("path_penalty=%.2f", "factor"))).otherwise(F.array().cast("array<string>")).alias("filters"),
        F.struct(F.lit(c.w_content).alias("content"), F.lit(c.w_title).alias("title"), F.lit(c.w_link).alias("link")).alias("weights"), F.lit(c.norm).alias("norm_method"), round_half_even(F.col("raw")).alias("raw_content_sim"),
    )


def related_blocks(rel: DataFrame) -> DataFrame:
    """rel_path, confidence, markdown_block of notes with suggestions."""
    line = F.format_string("- [[%s]] (%.2f)", "target_title", round_half_even(F.col("confidence"), 2))
    rows = rel.groupBy("rel_path").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return rows.select("rel_path", "confidence", F.concat(F.lit(f"## Related\n<!-- {ANCHOR} -->\n"), F.array_join(F.transform("x", lambda v: v["line"]), "\n"), F.lit("\n")).alias("markdown_block"))


def metadata(parsed: DataFrame, rel: DataFrame, c: Scoring = Scoring()) -> DataFrame:  # noqa: B008
    """rel_path, keywords, aliases, related (null where present or underivable), confidence: the best suggestion's, else 0.25."""
    rows = rel.groupBy("rel_path").agg(F.max("confidence").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_title"))), lambda v: v["target_title"]).alias("titles"))
    d = parsed.select("rel_path", "title", "frontmatter", "top_terms").join(rows, "rel_path", "left")
    words = F.slice(F.array_sort("top_terms"), 1, 3)
    alias = F.when(F.col("title").rlike("[-_]"), F.array(F.translate("title", "-_", "  ")))
    out = d.select(
        "rel_path", F.when(F.col("frontmatter.keywords").isNull() & (F.size(words) > 0), words).alias("keywords"), F.when(F.col("frontmatter.aliases").isNull(), alias).alias("aliases"),
        F.when(F.col("frontmatter.related").isNull() & (F.size("titles") > 0), F.col("titles")).alias("related"), F.coalesce("best", F.lit(0.25)).alias("confidence"),
    )
    return out.where("keywords is not null or aliases is not null or related is not null")


def low_confidence(meta: DataFrame, rel: DataFrame, c: Scoring = Scoring()) -> DataFrame:  # noqa: B008
    low = F.count_if(F.col("confidence") < c.low)
    return meta.agg(low.alias("a")).join(F.broadcast(rel.agg(low.alias("b")))).select((F.col("a") + F.col("b")).alias("low_confidence"))


def merges(p: DataFrame | AllPairs, c: Scoring = Scoring()) -> DataFrame:  # noqa: B008
    """component, candidates (by path), average_confidence of the edges, of clusters of two or more notes. Of all pairs under a scoring, none becomes a row."""
    if isinstance(p, AllPairs):
        return p.merges()
    e = p.where(F.col("confidence") >= c.merge).select(F.col("l").alias("u"), F.col("r").alias("v"), F.col("confidence").alias("total"), F.lit(1).alias("pairs"))
    return _clusters(components(e), e)


def _clusters(comp: DataFrame, e: DataFrame) -> DataFrame:
    """The clusters of merges(). e: u, and the sum and number of the edges counted at it."""
    sums = e.join(comp, F.col("u") == F.col("node")).groupBy("component").agg((F.sum("total") / F.sum("pairs")).alias("m"))
    members = comp.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("candidates"))
    return members.join(sums, "component").select("component", "candidates", round_half_even(F.col("m")).alias("average_confidence"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with number (from 1) in the given order: a range sort, and the count of the partitions before each one."""
    placed = saved(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    start = placed.groupBy("_p").agg(F.count("*").alias("n")).select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # The lower 33 bits of the id count the rows of a partition in their order.
    at = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(start), "_p").withColumn("number", F.col("start") + at + 1).drop("_p", "_i", "start")


def plan(broken: DataFrame, rel: DataFrame, meta: DataFrame, merged: DataFrame, with_key: bool = False) -> DataFrame:
    """Numbered actions: at most five stubs by target, related sections, metadata, merge previews. with_key: with key and number."""
    stub_path = F.when(F.lower("target").endswith(".md"), F.col("target")).otherwise(F.concat("target", F.lit(".md")))
    row = lambda d, part, key, kind, risk, path, conf: d.select(
        F.lit(part).alias("part"), F.col(key).alias("key"), F.lit(kind).alias("type"), F.lit(risk).alias("risk_class"), path.alias("target_path"), conf.alias("confidence")
    )
    items = (
        row(broken.orderBy("target").limit(5), 1, "target", "create_stub_note", "A", stub_path, F.lit(0.2))
        .unionByName(row(related_blocks(rel), 2, "rel_path", "append_related_links_section", "A", F.col("rel_path"), F.col("confidence")))
        .unionByName(row(meta, 3, "rel_path", "add_frontmatter_fields", "read-only", F.col("rel_path"), F.col("confidence")))
        .unionByName(row(merged, 4, "component", "merge_preview", "read-only", F.lit("merge-preview"), F.col("average_confidence")))
    )
    out = numbered(items, "part", "key").withColumn("id", F.format_string("act_%04d", "number"))
    return out.select("id", "type", "risk_class", "target_path", "confidence", *(["key", "number"] if with_key else []))
