import random

import numpy as np
import pyarrow as pa

from notelake.operators import recommend, tiles


def sets(rows):
    return tiles.Sets.of(pa.chunked_array([pa.array(rows, pa.list_(pa.int64()))]))


def notes(rnd, names):
    some = lambda k, most: [rnd.sample(range(k), rnd.randint(0, most)) for _ in names]
    columns = {"terms": some(14, 6), "title": [[-1] if i % 3 else [-1, i] for i in range(len(names))], "links": some(40, 2)}
    lists = {k: pa.array(v, pa.list_(pa.int64())) for k, v in columns.items()}
    return recommend._Notes(pa.table({"path": pa.array(names), "folder": pa.array([rnd.randrange(3) for _ in names]), **lists}))


def test_a_tile_is_judged_by_a_table(monkeypatch):
    """Pairs without common links are looked up, and have the parts and sums that they have one by one."""
    rnd, judged, parts = random.Random(4), [], recommend._Tile.parts
    x, y = notes(rnd, [f"a{i:03}" for i in range(120)]), notes(rnd, [f"b{i:03}" for i in range(90)])
    monkeypatch.setattr(recommend._Tile, "parts", lambda self, row, col: judged.append(len(row)) or parts(self, row, col))
    for a, b in ((x, y), (x, x)):
        tile = recommend._Tile(a, b, recommend.Scoring(), None, None, a is b)
        n, m = tile.shape
        every = np.divmod(np.arange(n * m), m)
        want = parts(tile, *every)
        for table in (1 << 20, 10):
            monkeypatch.setattr(recommend, "_TABLE", table)
            judged.clear()
            found, got = tile.at_least(0.3)
            assert table == 10 or sum(judged) == len(tile.links[0]) < n * m // 3
            assert 0 < found.sum() < n * m and np.array_equal(found.ravel(), want[-1] >= 0.3)
            assert all(np.array_equal(g[every], w) for g, w in zip(got, want, strict=True))


def test_a_unit_holds_few_blocks():
    """However many blocks a unit has, a few are unpacked at once, and each pair of them meets once."""
    import weakref

    class Held:
        alive, most = 0, 0

        def __init__(self, t):
            self.b = t.column("b")[0].as_py()
            Held.alive += 1
            Held.most = max(Held.most, Held.alive)
            weakref.finalize(self, lambda: setattr(Held, "alive", Held.alive - 1))

    pack = lambda numbers: tiles.Packs(numbers, [pa.py_buffer(tiles.packed(pa.table({"b": [b]}))) for b in numbers])
    for lefts, rights in ((range(30), range(30)), (range(20), range(20, 50))):
        met = [(a, b) for (a, x), (b, y) in tiles.tiles(pack(list(lefts)), pack(list(rights)), Held) if (x.b, y.b) == (a, b)]
        assert sorted(met) == [(a, b) for a in lefts for b in rights if a <= b]
        assert Held.most <= 2 * tiles._HELD + 2


def test_stars_meet_each_note_once():
    rnd = np.random.default_rng(1)
    for n, m, same in ((30, 40, False), (35, 35, True), (5, 0, False), (0, 5, False)):
        found = rnd.random((n, m)) < 0.03
        found = np.triu(found, 1) if same else found
        want = np.arange(n if same else n + m)
        for _ in want:
            for i, j in zip(*np.nonzero(found)):
                k = j if same else n + j
                want[i] = want[k] = min(want[i], want[k])
        row, col = tiles.stars(found, same)
        assert np.array_equal(row, want[:n]) and np.array_equal(col, want if same else want[n:])


def test_packed_metadata_is_small():
    """Lists of words and weights in the metadata are compressed as well."""
    t = pa.table({"a": [1]}).replace_schema_metadata({b"idf": np.zeros(10_000).tobytes()})
    data = tiles.packed(t)
    assert len(data) < 8_000 and tiles.unpacked(data).equals(t, check_metadata=True)
