"""Scans: each folder once, work shared over deep trees, vaults by scheme and in other stores."""

import os

import pyarrow.fs as pfs
import pytest

from notelake.operators import parse
from notelake.sources import places, vault


@pytest.fixture
def root(tmp_path):
    for p in ["a.md", "x/b.md", "x/y/c.md", "_h/.d.md", ".obsidian/no.md", *[f"deep/{'/'.join('nested'[:k])}/n{k}.md" for k in range(1, 7)], *[f"f{i}/g{j}/{i}{j}.md" for i in range(4) for j in range(4)]]:
        (tmp_path / "v" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / p).write_text(f"text of {p} [[a]]")
    return tmp_path / "v"


def counting():
    """Made here, so that it goes to tasks by value."""

    class Counting(places.Local):
        """Says in a file which folders were listed."""

        def listed(self, folder):
            with open(f"{self.root}-listed", "a", encoding="utf-8") as f:
                f.write(folder + "\n")
            return super().listed(folder)

    return Counting


def names(files):
    return sorted(r.rel_path for r in files.collect())


def on_disk(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) if ".obsidian" not in d for f in fs)


@pytest.mark.parametrize("share", [1, 5, 64])
def test_each_folder_is_listed_once(spark, root, share):
    files = vault.scan(spark, str(root), places=counting(), share=share)
    assert names(files) == on_disk(root)
    with open(f"{root}-listed", encoding="utf-8") as f:
        listed = f.read().split("\n")[:-1]
    assert sorted(listed) == sorted({os.path.dirname(p) for p in on_disk(root)} | {"", "f0", "f1", "f2", "f3", "deep"})
    st = os.stat(root / "a.md")
    row = files.where("rel_path = 'a.md'").first()
    assert (row.vault, row.mtime, row.length, row.readable, row.skipped) == ("v", st.st_mtime, st.st_size, True, None)


def test_vaults_by_scheme(spark, root):
    """The same notes through a path, a file: URI, and a store of Arrow's file systems."""
    below = str(root.parent)

    def store(uri):
        return places.Store(pfs.SubTreeFileSystem(below, pfs.LocalFileSystem()), uri.removeprefix("vaults://"))

    found = []
    for at, opened in ((str(root), places.place_of), (f"file://{root}", places.place_of), ("vaults://v", store)):
        notes = parse.parse_v2(vault.notes_of(vault.scan(spark, at, places=opened, share=3), opened))
        found.append(sorted((r.vault, r.rel_path, r.title, r.size, round(r.mtime, 3), r.sha256, tuple(r.links)) for r in notes.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(on_disk(root))


def test_an_arrow_scheme(spark, root):
    """A root by a scheme that Arrow knows."""
    store = places.place_of("mock:///")
    assert isinstance(store, places.Store) and list(store.listed("")) == []
    with pytest.raises(FileNotFoundError):
        store.stat("none")


def test_missing_and_empty_roots(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert vault.scan(spark, str(tmp_path / "e"), str(tmp_path / "none")).count() == 0


def test_gone_between_listing_and_asking(spark, root):
    class Losing(places.Local):
        def stat(self, path):
            if path == "a.md":
                raise FileNotFoundError(path)
            return super().stat(path)

    row = vault.scan(spark, str(root), places=Losing).where("rel_path = 'a.md'").first()
    assert (row.readable, row.skipped) == (False, "no_permission")
