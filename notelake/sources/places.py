"""Where vaults lie: local folders and the stores that Arrow's file systems reach (s3, gs, abfs, hdfs), by the scheme of the root."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow.fs as pfs

#: name, whether it is a folder, time of change (seconds) and size; None where they have to be asked for.
Entry = tuple[str, bool, float | None, int | None]


class Local:
    """A folder that this machine sees. Links to folders aren't followed."""

    def __init__(self, root: str):
        self.root = root

    def listed(self, folder: str) -> Iterator[Entry]:
        with os.scandir(os.path.join(self.root, folder)) as entries:
            for e in entries:
                yield e.name, e.is_dir(follow_symlinks=False), None, None

    def stat(self, path: str) -> tuple[float, int]:
        st = os.stat(os.path.join(self.root, path))
        return float(st.st_mtime), st.st_size

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as f:
            return f.read()


class Store:
    """A folder of an Arrow file system; times and sizes come with the listing."""

    def __init__(self, files: pfs.FileSystem, root: str):
        self.files, self.root = files, root.rstrip("/")

    def _at(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def listed(self, folder: str) -> Iterator[Entry]:
        for i in self.files.get_file_info(pfs.FileSelector(self._at(folder))):
            if i.type != pfs.FileType.NotFound:
                yield i.base_name, i.type == pfs.FileType.Directory, None if i.mtime_ns is None else i.mtime_ns / 1e9, i.size

    def stat(self, path: str) -> tuple[float, int]:
        i = self.files.get_file_info(self._at(path))
        if i.type != pfs.FileType.File:
            raise FileNotFoundError(path)
        return (i.mtime_ns or 0) / 1e9, i.size

    def read(self, path: str) -> bytes:
        with self.files.open_input_stream(self._at(path)) as f:
            return f.read()


def place_of(root: str) -> Local | Store:
    if "://" not in root and not root.startswith("file:"):
        return Local(root)
    if urlparse(root).scheme == "file":
        return Local(unquote(urlparse(root).path))
    return Store(*pfs.FileSystem.from_uri(root))
