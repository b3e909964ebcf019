"""A stream source of the changes of a vault.

Each trigger compares the vault with what the source knows: folders whose time is unchanged aren't listed, only their known files are asked for
their times, and nothing is opened. What has changed is written as a numbered entry of a log; an offset is the number of an entry, so a batch can
be read again after a crash, and a restart goes on from the log without listing the vault. Every so many entries what is known is written whole,
and entries that batches are done with are deleted.

The log lies in a folder that all executors see, as the vault does. Names that end in a batch and a name that comes back later are events of their own;
within one entry a path has one event. A folder that can't be read counts as unchanged.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHANGES = "vault string, root string, rel_path string, mtime double, length long, readable boolean, change string, number long"
#: Events of a task, entries between two whole states, and how old (ns) a folder's time must be to tell that nothing came after the listing.
PART, WHOLE, SETTLED = 10_000, 100, 2_000_000_000


class _Part(InputPartition):
    def __init__(self, number: int, start: int, end: int):
        self.number, self.start, self.end = number, start, end


class ChangeReader(DataSourceStreamReader):
    """known: folder -> [time, whether it was settled when listed, subfolders, {name: [mtime, size]}]."""

    def __init__(self, options: dict):
        self.root, self.log = options["path"], options["log"]
        self.pruned = set(filter(None, options.get("pruned", ".obsidian").split(",")))
        self.known: dict[str, list] | None = None
        self.number = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}  # tasks need the log only

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.known is None:
            self._restore()
        events, folders = self._poll()
        if events or folders:
            self._write(self.number + 1, {"events": events, "folders": folders})
            self.number += 1
        return {"n": self.number}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        out = []
        for k in range(start["n"] + 1, end["n"] + 1):
            n = len(self._read(k)["events"])
            out += [_Part(k, at, min(at + PART, n)) for at in range(0, n, PART)]
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        vault = os.path.basename(os.path.abspath(self.root))
        for path, change, mtime, size in self._read(part.number)["events"][part.start : part.end]:
            yield vault, self.root, path, mtime, size, change != "unreadable", "updated" if change == "unreadable" else change, part.number

    def commit(self, end: dict) -> None:
        whole = self._numbers("known")
        if self.known is not None and self.number - (whole[-1] if whole else 0) >= WHOLE:
            self._write(self.number, self.known, "known")
            whole.append(self.number)
        for k in self._numbers("entry"):
            if whole and k <= min(whole[-1], end["n"]):
                os.unlink(self._path(k))
        for k in whole[:-1]:
            os.unlink(self._path(k, "known"))

    def _path(self, n: int, kind: str = "entry") -> str:
        return os.path.join(self.log, f"{kind}-{n:012}.json")

    def _numbers(self, kind: str) -> list[int]:
        names = os.listdir(self.log) if os.path.isdir(self.log) else []
        return sorted(int(n[len(kind) + 1 : -5]) for n in names if n.startswith(f"{kind}-") and n.endswith(".json"))

    def _read(self, n: int, kind: str = "entry") -> dict:
        with open(self._path(n, kind), encoding="utf-8") as f:
            return json.load(f)

    def _write(self, n: int, what: dict, kind: str = "entry") -> None:
        os.makedirs(self.log, exist_ok=True)
        tmp = f"{self._path(n, kind)}.tmp"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(what, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, self._path(n, kind))

    def _restore(self) -> None:
        whole = self._numbers("known")
        self.known = self._read(whole[-1], "known") if whole else {}
        self.number = whole[-1] if whole else 0
        for k in self._numbers("entry"):
            if k > self.number:
                entry = self._read(k)
                self._apply(entry["folders"], entry["events"])
                self.number = k

    def _apply(self, folders: dict, events: list) -> None:
        """Brings known up to date: folders that were listed (None: gone), and changes of their files."""
        for folder, row in folders.items():
            if row is None:
                self.known.pop(folder, None)
            else:
                self.known[folder] = [*row, self.known.get(folder, [0, 0, 0, {}])[3]]
        for path, change, mtime, size in events:
            folder, _, name = path.rpartition("/")
            if folder in self.known:
                files = self.known[folder][3]
                if change == "removed":
                    files.pop(name, None)
                else:
                    files[name] = [mtime, size]

    def _stat(self, path: str) -> list | None:
        """Time and size, [None, None] where they can't be read, None where there is no such file."""
        try:
            st = os.stat(os.path.join(self.root, path))
            return [st.st_mtime, st.st_size]
        except FileNotFoundError:
            return None
        except OSError:
            return [None, None]

    def _poll(self) -> tuple[list, dict]:
        events, folders, seen, left = [], {}, set(), [""]
        while left:
            folder = left.pop()
            try:
                at = os.stat(os.path.join(self.root, folder)).st_mtime_ns
            except FileNotFoundError:
                continue
            except OSError:
                at = None
            row = self.known.get(folder)
            had = row[3] if row else {}
            if at is None and row is None:
                continue
            seen.add(folder)
            if at is None or row is not None and row[0] == at and row[1]:
                subfolders, names = row[2], had
            else:
                try:
                    subfolders, names = self._listed(folder)
                except OSError:
                    if row is not None:
                        left += [self._join(folder, s) for s in row[2]]
                    continue
                settled = time.time_ns() - at > SETTLED
                if row is None or row[:3] != [at, settled, subfolders]:
                    folders[folder] = [at, settled, subfolders]
            for name in sorted({*names, *had}):
                path = self._join(folder, name)
                now = self._stat(path) if name in names else None
                if now is None:
                    if name in had:
                        events.append([path, "removed", None, None])
                elif name not in had:
                    events.append([path, "added" if now[0] is not None else "unreadable", *now])
                elif now != had[name]:
                    events.append([path, "updated" if now[0] is not None else "unreadable", *now])
            left += [self._join(folder, s) for s in subfolders]
        for folder in sorted(self.known.keys() - seen):
            folders[folder] = None
            events += [[self._join(folder, name), "removed", None, None] for name in sorted(self.known[folder][3])]
        self._apply(folders, events)
        return events, folders

    def _join(self, folder: str, name: str) -> str:
        return f"{folder}/{name}" if folder else name

    def _listed(self, folder: str) -> tuple[list[str], set[str]]:
        subfolders, names = [], set()
        for e in os.scandir(os.path.join(self.root, folder)):
            if e.is_dir(follow_symlinks=False):
                subfolders += [e.name] if e.name not in self.pruned else []
            else:
                names.add(e.name)
        return sorted(subfolders), names


class ChangeSource(DataSource):
    """readStream.format("vault_changes"): options path (the vault), log (folder of the source's log), pruned (directory names)."""

    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangeReader:  # noqa: N802
        return ChangeReader(self.options)
