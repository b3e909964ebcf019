"""Control plane of a vault, on the driver: configuration, lock files, git policy, quiet window, stored runs."""

from __future__ import annotations

import json
import shutil
import subprocess
import time
import tomllib
import zipfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from .recommend import Scoring
from .runs import retention

TEMPLATE = {
    "i18n": {"language": "en"},
    "storage": {"reports_dir": "reports", "max_run_logs": 50, "max_run_days": 30, "max_total_mb": 200, "compress_runs": False, "auto_prune": True},
    "apply": {"max_wait_sec": 30, "offline_lock_marker": ".nosync", "offline_lock_cleanup": True},
    "apply.git": {"policy": "require_clean", "auto_commit": False},
    "performance": {"max_mem_mb": 0, "timeout_sec": 0.0, "top_terms": 30, "fast_path_max_age_sec": 10},
    "scan": {"max_file_mb": 5, "sleep_ms": 0, "max_files_per_sec": 0},
    "scoring": {"model": "quantile", "clamp_min": 0.0, "clamp_max": 1.0, "w_content": 0.6, "w_title": 0.3, "w_link": 0.1, "min_related_confidence": 0.3, "merge_confidence": 0.85, "low_confidence": 0.45},
    "filters": {"path_penalty": 0.9},
}


def write_template(path: str) -> bool:
    """Writes the default configuration unless the file exists. The values equal the defaults, so writing it changes no result."""
    if Path(path).exists():
        return False
    text = "\n".join(f"[{part}]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in keys.items()) for part, keys in TEMPLATE.items())
    Path(path).write_text(text, encoding="utf-8")
    return True


def load_config(path: str | None, root: str | None = None) -> dict:
    """The first of the vault's own file (the name of `path` below root) and the file at path that exists, whole; {} where there is none."""
    places = [Path(root) / Path(path).name] if path and root else []
    for p in [*places, *([Path(path)] if path else [])]:
        if p.is_file():
            return tomllib.loads(p.read_text(encoding="utf-8"))
    return {}


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE of the export lines of a shell file, quotes removed; {} where there is none."""
    out, p = {}, Path(path)
    for line in p.read_text(encoding="utf-8").splitlines() if p.is_file() else []:
        head, eq, value = line.strip().removeprefix("export ").partition("=")
        if line.strip().startswith("export ") and eq:
            out[head.strip()] = value.strip().strip('"').strip("'")
    return out


def typed(value, default):
    """value as the type of the default, which stands in where it can't be read: true, yes, on and 1 are true."""
    if isinstance(default, bool):
        return value if isinstance(value, bool) else value.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, str) else bool(value) if isinstance(value, int | float) else default
    if isinstance(default, int | float):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return default
        return int(number) if isinstance(default, int) and number == int(number) else number
    return default if value is None else str(value)


def setting(config: dict, part: str, key: str):
    """A key of the configuration (parts may be dotted), of the default's type, or the default."""
    at = config
    for name in part.split("."):
        at = at.get(name, {}) if isinstance(at, dict) else {}
    default = TEMPLATE[part][key]
    return typed(at.get(key, default), default) if isinstance(at, dict) else default


def scoring_of(config: dict) -> Scoring:
    get = lambda key: setting(config, "scoring", key)
    return Scoring(
        w_content=get("w_content"), w_title=get("w_title"), w_link=get("w_link"), clamp_min=get("clamp_min"), clamp_max=get("clamp_max"), min_related=get("min_related_confidence"),
        merge=get("merge_confidence"), low=get("low_confidence"), penalty=setting(config, "filters", "path_penalty"), norm=get("model"),
    )


def _when(value: object) -> datetime | None:
    try:
        at = datetime.fromisoformat(str(value))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def check_lock(path: str, now: datetime | None = None) -> dict:
    """Whether a lock file is there and stale: by its expiry, else by creation and time to live; stale is None where neither is given."""
    now, p = now or datetime.now(UTC), Path(path)
    out = {"name": p.name, "path": str(p), "present": p.exists(), "stale": None, "details": "missing"}
    if not out["present"]:
        return out
    try:
        data = json.loads(p.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return out | {"details": "unreadable"}
    data = data if isinstance(data, dict) else {}
    either = lambda a, b: data.get(a) or data.get(b)
    if (end := either("expires_at", "expiresAt")) and (at := _when(end)):
        return out | {"stale": at < now, "details": "expires_at"}
    born, ttl = _when(either("created_at", "createdAt")), str(either("ttl_sec", "ttlSec") or "")
    if born and ttl.isdigit():
        return out | {"stale": (now - born).total_seconds() > int(ttl), "details": "created_at+ttl"}
    return out | {"details": "unknown"}


def git(root: str, *args: str) -> str | None:
    """Output of a git command, None where git or the repository is missing or the command fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


class GitPolicy:
    """require_clean refuses a dirty tree (code 10), auto_stash sets its changes aside and brings them back (code 20 where that fails), others let it be."""

    def __init__(self, root: str, policy: str = "require_clean", auto_commit: bool = False):
        self.root, self.policy, self.auto_commit, self.stashed = root, policy, auto_commit, False

    def before(self) -> int:
        dirty = (git(self.root, "status", "--porcelain") or "").strip()
        if not dirty:
            return 0
        if self.policy == "require_clean":
            return 10
        if self.policy == "auto_stash":
            self.stashed = git(self.root, "stash", "push", "--include-untracked", "-m", "before apply") is not None
            return 0 if self.stashed else 20
        return 0

    def after(self, paths: list[str], message: str) -> int:
        if self.auto_commit and paths and git(self.root, "add", "-A", "--", *paths) is not None:
            git(self.root, "commit", "-m", message, "--", *paths)
        return 20 if self.stashed and git(self.root, "stash", "pop") is None else 0


def wait_quiet(root: str, quiet: float = 3, most: float = 30, pause: float = 0.5) -> bool:
    """Waits until nothing below .obsidian changed for `quiet` seconds; True at once without that folder, False after `most` seconds."""
    base, end = Path(root) / ".obsidian", time.time() + most
    while base.exists():
        newest = max((p.stat().st_mtime for p in base.rglob("*") if p.is_file()), default=0.0)
        if time.time() - newest >= quiet:
            return True
        if time.time() >= end:
            return False
        time.sleep(pause)
    return True


def list_runs(folder: str) -> list[tuple[str, float, int]]:
    """(run_id, mtime, bytes) of run folders and archives, newest change of each."""
    out = []
    for p in sorted(Path(folder).iterdir()) if Path(folder).exists() else []:
        files = [f for f in p.rglob("*") if f.is_file()] if p.is_dir() else [p] if p.suffix in (".zip", ".json") else []
        if p.is_dir() or files:
            out.append((p.name, max([p.stat().st_mtime, *(f.stat().st_mtime for f in files)]) if files else p.stat().st_mtime, sum(f.stat().st_size for f in files)))
    return out


def prune(spark: SparkSession, folder: str, config: dict | None = None, now: float | None = None, compress_after: float = 7 * 86400) -> dict:
    """Removes runs beyond age, count and size, packs old folders where asked, and tells the sizes in MB before and after."""
    config, now, found = config or {}, time.time() if now is None else now, list_runs(folder)
    none = {"removed": 0, "compressed": 0, "before_mb": 0.0, "after_mb": 0.0}
    get = lambda key: setting(config, "storage", key)
    if not found or not get("auto_prune"):
        return none
    runs = spark.createDataFrame(found, "run_id string, mtime double, size long")
    kept = retention(runs, now, get("max_run_days") * 86400 or None, get("max_run_logs") or None, get("max_total_mb") * 1024 * 1024 or None)
    gone = [r.run_id for r in kept.where("not keep").collect()]  # run names of one vault
    for name in gone:
        p = Path(folder) / name
        shutil.rmtree(p, ignore_errors=True) if p.is_dir() else p.unlink(missing_ok=True)
    packed = 0
    for name, at, _ in list_runs(folder) if get("compress_runs") else []:
        p = Path(folder) / name
        if p.is_dir() and at < now - compress_after:
            with zipfile.ZipFile(p.with_suffix(".zip"), "w", zipfile.ZIP_DEFLATED) as z:
                for f in sorted(x for x in p.rglob("*") if x.is_file()):
                    z.write(f, f.relative_to(p).as_posix())
            shutil.rmtree(p)
            packed += 1
    mb = lambda runs: round(sum(r[2] for r in runs) / 1048576, 2)
    return {"removed": len(gone), "compressed": packed, "before_mb": mb(found), "after_mb": mb(list_runs(folder))}
