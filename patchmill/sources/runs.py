"""Run bookkeeping on the driver: queues, markers, growing metric logs, run folders, formats. All tiny."""

from __future__ import annotations

import csv
import json
import os
import re
import subprocess
import sys
import tempfile
import time
from dataclasses import dataclass, fields
from datetime import UTC, datetime
from pathlib import Path

from patchmill.errors import ConfigError, DataError


def load_queue(path: str) -> dict:
    """A queue of runs, checked: names unique and not empty, modules given, arguments by name."""
    try:
        q = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise DataError(f"cannot read queue {path}: {e}") from e
    runs = q.get("runs") if isinstance(q, dict) else None
    if not isinstance(runs, list) or not runs:
        raise ConfigError("a queue needs a list of runs that is not empty")
    wrong, names = [], []
    for i, r in enumerate(runs):
        if not isinstance(r, dict):
            wrong.append(f"run {i} is no object")
            continue
        wrong += [f"run {i}: no {k}" for k in ("name", "module") if not isinstance(r.get(k), str) or not r[k]]
        wrong += [f"run {i}: args is no object"] * (not isinstance(r.get("args", {}), dict))
        names.append(r.get("name"))
    wrong += [f"name {n!r} comes {names.count(n)} times" for n in sorted({n for n in names if n and names.count(n) > 1})]
    if not isinstance(q.get("base_args", {}), dict):
        wrong.append("base_args is no object")
    if wrong:
        raise ConfigError("; ".join(wrong))
    return q


def merged_args(entry: dict, base: dict, root: str) -> dict:
    """Arguments of a run over the common ones, with ``{run_root}`` filled in and a checkpoint folder of its own."""
    fill = lambda v: v.replace("{run_root}", root) if isinstance(v, str) else [fill(x) for x in v] if isinstance(v, list) else v
    return {"checkpoint_root": os.path.join(root, entry["name"])} | {k: fill(v) for k, v in (base | entry.get("args", {})).items()}


def command_line(args: dict) -> list[str]:
    """Arguments as flags: true as a bare flag, false and None left out, lists spread."""
    out: list[str] = []
    for k, v in args.items():
        if v is False or v is None:
            continue
        out += [f"--{k}", *([] if v is True else map(str, v) if isinstance(v, list) else [str(v)])]
    return out


def write_marker(path: str, payload: dict) -> None:
    """A JSON file that is whole or not there."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=Path(path).parent)
    with os.fdopen(fd, "w") as f:
        json.dump(payload, f)
    os.replace(tmp, path)


def read_marker(path: str) -> dict | None:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


def to_run(queue: dict, markers: str, force: set[str] = frozenset()) -> list[str]:
    """Names not yet done (exit code 0), and those forced; unknown forced names are an error."""
    names = [r["name"] for r in queue["runs"]]
    if unknown := sorted(force - set(names)):
        raise ConfigError(f"no such runs: {unknown}")
    return [n for n in names if n in force or (read_marker(os.path.join(markers, f"{n}.json")) or {}).get("exit_code") != 0]


class MetricLog:
    """A CSV of rows whose columns may grow; older rows are then blank there."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def append(self, **row) -> None:
        old, names = [], []
        if self.path.exists():
            with self.path.open(newline="") as f:
                r = csv.DictReader(f)
                names = list(r.fieldnames or [])
                new = [k for k in row if k not in names]
                old = list(r) if new else []
        else:
            new = list(row)
        cell = {k: "" if v is None else v for k, v in row.items()}
        if new:
            tmp = self.path.with_suffix(".tmp")
            with tmp.open("w", newline="") as f:
                w = csv.DictWriter(f, names + new, restval="")
                w.writeheader()
                w.writerows([*old, cell])
            os.replace(tmp, self.path)
        else:
            with self.path.open("a", newline="") as f:
                csv.DictWriter(f, names, restval="").writerow(cell)

    def last(self) -> dict:
        if not self.path.exists():
            return {}
        with self.path.open(newline="") as f:
            rows = list(csv.DictReader(f))
        return rows[-1] if rows else {}


def safe_name(s: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", s).strip("_") or "run"


@dataclass(frozen=True)
class RunDir:
    root: Path
    logs: Path
    checkpoints: Path
    manifest: Path


def run_dir(root: str, name: str, role: str = "run", stamp: str | None = None) -> RunDir:
    """Folders of a run, with a manifest; a given stamp goes on with the same run."""
    at = Path(root) / safe_name(role) / f"{safe_name(name)}_{stamp or datetime.now(UTC).strftime('%Y%m%d_%H%M%S')}"
    d = RunDir(at, at / "logs", at / "checkpoints", at / "manifest.json")
    for p in (d.logs, d.checkpoints):
        p.mkdir(parents=True, exist_ok=True)
    if not d.manifest.exists():
        write_marker(str(d.manifest), {"name": name, "role": role, "created": datetime.now(UTC).isoformat()})
    return d


def find_latest(folder: str, patterns: tuple[str, ...] = ("*.pt", "*.ckpt")) -> str | None:
    """The newest file of any pattern."""
    found = [p for g in patterns for p in Path(folder).glob(g)]
    return str(max(found, key=lambda p: (p.stat().st_mtime, str(p)))) if found else None


# Fixed value: metric names that end in this are shown with three decimals, all others with four.
THREE_DECIMALS = "_rate"


def shown(name: str, value) -> str:
    """A metric as text: whole numbers stay whole, NaN reads nan."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.{3 if name.endswith(THREE_DECIMALS) else 4}f}"
    return str(value)


def metric_row(tag: str, **fields) -> str:
    return " ".join([tag, *(f"{k}={shown(k, v)}" for k, v in fields.items())])


def first_given(*values: str | None) -> str | None:
    """Override, argument, environment: the first that is neither None nor empty."""
    return next((v for v in values if v), None)


# What each dataset's folder is called as an argument, and the environment variable that stands in for it.
DATA_FOLDERS = {"imd_root": "IMD_ROOT", "casia_root": "CASIA_ROOT", "indoor_root": "INDOOR_ROOT", "glide_root": "GLIDE_ROOT", "anyedit_root": "ANYEDIT_ROOT", "bfree_root": "BFREE_ROOT", "tgif_root": "TGIF_ROOT"}


@dataclass(frozen=True)
class DataPaths:
    """The folder of each dataset, None where none was given; where each came from is told by ``origin``."""

    paths: dict[str, str | None]
    origin: dict[str, str]

    def need(self, *names: str) -> list[str]:
        if missing := [n for n in names if not self.paths.get(n)]:
            raise ConfigError(f"no folder given for {missing}")
        return [self.paths[n] for n in names]


def data_paths(args: dict[str, str | None] | None = None, defaults: dict[str, str] | None = None, environ: dict[str, str] | None = None) -> DataPaths:
    """Folders by argument, else by environment, else by default; empty strings count as not given, ``~`` is the home folder."""
    env = os.environ if environ is None else environ
    paths, origin = {}, {}
    for name, var in DATA_FOLDERS.items():
        for where, value in (("argument", (args or {}).get(name)), ("environment", env.get(var)), ("default", (defaults or {}).get(name))):
            if value:
                paths[name], origin[name] = os.path.expanduser(value), where
                break
        else:
            paths[name], origin[name] = None, "none"
    return DataPaths(paths, origin)


@dataclass(frozen=True)
class RunConfig:
    """What a run over items is told; faults are all named at once."""

    side: int = 448
    patch: int = 16
    batch: int = 8
    epochs: int = 1
    val_frac: float = 0.1
    seed: int = 42
    decode: str = "kmeans"
    eval_mode: str = "none"

    def __post_init__(self) -> None:
        wrong = [f"{n} must be at least 1" for n in ("side", "patch", "batch", "epochs") if getattr(self, n) < 1]
        wrong += ["side must be a whole number of patches"] * (self.patch > 0 and self.side % self.patch != 0)
        wrong += ["val_frac must lie between 0 and 1"] * (not 0 < self.val_frac < 1)
        wrong += [f"unknown decode {self.decode!r}"] * (self.decode not in ("kmeans", "graph"))
        if wrong:
            raise ConfigError("; ".join(wrong))

    @classmethod
    def of(cls, args: dict) -> RunConfig:
        known = {f.name: f.type for f in fields(cls)}
        if unknown := sorted(set(args) - set(known)):
            raise ConfigError(f"unknown settings {unknown}")
        cast = {"int": int, "float": float, "str": str}
        try:
            return cls(**{k: cast[known[k]](v) for k, v in args.items()})
        except ValueError as e:
            raise ConfigError(str(e)) from e


class RunLog:
    """Lines of a run, each with its tag in brackets, shown and kept in a file."""

    TAG = re.compile(r"\[[a-z0-9_.-]+\]")

    def __init__(self, path: str | None = None, show=print):
        self.path, self.show = path, show
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)

    def line(self, text: str) -> None:
        if not self.TAG.match(text):
            raise ValueError(f"a line begins with its tag in brackets: {text!r}")
        self.show(text)
        if self.path:
            with open(self.path, "a") as f:
                f.write(text + "\n")

    def warn(self, tag: str, text: str) -> None:
        self.line(f"{tag} WARN: {text}")

    def error(self, tag: str, text: str) -> None:
        self.line(f"{tag} ERROR: {text}")

    def metrics(self, tag: str, **values) -> None:
        self.line(metric_row(tag, **values))


def percentile_line(values: dict[str, float]) -> str:
    """p1 to p99 with the median between, of a row of spread, as text."""
    return " ".join(f"{n}={shown('', float(values[n]))}" for n in ("p1", "p5", "p25", "median", "p75", "p95", "p99")) + f" mean={shown('', float(values['mean']))}"


def commit_of(folder: str) -> str:
    """The short name of the commit that a folder's repository is at, ``nogit`` where there is none."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "nogit"


def run_one(entry: dict, base: dict, root: str, markers: str, *, command=None, now=lambda: datetime.now(UTC).isoformat(timespec="seconds")) -> dict:
    """Run an entry of a queue as a process of its own, its output in a file, and leave a marker with what became of it."""
    args = merged_args(entry, base, root)
    cmd = (command or (lambda m, a: [sys.executable, "-m", m, *a]))(entry["module"], command_line(args))
    out = Path(root) / entry["name"] / "output.log"
    out.parent.mkdir(parents=True, exist_ok=True)
    start, begun = now(), time.monotonic()
    with out.open("w") as f:
        code = subprocess.run(cmd, stdout=f, stderr=subprocess.STDOUT, check=False).returncode
    done = {"name": entry["name"], "status": "done" if code == 0 else "failed", "exit_code": code, "started": start, "finished": now(), "wall_seconds": round(time.monotonic() - begun, 1)}
    write_marker(os.path.join(markers, f"{entry['name']}.json"), done)
    return done


def run_queue(queue: dict, root: str, *, force: set[str] = frozenset(), stop_on_failure: bool = False, **how) -> list[dict]:
    """What became of each run of a queue, in order: those done before are skipped, failures don't stop the others unless asked to."""
    markers = os.path.join(root, "markers")
    todo, out, stopped = set(to_run(queue, markers, force)), [], False
    for entry in queue["runs"]:
        n = entry["name"]
        if n not in todo:
            out.append({**(read_marker(os.path.join(markers, f"{n}.json")) or {}), "name": n, "status": "skipped"})
        elif stopped:
            out.append({"name": n, "status": "pending"})
        else:
            out.append(run_one(entry, queue.get("base_args", {}), root, markers, **how))
            stopped = stop_on_failure and out[-1]["status"] == "failed"
    return out


def run_dir_beside(checkpoints: str, role: str = "run", stamp: str | None = None) -> RunDir:
    """The folders of a run whose checkpoints already have a place: its name is that folder's, its logs lie beside it."""
    at = Path(checkpoints).resolve()
    d = run_dir(str(at.parent), at.name, role, stamp)
    return RunDir(d.root, d.logs, at, d.manifest)
