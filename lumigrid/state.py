"""Decisions and derived state of a session: what a person decided is never deleted with derived data."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Any

from pyarrow import fs

from .sources.seek import system

DECISIONS = ("demux_correction.json", "ica_exclusion.json", "marks.json", "rois.csv")


def _write(path: str, value: Any) -> None:
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f)
    os.replace(part, path)


def _read(path: str) -> Any:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)  # a damaged decision must raise, not vanish


def save_exclusion(folder: str, group: str, components: list[int]) -> None:
    path = os.path.join(folder, "ica_exclusion.json")
    kept = {i for i in components if i >= 0}
    _write(path, (_read(path) or {}) | {group: [f"IC{i + 1}" for i in sorted(kept)]})


def load_exclusion(folder: str, group: str) -> list[int] | None:
    """0-based components; None: not decided, []: decided to keep all."""
    found = (_read(os.path.join(folder, "ica_exclusion.json")) or {}).get(group)
    return None if found is None else sorted({int(str(s).upper().removeprefix("IC")) - 1 for s in found})


def resolve_exclusion(folder: str, group: str, given: dict | bool | None) -> list[int]:
    if isinstance(given, dict):
        return sorted(set(given.get(group, [])))
    return [] if given is False else load_exclusion(folder, group) or []


def save_correction(folder: str, cycle: int, start_offset: int, edits: list) -> None:
    _write(os.path.join(folder, "demux_correction.json"), {"cycle_len": cycle, "start_offset": start_offset, "edits": edits})


def load_correction(folder: str, cycle: int) -> tuple[int, list] | None:
    """Offset and edits; one of another cycle length is ignored, two-part edits of old files are open in delta 1."""
    found = _read(os.path.join(folder, "demux_correction.json"))
    if not found or found["cycle_len"] != cycle:
        return None
    return found["start_offset"], [tuple(e) if len(e) == 3 else (e[0], None, e[1]) for e in found["edits"]]


def save_marks(folder: str, pairs: list[tuple[float, float, float, float]]) -> None:
    """Control points (src_r, src_c, ref_r, ref_c), columns first on disk; the previous file stays as ``.old``."""
    path = os.path.join(folder, "marks.json")
    if os.path.exists(path):
        os.replace(path, f"{path}.old")
    _write(path, [[sc, sr, rc, rr] for sr, sc, rr, rc in pairs])


def load_marks(folder: str) -> list[tuple[float, float, float, float]] | None:
    found = _read(os.path.join(folder, "marks.json"))
    return found and [(sr, sc, rr, rc) for sc, sr, rc, rr in found]


def signature(stage: str, settings: dict, upstream: str = "") -> str:
    """What a stage's result depends on: its settings and the stages before it."""
    return hashlib.sha1(json.dumps([stage, settings, upstream], sort_keys=True, default=str).encode()).hexdigest()


class Manifest:
    """Which tables of a folder are whole: a row per stage with its signature and where its tables are. It is replaced as one file, after them."""

    NAME = "manifest.json"

    def __init__(self, folder: str):
        self.files, self.at = system(folder.rstrip("/"))
        self.path = f"{self.at}/{self.NAME}"

    def read(self) -> dict[str, dict]:
        if self.files.get_file_info(self.path).type != fs.FileType.File:
            return {}
        with self.files.open_input_file(self.path) as f:
            return json.loads(f.read())

    def put(self, stage: str, entry: dict) -> None:
        self.files.create_dir(self.at)
        now = self.read() | {stage: entry}
        with self.files.open_output_stream(f"{self.path}.part") as f:
            f.write(json.dumps(now, indent=1).encode())
        self.files.move(f"{self.path}.part", self.path)


def contents(paths: list[str]) -> str:
    """A digest of files as they are: their names in order, sizes, times of change and first bytes."""
    out = []
    for path in paths:
        files, at = system(path)
        info = files.get_file_info(at)
        with files.open_input_file(at) as f:
            head = hashlib.sha1(f.read(4096)).hexdigest()
        out.append([info.base_name, info.size, info.mtime_ns, head])
    return hashlib.sha1(json.dumps(out).encode()).hexdigest()


def delete_derived(folder: str) -> list[str]:
    """Removes everything but decisions and configuration; returns what went."""
    import shutil

    gone = []
    for name in sorted(os.listdir(folder)):
        if name in DECISIONS or name.endswith(".old") or name in ("db.json", "ops.json"):
            continue
        path = os.path.join(folder, name)
        shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
        gone.append(name)
    return gone
