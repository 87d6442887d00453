"""Where frames lie inside files, from headers alone, and reading them by byte ranges.

Files are opened through pyarrow's file systems (local, HDFS, S3, GCS by their URI), always at a position: an index walks a TIFF's chain
of directories, a DCIMG session header or a spool's text, and never touches pixels; a read fetches a frame's own bytes once.
"""

from __future__ import annotations

import os
import posixpath
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs

from . import binary

#: Bytes fetched at once while walking headers.
STEP = 1 << 16
#: Endings of file names by format.
SUFFIXES = {"tif": (".tif", ".tiff"), "dcimg": (".dcimg",)}
SPOOL_HEAD, SPOOL_TAIL = "acquisitionmetadata.ini", "spool.dat"


def system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def natural(name: str) -> list:
    return [(1, int(x)) if x.isdigit() else (0, x) for x in re.findall(r"\d+|\D+", name.lower())]


def listed(path: str, kind: str) -> list[tuple[str, int]]:
    """(path, size) of a recording's files in reading order; a file that is named itself is alone."""
    files, at = system(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in files.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    if kind == "spool":
        found = [f for f in found if f.base_name.endswith(SPOOL_TAIL)]
        found.sort(key=lambda f: int("".join(re.findall(r"\d", f.base_name))[::-1] or 0))
    else:
        found = [f for f in found if f.base_name.lower().endswith(SUFFIXES[kind])]
        found.sort(key=lambda f: (natural(f.base_name), f.base_name))
    return [(scheme + f.path, f.size) for f in found]


class Reader:
    """Bytes at positions of one file; small reads come from a block that is fetched once. ``fetched`` counts bytes."""

    def __init__(self, path: str):
        files, at = system(path)
        self.file = files.open_input_file(at)
        self.size = self.file.size()
        self.block, self.start, self.fetched = b"", 0, 0

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def at(self, offset: int, n: int) -> bytes:
        """``n`` bytes from ``offset``; fewer at the end of the file."""
        if not self.start <= offset <= offset + n <= self.start + len(self.block):
            self.start, self.block = offset, self.whole(offset, max(n, STEP))
        return self.block[offset - self.start : offset - self.start + n]

    def whole(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        self.fetched += n
        return self.file.read_at(n, offset) if n else b""


@dataclass
class Place:
    """A frame inside a file: its parts of pixels, their layout, and where a footer with its stamp is."""

    frame_index: int
    h: int
    w: int
    kind: str
    compression: int
    row_bytes: int
    offsets: list[int]
    sizes: list[int]
    footer: int | None = None


def tiff_places(f: Reader) -> Iterator[Place]:
    """Along the chain of directories of a baseline or big TIFF with one grey sample of 8, 16 or 32 bits."""
    order = {b"II": "<", b"MM": ">"}.get(f.at(0, 2))
    if order is None:
        raise ValueError("not a TIFF")
    big = struct.unpack(order + "H", f.at(2, 2))[0] == 43
    word, size = ("Q", 8) if big else ("I", 4)
    number = lambda offset, code: struct.unpack(order + code, f.at(offset, struct.calcsize(order + code)))[0]
    at, i = number(8 if big else 4, word), 0
    codes = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
    seen = set()
    while at:
        if at in seen or at >= f.size:
            raise ValueError("a TIFF's chain of directories is broken")
        seen.add(at)
        n = number(at, "Q" if big else "H")
        at += 8 if big else 2
        entry = 20 if big else 12
        raw = f.at(at, n * entry)
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, k * entry)
            count = struct.unpack_from(order + word, raw, k * entry + 4)[0]
            if kind in codes:
                width = struct.calcsize(order + codes[kind]) * count
                inline = raw[k * entry + 4 + size : k * entry + entry]
                data = inline[:width] if width <= size else f.at(struct.unpack(order + word, inline)[0], width)
                tags[tag] = struct.unpack(f"{order}{count}{codes[kind]}", data)
        one = lambda t, d=None: tags[t][0] if t in tags else d
        if one(277, 1) != 1 or one(258, 1) not in (8, 16, 32) or one(259, 1) not in (1, 8, 32946):
            raise ValueError("only grey TIFFs of 8, 16 or 32 bits, plain or deflated, are handled")
        bytes_ = one(258) // 8
        yield Place(i, one(257), one(256), f"{order}u{bytes_}", one(259, 1), one(256) * bytes_, list(tags[273]), list(tags[279]))
        i += 1
        at = number(at + n * entry, word)


def dcimg_places(f: Reader) -> Iterator[Place]:
    d = binary.Dcimg.parse(f.at(0, STEP))
    if d.depth not in (1, 2):
        raise ValueError(f"byte depth {d.depth} isn't handled")
    for i in range(d.n):
        at = d.start + i * d.frame_bytes
        footer = at + d.frame_bytes - d.footer if d.footer >= 12 else None
        yield Place(i, d.height, d.width, f"<u{d.depth}", 1, d.row_bytes, [at], [d.row_bytes * (d.height - 1) + d.width * d.depth], footer)


def spool_places(f: Reader, head: binary.Spool, left: int | None) -> Iterator[Place]:
    """Images that are really there, no more than the header still promises."""
    n = min(head.per_file, f.size // head.image_bytes)
    width = int(head.kind[-1])
    for i in range(n if left is None else max(0, min(n, left))):
        yield Place(i, head.height, head.width, head.kind, 1, head.row_bytes, [i * head.image_bytes], [head.row_bytes * (head.height - 1) + head.width * width])


def spool_head(path: str) -> binary.Spool:
    files, at = system(path)
    folder = at if files.get_file_info(at).type == fs.FileType.Directory else posixpath.dirname(at)
    with files.open_input_file(posixpath.join(folder, SPOOL_HEAD)) as f:
        return binary.Spool.parse(f.read().decode("utf-8-sig"))


def places(path: str, kind: str, position: int = 0, frames: int | None = None) -> Iterator[Place]:
    """A file's frames. ``position``: which file of the recording it is, ``frames``: of the whole recording (spools)."""
    with Reader(path) as f:
        if kind == "tif":
            yield from tiff_places(f)
        elif kind == "dcimg":
            yield from dcimg_places(f)
        elif kind == "spool":
            head = spool_head(path)
            yield from spool_places(f, head, None if frames is None else frames - position * head.per_file)
        else:
            raise ValueError(f"unknown format: {kind}")


def pixels(f: Reader, p: Place) -> np.ndarray:
    """A frame's pixels; parts that follow each other are fetched together."""
    parts, k = [], 0
    while k < len(p.offsets):
        last = k
        while last + 1 < len(p.offsets) and p.offsets[last] + p.sizes[last] == p.offsets[last + 1]:
            last += 1
        raw = f.whole(p.offsets[k], p.offsets[last] + p.sizes[last] - p.offsets[k])
        parts += [raw[p.offsets[j] - p.offsets[k] :][: p.sizes[j]] for j in range(k, last + 1)]
        k = last + 1
    if p.compression != 1:
        parts = [zlib.decompress(x) for x in parts]
    raw, kind = b"".join(parts), np.dtype(p.kind)
    if len(raw) < p.row_bytes * (p.h - 1) + p.w * kind.itemsize:
        raise ValueError(f"frame {p.frame_index} ends early")
    return np.array(np.ndarray((p.h, p.w), kind, raw, 0, (p.row_bytes, kind.itemsize)))


def stamp(f: Reader, p: Place) -> tuple[int, int, int] | None:
    """Frame stamp, seconds and microseconds, where the format has them."""
    return None if p.footer is None else struct.unpack("<3I", f.at(p.footer, 12))


def kind_of(name: str) -> str | None:
    """The format a file or folder name says."""
    ending = os.path.splitext(name)[1].lower()
    return next((k for k, s in SUFFIXES.items() if ending in s), "spool" if ending == ".sifx" else None)
