"""Frame decoders for TIFF stacks, DCIMG recordings and SIFX spools, from bytes; no imaging library."""

from __future__ import annotations

import configparser
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Page:
    height: int
    width: int
    offsets: list[int]
    counts: list[int]
    compression: int
    bits: int
    order: str

    def pixels(self, raw: bytes) -> np.ndarray:
        parts = [raw[o : o + n] for o, n in zip(self.offsets, self.counts, strict=True)]
        if self.compression in (8, 32946):
            parts = [zlib.decompress(p) for p in parts]
        elif self.compression != 1:
            raise ValueError(f"TIFF compression {self.compression} isn't handled")
        kind = np.dtype(f"{self.order}u{self.bits // 8}")
        return np.frombuffer(b"".join(parts), kind, self.height * self.width).reshape(self.height, self.width)


def tiff_pages(raw: bytes) -> Iterator[Page]:
    """Pages of a baseline or big TIFF with one grey sample of 8, 16 or 32 bits."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None:
        raise ValueError("not a TIFF")
    version = struct.unpack_from(order + "H", raw, 2)[0]
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0]
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 16: 8}
    codes = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
    while at:
        n = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
        at += 8 if big else 2
        tags: dict[int, tuple[int, ...]] = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, at)
            count = struct.unpack_from(order + ("Q" if big else "I"), raw, at + 4)[0]
            place, inline = at + (12 if big else 8), 8 if big else 4
            if kind in sizes:
                if sizes[kind] * count > inline:
                    place = struct.unpack_from(order + ("Q" if big else "I"), raw, place)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{codes[kind]}", raw, place)
            at += 20 if big else 12
        one = lambda t, d=None: tags[t][0] if t in tags else d
        if one(277, 1) != 1 or one(258, 1) not in (8, 16, 32):
            raise ValueError("only grey TIFFs of 8, 16 or 32 bits are handled")
        yield Page(one(257), one(256), list(tags[273]), list(tags[279]), one(259, 1), one(258), order)
        at = struct.unpack_from(order + ("Q" if big else "I"), raw, at)[0]


def write_tiff(frames: np.ndarray, compress: bool = True) -> bytes:
    """A little-endian big TIFF of grey frames (n, h, w), zlib by default."""
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    link = 8
    for f in frames:
        data = np.ascontiguousarray(f.astype(f.dtype.newbyteorder("<"))).tobytes()
        data = zlib.compress(data) if compress else data
        at = len(out)
        out += data + b"\0" * (-len(data) % 8)
        entries = [(256, 4, f.shape[1]), (257, 4, f.shape[0]), (258, 3, f.dtype.itemsize * 8), (259, 3, 8 if compress else 1), (262, 3, 1), (273, 16, at), (277, 3, 1), (278, 4, f.shape[0]), (279, 16, len(data))]
        struct.pack_into("<Q", out, link, len(out))
        out += struct.pack("<Q", len(entries))
        for tag, kind, value in entries:
            out += struct.pack("<HHQQ", tag, kind, 1, value)
        link = len(out)
        out += struct.pack("<Q", 0)
    return bytes(out)


@dataclass
class Dcimg:
    """Geometry of a DCIMG session (both header generations) and its frames with footers."""

    height: int
    width: int
    n: int
    depth: int
    row_bytes: int
    frame_bytes: int
    start: int
    footer: int

    @classmethod
    def parse(cls, raw: bytes) -> Dcimg:
        if raw[:5] != b"DCIMG":
            raise ValueError("not a DCIMG file")
        version = struct.unpack_from("<I", raw, 8)[0]
        session = struct.unpack_from("<I", raw, 40)[0]
        if version == 0x7:
            n, depth, _, width, row_bytes, height, image_bytes = struct.unpack_from("<7I", raw, session + 32)
            start = struct.unpack_from("<I", raw, session + 68)[0]
            return cls(height, width, n, depth, row_bytes, image_bytes, session + start, 0)
        if version not in (0x1000000, 0x2000000):
            raise ValueError(f"DCIMG version {version:#x} isn't handled")
        n, depth = struct.unpack_from("<I", raw, session + 60)[0], struct.unpack_from("<I", raw, session + 64)[0]
        width, height, row_bytes, image_bytes = struct.unpack_from("<4I", raw, session + 72)
        start = struct.unpack_from("<Q", raw, session + 96)[0]
        footer = struct.unpack_from("<I", raw, session + 124)[0]
        return cls(height, width, n, depth, row_bytes, image_bytes + footer, session + start, footer)

    def frame(self, raw: bytes, i: int) -> tuple[np.ndarray, dict]:
        if self.depth not in (1, 2):
            raise ValueError(f"byte depth {self.depth} isn't handled")
        at = self.start + i * self.frame_bytes
        pix = np.ndarray((self.height, self.width), f"<u{self.depth}", raw, at, (self.row_bytes, self.depth))
        meta = {"frame_index": i, "framestamp": None, "timestamp_sec": None, "timestamp_microsec": None}
        if self.footer >= 12:
            stamp, sec, micro = struct.unpack_from("<3I", raw, at + self.frame_bytes - self.footer)
            meta |= {"framestamp": stamp, "timestamp_sec": sec, "timestamp_microsec": micro}
        return np.array(pix), meta


#: Sample types of spool recordings.
SPOOL_KINDS = {"Mono8": "<u1", "Mono12": "<u2", "Mono16": "<u2", "Mono32": "<u4"}


@dataclass
class Spool:
    """Geometry from a spool's ini text: each file holds some images, rows may be padded."""

    height: int
    width: int
    row_bytes: int
    image_bytes: int
    per_file: int
    kind: str

    @classmethod
    def parse(cls, text: str) -> Spool:
        p = configparser.ConfigParser(strict=False)
        p.optionxform = str
        p.read_string(text)
        values = {k.lower(): v for s in p.sections() for k, v in p.items(s)}
        kind = SPOOL_KINDS.get(values.get("pixelencoding", "Mono16"))
        if kind is None:
            raise ValueError(f"sample type {values.get('pixelencoding')} isn't handled")
        width = int(values["aoiwidth"])
        stride = int(values.get("aoistride", width * int(kind[-1])))
        return cls(int(values["aoiheight"]), width, stride, int(values["imagesizebytes"]), int(values["imagesperfile"]), kind)

    def frames(self, raw: bytes, header_left: int | None = None) -> list[np.ndarray]:
        """Images really there, no more than the header still promises."""
        n = min(self.per_file, len(raw) // self.image_bytes)
        n = n if header_left is None else min(n, header_left)
        size = int(self.kind[-1])
        return [np.array(np.ndarray((self.height, self.width), self.kind, raw, i * self.image_bytes, (self.row_bytes, size))) for i in range(n)]
