"""FLAC streams: an encoder and a decoder over many streams at once (operator 6).

Streams are mono, 8 bits a sample, fixed block size. Every subframe is constant, verbatim, or a linear
predictor (the fixed ones of order 0 to 4, or LPC with quantised coefficients) with Rice-coded residuals. The
decoder reads all frames of a batch in step: one NumPy operation handles the n-th sample of every frame, so
the sequential Rice code costs no Python loop per sample. Header CRC-8, frame CRC-16 and the MD5 of the
samples are verified; a mismatch raises.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from .words import per_text

BLOCK = 1024
RATE = 8000
_MAX_RICE = 14


def _crc_steps(poly: int, bits: int, length: int) -> np.ndarray:
    """table[d * 256 + b]: what byte b contributes to the checksum when d bytes follow it."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1

    def shift(x: int) -> int:
        for _ in range(8):
            x = ((x << 1) ^ (poly if x & top else 0)) & mask
        return x

    step = np.array([shift(b << (bits - 8)) for b in range(256)], np.uint32)
    rows = [step]
    for _ in range(length - 1):
        x = rows[-1]
        rows.append(((x << 8) & mask) ^ step[(x >> (bits - 8)) & 255])
    return np.concatenate(rows).astype(np.uint16)


_CRC8 = _crc_steps(0x07, 8, 16)
_crc16: dict[str, np.ndarray] = {}


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    lens = ends - starts
    cum = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) + np.repeat(starts - cum, lens)
    after = np.repeat(ends, lens) - 1 - at
    return np.bitwise_xor.reduceat(table[after * 256 + data[at]], cum)


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    longest = int((ends - starts).max())
    if len(_crc16.get("t", ())) < longest * 256:
        _crc16["t"] = _crc_steps(0x8005, 16, max(longest, 2 * BLOCK + 64))
    return _crc(data, starts, ends, _crc16["t"])


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8 like code: (n, 6) bytes and how many count."""
    size = 1 + (n > 0x7F) + (n > 0x7FF) + (n > 0xFFFF) + (n > 0x1FFFFF) + (n > 0x3FFFFFF)
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        r = np.flatnonzero(size == s)
        if s == 1:
            out[r, 0] = n[r]
            continue
        for j in range(s - 1, 0, -1):
            out[r, j] = 0x80 | (n[r] >> (6 * (s - 1 - j)) & 0x3F)
        out[r, 0] = (0xFF00 >> s & 0xFF) | (n[r] >> (6 * (s - 1)))
    return out, size


#: Coefficients of the fixed predictors, nearest sample first.
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


#: A point of the seek table.
_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])


def encode(data: np.ndarray, bounds: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload ``data[bounds[i]:bounds[i + 1]]`` (unsigned bytes, centred to signed samples)."""
    n_streams, sizes = len(bounds) - 1, np.diff(bounds)
    frames_of = -(-sizes // block)
    stream = np.repeat(np.arange(n_streams), frames_of)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    start = bounds[stream] + number * block
    length = np.minimum(block, bounds[stream + 1] - start)
    n = len(stream)
    edges = np.append(start, bounds[-1])
    x = data.astype(np.int16) - np.int16(128)
    frame = np.repeat(np.arange(n, dtype=np.int32), length)
    place = np.arange(len(x), dtype=np.int32) - np.repeat(start.astype(np.int32), length)
    # the order with the smallest sum of residual magnitudes; its first samples are stored as they are
    best, order, r, d = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), x, x
    for k in range(5):
        if k:
            d = np.diff(d, prepend=np.int16(0))
        sizes_of = np.abs(d)
        for j in range(k):
            sizes_of[(at := start + j)[at < bounds[-1]]] = 0
        cost = per_text(sizes_of, edges)
        better = (cost < best) & (length > k)
        best, order = np.where(better, cost, best), np.where(better, k, order)
        if k and better.any():
            r = np.where(np.repeat(better, length), d, r)
    warm = place < order[frame]
    zig = np.where(warm, 0, (r << 1) ^ (r >> 15)).astype(np.int32)
    guess = np.log2(np.maximum(best / np.maximum(length - order, 1), 0.5) * 2).astype(np.int64)
    rice, bits = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    for step in (-1, 0, 1):
        k = np.clip(guess + step, 0, _MAX_RICE)
        size = per_text(zig >> np.repeat(k.astype(np.int32), length), edges) + (length - order) * (k + 1)
        better = size < bits
        rice, bits = np.where(better, k, rice), np.where(better, size, bits)
    bits += 8 * order + 2 + 4 + 4
    constant = per_text(x != np.repeat(x[start], length), edges) == 0
    kind = np.where(constant, 0, np.where(bits < 8 * length, 8 + order, 1))  # subframe type codes
    body = np.where(constant, 8, np.where(kind == 1, 8 * length, bits))
    # header: sync, block size and rate code, channels and sample size, number, block size - 1, CRC-8
    digits, n_digits = _utf8_number(number)
    head_bytes = 4 + n_digits + 2 + 1
    frame_bytes = head_bytes + (8 + body + 7) // 8 + 2
    where = np.cumsum(frame_bytes) - frame_bytes
    total = int(frame_bytes.sum())
    out = np.zeros(total + 8, np.uint8)
    out[where], out[where + 1], out[where + 2], out[where + 3] = 0xFF, 0xF8, 0x70, 0x02
    for j in range(6):
        has = n_digits > j
        out[where[has] + 4 + j] = digits[has, j]
    size_at = where + 4 + n_digits
    out[size_at], out[size_at + 1] = (length - 1) >> 8, (length - 1) & 255
    out[size_at + 2] = _crc(out, where, size_at + 2, _CRC8)
    # the body's codes: value, width and bit position; all disjoint, so words are sums
    begin = 8 * (where + head_bytes)
    coded = np.repeat(kind >= 8, length) & ~warm
    low = np.repeat(rice.astype(np.int32), length)
    need = np.where(coded, low + 1, 8)
    width = np.where(coded, (zig >> low) + need, 8)
    if constant.any():
        width[np.repeat(constant, length) & (place > 0)] = 0
    value = np.where(coded, (np.int32(1) << low) | (zig & ((np.int32(1) << low) - 1)), x & 255)
    # method, partition order and parameter stand before the first residual
    width[(start + order)[kind >= 8]] += 10
    run = np.cumsum(width)
    position = run + np.repeat(begin + 8 - (run[start] - width[start]), length)  # end of the code
    keep = width > 0
    parts = [(position[keep], value[keep], need[keep])]
    rows = np.flatnonzero(kind >= 8)
    parts.append((begin[rows] + 8 + 8 * order[rows] + 10, rice[rows], np.full(len(rows), 10)))
    parts.append((begin + 8, kind << 1, np.full(n, 8)))
    end, value, need = (np.concatenate(c) for c in zip(*parts, strict=True))
    first = end - need
    word, shift = first >> 5, 64 - (first & 31) - need
    wide = value.astype(np.uint64) << shift.astype(np.uint64)
    words = -(-(total + 8) // 4) + 2
    high = np.bincount(word, (wide >> np.uint64(32)).astype(float), words)
    high += np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(float), words)
    out |= high.astype(np.uint32).astype(">u4").view(np.uint8)[: len(out)]
    sums = crc16(out, where, where + frame_bytes - 2)
    out[where + frame_bytes - 2], out[where + frame_bytes - 1] = sums >> 8, sums & 255
    raw, ends = out.tobytes(), np.cumsum(frame_bytes)
    signed = (data ^ np.uint8(0x80)).tobytes()
    streams, f = [], 0
    for i in range(n_streams):
        m = int(frames_of[i])
        lo, hi = (int(where[f]), int(ends[f + m - 1])) if m else (0, 0)
        inside = frame_bytes[f : f + m]
        least, most = (int(inside.min()), int(inside.max())) if m else (0, 0)
        fields = (RATE << 44) | (0 << 41) | (7 << 36) | int(sizes[i])
        info = block.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big") + fields.to_bytes(8, "big") + hashlib.md5(signed[bounds[i] : bounds[i + 1]]).digest()
        points = np.zeros(m, _POINT)
        points["sample"], points["offset"], points["samples"] = number[f : f + m] * block, where[f : f + m] - lo, length[f : f + m]
        streams.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + points.nbytes.to_bytes(3, "big") + points.tobytes() + raw[lo:hi])
        f += m
    return streams


@dataclass
class Decoded:
    data: np.ndarray  # unsigned bytes of all streams
    bounds: np.ndarray
    frame_stream: np.ndarray  # per frame: its stream, first sample in it, and byte offset in the stream
    frame_sample: np.ndarray
    frame_byte: np.ndarray


def _stream_info(raw: bytes) -> tuple[int, int, int, bytes, np.ndarray]:
    """Block size, samples, where frames begin, MD5, seek points."""
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, None, np.zeros(0, _POINT)
    while True:
        last, kind, size = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind == 0:
            info = raw[at + 4 : at + 4 + size]
        elif kind == 3:
            points = np.frombuffer(raw, _POINT, size // 18, at + 4)
            points = points[points["sample"] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + size
        if last:
            break
    if info is None:
        raise ValueError("a FLAC stream without STREAMINFO")
    fields = int.from_bytes(info[10:18], "big")
    if (fields >> 41 & 7, fields >> 36 & 31) != (0, 7):
        raise ValueError("only mono streams of 8 bits are handled")
    return int.from_bytes(info[:2], "big"), fields & (1 << 36) - 1, at, info[18:34], points


_LEAD = np.array([16] + [15 - i.bit_length() + 1 for i in range(1, 1 << 16)], np.int64)


class _Bits:
    """Bit readers in step: each of many positions reads from one byte array."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        n = len(data) + 8
        window = np.zeros(n, np.uint64)
        for j in range(8):
            window |= padded[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.window, self.end = window, 8 * n - 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.window[np.minimum(at, self.end) >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """``width`` bits (0 to 32) at each position."""
        w = np.asarray(width)
        return np.where(w == 0, 0, (self.peek(at) >> (64 - np.maximum(w, 1)).astype(np.uint64)).astype(np.int64))

    def unary(self, at: np.ndarray) -> np.ndarray:
        count = _LEAD[self.peek(at) >> np.uint64(48)]
        more = np.flatnonzero(count == 16)
        while len(more):
            if (at[more] + count[more] > self.end).any():
                raise ValueError("a Rice code runs over the end")
            step = _LEAD[self.peek(at[more] + count[more]) >> np.uint64(48)]
            count[more] += step
            more = more[step == 16]
        return count


def decode(streams: list[bytes]) -> Decoded:
    """All samples of the streams, with the seek table of their frames."""
    infos = [_stream_info(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    bits = _Bits(data)
    sizes = np.array([i[1] for i in infos], np.int64)
    blocks = np.array([i[0] for i in infos], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(bounds[-1]), np.int32)
    at = base[:-1] + np.array([i[2] for i in infos], np.int64)
    done = np.zeros(len(streams), np.int64)
    seek: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # where the seek table lists every frame, all are decoded together
    listed = [i for i, x in enumerate(infos) if x[1] and int(x[4]["samples"].sum()) == x[1] and (np.cumsum(x[4]["samples"]) - x[4]["samples"] == x[4]["sample"]).all()]
    if listed:
        own = np.repeat(listed, [len(infos[i][4]) for i in listed])
        points = np.concatenate([infos[i][4] for i in listed])
        sample, begin = points["sample"].astype(np.int64), at[own] + points["offset"].astype(np.int64)
        if (begin >= base[own + 1]).any():
            raise ValueError("a seek point lies outside the stream")
        _, length = _frames(data, bits, begin, out, bounds[own] + sample, blocks[own], sizes[own] - sample)
        if (length != points["samples"]).any():
            raise ValueError("a frame's size differs from the seek table")
        seek.append((own, sample, begin - base[own]))
        done[listed] = sizes[listed]
    # else a frame's end is known once it is decoded, so round r handles the r-th frame of every stream
    live = np.flatnonzero(done < sizes)
    while len(live):
        begin = at[live]
        used, length = _frames(data, bits, begin, out, bounds[live] + done[live], blocks[live], sizes[live] - done[live])
        seek.append((live, done[live].copy(), begin - base[live]))
        at[live] += used
        done[live] += length
        live = live[done[live] < sizes[live]]
    samples = (out + 128).astype(np.uint8)
    signed = (samples ^ np.uint8(0x80)).tobytes()
    for i, info in enumerate(infos):
        if hashlib.md5(signed[bounds[i] : bounds[i + 1]]).digest() != info[3]:
            raise ValueError("MD5 of the samples differs")
    columns = [np.concatenate(c) if seek else np.zeros(0, np.int64) for c in (zip(*seek, strict=True) if seek else ([], [], []))]
    order = np.lexsort((columns[1], columns[0]))
    return Decoded(samples, bounds, *(c[order] for c in columns))


def _frames(data, bits: _Bits, begin, out, target, block, left) -> tuple[np.ndarray, np.ndarray]:
    """Decodes one frame at each of the byte positions into ``out`` from ``target`` on; returns bytes and samples."""
    if (data[begin] != 0xFF).any() or (data[begin + 1] != 0xF8).any() or (data[begin + 3] != 0x02).any() or (data[begin + 2] & 15).any():
        raise ValueError("unsupported or damaged frame header")
    code = data[begin + 2] >> 4
    digits = np.maximum(1, 8 - np.ceil(np.log2(256.0 - data[begin + 4])).astype(np.int64))
    digits = np.where(data[begin + 4] < 0x80, 1, digits)
    size_at = begin + 4 + digits
    wide = np.where(code == 7, 2, np.where(code == 6, 1, 0))
    length = np.where(code == 7, bits.take(8 * size_at, 16) + 1, np.where(code == 6, bits.take(8 * size_at, 8) + 1, np.where(code >= 8, 256 << (code.astype(np.int64) & 7), np.where(code == 1, 192, 576 << np.maximum(code.astype(np.int64) - 2, 0)))))
    crc_at = size_at + wide
    if (length > np.minimum(block, left)).any() or (_crc(data, begin, crc_at, _CRC8) != data[crc_at]).any():
        raise ValueError("a frame header's checksum or size is wrong")
    pos = 8 * (crc_at + 1)
    head = bits.take(pos, 8)
    if (head & 0x81).any():
        raise ValueError("unsupported subframe")
    kind = head >> 1
    pos += 8
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    constant, verbatim = kind == 0, kind == 1
    if not (constant | verbatim | ((kind >= 8) & (kind <= 12)) | (kind >= 32)).all():
        raise ValueError("reserved subframe type")
    signed = lambda v, w: np.where(v >> np.maximum(w - 1, 0) & 1, v - (np.int64(1) << w), v)
    longest, top = int(length.max()), int(order.max())
    n = len(begin)
    past = np.zeros((n, max(top, 1)), np.int64)  # nearest sample first
    coef, shift = np.zeros((n, max(top, 1)), np.int64), np.zeros(n, np.int64)
    for k in range(1, min(top, 4) + 1):
        coef[kind == 8 + k, :k] = _FIXED[k]
    # frames by length, longest first: those still running are a prefix
    by = np.argsort(-length, kind="stable")
    pos, kind, order, constant, verbatim, coef, target, n_of = pos[by], kind[by], order[by], constant[by], verbatim[by], coef[by], target[by], length[by]
    lpc, shift = kind >= 32, shift[by]
    running = np.searchsorted(-n_of, -np.arange(longest), "left")
    coded = ~constant & ~verbatim
    rice, per, until, escape = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    method, started = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(longest):
        m = int(running[i])
        p = pos[:m]
        raw = verbatim[:m] | (coded[:m] & (i < order[:m])) | (constant[:m] if i == 0 else False)
        start = np.flatnonzero(coded[:m] & (order[:m] == i) & ~started[:m])
        if len(start):
            own = start[lpc[start]]
            if len(own):
                precision, shift[own] = bits.take(pos[own], 4) + 1, signed(bits.take(pos[own] + 4, 5), np.full(len(own), 5))
                pos[own] += 9
                for j in range(top):
                    has = own[order[own] > j]
                    w = precision[order[own] > j]
                    coef[has, j] = signed(bits.take(pos[has], w), w)
                    pos[has] += w
            method[start] = bits.take(pos[start], 2)
            parts = bits.take(pos[start] + 2, 4)
            pos[start] += 6
            per[start] = n_of[start] >> parts
            until[start], started[start] = i, True
            if (method[start] > 1).any():
                raise ValueError("reserved residual coding")
        new = np.flatnonzero(coded[:m] & started[:m] & (until[:m] == i))
        if len(new):
            w = np.where(method[new] == 0, 4, 5)
            rice[new] = bits.take(pos[new], w)
            pos[new] += w
            out_of = rice[new] == (1 << w) - 1
            escape[new] = np.where(out_of, bits.take(pos[new], 5) + 1, 0)
            pos[new] += np.where(out_of, 5, 0)
            until[new] = np.where(until[new] == order[new], np.maximum(per[new], order[new] + (per[new] == 0)), until[new] + per[new])
        v = signed(bits.take(p, 8), np.full(m, 8))
        if not raw.all():
            q = _unary_where(bits, p, ~raw & ~constant[:m])
            k = rice[:m]
            z = (q << k) | bits.take(p + q + 1, k)
            rest = np.where(z & 1, -(z >> 1) - 1, z >> 1)
            used = q + 1 + k
            esc = escape[:m] > 0
            if esc.any():
                w = escape[:m] - 1
                rest, used = np.where(esc, signed(bits.take(p, w), np.maximum(w, 1)) * (w > 0), rest), np.where(esc, w, used)
            if top:
                rest = rest + ((coef[:m] * past[:m]).sum(1) >> shift[:m])
            hold = constant[:m] & (i > 0)
            v = np.where(raw, v, np.where(hold, past[:m, 0], rest))
            pos[:m] = p + np.where(raw, 8, np.where(hold, 0, used))
        else:
            pos[:m] = p + 8
        if top > 1:
            past[:m, 1:] = past[:m, :-1]
        past[:m, 0] = v
        out[target[:m] + i] = v
    end = np.empty(n, np.int64)
    end[by] = (pos + 7) >> 3
    if (end + 2 > len(data)).any() or (crc16(data, begin, end) != (data[end].astype(np.int64) << 8 | data[end + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    return end + 2 - begin, length


def _unary_where(bits: _Bits, at: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    rows = np.flatnonzero(where)
    out[rows] = bits.unary(at[rows])
    return out
