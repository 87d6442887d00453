"""Token ids of public vocabularies, through the ``tokenizers`` library.

A byte-level BPE merges inside the pieces of its split pattern only, and that pattern always begins a new
piece at a space before a non-space. So a text's ids are those of its space-led units, and units repeat:
a chunk of texts is split and dictionary-encoded by Arrow, each distinct unit is looked up once, units the
worker hasn't met go through the library, and the ids are gathered in one NumPy step. New units are sent many
to a line, not one by one: those of plain runs (letters, digits, signs, a line feed) as their distinct runs, the
others whole. Texts where spaces meet other white space, or that hold a special token's string, go through the
library whole. The store keeps no strings: a unit is known by two independent 64-bit hashes of its bytes. It is
emptied when full.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from . import words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: Units a worker keeps, about 60 bytes each; longer units aren't kept.
STORE_UNITS, STORE_LENGTH = 1_000_000, 48
#: Pieces that go through the library at once, or in one line: its results are some KB each beside the ids.
AT_ONCE = 1024

#: White space of the split pattern and of Python, as RE2 writes it.
_SPACE = r"\x09-\x0d\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Classes of bytes whose runs the split pattern keeps together, 0: others. Letters are ASCII's and, of two bytes, U+00C0 to U+027F and U+0400 to U+047F.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA), 0xD0, 0xD1]] = 1
_KIND[10], _KIND[39] = 4, 0  # a line feed; an apostrophe begins endings of its own
#: The vocabulary's character for each byte: printable ones of Latin-1 are themselves. NUL divides pieces.
_BYTES = np.arange(256, dtype="<u4")
_odd = np.setdiff1d(_BYTES, [*range(33, 127), *range(161, 173), *range(174, 256)])
_BYTES[_odd] = 256 + np.arange(len(_odd))
_BYTES[0] = 32


def _alphabet(line: pa.StringScalar) -> str:
    return _BYTES[np.frombuffer(line.as_buffer(), np.uint8)].tobytes().decode("utf-32-le")


def _plain(units: pa.Array) -> np.ndarray:
    """Which non-empty units are runs of the classes of ``_KIND`` only, no line feed beside another."""
    data, bounds = words.raw(units)
    kind = _KIND[data]
    bad = kind == 0
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of times and division
    pair = (kind[1:] == 4) & (kind[:-1] == 4)
    pair[bounds[1:-1] - 1] = False
    bad[1:] |= pair
    return (words.per_text(bad, bounds) == 0) & (np.diff(bounds) > 0)


def _hashes(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string's bytes."""
    data, bounds = words.raw(units)
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros(len(units), np.uint64), np.zeros(len(units), np.uint64)
    for h, turned in zip(out, (data, _TURN[data]), strict=True):
        h[full] = words.hashes(turned, bounds[full], bounds[full + 1])
    return out


#: A permutation of the bytes: the second hash adds other keys at each place.
_TURN = np.random.default_rng(7).permutation(256).astype(np.uint8)


class UnitEncoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of each text."""

    def __init__(self, path: str = VOCABULARY, units: int = STORE_UNITS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)  # for runs of one class, already in the byte alphabet
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
        self.widths[list(vocab.values())] = [len(token) for token in vocab]  # a character of the byte alphabet is a byte
        special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole_only = "|".join([rf" ([{_SPACE}]|$)", *map(re.escape, special)])
        self.limit = units
        self._empty()

    def _empty(self) -> None:
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)  # both hashes and the row, by the first
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Rows of the store, -1 for what isn't in it."""
        h, g, row = self.known
        if not len(h):
            return np.full(len(one), -1)
        at = np.minimum(np.searchsorted(h, one), len(h) - 1)
        return np.where((h[at] == one) & (g[at] == two), row[at], -1)

    def _keep(self, one: np.ndarray, two: np.ndarray, rows: np.ndarray) -> None:
        h, g, row = (np.concatenate(x) for x in zip(self.known, (one, two, rows), strict=True))
        order = np.argsort(h, kind="stable")
        first = np.ones(len(h), bool)
        first[1:] = h[order][1:] != h[order][:-1]
        order = order[first]
        self.known = h[order], g[order], row[order]

    def _put(self, flat: np.ndarray, lens: np.ndarray) -> range:
        """Rows of the store that hold these ids, cut by lengths."""
        while self.n + len(lens) > len(self.starts):
            self.starts, self.lens = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        first, self.n = self.n, self.n + len(lens)
        self.lens[first : self.n] = lens
        self.starts[first : self.n] = self.used + np.cumsum(lens) - lens
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return range(first, self.n)

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece by the library, and how many it has."""
        encode = self.tokenizer.encode_batch_fast
        got = [np.array(e.ids, np.uint32) for i in range(0, len(pieces), AT_ONCE) for e in encode(pieces[i : i + AT_ONCE], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(g) for g in got], np.int64)

    def _lines(self, pieces: pa.Array, lead: int, separator: str, encode) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_library``, for pieces joined to lines; ``lead``: bytes that a line gives each piece before its own.

        The tokens' bytes tell where a piece ends. None where they don't: another kind of vocabulary.
        """
        lines = pa.ListArray.from_arrays(pa.array([*range(0, len(pieces), AT_ONCE), len(pieces)], pa.int32()), pieces)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(encode(line), np.uint32) for line in pc.binary_join(lines, separator))])
        at, ends = np.cumsum(self.widths[flat]), np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + lead)
        last = np.searchsorted(at, ends)
        if len(ends) and (not len(at) or at[-1] != ends[-1] or (at[last] != ends).any()):
            return None
        return flat, np.diff(last, prepend=-1)

    def _runs(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain units (with their leading space) and how many each has.

        The pieces of the split pattern are runs of one class of characters; each distinct one goes through the library, without the pattern.
        """
        first = np.cumsum(pc.binary_length(units).to_numpy().astype(np.int64) + 1)
        first[1:], first[:1] = first[:-1].copy(), 0
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units), " ")[0].as_buffer(), np.uint8)
        data = np.concatenate([[np.uint8(32)], data])
        kind = _KIND[data]
        new = np.empty(len(data), bool)
        new[0], new[1:] = True, kind[1:] != kind[:-1]
        new[first], new[first + 1] = True, False  # a space goes with the run after it
        starts = np.flatnonzero(new)
        runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        got = self._lines(runs.dictionary, 0, "\0", lambda line: self.words.encode_batch_fast([_alphabet(line)], add_special_tokens=False)[0].ids)
        if got is None:
            return None
        flat, many = got
        index = runs.indices.to_numpy()
        lens = many[index]
        shift = np.repeat((np.cumsum(many) - many)[index] - (np.cumsum(lens) - lens), lens)
        return flat[shift + np.arange(len(shift))], np.add.reduceat(lens, np.searchsorted(starts, first))

    def _learn(self, units: pa.Array, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Rows for units (without their leading space) that have none yet, and their two hashes."""
        plain = _plain(units)
        rows = np.empty(len(units), np.int64)
        for which, ids in (
            (plain, self._runs),
            (~plain, lambda some: self._lines(some, 1, " ", lambda line: self.tokenizer.encode_batch_fast([f" {line.as_py()}"], add_special_tokens=False)[0].ids)),
        ):
            if which.any():
                some = units.filter(pa.array(which))
                rows[which] = self._put(*(ids(some) or self._library([f" {u}" for u in some.to_pylist()])))
        kept = np.flatnonzero(pc.binary_length(units).to_numpy() <= STORE_LENGTH)
        self._keep(one[kept], two[kept], rows[kept])
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and how many each text has. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > self.limit:
            self._empty()
        whole = pc.match_substring_regex(texts, self.whole_only)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        odd_texts = pc.take(texts, pa.array(odd)).to_pylist()
        if len(odd):
            texts = pc.if_else(whole, "", texts)
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        values = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        one, two = _hashes(values.dictionary)
        rows, places = self._find(one, two), values.indices.to_numpy()
        led = np.ones(len(places), bool)
        led[bounds[:-1]] = False  # a text's beginning has no space before it
        asked = np.zeros(len(rows), bool)
        asked[places[led]] = True
        if len(new := np.flatnonzero(asked & (rows < 0))):
            rows[new] = self._learn(values.dictionary.take(pa.array(new)), one[new], two[new])
        index = rows[places]
        firsts = pc.take(parts.values, pa.array(parts.offsets.to_numpy()[:-1])).dictionary_encode()
        mark = self.n, self.used
        index[bounds[:-1]] = np.array(self._put(*self._library(firsts.dictionary.to_pylist())), np.int64)[firsts.indices.to_numpy()]
        index[bounds[odd]] = self._put(*self._library(odd_texts))
        lens = self.lens[index]
        total = int(lens.sum())
        shift = np.repeat(self.starts[index] - (np.cumsum(lens) - lens), lens)
        out = self.pool[shift + np.arange(total)], np.add.reduceat(lens, bounds[:-1])
        self.n, self.used = mark  # texts' beginnings and whole texts aren't kept
        return out


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str = VOCABULARY, units: int = STORE_UNITS) -> UnitEncoder:
    """One encoder for each vocabulary and Python worker; it keeps ``units`` from here on."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    _encoders[path].limit = units
    return _encoders[path]


def loaded(path: str = VOCABULARY) -> bool:
    return path in _encoders


def forget() -> None:
    """Drops this worker's encoders."""
    _encoders.clear()
