"""Encoder, packing and token files."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumigrid.llm import packing, token_files, tokens


def _ids(text):
    return tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aeit .,\n\tXé'1   \x1c<|>日")), max_size=30), max_size=6))
def test_units_equal_the_library(texts):
    ids, lens = tokens.UnitEncoder.encode(tokens.encoder(), pa.array(texts, pa.string()))
    at = np.cumsum(lens)
    for t, n, e in zip(texts, lens, at, strict=True):
        assert ids[e - n : e].tolist() == _ids(t)


def test_a_full_store_is_emptied():
    enc = tokens.UnitEncoder(units=50)
    for k in range(5):
        text = " ".join(f"w{k}x{i}," for i in range(60))
        assert enc.encode(pa.array([text]))[0].tolist() == _ids(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=700), max_size=5), st.integers(50, 100))
def test_files_round_trip(docs, percentile):
    lens = np.array([len(d) for d in docs], np.int64)
    ids = np.array([i for d in docs for i in d], np.uint32)
    keys = [None if i == 1 else i - 3 for i in range(len(docs))]
    k, n, back = token_files.unpack(token_files.pack(ids, lens, keys, percentile))
    assert k == keys and n.tolist() == lens.tolist() and back.tolist() == ids.tolist()


def test_damaged_files_are_refused():
    with pytest.raises(ValueError):
        token_files.unpack(b"XXXX" + bytes(60))


def _expected(rows):
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*_ids(r[1]), 2]
        out.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_token_files_of_odd_documents(odd, odd_rows, tmp_path):
    files = token_files.write(odd, file_ids=500)
    got = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(files).orderBy("start").collect()]
    assert sorted(map(str, got)) == sorted(map(str, _expected(odd_rows)))
    rows = token_files.read(files).orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    keys = [r.doc_id for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    assert token_files.export_files(files, str(tmp_path)) == len(list(tmp_path.glob("*.lgpf"))) > 1


def test_empty_tables(empty):
    assert token_files.read(token_files.write(empty)).count() == 0
    assert packing.pack_documents(empty).count() == 0


def _check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_documents(odd, odd_rows):
    rows = packing.pack_documents(odd, 64).collect()
    _check_packing(rows, 64)
    want = []
    for r in odd_rows:
        ids = [*_ids(r[1]), 2]
        head = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(head, len(ids) + 1, 64)]
        want += [(r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_packing_is_tight(spark, small):
    rows = packing.pack_documents(small).collect()
    used = _check_packing(rows, 1024)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300))
def test_plans_place_every_piece_once(lengths):
    h = np.bincount(lengths, minlength=51)
    plan = packing.plan(h, 50)
    length = np.repeat(np.arange(51), h)
    rank = np.concatenate([np.arange(n) for n in h]) if lengths else np.zeros(0, np.int64)
    if not lengths:
        assert plan.sequences == 0
        return
    seq, off = plan.assign(length, rank)
    seen = {}
    for s, o, n in zip(seq.tolist(), off.tolist(), length.tolist(), strict=True):
        seen.setdefault(s, []).append((o, n))
    assert len(seen) == plan.sequences
    for parts in seen.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 50


def test_fit_follows_the_histogram():
    h = np.zeros(101)
    h[[30, 70, 20, 50]] = [40, 40, 10, 5]
    patterns = packing.exact_patterns(np.flatnonzero(h), 100)
    x = packing.fit(patterns, h)
    used = sum(v * np.bincount(p, minlength=101) for v, p in zip(x, patterns, strict=True))
    # the least-squares optimum: no slope along a used pattern, none downwards along an unused one
    miss = np.clip(np.arange(101) / 25.25, 0.1, 1.0) * (used - h)
    miss[0] = 0
    slope = np.array([miss[p[p > 0]].sum() for p in patterns])
    assert (x >= 0).all() and (np.abs(slope[x > 1e-6]) < 1e-3).all() and (slope > -1e-3).all()


def test_ids_don_t_depend_on_slices_or_store(monkeypatch):
    """The library gets pieces a few at a time; a small store is emptied and filled again."""
    from lumigrid.llm import tokens

    calls = []
    plain = tokens.UnitEncoder()
    texts = pa.array([" ".join(f"w{i * j % 97} x{i}, Yes{j}." for j in range(40)) for i in range(12)] + [None, ""])
    want = [[e for e in plain.tokenizer.encode(t or "", add_special_tokens=False).ids] for t in texts.to_pylist()]
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    small = tokens.UnitEncoder(units=20)

    class Library:
        def encode_batch_fast(self, pieces, **more):
            calls.append(len(pieces))
            return real.encode_batch_fast(pieces, **more)

    real, small.tokenizer = small.tokenizer, Library()
    for _ in range(2):
        ids, lens = small.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == want
    assert calls and max(calls) <= 7


def _counted(enc, monkeypatch):
    """Wraps both tokenizers of an encoder; the list grows by the inputs of each call."""
    sent = []

    class Counted:
        def __init__(self, real):
            self.real = real

        def encode_batch_fast(self, pieces, **more):
            sent.extend(pieces)
            return self.real.encode_batch_fast(pieces, **more)

    monkeypatch.setattr(enc, "tokenizer", Counted(enc.tokenizer))
    monkeypatch.setattr(enc, "words", Counted(enc.words))
    return sent


@pytest.mark.parametrize("ending", ["", ".", ",\nAnd", "'s", "!?", "\n\n", "\u3002"])
def test_new_units_go_to_the_library_in_lines(ending, monkeypatch):
    """One call's overhead for many new units, whatever their kind; one by one they took most of op1's and op7's time."""
    enc = tokens.UnitEncoder()
    sent = _counted(enc, monkeypatch)
    text = "Begin " + " ".join(f"{'aeiouñö'[i % 7]}{chr(97 + i % 26)}w{'xyz'[i % 3]}{chr(97 + i // 26 % 26)}{i}{ending}" for i in range(3000))
    assert enc.encode(pa.array([text]))[0].tolist() == _ids(text)
    assert len(sent) <= 12


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZéßÿœжя×÷²0 7  .,'\n\t\0\x1c\x7f\x85\xa0¡_日́😀\u3000ΑΩҁ҂")), max_size=40), max_size=6))
def test_lines_of_odd_units_equal_the_library(texts):
    enc = test_lines_of_odd_units_equal_the_library.enc
    enc._empty()
    ids, lens = enc.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [_ids(t) for t in texts] or not texts


test_lines_of_odd_units_equal_the_library.enc = tokens.UnitEncoder()


def test_every_character_beside_letters_digits_and_signs():
    """The classes of bytes agree with the split pattern's: each character up to U+0600 between, before and after runs."""
    marks = [chr(c) for c in range(1, 0x600)]
    texts = [f"b a{c}b7{c}8.{c}, {c}ab {c}7 .{c}{c}x, a{c}" for c in marks]
    ids, lens = tokens.UnitEncoder().encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [_ids(t) for t in texts]


def test_tokens_that_don_t_spell_their_bytes(monkeypatch):
    """Where lines can't be cut by bytes, units go one by one."""
    enc = tokens.UnitEncoder()
    monkeypatch.setattr(enc, "widths", enc.widths + 1)
    text = "One two, three's four. 5 six"
    assert enc.encode(pa.array([text]))[0].tolist() == _ids(text)
