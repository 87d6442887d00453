"""Jaccard classes and substring removal against plain Python."""

import hashlib
import re

import numpy as np
import pytest

from lumigrid.llm import components, jaccard, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sets(rows, k):
    out = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out.setdefault(doc, []).append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    return out


def _classes(sets, percent):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = root(a), root(b)
                        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_classes_of_small_documents(small, small_rows, k, percent):
    sets = _sets([(d, r.text) for d, r in small_rows.items()], k)
    want = _classes(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(small, k, percent).collect()}
    assert got == {d: (len(sets[d][0]), want[d]) for d in sets}


def test_classes_of_odd_documents(odd, odd_rows):
    rows = jaccard.classes(odd).collect()
    assert len(rows) == len(odd_rows)
    want = _classes(_sets([(r[0], r[1]) for r in odd_rows if r[0] is not None], 4), 85)
    for r in rows:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    kept = {r.doc_id for r in jaccard.keep_one(odd, 4, 85).collect()}
    assert kept == {None, *(d for d, c in want.items() if d == c)}


def test_keep_one_of_null_and_repeated_ids(spark):
    text = lambda c, edit=None: " ".join(f"{c}{j}" if j != edit else "other" for j in range(200))
    rows = [(5, text("a")), (5, text("b")), (5, text("b")), (None, text("c")), (None, text("c")), (None, text("c", 100)), (None, text("b", 50)), (None, text("d")), (3, text("e")), (3, text("a", 7)), (None, ""), (None, None), (8, "")]
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    near_c = [t for d, t in got if d is None and t and t.startswith("c0 ")]
    assert len(near_c) == 1
    assert sorted(map(str, got)) == sorted(map(str, [(3, text("a", 7)), (3, text("e")), (5, text("b")), (None, near_c[0]), (None, text("d")), (None, ""), (None, None), (8, "")]))


def test_empty_tables(empty):
    assert jaccard.classes(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    assert substrings.deduplicate(empty).count() == 0


def test_chains_of_near_copies_are_one_class(spark):
    base = [f"w{i}" for i in range(200)]
    rows, words = [], list(base)
    for i in range(30):  # each differs from the next a little, the ends a lot
        rows.append((i + 100, " ".join(words)))
        words[(i * 7) % 200] = f"new{i}"
    rows += [(1000 + i, " ".join(f"z{i}_{j}" for j in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()}
    assert got == _classes(_sets(rows, 4), 85) and got[129] == 100


def test_search_finds_all_pairs_the_bound_allows():
    rng = np.random.default_rng(1)
    vec = rng.poisson(3, size=(300, jaccard.GROUPS)).astype(np.int64)
    vec[150:] = vec[:150] + (rng.random((150, jaccard.GROUPS)) < 0.1)
    group, label = rng.integers(0, 4, 300), rng.integers(0, 50, 300)
    n = vec.sum(1)
    order = np.lexsort((n, group))
    group, label, n, vec = group[order], label[order], n[order], vec[order]
    i, j = jaccard.Forest(group, n, vec, 85).search(np.arange(300), np.arange(300), label)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if group[a] == group[b] and label[a] != label[b] and np.minimum(vec[a], vec[b]).sum() >= -(-85 * (n[a] + n[b]) // 185)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want
    root = jaccard.families(group, n, jaccard.Vectors(list(vec)), 85, np.arange(300), label)
    assert root.tolist() == _roots(300, want)


def _roots(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def _family(n, size, seed, edits):
    """Copies of one text with a few words changed, some near the threshold, in one group of tokens."""
    rnd = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rnd.choice(size, int(rnd.integers(0, edits)), False):
            words[at] = f"n{i}_{at}"
        rows.append((i * 3 % 1009, " ".join(words[: size - int(rnd.integers(0, 9))])))
    return rows


@pytest.mark.parametrize("part_rows,part_shingles", [(2000, 6_000_000), (40, 6_000_000), (2000, 4_000)])
def test_groups_of_near_copies_whole_and_split(spark, monkeypatch, part_rows, part_shingles):
    """A group above the limits meets part by part, in two rounds, with the same result."""
    monkeypatch.setattr(jaccard, "PART_ROWS", part_rows)
    monkeypatch.setattr(jaccard, "PART_SHINGLES", part_shingles)
    monkeypatch.setattr(jaccard, "HELD_ROWS", 30)
    monkeypatch.setattr(jaccard, "HELD_SHINGLES", 1000)
    rows = _family(220, 200, 3, 9) + [(2000 + i, t) for i, t in _family(60, 90, 4, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = _classes(_sets(rows, 4), 85)
    assert len(set(want.values())) > 20 and max(np.unique(list(want.values()), return_counts=True)[1]) > 60
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def _left(rows, length):
    """n_bytes, removed, spans, digest by plain search over all strings."""
    seen, out = {}, {}
    for doc, text in sorted({(-1 if d is None else d, t or "") for d, t in rows}):
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if seen.setdefault(w, (doc, i)) != (doc, i):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("spread", [16, 1])
def test_substrings_of_odd_documents(odd, odd_rows, monkeypatch, hot, spread):
    monkeypatch.setattr(substrings, "SPREAD", spread)
    if hot:
        monkeypatch.setattr(substrings, "HOT", 400)
    got = {(-1 if r.doc_id is None else r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.deduplicate(odd).collect()}
    assert got == _left([(r[0], r[1]) for r in odd_rows], 100)


def test_substrings_of_small_documents(small, small_rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.deduplicate(small).collect()}
    assert got == _left([(d, r.text) for d, r in small_rows.items()], 100)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("spread", [16, 1])
def test_substrings_of_null_and_repeated_ids(spark, monkeypatch, hot, spread):
    """Rows that share an id or have none are documents of their own, by their texts."""
    monkeypatch.setattr(substrings, "SPREAD", spread)
    if hot:
        monkeypatch.setattr(substrings, "HOT", 400)
    shared = " ".join(f"passage{i}" for i in range(14))
    texts = [" ".join(f"{c}{j}" for j in range(n)) + tail for c, n, tail in (("a", 5, shared), ("b", 90, shared + "x"), ("c", 300, "y" + shared), ("d", 2, ""), ("e", 40, "z" + shared + "w"), ("f", 500, ""))]
    rows = [(None, t) for t in texts] + [(7, t + "!") for t in texts] + [(-(1 << 63), texts[1]), (None, texts[2]), (7, texts[1] + "!"), (9, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = docs.select("doc_id", "text", substrings.F.xxhash64("text", substrings.F.col("doc_id").isNull()).alias("key")).distinct().collect()
    order = sorted(keyed, key=lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id, r.key))
    want = _left([(i, r.text) for i, r in enumerate(order)], 100)
    place = {(r.doc_id, r.text): i for i, r in enumerate(order)}
    assert sorted(map(str, ((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substrings.deduplicate(docs).collect()))) == sorted(map(str, ((d, want[place[d, t]]) for d, t in rows)))


def test_expansion_classes_are_those_of_the_prefixes():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(97, 100, 400), np.tile(rng.integers(97, 100, 30), 5), [0]]).astype(np.uint8)
    order, interval = substrings.expand(text, 12)
    raw = text.tobytes() + bytes(20)
    by = {}
    for row, at in enumerate(order.tolist()):
        by.setdefault(int(interval[row]), set()).add(raw[at : at + 12])
    assert all(len(s) == 1 for s in by.values())
    assert len(by) == len({raw[i : i + 12] for i in range(len(text))})
