"""N-gram Jaccard join with count-vector R-trees (operator 5).

A document's set holds its distinct k-word shingles as 64-bit hashes. Documents with equal sets become one
node. Tokens (shingles) are ordered the same way everywhere - rare ones by hash first, the few very frequent
ones last - and two sets that meet the threshold share a token among the first n - ceil(t n) + 1 of either, so
documents meet by these prefix tokens only. A token's smallest document is its hub; all documents that share a
token with one hub form a group, in which each of them lies once however many tokens it shares. So any two
documents with a common prefix token are in one group.

Inside a group the count vectors decide: shingles are hashed into cells, a document is the point of its cell
counts, and the overlap of two sets is at most the sum of the coordinate minima. The points of a group form an
R-tree over ``GROUPS`` coarse cells; a box whose summed minima with a point can't reach the overlap the threshold
needs is skipped with all it holds, and what it leaves is bounded again with more cells. The bound is applied
twice. First the vectors alone are shuffled, and only documents that the bound leaves a partner go on, as
clusters. Then the texts of a cluster (of all clusters that share documents, if they are few) meet in one task,
where finer vectors bound and the hash sets verify each pair. No pair leaves a task: documents that are linked already, even through others, aren't compared again, and
what a task hands on are the edges of a spanning forest, at most one a document.

A group above ``PART_ROWS`` documents or ``PART_SHINGLES`` shingles is split by bands of set size (the width of a
band is the threshold's ratio, so only neighbouring bands can link) and by a hash, each part with a copy of the
hub. Its parts meet in a second round, in which the group's largest component isn't held against itself: only
the others, part against part, against each other and against it. No document is dropped in either round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, words
from .components import components

GROUPS, FINEST, FAN = 32, 4096, 8
#: Cells of the bounds between the tree's and a document's own.
MIDDLE = 256
#: A token held by this many documents of one chunk counts as frequent; so many of them at most go last in the order.
OFTEN, FREQUENT = 4, 50_000
#: What a task compares at once: a larger group is split.
PART_ROWS, PART_SHINGLES = 2_000, 6_000_000
#: What a task holds before it works: whole groups, at least so many rows or shingles.
HELD_ROWS, HELD_SHINGLES = 10_000, 1_000_000
#: Documents of a group that descend the tree together, at most.
SLICE = 32
_CHUNK = 3 << 18


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending in each, and the n + 1 bounds. Shorter texts have one shingle of all words."""
    w = words.scan(texts, lower=True)
    h, at = w.windows(k)
    owner = w.owner[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = w.counts[short] > j
            extra[has] = extra[has] * np.uint64(0x9E3779B97F4A7C15) + w.hash[np.minimum(w.first[short] + j, len(w.hash) - 1)[has]]
        h = np.concatenate([h, words.mix(extra + w.counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.searchsorted(owner[keep], np.arange(len(texts) + 1))


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of sizes a and b meet the threshold: 100 I >= percent (a + b - I)."""
    return -(-percent * (a + b) // (100 + percent))


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """The tokens that many documents share, most frequent last: the tail of the common order.

    Counted over all documents, per chunk; only tokens with ``OFTEN`` documents in a chunk are sent on, and the
    ``FREQUENT`` largest sums stay. Any order is right for the join; this one keeps frequent tokens out of prefixes.
    """
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, size=_CHUNK):
            h = np.sort(shingle_sets(part.column(1), k)[0])
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
            n = np.diff(edge)
            often = np.flatnonzero(n >= OFTEN)
            if len(often):
                yield common.batch_of(schema, h[edge[often]].view(np.int64), n[often])

    rows = common.texts(docs).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.array([r.token for r in reversed(rows)], np.int64).view(np.uint64)


NODES = "doc_id long, n long, key_a long, key_b long, vec binary, prefix array<long>, often array<long>"
_NODES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("vec", pa.binary()), ("prefix", pa.list_(pa.int64())), ("often", pa.list_(pa.int64()))])


def _counts(h: np.ndarray, first: np.ndarray, share: int) -> list[np.ndarray]:
    """Cell counts of each set, in about size / ``share`` cells (a power of two). Half the cells are sums of pairs of cells."""
    n = np.diff(first)
    cells = np.clip(np.left_shift(1, np.log2(np.maximum(n, 1)).astype(np.int64)) // share, GROUPS, FINEST)
    edge = np.concatenate([[0], np.cumsum(cells)])
    place = np.repeat(edge[:-1], n) + (h >> np.uint64(40)).astype(np.int64) % np.repeat(cells, n)
    flat = np.bincount(place, minlength=int(edge[-1]))
    return [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _pack(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each, that size first."""
    width = 1 if (top := int(counts.max())) < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def nodes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Set size, set key, count vector and prefix tokens of each document; the frequent ones among these in ``often``."""
    tail = frequent(docs, k)
    by = np.argsort(tail)
    tokens, place = tail[by], by + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, size=_CHUNK):
            h, first = shingle_sets(part.column(1), k)
            n, owner = np.diff(first), np.repeat(np.arange(part.num_rows), np.diff(first))
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(h + np.uint64(salt)))]) for salt in (1, 2)]
            keys = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
            vec = [_pack(c) for c in _counts(h, first, 4)]
            rank = np.zeros(len(h), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                rank = np.where(tokens[at] == h, place[at], 0)
                order = np.lexsort((h, rank, owner))
                h, rank = h[order], rank[order]
            size = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            take = np.arange(len(h)) - np.repeat(first[:-1], n) < np.repeat(size, n)
            lists = []
            for mask in (take & (rank == 0), take & (rank > 0)):
                edge = np.concatenate([[0], np.cumsum(mask)])[first]
                lists.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(h[mask].view(np.int64))))
            yield common.batch_of(_NODES, part.column(0), n, *keys, vec, *lists)

    return common.table(common.texts(docs).mapInArrow(run, NODES), "shingle-nodes")


class Vectors:
    """Count vectors of rows, each with its own number of cells; folded to fewer where two rows are compared."""

    def __init__(self, counts: list[np.ndarray]):
        self.size = np.array([len(c) for c in counts], np.int64)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.own = {}
        for g in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == g)
            self.own[g] = (at, np.stack([counts[i] for i in at.tolist()]))

    def level(self, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts in so many cells of all rows that have as many, and each row's place among them."""
        if cells not in self.levels:
            place = np.cumsum(self.size >= cells) - 1
            out = np.zeros((int((self.size >= cells).sum()), cells), np.int32)
            for g, (at, m) in self.own.items():
                if g >= cells:
                    out[place[at]] = m.reshape(len(m), -1, cells).sum(1)
            self.levels[cells] = place, out.astype(np.uint8) if out.size and out.max() < 256 else out
        return self.levels[cells]

    def reach(self, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which pairs of rows have summed minima of at least ``need``, in ``MIDDLE`` and then in all cells both have."""
        left = np.arange(len(i))
        for most in (MIDDLE, FINEST):
            cells = np.minimum(np.minimum(self.size[i[left]], self.size[j[left]]), most)
            ok = np.zeros(len(left), bool)
            for c in np.unique(cells).tolist():
                at = np.flatnonzero(cells == c)
                place, m = self.level(c)
                ok[at] = _minima(m, place[i[left[at]]], m, place[j[left[at]]]) >= need[left[at]]
            left = left[ok]
        out = np.zeros(len(i), bool)
        out[left] = True
        return out


def _minima(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    step = max(1, (1 << 21) // a.shape[1])
    for s in range(0, len(i), step):
        out[s : s + step] = np.minimum(a[i[s : s + step]], b[j[s : s + step]]).sum(1, dtype=np.int32)
    return out


class Forest:
    """One R-tree for each group of rows; rows come sorted by (group, n).

    Leaves are runs of ``FAN`` rows, a node above covers ``FAN`` nodes. A node's box counts by its upper corner, its
    smallest n, its last row and the range of its rows' roots.
    """

    def __init__(self, group: np.ndarray, n: np.ndarray, vec: np.ndarray, percent: int):
        self.n, self.vec, self.percent = n, vec, percent
        self.tree = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
        self.levels = []  # each: first child, number of children, upper corner, smallest n, last row
        own, low, last, corner = self.tree, n, np.arange(len(n)), vec
        while True:
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            size = np.diff(np.append(start, len(own)))
            if self.levels and (size == 1).all():
                break
            first = np.flatnonzero((np.arange(len(own)) - np.repeat(start, size)) % FAN == 0)
            count = np.diff(np.append(first, len(own)))
            corner, low, last = np.maximum.reduceat(corner, first), np.minimum.reduceat(low, first), last[first + count - 1]
            self.levels.append((first, count, corner, low, last))
            own = own[first]

    def search(self, query: np.ndarray, *apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, later row of its group) that the bound allows and that differ in each of ``apart``."""
        n, percent, node = self.n, self.percent, self.tree[query]
        ranges = []
        for values in apart:
            lo = hi = values
            for first, *_ in self.levels:
                lo, hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
                ranges.append((values, lo, hi))
        for depth in range(len(self.levels) - 1, -1, -1):
            first, count, corner, low, last = self.levels[depth]
            # rows are sorted by n, so partners after the query are no smaller; too large ones are skipped by size
            ok = (last[node] > query) & (100 * n[query] >= percent * low[node])
            for values, lo, hi in ranges[depth :: len(self.levels)]:
                ok &= (lo[node] != values[query]) | (hi[node] != values[query])
            query, node = query[ok], node[ok]
            ok = _minima(self.vec, query, corner, node) >= needed(n[query], np.maximum(low[node], n[query]), percent)
            query, node = query[ok], node[ok]
            many = count[node]
            child = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[node], many)
            query, node = np.repeat(query, many), child
        ok = (node > query) & (100 * n[query] >= percent * n[node])
        for values in apart:
            ok &= values[query] != values[node]
        query, node = query[ok], node[ok]
        ok = _minima(self.vec, query, self.vec, node) >= needed(n[query], n[node], percent)
        return query[ok], node[ok]


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (each row's smallest row, as far as known) after rows i and j are joined."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (deeper := root[root] != root).any():
            root = np.where(deeper, root[root], root)


def families(group: np.ndarray, n: np.ndarray, vectors: Vectors, percent: int, root: np.ndarray, apart: np.ndarray | None = None, exact: Callable | None = None) -> np.ndarray:
    """Roots of the rows after all pairs of a group that the bound (and ``exact``, if given) allows are joined.

    Rows come sorted by (group, n). Pairs with one root, or with one value of ``apart``, aren't looked at. The first rows
    of each group search alone, later ones in growing slices, so a group of near copies is one before the
    slices are wide.
    """
    if not len(group):
        return root
    forest = Forest(group, n, vectors.level(GROUPS)[1], percent)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, len(group)))
    rank = np.arange(len(group)) - np.repeat(start, size)
    at, width = 0, 1
    while at < size.max() - 1:
        i, j = forest.search(np.flatnonzero((rank >= at) & (rank < at + width)), root, *([apart] if apart is not None else []))
        ok = vectors.reach(i, j, needed(n[i], n[j], percent))
        i, j = i[ok], j[ok]
        if exact is not None and len(i):
            ok = exact(i, j)
            i, j = i[ok], j[ok]
        root = merge(root, i, j)
        at, width = at + width, min(2 * width, SLICE)
    return root


def _first_of(values: np.ndarray) -> np.ndarray:
    """The first row that holds each row's value."""
    _, first, back = np.unique(values, return_index=True, return_inverse=True)
    return first[back]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """A number for each run of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


CLUSTERS = "hub long, part long, root long, doc_id long, label long, n long"
_CLUSTERS = pa.schema([(c, pa.int64()) for c in ("hub", "part", "root", "doc_id", "label", "n")])


def clusters(rows: DataFrame, percent: int) -> DataFrame:
    """Of the groups (hub, part) of rows (doc_id, label, n, vec): what the bound leaves a partner of another label, by clusters."""

    def close(t: pa.Table) -> pa.RecordBatch:
        hub, part, doc, label, n = (t.column(i).to_numpy() for i in range(5))
        group = _changes(hub, part)
        vectors = Vectors([_unpack(v) for v in t.column(5).to_pylist()])
        root = families(group, n, vectors, percent, np.arange(len(n)), label)
        keep = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        keep = keep[np.unique(np.stack([root[keep], doc[keep]]), axis=1, return_index=True)[1]]
        return common.batch_of(_CLUSTERS, *(c[keep] for c in (hub, part, doc[root], doc, label, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                group = _changes(t.column(0).to_numpy(), t.column(1).to_numpy())
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield close(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield close(pa.Table.from_batches(held).combine_chunks())

    rows = rows.select("hub", "part", "doc_id", "label", "n", "vec").repartition("hub", "part").sortWithinPartitions("hub", "part", "n", "doc_id")
    return common.table(rows.mapInArrow(run, CLUSTERS), "clusters")


def gathered(found: DataFrame) -> DataFrame:
    """Clusters that share documents as one, so that a text travels once; where that would be above the limits, the clusters stay as they are."""
    family = components(found.select(F.col("root").alias("u"), F.col("doc_id").alias("v")))
    family = found.join(family.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("family", F.coalesce("component", "doc_id"))
    rows = written = common.table(family.select(*found.columns, "family"), "families")
    sizes = rows.select("family", "doc_id", "n").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    above = sizes.filter((F.col("rows") > PART_ROWS) | (F.col("shingles") > PART_SHINGLES)).select("family", F.lit(True).alias("above"))
    rows = rows.join(above, "family", "left")
    own = F.col("above").isNull()
    place = (F.when(own, F.lit(-1)).otherwise(F.col(c)).alias(c) for c in ("hub", "part"))
    out = common.table(rows.select(*place, F.when(own, F.col("family")).otherwise(F.col("root")).alias("root"), "doc_id", "label").distinct(), "gathered")
    common.drop(written)
    return out


def links(found: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): a spanning forest of the documents of each cluster whose sets meet the threshold, from whole texts."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def close(rows: list[np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hub, part, base, doc, label, n = rows
        start = np.cumsum(n) - n
        order = np.lexsort((doc, n, _changes(hub, part, base)))
        sets = [h[a:b] for a, b in zip(start[order].tolist(), (start + n)[order].tolist(), strict=True)]
        doc, label, n, group = doc[order], label[order], n[order], _changes(hub, part, base)[order]

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            shared = np.zeros(len(i), np.int64)
            for at, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                few, many = sets[a], sets[b]
                shared[at] = (many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()
            return shared >= needed(n[i], n[j], percent)

        vectors = Vectors(_counts(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]), 1))
        was = np.zeros(len(n), np.int64)
        for lo, hi in zip(*_runs(group), strict=True):
            was[lo:hi] = lo + _first_of(label[lo:hi])
        root = families(group, n, vectors, percent, was, exact=exact)
        new = np.unique(np.stack([doc[root], doc[was]])[:, root != was], axis=1)
        return new[0], new[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        limit = HELD_SHINGLES

        def whole() -> tuple[list[np.ndarray], np.ndarray]:
            return [np.concatenate(c) for c in zip(*(rows for rows, _ in held), strict=True)], np.concatenate([h for _, h in held])

        for part in common.chunks(batches, size=_CHUNK):
            h, first = shingle_sets(part.column(5), k)
            has = np.diff(first) > 0
            held.append(([*(part.column(i).to_numpy()[has] for i in range(5)), np.diff(first)[has]], h))
            if sum(len(h) for _, h in held) >= limit:
                rows, h = whole()
                group = _changes(*rows[:3])
                cut = int(np.searchsorted(group, group[-1]))  # the last cluster may go on
                at = int(rows[5][:cut].sum())
                if cut:
                    yield common.batch_of(out, *close([c[:cut] for c in rows], h[:at]))
                held = [([c[cut:].copy() for c in rows], h[at:].copy())]
                limit = max(HELD_SHINGLES, 2 * (len(h) - at))
        if sum(len(h) for _, h in held):
            yield common.batch_of(out, *close(*whole()))

    rows = found.join(common.sift(common.texts(docs), found), "doc_id").select("hub", "part", "root", "doc_id", "label", "text")
    rows = rows.repartition("hub", "part", "root").sortWithinPartitions("hub", "part", "root")
    return common.table(rows.mapInArrow(run, "u long, v long"), "links")


def _runs(group: np.ndarray) -> tuple[list[int], list[int]]:
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() if len(group) else []
    return start, [*start[1:], len(group)] if start else []


def _fan(rows: str, shingles: str) -> F.Column:
    return F.ceil(F.greatest(F.col(rows) / PART_ROWS, F.col(shingles) / PART_SHINGLES)).cast("int")


def _part(fan: F.Column) -> F.Column:
    """A number for each (band, hash) of a split group, from 1."""
    return F.col("band") * (1 << 24) + F.pmod(F.xxhash64("doc_id"), fan) + 1


def _second(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, part, doc_id, label) of the second round: which parts of a split group still have to meet, and who is in them.

    ``placed``: (hub, doc_id, n, band, part), the rows of split groups; ``labels``: (node, component).
    """
    members = placed.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("hub", "doc_id", "n", "band", "part", F.coalesce("component", "doc_id").alias("label"))
    members = common.table(members, "members")
    by_label = members.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("rows"))
    most = by_label.groupBy("hub").agg(F.max_by("label", F.struct("rows", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("hub", "most")
    sided = members.join(most, "hub").withColumn("rest", (F.col("label") != F.col("most")).cast("int"))
    fans = sided.filter("rest = 1").groupBy("hub", "band", "rest").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).select("hub", "band", "rest", _fan("rows", "shingles").alias("fan"))
    sided = sided.join(fans, ["hub", "band", "rest"], "left").withColumn("part", F.coalesce(_part(F.col("fan")), "part"))
    sided = common.table(sided.select("hub", "doc_id", "label", "band", "rest", "part"), "sided")
    parts = sided.select("hub", "band", "rest", "part").distinct()
    one, two = (parts.select("hub", *(F.col(c).alias(f"{c}_{side}") for c in ("band", "rest", "part"))) for side in "ab")
    meet = one.join(two, "hub").filter("rest_a = 1 and abs(band_a - band_b) <= 1 and (rest_b = 0 or part_a <= part_b)")
    meet = meet.withColumn("task", F.xxhash64("part_a", "part_b", "rest_b"))
    who = meet.select("hub", "task", F.explode(F.array(F.struct(F.col("rest_a").alias("rest"), F.col("part_a").alias("part")), F.struct(F.col("rest_b").alias("rest"), F.col("part_b").alias("part")))).alias("x")).select("hub", "task", "x.rest", "x.part").distinct()
    return sided.join(who, ["hub", "rest", "part"]).select("hub", F.col("task").alias("part"), "doc_id", "label")


def classes(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each document.

    Null and empty texts have empty sets: size 0, linked with nothing. Rows with equal doc_id count as one
    document. A null doc_id isn't compared and has a null component. An empty table gives no rows.
    """
    table = nodes(docs, k, percent)
    named = table.filter("n > 0 and doc_id is not null")
    reps = common.table(named.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep")), "sets")
    chosen = reps.select(F.col("rep").alias("doc_id"), "key_a", "key_b")
    # most rows of equal sets go here, the others with the points below
    tokens = lambda prefix: common.sift(named.select("doc_id", "n", prefix), chosen).select("doc_id", "n", F.explode(prefix).alias("token"))
    ends = F.min("doc_id"), F.max("doc_id")
    # a token's ends are combined map-side and joined back, so no token's rows are one group: those of the often ones
    # (at most FREQUENT) stay where they are, a large part of the others can be split by AQE
    ends_of = lambda rows: rows.groupBy("token").agg(*(e.alias(c) for e, c in zip(ends, ("hub", "last"), strict=True))).filter("hub < last")
    rare = tokens("prefix").join(ends_of(tokens("prefix")), "token")
    often = tokens("often").join(F.broadcast(ends_of(tokens("often"))), "token")
    both = rare.select("hub", "doc_id", "n").unionByName(often.select("hub", "doc_id", "n"))
    met = common.table(both.groupBy("hub", "doc_id").agg(F.max("n").alias("n")), "meetings")
    points = common.table(named.join(chosen, ["doc_id", "key_a", "key_b"], "left_semi").select("doc_id", "n", "vec").dropDuplicates(["doc_id", "n"]), "points")

    banded = met.withColumn("band", F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int"))
    per = banded.groupBy("hub", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    above = per.groupBy("hub").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")).filter((F.col("rows") > PART_ROWS) | (F.col("shingles") > PART_SHINGLES)).select("hub")
    large = common.table(per.join(above, "hub", "left_semi").select("hub", "band", _fan("rows", "shingles").alias("fan")), "split-groups")
    split = not large.isEmpty()
    whole = met.select("hub", F.lit(0).cast("long").alias("part"), "doc_id")
    if split:
        whole = whole.join(large, "hub", "left_anti")
        placed = banded.join(large, ["hub", "band"]).withColumn("part", _part(F.col("fan")).cast("long"))
        hubs = large.select("hub", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("at"), (F.col("band") * (1 << 24)).alias("base")).select("hub", (F.col("base") + F.col("at") + 1).cast("long").alias("part"), F.col("hub").alias("doc_id"))
        whole = whole.unionByName(placed.select("hub", "part", "doc_id").unionByName(hubs).distinct())

    def resolve(rows: DataFrame) -> DataFrame:
        found = clusters(rows.join(points, "doc_id"), percent)
        together = gathered(found)
        common.drop(found)
        edges = links(together, docs, k, percent)
        common.drop(together)
        return edges

    edges = resolve(whole.withColumn("label", F.col("doc_id")))
    joined = components(edges)
    if split:
        edges = edges.unionByName(resolve(_second(placed.select("hub", "doc_id", "n", "band", "part"), joined)))
        joined = components(edges)
    common.drop(met, points)
    parts = reps.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("key_a").alias("part_a"), F.col("key_b").alias("part_b"), F.coalesce("component", "rep").alias("part"))
    full = table.select("doc_id", "n", "key_a", "key_b").join(parts, (F.col("n") > 0) & F.col("doc_id").isNotNull() & (F.col("key_a") == F.col("part_a")) & (F.col("key_b") == F.col("part_b")), "left")
    out = common.table(full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("part", "doc_id").alias("component_id")), "classes")
    common.drop(table, reps)
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, columns unchanged, without those that a smaller doc_id of their component stands for.

    A document is what has one doc_id and text: rows that repeat both go down to one, equal doc_ids with different
    texts are compared like any others. A null doc_id comes after all others. Documents with an empty set stay (with
    a null doc_id all their rows).
    """
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        gone = common.table(classes(docs, k, percent).filter("component_id < doc_id").select("doc_id"), "gone")
        return common.without(docs, gone)
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    ids = docs.select(F.col("doc_id").alias("own"), key.alias("key")).distinct().orderBy(F.asc_nulls_last("own"), "key")
    ids = common.table(ids.withColumn("id", F.monotonically_increasing_id()), "row-ids")  # grows in the sorted order
    same = docs["doc_id"].eqNullSafe(ids["own"]) & (key == ids["key"])
    renamed = common.table(docs.join(ids, same).select(ids["id"].alias("doc_id"), docs["text"]), "renamed")
    found = classes(renamed, k, percent)
    common.drop(renamed)
    stays = found.filter("component_id >= doc_id").select(F.col("doc_id").alias("stay"), (F.col("n_shingles") == 0).alias("empty")).distinct()
    rows = docs.join(ids, same).join(stays, ids["id"] == stays["stay"])
    number = F.row_number().over(Window.partitionBy("stay").orderBy("text"))
    rows = rows.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), stays["stay"], stays["empty"], docs["text"]).withColumn("number", number)
    return rows.filter("number = 1 or (empty and doc.doc_id is null)").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
