"""Best-fit packing by length patterns and non-negative least squares (operator 1).

Only the histogram of piece lengths reaches the driver (at most ``capacity`` numbers). There, every pattern of
one to three lengths that fills a sequence exactly is enumerated, repeat counts are fitted to the histogram by
non-negative least squares, rounded so that running totals are kept, and cut back to what there is; what is
left over is packed best-fit decreasing, length class by length class. The outcome is a list of
(pattern, repeats). A piece's place follows from its rank among the pieces of its length: each task numbers
its own pieces while it tokenizes, and a small table of counts per (task, length) turns these into global
ranks. So no group of documents is ever gathered, and a hot length is spread over the tasks that read it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens
from .token_files import with_end

CAPACITY = 1024
#: Of the fitted counts; best-fit gets the rest, so that it still meets every length.
FITTED_SHARE = 0.9
#: Text bytes tokenized at once.
_CHUNK = 1 << 20


def exact_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of up to three present lengths (descending, 0: none) whose sum is ``capacity``."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    has[0] = False
    rows = [np.array([[capacity, 0, 0]])] if has[capacity] else []
    for first in range(capacity - 1, -(-capacity // 3) - 1, -1):
        if not has[first]:
            continue
        rest = capacity - first
        second = np.arange(min(first, rest), -(-rest // 2) - 1, -1)
        third = rest - second
        ok = has[second] & ((third == 0) | has[third])
        rows.append(np.stack([np.full(ok.sum(), first), second[ok], third[ok]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fit(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared difference between pattern use and histogram (accelerated projected gradient)."""
    p, size = len(patterns), len(histogram)
    if not p:
        return np.zeros(0)
    filled = patterns > 0
    # short lengths fill gaps later, so their misfit weighs less
    weight = np.clip(np.arange(size) / (size / 4), 0.1, 1.0)
    use = np.bincount(patterns.ravel(), filled.ravel(), size)
    step = 1.0 / (3.0 * max(1.0, (weight * use).max()))
    x = y = np.zeros(p)
    t = 1.0
    for _ in range(rounds):
        used = np.bincount(patterns.ravel(), np.repeat(y, 3) * filled.ravel(), size)
        miss = weight * (used - histogram)
        miss[0] = 0
        new = np.maximum(y - step * miss[patterns].sum(1), 0.0)
        if ((y - new) * (new - x)).sum() > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts per length: each step places a whole class into the fullest open class that takes it."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        while todo:
            fits = [r for r in room if r >= length]
            if fits:
                space = min(fits)
                pattern, count = room[space].pop()
                if not room[space]:
                    del room[space]
                take = min(count, todo)
                if count > take:
                    room.setdefault(space, []).append((pattern, count - take))
                room.setdefault(space - length, []).append(((*pattern, length), take))
                todo -= take
            else:
                many = min(capacity // length, todo)
                bins = todo // many
                room.setdefault(capacity - many * length, []).append(((length,) * many, bins))
                todo -= bins * many
    return [x for group in room.values() for x in group]


@dataclass(frozen=True)
class Plan:
    """Which sequence and place the r-th piece of each length gets: rank intervals by length."""

    sequences: int
    first: np.ndarray  # interval rows of length L: first[L]:first[L + 1]
    rank: np.ndarray  # first rank of the interval
    base: np.ndarray  # its first sequence
    each: np.ndarray  # pieces of this length in one sequence
    place: np.ndarray  # offset of the first of them

    def assign(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.int64(1) << 40
        row = np.searchsorted(self.rank + top * np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)), rank + top * length, "right") - 1
        inside = rank - self.rank[row]
        return self.base[row] + inside // self.each[row], self.place[row] + inside % self.each[row] * length


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """``histogram[L]``: pieces of length L, L from 1 to ``capacity``."""
    left = np.asarray(histogram, np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    total = FITTED_SHARE * np.cumsum(fit(patterns, left.astype(float)))
    whole = np.diff(np.floor(total + 0.5), prepend=0).astype(np.int64)
    for i in np.flatnonzero(whole).tolist():
        parts = [int(v) for v in patterns[i] if v]
        repeats = min(int(whole[i]), *(int(left[v]) // parts.count(v) for v in parts))
        if repeats > 0:
            chosen.append((tuple(parts), repeats))
            for v in parts:
                left[v] -= repeats
    chosen += best_fit(left, capacity)
    rows, base, given = [], 0, np.zeros(capacity + 1, np.int64)
    for parts, repeats in chosen:
        place = 0
        for length in dict.fromkeys(parts):
            each = parts.count(length)
            rows.append((length, int(given[length]), base, each, place))
            given[length] += each * repeats
            place += each * length
        base += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(base, np.searchsorted(table[:, 0], np.arange(capacity + 2)), *(table[:, k] for k in range(1, 5)))


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("task_rank", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY, units: int = tokens.STORE_UNITS) -> DataFrame:
    """Tokenizes whole texts; one row per piece. A document's first piece takes what doesn't fill a sequence. A worker remembers ``units``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokens.loaded(vocabulary):
            common.trim()
        enc, task, seen = tokens.encoder(vocabulary, units), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in common.chunks(batches, size=_CHUNK):
            ids, n = with_end(*enc.encode(part.column(1)))
            many = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            head = n - (many - 1) * capacity
            length = np.where(piece == 0, head[owner], capacity)
            start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
            ends, view = 4 * np.cumsum(length), memoryview(ids.astype("<u4")).cast("B")
            crcs = [zlib.crc32(view[hi - 4 * m : hi]) for hi, m in zip(ends.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            same = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(same)) - np.searchsorted(same, same) + seen[same]
            seen += np.bincount(length, minlength=capacity + 1)
            yield common.batch_of(_PIECES, part.column(0).take(pa.array(owner)), piece.astype(np.int32), start, length, crcs, np.full(len(owner), task, np.int32), rank)

    return common.table(common.texts(docs).mapInArrow(cut, _PIECES_SQL), "pieces")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces (a table with length, task, task_rank)."""
    counts = cut.groupBy("task", "length").count()
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # one row a length
        histogram[r.length] = r.n
    places = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("earlier"))
    out = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.assign(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield common.batch_of(out, *b.columns[:5], sequence, offset)

    keyed = cut.join(ranked, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("task_rank") + F.col("earlier")).alias("rank"))
    return keyed.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY, units: int = tokens.STORE_UNITS) -> DataFrame:
    """Packs every document (null text: empty, just the end id) into sequences of at most ``capacity`` ids.

    Empty input gives no rows; repeated rows are packed each; a null doc_id stays null.
    """
    return pack(pieces(docs, capacity, vocabulary, units), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
