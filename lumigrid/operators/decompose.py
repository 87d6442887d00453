"""Principal and independent components of movies, and removal of components.

``px`` rows are (g, p, x). The movie is kept once as a grid of dense tiles. A truncated decomposition is a blocked range finder: a seeded
random matrix is multiplied by the movie and its transpose in turn, and what comes out is made orthonormal by a tall-skinny QR whose
small triangles meet in one task. Factors (a row of a few numbers per pixel or frame) stay tables; the driver sees matrices of
components x components only. Independent components are a fixed-point iteration over the pixel factor, whose steps are sums over pixels.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..shipping import ship

#: Entries on a side of the tiles in which a task sums its products, tiles it holds, values of the movie it takes at once.
TILE, TILES, VALUES = 128, 2_048, 1 << 18


def full_mean(px: DataFrame) -> DataFrame:
    return px.groupBy("p").agg(F.avg("x").alias("mean"))


def centred(px: DataFrame) -> DataFrame:
    return px.join(full_mean(px), "p").select("g", "p", (F.col("x") - F.col("mean")).alias("x"))


_ROWS = "i long, b long, js array<long>, vs array<double>"
_ROW_SCHEMA = pa.schema([("i", pa.int64()), ("b", pa.int64()), ("js", pa.list_(pa.int64())), ("vs", pa.list_(pa.float64()))])


class _Tiles:
    """Sums of products in tiles of the upper half of the Gram matrix, with which entries were seen."""

    def __init__(self):
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, row: np.ndarray, k: np.ndarray, x: np.ndarray) -> None:
        """Entries ``x`` of rows (numbered from 0, ascending) at places ``k``."""
        u, at = np.unique(k, return_inverse=True)
        n = int(row[-1]) + 1
        if n > 1 and n * len(u) > 8 * VALUES:  # rows with few places in common
            cut = np.searchsorted(row, n // 2)
            self.add(row[:cut], k[:cut], x[:cut])
            self.add(row[cut:] - n // 2, k[cut:], x[cut:])
            return
        dense = np.zeros((n, len(u)))
        np.add.at(dense, (row, at), x)
        tile, place = u // TILE, u % TILE
        edges = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(u)]
        for n_before, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            strip = dense[:, lo:hi].T @ dense[:, lo:]
            for lo2, hi2 in zip(edges[n_before:-1], edges[n_before + 1 :], strict=True):
                key = (int(tile[lo]), int(tile[lo2]))
                if key not in self.held:
                    self.held[key] = np.zeros((TILE, TILE)), np.zeros(TILE, bool), np.zeros(TILE, bool)
                sums, left, right = self.held[key]
                sums[np.ix_(place[lo:hi], place[lo2:hi2])] += strip[:, lo2 - lo : hi2 - lo]
                left[place[lo:hi]] = right[place[lo2:hi2]] = True

    def take(self) -> Iterator[pa.RecordBatch]:
        for (i, j), (sums, left, right) in self.held.items():
            js, rows = np.flatnonzero(right), np.flatnonzero(left)
            kept = [js[js >= r] if i == j else js for r in rows]
            columns = [rows + i * TILE, np.full(len(rows), j), [(q + j * TILE).tolist() for q in kept], [sums[r, q].tolist() for r, q in zip(rows, kept, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROW_SCHEMA.types, strict=True)], schema=_ROW_SCHEMA)
        self.held.clear()


def _products(centre: bool):
    """From (o, k, x) sorted by o: each task's sums. Rows of one o stay together; ``centre`` takes their mean off first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = _Tiles()
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

        def use(o, k, x) -> None:
            row = np.cumsum(np.concatenate([[False], o[1:] != o[:-1]]))
            if centre:
                x = x - (np.bincount(row, x) / np.bincount(row))[row]
            tiles.add(row, k, x)

        for batch in batches:
            rest = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
            if len(rest[0]) >= VALUES and rest[0][0] != rest[0][-1]:
                cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last row may go on
                use(*(r[:cut] for r in rest))
                rest = [r[cut:] for r in rest]
                if len(tiles.held) > TILES:
                    yield from tiles.take()
        if len(rest[0]):
            use(*rest)
        yield from tiles.take()

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (i, b): one row of each."""
    now, sums, seen, out = None, np.zeros(TILE), np.zeros(TILE, bool), []

    def close() -> None:
        js = np.flatnonzero(seen)
        out.append({"i": now[0], "b": now[1], "js": (js + now[1] * TILE).tolist(), "vs": sums[js].tolist()})

    for batch in batches:
        starts, js, vs = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
        for n, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != now:
                if now is not None:
                    close()
                now, sums, seen = key, np.zeros(TILE), np.zeros(TILE, bool)
            at = js[starts[n] : starts[n + 1]] - key[1] * TILE
            sums[at] += vs[starts[n] : starts[n + 1]]
            seen[at] = True
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema=_ROW_SCHEMA)
            out.clear()
    if now is not None:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_ROW_SCHEMA)


def gram_rows(px: DataFrame, side: str = "g") -> DataFrame:
    """Parts of the Gram matrix' rows: (i, b, js, vs) with j >= i in the b-th ``TILE`` entries.

    Rows that share the other index meet in one task, which multiplies them densely and keeps sums in tiles; only these sums are
    shuffled again. Pixel traces are centred in the same task, frames by a join with the mean image.
    """
    ship(px.sparkSession)
    other = "p" if side == "g" else "g"
    rows = (px if side == "g" else centred(px)).select(F.col(other).cast("long").alias("o"), F.col(side).cast("long").alias("k"), F.col("x").cast("double").alias("x")).dropna()
    parts = rows.repartition("o").sortWithinPartitions("o").mapInArrow(_products(side == "g"), _ROWS)
    return parts.repartition("i", "b").sortWithinPartitions("i", "b").mapInArrow(_totals, _ROWS)


def gram(px: DataFrame, side: str = "g") -> DataFrame:
    """(i, j, v), i <= j: inner products of frames (``side`` g) or pixel traces (p) of the centred movie."""
    return gram_rows(px, side).select("i", F.explode(F.arrays_zip(F.col("js").alias("j"), F.col("vs").alias("v"))).alias("e")).select("i", "e.j", "e.v")


#: Pixels and frames of a tile of the movie (512 KB of doubles).
SIDE = 256
#: Directions beyond those asked for, rounds of the range finder at most, and the relative change of singular values that ends them.
SPARE, ROUNDS, SETTLED = 12, 40, 1e-11
#: Sides up to here are spanned whole: one round is exact.
SPANNED = 96
#: Values of a factor up to which it goes to all tasks (64 MB); a larger one is joined.
SENT = 8 << 20
#: Partial sums of a product a task holds before it hands them on, and blocks in a batch of them.
SUMS, HANDED = 128, 16

_TILE = "pb long, gb long, ps array<long>, gs array<long>, data binary"
_BLOCK = "b long, ids array<long>, m binary"
_BLOCK_TYPES = pa.schema([("b", pa.int64()), ("ids", pa.list_(pa.int64())), ("m", pa.binary())])


def _dense(cell: pa.Scalar, *shape: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<f8").reshape(shape)


def _ids(column: pa.ListArray, i: int) -> np.ndarray:
    return column[i].values.to_numpy()


def _block(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [[b for b, _, _ in rows], [i.tolist() for _, i, _ in rows], [np.ascontiguousarray(m, "<f8").tobytes() for _, _, m in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK_TYPES.types, strict=True)], schema=_BLOCK_TYPES)


def _tile(t: pa.Table) -> pa.Table:
    """Of the rows (pb, gb, p, g, x) of one tile: a dense matrix. Rows that repeat a place add up."""
    p, at_p = np.unique(t["p"].to_numpy(), return_inverse=True)
    g, at_g = np.unique(t["g"].to_numpy(), return_inverse=True)
    data = np.zeros((len(p), len(g)))
    np.add.at(data, (at_p, at_g), t["x"].to_numpy())
    return pa.table({"pb": t["pb"][:1], "gb": t["gb"][:1], "ps": [p.tolist()], "gs": [g.tolist()], "data": pa.array([data.tobytes()], pa.binary())})


def _blocks(rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks a few at a time, so no task holds more than these beside what they are made from."""
    rows = iter(rows)
    while some := list(islice(rows, HANDED)):
        yield _block(some)


@dataclass
class Factor:
    """Rows of ``width`` numbers per pixel or frame, in blocks of ``SIDE`` ids: (b, ids, m), to be multiplied by ``by`` where that is given.

    Products with small matrices gather in ``by``: whatever their number, a task has one Python worker for them.
    """

    stored: DataFrame
    width: int
    path: str = ""
    by: np.ndarray | None = None

    def _read(self) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
        by, width = self.by, self.width if self.by is None else len(self.by)

        def run(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for i in range(b.num_rows):
                ids = _ids(b.column(1), i)
                m = _dense(b.column(2)[i], len(ids), width)
                yield b.column(0)[i].as_py(), ids, m if by is None else m @ by

        return run

    @property
    def blocks(self) -> DataFrame:
        if self.by is None:
            return self.stored
        read = self._read()
        return self.stored.mapInArrow(lambda batches: (out for b in batches for out in _blocks(read(b))), _BLOCK)

    def rows(self) -> DataFrame:
        """(id, v): an id's numbers as an array."""
        width, read = self.width, self._read()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, ids, m in read(b):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), pa.array(m.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["id", "v"])

        return self.stored.mapInArrow(run, "id long, v array<double>")

    def times(self, m: np.ndarray) -> Factor:
        """The factor's rows times a small matrix; not written."""
        return Factor(self.stored, m.shape[1], by=m if self.by is None else self.by @ m)

    def saved(self, name: str) -> Factor:
        blocks, path = shared.save(self.blocks, name)
        return Factor(blocks, self.width, path)

    def drop(self) -> None:
        if self.path:
            shared.remove(self.stored.sparkSession, self.path)

    def size(self) -> int:
        return (self.stored.agg(F.sum(F.size("ids"))).first()[0] or 0) * self.width


def _folded(df: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray | None]], width: int) -> np.ndarray | None:
    """Folds a factor's blocks inside tasks, then the tasks' results (one small matrix each) in one task."""

    def outer(blocks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step, out = make(), None
            for b in batches:
                for i in range(b.num_rows):
                    raw = _dense(b.column(2 if blocks else 0)[i], -1)
                    out = step(raw.reshape(-1, width) if blocks else raw, not blocks)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(out).tobytes()], pa.binary())], names=["m"])

        return run

    found = df.mapInArrow(outer(True), "m binary").repartition(1).mapInArrow(outer(False), "m binary").collect()
    return np.frombuffer(bytes(found[0].m), "<f8") if found else None


def triangle(f: Factor) -> np.ndarray:
    """The R of a QR of all the factor's rows (width x width)."""
    w = f.width

    def make():
        r = np.zeros((0, w))

        def step(m: np.ndarray, small: bool) -> np.ndarray:
            nonlocal r
            r = np.linalg.qr(np.concatenate([r, m.reshape(-1, w)]), mode="r")
            return r

        return step

    out = _folded(f.blocks, make, w)
    return np.zeros((0, w)) if out is None else out.reshape(-1, w)


def orthonormal(f: Factor, name: str) -> Factor:
    """A basis of the factor's columns, written: directions lost to rounding are left out, and a second pass takes off what the first left."""
    for _ in range(2):
        _, s, v = np.linalg.svd(triangle(f))
        kept = s > 1e-12 * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), bool)
        out = f.times(v[: len(s)][kept].T / s[kept]).saved(name)
        f.drop()
        f = out
    return f


class Movie:
    """A centred movie as a table of tiles. ``across`` and ``along`` multiply it with a factor of frames or of pixels."""

    def __init__(self, px: DataFrame):
        self.spark = px.sparkSession
        ship(self.spark)
        place = lambda c: F.floor(F.col(c) / SIDE).alias(f"{c}b")
        rows = centred(px).select(F.col("p").cast("long").alias("p"), F.col("g").cast("long").alias("g"), F.col("x").cast("double").alias("x")).dropna()
        grid = rows.select(place("p"), place("g"), "p", "g", "x").groupBy("pb", "gb").applyInArrow(_tile, _TILE)
        self.tiles, self.path = shared.save(grid, "tiles")
        self.pixels = self.tiles.select(F.explode("ps").alias("p")).distinct().count()
        self.frames = self.tiles.select(F.explode("gs").alias("g")).distinct().count()
        self.total = self._total()

    def _total(self) -> float:
        """The sum of all squares."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([sum((float(np.square(_dense(d, -1)).sum()) for b in batches for d in b.column(0)), 0.0)])], names=["s"])

        return self.tiles.select("data").mapInArrow(run, "s double").agg(F.sum("s")).first()[0] or 0.0

    def close(self) -> None:
        shared.remove(self.spark, self.path)

    def _product(self, f: Factor | None, width: int, side: str, seed: int = 0) -> Factor:
        """Side p: the movie times a factor of frames (None: seeded normal numbers); side g: its transpose times a factor of pixels."""
        out, other = ("p", "g") if side == "p" else ("g", "p")
        seeded = f is None
        rows = self.tiles.select(f"{out}b", f"{out}s", f"{other}b", f"{other}s", "data")
        if not seeded:
            blocks = f.blocks.select(F.col("b").alias(f"{other}b"), "ids", "m")
            rows = rows.join(F.broadcast(blocks) if f.size() <= SENT else blocks, f"{other}b").select(*rows.columns, "ids", "m")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for i in range(b.num_rows):
                    key, ids, block, others = b.column(0)[i].as_py(), _ids(b.column(1), i), b.column(2)[i].as_py(), _ids(b.column(3), i)
                    tile = _dense(b.column(4)[i], -1)
                    tile = tile.reshape(len(ids), len(others)) if side == "p" else tile.reshape(len(others), len(ids)).T
                    if seeded:
                        far = np.random.default_rng([seed, block % (1 << 63)]).normal(size=(SIDE, width))[others % SIDE]
                    else:
                        known = _ids(b.column(5), i)
                        far = _dense(b.column(6)[i], len(known), width)[np.searchsorted(known, others)]
                    if key not in held:
                        held[key] = np.zeros(SIDE, bool), np.zeros((SIDE, width))
                    seen, sums = held[key]
                    seen[ids % SIDE] = True
                    sums[ids % SIDE] += tile @ far
                if len(held) > SUMS:
                    yield from _blocks((k, k * SIDE + np.flatnonzero(s), m[s]) for k, (s, m) in held.items())
                    held.clear()
            yield from _blocks((k, k * SIDE + np.flatnonzero(s), m[s]) for k, (s, m) in held.items())

        def add(t: pa.Table) -> pa.Table:
            seen, sums = np.zeros(SIDE, bool), np.zeros((SIDE, width))
            ids, m = t["ids"].combine_chunks(), t["m"].combine_chunks()
            for i in range(t.num_rows):
                at = _ids(ids, i)
                seen[at % SIDE] = True
                sums[at % SIDE] += _dense(m[i], len(at), width)
            key = t["b"][0].as_py()
            return pa.Table.from_batches([_block([(key, key * SIDE + np.flatnonzero(seen), sums[seen])])])

        return Factor(rows.mapInArrow(run, _BLOCK).groupBy("b").applyInArrow(add, _BLOCK), width).saved(f"factor-{side}")

    def across(self, f: Factor | None, width: int = 0, seed: int = 0) -> Factor:
        return self._product(f, f.width if f else width, "p", seed)

    def along(self, f: Factor) -> Factor:
        return self._product(f, f.width, "g")


@dataclass
class Pca:
    """``spatial``, ``temporal``: factors with unit-norm columns (pixels, frames); the movie less ``mean`` (p, mean) is spatial * singular * temporal'."""

    spatial: Factor
    temporal: Factor
    singular: np.ndarray
    ratio: np.ndarray
    mean: DataFrame

    def head(self, k: int) -> Pca:
        """The first k components."""
        first = np.eye(len(self.singular))[:, :k]
        return Pca(self.spatial.times(first), self.temporal.times(first), self.singular[:k], self.ratio[:k], self.mean)

    def drop(self) -> None:
        """Deletes the factors' tables."""
        self.spatial.drop()
        self.temporal.drop()


def pca(px: DataFrame, k: int, seed: int = 0) -> Pca:
    """Truncated decomposition; k <= min(k, frames - 1, pixels).

    Of sides up to ``SPANNED`` every direction is taken, which is exact. Else rounds go on until the k singular values settle; ``ROUNDS``
    without that gives a warning. Null values count as the pixel's mean; a movie without variance or rows has no components.
    """
    movie = Movie(px)
    small = min(movie.frames, movie.pixels)
    k = max(0, min(k, movie.frames - 1, movie.pixels))
    width = small if small <= SPANNED else min(small, k + SPARE)
    if not k or movie.total == 0:
        none = Factor(px.sparkSession.createDataFrame([], _BLOCK), 0)
        movie.close()
        return Pca(none, none, np.zeros(0), np.zeros(0), full_mean(px))
    basis, before, done = orthonormal(movie.across(None, width, seed), "basis-p"), None, False
    for turn in range(ROUNDS):
        far = movie.along(basis)
        left, singular, right = np.linalg.svd(triangle(far), full_matrices=False)
        top = singular[:k]
        done = small <= SPANNED or before is not None and len(before) == len(top) and bool(np.all(np.abs(top - before) <= SETTLED * top[0]))
        if done or turn == ROUNDS - 1:
            break
        before = top
        frames = orthonormal(far, "basis-g")
        basis.drop()
        basis = orthonormal(movie.across(frames), "basis-p")
        frames.drop()
    if not done:
        warnings.warn(f"singular values did not settle in {ROUNDS} rounds", RuntimeWarning, stacklevel=2)
    # movie' * basis = far = Q R and R = left * singular * right: the movie is (basis right') singular (Q left)', Q left = far right' / singular
    k = int(min(k, (singular > 1e-12 * singular[0]).sum()))
    spatial = basis.times(right[:k].T).saved("spatial")
    temporal = far.times(right[:k].T / singular[:k]).saved("temporal")
    basis.drop()
    far.drop()
    movie.close()
    return Pca(spatial, temporal, singular[:k], singular[:k] ** 2 / movie.total, full_mean(px))


def spectrum(px: DataFrame, k: int) -> DataFrame:
    r = pca(px, k)
    r.drop()
    return px.sparkSession.createDataFrame([(i, float(s), float(v)) for i, (s, v) in enumerate(zip(r.singular, r.ratio, strict=True))], "k long, singular double, ratio double")


@dataclass
class Ica:
    """``maps`` (p, v) and ``scores`` (g, v): a row of one number per component for every pixel and frame; ``variance`` of the scores, descending."""

    maps: DataFrame
    scores: DataFrame
    variance: np.ndarray
    paths: tuple[str, ...] = field(default=())

    def drop(self) -> None:
        shared.remove(self.maps.sparkSession, *self.paths)


#: E[log cosh] of a standard normal variable.
_NORMAL = 0.37456


def _even(w: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(w @ w.T)
    return u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-18))) @ u.T @ w


def _sum_of(f: Factor, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the factor's blocks of a flat vector."""

    def make():
        total = None

        def step(m: np.ndarray, small: bool) -> np.ndarray:
            nonlocal total
            v = m if small else of(m)
            total = v if total is None else total + v
            return total

        return step

    return _folded(f.blocks, make, f.width)


def unmixing(f: Factor, seed: int = 0, rounds: int = 500, tol: float = 1e-4, starts: int = 4) -> np.ndarray:
    """Unmixing matrix (components x width) of a factor's columns: symmetric fixed-point iteration with log cosh, unit variance.

    Every round is one pass of sums over the rows for all starts that still move. Of several seeded starts the one with the most contrast
    (squared distance of E[log cosh] from a normal variable's) counts; if none converged, a warning says so.
    """
    k = f.width
    first = _sum_of(f, lambda m: np.concatenate([[len(m)], m.sum(0)]))
    n, mean = first[0], first[1:] / first[0]
    cov = _sum_of(f, lambda m: ((m - mean).T @ (m - mean)).ravel()).reshape(k, k) / n
    values, vectors = np.linalg.eigh(cov)
    white = (vectors / np.sqrt(np.maximum(values, 1e-18))).T
    rng = np.random.default_rng(seed)
    ws, moving = [_even(rng.normal(size=(k, k))) for _ in range(starts)], list(range(starts))
    for _ in range(rounds):
        now = np.stack([ws[i] for i in moving])

        def sums(m: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            z = white @ (m - mean).T
            t = np.tanh(now @ z)
            return np.concatenate([(t @ z.T).ravel(), (1 - t**2).sum(2).ravel()])

        got = _sum_of(f, sums)
        a, b = got[: now.size].reshape(now.shape) / n, got[now.size :].reshape(len(now), k) / n
        still = []
        for i, w, x, y in zip(moving, now, a, b, strict=True):
            ws[i] = _even(x - np.diag(y) @ w)
            # rows keep their places in this iteration and may only change sign
            if np.max(np.abs(np.abs(np.einsum("ij,ij->i", ws[i], w)) - 1)) >= tol:
                still.append(i)
        moving = still
        if not moving:
            break

    def contrast(m: np.ndarray) -> np.ndarray:
        y = np.abs(np.stack(ws) @ (white @ (m - mean).T))
        return (y + np.log1p(np.exp(-2 * y)) - np.log(2)).sum(2).ravel()

    gain = ((_sum_of(f, contrast).reshape(starts, k) / n - _NORMAL) ** 2).sum(1)
    best = max(range(starts), key=lambda i: (i not in moving, gain[i]))
    if best in moving:
        warnings.warn(f"independent components did not converge in {rounds} rounds", RuntimeWarning, stacklevel=2)
    return ws[best] @ white


def ica(p: Pca, seed: int = 0, rounds: int = 500) -> Ica:
    """Spatial independent components; the largest entry of a map is positive (ties: of the smallest pixel), order by temporal variance."""
    k = len(p.singular)
    spark = p.mean.sparkSession
    if not k:
        none = "v array<double>"
        return Ica(spark.createDataFrame([], f"p long, {none}"), spark.createDataFrame([], f"g long, {none}"), np.zeros(0))
    scale = p.spatial.times(np.diag(p.singular)).saved("scaled")
    u = unmixing(scale, seed, rounds)
    scale.drop()
    maps = p.spatial.times((u @ np.diag(p.singular)).T)
    scores = p.temporal.times(np.linalg.pinv(u))
    peak = maps.rows().agg(*(F.min(F.struct(-F.abs(F.col("v")[c]), "id", F.col("v")[c].alias("x"))).alias(f"c{c}") for c in range(k))).first()
    sign = np.array([-1.0 if peak[f"c{c}"]["x"] < 0 else 1.0 for c in range(k)])
    spread = scores.rows().agg(*(F.var_pop(F.col("v")[c]).alias(f"c{c}") for c in range(k))).first()
    variance = np.array([spread[f"c{c}"] for c in range(k)])
    order = np.argsort(-variance, kind="stable")
    turn = np.diag(sign)[:, order]
    tables, paths = zip(*(shared.save(f.times(turn).rows().withColumnRenamed("id", name), f"components-{name}") for f, name in ((maps, "p"), (scores, "g"))), strict=True)
    return Ica(*tables, variance[order], paths)


def _dot(v: str, weights: np.ndarray) -> Column:
    """A short array times fixed weights."""
    return sum((F.col(v)[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))


def products(maps: DataFrame, k: int) -> np.ndarray:
    """Inner products of the maps (k x k)."""
    got = maps.agg(*(F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return np.array([[got[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


def loadings(px: DataFrame, maps: DataFrame, k: int, wanted: list[int]) -> DataFrame:
    """(g, a): how much of each wanted map a frame holds, fitted to all maps at once against the whole timeline's mean."""
    fit = np.linalg.pinv(products(maps, k))
    table = maps.select("p", *(_dot("v", fit[e]).alias(f"_l{c}") for c, e in enumerate(wanted)))
    rows = px.join(full_mean(px), "p").join(table, "p")
    sums = rows.groupBy("g").agg(*(F.sum((F.col("x") - F.col("mean")) * F.col(f"_l{c}")).alias(f"_a{c}") for c in range(len(wanted))))
    return sums.select("g", F.array(*(F.col(f"_a{c}") for c in range(len(wanted)))).alias("a"))


def subtract(px: DataFrame, maps: DataFrame, k: int, exclude: list[int]) -> DataFrame:
    """The movie without the excluded components: x - sum of map * loading. ``maps``: (p, v) with k components. Nothing excluded: unchanged.

    Joins by pixel and by frame; Spark sends the smaller tables to all tasks only below its own limit.
    """
    exclude = sorted(set(exclude))
    if not exclude:
        return px.select("g", "p", "x")
    if exclude[0] < 0 or exclude[-1] >= k:
        raise ValueError("a component to exclude doesn't exist")
    own = maps.select("p", F.array(*(F.col("v")[e] for e in exclude)).alias("_m"))
    rows = px.select("g", "p", "x").join(own, "p").join(loadings(px, maps, k, exclude), "g")
    removed = sum((F.col("_m")[c] * F.col("a")[c] for c in range(len(exclude))), F.lit(0.0))
    return rows.select("g", "p", (F.col("x") - removed).alias("x"))


def reconstruct(px: DataFrame, maps: DataFrame, scores: DataFrame, keep: list[int]) -> DataFrame:
    """(g, p, x) at the places of ``px`` from some components and the mean; none: the mean image for every frame."""
    rows = px.select("g", "p").join(full_mean(px), "p")
    if not keep:
        return rows.select("g", "p", F.col("mean").alias("x"))
    rows = rows.join(maps.select("p", F.col("v").alias("_m")), "p").join(scores.select("g", F.col("v").alias("_s")), "g")
    return rows.select("g", "p", (F.col("mean") + sum((F.col("_m")[c] * F.col("_s")[c] for c in keep), F.lit(0.0))).alias("x"))
