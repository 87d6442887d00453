"""Vector code compression: product codes whose codebooks are fitted by exact integer Lloyd rounds with Elkan's bounds (operator 11).

Components become integers floor(scale * x); vectors are cut into equal consecutive parts, each with a codebook of its own. A
part's row keeps an upper bound of the distance to its entry and one lower bound per entry from round to round, in a table in the
shared folder. When entries move, upper bounds grow by the own entry's movement and lower bounds shrink by each entry's; an entry
is passed over only where a bound is strictly on the safe side, else its distance is computed in integers, so a tie always goes to
the lower index. Bounds are stored in 16 bits, rounded outwards, so they stay bounds.

Defined cases. Dropped: null vectors, vectors with a null or non-finite component, empty ones, and those whose length isn't a
multiple of ``parts`` or isn't that of the smallest kept vec_id. Repeated rows are rows of their own; the first entries are the
rows with the smallest (vec_id, components), null ids last; with fewer rows than entries there are fewer entries. Equal distances:
the lower index. Null labels are one label. An empty table gives none. Integers beyond 2^28 raise, since squares would overflow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers up to here have exact squared distances in 64 bits.
WIDEST = 1 << 28
#: What square roots and sums of doubles may be off by, relatively.
SLACK = 1e-12

Entries = np.ndarray  # parts x entries x width, integers


def _stored(a: np.ndarray, upper: bool) -> bytes:
    """Bounds as the upper halves of single floats, rounded outwards."""
    with np.errstate(over="ignore"):
        f = a.astype(np.float32)
    f = np.where(f < a, np.nextafter(f, np.float32(np.inf)), f) if upper else np.where(f > a, np.nextafter(f, np.float32(0)), f)
    bits = f.view(np.uint32)
    return ((bits + np.uint32(0xFFFF) if upper else bits) >> np.uint32(16)).astype("<u2")


def _read(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries of the same place."""
    d = x - entries
    return np.einsum("...i,...i->...", d, d)


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> int:
    """One part: x (rows x width), code, upper (rows), lower (rows x entries), changed in place. Returns how many distances were computed."""
    upper += moved[code]
    upper *= 1 + SLACK
    np.maximum((lower - moved) * (1 - SLACK), 0, out=lower)
    half = 0.5 * np.sqrt(squares(entries[:, None], entries[None])) * (1 - SLACK)
    apart = np.where(np.eye(len(entries), dtype=bool), np.inf, half)
    rows = np.flatnonzero(upper >= apart.min(1)[code])
    if not len(rows):
        return 0
    own = code[rows]

    def open_pairs(at: np.ndarray, a: np.ndarray) -> np.ndarray:
        u = upper[at][:, None]
        return (u >= lower[at]) & (u >= apart[a])

    at = open_pairs(rows, own).any(1)
    rows, own = rows[at], own[at]
    exact = squares(x[rows], entries[own])
    upper[rows] = np.sqrt(exact) * (1 + SLACK)
    pairs = open_pairs(rows, own)
    r, j = np.nonzero(pairs)
    d = squares(x[rows[r]], entries[j])
    table = np.full(pairs.shape, np.iinfo(np.int64).max)
    table[r, j] = d
    table[np.arange(len(rows)), own] = exact
    lower[rows[r], j] = np.sqrt(d) * (1 - SLACK)
    lower[rows, own] = np.sqrt(exact) * (1 - SLACK)
    best = table.argmin(1)  # the first of equal ones
    code[rows] = best
    upper[rows] = np.sqrt(table[np.arange(len(rows)), best]) * (1 + SLACK)
    return len(rows) + len(r)


_STATE = "vec_id long, label {label}, x binary, code binary, upper binary, lower binary"


def _matrix(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    """Binary values of one length as an array."""
    if not len(column):
        return np.zeros((0, *shape), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _rows(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    size = a[0].nbytes if len(a) else 0
    raw = a.tobytes()
    return pa.array([raw[i * size : (i + 1) * size] for i in range(len(a))], pa.binary())


def usable(vectors: DataFrame, parts: int) -> DataFrame:
    """(vec_id, label, v): the rows that can be coded."""
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & ok)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


def _first(rows: DataFrame, parts: int, entries: int, scale: int) -> Entries | None:
    """The first entries: parts of the ``entries`` smallest rows; None where there are no rows."""
    order = [F.asc_nulls_last("vec_id"), "v"]
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        return None
    found = rows.filter(F.size("v") == len(head[0].v)).orderBy(*order).limit(entries).collect()
    return whole(np.array([r.v for r in found]), scale).reshape(len(found), parts, -1).transpose(1, 0, 2).copy()


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(v * scale)
    if x.size and np.abs(x).max() > WIDEST:
        raise ValueError(f"a component times {scale} is beyond 2^28")
    return x.astype(np.int64)


def _pass(shape: tuple[int, int, int], entries: Entries, moved: np.ndarray) -> Callable:
    """Arrow batches of the state with every part assigned again."""
    parts, k, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "x"):
            x = _matrix(b.column(2), "<i4", parts, width).astype(np.int64)
            code = _matrix(b.column(3), "u1", parts).astype(np.int64)
            upper, lower = _read(_matrix(b.column(4), "<u2", parts)), _read(_matrix(b.column(5), "<u2", parts, k))
            for p in range(parts):
                c, u, low = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                assign(x[:, p], c, u, low, entries[p], moved[p])
                code[:, p], upper[:, p], lower[:, p] = c, u, low
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _rows(code.astype("u1")), _rows(_stored(upper, True)), _rows(_stored(lower, False))], schema=b.schema)

    return run


def _start(shape: tuple[int, int, int], scale: int) -> Callable:
    """The state before the first round: nothing known."""
    parts, k, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, common.CHUNK_BYTES // (8 * parts * width))
        for b in (batch.slice(i, size) for batch in batches for i in range(0, batch.num_rows, size)):
            n = b.num_rows
            x = whole(b.column(2).flatten().to_numpy(), scale).astype("<i4").reshape(n, parts * width)
            unknown = [_rows(np.zeros((n, parts), "u1")), _rows(_stored(np.full((n, parts), np.inf), True)), _rows(np.zeros((n, parts * k), "<u2"))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _rows(x), *unknown], names=["vec_id", "label", "x", "code", "upper", "lower"])

    return run


def _sums(shape: tuple[int, int, int]) -> Callable:
    """A task's counts and component sums of each (part, entry)."""
    parts, k, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        for b in common.chunks(batches, "x"):
            x = _matrix(b.column(0), "<i4", parts, width).astype(np.int64)
            at = (_matrix(b.column(1), "u1", parts).astype(np.int64) + np.arange(parts) * k).ravel()
            n += np.bincount(at, minlength=parts * k)
            np.add.at(total, at, x.reshape(-1, width))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["at", "n", "total"])

    return run


def _moved_to(state: DataFrame, entries: Entries) -> Entries:
    """Each used entry's floor of the mean. One row per entry reaches the driver."""
    parts, k, width = entries.shape
    partial = state.select("x", "code").mapInArrow(_sums(entries.shape), "at long, n long, total array<long>")
    sums = partial.groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width))).collect()
    out = entries.copy()
    for r in sums:
        out[r["at"] // k, r["at"] % k] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
    return out


def _coded(entries: Entries) -> Callable:
    """Codes as hexadecimal digits, exact errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = entries.shape
        for b in common.chunks(batches, "x"):
            x, code = _matrix(b.column(2), "<i4", parts, width).astype(np.int64), _matrix(b.column(3), "u1", parts)
            error = squares(x, entries[np.arange(parts), code]).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


@dataclass
class Codes:
    """``rows``: a table (vec_id, label, code, error); ``entries``: parts x entries x width."""

    rows: DataFrame
    entries: Entries

    @property
    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of ``vectors`` (vec_id, embedding, label): at most 256 entries, so two digits each."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries fit two digits")
    common.ship(vectors.sparkSession)
    rows = usable(vectors, parts)
    label = rows.schema["label"].dataType.simpleString()
    now = _first(rows, parts, entries, scale)
    if now is None:
        return Codes(rows.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), np.zeros((parts, 0, 0), np.int64))
    schema = _STATE.format(label=label)
    width = now.shape[2]
    state = common.table(rows.filter(F.size("v") == parts * width).mapInArrow(_start(now.shape, scale), schema), "codes-start", "zstd")
    moved = np.zeros(now.shape[:2])
    for _ in range(rounds):
        before, state = state, common.table(state.mapInArrow(_pass(now.shape, now, moved), schema), "codes-state", "zstd")
        common.drop(before)
        new = _moved_to(state, now)
        moved, now = np.sqrt(squares(new, now)) * (1 + SLACK), new
    last = common.table(state.mapInArrow(_pass(now.shape, now, moved), schema).mapInArrow(_coded(now), f"vec_id long, label {label}, code string, error long"), "codes")
    common.drop(state)
    return Codes(last, now)


def query(spark, sf_dir: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    labels = found.rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = common.attach(found.rows, labels, ["label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(found.digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds, written out one after the other, every distance computed."""
    steps = [
        "kept as materialized (select vec_id, label, embedding from embeddings where embedding is not null and len([v for v in embedding if v is null or not isfinite(v)]) = 0)",
        "x as materialized (select vec_id, label, i // 8 p, i % 8 d, cast(floor(4096 * cast(embedding[i + 1] as double)) as bigint) x from kept, (select unnest(range(64)) i))",
        "heads as (select vec_id, row_number() over (order by vec_id) - 1 e from (select vec_id from kept order by vec_id limit 16))",
        "c0 as materialized (select p, e, d, x c from x join heads using (vec_id))",
    ]
    near = "as materialized (select vec_id, p, arg_min(e, (s, e)) e, min(s) s from (select vec_id, p, e, sum((x - c) * (x - c)) s from x join c{0} using (p, d) group by all) group by all)"
    for i in range(ROUNDS):
        steps.append(f"a{i} " + near.format(i))
        steps.append(f"c{i + 1} as materialized (select p, e, d, coalesce(m, c) c from c{i} left join (select p, e, d, cast(floor(sum(x) / count(*)) as bigint) m from x join a{i} using (vec_id, p) group by all) using (p, e, d))")
    steps.append(f"last {near.format(ROUNDS)}")
    steps.append("done as (select vec_id, any_value(label) label, string_agg(format('{:02x}', e), '' order by p) code, cast(sum(s) as bigint) error from last join kept using (vec_id) group by vec_id)")
    steps.append(f"book as (select sha256(string_agg(cast(c as varchar), ',' order by p, e, d)) h from c{ROUNDS})")
    return "with " + ", ".join(steps) + " select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, h codebooks_sha256 from done, book"


ORACLE = _oracle()
