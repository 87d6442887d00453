"""Recordings as Spark tables.

``spark.read.format("lumigrid_tiff").load(path)`` (also ``lumigrid_dcimg``, ``lumigrid_spool``) gives (file_idx, frame_index, h, w, pix,
framestamp, timestamp_sec, timestamp_microsec). Planning reads headers only; filters on file_idx and frame_index choose files and frames before
anything is opened for reading; each task fetches the bytes of its own frames. ``index`` walks the headers inside tasks instead, a task per
file, and gives places, sizes and counts as a table, without pixels; ``load`` reads the frames of such a table, or of a part of it.
``write.format("lumigrid_tiff")`` writes one big TIFF per channel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .. import shipping
from . import seek

SCHEMA = "file_idx int, frame_index long, h int, w int, pix array<int>, framestamp long, timestamp_sec double, timestamp_microsec double"
#: Bytes of frames one task reads, about.
RANGE = 64 << 20

_PLACE = "file_idx int, path string, frame_index long, h int, w int, kind string, compression int, row_bytes long, offsets array<long>, sizes array<long>, footer long, framestamp long, timestamp_sec double, timestamp_microsec double"


class Range(InputPartition):
    def __init__(self, file_idx: int, path: str, places: list[seek.Place]):
        self.file_idx, self.path, self.places = file_idx, path, places


def _row(file_idx: int, p: seek.Place, pix: np.ndarray, stamp: tuple[int, int, int] | None) -> tuple:
    first, sec, micro = stamp or (None, None, None)
    return (file_idx, p.frame_index, p.h, p.w, pix.astype("int64").ravel().tolist(), first, None if sec is None else float(sec), None if micro is None else float(micro))


class _Bounds:
    """What filters leave of an integer column."""

    def __init__(self):
        self.lo, self.hi, self.among = None, None, None

    def add(self, f: Filter) -> bool:
        if isinstance(f, EqualTo):
            self.among = {f.value} if self.among is None else self.among & {f.value}
        elif isinstance(f, In):
            self.among = set(f.value) if self.among is None else self.among & set(f.value)
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            lo = f.value + isinstance(f, GreaterThan)
            self.lo = lo if self.lo is None else max(self.lo, lo)
        elif isinstance(f, LessThan | LessThanOrEqual):
            hi = f.value - isinstance(f, LessThan)
            self.hi = hi if self.hi is None else min(self.hi, hi)
        else:
            return False
        return True

    def has(self, v: int) -> bool:
        return (self.lo is None or v >= self.lo) and (self.hi is None or v <= self.hi) and (self.among is None or v in self.among)


class FrameReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.frames = int(options["frames"]) if "frames" in options else None
        self.bounds = {"file_idx": _Bounds(), "frame_index": _Bounds()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column not in self.bounds or not self.bounds[column].add(f):
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for i, (path, _) in enumerate(seek.listed(self.path, self.kind)):
            if not self.bounds["file_idx"].has(i):
                continue
            now, size = [], 0
            for p in seek.places(path, self.kind, i, self.frames):
                if self.bounds["frame_index"].has(p.frame_index):
                    now.append(p)
                    size += sum(p.sizes)
                if size >= RANGE:
                    out.append(Range(i, path, now))
                    now, size = [], 0
            if now:
                out.append(Range(i, path, now))
        return out or [Range(0, "", [])]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.places:
            return
        with seek.Reader(part.path) as f:
            for p in part.places:
                yield _row(part.file_idx, p, seek.pixels(f, p), seek.stamp(f, p))


class _Stack:
    """A big TIFF written front to back. A frame waits until it is known whether another follows, since its directory names the next one's place."""

    def __init__(self, path: str, compress: bool):
        self.files, self.path = seek.system(path)
        self.out = self.files.open_output_stream(self.path)
        self.compress, self.at, self.n, self.waiting = compress, 16, 0, None
        self.out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))

    def add(self, frame: np.ndarray) -> None:
        self._put(True)
        self.waiting = frame
        self.n += 1

    def _put(self, more: bool) -> None:
        if self.waiting is None:
            return
        frame = self.waiting
        data = np.ascontiguousarray(frame, frame.dtype.newbyteorder("<")).tobytes()
        data = zlib.compress(data) if self.compress else data
        place = self.at + 8 + 9 * 20 + 8
        entries = [(256, 4, frame.shape[1]), (257, 4, frame.shape[0]), (258, 3, 8 * frame.dtype.itemsize), (259, 3, 8 if self.compress else 1), (262, 3, 1), (273, 16, place), (277, 3, 1), (278, 4, frame.shape[0]), (279, 16, len(data))]
        padded = data + b"\0" * (-len(data) % 8)
        after = place + len(padded)
        self.out.write(struct.pack("<Q", 9) + b"".join(struct.pack("<HHQQ", tag, kind, 1, value) for tag, kind, value in entries) + struct.pack("<Q", after if more else 0) + padded)
        self.at = after

    def close(self) -> None:
        self._put(False)
        self.out.close()


class Written(WriterCommitMessage):
    def __init__(self, stacks: list[tuple[str, str]]):
        self.stacks = stacks  # (where it was written, where it belongs)


class StackWriter(DataSourceWriter):
    """Rows (ch, t, h, w, pix) that come ordered by (ch, t), a channel's rows in one task: ``<prefix><ch>.tif`` each. Files get their names
    when all tasks are done; a failed task removes what it began, a failed job what the others finished."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.prefix, self.overwrite = options["path"].rstrip("/"), options.get("prefix", "Ch"), overwrite
        self.compress, self.bits = options.get("compress", "false").lower() == "true", int(options.get("bits", "16"))

    def write(self, rows: Iterator[Row]) -> Written:
        files, at = seek.system(self.folder)
        files.create_dir(at)
        attempt = TaskContext.get().taskAttemptId()
        done: list[tuple[str, str]] = []
        stack, now = None, None
        try:
            for r in rows:
                key = r["ch"]
                if key != now:
                    if stack is not None:
                        stack.close()
                    if any(b == f"{self.folder}/{self.prefix}{key}.tif" for _, b in done):
                        raise ValueError(f"rows of channel {key} aren't together")
                    done.append((f"{self.folder}/.{self.prefix}{key}.{attempt}.part", f"{self.folder}/{self.prefix}{key}.tif"))
                    stack, now, last = _Stack(done[-1][0], self.compress), key, None
                if last is not None and r["t"] <= last:
                    raise ValueError(f"frames of channel {key} aren't in order")
                last = r["t"]
                stack.add(np.array(r["pix"], f"<u{self.bits // 8}").reshape(r["h"], r["w"]))
            if stack is not None:
                stack.close()
        except BaseException:
            if stack is not None:
                stack.out.close()
            _remove(a for a, _ in done)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        stacks = [s for m in messages if m is not None for s in m.stacks]
        names = [b for _, b in stacks]
        there = [b for b in names if _there(b)]
        if len(set(names)) < len(names) or there and not self.overwrite:
            _remove(a for a, _ in stacks)
            raise ValueError(f"files are there already: {there}" if there else "rows of a channel came from several tasks")
        for a, b in stacks:
            files, at = seek.system(a)
            files.move(at, seek.system(b)[1])

    def abort(self, messages: list[Written | None]) -> None:
        _remove(a for m in messages if m is not None for a, _ in m.stacks)


def _there(path: str) -> bool:
    files, at = seek.system(path)
    return files.get_file_info(at).type == fs.FileType.File


def _remove(paths: Iterator[str]) -> None:
    for path in paths:
        if _there(path):
            files, at = seek.system(path)
            files.delete_file(at)


WRITTEN = "ch int, t long, h int, w int, pix array<int>"


def _source(short: str, kind: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return FrameReader(kind, self.options)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if kind != "tif":
                raise ValueError(f"{short} can't be written")
            return StackWriter(self.options, overwrite)

    Source.__name__ = Source.__qualname__ = f"{kind.title()}Source"
    return Source


def register(spark: SparkSession) -> None:
    """Makes ``lumigrid_tiff``, ``lumigrid_dcimg`` and ``lumigrid_spool`` known, and lets filters reach them."""
    shipping.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for short, kind in (("lumigrid_tiff", "tif"), ("lumigrid_dcimg", "dcimg"), ("lumigrid_spool", "spool")):
        spark.dataSource.register(_source(short, kind))


def write_stacks(rows: DataFrame, folder: str, prefix: str = "Ch", compress: bool = False, bits: int = 16, mode: str = "append") -> None:
    """Rows (ch, t, h, w, pix) as one big TIFF a channel, a task per channel that streams its frames in order of t. Channels without rows give no file."""
    register(rows.sparkSession)
    kinds = [c.strip().split(" ") for c in WRITTEN.split(",")]
    rows = rows.select(*(F.col(c).cast(k).alias(c) for c, k in kinds)).repartition("ch").sortWithinPartitions("ch", "t")
    rows.write.format("lumigrid_tiff").options(prefix=prefix, compress=str(compress).lower(), bits=bits).mode(mode).save(folder)


def convert(spark: SparkSession, path: str, fmt: str, folder: str, prefix: str = "stack", max_frames: int | None = None) -> None:
    """A recording's files as one big TIFF, frames in reading order, at most ``max_frames``."""
    rows = load(index(spark, path, fmt).transform(lambda d: d if max_frames is None else timeline(d).filter(F.col("g") < max_frames).drop("g")))
    write_stacks(timeline(rows).select(F.lit(0).alias("ch"), F.col("g").alias("t"), "h", "w", "pix"), folder, prefix)


# --- places as a table ---------------------------------------------------------------------------------


def index(spark: SparkSession, path: str, fmt: str, frames: int | None = None, stamps: bool = False) -> DataFrame:
    """A row per frame: its file, its place and layout, its stamp if asked for. The driver lists names, a task per file walks headers; no pixel is read.

    ``fmt``: tif, dcimg or spool; ``frames``: how many the recording has (spools may hold more).
    """
    shipping.ship(spark)
    files = seek.listed(path, fmt)
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(files)], "file_idx int, path string").repartition(max(1, min(len(files), 10_000)), "file_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                with seek.Reader(at) as f:
                    for p in seek.places(at, fmt, i, frames):
                        first, sec, micro = (seek.stamp(f, p) if stamps else None) or (None, None, None)
                        out.append((i, at, p.frame_index, p.h, p.w, p.kind, p.compression, p.row_bytes, p.offsets, p.sizes, p.footer, first, sec, micro))
                        if len(out) == 4096:
                            yield _places(out)
                            out = []
                if out:
                    yield _places(out)

    return rows.mapInArrow(run, _PLACE)


_ints = pa.list_(pa.int64())
_PLACE_TYPES = pa.schema([
    ("file_idx", pa.int32()), ("path", pa.string()), ("frame_index", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("kind", pa.string()), ("compression", pa.int32()), ("row_bytes", pa.int64()),
    ("offsets", _ints), ("sizes", _ints), ("footer", pa.int64()), ("framestamp", pa.int64()), ("timestamp_sec", pa.float64()), ("timestamp_microsec", pa.float64()),
])


def _places(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACE_TYPES, strict=True)], schema=_PLACE_TYPES)


def counts(places: DataFrame) -> DataFrame:
    """(file_idx, path, n, h, w, kind): what a recording's files hold, from an index."""
    return places.groupBy("file_idx", "path").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h"), F.min("w").alias("w"), F.min("kind").alias("kind"))


def common_size(places: DataFrame) -> tuple[int, int]:
    """The height and width that all frames have at least."""
    r = places.agg(F.min("h").alias("h"), F.min("w").alias("w")).first()
    return r["h"], r["w"]


def timeline(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds g, the frame's number over all files in order, to rows with (file_idx, frame_index): one recording from its files.

    ``files``: (file_idx, n) of all files; without it the rows themselves say. The running sum is over a row per file.
    """
    from ..operators.demux import file_starts

    files = rows.groupBy("file_idx").agg((F.max("frame_index") + 1).alias("n")) if files is None else files.select("file_idx", "n")
    starts = file_starts(files).select("file_idx", "frame_start")
    return rows.join(starts, "file_idx").withColumn("g", F.col("frame_start") + F.col("frame_index")).drop("frame_start")


def load(places: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """The frames of an index, or of what a filter left of it: its columns but the layout, and pix. ``size``: rows and columns kept of each frame.

    Places are dealt to tasks in runs of about ``RANGE`` bytes of one file, so each task reads forwards and no byte is fetched twice.
    """
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    names = [c for c in places.columns if c not in ("kind", "compression", "row_bytes", "offsets", "sizes", "footer")]
    kinds = {f.name: f.dataType.simpleString() for f in places.schema}
    layout = ["kind", "compression", "row_bytes", "offsets", "sizes", "footer"]
    run_ = F.floor(F.element_at("offsets", 1) / RANGE)
    tasks = places.agg(F.sum(total)).first()[0] or 0
    rows = places.select(*names, *layout).repartition(max(1, -(-tasks // RANGE)), "file_idx", run_).sortWithinPartitions("file_idx", F.element_at("offsets", 1))
    at = {c: i for i, c in enumerate([*names, *layout])}
    shape = size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, now = None, None
        try:
            for b in batches:
                for i in range(b.num_rows):
                    v = {c: b.column(k)[i].as_py() for c, k in at.items()}
                    if v["path"] != now:
                        if f is not None:
                            f.file.close()
                        f, now = seek.Reader(v["path"]), v["path"]
                    place = seek.Place(v["frame_index"], v["h"], v["w"], v["kind"], v["compression"], v["row_bytes"], v["offsets"], v["sizes"], v["footer"])
                    pix = seek.pixels(f, place)
                    pix = pix if shape is None else pix[: shape[0], : shape[1]]
                    columns = [b.column(at[c]).slice(i, 1) if c not in ("h", "w") else pa.array([pix.shape[c == "w"]], pa.int32()) for c in names]
                    flat = pa.array(pix.astype(np.int32, copy=False).ravel())
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=[*names, "pix"])
        finally:
            if f is not None:
                f.file.close()

    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "pix array<int>"]))


def pixels(frames: DataFrame) -> DataFrame:
    """(g, file_idx, r, c, x) from frames with g: a row per pixel."""
    w = F.col("w")
    out = frames.select("g", F.col("file_idx").cast("long").alias("file_idx"), "w", F.posexplode("pix").alias("p", "v"))
    return out.select("g", "file_idx", F.floor(F.col("p") / w).alias("r"), (F.col("p") % w).cast("long").alias("c"), F.col("v").cast("double").alias("x"))
