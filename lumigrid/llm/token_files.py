"""Token-id files in patched frame-of-reference blocks (operator 7).

A file holds the ids of consecutive documents. Ids are cut into blocks of 256; a block stores its minimum,
the differences packed at the width that covers the chosen percentile of them, and a list of exceptions
(position, high bits) for the rest. The header indexes documents and block starts, so a reader decodes any
block range alone. Layout, little-endian::

    "LGPF" | version u32 | n_docs u64 | n_ids u64 | n_blocks u64 | n_exceptions u64 | payload_bytes u64
    doc keys i64[n_docs] | key is set u8[n_docs] | ids per doc u64[n_docs]
    block: minimum u32[n_blocks] | width u8[n_blocks] | payload start u64[n_blocks] | first exception u64[n_blocks]
    exceptions: position u8[n] | high bits u32[n] | payload

On a cluster a file is one row of a table of files, ordered by (shard, file): Spark's committer then makes
task retries and lost executors harmless, and any store Spark reaches can hold them. ``export_files`` puts
the same bytes into plain files.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common, tokens

BLOCK, PERCENTILE = 256, 90
_HEAD = struct.Struct("<4sIQQQQQ")
#: At least so many ids before a file is closed; a longer document stays whole.
FILE_IDS = 2_000_000


def _widths(top: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.uint8)


def pack(ids: np.ndarray, lens: np.ndarray, keys: list, percentile: int = PERCENTILE) -> bytes:
    """One file. ``ids``: uint32, all documents in order; ``lens``: ids of each; ``keys``: int or None of each."""
    n, docs = len(ids), len(lens)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if n % BLOCK:
        grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(1) if blocks else np.zeros(0, np.uint32)
    grid = grid - low[:, None]
    rank = min(BLOCK - 1, -(-BLOCK * percentile // 100) - 1)
    width = _widths(np.partition(grid, rank, 1)[:, rank] if blocks else low)
    high = grid >> width[:, None].astype(np.uint32) if blocks else grid
    high[width == 32] = 0
    block_of, place = np.nonzero(high)
    first = np.searchsorted(block_of, np.arange(blocks))
    starts = np.cumsum(width.astype(np.int64) * (BLOCK // 8)) - width.astype(np.int64) * (BLOCK // 8)
    size = int(width.sum(dtype=np.int64)) * (BLOCK // 8)
    payload = np.zeros(size, np.uint8)
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            bits = (grid[at][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
            payload[starts[at][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    whole = np.array([k if k is not None else 0 for k in keys], np.int64)
    is_set = np.array([k is not None for k in keys], np.uint8)
    return b"".join([
        _HEAD.pack(b"LGPF", 1, docs, n, blocks, len(place), size),
        whole.tobytes(), is_set.tobytes(), lens.astype(np.uint64).tobytes(),
        low.astype(np.uint32).tobytes(), width.tobytes(), starts.astype(np.uint64).tobytes(), first.astype(np.uint64).tobytes(),
        place.astype(np.uint8).tobytes(), high[block_of, place].astype(np.uint32).tobytes(), payload.tobytes(),
    ])


def unpack(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys, ids of each document, all ids."""
    magic, version, docs, n, blocks, exceptions, size = _HEAD.unpack_from(raw)
    if magic != b"LGPF" or version != 1:
        raise ValueError("not a token file")
    at = _HEAD.size

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    keys, is_set, lens = take("<i8", docs), take("u1", docs), take("<u8", docs)
    low, width, starts, first = take("<u4", blocks), take("u1", blocks), take("<u8", blocks), take("<u8", blocks)
    place, high, payload = take("u1", exceptions), take("<u4", exceptions), take("u1", size)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(payload[starts[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            out = bits[:, :, 0].astype(np.uint32)
            for b in range(1, w):
                out |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
            grid[rows] = out
    owner = np.repeat(np.arange(blocks), np.diff(np.append(first, exceptions)).astype(np.int64))
    grid[owner, place] |= high << width[owner].astype(np.uint32)
    grid += low[:, None]
    return [k if s else None for k, s in zip(keys.tolist(), is_set.tolist(), strict=True)], lens.astype(np.int64), grid.reshape(-1)[:n]


def with_end(ids: np.ndarray, lens: np.ndarray, end_id: int = tokens.END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document."""
    return np.insert(ids, np.cumsum(lens), np.uint32(end_id)), lens + 1


FILES = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())])
_FILES = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def write(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, percentile: int = PERCENTILE, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes the documents and writes files in ascending doc_id order (null first); returns the table of files.

    One range shuffle of (doc_id, text) orders them; each task appends to its shard and notes how many of the
    shard's ids come before a file. Empty and null texts give just the end id; equal keys keep all their rows, ordered
    by a hash of the text and then the text, so that reruns agree and a key with very many rows spreads. A file ends
    with the first document that brings it to ``file_ids`` ids. An empty table gives no files.
    """
    place = F.xxhash64("text")
    ordered = common.texts(docs).withColumn("place", place).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, file, before = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        held, keys, many = [], [], 0
        for part in common.chunks(batches):
            ids, lens = with_end(*enc.encode(part.column(1)))
            names, ends, at = part.column(0).to_pylist(), np.cumsum(lens), 0
            while at < len(lens):
                done = int(ends[at - 1]) if at else 0
                to = min(int(np.searchsorted(ends, done + file_ids - many)) + 1, len(lens))
                held.append((ids[done : ends[to - 1]], lens[at:to]))
                keys += names[at:to]
                many, at = many + int(ends[to - 1]) - done, to
                if many >= file_ids:
                    yield common.batch_of(_FILES, [shard], [file], [before], [many], [pack(*map(np.concatenate, zip(*held, strict=True)), keys, percentile)])
                    file, before, held, keys, many = file + 1, before + many, [], [], 0
        if keys:
            yield common.batch_of(_FILES, [shard], [file], [before], [many], [pack(*map(np.concatenate, zip(*held, strict=True)), keys, percentile)])

    return common.table(ordered.mapInArrow(encode, FILES), "token-files")


def read(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Starts need each shard's total only: one small row per shard, at most the number of shuffle partitions.
    """
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("all_ids"))
    base = totals.select("shard", F.coalesce(F.sum("all_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, lens, ids = unpack(raw.as_buffer())
                ends = np.cumsum(lens)
                view, bounds = memoryview(ids.astype("<u4")).cast("B"), (4 * ends).tolist()
                crcs = [zlib.crc32(view[hi - 4 * n : hi]) for hi, n in zip(bounds, lens.tolist(), strict=True)]
                yield common.batch_of(out, keys, first + ends - lens, lens, crcs)

    # a file is some MB: few rows in an Arrow batch
    return files.join(F.broadcast(base), "shard").select((F.col("base") + F.col("before")).alias("first"), "data").mapInArrow(decode, schema)


def export_files(files: DataFrame, folder: str) -> int:
    """Writes each file as ``<folder>/<shard>-<file>.lgpf``; ``folder`` must be mounted on every executor. Returns how many."""

    def put(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = f"{folder}/.{r.shard:06d}-{r.file:06d}.{TaskContext.get().taskAttemptId()}"
            with open(part, "wb") as f:
                f.write(r.data)
            os.replace(part, f"{folder}/{r.shard:06d}-{r.file:06d}.lgpf")

    files.foreachPartition(put)
    return files.count()


def query(spark, sf_dir: str) -> DataFrame:
    return read(write(common.documents(spark, sf_dir)))
