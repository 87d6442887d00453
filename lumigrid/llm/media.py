"""Media columns: FLAC streams in a binary column, decoded to PCM blocks and features (operator 6).

``store`` puts texts' bytes, padded with zeros to a positive multiple of 64, into FLAC streams of 8-bit
samples; ``decode`` reads streams back from the column into PCM blocks, ``blocks`` and ``describe`` read those.
Each works batch by batch; a task holds about two MB of samples and their working arrays, or one longer stream.
Empty tables give no rows; equal texts, repeated rows too, give equal values.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, flac, words

UNIT = 64
_CHUNK = 2 << 20

MEDIA = "doc_id long, n_bytes long, media binary"
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Payload bytes, their bounds, and the unpadded sizes."""
    data, bounds = words.raw(texts)
    n = np.diff(bounds)
    sizes = np.maximum(-(-n // UNIT), 1) * UNIT
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(to[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - bounds[:-1], n)] = data
    return out, to, n


def store(docs: DataFrame) -> DataFrame:
    """A FLAC stream for each whole text (null: empty, one unit of zeros). Repeated rows and equal texts give equal streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, size=_CHUNK):
            data, bounds, n = padded(part.column(1))
            yield common.batch_of(_MEDIA, part.column(0), n, flac.encode(data, bounds))

    return common.texts(docs).mapInArrow(run, MEDIA)


_BLOCKS = pa.list_(pa.struct([("first_sample", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary())]))
DECODED = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<first_sample:long,byte_offset:long,pcm:binary>>"
_DECODED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("blocks", _BLOCKS)])


def decode(media: DataFrame) -> DataFrame:
    """Streams (doc_id, n_bytes, media) as PCM: size and digest of each, and its blocks in order.

    A block is a frame's samples with its first sample and its byte offset in the stream, so a reader that wants
    one sample seeks to one frame. Null media gives no row; a stream whose checksums fail is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, "media", size=_CHUNK):
            streams = part.column(2).to_pylist()
            d = flac.decode(streams)
            first = np.append(d.frame_sample + d.bounds[d.frame_stream], len(d.data))
            pcm = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32).tobytes()), pa.py_buffer(d.data.tobytes())])
            frames = pa.StructArray.from_arrays([pa.array(d.frame_sample, pa.int64()), pa.array(d.frame_byte, pa.int64()), pcm], fields=list(_BLOCKS.value_type))
            edge = np.searchsorted(d.frame_stream, np.arange(len(streams) + 1)).astype(np.int32)
            yield common.batch_of(_DECODED, part.column(0), part.column(1), [len(s) for s in streams], [hashlib.sha256(s).hexdigest() for s in streams], pa.ListArray.from_arrays(pa.array(edge), frames))

    return media.filter(F.col("media").isNotNull()).select("doc_id", "n_bytes", "media").mapInArrow(run, DECODED)


def blocks(decoded: DataFrame) -> DataFrame:
    """One row per PCM block."""
    return decoded.select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", "b.first_sample", "b.byte_offset", "b.pcm")


DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def features(data: np.ndarray, bounds: np.ndarray, frames: np.ndarray) -> list[str]:
    """peak, energy, sign changes and frames of each stream, from its samples."""
    x = data.astype(np.int32) - 128
    energy, peak = words.per_text(x * x, bounds), np.maximum.reduceat(np.abs(x), bounds[:-1])
    flips = np.zeros(len(x), bool)
    flips[1:] = (x[1:] < 0) != (x[:-1] < 0)
    flips[bounds[:-1]] = False
    return [f"peak={p};energy={e};crossings={c};frames={f}" for p, e, c, f in zip(peak.tolist(), energy.tolist(), words.per_text(flips, bounds).tolist(), frames.tolist(), strict=True)]


def describe(decoded: DataFrame) -> DataFrame:
    """Payload digests and features of each stream, from the PCM blocks that ``decode`` left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            edge = column.offsets.to_numpy().astype(np.int64)
            pcm = column.values.field("pcm")
            at = 0
            while at < batch.num_rows:
                # whole streams of about a chunk
                sizes = np.cumsum(batch.column(1).to_numpy()[at:])
                to = at + max(1, int(np.searchsorted(sizes, _CHUNK)))
                to = min(to, batch.num_rows)
                data, cuts = words.raw(pcm.slice(edge[at], edge[to] - edge[at]))
                bounds = cuts[edge[at : to + 1] - edge[at]]
                whole, b = data.tobytes(), bounds.tolist()
                spans = list(zip(b[:-1], b[1:], strict=True))
                part = batch.slice(at, to - at)
                yield common.batch_of(
                    _DESCRIBED, part.column(0), part.column(1), np.diff(bounds), [hashlib.sha256(whole[i:j]).hexdigest() for i, j in spans], [zlib.crc32(whole[j - UNIT : j]) for _, j in spans],
                    part.column(2), part.column(3), features(data, bounds, np.diff(edge[at : to + 1])),
                )
                at = to

    return decoded.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, DESCRIBED)


def query(spark, sf_dir: str) -> DataFrame:
    """Streams are written as a table, which is read back; the PCM blocks decoded from it go to their description batch by batch."""
    streams = common.table(store(common.documents(spark, sf_dir)), "media-streams", "zstd")
    return describe(decode(streams))
