"""Recording files, made here byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.sources import binary, frames, listing


def test_tiff_round_trip(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 60000, size=(5, 6, 7)).astype(np.uint16)
    (tmp_path / "a10.tif").write_bytes(binary.write_tiff(a))
    (tmp_path / "a9.tif").write_bytes(binary.write_tiff(a[:2], compress=False))
    frames.register(spark)
    rows = spark.read.format("lumigrid_tiff").load(str(tmp_path)).orderBy("file_idx", "frame_index").collect()
    assert [(r.file_idx, r.frame_index) for r in rows] == [(0, 0), (0, 1), *((1, i) for i in range(5))]  # a9 before a10
    np.testing.assert_array_equal(np.array(rows[4].pix).reshape(6, 7), a[2])


@pytest.mark.parametrize("new", [True, False])
def test_dcimg(spark, tmp_path, new):
    a = np.arange(3 * 4 * 5, dtype=np.uint16).reshape(3, 4, 5)
    row, footer, head, data = 12, 16 if new else 0, 100, 200
    file_head = bytearray(head)
    file_head[:8] = b"DCIMG\0\0\0"
    struct.pack_into("<I", file_head, 8, 0x1000000 if new else 0x7)
    struct.pack_into("<I", file_head, 40, head)
    session = bytearray(data)
    if new:
        struct.pack_into("<3I4I", session, 60, 3, 2, 0, 5, 4, row, row * 4)
        struct.pack_into("<Q", session, 96, data)
        struct.pack_into("<I", session, 124, footer)
    else:
        struct.pack_into("<7I", session, 32, 3, 2, 0, 5, row, 4, row * 4)
        struct.pack_into("<I", session, 68, data)
    body = b""
    for i in range(3):
        body += b"".join(a[i, r].tobytes() + b"\0" * (row - 10) for r in range(4)) + (struct.pack("<4I", 7 + i, 100 + i, 5, 0) if new else b"")
    (tmp_path / "x.dcimg").write_bytes(bytes(file_head) + bytes(session) + body)
    frames.register(spark)
    rows = spark.read.format("lumigrid_dcimg").load(str(tmp_path)).orderBy("frame_index").collect()
    np.testing.assert_array_equal(np.array([r.pix for r in rows]).reshape(a.shape), a)
    assert [r.framestamp for r in rows] == ([7, 8, 9] if new else [None] * 3)
    with pytest.raises(ValueError):
        binary.Dcimg.parse(b"nothing" + bytes(100))


def test_spool(spark, tmp_path):
    (tmp_path / "acquisitionmetadata.ini").write_text("[data]\nAOIHeight=2\nAOIWidth=3\nAOIStride=8\nPixelEncoding=Mono16\nImageSizeBytes=16\n[multiimage]\nImagesPerFile=2\n")
    image = lambda v: b"".join(np.full(3, v, "<u2").tobytes() + b"\0\0" for _ in range(2))
    (tmp_path / "0000000000spool.dat").write_bytes(image(1) + image(2))
    (tmp_path / "1000000000spool.dat").write_bytes(image(3) + image(4))
    (tmp_path / "0100000000spool.dat").write_bytes(image(5))  # its digits reversed: 10, the last and short
    frames.register(spark)
    rows = spark.read.format("lumigrid_spool").load(str(tmp_path)).orderBy("file_idx", "frame_index").collect()
    assert [r.pix[0] for r in rows] == [1, 2, 3, 4, 5]
    assert spark.read.format("lumigrid_spool").option("frames", 3).load(str(tmp_path)).count() == 3


def test_listing(spark, tmp_path):
    for n in ("b10.tif", "b2.TIFF", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    files = listing.list_files(spark, str(tmp_path))
    got = listing.recording_files(files).orderBy("file_idx").collect()
    assert [r["name"] for r in got] == ["b2.TIFF", "b10.tif"]
    assert listing.experiment_stem(listing.recording_files(files)) == "b2"
    with pytest.raises(FileNotFoundError):
        listing.recording_files(files, "dcimg")
    (tmp_path / "c.dcimg").write_bytes(b"x")
    with pytest.raises(ValueError):
        listing.recording_files(listing.list_files(spark, str(tmp_path)))
    assert listing.recording_files(listing.list_files(spark, str(tmp_path)), "tiff").count() == 2
    assert listing.list_files(spark, str(tmp_path)).filter(F.col("format") == "dcimg").count() == 1
