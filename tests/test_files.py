"""From files to a timeline: places, byte ranges, filters, writers."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.sources import binary, frames, seek


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    stacks = [rng.integers(0, 60_000, (n, h, w)).astype(np.uint16) for n, h, w in ((5, 6, 7), (0, 6, 7), (3, 5, 8))]
    for i, s in enumerate(stacks):
        (tmp_path / f"rec_{i + 9}.tif").write_bytes(binary.write_tiff(s, compress=i == 2))
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path, stacks


def test_index_and_timeline(spark, folder):
    path, stacks = folder
    places = frames.index(spark, str(path), "tif")
    assert [tuple(r) for r in frames.counts(places).select("file_idx", "n", "h", "w", "kind").orderBy("file_idx").collect()] == [(0, 5, 6, 7, "<u2"), (2, 3, 5, 8, "<u2")]
    size = frames.common_size(places)
    assert size == (5, 7)
    rows = frames.load(frames.timeline(places), size).orderBy("g").collect()
    assert [(r.g, r.file_idx, r.frame_index) for r in rows] == [*((i, 0, i) for i in range(5)), *((5 + i, 2, i) for i in range(3))]
    want = np.concatenate([s[:, :5, :7] for s in stacks if len(s)])
    np.testing.assert_array_equal(np.array([r.pix for r in rows]).reshape(want.shape), want)
    px = frames.pixels(frames.load(frames.timeline(places).filter("g between 4 and 6"), size))
    got = np.zeros_like(want)
    for r in px.collect():
        got[r.g, r.r, r.c] = r.x
    np.testing.assert_array_equal(got[4:7], want[4:7])
    assert px.count() == 3 * 35 and frames.load(places.limit(0)).count() == 0


def test_filters_reach_the_files(spark, folder, tmp_path_factory):
    path, stacks = folder
    (path / "rec_99.tif").write_bytes(b"II*\0 not a TIFF at all")  # fails as soon as it is looked at
    frames.register(spark)
    df = spark.read.format("lumigrid_tiff").load(str(path)).filter("file_idx = 0 and frame_index >= 2 and frame_index in (1, 3, 4)")
    assert sorted(r.frame_index for r in df.collect()) == [3, 4]
    assert df.filter("h = 6").count() == 2
    with pytest.raises(Exception, match="TIFF"):
        spark.read.format("lumigrid_tiff").load(str(path)).count()


def test_each_byte_is_read_once(tmp_path):
    stack = np.arange(400 * 64 * 64, dtype=np.uint16).reshape(400, 64, 64)
    (tmp_path / "a.tif").write_bytes(raw := binary.write_tiff(stack, compress=False))
    with seek.Reader(str(tmp_path / "a.tif")) as f:
        places = list(seek.tiff_places(f))
    with seek.Reader(str(tmp_path / "a.tif")) as f:
        for p in places:
            np.testing.assert_array_equal(seek.pixels(f, p), stack[p.frame_index])
        assert f.fetched == stack.nbytes < len(raw)


def test_places_in_strips_and_both_orders(tmp_path):
    """Two strips a frame, big-endian, classic directories."""
    a = np.arange(24, dtype=">u2").reshape(4, 6)
    data = a.tobytes()
    entries = [(256, 4, 1, 6), (257, 4, 1, 4), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (262, 3, 1, 1 << 16), (273, 4, 2, 200), (277, 3, 1, 1 << 16), (278, 4, 1, 2), (279, 4, 2, 208)]
    raw = bytearray(struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", 9) + b"".join(struct.pack(">HHII", *e) for e in entries) + struct.pack(">I", 0))
    raw += bytes(200 - len(raw)) + struct.pack(">4I", 300, 400, 24, 24) + bytes(84) + data[:24] + bytes(76) + data[24:]
    (tmp_path / "b.tif").write_bytes(raw)
    with seek.Reader(str(tmp_path / "b.tif")) as f:
        (p,) = seek.tiff_places(f)
        np.testing.assert_array_equal(seek.pixels(f, p), a)
    loop = bytearray(binary.write_tiff(np.zeros((1, 2, 2), np.uint8)))
    loop[-8:] = struct.pack("<Q", struct.unpack_from("<Q", loop, 8)[0])
    (tmp_path / "c.tif").write_bytes(loop)
    with seek.Reader(str(tmp_path / "c.tif")) as f, pytest.raises(ValueError, match="chain"):
        list(seek.tiff_places(f))


@pytest.mark.parametrize("compress", [False, True])
def test_stacks_round_trip(spark, tmp_path, compress):
    rows = spark.range(90).select((F.col("id") % 3).alias("ch"), F.floor(F.col("id") / 3).alias("t"), F.lit(4).alias("h"), F.lit(5).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (F.col("id") * 100 + i).cast("int")).alias("pix")).repartition(7)
    out = str(tmp_path / "out")
    frames.write_stacks(rows, out, "x_Ch", compress)
    assert sorted(os.listdir(out)) == ["x_Ch0.tif", "x_Ch1.tif", "x_Ch2.tif"]
    frames.register(spark)
    got = {(r.file_idx, r.frame_index): list(r.pix) for r in spark.read.format("lumigrid_tiff").load(out).collect()}
    assert got == {(r.ch, r.t): list(r.pix) for r in rows.collect()}
    assert [p.pixels(raw)[0, 0] for raw in [open(f"{out}/x_Ch1.tif", "rb").read()] for p in binary.tiff_pages(raw)] == [100 + 300 * t for t in range(30)]
    with pytest.raises(Exception, match="already"):
        frames.write_stacks(rows, out, "x_Ch")
    frames.write_stacks(rows.filter("t < 2"), out, "x_Ch", mode="overwrite")
    assert spark.read.format("lumigrid_tiff").load(out).count() == 6


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.range(40).select((F.col("id") % 4).alias("ch"), F.floor(F.col("id") / 4).alias("t"), F.lit(2).alias("h"), F.lit(2).alias("w"), F.array(*(F.lit(i) for i in range(4))).alias("pix"))
    bad = good.withColumn("pix", F.when((F.col("ch") == 2) & (F.col("t") == 9), F.array(F.lit(1))).otherwise(F.col("pix")))
    with pytest.raises(Exception, match="reshape"):
        frames.write_stacks(bad, out)
    assert os.listdir(out) == []
    with pytest.raises(Exception, match="order"):
        frames.write_stacks(good.withColumn("t", F.lit(1)), out)
    assert os.listdir(out) == []


def test_a_spool_becomes_a_stack(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    (spool / "acquisitionmetadata.ini").write_text("[data]\nAOIHeight=2\nAOIWidth=3\nAOIStride=8\nPixelEncoding=Mono16\nImageSizeBytes=16\n[multiimage]\nImagesPerFile=2\n")
    image = lambda v: b"".join(np.full(3, v, "<u2").tobytes() + b"\0\0" for _ in range(2))
    (spool / "0000000000spool.dat").write_bytes(image(1) + image(2))
    (spool / "1000000000spool.dat").write_bytes(image(3) + image(4))
    (spool / "0100000000spool.dat").write_bytes(image(5))
    frames.convert(spark, str(spool), "spool", str(tmp_path / "out"), max_frames=4)
    raw = (tmp_path / "out" / "stack0.tif").read_bytes()
    assert [int(p.pixels(raw)[1, 2]) for p in binary.tiff_pages(raw)] == [1, 2, 3, 4]
