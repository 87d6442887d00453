"""Ancestors, surfaces, regions, masks and rotated volumes against plain Python and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import atlas_build


def test_closure_of_chains_and_cycles(spark):
    chain = [(i, i - 1, f"n{i}") for i in range(1, 12)] + [(100, 3, "side"), (200, 999, "alone")]
    tree = spark.createDataFrame(chain, "node long, parent long, name string")
    parent = {n: p for n, p, _ in chain}
    want = set()
    for n in parent:
        at, d = n, 0
        while at in parent:
            want.add((n, at, d))
            at, d = parent[at], d + 1
    assert {tuple(r) for r in atlas_build.closure(tree).collect()} == want
    inside = atlas_build.members(atlas_build.closure(tree), atlas_build.named(tree, ["n10", 100]))
    assert {r.node for r in inside.collect()} == {10, 11, 100}
    with pytest.raises(ValueError, match="unknown"):
        atlas_build.named(tree, [1, "nothing"])
    with pytest.raises(ValueError, match="cycle"):
        atlas_build.closure(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))
    assert atlas_build.closure(tree.limit(0)).count() == 0


@pytest.mark.parametrize("degrees", [0.0, 90.0, 180.0, -90.0, 17.0, 123.4])
def test_rotated_planes(spark, degrees):
    rng = np.random.default_rng(1)
    n, m = 7, 10
    plane = rng.integers(1, 99, (n, m))
    cos, sin = np.round(np.cos(np.radians(degrees)), 15), np.round(np.sin(np.radians(degrees)), 15)
    want = np.zeros_like(plane)
    for i in range(n):
        for j in range(m):
            y, x = cos * (i - 3) + sin * (j - 4.5) + 3, -sin * (i - 3) + cos * (j - 4.5) + 4.5
            if -1e-9 <= y <= n - 1 + 1e-9 and -1e-9 <= x <= m - 1 + 1e-9:
                want[i, j] = plane[int(np.floor(y + 0.5)), int(np.floor(x + 0.5))]
    voxels = spark.createDataFrame([(2, i, j, int(plane[i, j])) for i in range(n) for j in range(m)], "ap long, dv long, ml long, idx long")
    got = np.zeros_like(plane)
    for r in atlas_build.tilt(voxels, (5, n, m), ap=degrees).collect():
        assert r.ap == 2
        got[r.dv, r.ml] = r.idx
    assert (got != want).sum() <= (0 if degrees % 90 == 0 else 1)
    if degrees == 180.0:
        np.testing.assert_array_equal(got, plane[::-1, ::-1])


def test_build_from_a_volume(spark, tmp_path):
    """Two areas under one root, another structure above them, seen from above."""
    tree = spark.createDataFrame([(1, 0, "root"), (2, 1, "cortex"), (3, 2, "VIS1"), (4, 2, "VIS2/3"), (5, 2, "MO1"), (6, 1, "skin")], "node long, parent long, name string")
    rows = []
    for ap in range(8):
        for ml in range(12):
            rows += [(ap, 0, ml, 6), (ap, 1, ml, 3 if ap < 4 else 5), (ap, 2, ml, 4)]
    voxels = spark.createDataFrame(rows, "ap long, dv long, ml long, idx long")
    labels, names = atlas_build.build(voxels, tree, ["cortex"], (8, 12), (4, 6), least=3, cols=(0.0, 1.0))
    ids = np.zeros((4, 6), int)
    for r in labels.collect():
        ids[r.r, r.c] = r.region_id
    told = {r.region_id: r.name for r in names.collect()}
    assert told == {1: "background", 2: "VIS", 3: "VIS_R", 4: "MO", 5: "MO_R"}
    np.testing.assert_array_equal(ids, [[2, 2, 2, 3, 3, 3]] * 2 + [[4, 4, 4, 5, 5, 5]] * 2)
    atlas_build.save(str(tmp_path / "atlas"), labels, names)
    loaded, found, outlines = atlas_build.load(spark, str(tmp_path / "atlas"))
    assert loaded.count() == 24 and outlines.count() > 0 and atlas_build.brain_mask(loaded).count() == 24
    assert {(r.r, r.c) for r in atlas_build.region_mask(loaded, found, ["MO", 3]).collect()} == {(r, c) for r in range(4) for c in range(6) if ids[r, c] in (4, 3)}
    with pytest.raises(ValueError, match="unknown"):
        atlas_build.region_mask(loaded, found, ["nowhere"])
    atlas_build.save(str(tmp_path / "bad"), labels, names.filter("region_id <> 4"))
    with pytest.raises(ValueError, match=r"\[4\]"):
        atlas_build.load(spark, str(tmp_path / "bad"))


def test_small_areas_and_empty_labels_are_background(spark):
    labels = spark.createDataFrame([(0, c, lab) for c, lab in enumerate(["a", "a", "a", "b", "", None])], "r long, c long, label string")
    px, names = atlas_build.regions(labels, 6, least=2)
    assert [r.region_id for r in px.orderBy("c").collect()] == [2, 2, 2, 1, 1, 1] and names.count() == 3


def test_masks_newest_and_nearest(spark):
    masks = spark.createDataFrame([(0, 1, 1), (5, 1, 1), (62, 0, 0), (0, 1, 1)], "bit int, r long, c long")
    assert {(r.r, r.c): r.bits for r in atlas_build.mask_bits(masks).collect()} == {(1, 1): 33, (0, 0): 1 << 62}
    files = spark.createDataFrame([("a", 3, 10), ("b", 4, 30), ("c", 5, 30)], "path string, size_bytes long, mtime long")
    assert tuple(atlas_build.newest(files).first()) == ("c", 3, 12)
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 5.0), (2, 1.0, 0.0)], "id long, r double, c double")
    got = {r.id: (r.i, r.d2) for r in atlas_build.nearest([(2.0, 0.0), (0.0, 0.0), (6.0, 5.0)], at).collect()}
    assert got == {0: (1, 0.0), 1: (2, 1.0), 2: (0, 1.0)}
    assert atlas_build.framed(spark.range(6).select(F.lit(0).alias("r"), F.col("id").alias("c")), (1, 6), (1, 3), cols=(0.0, 1.0)).orderBy("c").count() == 3
