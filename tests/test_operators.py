"""Operators against NumPy and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.functions import naming
from lumigrid.operators import corr, decompose, demux, dff, filters, frames, geometry, qc, register, roi


def _px(spark, a):
    """(g, p, r, c, x) of an array of frames."""
    n, h, w = a.shape
    rows = [(g, r * w + c, r, c, float(a[g, r, c])) for g in range(n) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "g long, p long, r long, c long, x double")


def _cube(df, shape):
    out = np.full(shape, np.nan)
    for row in df.collect():
        out[row.g, row.r, row.c] = row.x
    return out


@pytest.mark.parametrize("shape,size", [((5, 4, 9), (3, 1, 3)), ((4, 5, 6), (2, 3, 4)), ((3, 3, 4), (1, 1, 7))])
def test_box_filter_reflects(spark, shape, size):
    h, w, n = shape
    a = np.random.default_rng(1).normal(size=(n, h, w))
    got = _cube(filters.smooth(_px(spark, a), shape, size), a.shape)
    want = a
    for axis, s in ((1, size[0]), (2, size[1]), (0, size[2])):
        m = want.shape[axis]
        acc = 0
        for o in range(-(s // 2), s - s // 2):
            j = (np.arange(m) + o) % (2 * m)
            acc = acc + np.take(want, np.where(j < m, j, 2 * m - 1 - j), axis)
        want = acc / s
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_median_filter_picks_a_rank(spark):
    a = np.random.default_rng(2).integers(0, 50, size=(4, 3, 3)).astype(float)
    got = _cube(filters.smooth(_px(spark, a), (3, 3, 4), (3, 1, 2), "median"), a.shape)
    want = np.empty_like(a)
    mirror = lambda j, n: j if 0 <= j < n else (-1 - j if j < 0 else 2 * n - 1 - j)
    for g in range(4):
        for r in range(3):
            for c in range(3):
                near = sorted(a[mirror(g + dg, 4), mirror(r + dr, 3), c] for dg in (-1, 0) for dr in (-1, 0, 1))
                want[g, r, c] = near[3]
    np.testing.assert_array_equal(got, want)


def test_filter_of_ones_is_identity_and_kinds_are_checked(spark):
    a = np.arange(8.0).reshape(2, 2, 2)
    np.testing.assert_array_equal(_cube(filters.smooth(_px(spark, a), (2, 2, 2), (1, 1, 1)), a.shape), a)
    with pytest.raises(ValueError):
        filters.smooth(_px(spark, a), (2, 2, 2), (3, 1, 1), "mode")


def test_masked_smoothing_keeps_a_constant():
    a = np.full((6, 6), 3.0)
    a[0, :2] = np.nan
    out = filters.smooth_masked(a, 1.0)
    assert np.isnan(out[0, 0]) and np.allclose(out[np.isfinite(a)], 3.0)


def test_detrend_even_window(spark):
    m = np.random.default_rng(0).normal(size=23)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(m)], "g long, m double")
    got = [r.resid for r in demux.detrend(rows, 3).orderBy("g").collect()]
    at = np.clip(np.arange(23)[:, None] + np.arange(-3, 3), 0, 22)
    np.testing.assert_allclose(got, m - m[at].mean(1), atol=1e-12)


def _series(spark, n, amps, slip=None, noise=0.01):
    g = np.arange(n)
    phase = (g + np.where(g >= (slip or n + 1), 1, 0)) % len(amps)
    m = np.array(amps)[phase] + 0.001 * g + np.random.default_rng(3).normal(0, noise, n)
    return spark.createDataFrame([(int(i), float(v)) for i, v in zip(g, m, strict=True)], "g long, m double")


def test_demux_check_finds_a_slip(spark):
    files = spark.createDataFrame([(0, 400), (1, 400)], "file_idx long, n long")
    good = demux.analyze(_series(spark, 800, [10.0, 3.0, 6.0]), files, 3)
    assert good["conclusive"] and not good["slip_detected"] and good["dominant_period"] == 3 and good["per_file_offset"] == [0, 0]
    bad = demux.analyze(_series(spark, 800, [10.0, 3.0, 6.0], 400), files, 3)
    assert bad["slip_detected"] and 300 <= bad["slip_frame"] <= 500 and bad["slip_offset"] == 2 and bad["per_file_offset"] == [0, 2]
    assert demux.suggest(bad) == [(bad["slip_frame"], None, 1)]  # from frame 400 on the phase is one ahead
    flat = demux.analyze(_series(spark, 800, [5.0, 5.0, 5.0], noise=1.0), files, 3)
    assert not flat["conclusive"]
    assert not demux.analyze(_series(spark, 10, [1.0, 2.0]), files, 2)["conclusive"]
    assert not demux.analyze(_series(spark, 10, [1.0]), files, 1)["conclusive"]


def test_edits_add_up_and_identity():
    assert demux.is_identity(4, [(0, 5, 4), (3, None, -8)]) and not demux.is_identity(4, [(0, 5, 1)])


def test_regression_degenerates(spark):
    rows = [("flat", t, 5.0 + t % 3, 2.0) for t in range(20)] + [("line", t, 3.0 * (t % 7) + 50, float(t % 7)) for t in range(20)] + [("still", t, 4.0, float(t)) for t in range(20)]
    pairs = spark.createDataFrame(rows, "k string, t long, s double, d double")
    fit = {r.k: r for r in dff.regression(pairs, ["k"]).collect()}
    assert fit["flat"].a == 0 and abs(fit["flat"].b - np.mean([5 + t % 3 for t in range(20)])) < 1e-12 and fit["flat"].r2 == 0
    assert abs(fit["line"].a - 3) < 1e-9 and abs(fit["line"].r2 - 1) < 1e-9
    assert fit["still"].r2 == 0
    out = {(r.k, r.t): r.dff for r in dff.regressed_dff(pairs, ["k"]).collect()}
    assert abs(out["line", 3]) < 1e-9


def test_non_positive_baseline_gives_zero(spark):
    px = spark.createDataFrame([(0, t, float(-1 - t)) for t in range(5)], "p long, t long, x double")
    assert {r.dff for r in dff.percentile_dff(px, ["p"], 5.0).collect()} == {0.0}


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(5)
    td, ts = np.sort(rng.choice(100, 12, replace=False)), np.arange(0, 100, 3)
    vd = rng.normal(size=12)
    rows = [(0, int(t), "d", float(v)) for t, v in zip(td, vd, strict=True)] + [(0, int(t), "s", 0.0) for t in ts]
    got = {r.time: r.d for r in dff.interpolate_reference(spark.createDataFrame(rows, "k long, time long, role string, x double"), ["k"]).collect()}
    np.testing.assert_allclose([got[int(t)] for t in ts], np.interp(ts, td, vd), atol=1e-12)


def test_interpolation_over_stretches_equals_numpy(spark):
    """Long traces are cut; gaps longer than a stretch, equal times, one-sided traces and null times keep their neighbours."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k in (0, 1, None):
        td, ts = np.sort(rng.choice(4000, 90, replace=False)), np.sort(rng.choice(4000, 700, replace=False))
        td = td[(td < 900) | (td > 2600)] if k == 1 else td
        vd = rng.normal(size=len(td))
        rows += [(k, int(t), "d", float(v)) for t, v in zip(td, vd, strict=True)] + [(k, int(t), "s", 0.0) for t in ts]
        want |= {(k, int(t)): v for t, v in zip(ts, np.interp(ts, td, vd), strict=True)}
    rows += [(7, t, "s", 1.0) for t in range(40)] + [(0, None, "s", 2.0), (0, None, "d", 99.0)]
    want |= {(7, t): None for t in range(40)} | {(0, None): None}
    table = spark.createDataFrame(rows, "k long, time long, role string, x double").repartition(5)
    for block in (16, 1 << 16):
        got = {(r.k, r.time): r.d for r in dff.interpolate_reference(table, ["k"], block).collect()}
        assert set(got) == set(want) and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
        known = [k for k, v in want.items() if v is not None]
        np.testing.assert_allclose([got[k] for k in known], [want[k] for k in known], atol=1e-12)


def test_autocorrelation_over_blocks_without_a_join(spark, monkeypatch):
    """Pairs across a block's end count once; gaps and repeated frames meet what a join would give; no series goes to all tasks."""
    monkeypatch.setattr(demux, "BLOCK", 16)
    rng = np.random.default_rng(8)
    g = np.concatenate([np.arange(150), [40, 41], np.arange(170, 300)])
    v = rng.normal(size=len(g))
    found = demux.autocorrelation(spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v, strict=True)], "g long, resid double"), 300, 4)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan
    c = v - v.mean()
    sums = [sum(c[i] * c[j] for i in range(len(g)) for j in np.flatnonzero(g == g[i] + lag)) for lag in range(13)]
    got = {r.lag: r.ac for r in found.collect()}
    assert set(got) == set(range(13))
    np.testing.assert_allclose([got[i] for i in range(13)], np.array(sums) / sums[0], atol=1e-12)


def _slow(x, fps, cutoff, rank):
    """The baseline sample by sample."""
    step = max(1, round(fps))
    low = list(x[::step])
    n, win = len(low), round(cutoff * fps / step)
    win += win % 2 == 0
    at = lambda v, i: v[min(max(i, 0), n - 1)]
    if n < 3 or win < 3:
        base = [float(np.percentile(low, rank))] * n
    else:
        win = min(win, n - 1 + n % 2)
        around = lambda v, i: [at(v, j) for j in range(i - win // 2, i + win // 2 + 1)]
        kth = win - 1 if rank == 100 else int(win * rank / 100)
        ranked = [sorted(around(low, i))[kth] for i in range(n)]
        base = [sum(around(ranked, i)) / win for i in range(n)]
    out = []
    for k in range(len(x)):
        i = max(0, min(k // step, n - 2))
        out.append(max(1e-6, base[i] + (at(base, i + 1) - base[i]) * (k / step - i)))
    return np.array(out)


def test_highpass_divides_by_the_slow_baseline(spark):
    rng = np.random.default_rng(12)
    traces = {"flat": np.full(50, 2.0), "short": np.arange(1.0, 4), "one": np.array([4.0]), "long": rng.uniform(1, 3, 137), "even": rng.uniform(-1, 3, 96)}
    rows = [(k, i * 2 + 5, float(v)) for k, x in traces.items() for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "k string, t long, x double").repartition(4)
    for fps, cutoff, rank in ((5.0, 4.0, 10.0), (1.0, 15.0, 10.0), (10.0, 5.0, 100.0), (3.4, 0.2, 30.0), (4.0, 60.0, 0.0)):
        got = dff.highpass(table, ["k"], fps, cutoff, rank).orderBy("t").toPandas()
        for k, x in traces.items():
            np.testing.assert_allclose(got[got["k"] == k]["y"], x / _slow(x, fps, cutoff, rank), rtol=1e-9)


def test_resize_keeps_constants_and_rounds_size(spark):
    a = np.full((2, 5, 7), 4.0)
    out = frames.resize(_px(spark, a), 5, 7, 2).collect()
    assert {(r.r, r.c) for r in out} == {(i, j) for i in range(2) for j in range(4)} and all(abs(r.x - 4) < 1e-9 for r in out)


def test_adjoint_equals_warp_then_mean(spark):
    a = np.random.default_rng(4).normal(size=(3, 8, 8))
    px, pull = _px(spark, a), ((0.9, -0.1, 0.5), (0.1, 0.9, -0.3))
    rois = spark.createDataFrame([("a", 6, 2, 3), ("edge", 0, 11, 5)], "name string, x long, y long, size long")
    masks = roi.discs(rois, 12, 12)
    one = {(r.roi, r.g): r.v for r in roi.signals_from_source(px, masks, pull, (12, 12), (8, 8)).collect()}
    two = {(r.roi, r.g): r.v for r in roi.signals(geometry.warp(px, pull, (12, 12), (8, 8)), masks).collect()}
    assert all(abs(two[k] - one.get(k, 0.0)) < 1e-12 for k in two)


def test_similarity_recovers_a_transform(spark):
    rng = np.random.default_rng(6)
    src = rng.normal(size=(9, 2))
    m = np.array([[1.2, -0.7], [0.7, 1.2]])
    ref = src @ m.T + [3, -2]
    rows = [(float(s[1]), float(s[0]), float(r[1]), float(r[0])) for s, r in zip(src, ref, strict=True)]
    fit = np.array(geometry.fit_similarity(spark.createDataFrame(rows, "src_r double, src_c double, ref_r double, ref_c double")))
    np.testing.assert_allclose(fit, np.column_stack([m, [3, -2]]), atol=1e-9)
    assert abs(geometry.describe(tuple(map(tuple, fit)))["scale"] - np.hypot(1.2, 0.7)) < 1e-9
    back = np.array([*geometry.inverse(tuple(map(tuple, fit))), (0, 0, 1)])
    np.testing.assert_allclose(back @ np.array([*fit, (0, 0, 1)]), np.eye(3), atol=1e-9)


def test_correlations(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3, 60)) + rng.normal(size=60)
    rows = [(f"r{i}", t, float(v[i, t])) for i in range(3) for t in range(60)] + [("still", t, 1.0) for t in range(60)]
    signal = spark.createDataFrame(rows, "roi string, g long, v double")
    got = {(r.roi_i, r.roi_j): r.r for r in corr.pearson(signal).collect()}
    want = np.corrcoef(v)
    assert abs(got["r0", "r2"] - want[0, 2]) < 1e-12 and got["r0", "still"] is None
    part = {(r.roi_i, r.roi_j): r.r for r in corr.partial(signal.filter("roi <> 'still'")).collect()}
    assert part["r1", "r1"] == 1.0 and abs(part["r0", "r1"]) < 1


def _matrix(rows):
    """Rows of arrays, by their first column, as columns of a matrix."""
    return np.array([list(r[1]) for r in sorted(map(tuple, rows.collect()))]).T


def test_pca_equals_svd_and_ica_subtracts(spark):
    rng = np.random.default_rng(8)
    t = np.arange(40)
    maps = rng.laplace(size=(2, 1200))
    x = np.outer(np.sin(t / 3), maps[0]) * 5 + np.outer(np.sign(np.sin(t / 5)), maps[1]) * 3 + rng.normal(0, 0.01, (40, 1200)) + 100
    px = _px(spark, x.reshape(40, 30, 40))
    p = decompose.pca(px, 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(p.singular, s[:2], rtol=1e-9)
    np.testing.assert_allclose(p.ratio, s[:2] ** 2 / (s**2).sum(), rtol=1e-9)
    np.testing.assert_allclose(np.abs(_matrix(p.spatial.rows()) @ vt[:2].T), np.eye(2), atol=1e-8)
    np.testing.assert_allclose(np.abs(_matrix(p.temporal.rows()) @ u[:, :2]), np.eye(2), atol=1e-8)
    found = decompose.ica(p)
    got, scores = _matrix(found.maps), _matrix(found.scores)
    likeness = np.abs(np.corrcoef(np.vstack([got, maps]))[:2, 2:])
    assert likeness.max(1).min() > 0.99
    np.testing.assert_allclose(got.var(1), 1, rtol=1e-6)
    assert (got[np.arange(2), np.abs(got).argmax(1)] > 0).all() and found.variance[0] > found.variance[1]
    np.testing.assert_allclose(found.variance, scores.var(1), rtol=1e-9)
    low = (u[:, :2] * s[:2]) @ vt[:2]
    np.testing.assert_allclose(scores.T @ got, low, atol=1e-6)
    pivot = lambda df: df.toPandas().pivot(index="g", columns="p", values="x").to_numpy()
    np.testing.assert_allclose(pivot(decompose.subtract(px, found.maps, 2, [0, 1])), x - low, atol=1e-6)
    np.testing.assert_allclose(pivot(decompose.reconstruct(px, found.maps, found.scores, [0, 1])), low + x.mean(0), atol=1e-6)
    np.testing.assert_allclose(pivot(decompose.reconstruct(px, found.maps, found.scores, [])), np.tile(x.mean(0), (40, 1)))
    load = decompose.loadings(px, found.maps, 2, [1]).orderBy("g").toPandas()["a"].str[0].to_numpy()
    np.testing.assert_allclose(load, ((x - x.mean(0)) @ np.linalg.pinv(got))[:, 1], atol=1e-8)
    with pytest.raises(ValueError):
        decompose.subtract(px, found.maps, 2, [5])
    found.drop()
    p.drop()


def test_pca_of_two_long_sides(spark, monkeypatch):
    """Sides beyond the span of one round, several blocks a side, joined factors and factors sent to all tasks."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(700, 9)) * [90, 60, 40, 30, 20, 12, 8, 5, 3]) @ rng.normal(size=(9, 600)) + rng.normal(size=(700, 600)) + 7
    rows = spark.createDataFrame([(int(g) * 3 - 500, int(q) * 11 - 900, float(x[g, q])) for g in range(700) for q in range(600)], "g long, p long, x double").repartition(5)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    for sent in (decompose.SENT, 0):
        monkeypatch.setattr(decompose, "SENT", sent)
        p = decompose.pca(rows, 5)
        np.testing.assert_allclose(p.singular, s[:5], rtol=1e-9)
        v = _matrix(p.spatial.rows())
        np.testing.assert_allclose(v @ v.T, np.eye(5), atol=1e-10)


def test_pca_of_sides_over_8000(spark):
    """Two bright patches in 8,200 frames of 8,200 pixels: nothing of that length is put together on the driver."""
    n = 8_200
    patch = lambda at, size: spark.range(80 * 60).select((at + 41 * (F.col("id") % 80)).alias("g"), (at + 53 * F.floor(F.col("id") / 80)).alias("p"), (F.lit(size) * F.sin(F.col("id") % 80) * F.cos(F.floor(F.col("id") / 80))).alias("x"))
    dim = spark.range(n).select(F.explode(F.array(F.struct(F.col("id").alias("g"), (n - 1 - F.col("id")).alias("p"), F.lit(0.01).alias("x")), F.struct(F.pmod(F.col("id") + 1, F.lit(n)).alias("g"), (n - 1 - F.col("id")).alias("p"), F.lit(-0.01).alias("x")))).alias("e")).select("e.*")
    rows = patch(0, 9.0).unionByName(patch(4_000, 4.0)).unionByName(dim).groupBy("g", "p").agg(F.sum("x").alias("x"))
    p = decompose.pca(rows, 2)
    table = rows.toPandas()
    table["x"] -= table.groupby("p")["x"].transform("mean")
    by = [table[(table["g"] >= lo) & (table["x"].abs() > 0.011) & (table["g"] < lo + 4_000)].pivot(index="g", columns="p", values="x").fillna(0) for lo in (0, 4_000)]
    np.testing.assert_allclose(p.singular, sorted((np.linalg.svd(m, compute_uv=False)[0] for m in by), reverse=True), rtol=1e-4)
    assert p.spatial.rows().count() == p.temporal.rows().count() == n


def test_components_of_nothing(spark):
    px = _px(spark, np.ones((6, 2, 2)))
    for rows in (px, px.limit(0), px.filter("g = 0")):
        p = decompose.pca(rows, 3)
        assert len(p.singular) == 0 and decompose.ica(p).maps.count() == 0
        assert decompose.spectrum(rows, 3).count() == 0


def test_gram_of_sides_gaps_and_far_ids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 170)) + 50
    rows = [(int(g), int(p) * 97, float(x[g, p])) for g in range(300) for p in range(170)]
    px = spark.createDataFrame(rows, "g long, p long, x double").repartition(6)
    c = x - x.mean(0)
    for tiles, values in ((decompose.TILES, decompose.VALUES), (1, 1000)):
        monkeypatch.setattr(decompose, "TILES", tiles)
        monkeypatch.setattr(decompose, "VALUES", values)
        for side, want, step in (("g", c @ c.T, 1), ("p", c.T @ c, 97)):
            got = decompose.gram(px, side).toPandas()
            assert len(got) == len(want) * (len(want) + 1) // 2 and (got["i"] <= got["j"]).all()
            np.testing.assert_allclose(got["v"], want[got["i"] // step, got["j"] // step], atol=1e-8)
    assert decompose.gram(px.limit(0)).count() == 0


def test_fingerprint_counts_repeats_and_tells_null_from_empty(spark):
    of = lambda *rows: tuple(spark.createDataFrame(list(rows), "a string, b long").agg(*naming.fingerprint("a", "b")).first())
    assert of(("x", 1), ("y", 2)) == of(("y", 2), ("x", 1)) != of(("x", 1), ("y", 2), ("y", 2), ("y", 2))
    assert of((None, 1)) != of(("", 1)) and of(("x", 1), ("x", 1))[1] != of(("y", 1), ("y", 1))[1]


def _phase_shift(image, row, col):
    """In double precision, by the whole spectrum."""
    h, w = image.shape
    ramp = np.exp(-2j * np.pi * (np.fft.fftfreq(h)[:, None] * row + np.fft.fftfreq(w)[None, :] * col))
    return np.abs(np.fft.ifft2(np.fft.fft2(image) * ramp))


def _smooth_image(rng, h, w):
    return np.abs(np.fft.ifft2(np.fft.fft2(rng.normal(size=(h, w))) * np.exp(-8 * (np.abs(np.fft.fftfreq(h))[:, None] + np.abs(np.fft.fftfreq(w))[None])))) * 100


@pytest.mark.parametrize("h, w", [(32, 32), (31, 40), (33, 27)])
def test_registration_recovers_shifts(spark, h, w):
    base = _smooth_image(np.random.default_rng(9), h, w)
    moves = [(0.0, 0.0), (3.0, -2.0), (1.5, 0.25)]
    rows = [(i, h, w, _phase_shift(base, -r, -c).ravel().tolist()) for i, (r, c) in enumerate(moves)]
    df = spark.createDataFrame(rows, "g long, h int, w int, pix array<double>")
    out = register.register(df, base, 20).orderBy("g").collect()
    for row, (r, c), source in zip(out, moves, rows, strict=True):
        assert abs(row.shift_r - r) <= 0.05 and abs(row.shift_c - c) <= 0.05
        np.testing.assert_allclose(np.array(row.pix).reshape(h, w), _phase_shift(np.array(source[3]).reshape(h, w), row.shift_r, row.shift_c), atol=2e-2)
    np.testing.assert_allclose(np.array(out[1].pix).reshape(h, w), base, atol=1e-3)
    with pytest.raises(Exception, match="the template has"):
        register.register(df, base[:-1], 20).collect()


@pytest.mark.parametrize("factor", [50, 500])
def test_refinement_equals_the_whole_grid(factor):
    """On full-size frames: the best of all grid points, in double precision."""
    rng = np.random.default_rng(factor)
    base = _smooth_image(rng, 540, 640) * 20
    t = register.Template(base)
    for move in ((2.31, -7.774), (-0.4, 0.062)):
        frame = np.round(_phase_shift(base, *move))
        got = t.shift_of(np.fft.rfft2(frame.astype(np.float32)), factor)
        cross = np.fft.fft2(base) * np.conj(np.fft.fft2(frame))
        near = [np.round(v * factor) / factor + np.arange(-3, 4) / factor for v in (-move[0], -move[1])]
        score = np.abs(np.exp(2j * np.pi * np.outer(near[0], np.fft.fftfreq(540))) @ cross @ np.exp(2j * np.pi * np.outer(np.fft.fftfreq(640), near[1])))
        i, j = np.unravel_index(score.argmax(), score.shape)
        assert abs(got[0] - near[0][i]) <= 1.01 / factor and abs(got[1] - near[1][j]) <= 1.01 / factor


def test_content_consistency_flags_a_mixed_file(spark):
    rows = [(f, ch, ch if f == 0 or i else 1 - ch) for f in (0, 1) for ch in (0, 1) for i in range(3)] + [(0, ch, ch) for ch in (0, 1) for _ in range(5)]
    out = {(r.file_idx, r.ch): r.flagged for r in qc.consistency(spark.createDataFrame(rows, "file_idx long, ch long, cluster long")).collect()}
    assert not out[0, 0] and out[1, 0] and out[1, 1]


def test_two_level_rank_equals_one_window(spark):
    rows = spark.range(1000).select(F.col("id").alias("g"), (F.col("id") * 7 % 3).alias("ch"))
    got = {r.g: r.t for r in demux.index_in_channel(rows, block=64).collect()}
    seen = {0: 0, 1: 0, 2: 0}
    for g in range(1000):
        ch = g * 7 % 3
        assert got[g] == seen[ch]
        seen[ch] += 1


def test_products_of_a_factor_share_one_worker(spark):
    """However many small matrices follow each other, reading them takes one Python step, and blocks leave it a few at a time."""
    rng = np.random.default_rng(2)
    m, a, b = rng.normal(size=(5000, 3)), rng.normal(size=(3, 4)), rng.normal(size=(4, 2))
    blocks = [(i, list(range(i * 256, min(5000, i * 256 + 256))), m[i * 256 : i * 256 + 256].tobytes()) for i in range(20)]
    twice = decompose.Factor(spark.createDataFrame(blocks, decompose._BLOCK), 3).times(a).times(b)
    for table in (twice.rows(), twice.blocks):
        assert table._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    got = {r.id: r.v for r in twice.rows().collect()}
    np.testing.assert_allclose([got[i] for i in range(5000)], m @ a @ b, atol=1e-9)
    saved = np.concatenate([np.frombuffer(bytes(r.m)).reshape(-1, 2) for r in twice.blocks.orderBy("b").collect()])
    np.testing.assert_allclose(saved, m @ a @ b, atol=1e-9)
    assert [x.num_rows for x in decompose._blocks((0, np.arange(1), np.zeros((1, 1))) for _ in range(40))] == [16, 16, 8]
