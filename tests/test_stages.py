"""From a folder of files and settings in use to results; what is computed again when something changes."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid import config, state, store
from lumigrid.plans import session
from lumigrid.sources import binary

STAGES = ("preprocess", "pca", "ica", "roi", "correlation")


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    """Two files of different size, 2 channels, a region that is active."""
    folder = tmp_path_factory.mktemp("recording")
    rng = np.random.default_rng(2)
    t = np.arange(60)
    cube = rng.normal(0, 2, (60, 7, 8)) + np.where(t % 2 == 0, 1500, 900)[:, None, None]
    cube[:, 2:5, 4:7] += (80 * np.sin(t / 4) * (t % 2 == 0))[:, None, None]
    cube = cube.round().astype(np.uint16)
    (folder / "rec_2.tif").write_bytes(binary.write_tiff(cube[:25]))
    (folder / "rec_10.tif").write_bytes(binary.write_tiff(np.pad(cube[25:], ((0, 0), (0, 1), (0, 0)))))
    return folder, cube


def _session(spark, folder, out, **more):
    values = {
        "input_dir": str(folder), "output_dir": str(out), "channels_name": ["a", "a"], "channels_prop": ["s", "d"], "do_registration": False, "fps": 4, "start_initial_frames": 0, "flag_binning": 0, "registration_cache": "cached",
        "roi_space": "source", "pca_n_components": 3, "pca_skip_frames": 1, "corr_method": "raw", "linear_subt": True, "hemovar_qc": True, "demux_qc": False, "exp_name": "x", "save_movie": False, "annotation": "cache", "output_metadata_yaml": True,
    } | more
    path = out / "settings.json"
    path.write_text(json.dumps(values))
    with pytest.warns(UserWarning, match="save_movie"):
        c = config.in_use(json.loads(path.read_text()))
    rois = spark.createDataFrame([("on", 5, 3, 2), ("off", 1, 3, 2)], "name string, x long, y long, size long")
    seen = session.Recording()
    return session.Session.from_files(spark, c, rois=rois, reporter=seen), seen


def _done(seen):
    return [n for n, status in seen.events if status == "done"]


def test_files_to_results_and_what_goes_stale(spark, recording, tmp_path):
    folder, cube = recording
    s, seen = _session(spark, folder, tmp_path, save_registered_each_ch=True, save_raw_each_ch=True, tiff_compression=True, save_roi_signals="csv")
    out = s.run(STAGES)
    assert _done(seen) == list(STAGES) and (s.height, s.width) == (7, 8)
    raw = out["roi_signals_raw"].toPandas().pivot(index="g", columns="roi", values="v")
    assert raw["on"].std() > 10 * raw["off"].std() and len(raw) == 30
    np.testing.assert_allclose(raw["off"], np.trunc(cube[0::2, 2:5, 0:3][:, [0, 1, 1, 1, 2], [1, 0, 1, 2, 1]]).mean(1))
    spread = out["roi_signals"].toPandas().pivot(index="g", columns="roi", values="v")["on"].std()
    # one timeline, a channel and a stretch a folder, stored means
    one = store.channel(out["registered"], 1, 3, 5)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ch" in plan and "(ch#" in plan and one.count() == 2 * 56
    means = s.written | {"mean_images": f"{s._folder('preprocess')}/mean_images"}
    for stored in (means["mean_images"], str(tmp_path / "nothing")):
        got = store.mean_image(spark, out["registered"], stored, 0).toPandas().set_index(["r", "c"])["mean"]
        np.testing.assert_allclose([got[r, c] for r in range(7) for c in range(8)], cube[0::2].mean(0).ravel())
    when = s.times("a").orderBy("t").collect()
    assert [(r.source_sec, r.reference_sec) for r in when[:2]] == [(0.0, 0.25), (0.5, 0.75)] and len(when) == 30
    # files
    assert sorted(os.listdir(tmp_path / "stacks")) == ["x_raw_Ch0.tif", "x_raw_Ch1.tif", "x_registered_Ch0.tif", "x_registered_Ch1.tif"]
    stack = (tmp_path / "stacks" / "x_registered_Ch1.tif").read_bytes()
    np.testing.assert_array_equal([p.pixels(stack) for p in binary.tiff_pages(stack)], cube[1::2])
    assert (tmp_path / "roi_signals_a_csv").is_dir()
    # nothing changed: all is read
    more = dict(save_registered_each_ch=True, save_raw_each_ch=True, tiff_compression=True, save_roi_signals="csv")
    s, seen = _session(spark, folder, tmp_path, **more)
    again = s.run(STAGES)
    assert _done(seen) == [] and again["network"].count() == 1 and again["dff"].count() == 30 * 56
    # a late setting: its stage only
    s, seen = _session(spark, folder, tmp_path, corr_auto_threshold=False, corr_network_threshold=0.0, **more)
    assert s.run(STAGES)["network"].count() == 1 and _done(seen) == ["correlation"]
    # a decision about components: from that stage on, with the components read
    state.save_exclusion(str(tmp_path), "a", [0])
    s, seen = _session(spark, folder, tmp_path, ica_denoise="subtract", **more)
    s.run(STAGES)
    assert _done(seen) == ["ica", "roi", "correlation"]
    assert s.tables["denoised_a"].count() == 30 * 56
    on = s.tables["roi_signals"].toPandas().pivot(index="g", columns="roi", values="v")["on"]
    assert on.std() < 0.5 * spread
    # the folder holds one version of each stage
    assert all(len(os.listdir(tmp_path / stage)) == 1 for stage in STAGES)


def test_changed_files_and_cancelled_runs(spark, recording, tmp_path):
    folder, cube = recording
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for n in os.listdir(folder):
        (tmp_path / "in" / n).write_bytes((folder / n).read_bytes())
    run = lambda **more: _session(spark, tmp_path / "in", tmp_path / "out", **more)
    s, seen = run()
    left = iter([False, True])
    s.cancelled = lambda: next(left)
    with pytest.raises(session.Cancelled):
        s.run(("preprocess", "pca"))
    s, seen = run()
    s.run(("preprocess",))
    assert _done(seen) == []  # what was complete stays
    (tmp_path / "in" / "rec_2.tif").write_bytes(binary.write_tiff(cube[:25] + np.uint16(1)))
    s, seen = run()
    s.run(("preprocess",))
    assert _done(seen) == ["preprocess"]
    s, seen = run(linear_subt=False)
    s.run(("preprocess",))
    assert _done(seen) == ["preprocess"] and "hemovar" not in s.tables
    base = np.percentile((cube.astype(float) + (np.arange(60) < 25)[:, None, None])[0::2], 5, axis=0)
    got = s.tables["dff"].filter("r = 3 and c = 5").orderBy("g").toPandas()["x"]
    np.testing.assert_allclose(got, ((cube + (np.arange(60) < 25)[:, None, None])[0::2, 3, 5] - base[3, 5]) / base[3, 5], rtol=1e-5)


def test_all_settings_of_files_in_use():
    """Every name that files in use hold is read; what changes results is checked."""
    values = {
        "input_dir": "in", "input_format": "auto", "input_order": "natural", "output_dir": None, "channels_name": None, "channels_prop": None, "channels_slip": None, "do_registration": True, "registration_cache": "force", "linear_subt": True,
        "baseline_percentile": 5.0, "detrend": False, "baseline_percentile_highpass": False, "baseline_percentile_highpass_sec": 120.0, "baseline_percentile_highpass_rank": 50.0, "hemovar_qc": True, "start_initial_frames": None, "ignore_last_frames": 0,
        "binning": 2, "flip": False, "delete": True, "fps": 20, "use_mmap": False, "registration_batch_size": 500, "usfac": 50, "template": None, "template_stride": 100, "template_ch": 0, "output_format": "mat", "exp_name": None, "max_frames": None,
        "output_metadata_yaml": True, "dcimg_backend": "auto", "filter_xyt": None, "filter_xyt_kind": "mean", "demux_qc": True, "demux_start_offset": 0, "annotation": "cache", "annotation_allow_reflection": False, "ch_for_annotation": 0, "roi_signal": "Both",
        "roi_space": "atlas", "save_roi_signals": "csv", "corr_method": "raw", "corr_auto_threshold": True, "corr_edge_density": 0.2, "corr_network_threshold": 0.3, "save_movie": False, "save_raw_each_ch": False, "save_registered_each_ch": False,
        "save_annotated_each_ch": False, "save_annotated_dF_mat": False, "save_annotated_dF_dtype": "float32", "export_orientation": "HWT", "post_annotation_time_average": 0, "post_annotation_filter_xyt": None, "post_annotation_filter_kind": "mean",
        "tiff_format": "big-tiff", "tiff_compression": False, "save_figures": "none", "pca_n_components": 10, "pca_smooth_sigma": 5.0, "pca_skip_frames": 10, "skip_ica": False, "ica_n_components": None, "ica_max_iter": 1000, "ica_random_state": 0,
        "ica_exclusion": "cache", "ica_denoise": "off", "annotation_atlas_path": "", "save_movie_speed": 2.0, "save_movie_codec": "MJPG", "save_movie_vminmax": [-2, 10], "save_movie_cmap": "magma", "save_movie_merge_chs": False,
    }
    with pytest.warns(UserWarning, match="export_orientation"):
        c = config.in_use(values)
    assert c.channels_name == ["BL", "BL"] and c.registration and c.reference_times and c.fit_stride == 10 and c.ica_denoise == "off" and c.corr_methods == ["raw"]
    for bad in ({"ica_denoise": "subtract", "skip_ica": True}, {"ica_exclusion": {"zz": [1]}}, {"ica_exclusion": {"BL": [-1]}}, {"usfac": 0}, {"post_annotation_filter_xyt": [1, 2]}, {"registration_cache": "no"}, {"ch_for_annotation": 2}, {"save_roi_signals": "xls"}):
        with pytest.raises(config.ConfigError):
            config.in_use(bad)


def test_export_filters_and_inline_points(spark, tmp_path):
    rows = [(g, 0, r, c, float(100 + g * (1 + r) + 3 * c)) for g in range(12) for r in range(4) for c in range(4)]
    px = spark.createDataFrame(rows, "g long, file_idx long, r long, c long, x double")
    still = ([[0, 0], [3, 0], [0, 3]], [[0, 0], [3, 0], [0, 3]])
    c = config.Config(output_dir=str(tmp_path), fps=2, start_initial_frames=0, binning=0, annotation=still, atlas_filter_xyt=(1, 1, 3), write_annotated=True, exp_name="e")
    s = session.Session(spark, c, px, 4, 4, atlas_shape=(4, 4))
    out = s.run(("preprocess", "annotation", "export"))
    dff = {(r.g, r.r, r.c): r.x for r in out["dff"].collect()}
    got = {(r.g, r.r, r.c): r.x for r in out["dff_atlas"].collect()}
    assert got[5, 1, 2] == pytest.approx(np.mean([dff[g, 1, 2] for g in (4, 5, 6)]), abs=1e-6) and len(got) == len(dff)
    raw = (tmp_path / "stacks" / "e_annotated_Ch0.tif").read_bytes()
    np.testing.assert_array_equal([p.pixels(raw)[2, 3] for p in binary.tiff_pages(raw)], [100 + g * 3 + 9 for g in range(12)])
    assert out["annotation_source"].filter((F.col("r") == 0) & (F.col("c") == 0)).first()["mean"] == pytest.approx(105.5)
