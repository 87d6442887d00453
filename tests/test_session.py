"""Configuration, decisions and the staged run."""

import numpy as np
import pytest

from lumigrid import config, state
from lumigrid.operators import dff
from lumigrid.plans import session


def test_config(tmp_path):
    c = config.from_dict({"channel_names": ["a", "b", "a"], "channels_prop": ["s", " D ", "source"], "legacy_mode": 1, "fps": 30})
    assert c.groups() == {"a": {"source": [0, 2], "donner": []}, "b": {"source": [], "donner": [1]}} and c.initial_skip == 40
    config.save(c, str(tmp_path))
    assert config.load(str(tmp_path)) == c and config.load(str(tmp_path), fps=10).fps == 10
    for bad in ({"fps": 0}, {"channels_name": ["a b"]}, {"nonsense": 1}, {"channels_prop": ["x"]}, {"filter_xyt": [1, 0, 1]}):
        with pytest.raises(config.ConfigError):
            config.from_dict(bad)
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path), fps=-1)
    assert c.window(20) == (0, 20) and config.Config(start_initial_frames=2, ignore_last_frames=3).window(20) == (2, 17)


def test_decisions(tmp_path):
    d = str(tmp_path)
    assert state.load_exclusion(d, "a") is None
    state.save_exclusion(d, "a", [2, 0, 2, -1])
    state.save_exclusion(d, "b", [])
    assert state.load_exclusion(d, "a") == [0, 2] and state.load_exclusion(d, "b") == []
    assert state.resolve_exclusion(d, "a", {"a": [3, 1]}) == [1, 3] and state.resolve_exclusion(d, "a", False) == [] and state.resolve_exclusion(d, "a", None) == [0, 2]
    state.save_correction(d, 4, 1, [(0, 5, 1)])
    assert state.load_correction(d, 4) == (1, [(0, 5, 1)]) and state.load_correction(d, 3) is None
    state.save_marks(d, [(1, 2, 3, 4)])
    state.save_marks(d, [(5, 6, 7, 8)])
    assert state.load_marks(d) == [(5, 6, 7, 8)] and (tmp_path / "marks.json.old").exists()
    (tmp_path / "dff").mkdir()
    assert state.delete_derived(d) == ["dff"] and state.load_marks(d)
    (tmp_path / "ica_exclusion.json").write_text("{")
    with pytest.raises(ValueError):
        state.load_exclusion(d, "a")


def test_staged_run(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(80):
        t, source = g // 2, g % 2 == 0
        for r in range(6):
            for c in range(6):
                v = (1500 + 60 * np.sin(t / 3) * (c > 2) + 20 * (t % 5) if source else 900 + 20 * (t % 5)) + rng.normal(0, 3)
                rows.append((g, g // 40, r, c, float(v)))
    px = spark.createDataFrame(rows, "g long, file_idx long, r long, c long, x double")
    rois = spark.createDataFrame([("L", 1, 3, 3), ("R", 4, 3, 3)], "name string, x long, y long, size long")
    c = config.Config(output_dir=str(tmp_path), channels_name=["a", "a"], channels_prop=["source", "donner"], fps=2, start_initial_frames=0, binning=0, pca_components=3, ica_components=2, corr_methods=["raw", "gsr"], time_average=1)
    state.save_marks(str(tmp_path), [(0, 0, 0, 0), (5, 0, 5, 0), (0, 5, 0, 5)])
    seen = session.Recording()

    class Pick:
        def request(self, group, found):
            return []

    s = session.Session(spark, c, px, 6, 6, rois, exclusions=Pick(), reporter=seen, atlas_shape=(6, 6))
    out = s.run()
    assert [e for e in seen.events if e[1] == "done"] == [(n, "done") for n in session.STAGES]
    signal = out["roi_signals"].toPandas().pivot(index="g", columns="roi", values="v")
    assert signal["R"].std() > 3 * signal["L"].std() and len(signal) == 40
    assert out["correlations"].count() == 6 and out["dff_atlas"].count() == 40 * 36
    assert state.load_exclusion(str(tmp_path), "a") == []
    stopped = session.Session(spark, c, px, 6, 6, cancelled=lambda: True)
    with pytest.raises(session.Cancelled):
        stopped.run()
    raw = out["roi_signals_raw"].toPandas().pivot(index="g", columns="roi", values="v")
    assert raw.shape == (40, 2) and raw["L"].between(1490, 1600).all()
    assert out["hemovar"].count() == 36 and out["hemovar"].filter("r2 < 0 or r2 > 1").count() == 0


def test_names_of_files_in_use():
    old = {"do_registration": True, "flag_flip": True, "roi_signal": "Both", "corr_method": "gsr", "pca_n_skip": 4, "filter_xyt": None, "use_mmap": True}
    with pytest.warns(UserWarning, match="use_mmap"):
        c = config.from_dict(old)
    assert c.registration and c.flip and c.roi_mode == "both" and c.corr_methods == ["gsr"] and c.fit_stride == 4 and c.filter_xyt == (1, 1, 1)
    assert config.from_dict({"flag_flip": True, "flip": False}).flip is False


def _recording(spark, cube):
    rows = [(g, 0, r, c, float(v)) for g, frame in enumerate(cube) for r, line in enumerate(frame) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "g long, file_idx long, r long, c long, x double")


def test_registered_recording_equals_the_still_one(spark, tmp_path):
    rng = np.random.default_rng(5)
    image, t = rng.integers(500, 3000, (9, 11)), np.arange(24)
    cube = np.round(image * (1 + 0.2 * np.sin(t // 2 / 2))[:, None, None]) + rng.integers(0, 9, (24, 9, 11))
    # the template is the first frame, which stays where it is
    moves = [(0, 0), *zip(rng.integers(-3, 4, 23), rng.integers(-3, 4, 23), strict=True)]
    shaken = np.stack([np.roll(f, m, (0, 1)) for f, m in zip(cube, moves, strict=True)])
    settings = dict(channels_name=["a", "a"], channels_prop=["source", "donner"], fps=2, start_initial_frames=0, binning=0, usfac=1, template_stride=1000)

    def run(name, px, **more):
        c = config.Config(output_dir=str(tmp_path / name), **settings, **more)
        seen = session.Recording()
        s = session.Session(spark, c, _recording(spark, px), 9, 11, reporter=seen, recording=name)
        return s.run(("preprocess",)), seen.events

    still, _ = run("still", cube)
    moved, events = run("shaken", shaken, registration=True)
    order = ["grp", "g", "r", "c"]
    a, b = (d["dff"].toPandas().sort_values(order).reset_index(drop=True) for d in (still, moved))
    assert len(a) == 12 * 99 and a[order].equals(b[order]) and np.allclose(a["x"], b["x"], atol=1e-6)
    shifts = {r.g: (r.shift_r, r.shift_c) for r in moved["registered_frames"].collect()}
    assert all(shifts[g] == (-r, -c) for g, (r, c) in enumerate(moves))
    # a second run reads what is there; other settings don't
    again, events = run("shaken", shaken, registration=True)
    assert events[-1] == ("preprocess", "skipped") and sorted(again) == sorted(moved) and again["dff"].count() == len(b)
    assert run("shaken", shaken, registration=True, baseline_percentile=10)[1][-1] == ("preprocess", "done")
    assert run("shaken", shaken, registration=True)[1][-1] == ("preprocess", "done")


def test_conditioning_and_times_of_the_reference(spark, tmp_path):
    t = np.arange(60)
    rng = np.random.default_rng(6)
    bleach = np.exp(-t / 30)
    cube = np.empty((120, 2, 2))
    cube[0::2] = (1000 + 4000 * bleach)[:, None, None] + rng.normal(0, 2, (60, 2, 2))
    cube[1::2] = 2000 + rng.normal(0, 2, (60, 2, 2))
    settings = dict(channels_name=["a", "a"], channels_prop=["source", "donner"], fps=4, start_initial_frames=0, binning=0)
    spread = {}
    for name, more in {"plain": {}, "detrend": {"detrend": True}, "highpass": {"highpass": True, "highpass_sec": 5.0}}.items():
        s = session.Session(spark, config.Config(output_dir=str(tmp_path / name), **settings, **more), _recording(spark, cube), 2, 2)
        spread[name] = s.run(("preprocess",))["dff"].toPandas()["x"].std()
    assert spread["detrend"] < spread["plain"] / 2 and spread["highpass"] < spread["plain"] / 2
    # the share that the reference explains, with and without its values at the source's times
    ramp = np.arange(120.0)[:, None, None] * 10 + 500 + 300 * (np.arange(120) % 7 == 0)[:, None, None] * (np.arange(120) % 2 == 0)[:, None, None] + np.zeros((120, 2, 2))
    shares = {}
    for on in (False, True):
        s = session.Session(spark, config.Config(output_dir=str(tmp_path / f"times{on}"), reference_times=on, **settings), _recording(spark, ramp), 2, 2)
        s.run(("preprocess",))
        shares[on] = {(r.r, r.c): r.r2 for r in s.tables["hemovar"].collect()}
    src, ref = ramp[0::2, 0, 0], np.interp(np.arange(60) - 0.5, np.arange(60), ramp[1::2, 0, 0])
    assert shares[True][0, 0] == pytest.approx(np.corrcoef(src, ref)[0, 1] ** 2) and shares[False][0, 0] == pytest.approx(np.corrcoef(src, ramp[1::2, 0, 0])[0, 1] ** 2)
    values = rng.normal(size=20)
    pairs = spark.createDataFrame([(0, i, 0.0, float(v)) for i, v in enumerate(values)], "k long, t long, s double, d double")
    for ahead in (-1.0, -0.5, 0.0, 0.25, 1.0):
        got = [r.d for r in dff.reference_ahead(pairs, ["k"], ahead).orderBy("t").collect()]
        np.testing.assert_allclose(got, np.interp(np.arange(20) + ahead, np.arange(20), values), atol=1e-12)
