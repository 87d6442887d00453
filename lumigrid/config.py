"""Settings of a recording's analysis: one flat record, checked when made, kept as two JSON files."""

from __future__ import annotations

import json
import math
import os
import re
import warnings
from dataclasses import asdict, dataclass, field, fields

FILTERS = ("mean", "median", "gaussian")
ROLES = {"s": "source", "d": "donner"}
#: Which settings say where data is; the others say what to do.
PLACES = ("input_dir", "output_dir", "exp_name", "atlas_path")
#: Other names of settings, as files in use hold them (fixed values); a name of ``Config`` given beside wins.
RENAMED = {
    "channel_names": "channels_name",
    "channel_props": "channels_prop",
    "frame_rate": "fps",
    "bin": "binning",
    "flag_binning": "binning",
    "flag_flip": "flip",
    "ignore_initial_frames": "start_initial_frames",
    "do_registration": "registration",
    "baseline_percentile_highpass": "highpass",
    "baseline_percentile_highpass_sec": "highpass_sec",
    "baseline_percentile_highpass_rank": "highpass_rank",
    "filter_xyt_kind": "filter_kind",
    "pca_n_components": "pca_components",
    "pca_n_skip": "fit_stride",
    "pca_skip_frames": "fit_stride",
    "ica_n_components": "ica_components",
    "annotation_atlas_path": "atlas_path",
    "roi_signal": "roi_mode",
    "post_annotation_time_average": "time_average",
    "corr_method": "corr_methods",
    "corr_edge_density": "edge_density",
    "post_annotation_filter_xyt": "atlas_filter_xyt",
    "post_annotation_filter_kind": "atlas_filter_kind",
    "annotation_allow_reflection": "allow_reflection",
    "linear_subt": "subtract_reference",
    "ch_for_annotation": "annotation_ch",
    "ica_random_state": "ica_seed",
    "corr_network_threshold": "edge_threshold",
    "save_raw_each_ch": "write_raw",
    "save_registered_each_ch": "write_registered",
    "save_annotated_each_ch": "write_annotated",
    "save_annotated_dF_mat": "write_atlas_dff",
    "save_roi_signals": "write_signals",
    "tiff_compression": "compress_stacks",
}
#: What a file in use means where it names nothing (fixed values, by the names of ``Config``); ``Config`` itself asks for nothing that isn't set.
IN_USE = {
    "channels_name": ["BL", "BL"], "channels_prop": ["source", "donner"], "registration": True, "reference_times": True, "template_stride": 100, "registration_cache": "force",
    "pca_components": 10, "fit_stride": 10, "ica_components": None, "corr_methods": ["raw"], "write_signals": "csv",
}
#: Settings that change no result here (memory, file formats, pictures): dropped with a warning (fixed values).
DROPPED = (
    "legacy_mode", "use_gpu", "batch_size", "registration_batch_size", "use_mmap", "delete", "flag_delete", "output_format", "output_metadata_yaml", "dcimg_backend",
    "tiff_format", "save_annotated_dF_dtype", "export_orientation", "pca_smooth_sigma", "ica_n_skip", "save_figures", "save_movie", "save_movie_speed", "save_movie_codec", "save_movie_vminmax", "save_movie_cmap", "save_movie_merge_chs",
)


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    input_dir: str = ""
    output_dir: str = ""
    exp_name: str = ""
    atlas_path: str = ""
    input_format: str = "auto"
    input_order: str = "natural"
    channels_name: list[str] = field(default_factory=lambda: ["signal"])
    channels_prop: list[str] = field(default_factory=lambda: ["source"])
    channels_slip: list[int] = field(default_factory=list)
    demux_start_offset: int = 0
    fps: float = 20.0
    start_initial_frames: int | None = None
    ignore_last_frames: int = 0
    max_frames: int | None = None
    template_ch: int = 0
    template_stride: int = 10
    registration: bool = False
    usfac: int = 50
    flip: bool = False
    binning: float = 2.0
    filter_kind: str = "mean"
    filter_xyt: tuple[int, int, int] = (1, 1, 1)
    baseline_percentile: float = 5.0
    baseline_ignore_initial: int | None = None
    reference_times: bool = False
    detrend: bool = False
    highpass: bool = False
    highpass_sec: float = 120.0
    highpass_rank: float = 50.0
    subtract_reference: bool = True
    hemovar_qc: bool = True
    demux_qc: bool = True
    template: str = ""
    registration_cache: str = "cached"
    pca_components: int = 20
    ica_components: int | None = 10
    fit_stride: int = 1
    skip_ica: bool = False
    ica_max_iter: int = 1000
    ica_seed: int = 0
    ica_exclusion: object = "cache"
    ica_denoise: str = "off"
    annotation: object = "cache"
    annotation_ch: int = 0
    allow_reflection: bool = False
    roi_mode: str = "both"
    roi_space: str = "atlas"
    roi_size: int = 8
    time_average: int = 0
    atlas_filter_kind: str = "mean"
    atlas_filter_xyt: tuple[int, int, int] = (1, 1, 1)
    corr_methods: list[str] = field(default_factory=lambda: ["raw", "gsr", "partial"])
    corr_auto_threshold: bool = True
    edge_density: float = 0.2
    edge_threshold: float = 0.3
    write_raw: bool = False
    write_registered: bool = False
    write_annotated: bool = False
    write_atlas_dff: bool = True
    write_signals: str = ""
    compress_stacks: bool = False

    def __post_init__(self) -> None:
        self.channels_prop = [ROLES.get(p.strip().lower(), p.strip().lower()) for p in self.channels_prop]
        self.filter_xyt = tuple(int(v) for v in self.filter_xyt)
        self.atlas_filter_xyt = tuple(int(v) for v in self.atlas_filter_xyt)
        self.write_signals = str(self.write_signals or "").lower()
        inline = isinstance(self.ica_exclusion, dict)
        checks = [
            (len(self.channels_name) == len(self.channels_prop) > 0, "channels_name and channels_prop must have equal, positive length"),
            (all(re.fullmatch(r"[A-Za-z0-9_-]+", n) for n in self.channels_name), "a channel name may hold letters, digits, _ and - only"),
            (all(p in ROLES.values() for p in self.channels_prop), "channels_prop must be source or donner"),
            (self.fps > 0, "fps must be positive"),
            (self.input_order in ("natural", "name", "mtime"), "unknown input_order"),
            (self.filter_kind in FILTERS and self.atlas_filter_kind in FILTERS, "unknown filter_kind"),
            (len(self.atlas_filter_xyt) == 3 and min(self.atlas_filter_xyt) >= 1, "atlas_filter_xyt must hold three sizes of at least 1"),
            (self.registration_cache in ("force", "cached"), "registration_cache must be force or cached"),
            (self.ica_denoise in ("off", "subtract"), "ica_denoise must be off or subtract"),
            (self.ica_denoise == "off" or not self.skip_ica, "components that are skipped can't be subtracted"),
            (inline or self.ica_exclusion in ("cache", "gui", False, None), "ica_exclusion must be cache, gui, false or components by group"),
            (not inline or set(self.ica_exclusion) <= set(self.channels_name) and all(int(i) == i >= 0 for v in self.ica_exclusion.values() for i in v), "ica_exclusion names an unknown group or component"),
            (all(0 <= v < len(self.channels_name) for v in (self.annotation_ch, self.template_ch, self.demux_start_offset)), "annotation_ch, template_ch and demux_start_offset must be channels of the cycle"),
            (self.ica_max_iter >= 1 and self.pca_components >= 1 and (self.ica_components is None or self.ica_components >= 1), "components and rounds must be at least 1"),
            (self.usfac >= 1 and self.binning >= 0 and self.ignore_last_frames >= 0 and self.time_average >= 0, "usfac must be at least 1; binning, ignore_last_frames and time_average at least 0"),
            (self.start_initial_frames is None or self.start_initial_frames >= 0, "start_initial_frames must be at least 0"),
            (self.highpass_sec > 0 and 0 <= self.highpass_rank <= 100, "highpass_sec must be positive, highpass_rank within 0 to 100"),
            (self.write_signals in ("", "csv", "both", "pickle"), "write_signals must be csv, pickle, both or nothing"),
            (len(self.filter_xyt) == 3 and min(self.filter_xyt) >= 1, "filter_xyt must hold three sizes of at least 1"),
            (0 <= self.baseline_percentile <= 100, "baseline_percentile must lie in 0 to 100"),
            (self.roi_mode in ("both", "raw", "dff"), "unknown roi_mode"),
            (self.roi_space in ("atlas", "source"), "unknown roi_space"),
            (all(m in ("raw", "gsr", "partial") for m in self.corr_methods), "unknown correlation method"),
            (self.template_stride >= 1 and self.fit_stride >= 1, "strides must be at least 1"),
            (self.max_frames is None or self.max_frames > 0, "max_frames must be positive"),
        ]
        for ok, message in checks:
            if not ok:
                raise ConfigError(message)

    @property
    def cycle(self) -> int:
        return len(self.channels_name)

    @property
    def fps_channel(self) -> float:
        return self.fps / self.cycle

    @property
    def initial_skip(self) -> int:
        return self.start_initial_frames if self.start_initial_frames is not None else math.floor(4 * self.fps / self.cycle)

    @property
    def baseline_skip(self) -> int:
        """Initial times that no baseline sees: as many as the regression skips, unless set."""
        return self.initial_skip if self.baseline_ignore_initial is None else self.baseline_ignore_initial

    def groups(self) -> dict[str, dict[str, list[int]]]:
        """Channels by name and role, in order of first appearance."""
        out: dict[str, dict[str, list[int]]] = {}
        for i, (name, prop) in enumerate(zip(self.channels_name, self.channels_prop, strict=True)):
            out.setdefault(name, {"source": [], "donner": []})[prop].append(i)
        return out

    def window(self, n: int) -> tuple[int, int]:
        """[start, n - ignore_last); crossed ends give everything."""
        lo, hi = self.initial_skip, n - self.ignore_last_frames
        return (lo, hi) if lo < hi else (0, n)


def from_dict(values: dict) -> Config:
    """Renamed settings move, dropped ones go with a warning, unknown ones are refused."""
    gone = [k for k in values if k in DROPPED]
    if gone:
        warnings.warn(f"settings without effect here: {gone}", stacklevel=2)
    values = {k: v for k, v in values.items() if k not in gone}
    for old, new in RENAMED.items():
        if old in values:
            values.setdefault(new, values[old])
            del values[old]
    if isinstance(values.get("roi_mode"), str):
        values["roi_mode"] = values["roi_mode"].lower()
    if isinstance(values.get("corr_methods"), str):
        values["corr_methods"] = [values["corr_methods"]]
    # null in a file: as if it weren't named
    values = {k: v for k, v in values.items() if v is not None}
    if values.get("write_signals") is False:
        values["write_signals"] = ""
    unknown = set(values) - {f.name for f in fields(Config)}
    if unknown:
        raise ConfigError(f"unknown settings: {sorted(unknown)}")
    return Config(**values)


def in_use(values: dict) -> Config:
    """Settings of files in use: what they leave out has their meaning (``IN_USE``), not that of ``Config``."""
    return from_dict(IN_USE | {RENAMED.get(k, k): v for k, v in values.items() if v is not None})


def load(path: str, **override) -> Config:
    """A file, or a folder with ``db.json`` and ``ops.json`` (the later wins); overrides are checked like the rest."""
    paths = [path] if os.path.isfile(path) else [p for n in ("db.json", "ops.json") if os.path.isfile(p := os.path.join(path, n))]
    if not paths:
        raise FileNotFoundError(path)
    values: dict = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            values |= json.load(f)
    return from_dict(values | override)


def save(config: Config, folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    values = asdict(config)
    for name, keep in (("db.json", True), ("ops.json", False)):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            json.dump({k: v for k, v in values.items() if (k in PLACES) == keep}, f, indent=1)
