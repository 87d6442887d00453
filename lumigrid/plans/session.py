"""The staged analysis of a recording: preprocess, pca, ica, annotation, roi, correlation, export.

Tables live under the output folder as Parquet, each stage's in a folder named by its signature: the settings it reads, the decisions it takes,
its input, and the signatures of the stages before it. A stage whose signature is the manifest's is read and not computed (status "skipped");
else its tables are written beside the old ones and the manifest points at them when all are there. What a cancelled or failed run completed stays.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared, state, store
from ..config import Config
from ..operators import corr, decompose, demux, dff, filters, frames, geometry, register, roi

STAGES = ("preprocess", "pca", "ica", "annotation", "roi", "correlation", "export")
#: What each stage builds on, and which settings it reads; preprocess reads all that no later stage does.
BEFORE = {"preprocess": (), "pca": ("preprocess",), "ica": ("pca",), "annotation": ("preprocess",), "roi": ("preprocess", "ica", "annotation"), "correlation": ("roi",), "export": ("preprocess", "ica", "annotation")}
READS = {
    "pca": ("pca_components", "fit_stride"),
    "ica": ("ica_components", "skip_ica", "ica_max_iter", "ica_seed", "ica_exclusion", "ica_denoise"),
    "annotation": ("annotation", "annotation_ch", "allow_reflection"),
    "roi": ("roi_mode", "roi_space", "roi_size", "write_signals"),
    "correlation": ("corr_methods", "corr_auto_threshold", "edge_density", "edge_threshold", "start_initial_frames", "ignore_last_frames", "fps"),
    "export": ("time_average", "atlas_filter_kind", "atlas_filter_xyt", "write_annotated", "write_atlas_dff", "compress_stacks"),
}
#: Settings that choose how, not what.
_NEITHER = ("registration_cache", "atlas_path", "output_dir")
STATUSES = ("pending", "running", "done", "skipped", "failed", "cancelled")


class Cancelled(Exception):
    pass


class Reporter(Protocol):
    def stage(self, name: str, status: str) -> None: ...


@dataclass
class Recording(Reporter):
    """Remembers what it was told."""

    events: list[tuple[str, str]] = field(default_factory=list)

    def stage(self, name: str, status: str) -> None:
        self.events.append((name, status))


class MarksProvider(Protocol):
    def request(self, config: Config) -> list[tuple[float, float, float, float]] | None: ...


class ExclusionProvider(Protocol):
    def request(self, group: str, found: decompose.Ica) -> list[int] | None: ...


@dataclass
class Recorded:
    """Providers that replay decisions on disk: None where there is none."""

    folder: str

    def request(self, *args) -> list | None:
        if isinstance(args[0], Config):
            return state.load_marks(self.folder)
        return state.load_exclusion(self.folder, args[0])


@dataclass
class Session:
    """``px``: pixel rows (g, file_idx, r, c, x) of the whole timeline, raw. ``recording``: a name that changes with them; without it nothing is reused."""

    spark: SparkSession
    config: Config
    px: DataFrame
    height: int
    width: int
    rois: DataFrame | None = None
    marks: MarksProvider | None = None
    exclusions: ExclusionProvider | None = None
    reporter: Reporter = field(default_factory=Recording)
    cancelled: Callable[[], bool] = lambda: False
    atlas_shape: tuple[int, int] = (285, 285)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    transform: geometry.Matrix | None = None
    recording: str = ""
    pca: dict[str, decompose.Pca] = field(default_factory=dict)
    written: dict[str, str] = field(default_factory=dict)
    stage: str = ""

    @classmethod
    def from_files(cls, spark: SparkSession, config: Config, **more) -> Session:
        """A session on the files of ``config.input_dir``: their frames in reading order are one timeline, cut to the size all have."""
        from ..sources import frames as files
        from ..sources import seek

        fmt = config.input_format if config.input_format != "auto" else cls._format(config.input_dir)
        fmt = {"tiff": "tif", "sifx": "spool"}.get(fmt, fmt)
        places = files.index(spark, config.input_dir, fmt)
        if config.input_order != "natural":
            raise ValueError("files are read in natural order; other orders need a listing (sources.listing)")
        size = files.common_size(places)
        if size[0] is None:
            raise FileNotFoundError(f"no frames under {config.input_dir}")
        timed = files.timeline(places, files.counts(places))
        if config.max_frames:
            timed = timed.filter(F.col("g") < config.max_frames)
        px = files.pixels(files.load(timed, size))
        digest = state.contents([p for p, _ in seek.listed(config.input_dir, fmt)])
        return cls(spark, config, px, *size, recording=digest, **more)

    @staticmethod
    def _format(folder: str) -> str:
        """The one format of a folder's files."""
        from ..sources import seek

        files, at = seek.system(folder)
        info = files.get_file_info(at)
        names = [info.base_name] if info.is_file else [f.base_name for f in files.get_file_info(seek.fs.FileSelector(at))]
        kinds = {k for n in names if (k := seek.kind_of(n))} | ({"spool"} if seek.SPOOL_HEAD in names else set())
        if len(kinds) != 1:
            raise ValueError(f"one format is needed, found {sorted(kinds)}") if kinds else FileNotFoundError("no recording files")
        return kinds.pop()

    def _folder(self, stage: str) -> str:
        return f"{self.config.output_dir}/{stage}/{self.signature(stage)[:16]}"

    def _save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self._folder(self.stage)}/{name}"
        if name == "registered":
            store.write(df, path)
        else:
            df.write.mode("overwrite").parquet(path)
        return self._take(name, path)

    def _take(self, name: str, path: str) -> DataFrame:
        self.written[name] = path
        self.tables[name] = store.read(self.spark, path) if name == "registered" else self.spark.read.parquet(path)
        return self.tables[name]

    def _decisions(self, stage: str) -> object:
        """What people decided, as far as a stage takes it."""
        c = self.config
        if stage == "preprocess":
            return [self.recording, self.height, self.width, state.load_correction(c.output_dir, c.cycle)]
        if stage == "ica" and c.ica_exclusion not in (False, None) and not isinstance(c.ica_exclusion, dict):
            return {g: state.load_exclusion(c.output_dir, g) for g in self._groups()}
        if stage == "annotation":
            return state.load_marks(c.output_dir)
        if stage == "roi":
            rows = [] if self.rois is None else sorted(map(tuple, self.rois.collect()))  # a row a region
            return [rows, list(self.atlas_shape)]
        return list(self.atlas_shape) if stage == "export" else None

    def signature(self, stage: str) -> str:
        values = vars(self.config)
        later = {n for names in READS.values() for n in names} - {"start_initial_frames", "ignore_last_frames", "fps"}
        names = READS.get(stage) or [k for k in values if k not in later and k not in _NEITHER]
        own = {k: values[k] for k in names}
        return state.signature(stage, own | {"decisions": self._decisions(stage)}, "+".join(self.signature(b) for b in BEFORE[stage]))

    def _reuse(self, stage: str) -> bool:
        """Takes a stage's tables from an earlier run of the same recording, where nothing it depends on has changed."""
        if not self.recording or stage == "preprocess" and self.config.registration_cache == "force":
            return False
        entry = state.Manifest(self.config.output_dir).read().get(stage)
        if entry is None or entry["signature"] != self.signature(stage):
            return False
        self.written = {}
        for name, path in entry["tables"].items():
            self._take(name, f"{self.config.output_dir}/{path}")
        self._restore(stage)
        return True

    def _commit(self, stage: str) -> None:
        if not self.recording:
            return
        manifest = state.Manifest(self.config.output_dir)
        before = manifest.read().get(stage)
        root = f"{self.config.output_dir}/"
        manifest.put(stage, {"signature": self.signature(stage), "tables": {n: p.removeprefix(root) for n, p in self.written.items()}})
        old = {os.path.dirname(p) for p in before["tables"].values()} if before else set()
        shared.remove(self.spark, *(root + p for p in old - {os.path.dirname(p.removeprefix(root)) for p in self.written.values()}))

    def _restore(self, stage: str) -> None:
        """What later stages need of a stage besides its tables."""
        if stage == "pca":
            for g in self._groups():
                rows = self.tables[f"pca_values_{g}"].orderBy("k").collect()
                k = len(rows)
                self.pca[g] = decompose.Pca(*(decompose.Factor(self.tables[f"pca_{side}_{g}"], k) for side in ("spatial", "temporal")), np.array([r["singular"] for r in rows]), np.array([r["ratio"] for r in rows]), decompose.full_mean(self._movie(g)))
        if stage == "annotation":
            self._fit()

    def run(self, stages: tuple[str, ...] = STAGES) -> dict[str, DataFrame]:
        for name in stages:
            if self.cancelled():
                self.reporter.stage(name, "cancelled")
                raise Cancelled(name)
            self.reporter.stage(name, "running")
            self.stage = name
            try:
                if self._reuse(name):
                    self.reporter.stage(name, "skipped")
                    continue
                self.written = {}
                did = getattr(self, f"run_{name}")()
                if did is not False:
                    self._commit(name)
            except Exception:
                self.reporter.stage(name, "failed")
                raise
            self.reporter.stage(name, "skipped" if did is False else "done")
        return self.tables

    def _moved(self, px: DataFrame) -> DataFrame:
        """Pixel rows of the frames on the template. A frame is gathered into one row (one shuffle by frame) and spread again; only the template reaches the driver."""
        c, h, w = self.config, self.height, self.width
        whole = px.withColumn("p", F.col("r") * w + F.col("c"))
        if c.template:
            image = _image(c.template)[:h, :w]
        else:
            found = self._save("template", frames.template(whole, c.template_ch, c.template_stride, c.cycle)).orderBy("p").toPandas()
            image = found["mean"].to_numpy().reshape(h, w) if len(found) == h * w else np.zeros((0, 0))
        if image.shape != (h, w):
            raise ValueError(f"the template has {image.size} of {h * w} pixels")
        pix = F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda v: v["x"].cast("double"))
        rows = whole.groupBy("g").agg(pix.alias("pix")).select("g", F.lit(h).alias("h"), F.lit(w).alias("w"), "pix")
        moved = self._save("registered_frames", register.register(rows, image, c.usfac))
        out = moved.select("g", F.posexplode("pix").alias("p", "x"))
        return out.select("g", F.floor(F.col("p") / w).alias("r"), (F.col("p") % w).cast("long").alias("c"), "x")

    def _pairs(self, reg: DataFrame, source: list[int], donner: list[int]) -> DataFrame:
        """Source and reference; trends and slow baselines go first, from each on its own samples, then ``reference_times`` reads the reference at the source's times."""
        c, keys = self.config, ["r", "c"]
        slow = (c.fps_channel, c.highpass_sec, c.highpass_rank) if c.highpass else None
        if c.detrend or slow:
            role = F.when(F.col("ch").isin(source), "s").otherwise("d").alias("role")
            traces = reg.filter(F.col("ch").isin([*source, *donner])).groupBy(*keys, role, "t").agg(F.avg("x").alias("x"))
            traces = dff.conditioned(traces, [*keys, "role"], c.detrend, slow)
            one = lambda side: F.max(F.when(F.col("role") == side, F.col("x"))).alias(side)
            pairs = traces.groupBy(*keys, "t").agg(one("s"), one("d"))
        else:
            pairs = dff.pair_channels(reg, source, donner, keys)
        if not c.reference_times:
            return pairs
        return dff.reference_ahead(pairs, keys, (sum(source) / len(source) - sum(donner) / len(donner)) / c.cycle)

    def run_preprocess(self) -> None:
        c = self.config
        px = frames.cap(self.px, c.max_frames) if c.max_frames else self.px
        if c.flip:
            px = frames.flip_left_right(px, self.width)
        files = px.select("file_idx", "g").distinct().groupBy("file_idx").agg(F.count(F.lit(1)).alias("n"))
        offset, edits = state.load_correction(c.output_dir, c.cycle) or (c.demux_start_offset, [(r["start"], r["end"], r["delta"]) for r in demux.slip_edits(files, c.channels_slip, c.cycle).collect()])
        means = self._save("frame_means", frames.frame_means(px))
        if c.write_raw:
            raw_rows = px.withColumn("ch", demux.channel_at(F.col("g"), c.cycle, offset, edits))
            self._stacks("raw", raw_rows.withColumn("t", F.col("g")), self.width, self.height)
        placed = self._moved(px) if c.registration else px
        binned = frames.resize(placed, self.height, self.width, c.binning) if c.binning > 0 else placed.select("g", "r", "c", "x")
        index = means.select("g", demux.channel_at(F.col("g"), c.cycle, offset, edits).alias("ch"))
        index = self._save("frame_index", demux.index_in_channel(index))
        reg = self._save("registered", binned.join(F.broadcast(index) if index.count() <= 1_000_000 else index, "g").select("ch", "t", "r", "c", frames.saturated(F.col("x")).alias("x")))
        if any(s > 1 for s in c.filter_xyt):
            shape = reg.agg(F.max("r") + 1, F.max("c") + 1).first()
            parts = []
            for ch in range(c.cycle):
                own = reg.filter(F.col("ch") == ch).select(F.col("t").alias("g"), "r", "c", F.col("x").cast("double").alias("x"))
                n = own.agg(F.max("g") + 1).first()[0] or 0
                out = filters.smooth(own, (shape[0], shape[1], n), (c.filter_xyt[1], c.filter_xyt[0], c.filter_xyt[2]), c.filter_kind)
                parts.append(out.select(F.lit(ch).cast("long").alias("ch"), F.col("g").alias("t"), "r", "c", "x"))
            reg = parts[0]
            for p in parts[1:]:
                reg = reg.unionByName(p)
        if c.write_registered:
            shape = reg.agg(F.max("r") + 1, F.max("c") + 1).first()
            self._stacks("registered", reg, shape[1], shape[0])
        self._save("mean_images", reg.groupBy("ch", "r", "c").agg(F.avg("x").alias("mean")))
        lengths = {r["ch"]: r["n"] for r in index.groupBy("ch").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a channel
        out = raw = explained = None
        keys = ["r", "c"]
        for name, roles in c.groups().items():
            # a group is as long as its shortest channel
            n = min(lengths.get(ch, 0) for ch in roles["source"] + roles["donner"])
            if not roles["source"] or not n:
                continue
            cut = reg.filter(F.col("t") < n)
            mean = cut.filter(F.col("ch").isin(roles["source"])).groupBy("t", *keys).agg(F.avg("x").alias("x"))
            # channels of one name are one signal: their mean, in whole counts
            level = mean.select(F.lit(name).alias("grp"), F.col("t").alias("g"), *keys, frames.truncated(F.col("x")).alias("x"))
            raw = level if raw is None else raw.unionByName(level)
            if roles["donner"] and c.subtract_reference:
                pairs = self._pairs(cut, roles["source"], roles["donner"])
                foi = dff.window_of_interest(n, c.initial_skip, c.ignore_last_frames)
                one = dff.regressed_dff(pairs, keys, c.baseline_percentile, foi, c.baseline_skip)
                share = None if not c.hemovar_qc else dff.regression(pairs, keys, foi).select(F.lit(name).alias("grp"), *keys, "r2")
                explained = share if explained is None or share is None else explained.unionByName(share)
            else:
                one = dff.percentile_dff(mean, keys, c.baseline_percentile, c.baseline_skip)
            one = one.select(F.lit(name).alias("grp"), F.col("t").alias("g"), *keys, F.col("dff").cast("float").alias("x"))
            out = one if out is None else out.unionByName(one)
        for name, table in (("dff", out), ("source_mean", raw), ("hemovar", explained)):
            if table is not None:
                self._save(name, table)
        if c.demux_qc:
            told = str(demux.analyze(means.select("g", "m"), files, c.cycle))
            self._save("demux_qc", self.spark.createDataFrame([(told,)], "qc string"))
        times = [(n, role, sum(chs) / len(chs), len(chs)) for n, r in c.groups().items() for role, chs in r.items() if chs]
        self._save("times", self.spark.createDataFrame(times, "grp string, role string, first double, channels int"))

    def times(self, group: str) -> DataFrame:
        """(t, source_sec, reference_sec): when a group's samples were taken; no reference: null."""
        cycle, fps = float(self.config.cycle), float(self.config.fps)
        at = {r["role"]: r["first"] for r in self.tables["times"].filter(F.col("grp") == group).collect()}  # a row a role
        rows = self.tables["source_mean"].filter(F.col("grp") == group).select(F.col("g").alias("t")).distinct()
        when = lambda role: ((F.col("t") * cycle + at[role]) / fps if role in at else F.lit(None).cast("double"))
        return rows.select("t", when("source").alias("source_sec"), when("donner").alias("reference_sec"))

    def _stacks(self, folder: str, rows: DataFrame, width: int, height: int) -> None:
        """Pixel rows (ch, t, r, c, x) as one big TIFF a channel, named by its token. A frame's pixels are gathered into one row."""
        from ..sources import frames as files

        c = self.config
        place = (F.col("r") * width + F.col("c")).cast("int")
        pix = F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.col("x").cast("int").alias("x")))), lambda v: v["x"])
        whole = rows.groupBy("ch", "t").agg(pix.alias("pix")).select("ch", "t", F.lit(height).alias("h"), F.lit(width).alias("w"), "pix")
        files.write_stacks(whole, f"{c.output_dir}/stacks", f"{c.exp_name or 'output'}_{folder}_Ch", c.compress_stacks, mode="overwrite")

    def _groups(self) -> list[str]:
        return [n for n, r in self.config.groups().items() if r["source"]]

    def _movie(self, group: str) -> DataFrame:
        """A group's plain dF/F on pixel numbers, strided for fitting."""
        d = self.tables["dff"].filter((F.col("grp") == group) & (F.col("g") % self.config.fit_stride == 0))
        width = d.agg(F.max("c") + 1).first()[0]
        return d.select("g", (F.col("r") * width + F.col("c")).alias("p"), F.col("x").cast("double").alias("x"))

    def run_pca(self) -> None:
        values = "k long, singular double, ratio double"
        for g in self._groups():
            p = decompose.pca(self._movie(g), self.config.pca_components)
            kept = [decompose.Factor(self._save(f"pca_{side}_{g}", f.blocks), len(p.singular)) for side, f in (("spatial", p.spatial), ("temporal", p.temporal))]
            self._save(f"pca_values_{g}", self.spark.createDataFrame([(i, float(s), float(r)) for i, (s, r) in enumerate(zip(p.singular, p.ratio, strict=True))], values))
            p.drop()
            self.pca[g] = decompose.Pca(*kept, p.singular, p.ratio, p.mean)

    def run_ica(self) -> bool | None:
        c = self.config
        if c.skip_ica:
            return False
        for g in self._groups():
            k = min(c.ica_components or c.pca_components, len(self.pca[g].singular))
            found = decompose.ica(self.pca[g].head(k), c.ica_seed, c.ica_max_iter)
            for name, table in (("maps", found.maps), ("scores", found.scores)):
                self._save(f"ica_{name}_{g}", table)
            asked = c.ica_exclusion in ("cache", "gui") if not isinstance(c.ica_exclusion, dict) else False
            chosen = self.exclusions.request(g, found) if self.exclusions and asked else None
            found.drop()
            if chosen is not None:
                state.save_exclusion(c.output_dir, g, chosen)
            exclude = state.resolve_exclusion(c.output_dir, g, None if asked else c.ica_exclusion or False) if c.ica_denoise == "subtract" else []
            width = self.tables["dff"].agg(F.max("c") + 1).first()[0]
            if exclude:
                d = self.tables["dff"].filter(F.col("grp") == g).select("g", (F.col("r") * width + F.col("c")).alias("p"), F.col("x").cast("double").alias("x"))
                clean = decompose.subtract(d, self.tables[f"ica_maps_{g}"], k, exclude)
                self._save(f"denoised_{g}", clean.select(F.lit(g).alias("grp"), "g", F.floor(F.col("p") / width).alias("r"), (F.col("p") % width).alias("c"), F.col("x").cast("float").alias("x")))

    def run_annotation(self) -> bool | None:
        c = self.config
        if c.annotation is False:
            return False
        if self.marks and (chosen := self.marks.request(c)):
            state.save_marks(c.output_dir, chosen)
        if not self._fit():
            return False
        self._save("annotation_source", self.tables["mean_images"].filter(F.col("ch") == c.annotation_ch).select("r", "c", "mean"))

    def _fit(self) -> bool:
        """The map from the recording to the atlas, from the settings' own points (x, y) or those on disk."""
        c = self.config
        inline = c.annotation if isinstance(c.annotation, list | tuple) else None
        pairs = [(sy, sx, ry, rx) for (sx, sy), (rx, ry) in zip(*inline, strict=True)] if inline else state.load_marks(c.output_dir)
        if not pairs:
            return False
        table = self.spark.createDataFrame([tuple(map(float, p)) for p in pairs], "src_r double, src_c double, ref_r double, ref_c double")
        self.transform = geometry.fit_similarity(table, c.allow_reflection)
        return True

    def run_roi(self) -> bool | None:
        if self.rois is None or self.config.roi_space == "atlas" and self.transform is None:
            return False
        shape = self.tables["dff"].agg(F.max("r") + 1, F.max("c") + 1).first()
        mode = self.config.roi_mode
        if mode in ("both", "raw"):
            self._save("roi_signals_raw", self._signals(self.tables["source_mean"], shape))
        if mode in ("both", "dff"):
            out = None
            for g in self._groups():
                s = self._signals(self.tables.get(f"denoised_{g}", self.tables["dff"].filter(F.col("grp") == g)), shape)
                out = s if out is None else out.unionByName(s)
            self._save("roi_signals", out)
        if self.config.write_signals:
            self._signals_out()

    def _signals_out(self) -> None:
        """A CSV folder per group and kind: a row per time, a column per region."""
        names = [r["name"] for r in self.rois.select("name").distinct().orderBy("name").collect()]  # a row a region
        for kind in ("roi_signals", "roi_signals_raw"):
            for g in self._groups() if kind in self.tables else ():
                s = self.tables[kind].filter(F.col("grp") == g)
                roi.wide(s, names, self.config.fps_channel).orderBy("time_s").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{self.config.output_dir}/{kind}_{g}_csv")

    def _signals(self, movie: DataFrame, shape: tuple[int, int]) -> DataFrame:
        """The regions' signals (grp, roi, g, v) of a movie (grp, g, r, c, x)."""
        d = movie.withColumn("x", F.col("x").cast("double"))
        if self.config.roi_space == "atlas":
            masks = roi.discs(self.rois, *self.atlas_shape)
            s = roi.signals_from_source(d, masks, geometry.inverse(self.transform), self.atlas_shape, tuple(shape), "grp")
        else:
            s = roi.signals(d, roi.discs(self.rois, *shape), "grp")
        return s.select("grp", "roi", "g", "v")

    def run_correlation(self) -> bool | None:
        if "roi_signals" not in self.tables:
            return False
        out = None
        for g in self._groups():
            s = self.tables["roi_signals"].filter(F.col("grp") == g).select("roi", "g", "v")
            lo, hi = self.config.window((s.agg(F.max("g")).first()[0] or 0) + 1)
            s = s.filter((F.col("g") >= lo) & (F.col("g") < hi))
            for m in self.config.corr_methods:
                e = {"raw": corr.pearson, "gsr": corr.gsr, "partial": corr.partial}[m](s)
                e = e.select(F.lit(g).alias("grp"), F.lit(m).alias("method"), "roi_i", "roi_j", "r")
                out = e if out is None else out.unionByName(e)
        edges = self._save("correlations", out)
        c, strong = self.config, None
        for g in self._groups():
            for m in c.corr_methods:
                e = edges.filter((F.col("grp") == g) & (F.col("method") == m)).select("roi_i", "roi_j", "r")
                e = corr.network(e, c.edge_density) if c.corr_auto_threshold else e.filter((F.col("roi_i") < F.col("roi_j")) & (F.abs("r") >= c.edge_threshold))
                e = e.select(F.lit(g).alias("grp"), F.lit(m).alias("method"), "roi_i", "roi_j", "r")
                strong = e if strong is None else strong.unionByName(e)
        self._save("network", strong)

    def run_export(self) -> bool | None:
        if self.transform is None:
            return False
        c = self.config
        shape = tuple(self.tables["dff"].agg(F.max("r") + 1, F.max("c") + 1).first())
        pull = geometry.inverse(self.transform)
        if c.write_atlas_dff:
            parts = [self.tables.get(f"denoised_{g}", self.tables["dff"].filter(F.col("grp") == g)).select("grp", "g", "r", "c", F.col("x").cast("double").alias("x")) for g in self._groups()]
            d = parts[0]
            for p in parts[1:]:
                d = d.unionByName(p)
            warped = geometry.warp(d, pull, self.atlas_shape, shape, ("grp", "g"))
            if any(v > 1 for v in c.atlas_filter_xyt):
                smooth = None
                for g in self._groups():
                    own = warped.filter(F.col("grp") == g)
                    n = self.tables["dff"].filter(F.col("grp") == g).agg(F.max("g") + 1).first()[0] or 0
                    size = (c.atlas_filter_xyt[1], c.atlas_filter_xyt[0], c.atlas_filter_xyt[2])
                    one = filters.smooth(own.select("g", "r", "c", "x"), (*self.atlas_shape, n), size, c.atlas_filter_kind).select(F.lit(g).alias("grp"), "g", "r", "c", "x")
                    smooth = one if smooth is None else smooth.unionByName(one)
                warped = smooth
            if c.time_average > 0:
                warped = filters.moving_average(warped, c.time_average, ("grp", "r", "c"))
            self._save("dff_atlas", warped)
        if c.write_annotated:
            reg = self.tables["registered"].select(F.col("ch").alias("grp"), F.col("t").alias("g"), "r", "c", F.col("x").cast("double").alias("x"))
            out = geometry.warp(reg, pull, self.atlas_shape, shape, ("grp", "g")).select(F.col("grp").alias("ch"), F.col("g").alias("t"), "r", "c", frames.saturated(F.col("x")).alias("x"))
            self._stacks("annotated", out, self.atlas_shape[1], self.atlas_shape[0])


def _image(path: str) -> np.ndarray:
    """A template image: a .npy file or the first frame of a TIFF."""
    from ..sources import seek

    files, at = seek.system(path)
    if path.endswith(".npy"):
        with files.open_input_file(at) as f:
            return np.load(io.BytesIO(f.read()), allow_pickle=False).astype(float)
    with seek.Reader(path) as f:
        return seek.pixels(f, next(seek.tiff_places(f))).astype(float)
