"""Registered queries over the driver's tables and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import atlas, atlas_build, corr, decompose, demux, dff, filters, frames, geometry, qc, register, roi
from . import fixtures as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
C = V.CYCLE


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c: Column | str, name: str | None = None) -> Column:
    """Rounded to 6 places, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name) if name else F.round(c, 6) + F.lit(0.0)


# --- demultiplexing -----------------------------------------------------------------------------------


@query(f"with {V.MEAN} select g, (g + 3) % 4 ch from mean")
def demux_phase(spark, d):
    return V.mean(spark, d).select("g", demux.channel_at(F.col("g"), C, 3).alias("ch"))


_EDITS = f"edits as (select * from (values (100, 400, 1), (300, null, 2), (-5, 50, -1)) t(s, e, d)), off as (select g, cast(coalesce(sum(d), 0) as bigint) o from mean left join edits on g >= s and (e is null or g < e) group by g)"


@query(f"with {V.MEAN}, {_EDITS} select g, ((g + o) % 4 + 4) % 4 ch from off")
def demux_range_edits(spark, d):
    return V.mean(spark, d).select("g", demux.channel_at(F.col("g"), C, 0, V.EDITS).alias("ch"))


@query(f"with {V.MEAN}, {_EDITS} select g, o as \"offset\" from off")
def demux_edit_table(spark, d):
    edits = spark.createDataFrame(V.EDITS, "start long, end long, delta long")
    return demux.offsets_from_table(V.mean(spark, d).select("g"), edits).select("g", "offset")


@query(f"with {V.MEAN}, {_EDITS}, c as (select g, ((g + o) % 4 + 4) % 4 ch from off) select g, ch, row_number() over (partition by ch order by g) - 1 t from c")
def demux_frame_index_in_channel(spark, d):
    return demux.index_in_channel(demux_range_edits(spark, d), block=1 << 12).select("g", "ch", "t")


@query(f"with {V.MEAN}, c as (select g % 3 ch from mean) select cast(k as bigint) ch, count(ch) n from (select unnest(range(4)) k) left join c on c.ch = k group by k")
def channel_frame_counts(spark, d):
    return demux.channel_counts(V.mean(spark, d).select(F.pmod("g", F.lit(3)).alias("ch")), 4)


@query(f"with {V.FILES} select file_idx, n, cast(coalesce(sum(n) over (order by file_idx rows between unbounded preceding and 1 preceding), 0) as bigint) frame_start from files")
def file_starts(spark, d):
    return demux.file_starts(V.files(spark, d))


_STARTS = "starts as (select file_idx, n, row_number() over (order by file_idx) - 1 i, cast(coalesce(sum(n) over (order by file_idx rows between unbounded preceding and 1 preceding), 0) as bigint) s from files)"


@query(f"with {V.FILES}, {_STARTS} select s as \"start\", s + n as \"end\", cast([0, 1, 3, 2, 0, 1][i + 1] as bigint) delta from starts where i < 6 and [0, 1, 3, 2, 0, 1][i + 1] <> 0")
def file_slip_edits(spark, d):
    return demux.slip_edits(V.files(spark, d), [0, 1, -1, 6, 4, 1], C)


@query(f"with {V.FILES} select file_idx, n, n % 4 rest from (select *, lead(file_idx) over (order by file_idx) after from files) where after is not null and n % 4 <> 0")
def cycle_misalignment_warning(spark, d):
    return demux.misaligned_files(V.files(spark, d), C)


@query(f"with {V.FILES}, {_STARTS} select g, starts.file_idx file, g - s as \"local\" from mean join starts on g >= s and g < s + n")
def frame_to_file_lookup(spark, d):
    return demux.frame_to_file(V.mean(spark, d).select("g"), V.files(spark, d))


_RESID = f"{V.MEAN}, n as (select count(*) n from mean), box as (select a.g, avg(b.m) trend from (select g, unnest(range(-4, 4)) o from mean) a, n join mean b on b.g = least(greatest(a.g + a.o, 0), n.n - 1) group by a.g), resid as (select mean.g, m, m - trend resid from mean join box using (g))"


def _resid(spark, d) -> DataFrame:
    return demux.detrend(V.mean(spark, d).select("g", "m"), C)


@query(f"with {_RESID} select g, round(resid, 6) + 0.0 resid from resid")
def intensity_detrend(spark, d):
    return _resid(spark, d).select("g", _r("resid", "resid"))


@query(f"with {_RESID} select cast(k as bigint) phase, round(coalesce(avg(resid), 0), 5) + 0.0 mean, round(coalesce(stddev_pop(resid), 0), 5) + 0.0 std, count(resid) n from (select unnest(range(4)) k) left join resid on g % 4 = k group by k")
def phase_fold(spark, d):
    five = lambda c: (F.round(c, 5) + F.lit(0.0)).alias(c)
    return demux.phase_fold(_resid(spark, d), C).select("phase", five("mean"), five("std"), "n")


_ETA = "greatest(0.0, (bet / ss - 3.0 / greatest(n - 1, 1)) / (1 - 3.0 / greatest(n - 1, 1)))"


@query(f"with {_RESID}, f as (select g % 4 ph, count(*) k, avg(resid) m, sum(resid * resid) q from resid group by 1), t as (select cast(sum(k) as bigint) n, sum(q) ss, sum(k * m * m) bet from f) select n, round({_ETA}, 6) + 0.0 eta2 from t")
def phase_eta2(spark, d):
    folds = _resid(spark, d).groupBy(F.pmod("g", F.lit(C)).alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.avg("resid").alias("mean"), F.sum(F.col("resid") * F.col("resid")).alias("ss"))
    return demux.eta2(folds, C).select("n", _r("eta2", "eta2"))


_WINDOWS = f"{_RESID}, plan as (select n, least(n, greatest(least(8, n), 32, n // 8)) win from n), win as (select s, least(s + win, n) e from (select unnest(range(0, n - 3, greatest(4, win // 2))) s, win, n from plan)), fold as (select s, e, g % 4 phase, count(*) n, avg(resid) m, sum(resid * resid) q from win join resid on g >= s and g < e where e - s >= 8 group by 1, 2, 3)"


@query(f"with {_WINDOWS}, t as (select s, e, cast(sum(n) as bigint) n, sum(q) ss, sum(n * m * m) bet from fold group by 1, 2) select s, e, n, round({_ETA}, 6) + 0.0 eta2 from t")
def phase_windows(spark, d):
    means = V.mean(spark, d)
    return demux.eta2(demux.windows(_resid(spark, d), means.count(), C), C, "s", "e").select("s", "e", "n", _r("eta2", "eta2"))


_SHIFTS = (
    f"{_WINDOWS}, win1 as (select win from plan), ref as (select k, coalesce(avg(resid), 0) v from (select unnest(range(4)) k) left join resid on g % 4 = k and g < (select win from win1) group by k), "
    "pat as (select w.s, w.e, k, coalesce(m, 0) v from (select distinct s, e from fold) w cross join (select unnest(range(4)) k) left join fold on fold.s = w.s and fold.phase = k), "
    "pc as (select s, e, k, v - avg(v) over (partition by s) v from pat), rc as (select k, v - avg(v) over () v from ref), "
    "sc as (select s, e, dd, sum(pc.v * rc.v) / nullif(sqrt(sum(pc.v * pc.v)) * sqrt(sum(rc.v * rc.v)), 0) corr from pc, (select unnest(range(4)) dd) join rc on rc.k = (pc.k + dd) % 4 group by 1, 2, 3), "
    "best as (select s, e, arg_max(dd, (round(coalesce(corr, 0), 9), -dd)) shift from sc group by 1, 2)"
)


def _shifts(spark, d) -> DataFrame:
    resid, n = _resid(spark, d), V.mean(spark, d).count()
    win, _ = demux.window_plan(n, C)
    reference = [r["mean"] for r in demux.phase_fold(resid.filter(F.col("g") < win), C).orderBy("phase").collect()]
    return demux.best_shift(demux.windows(resid, n, C), reference, C, "s", "e")


@query(f"with {_SHIFTS} select s, e, cast(shift as bigint) shift from best")
def best_phase_shift(spark, d):
    return _shifts(spark, d).select("s", "e", "shift")


@query(f"with {_SHIFTS}, o as (select s k, (s + e) // 2 centre, (4 - shift) % 4 o from best), m as (select *, first_value(o) over (order by k) b, lead(o) over (order by k) nx from o), h as (select * from m where o <> b and (nx is null or nx <> b) order by k limit 1) select cast(centre as bigint) slip_frame, cast((o - b + 4) % 4 as bigint) slip_offset from h")
def slip_first_persistent(spark, d):
    offsets = _shifts(spark, d).select(F.col("s").alias("k"), F.floor((F.col("s") + F.col("e")) / 2).alias("centre"), F.pmod(F.lit(C) - F.col("shift"), F.lit(C)).alias("offset"))
    return demux.first_slip(offsets, C)


@query(f"with {_RESID}, z as (select g, resid - (select avg(resid) from resid) v from resid), ac as (select lag, sum(a.v * b.v) ac from z a, (select unnest(range(13)) lag) l join z b on b.g = a.g + lag group by 1), s as (select lag, ac / (select ac from ac where lag = 0) v from ac), p as (select arg_max(lag, (round(v, 9), -lag)) period from s where lag >= 1) select cast(period as bigint) period, 4 % period = 0 or period % 4 = 0 period_ok from p")
def dominant_period(spark, d):
    return demux.dominant_period(demux.autocorrelation(_resid(spark, d), V.mean(spark, d).count(), C), C)


@query()
def demux_qc(spark, d):
    found = demux.analyze(V.mean(spark, d).select("g", "m"), V.files(spark, d), C)
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "field string, value string")


# --- frames ------------------------------------------------------------------------------------------


@query(f"with {V.FRAME} select g, round(avg(x), 6) + 0.0 m from frame group by 1")
def frame_mean(spark, d):
    return frames.frame_means(V.frame(spark, d)).select("g", _r("m", "m"))


@query(f"with {V.FRAME} select g % 2 ch, p, round(avg(x), 6) + 0.0 mean from frame group by 1, 2")
def channel_mean_image(spark, d):
    px = V.frame(spark, d).withColumn("ch", F.pmod("g", F.lit(2)))
    return frames.mean_image(px, "ch").select("ch", "p", _r("mean", "mean"))


@query(f"with {V.FRAME}, l as (select p, x, g - min(g) over () i from frame where file_idx = (select max(file_idx) from frame)) select p, round(avg(x), 6) + 0.0 mean from l where i >= 1 and (i - 1) % 12 = 0 group by 1")
def template_image(spark, d):
    return frames.template(V.frame(spark, d), 1, 3, C).select("p", _r("mean", "mean"))


@query(f"with {V.FRAME} select file_idx, g, p, x from (select *, dense_rank() over (partition by file_idx order by g) k from frame) where k <= 4")
def head_frames_per_file(spark, d):
    return frames.head_per_file(V.frame(spark, d), 4).select("file_idx", "g", "p", "x")


@query(f"with {V.FRAME} select g, p, x from frame where g < 37")
def frame_cap(spark, d):
    return frames.cap(V.frame(spark, d), 37).select("g", "p", "x")


@query(f"with {V.FRAME} select g, p, x from frame where g % 7 = 0")
def time_stride(spark, d):
    return frames.stride(V.frame(spark, d), 7).select("g", "p", "x")


@query(f"with {V.FRAME} select g, r, c, x from frame where r % 3 = 0 and c % 3 = 0")
def decimate(spark, d):
    return frames.decimate(V.frame(spark, d), 3).select("g", "r", "c", "x")


@query(f"with {V.FRAME} select g, r, 7 - c c, x from frame where r < 5 and c < 6")
def flip_and_crop(spark, d):
    return frames.flip_left_right(frames.crop(V.frame(spark, d), 5, 6), 8).select("g", "r", "c", "x")


@query(f"with {V.FRAME} select g, p, cast(round_even(greatest(least((x - 1000) * 90.5, 65535.0), 0.0), 0) as bigint) v from frame")
def saturating_cast(spark, d):
    return V.frame(spark, d).select("g", "p", frames.saturated((F.col("x") - 1000) * 90.5).alias("v"))


@query(f"with {V.FRAME} select g, p, cast(trunc(greatest(least((x - 1000) * 90.25, 65535.0), 0.0)) as bigint) v from frame")
def truncating_cast(spark, d):
    return V.frame(spark, d).select("g", "p", frames.truncated((F.col("x") - 1000) * 90.25).alias("v"))


@query(f"with {V.FRAME} select g, r // 2 r, c // 2 c, round(avg(x), 6) + 0.0 x from frame group by 1, 2, 3")
def block_bin_2x2(spark, d):
    return frames.block_bin(V.frame(spark, d), 2).select("g", "r", "c", _r("x", "x"))


_RESIZE = (
    "k as (select o, exp(-2.0 * o * o) / sum(exp(-2.0 * o * o)) over () w from (select unnest(range(-2, 3)) o)), tap as (select i, case when a < 0 then -a when a > 7 then 14 - a else a end j, sum(w / 2) w "
    "from (select i, 2 * i + e + o a, w from (select unnest(range(4)) i), (select unnest([0, 1]) e), k) group by 1, 2), half as (select g, i r, c, sum(x * w) x from frame join tap on frame.r = j group by 1, 2, 3)"
)


@query(f"with {V.FRAME}, {_RESIZE} select g, r, i c, round(sum(x * w), 6) + 0.0 x from half join tap on half.c = j group by 1, 2, 3")
def resize_antialias(spark, d):
    return frames.resize(V.frame(spark, d), 8, 8, 2).select("g", "r", "c", _r("x", "x"))


@query(f"with {V.FRAME}, want as (select * from (values (0, 17), (1, 3), (2, 17), (3, 250)) t(position, g)) select cast(position as bigint) position, g, p, x from frame join want using (g)")
def random_access_by_index(spark, d):
    return frames.by_index(V.frame(spark, d), [17, 3, 17, 250]).select("position", "g", "p", "x")


@query(f"with {V.FRAME} select (g // 3) * 3 + g % 3 g, p, x from frame")
def interleave_time_channel(spark, d):
    px = V.frame(spark, d).select(F.floor(F.col("g") / 3).alias("t"), F.pmod("g", F.lit(3)).alias("ch"), "p", "x")
    return frames.interleave(px, 3).select("g", "p", "x")


@query("with parts as (select vec_id source_index, vec_id % 2 part, vec_id // 2 as \"local\" from embeddings) select part, \"local\", row_number() over (order by source_index, part, \"local\") - 1 g from parts")
def merge_parts_by_source_index(spark, d):
    v = F.col("vec_id")
    return frames.merge_parts(V.table(spark, d, "embeddings").select(v.alias("source_index"), (v % 2).alias("part"), F.floor(v / 2).alias("local"))).select("part", "local", "g")


@query(f"with {V.FRAME}, ch as (select g % 3 ch, g // 3 t, p, x from frame), n as (select min(n) n from (select ch, max(t) + 1 n from ch group by 1)) select t, p, round(avg(x), 6) + 0.0 x from ch, n where t < n group by 1, 2")
def average_source_channels(spark, d):
    px = V.channels(spark, d, 3)
    return frames.average_sources(px).select("t", "p", _r("x", "x"))


# --- smoothing ---------------------------------------------------------------------------------------


@query(f"with {V.FRAME} select g, p, round(avg(x) over (partition by p order by g rows between 3 preceding and 3 following), 6) + 0.0 x from frame")
def time_average_truncated(spark, d):
    return filters.moving_average(V.frame(spark, d), 3, ("p",)).select("g", "p", _r("x", "x"))


_MIR = lambda e, n: f"(case when {e} < 0 then -1 - ({e}) when {e} >= {n} then 2 * {n} - 1 - ({e}) else {e} end)"
_BOX = f"near as (select a.g, a.r, a.c, b.x from frame a, (select unnest([-1, 0, 1]) dr), (select unnest([-1, 0, 1]) dc) join frame b on b.g = a.g and b.r = {_MIR('a.r + dr', '8')} and b.c = {_MIR('a.c + dc', '8')}), flat as (select g, r, c, avg(x) x from near group by 1, 2, 3), n as (select max(g) + 1 n from frame), deep as (select a.g, a.r, a.c, b.x from flat a, n, (select unnest([-1, 0, 1]) dg) join flat b on b.r = a.r and b.c = a.c and b.g = {_MIR('a.g + dg', 'n.n')})"


def _n_frames(spark, d) -> int:
    return V.table(spark, d, "embeddings").agg(F.max("vec_id") + 1).first()[0]


@query(f"with {V.FRAME}, {_BOX} select g, r, c, round(avg(x), 6) + 0.0 x from deep group by 1, 2, 3")
def box_filter_xyt(spark, d):
    return filters.smooth(V.frame(spark, d), (8, 8, _n_frames(spark, d)), (3, 3, 3)).select("g", "r", "c", _r("x", "x"))


_MED = f"near as (select a.g, a.r, a.c, b.x from frame a, n, (select unnest([-1, 0, 1]) dr), (select unnest([-1, 0, 1]) dc), (select unnest([-1, 0, 1]) dg) join frame b on b.r = {_MIR('a.r + dr', '8')} and b.c = {_MIR('a.c + dc', '8')} and b.g = {_MIR('a.g + dg', 'n.n')})"


@query(f"with {V.FRAME}, n as (select max(g) + 1 n from frame), {_MED} select g, r, c, list_sort(list(x))[14] x from near group by 1, 2, 3")
def median_filter_xyt(spark, d):
    return filters.smooth(V.frame(spark, d), (8, 8, _n_frames(spark, d)), (3, 3, 3), "median").select("g", "r", "c", "x")


_GAUSS = (
    f"k as (select o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) over () w from (select unnest(range(-4, 5)) o)), tap as (select i, {_MIR('i + o', '8')} j, sum(w) w from (select unnest(range(8)) i), k group by 1, 2), "
    "half as (select g, i r, c, sum(x * w) x from frame join tap on frame.r = j group by 1, 2, 3)"
)


@query(f"with {V.FRAME}, {_GAUSS} select g, r, i c, round(sum(x * w), 6) + 0.0 x from half join tap on half.c = j group by 1, 2, 3")
def gaussian_filter_xyt(spark, d):
    return filters.smooth(V.frame(spark, d), (8, 8, _n_frames(spark, d)), (3, 3, 1), "gaussian").select("g", "r", "c", _r("x", "x"))


# --- dF/F --------------------------------------------------------------------------------------------


@query(f"with {V.FRAME}, b as (select p, quantile_cont(x, 0.05) base from frame where g >= 10 group by 1) select g, p, round(case when base > 0 then x / base - 1 else 0 end, 6) + 0.0 dff from frame join b using (p)")
def dff_percentile_baseline(spark, d):
    px = V.frame(spark, d).select(F.col("g").alias("t"), "p", "x")
    return dff.percentile_dff(px, ["p"], 5.0, 10).select(F.col("t").alias("g"), "p", _r("dff", "dff"))


_FIT = (
    "fit as (select {k}, count(*) f, sum(d) sd, sum(s) ss, sum(d * d) sdd, sum(d * s) sds, sum(s * s) sss, avg(s) ms from pairs group by 1), "
    "ab as (select {k}, ms, case when abs(sdd * f - sd * sd) > 1e-10 then (f * sds - sd * ss) / (sdd * f - sd * sd) else 0 end a, case when abs(sdd * f - sd * sd) > 1e-10 then (sdd * ss - sd * sds) / (sdd * f - sd * sd) else ss / f end b, "
    "case when (sdd * f - sd * sd) * (sss * f - ss * ss) > 1e-20 then least(1.0, greatest(0.0, (f * sds - sd * ss) * (f * sds - sd * ss) / ((sdd * f - sd * sd) * (sss * f - ss * ss)))) else 0 end r2 from fit), "
    "y as (select pairs.*, s - (a * d + b) + ms y from pairs join ab using ({k})), base as (select {k}, quantile_cont(y, 0.05) base from y group by 1)"
)
_PAIRS = f"{V.CHANNELS}, pairs as (select s.p, s.t, s.x s, d.x d from chan s join chan d on s.p = d.p and s.t = d.t and s.ch = 0 and d.ch = 1)"


def _pairs(spark, d) -> DataFrame:
    return dff.pair_channels(V.channels(spark, d), [0], [1], ["p"])


@query(f"with {_PAIRS}, {_FIT.format(k='p')} select p, t, round(case when base > 0 then y / base - 1 else 0 end, 6) + 0.0 dff from y join base using (p)")
def dff_linear_subtraction(spark, d):
    return dff.regressed_dff(_pairs(spark, d), ["p"]).select("p", "t", _r("dff", "dff"))


@query(f"with {_PAIRS}, {_FIT.format(k='p')} select p, round(r2, 6) + 0.0 r2 from ab")
def hemo_r2_map(spark, d):
    return dff.regression(_pairs(spark, d), ["p"]).select("p", _r("r2", "r2"))


@query(f"with {V.BULK}, pairs as (select * from bulk), {_FIT.format(k='k')} select k, count(*) n, round(avg(case when base > 0 then y / base - 1 else 0 end), 6) + 0.0 mean_dff, round(max(case when base > 0 then y / base - 1 else 0 end), 6) + 0.0 max_dff from y join base using (k) group by 1")
def dff_linear_subtraction_bulk(spark, d):
    out = dff.regressed_dff(V.bulk(spark, d), ["k"])
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("dff"), "mean_dff"), _r(F.max("dff"), "max_dff"))


@query(f"with {V.BULK} select k, round(quantile_cont(s, 0.05), 6) + 0.0 base from bulk group by 1")
def baseline_percentile_bulk(spark, d):
    return dff.baseline(V.bulk(spark, d), ["k"], 5.0, "s").select("k", _r("base", "base"))


@query(
    f"with {V.MEAN}, s as (select g t, m x from mean where g % 3 = 0), r as (select g t, m x from mean where g % 3 = 1), l as (select s.t, s.x, r.t t0, r.x x0 from s asof left join r on s.t >= r.t), b as (select l.*, r.t t1, r.x x1 from l asof left join r on l.t <= r.t) "
    "select t as time, round(x, 6) + 0.0 s, round(case when t0 is null then x1 when t1 is null then x0 when t1 > t0 then x0 + (x1 - x0) * (t - t0) / (t1 - t0) else x0 end, 6) + 0.0 d from b"
)
def donner_interpolation(spark, d):
    m = V.mean(spark, d)
    rows = m.filter("g % 3 < 2").select(F.lit(0).alias("k"), F.col("g").alias("time"), F.when(F.col("g") % 3 == 0, "s").otherwise("d").alias("role"), F.col("m").alias("x"))
    return dff.interpolate_reference(rows, ["k"]).select("time", _r("s", "s"), _r("d", "d"))


@query(f"with {V.BULK}, f as (select k, count(*) n, avg(t) tm, avg(ln(greatest(s, 1e-6))) lm, avg(s) xm, covar_pop(t, ln(greatest(s, 1e-6))) cv, var_pop(t) vr from bulk group by 1) select bulk.k, t, s, round(case when n < 3 then s else s - exp(lm - cv / (case when vr > 0 then vr else 1 end) * tm + cv / (case when vr > 0 then vr else 1 end) * t) + xm end, 4) + 0.0 y from bulk join f using (k)")
def exp_detrend(spark, d):
    return dff.exp_detrend(V.bulk(spark, d).select("k", "t", F.col("s").alias("x")), ["k"]).select("k", "t", F.col("x").alias("s"), (F.round("y", 4) + F.lit(0.0)).alias("y"))


_NEAR = "least(n - 1, greatest(0, a.i + o))"
_SLOW = (
    f"{V.MEAN}, tr as (select file_idx, g, m, row_number() over (partition by file_idx order by g) - 1 i, count(*) over (partition by file_idx) n from mean), w as (select *, least(15, n - 1 + n % 2) w from tr), "
    f"ranked as (select a.file_idx, a.i, a.n, a.w, list_sort(list(b.m))[cast(floor(any_value(a.w) * 0.1) as bigint) + 1] v from (select *, unnest(range(-(w // 2), w // 2 + 1)) o from w) a join w b on a.file_idx = b.file_idx and b.i = {_NEAR.replace('n - 1', 'a.n - 1')} group by 1, 2, 3, 4), "
    f"slow as (select a.file_idx, a.i, sum(b.v) / any_value(a.w) v from (select *, unnest(range(-(w // 2), w // 2 + 1)) o from ranked) a join ranked b on a.file_idx = b.file_idx and b.i = {_NEAR.replace('n - 1', 'a.n - 1')} group by 1, 2), "
    "flat as (select file_idx, quantile_cont(m, 0.1) q from mean group by 1)"
)


@query(f"with {_SLOW} select file_idx, g t, round(m / greatest(case when n < 3 then q else v end, 1e-6), 6) + 0.0 y from tr join slow using (file_idx, i) join flat using (file_idx)")
def rolling_percentile_highpass(spark, d):
    traces = V.mean(spark, d).select("file_idx", F.col("g").alias("t"), F.col("m").alias("x"))
    return dff.highpass(traces, ["file_idx"], 1.0, 15.0, 10.0).select("file_idx", "t", _r("y", "y"))


# --- regions -----------------------------------------------------------------------------------------


def _mask(spark) -> DataFrame:
    return roi.discs(V.rois(spark), 8, 8)


@query(f"with {V.SPOT_MASK} select roi, r, c from mask")
def roi_masks(spark, d):
    return roi.discs(V.spots(spark, d), 8, 8)


_SIGNAL = f"{V.FRAME}, {V.MASK}, signal as (select roi, g, avg(x) v from frame join mask using (r, c) group by 1, 2)"


def _signal(spark, d) -> DataFrame:
    return roi.signals(V.frame(spark, d), _mask(spark))


@query(f"with {_SIGNAL} select roi, g, round(v, 6) + 0.0 v from signal")
def roi_signals_source(spark, d):
    return _signal(spark, d).select("roi", "g", _r("v", "v"))


@query(f"with {V.SPOT_MASK}, {V.TAPS} select roi, tap.r, tap.c, round(sum(w), 6) + 0.0 w from mask join tap on mask.r = r2 and mask.c = c2 group by 1, 2, 3")
def roi_weights_adjoint(spark, d):
    return geometry.fold_weights(roi.discs(V.spots(spark, d), 8, 8), V.PULL, V.GRID, V.SHAPE).select("roi", "r", "c", _r("w", "w"))


@query(f"with {V.FRAME}, {V.MASK}, {V.TAPS}, w as (select roi, tap.r, tap.c, sum(w) w from mask join tap on mask.r = r2 and mask.c = c2 group by 1, 2, 3), k as (select roi, count(*) k from mask group by 1) select w.roi, g, round(sum(x * w / k), 6) + 0.0 v from frame join w using (r, c) join k on k.roi = w.roi group by 1, 2")
def roi_signals_adjoint(spark, d):
    return roi.signals_from_source(V.frame(spark, d), _mask(spark), V.PULL, V.GRID, V.SHAPE).select("roi", "g", _r("v", "v"))


@query(f"with {_SIGNAL} select round(g / 10.0, 6) + 0.0 time_s, " + ", ".join(f"round(max(case when roi = '{n}' then v end), 6) + 0.0 as \"{n}\"" for n, *_ in V.ROIS) + " from signal group by g")
def roi_signals_wide(spark, d):
    names = [n for n, *_ in V.ROIS]
    return roi.wide(_signal(spark, d), names, 10.0).select(_r("time_s", "time_s"), *(_r(n, n) for n in names))


@query(f"with {V.SPOTS} select case when name like '%\\_R' escape '\\' then name[:-3] || '_L' when name like '%\\_L' escape '\\' then name[:-3] || '_R' else name || '_contra' end as \"name\", cast(7 - x as bigint) x, cast(y as bigint) y, cast(size as bigint) size from roi")
def roi_contralateral(spark, d):
    return roi.contralateral(V.spots(spark, d), 8)


@query(f"with {V.FRAME}, {V.TAPS}, w as (select g, r2, c2, sum(x * w) x from frame join tap using (r, c) group by 1, 2, 3), grid as (select g, r2, c2 from (select distinct g from frame), (select unnest(range(12)) r2), (select unnest(range(12)) c2)) select g, cast(r2 as bigint) r, cast(c2 as bigint) c, round(coalesce(x, 0), 6) + 0.0 x from grid left join w using (g, r2, c2)")
def warp_frames(spark, d):
    return geometry.warp(V.frame(spark, d), V.PULL, V.GRID, V.SHAPE).select("g", "r", "c", _r("x", "x"))


_BACK = geometry.inverse(V.PULL)
_BACK_SQL = (
    f"place as (select r2, c2, ({_BACK[0][0]!r})::double * c2 + ({_BACK[0][1]!r})::double * r2 + ({_BACK[0][2]!r})::double x, ({_BACK[1][0]!r})::double * c2 + ({_BACK[1][1]!r})::double * r2 + ({_BACK[1][2]!r})::double y from (select unnest(range(8)) r2), (select unnest(range(8)) c2)), "
    "taps as (select r2, c2, cast(floor(y) as bigint) + j r, cast(floor(x) as bigint) + i c, (case when j = 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case when i = 1 then x - floor(x) else 1 - (x - floor(x)) end) w from place, (select unnest([0, 1]) j), (select unnest([0, 1]) i)), tap as (select * from taps where r between 0 and 7 and c between 0 and 7 and w <> 0)"
)


@query(f"with {V.FRAME}, {_BACK_SQL}, m as (select r, c, avg(x) x from frame group by 1, 2), w as (select r2, c2, sum(x * w) x from m join tap using (r, c) group by 1, 2), grid as (select r2, c2 from (select unnest(range(8)) r2), (select unnest(range(8)) c2)) select cast(r2 as bigint) r, cast(c2 as bigint) c, round(coalesce(x, 0), 6) + 0.0 x from grid left join w using (r2, c2)")
def unwarp_map(spark, d):
    image = V.frame(spark, d).groupBy("r", "c").agg(F.avg("x").alias("x")).withColumn("g", F.lit(0).cast("long"))
    return geometry.warp(image, _BACK, V.SHAPE, V.SHAPE).select("r", "c", _r("x", "x"))


@query(f"with {V.POINTS} select count(*) n, round(avg(src_c), 6) + 0.0 msx, round(avg(src_r), 6) + 0.0 msy, round(avg(ref_c), 6) + 0.0 mrx, round(avg(ref_r), 6) + 0.0 mry, round(covar_pop(ref_c, src_c) / 1e3, 4) + 0.0 cxx, round(covar_pop(ref_c, src_r) / 1e3, 4) + 0.0 cxy, round(covar_pop(ref_r, src_c) / 1e3, 4) + 0.0 cyx, round(covar_pop(ref_r, src_r) / 1e3, 4) + 0.0 cyy, round((var_pop(src_c) + var_pop(src_r)) / 1e3, 4) + 0.0 var from points")
def similarity_fit_moments(spark, d):
    m = geometry.moments(V.points(spark, d))
    return m.select("n", *(_r(c, c) for c in ("msx", "msy", "mrx", "mry")), *((F.round(F.col(c) / 1e3, 4) + F.lit(0.0)).alias(c) for c in ("cxx", "cxy", "cyx", "cyy", "var")))


# --- correlations ------------------------------------------------------------------------------------

_CORR = "edges as (select a.roi roi_i, b.roi roi_j, corr(a.v, b.v) r from sig a join sig b on a.g = b.g and a.roi <= b.roi group by 1, 2)"
_GSR = "cen as (select roi, g, v - avg(v) over (partition by roi) v from signal), glo as (select g, avg(v) k from cen group by 1), be as (select roi, sum(v * k) / (select sum(k * k) from glo) b from cen join glo using (g) group by 1), sig as (select roi, g, v - b * k v from cen join glo using (g) join be using (roi))"
_RAW = f"{_SIGNAL}, sig as (select * from signal), {_CORR}"


@query(f"with {_RAW} select roi_i, roi_j, round(r, 6) + 0.0 r from edges")
def roi_correlation_raw(spark, d):
    return corr.pearson(_signal(spark, d)).select("roi_i", "roi_j", _r("r", "r"))


@query(f"with {_SIGNAL}, {_GSR}, {_CORR} select roi_i, roi_j, round(r, 6) + 0.0 r from edges")
def roi_correlation_gsr(spark, d):
    return corr.gsr(_signal(spark, d)).select("roi_i", "roi_j", _r("r", "r"))


@query()
def roi_correlation_partial(spark, d):
    return corr.partial(_signal(spark, d)).select("roi_i", "roi_j", _r("r", "r"))


_THRESHOLD = "thr as (select quantile_cont(a, 0.7) t from (select abs(r) a, unnest([1, 2]) k from edges where roi_i <> roi_j))"


@query(f"with {_RAW}, {_THRESHOLD} select round(t, 6) + 0.0 threshold from thr")
def network_threshold(spark, d):
    return corr.threshold(corr.pearson(_signal(spark, d)), 0.3).select(_r("threshold", "threshold"))


@query(f"with {_RAW}, {_THRESHOLD} select roi_i, roi_j, round(r, 6) + 0.0 r from edges, thr where roi_i < roi_j and abs(r) >= t - 1e-12")
def network_edges(spark, d):
    return corr.network(corr.pearson(_signal(spark, d)), 0.3).select("roi_i", "roi_j", _r("r", "r"))


def _seed(spark) -> DataFrame:
    return _mask(spark).filter("roi = 'A_R'")


@query(f"with {V.FRAME}, {V.MASK}, s as (select g, avg(x) s from frame join mask using (r, c) where roi = 'A_R' group by 1) select r, c, round(corr(x, s), 6) + 0.0 v from frame join s using (g) group by 1, 2")
def seed_corr_map_raw(spark, d):
    return corr.seed_map(V.frame(spark, d), _seed(spark)).select("r", "c", _r("v", "v"))


@query(
    f"with {V.FRAME}, {V.MASK}, gl as (select g, k - avg(k) over () k from (select g, avg(x) k from frame group by 1)), b as (select r, c, sum(x * k) / (select sum(k * k) from gl) b from frame join gl using (g) group by 1, 2), f as (select g, r, c, x - b * k x from frame join gl using (g) join b using (r, c)), "
    "s as (select g, avg(x) s from f join mask using (r, c) where roi = 'A_R' group by 1) select r, c, round(corr(x, s), 6) + 0.0 v from f join s using (g) group by 1, 2"
)
def seed_corr_map_gsr(spark, d):
    return corr.seed_map(V.frame(spark, d), _seed(spark), "gsr").select("r", "c", _r("v", "v"))


# --- decomposition -----------------------------------------------------------------------------------

_CEN = f"{V.FRAME}, cen as (select g, p, x - avg(x) over (partition by p) x from frame)"


@query(f"with {_CEN} select a.p i, b.p j, round(sum(a.x * b.x), 2) + 0.0 v from cen a join cen b on a.g = b.g and a.p <= b.p group by 1, 2")
def pca_gram(spark, d):
    return decompose.gram(V.frame(spark, d), "p").select("i", "j", (F.round("v", 2) + F.lit(0.0)).alias("v"))


#: Eigenvalues and eigenvectors of the 64 x 64 Gram matrix in SQL: rounds of 32 disjoint plane rotations, paired as in a round-robin, until nothing is left beside the diagonal.
_ROTATIONS = 63 * 9
_EIGEN = f"""{_CEN}, gram as (select a.p i, b.p j, sum(a.x * b.x) v from cen a join cen b on a.g = b.g group by 1, 2),
turn as (
  select 0 t, 0 m, i, j, v from gram union all select 0, 1, i, j, case when i = j then 1.0 else 0.0 end from gram
  union all select * from (
    with own as (select * from turn where m = 0),
    mate as (select t, i, case when i = 63 then t * 32 % 63 when (t - i + 4032) % 63 = i then 63 else (t - i + 4032) % 63 end k from own where i = j),
    angle as (select mate.t, mate.i, k, o.v o, case when o.v = 0 then 0.0 else (case when mate.i < k then e.v - d.v else d.v - e.v end) / (2 * o.v) end tau
      from mate join own d on d.i = mate.i and d.j = mate.i join own e on e.i = k and e.j = k join own o on o.i = mate.i and o.j = k),
    tan as (select t, i, k, case when o = 0 then 0.0 else (case when tau >= 0 then 1 else -1 end) / (abs(tau) + sqrt(1 + tau * tau)) end * (case when i < k then -1 else 1 end) s from angle),
    rot as (select i, i a, 1 / sqrt(1 + s * s) w from tan union all select i, k a, s / sqrt(1 + s * s) w from tan)
    select t + 1, m, i, j, v from (
      select t, m, l.i i, r.i j, sum(l.w * r.w * own.v) v from own join rot l on l.a = own.i join rot r on r.a = own.j group by all
      union all select t, m, turn.i, r.i, sum(r.w * turn.v) from turn join rot r on r.a = turn.j where m = 1 group by all) where t < {_ROTATIONS})),
last as materialized (select * from turn where t = {_ROTATIONS}),
flat as (select i, v from last where m = 0 and i = j),
eig as materialized (select a.i e, a.v ev, count(b.v) k from flat a left join flat b on b.v > a.v group by 1, 2),
axis as materialized (select k, i p, v from last join eig on e = j where m = 1)"""
_FOUR = "kept as (select g, k, sum(x * v) a from cen join axis using (p) where k < 4 group by all), low as (select g, p, sum(a * v) y from kept join axis using (k) group by all), mean as (select p, avg(x) mean from frame group by 1)"


@query(f"with recursive {_EIGEN} select k, round(sqrt(greatest(ev, 0)), 6) + 0.0 singular, round(ev / (select sum(v) from gram where i = j), 6) + 0.0 ratio from eig where k < 6")
def pca_spectrum(spark, d):
    return decompose.spectrum(V.frame(spark, d), 6).select("k", _r("singular", "singular"), _r("ratio", "ratio"))


@query(f"with recursive {_EIGEN} select k, p, round(v * sign(arg_min(v, (-abs(v), p)) over (partition by k)), 5) + 0.0 v from axis where k < 3")
def pca_components(spark, d):
    """Maps, the largest entry positive."""
    rows = decompose.pca(V.frame(spark, d), 3).spatial.rows().select("id", F.posexplode("v").alias("k", "v"))
    peak = rows.groupBy("k").agg(F.min(F.struct(-F.abs(F.col("v")), F.col("id"), F.col("v").alias("x")))["x"].alias("peak"))
    return rows.join(peak, "k").select(F.col("k").cast("long").alias("k"), F.col("id").alias("p"), (F.round(F.col("v") * F.signum("peak"), 5) + F.lit(0.0)).alias("v"))


def _components(spark, d, k: int = 4) -> decompose.Ica:
    return decompose.ica(decompose.pca(V.frame(spark, d), k))


@query()
def ica_components(spark, d):
    return _components(spark, d).maps.select(F.posexplode("v").alias("k", "v"), "p").select("k", "p", _r("v", "v"))


@query("select cast(a as bigint) i, cast(b as bigint) j, case when a = b then 1.0 else 0.0 end v from (select unnest(range(4)) a), (select unnest(range(4)) b)")
def ica_map_covariance(spark, d):
    """Maps over pixels: unit variance, no correlation."""
    maps = _components(spark, d).maps.select("p", F.posexplode("v").alias("k", "v"))
    a, b = maps.select("p", F.col("k").alias("i"), F.col("v").alias("x")), maps.select("p", F.col("k").alias("j"), F.col("v").alias("y"))
    return a.join(b, "p").groupBy("i", "j").agg(_r(F.covar_pop("x", "y"), "v")).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")


@query(f"with recursive {_EIGEN}, {_FOUR} select g, p, round(y + mean, 5) + 0.0 x from low join mean using (p)")
def ica_reconstruction(spark, d):
    """Four independent components span what four principal ones do."""
    found = _components(spark, d)
    return decompose.reconstruct(V.frame(spark, d), found.maps, found.scores, [0, 1, 2, 3]).select("g", "p", (F.round("x", 5) + F.lit(0.0)).alias("x"))


@query(f"with {V.FRAME} select g, p, x from frame")
def ica_subtract_identity(spark, d):
    return decompose.subtract(V.frame(spark, d), spark.createDataFrame([], "p long, v array<double>"), 1, []).select("g", "p", "x")


@query()
def ica_subtract(spark, d):
    return decompose.subtract(V.frame(spark, d), _components(spark, d).maps, 4, [0]).select("g", "p", _r("x", "x"))


@query(f"with recursive {_EIGEN}, {_FOUR} select g, p, round(x - y, 5) + 0.0 x from low join frame using (g, p)")
def ica_subtract_all(spark, d):
    """Without all four components: what the four principal ones don't span."""
    return decompose.subtract(V.frame(spark, d), _components(spark, d).maps, 4, [0, 1, 2, 3]).select("g", "p", (F.round("x", 5) + F.lit(0.0)).alias("x"))


@query(f"with {V.FRAME} select p, round(avg(x), 6) + 0.0 mean from frame group by 1")
def full_timeline_mean(spark, d):
    return decompose.full_mean(V.frame(spark, d)).select("p", _r("mean", "mean"))


@query()
def register_frames(spark, d):
    px = V.frame(spark, d)
    template = [r["mean"] for r in decompose.full_mean(px).orderBy("p").collect()]
    import numpy as np

    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("g"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: F.rint(1000 + 400 * v.cast("double"))).alias("pix"))
    return register.register(rows, np.array(template).reshape(8, 8), 10, shifts_only=True).select("g", _r("shift_r", "shift_r"), _r("shift_c", "shift_c"))


# --- content checks and atlas ------------------------------------------------------------------------


@query(f"with {V.FRAME}, z as (select g, p, (x - avg(x) over (partition by g)) / (case when stddev_pop(x) over (partition by g) > 0 then stddev_pop(x) over (partition by g) else 1 end) z from frame) select g, p, round(z - avg(z) over (partition by p), 6) + 0.0 z from z")
def content_normalise(spark, d):
    return qc.normalise(V.frame(spark, d)).select("g", "p", _r("z", "z"))


@query(
    "with l as (select vec_id // 50 file_idx, vec_id % 2 ch, cast(label % 3 as bigint) cluster from embeddings), t as (select ch, cluster, count(*) n from l group by 1, 2), h as (select ch, arg_max(cluster, (n, -cluster)) home from t group by 1) "
    "select file_idx, l.ch, round(avg(case when cluster = home then 1.0 else 0.0 end), 6) + 0.0 as \"share\", avg(case when cluster = home then 1.0 else 0.0 end) < 0.8 flagged from l join h on l.ch = h.ch group by 1, 2"
)
def slip_consistency(spark, d):
    v = F.col("vec_id")
    rows = V.table(spark, d, "embeddings").select(F.floor(v / 50).alias("file_idx"), (v % 2).alias("ch"), (F.col("label") % 3).cast("long").alias("cluster"))
    return qc.consistency(rows).select("file_idx", "ch", _r("share", "share"), "flagged")


@query("select l_suppkey ap, l_linenumber ml, coalesce(min(case when l_returnflag = 'R' then {'dv': l_quantity, 'idx': l_partkey} end)['idx'], 0) idx from lineitem group by 1, 2")
def surface_projection(spark, d):
    voxels = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ap"), F.col("l_linenumber").alias("ml"), F.col("l_quantity").alias("dv"), F.col("l_partkey").alias("idx"), "l_returnflag")
    return atlas.surface(voxels, "l_returnflag = 'R'")


@query("with s as (select c_nationkey as label, count(*) n, min(c_custkey) f from customer group by 1 having count(*) >= 55) select label, n, row_number() over (order by n desc, f) + 1 region_id from s")
def assign_region_ids(spark, d):
    return atlas.region_ids(V.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("label")), 55)


@query("select n_nationkey idx, n_name acronym from nation where '/' || n_regionkey || '/' || n_nationkey || '/' like '%/3/%'")
def region_membership(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("acronym"), F.concat(F.lit("/"), "n_regionkey", F.lit("/"), "n_nationkey", F.lit("/")).alias("path"))
    return atlas.in_subtree(n, 3).select("idx", "acronym")


@query(f"with {V.FRAME} select g, cast(r2 as bigint) r, cast(4 - c2 as bigint) c, x from (select unnest(range(4)) r2), (select unnest(range(5)) c2) join frame on frame.r = r2 * 8 // 4 and frame.c = c2 * 8 // 5")
def nearest_resample_flip(spark, d):
    return atlas.resample(V.frame(spark, d).select("g", "r", "c", "x"), (8, 8), (4, 5), flip=True).select("g", "r", "c", "x")


@query("with m as (select c_custkey // 64 r, c_custkey % 64 c, c_nationkey % 3 region_id from customer) select distinct a.r, a.c, a.region_id from m a join m b on (b.r = a.r and b.c = a.c + 1) or (b.r = a.r + 1 and b.c = a.c) where a.region_id <> b.region_id")
def region_outline(spark, d):
    k = F.col("c_custkey")
    return atlas.outline(V.table(spark, d, "customer").select(F.floor(k / 64).alias("r"), (k % 64).alias("c"), (F.col("c_nationkey") % 3).alias("region_id")))


# --- names and state ---------------------------------------------------------------------------------


@query("with k as (select page_id, url, list_aggregate(list_transform(regexp_extract_all(lower(url), '(\\d+|\\D+)'), lambda p: case when regexp_matches(p, '^\\d+$') then lpad(p, 20, '0') else p end), 'string_agg', '') k from pages) select page_id, url, row_number() over (order by k, page_id) - 1 position from k")
def natural_order(spark, d):
    from pyspark.sql.window import Window

    pages = V.table(spark, d, "pages").select("page_id", "url", naming.natural_key(F.col("url")).alias("k"))
    return pages.select("page_id", "url", (F.row_number().over(Window.orderBy("k", "page_id")) - 1).cast("long").alias("position"))


@query("select page_id, try_cast(nullif(reverse(regexp_replace(url, '\\D', '', 'g')), '') as bigint) n from pages")
def reversed_digit_order(spark, d):
    return V.table(spark, d, "pages").select("page_id", naming.reversed_sequence(F.col("url")).alias("n"))


_STEM = "case when page_id % 3 = 0 then 'timelapse' || page_id || '_MM' || url when page_id % 7 = 0 then 'timelapse_MMStack' when page_id % 11 = 0 then '' else url end"


@query(f"with s as (select page_id, {_STEM} stem from pages) select page_id, case when regexp_matches(stem, 'timelapse(.*?)_MM') then regexp_extract(stem, 'timelapse(.*?)_MM', 1) when stem <> '' then stem end as \"name\" from s")
def infer_experiment_name(spark, d):
    return V.table(spark, d, "pages").select("page_id", naming.experiment_name(F.expr(_STEM)).alias("name"))


@query("with g as (select * from (values ('http'), ('http://a'), ('http://the'), ('http://th'), ('http://thth')) t(name)) select page_id, arg_max(name, length(name)) owner from pages join g on starts_with(url, name) group by 1")
def owning_group_longest_prefix(spark, d):
    groups = F.broadcast(spark.createDataFrame([(n,) for n in ("http", "http://a", "http://the", "http://th", "http://thth")], "name string"))  # a recording's groups
    pages = V.table(spark, d, "pages").select("page_id", "url")
    return pages.join(groups, F.col("url").startswith(F.col("name"))).groupBy("page_id").agg(F.max_by("name", F.length("name")).alias("owner"))


@query("select event_id, list_aggregate(list_transform(list_sort(list_distinct([cast(json_extract(props, '$.k') as bigint), event_id % 5, 3])), lambda i: 'IC' || (i + 1)), 'string_agg', ',') labels, event_id % 5 as \"first\" from events where props is not null")
def exclusion_json_roundtrip(spark, d):
    e = V.table(spark, d, "events").filter("props is not null").withColumn("k", F.from_json("props", "k long")["k"])
    labels = naming.component_labels(F.array("k", F.col("event_id") % 5, F.lit(3).cast("long")))
    back = naming.component_indices(F.from_json(F.to_json(F.struct(labels.alias("l"))), "l array<string>")["l"])
    return e.select("event_id", F.array_join(naming.component_labels(back), ",").alias("labels"), F.element_at(F.filter(back, lambda i: i == F.col("event_id") % 5), 1).alias("first"))


@query("select count(*) n, cast(coalesce(sum(cast(cast('0x' || md5(coalesce(cast(event_id as varchar), chr(0)) || chr(31) || coalesce(cast(cast(floor(value * 1000000) as bigint) as varchar), chr(0)))[:15] as ubigint) as hugeint)), 0) as varchar) digest from events")
def table_fingerprint(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.floor(F.col("value") * 1000000).cast("long").alias("micro"))
    return rows.agg(*naming.fingerprint("event_id", "micro"))


# --- previews and labels -----------------------------------------------------------------------------


@query(f"with {_RESID}, n3 as (select n // 3 k, n from n), part as (select case when g < k then 'first' when g >= n - k then 'last' end part, g % 4 phase, resid from resid, n3) select part, phase, round(avg(resid), 5) + 0.0 mean, count(*) n from part where part is not null group by 1, 2")
def correction_preview(spark, d):
    resid, n = _resid(spark, d), V.mean(spark, d).count()
    part = F.when(F.col("g") < n // 3, "first").when(F.col("g") >= n - n // 3, "last")
    rows = resid.select(part.alias("part"), demux.channel_at(F.col("g"), C).alias("phase"), "resid").filter("part is not null")
    return rows.groupBy("part", "phase").agg((F.round(F.avg("resid"), 5) + F.lit(0.0)).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    f"with {V.FRAME}, h as (select distinct file_idx, g, dense_rank() over (partition by file_idx order by g) k from frame) select file_idx, g, ((g + 3) % 4) ch, 'Ch' || ((g + 3) % 4) || '_' || ['a', 'b', 'a', 'c'][(g + 3) % 4 + 1] || '-' || ['source', 'source', 'donner', 'donner'][(g + 3) % 4 + 1] token from h where k <= 4"
)
def input_preview(spark, d):
    head = frames.head_per_file(V.frame(spark, d).select("file_idx", "g").distinct(), 4).select("file_idx", "g", demux.channel_at(F.col("g"), C, 3).alias("ch"))
    names, roles = F.array(*map(F.lit, "abac")), F.array(*(naming.role(F.lit(r)) for r in (" S ", "source", "d", "Donner")))
    return head.select("file_idx", "g", "ch", naming.channel_token(F.col("ch"), F.get(names, F.col("ch")), F.get(roles, F.col("ch"))).alias("token"))


@query(
    f"with {V.SPOTS}, custom as (select name || ' ' as \"name\", x + 1 x, y from roi where size > 4), names as (select ' ' || name roi from roi where size <> 2 union all select n_name from nation) "
    "select trim(n.roi) roi, cast(coalesce(c.y, a.y) as bigint) r, cast(coalesce(c.x, a.x) as bigint) c from names n left join custom c on trim(c.name) = trim(n.roi) left join (select * from roi where size <> 6) a on a.name = trim(n.roi)"
)
def roi_coordinates(spark, d):
    rois = V.spots(spark, d)
    custom = rois.filter("size > 4").select(F.concat("name", F.lit(" ")).alias("name"), (F.col("x") + 1).alias("x"), "y", "size")
    names = rois.filter("size <> 2").select(F.concat(F.lit(" "), "name").alias("roi")).unionByName(V.table(spark, d, "nation").select(F.col("n_name").alias("roi")))
    return roi.coordinates(names, custom, rois.filter("size <> 6"))


@query(f"with {V.FRAME}, v as (select quantile_cont(abs(x - 1000), 0.99) q from frame) select round(case when q < 1e-6 then 1.0 else q end, 6) + 0.0 half_range from v")
def display_range(spark, d):
    q = V.frame(spark, d).agg(F.percentile(F.abs(F.col("x") - 1000), F.lit(0.99)).alias("q"))
    return q.select(_r(F.when(F.col("q") < 1e-6, 1.0).otherwise(F.col("q")), "half_range"))


@query("select p_partkey, regexp_replace(p_brand || '2/3', '(1|2/3|4|5|6a|6b)$', '') area, cast(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') as bigint) n from part")
def area_names(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", atlas.without_layer(F.concat("p_brand", F.lit("2/3"))).alias("area"), naming.embedded_number(F.col("p_brand")).alias("n"))


@query(f"with {V.FRAME}, w as (select * from (values (0.2989, 0), (0.5870, 1), (0.1140, 2)) t(k, ch)) select g // 3 t, p, round(sum(x * k), 6) + 0.0 gray from frame join w on g % 3 = ch where g // 3 < (select max(g) // 3 from frame) group by 1, 2")
def gray_map(spark, d):
    t, ch = F.floor(F.col("g") / 3), F.pmod("g", F.lit(3))
    last = V.table(spark, d, "embeddings").agg(F.floor(F.max("vec_id") / 3)).first()[0]
    pick = lambda k: F.max(F.when(ch == k, F.col("x")))
    rgb = V.frame(spark, d).filter(t < last).groupBy(t.alias("t"), "p").agg(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))
    return rgb.select("t", "p", _r(frames.luminance(F.col("r"), F.col("g"), F.col("b")), "gray"))


@query(f"with {V.SPOTS} select \"name\", cast(x as bigint) x, cast(y as bigint) y, cast(size as bigint) size from roi union all select case when name like '%\\_R' escape '\\' then name[:-3] || '_L' when name like '%\\_L' escape '\\' then name[:-3] || '_R' else name || '_contra' end, cast(7 - x as bigint), cast(y as bigint), cast(size as bigint) from roi")
def both_hemispheres(spark, d):
    return atlas.both_hemispheres(V.spots(spark, d), 8)


@query()
def content_slip_qc(spark, d):
    px = frames.decimate(frames.head_per_file(V.frame(spark, d), 8), 2)
    found = qc.clusters(qc.embed(px.select("g", "p", "x")), 2)
    return qc.consistency(found.select(F.floor(F.col("g") / 50).alias("file_idx"), F.pmod("g", F.lit(2)).alias("ch"), F.col("cluster").cast("long").alias("cluster")))


# --- atlas build -------------------------------------------------------------------------------------

_TREE = "tree as (select p_partkey + 1 node, (p_partkey + 1) // 3 parent, p_name as \"name\" from part), up as (select node, node ancestor, 0::bigint distance from tree union all select up.node, tree.parent, distance + 1 from up join tree on tree.node = up.ancestor where tree.parent in (select node from tree))"


def _tree(spark, d) -> DataFrame:
    return V.table(spark, d, "part").select((F.col("p_partkey") + 1).alias("node"), F.floor((F.col("p_partkey") + 1) / 3).alias("parent"), F.col("p_name").alias("name"))


@query(f"with recursive {_TREE} select * from up")
def structure_closure(spark, d):
    return atlas_build.closure(_tree(spark, d))


@query(
    f"with recursive {_TREE}, inside as (select distinct node from up where ancestor in (2, 7)), v as (select l_suppkey ap, l_linenumber ml, l_quantity dv, l_partkey + 1 idx, inside.node is not null hit from lineitem left join inside on inside.node = l_partkey + 1) "
    "select ap, ml, coalesce(arg_min(idx, (dv, idx)) filter (hit), 0) idx from v group by 1, 2"
)
def atlas_surface(spark, d):
    voxels = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ap"), F.col("l_linenumber").alias("ml"), F.col("l_quantity").alias("dv"), (F.col("l_partkey") + 1).alias("idx"))
    inside = atlas_build.members(atlas_build.closure(_tree(spark, d)), atlas_build.named(_tree(spark, d), [2, 7]))
    return atlas_build.surface(voxels, inside)


_LABELS = "px as (select c_custkey // 32 r, c_custkey % 32 c, case when c_nationkey % 5 = 0 then '' else c_mktsegment || c_nationkey % 7 end label from customer)"


def _labels(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    label = F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.concat("c_mktsegment", (F.col("c_nationkey") % 7).cast("string")))
    return V.table(spark, d, "customer").select(F.floor(k / 32).alias("r"), (k % 32).cast("long").alias("c"), label.alias("label"))


_REGIONS = f"{_LABELS}, area as (select label, 2 * row_number() over (order by count(*) desc, min(r * 32 + c)) f from px where label <> '' group by label having count(*) >= 15)"


@query(f"with {_REGIONS} select r, c, coalesce(f + (c >= 15.5)::bigint, 1) region_id from px left join area using (label)")
def atlas_regions(spark, d):
    return atlas_build.regions(_labels(spark, d), 32)[0]


@query(f"with {_REGIONS} select f region_id, label as \"name\" from area union all select f + 1, label || '_R' from area union all select 1, 'background'")
def atlas_region_names(spark, d):
    return atlas_build.regions(_labels(spark, d), 32)[1]


@query(f"with {V.SPOT_MASK}, m as (select mask.r, mask.c, cast(substr(regexp_extract(roi, '[0-9]+'), -1) as int) b from mask) select r, c, bit_or(1::bigint << b) bits from m group by 1, 2")
def mask_union(spark, d):
    masks = roi.discs(V.spots(spark, d), 8, 8)
    return atlas_build.mask_bits(masks.select(F.regexp_extract("roi", "([0-9])(_|$)", 1).cast("int").alias("bit"), "r", "c"))


def _turned(k: int, a: str, b: str, degrees: float) -> str:
    """One rotation in the plane of two axes, as SQL: volume k to volume k + 1."""
    cos, sin = atlas_build._turn(degrees)
    size = {"ap": "(select max(vec_id) + 1 from embeddings)", "dv": "8", "ml": "8"}
    rest = next(x for x in ("ap", "dv", "ml") if x not in (a, b))
    return (
        f"p{k} as (select n, m, u i, w j, (n - 1) / 2.0::double hi, (m - 1) / 2.0::double hj from (select {size[a]} n, {size[b]} m), range({size[a]}) t1(u), range({size[b]}) t2(w)), "
        f"q{k} as (select i, j, n, m, ({cos!r})::double * i + ({sin!r})::double * j + (hi - (({cos!r})::double * hi + ({sin!r})::double * hj)) y, ({-sin!r})::double * i + ({cos!r})::double * j + (hj - (({-sin!r})::double * hi + ({cos!r})::double * hj)) x from p{k}), "
        f"v{k + 1} as (select i {a}, j {b}, {rest}, idx from v{k} join q{k} on v{k}.{a} = cast(floor(y + 0.5) as bigint) and v{k}.{b} = cast(floor(x + 0.5) as bigint) where y between 0 and n - 1 and x between 0 and m - 1)"
    )


@query(f"with v0 as (select vec_id ap, cast(p // 8 as bigint) dv, cast(p % 8 as bigint) ml, cast(label * 64 + p as bigint) idx from embeddings, (select unnest(range(64)) p)), {_turned(0, 'dv', 'ml', 20.0)}, {_turned(1, 'ap', 'dv', -1.5)}, {_turned(2, 'ap', 'ml', 180.0)} select ap, dv, ml, idx from v3")
def volume_tilt(spark, d):
    """Frames stacked to a volume, rotated about its three axes."""
    rows = V.table(spark, d, "embeddings")
    n = rows.agg(F.max("vec_id") + 1).first()[0]
    p = F.col("p").cast("long")
    voxels = rows.select(F.col("vec_id").alias("ap"), "label", F.posexplode("embedding").alias("p", "v")).select("ap", F.floor(p / 8).alias("dv"), (p % 8).alias("ml"), (F.col("label") * 64 + p).cast("long").alias("idx"))
    return atlas_build.tilt(voxels, (n, 8, 8), 20.0, -1.5, 180.0)
