"""Disc regions and their signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry


def discs(rois: DataFrame, height: int, width: int, floor: float = 0.5) -> DataFrame:
    """(roi, r, c): pixels with (r - y)^2 + (c - x)^2 <= (size / 2)^2, from each region's bounding box; cut by the border. ``rois``: (name, x, y, size)."""
    radius = F.greatest(F.col("size") / 2.0, F.lit(floor))
    reach = F.ceil(radius)
    around = lambda c: F.sequence(c - reach, c + reach)
    box = rois.select(F.col("name").alias("roi"), "x", "y", radius.alias("radius"), F.explode(around(F.col("y"))).alias("r"), around(F.col("x")).alias("_c")).select("roi", "x", "y", "radius", "r", F.explode("_c").alias("c"))
    inside = (F.col("r") - F.col("y")) * (F.col("r") - F.col("y")) + (F.col("c") - F.col("x")) * (F.col("c") - F.col("x")) <= F.col("radius") * F.col("radius")
    return box.filter(inside & (F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)).select("roi", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


def signals(px: DataFrame, masks: DataFrame, *by: str) -> DataFrame:
    """Mean over each region's pixels, per frame (and ``by``). Masks are few pixels and broadcast; only their pixels survive the join."""
    return px.join(F.broadcast(masks), ["r", "c"]).groupBy("roi", *by, "g").agg(F.avg("x").alias("v"))


def signals_from_source(px: DataFrame, masks: DataFrame, pull: geometry.Matrix, out_shape: tuple[int, int], in_shape: tuple[int, int], *by: str) -> DataFrame:
    """The regions' means of the warped movie without warping it: weights first. The divisor is the mask's pixel count, so what lies outside the view counts 0."""
    size = masks.groupBy("roi").agg(F.count(F.lit(1)).alias("_n"))
    w = geometry.fold_weights(masks, pull, out_shape, in_shape).join(size, "roi").select("roi", "r", "c", (F.col("w") / F.col("_n")).alias("w"))
    clean = F.nanvl("x", F.lit(0.0))
    return px.join(F.broadcast(w), ["r", "c"]).groupBy("roi", *by, "g").agg(F.sum(clean * F.col("w")).alias("v"))


def wide(signal: DataFrame, names: list[str], fps: float) -> DataFrame:
    """A row per time, a column per region."""
    return signal.groupBy((F.col("g") / F.lit(fps)).alias("time_s")).pivot("roi", names).agg(F.first("v"))


def contralateral(rois: DataFrame, width: int) -> DataFrame:
    """Each region mirrored: _R and _L swap, other names get _contra."""
    n = F.col("name")
    base = F.substring(n, F.lit(1), F.length(n) - 2)
    name = F.when(n.endswith("_R"), F.concat(base, F.lit("_L"))).when(n.endswith("_L"), F.concat(base, F.lit("_R"))).otherwise(F.concat(n, F.lit("_contra")))
    return rois.select(name.alias("name"), (F.lit(width - 1) - F.col("x")).cast("long").alias("x"), "y", "size")


def resolve(custom: DataFrame | None, default: DataFrame) -> DataFrame:
    """A non-empty custom set replaces the defaults as a whole."""
    return default if custom is None or custom.isEmpty() else custom


def coordinates(names: DataFrame, custom: DataFrame, atlas: DataFrame) -> DataFrame:
    """(roi, r, c): from the custom set, else the atlas, else null; names are trimmed on both sides."""
    pick = lambda t, s: t.select(F.trim("name").alias("roi"), F.col("y").alias(f"r{s}"), F.col("x").alias(f"c{s}"))
    joined = names.select(F.trim("roi").alias("roi")).join(pick(custom, 1), "roi", "left").join(pick(atlas, 2), "roi", "left")
    return joined.select("roi", F.coalesce("r1", "r2").alias("r"), F.coalesce("c1", "c2").alias("c"))
