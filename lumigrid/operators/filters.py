"""Smoothing over time and space on pixel rows (g, r, c, x)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship


def moving_average(px: DataFrame, n: int, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """Centred mean over 2 n + 1 times of a pixel, cut at the ends."""
    w = Window.partitionBy(*keys).orderBy("g").rowsBetween(-n, n)
    return px.withColumn("x", F.avg("x").over(w))


def _mirror(j: Column, n: int) -> Column:
    """Index under half-sample reflection: d c b a | a b c d | d c b a."""
    k = F.pmod(j, F.lit(2 * n))
    return F.when(k < n, k).otherwise(2 * n - 1 - k)


def _taps(size: int, kind: str) -> list[tuple[int, float]]:
    """Offsets and weights of one axis. Even boxes reach one further back."""
    if kind == "gaussian":
        sigma = (size - 1) / 2
        radius = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        return list(zip(range(-radius, radius + 1), (w / w.sum()).tolist(), strict=True))
    return [(o, 1.0 / size) for o in range(-(size // 2), size - size // 2)]


def _along(px: DataFrame, axis: str, n: int, taps: list[tuple[int, float]]) -> DataFrame:
    """One separable pass: every value goes to the outputs that read it (a few more at the edges), sums combine map-side."""
    others = [k for k in ("g", "r", "c") if k != axis]
    at = F.col(axis)
    reach = max(abs(o) for o, _ in taps)
    # output i reads mirror(i + o); so value j feeds every i with mirror(i + o) = j: i + o among the mirror images of j
    images = [at, -1 - at, 2 * n - 1 - at]
    period = 2 * n
    more = [period * k + v for k in range(-(reach // period) - 1, reach // period + 2) for v in (at, -1 - at)] if reach >= n else images
    feeds = F.explode(F.array_distinct(F.array(*(v.cast("long") for v in more))))
    spread = px.select(*others, "x", feeds.alias("_v"))
    tap = F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("o"), F.lit(w).alias("w")) for o, w in taps)))
    rows = spread.filter((F.col("_v") >= -reach) & (F.col("_v") < n + reach)).select(*others, "x", "_v", tap.alias("_t"))
    rows = rows.select(*others, (F.col("_v") - F.col("_t.o")).alias(axis), (F.col("x") * F.col("_t.w")).alias("x")).filter((F.col(axis) >= 0) & (F.col(axis) < n))
    return rows.groupBy("g", "r", "c").agg(F.sum("x").alias("x"))


def smooth(px: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], kind: str = "mean") -> DataFrame:
    """``mean``, ``median`` or ``gaussian`` over (rows, columns, time) windows; ``shape`` is (rows, columns, frames). All sizes 1: unchanged."""
    if kind not in ("mean", "median", "gaussian"):
        raise ValueError(f"unknown filter: {kind}")
    size = tuple(max(1, int(s)) for s in size)
    if all(s == 1 for s in size):
        return px.select("g", "r", "c", "x")
    if kind == "median":
        return median(px, shape, size)
    for axis, n, s in zip(("r", "c", "g"), shape, size, strict=True):
        if s > 1:
            px = _along(px, axis, n, _taps(s, kind))
    return px.select("g", "r", "c", "x")


def median(px: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """The value of rank size // 2 in each reflected window, from per-pixel gathers of the window's places."""
    rows = px.select("g", "r", "c", "x")
    for axis, n, s in zip(("r", "c", "g"), shape, size, strict=True):
        if s > 1:
            # value j feeds the outputs i with mirror(i + o) = j
            taps = F.explode(F.array(*(F.lit(o).cast("long") for o, _ in _taps(s, "mean"))))
            at = F.col(axis)
            images = F.explode(F.array_distinct(F.array(at.cast("long"), (-1 - at).cast("long"), (2 * n - 1 - at).cast("long"))))
            rows = rows.withColumn("_v", images).withColumn("_o", taps).withColumn(axis, F.col("_v") - F.col("_o")).filter((F.col(axis) >= 0) & (F.col(axis) < n)).drop("_v", "_o")
    rank = (size[0] * size[1] * size[2]) // 2
    return rows.groupBy("g", "r", "c").agg(F.sort_array(F.collect_list("x"))[rank].alias("x"))  # a window's values


def smooth_scores(scores: DataFrame, sigma: float) -> DataFrame:
    """Gaussian along t per component k (edge values repeat), for display. ``scores``: (k, t, v)."""
    ship(scores.sparkSession)
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pdf[["k", "t"]].assign(v=np.convolve(np.pad(pdf["v"].to_numpy(), radius, mode="edge"), w, "valid"))

    return scores.select("k", "t", "v").groupBy("k").applyInPandas(run, "k long, t long, v double")


def smooth_masked(image: np.ndarray, sigma: float) -> np.ndarray:
    """Normalised Gaussian inside the finite pixels of one map; elsewhere NaN stays."""
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()

    def blur(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            n = a.shape[axis]
            at = np.arange(-radius, n + radius) % (2 * n)
            at = np.where(at < n, at, 2 * n - 1 - at)
            a = np.apply_along_axis(np.convolve, axis, np.take(a, at, axis), w, "valid")
        return a

    mask = np.isfinite(image)
    den = blur(mask.astype(float))
    out = np.where(den > 1e-6, blur(np.where(mask, image, 0.0)) / np.where(den > 1e-6, den, 1.0), 0.0)
    return np.where(mask, out, math.nan)
