"""Frame algebra on pixel rows (g, p, r, c, x): filters, casts, means, binning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def frame_means(px: DataFrame) -> DataFrame:
    return px.groupBy("g").agg(F.avg("x").alias("m"))


def mean_image(px: DataFrame, *by: str) -> DataFrame:
    return px.groupBy(*by, "p").agg(F.avg("x").alias("mean"))


def template(px: DataFrame, channel: int, stride: int, cycle: int) -> DataFrame:
    """Mean of the last file's frames ``channel, + stride * cycle, ...`` by their index in the file; one clamped frame if there is none."""
    last, n = px.agg(F.max("file_idx")).first()[0], None
    rows = px.filter(F.col("file_idx") == last)
    lo, hi = rows.agg(F.min("g"), F.max("g")).first()
    n = hi - lo + 1
    local = F.col("g") - lo
    if channel < n:
        rows = rows.filter((local >= channel) & (F.pmod(local - channel, F.lit(stride * cycle)) == 0))
    else:
        rows = rows.filter(local == min(channel, max(0, n - 1)))
    return rows.groupBy("p").agg(F.avg("x").alias("mean"))


def head_per_file(px: DataFrame, n: int) -> DataFrame:
    """The first n frames of each file: a file's first index is a map-side minimum, no window over frames."""
    first = px.groupBy("file_idx").agg(F.min("g").alias("_g0"))
    return px.join(F.broadcast(first), "file_idx").filter(F.col("g") < F.col("_g0") + n).drop("_g0")


def cap(px: DataFrame, n: int) -> DataFrame:
    return px.filter(F.col("g") < n)


def stride(px: DataFrame, k: int) -> DataFrame:
    return px.filter(F.pmod("g", F.lit(k)) == 0)


def decimate(px: DataFrame, d: int) -> DataFrame:
    return px.filter((F.col("r") % d == 0) & (F.col("c") % d == 0))


def flip_left_right(px: DataFrame, width: int) -> DataFrame:
    return px.withColumn("c", (F.lit(width - 1) - F.col("c")).cast("long"))


def crop(px: DataFrame, height: int, width: int) -> DataFrame:
    return px.filter((F.col("r") < height) & (F.col("c") < width))


def saturated(x: Column) -> Column:
    """uint16 by clipping, then rounding half to even."""
    return F.rint(F.greatest(F.least(x, F.lit(65535.0)), F.lit(0.0))).cast("long")


def truncated(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(65535.0)), F.lit(0.0)).cast("long")


def block_bin(px: DataFrame, b: int) -> DataFrame:
    """Plain block means: the cheap stand-in for ``resize``."""
    return px.groupBy("g", F.floor(F.col("r") / b).alias("r"), F.floor(F.col("c") / b).alias("c")).agg(F.avg("x").alias("x"))


def resize_weights(n: int, binning: float) -> np.ndarray:
    """Rows of the 1-D linear map of an anti-aliased order-1 resize: Gaussian (sigma (f - 1) / 2, mirror edges), then linear interpolation at pixel centres."""
    m = max(1, int(round(n / binning)))
    f = n / m
    sigma = max(0.0, (f - 1) / 2)
    blur = np.eye(n)
    if sigma > 0:
        radius = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        k /= k.sum()
        blur = np.zeros((n, n))
        for i in range(n):
            for j, w in zip(range(i - radius, i + radius + 1), k, strict=True):
                blur[i, _mirror(j, n)] += w
    out = np.zeros((m, n))
    for i in range(m):
        at = (i + 0.5) * f - 0.5
        lo = int(np.floor(at))
        for j, w in ((lo, 1 - (at - lo)), (lo + 1, at - lo)):
            out[i] += w * blur[_mirror(j, n)]
    return out


def _mirror(j: int, n: int) -> int:
    """Index under reflection without repeating the edge."""
    if n == 1:
        return 0
    j = abs(j) % (2 * n - 2)
    return j if j < n else 2 * n - 2 - j


def _sparse(spark, w: np.ndarray, to: str, of: str, name: str) -> DataFrame:
    i, j = np.nonzero(np.abs(w) > 1e-15)
    return F.broadcast(spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(i, j, strict=True)], f"{to} long, {of} long, {name} double"))  # at most H x H' numbers


def resize(px: DataFrame, height: int, width: int, binning: float) -> DataFrame:
    """The anti-aliased resize as two sparse maps, rows then columns; each is a broadcast join and a sum combined map-side."""
    if binning <= 0:
        return px.select("g", "r", "c", "x")
    spark = px.sparkSession
    rows = px.join(_sparse(spark, resize_weights(height, binning), "r2", "r", "w"), "r").groupBy("g", "r2", "c").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    cols = rows.join(_sparse(spark, resize_weights(width, binning), "c2", "c", "w"), "c").groupBy("g", "r2", "c2").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    return cols.select("g", F.col("r2").alias("r"), F.col("c2").alias("c"), "x")


def by_index(px: DataFrame, indices: list[int]) -> DataFrame:
    """Frames in the order of a list, repeats kept: adds ``position``."""
    spark = px.sparkSession
    wanted = spark.createDataFrame([(i, int(g)) for i, g in enumerate(indices)], "position long, g long")
    return px.join(F.broadcast(wanted), "g")


def interleave(px: DataFrame, channels: int) -> DataFrame:
    """A (t, channel) grid flattened to one index: g = t * channels + channel."""
    return px.withColumn("g", F.col("t") * channels + F.col("ch"))


def merge_parts(parts: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Parts merged by a stable order of source_index (ties: part, place in it); adds the merged index g.

    Ranks inside blocks of source_index, and a running sum over a row per block.
    """
    own = parts.withColumn("_b", F.floor(F.col("source_index") / block))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = own.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(before, F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("source_index", "part", "local")) - 1
    return own.withColumn("_r", rank).join(base, "_b").withColumn("g", (F.col("_r") + F.col("_base")).cast("long")).select(*parts.columns, "g")


def average_sources(px: DataFrame) -> DataFrame:
    """Mean over channels at the same t, cut to the shortest channel first. ``px``: (ch, t, p, x)."""
    shortest = px.groupBy("ch").agg((F.max("t") + 1).alias("n")).agg(F.min("n").alias("_n"))
    return px.crossJoin(F.broadcast(shortest)).filter("t < _n").groupBy("t", "p").agg(F.avg("x").alias("x"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2989 * r + 0.5870 * g + 0.1140 * b
