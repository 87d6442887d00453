"""Correlations between region signals (roi, g, v) and networks of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def _pairs(signal: DataFrame) -> DataFrame:
    """Sums per pair of regions i <= j: each time's regions meet in one row, pairs are made there and combined map-side. Regions are few (tens)."""
    rows = signal.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("roi", "v"))).alias("s"))  # a frame's regions
    i = rows.select("g", "s", F.posexplode("s").alias("_i", "a"))
    ij = i.select(F.col("a"), F.explode(F.slice("s", F.col("_i") + 1, F.size("s"))).alias("b"))
    return ij.select(F.col("a.roi").alias("roi_i"), F.col("b.roi").alias("roi_j"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))


def _centred(signal: DataFrame) -> DataFrame:
    mean = signal.groupBy("roi").agg(F.avg("v").alias("_m"))
    return signal.join(F.broadcast(mean), "roi").withColumn("v", F.col("v") - F.col("_m")).drop("_m")


def pearson(signal: DataFrame) -> DataFrame:
    """(roi_i, roi_j, r) for i <= j; null where a region is constant."""
    x, y = F.col("x"), F.col("y")
    sums = _pairs(_centred(signal)).groupBy("roi_i", "roi_j").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    den = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    return sums.select("roi_i", "roi_j", F.when(den > TINY, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / F.when(den > TINY, den).otherwise(1.0)))).alias("r"))


def without_global(signal: DataFrame) -> DataFrame:
    """Centred signals with their projection on the mean over regions removed; unchanged when that mean is flat."""
    c = _centred(signal)
    common = c.groupBy("g").agg(F.avg("v").alias("_g"))
    power = common.agg(F.sum(F.col("_g") * F.col("_g")).alias("_p"))
    joined = c.join(common, "g")
    beta = joined.groupBy("roi").agg(F.sum(F.col("v") * F.col("_g")).alias("_b")).crossJoin(F.broadcast(power))
    slope = F.when(F.col("_p") > TINY, F.col("_b") / F.when(F.col("_p") > TINY, F.col("_p")).otherwise(1.0)).otherwise(0.0)
    return joined.join(F.broadcast(beta.select("roi", slope.alias("_s"))), "roi").select("roi", "g", (F.col("v") - F.col("_s") * F.col("_g")).alias("v"))


def gsr(signal: DataFrame) -> DataFrame:
    return pearson(without_global(signal))


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Shrunk covariance of samples in rows (Ledoit and Wolf 2004): towards the mean variance times identity."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min((((x**2).T @ (x**2)).sum() / n - (s**2).sum()) / (n * p), d2)
    share = 0.0 if d2 == 0 else b2 / d2
    return share * mu * np.eye(p) + (1 - share) * s


def partial(signal: DataFrame, most: int = 5_000_000) -> DataFrame:
    """Partial correlations from the shrunk precision matrix; all i <= j. The regions x regions finish runs on the driver, on at most ``most`` values."""
    names = [r["roi"] for r in signal.select("roi").distinct().orderBy("roi").limit(2_001).collect()]
    times = signal.select("g").distinct().count()
    if len(names) * times > most or len(names) > 2_000:
        raise ValueError("too many values for the driver's finish")
    if len(names) < 2 or times < 2:
        return pearson(signal)
    table = signal.groupBy("g").pivot("roi", names).agg(F.first("v")).orderBy("g").drop("g").toPandas().to_numpy(float)
    prec = np.linalg.pinv(ledoit_wolf(table))
    d = np.sqrt(np.diag(prec))
    with np.errstate(invalid="ignore", divide="ignore"):
        c = -prec / np.outer(d, d)
    c[~np.isfinite(c)] = 0.0
    np.fill_diagonal(c, 1.0)
    return signal.sparkSession.createDataFrame([(names[i], names[j], float(c[i, j])) for i in range(len(names)) for j in range(i, len(names))], "roi_i string, roi_j string, r double")


def threshold(edges: DataFrame, density: float = 0.2) -> DataFrame:
    """One row: the (1 - density) quantile of |r| off the diagonal (both triangles weigh the same, so one suffices up to rank interpolation: both are used)."""
    density = min(max(density, 1e-3), 1.0)
    off = edges.filter((F.col("roi_i") != F.col("roi_j")) & F.col("r").isNotNull()).select(F.explode(F.array(F.abs("r"), F.abs("r"))).alias("a"))
    return off.agg(F.coalesce(F.percentile("a", F.lit(1.0 - density)), F.lit(0.0)).alias("threshold"))


def network(edges: DataFrame, density: float = 0.2) -> DataFrame:
    """Edges i < j at or above the threshold."""
    return edges.crossJoin(F.broadcast(threshold(edges, density))).filter((F.col("roi_i") < F.col("roi_j")) & (F.abs("r") >= F.col("threshold"))).select("roi_i", "roi_j", "r")


def seed_map(px: DataFrame, mask: DataFrame, method: str = "raw") -> DataFrame:
    """(r, c, v): Pearson r of each pixel with the mean of the seed's pixels; ``gsr`` first removes the mean over all pixels. 0 where undefined.

    Three passes of map-side combined sums: per frame (seed and global mean), per pixel (means), per pixel (products).
    """
    if method not in ("raw", "gsr"):
        raise ValueError(f"unknown method: {method}")
    marked = px.join(F.broadcast(mask.select("r", "c", F.lit(1).alias("_in"))), ["r", "c"], "left")
    frames = marked.groupBy("g").agg(F.avg("x").alias("_g"), F.avg(F.when(F.col("_in") == 1, F.col("x"))).alias("_s"))
    means = frames.agg(F.avg("_g").alias("_mg"), F.avg("_s").alias("_ms"))
    frames = frames.crossJoin(F.broadcast(means)).select("g", (F.col("_g") - F.col("_mg")).alias("_g"), (F.col("_s") - F.col("_ms")).alias("_s"))
    rows = px.join(frames, "g")
    if method == "gsr":
        power = frames.agg(F.sum(F.col("_g") * F.col("_g")).alias("_p"), F.sum(F.col("_s") * F.col("_g")).alias("_q"))
        over = lambda v: F.when(F.col("_p") > 0, v / F.when(F.col("_p") > 0, F.col("_p")).otherwise(1.0)).otherwise(0.0)
        pixel = rows.groupBy("r", "c").agg(F.sum(F.col("x") * F.col("_g")).alias("_b")).crossJoin(F.broadcast(power)).select("r", "c", over(F.col("_b")).alias("_b"), over(F.col("_q")).alias("_sb"))
        rows = rows.join(pixel, ["r", "c"]).select("g", "r", "c", (F.col("x") - F.col("_b") * F.col("_g")).alias("x"), (F.col("_s") - F.col("_sb") * F.col("_g")).alias("_s"))
    mean = rows.groupBy("r", "c").agg(F.avg("x").alias("_m"))
    x, s = F.col("x") - F.col("_m"), F.col("_s")
    sums = rows.join(mean, ["r", "c"]).groupBy("r", "c").agg(F.sum(x * s).alias("xs"), F.sum(x * x).alias("xx"), F.sum(s * s).alias("ss"))
    den = F.sqrt(F.col("xx") * F.col("ss"))
    return sums.select("r", "c", F.when(den > 0, F.col("xs") / F.when(den > 0, den).otherwise(1.0)).otherwise(0.0).alias("v"))
