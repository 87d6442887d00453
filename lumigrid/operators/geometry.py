"""Maps between the recording's pixels and atlas pixels.

A transform is a 2 x 3 matrix on (x = column, y = row). Warping is a sparse linear operator: each output pixel
reads four neighbours of its source place, outside ones count 0. Weights are a small table (output pixels x 4),
computed from the grid alone and broadcast, so warping frames is one join and one map-side combined sum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Matrix = tuple[tuple[float, float, float], tuple[float, float, float]]


def inverse(m: Matrix) -> Matrix:
    full = np.linalg.inv(np.array([*m, (0.0, 0.0, 1.0)]))
    return tuple(map(tuple, full[:2].tolist()))


def describe(m: Matrix) -> dict:
    (a, b, tx), (c, d, ty) = m
    det = a * d - b * c
    return {"scale": abs(det) ** 0.5, "rotation": float(np.degrees(np.arctan2(c, a))), "tx": tx, "ty": ty, "reflected": det < 0}


def taps(spark: SparkSession, pull: Matrix, out_shape: tuple[int, int], in_shape: tuple[int, int]) -> DataFrame:
    """(r2, c2, r, c, w): output pixel (r2, c2) reads pixel (r, c) with weight w. ``pull`` maps output to input places."""
    (a, b, tx), (d, e, ty) = pull
    h2, w2 = out_shape
    h, w = in_shape
    grid = spark.range(h2 * w2).select(F.floor(F.col("id") / w2).alias("r2"), F.pmod("id", F.lit(w2)).alias("c2"))
    x = F.lit(a) * F.col("c2") + F.lit(b) * F.col("r2") + F.lit(tx)
    y = F.lit(d) * F.col("c2") + F.lit(e) * F.col("r2") + F.lit(ty)
    place = grid.select("r2", "c2", x.alias("x"), y.alias("y")).withColumn("x0", F.floor("x")).withColumn("y0", F.floor("y"))
    fx, fy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    four = F.explode(F.array(*(F.struct((F.col("y0") + j).alias("r"), (F.col("x0") + i).alias("c"), ((fy if j else 1 - fy) * (fx if i else 1 - fx)).alias("w")) for j in (0, 1) for i in (0, 1))))
    return place.select("r2", "c2", four.alias("t")).select("r2", "c2", "t.r", "t.c", "t.w").filter((F.col("r") >= 0) & (F.col("r") < h) & (F.col("c") >= 0) & (F.col("c") < w) & (F.col("w") != 0))


def warp(px: DataFrame, pull: Matrix, out_shape: tuple[int, int], in_shape: tuple[int, int], keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """Every frame on the output grid; NaN counts 0, a pixel wholly outside is 0."""
    w = F.broadcast(taps(px.sparkSession, pull, out_shape, in_shape))  # at most 4 x output pixels rows
    read = px.select(*keys, "r", "c", F.nanvl("x", F.lit(0.0)).alias("x")).join(w, ["r", "c"]).groupBy(*keys, "r2", "c2").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    inside = read.select(*keys, F.col("r2").alias("r"), F.col("c2").alias("c"), "x")
    # output pixels that read nothing
    covered = w.select("r2", "c2").distinct()
    grid = px.sparkSession.range(out_shape[0] * out_shape[1]).select(F.floor(F.col("id") / out_shape[1]).alias("r2"), F.pmod("id", F.lit(out_shape[1])).alias("c2"))
    empty = F.broadcast(grid.join(covered, ["r2", "c2"], "left_anti"))  # at most the output pixels
    rest = px.select(*keys).distinct().crossJoin(empty).select(*keys, F.col("r2").alias("r"), F.col("c2").alias("c"), F.lit(0.0).alias("x"))
    return inside.unionByName(rest)


def fold_weights(masks: DataFrame, pull: Matrix, out_shape: tuple[int, int], in_shape: tuple[int, int]) -> DataFrame:
    """(roi, r, c, w): the weight of each source pixel in a region of the output grid; summing x * w equals warping first. ``masks``: (roi, r, c)."""
    w = taps(masks.sparkSession, pull, out_shape, in_shape)
    m = masks.select("roi", F.col("r").alias("r2"), F.col("c").alias("c2"))
    return m.join(w, ["r2", "c2"]).groupBy("roi", "r", "c").agg(F.sum("w").alias("w"))


def moments(points: DataFrame) -> DataFrame:
    """The sums a similarity fit needs, from control points (src_r, src_c, ref_r, ref_c): one row."""
    sx, sy, rx, ry = F.col("src_c"), F.col("src_r"), F.col("ref_c"), F.col("ref_r")
    return points.agg(
        F.count(F.lit(1)).alias("n"), F.avg(sx).alias("msx"), F.avg(sy).alias("msy"), F.avg(rx).alias("mrx"), F.avg(ry).alias("mry"),
        F.covar_pop(rx, sx).alias("cxx"), F.covar_pop(rx, sy).alias("cxy"), F.covar_pop(ry, sx).alias("cyx"), F.covar_pop(ry, sy).alias("cyy"), (F.var_pop(sx) + F.var_pop(sy)).alias("var"),
    )


def fit_similarity(points: DataFrame, allow_reflection: bool = False) -> Matrix:
    """Least-squares similarity source -> reference from the moments; a mirror only where allowed."""
    m = moments(points).first()
    if m["n"] < 2:
        raise ValueError("at least two point pairs are needed")
    u, s, vt = np.linalg.svd(np.array([[m["cxx"], m["cxy"]], [m["cyx"], m["cyy"]]]))
    sign = -1.0 if np.linalg.det(u) * np.linalg.det(vt) < 0 and not allow_reflection else 1.0
    rot = u @ np.diag([1.0, sign]) @ vt
    scale = (s[0] + sign * s[1]) / max(m["var"], 1e-12)
    move = np.array([m["mrx"], m["mry"]]) - scale * rot @ np.array([m["msx"], m["msy"]])
    return tuple(tuple([*(scale * rot[i]).tolist(), float(move[i])]) for i in (0, 1))
