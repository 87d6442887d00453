"""Content checks: do a file's channels look like the same channels elsewhere?"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decompose


def normalise(px: DataFrame) -> DataFrame:
    """Each frame to mean 0 and population deviation 1 (a flat one to 0), then each pixel to mean 0 over frames."""
    frame = px.groupBy("g").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    z = px.join(frame, "g").select("g", "p", ((F.col("x") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("z"))
    return z.join(z.groupBy("p").agg(F.avg("z").alias("_m")), "p").select("g", "p", (F.col("z") - F.col("_m")).alias("z"))


def embed(px: DataFrame) -> DataFrame:
    """(g, e1, e2): the first two principal scores of the normalised frames."""
    r = decompose.pca(normalise(px).withColumnRenamed("z", "x"), 2)
    if not len(r.singular):  # no variance: all frames are alike
        return px.select("g", F.lit(0.0).alias("e1"), F.lit(0.0).alias("e2")).distinct()
    r.spatial.drop()
    first, last = float(r.singular[0]), float(r.singular[-1])
    return r.temporal.rows().select(F.col("id").alias("g"), (F.element_at("v", 1) * first).alias("e1"), (F.element_at("v", -1) * last).alias("e2"))


def clusters(embedding: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Adds ``cluster``."""
    data = embedding.withColumn("features", array_to_vector(F.array(F.col("e1").cast("double"), F.col("e2").cast("double"))))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select(*embedding.columns, F.col("prediction").alias("cluster"))


def consistency(labelled: DataFrame, least: float = 0.8) -> DataFrame:
    """``labelled``: (file_idx, ch, cluster) per frame. Per file and channel the share in the channel's home cluster, and whether it's too small.

    Home is the cluster with most of the channel's frames (the smallest of equals). Counts only: (files x channels x clusters) rows.
    """
    counts = labelled.groupBy("file_idx", "ch", "cluster").count()
    total = counts.groupBy("ch", "cluster").agg(F.sum("count").alias("n"))
    home = total.groupBy("ch").agg(F.max(F.struct("n", (-F.col("cluster")).alias("minus"))).alias("h")).select("ch", (-F.col("h.minus")).alias("home"))
    shares = counts.join(F.broadcast(home), "ch").groupBy("file_idx", "ch").agg((F.sum(F.when(F.col("cluster") == F.col("home"), F.col("count")).otherwise(0)) / F.sum("count")).alias("share"))
    return shares.select("file_idx", "ch", "share", (F.col("share") < least).alias("flagged"))


def separable(labelled: DataFrame) -> bool:
    """Every channel has a home of its own."""
    total = labelled.groupBy("ch", "cluster").count()
    home = total.groupBy("ch").agg(F.max(F.struct("count", (-F.col("cluster")).alias("minus"))).alias("h"))
    n, homes = home.agg(F.count(F.lit(1)), F.countDistinct("h.minus")).first()
    return n >= 2 and n == homes


