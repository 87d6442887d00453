"""Atlas building: surface projection of a label volume, region numbers, outlines, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def surface(voxels: DataFrame, member: str, by: tuple[str, ...] = ("ap", "ml"), depth: str = "dv", value: str = "idx") -> DataFrame:
    """The first member voxel going down each column: smallest depth, then smallest value; columns without one give 0."""
    first = F.min(F.when(F.expr(member), F.struct(depth, value)))
    return voxels.groupBy(*by).agg(first.alias("_f")).select(*by, F.coalesce(F.col(f"_f.{value}"), F.lit(0)).alias(value))


def region_ids(pixels: DataFrame, least: int = 1) -> DataFrame:
    """``pixels``: (key, label). Regions of at least ``least`` pixels numbered from 2 by falling size, equal sizes by first pixel; 1 is background."""
    sizes = pixels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).filter(F.col("n") >= least)
    return sizes.select("label", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) + 1).cast("long").alias("region_id"))  # a row per region


def in_subtree(structures: DataFrame, node: int | str) -> DataFrame:
    """Structures whose ``path`` runs through a node."""
    return structures.filter(F.col("path").contains(f"/{node}/"))


def without_layer(acronym):
    """An acronym without its closing layer number."""
    return F.regexp_replace(acronym, r"(1|2/3|4|5|6a|6b)$", "")


def resample(px: DataFrame, shape: tuple[int, int], to: tuple[int, int], flip: bool = False) -> DataFrame:
    """Nearest pixel int(i n / N); strides are exact where N divides n. One equi-join on pixel places; several output pixels may read one."""
    spark = px.sparkSession
    axis = lambda n, m, a, b: F.broadcast(spark.range(m).select(F.col("id").alias(b), F.floor(F.col("id") * n / m).cast("long").alias(a)))
    out = px.join(axis(shape[0], to[0], "r", "r2"), "r").join(axis(shape[1], to[1], "c", "c2"), "c").drop("r", "c").withColumnRenamed("r2", "r").withColumnRenamed("c2", "c")
    return out.withColumn("c", F.lit(to[1] - 1) - F.col("c")) if flip else out


def outline(labels: DataFrame) -> DataFrame:
    """Pixels of a label map (r, c, region_id) with a right or lower neighbour of another region."""
    n = labels.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("region_id").alias("_id"))
    move = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    near = labels.select("r", "c", "region_id", move.alias("_m")).select("r", "c", "region_id", (F.col("r") + F.col("_m.dr")).alias("_r"), (F.col("c") + F.col("_m.dc")).alias("_c"))
    return near.join(n, ["_r", "_c"]).filter("region_id <> _id").select("r", "c", "region_id").distinct()


def both_hemispheres(rois: DataFrame, width: int) -> DataFrame:
    """Right regions and their mirror images."""
    from . import roi

    return rois.unionByName(roi.contralateral(rois, width))
