"""Channels on disk: pixel rows (ch, t, r, c, x) in Parquet folders of a channel and a stretch of time, so a query of one channel or a
few frames opens only their files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames of a channel in one folder.
STRETCH = 4096


def write(rows: DataFrame, path: str) -> None:
    """``rows``: (ch, t, r, c, x). A folder's rows come from one shuffle by its key."""
    rows = rows.select(*(F.col(c).cast(k).alias(c) for c, k in (("ch", "long"), ("t", "long"), ("r", "long"), ("c", "long"), ("x", "int"))))
    rows = rows.withColumn("stretch", F.floor(F.col("t") / STRETCH).cast("long"))
    rows.repartition("ch", "stretch").write.mode("overwrite").partitionBy("ch", "stretch").parquet(path)


def read(spark: SparkSession, path: str, schema: str = "t long, r long, c long, x int, ch long, stretch long") -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def channel(rows: DataFrame, ch: int, lo: int = 0, hi: int | None = None) -> DataFrame:
    """(t, r, c, x) of one channel's frames [lo, hi): both conditions also choose folders."""
    out = rows.filter((F.col("ch") == ch) & (F.col("t") >= lo) & (F.col("stretch") >= lo // STRETCH))
    if hi is not None:
        out = out.filter((F.col("t") < hi) & (F.col("stretch") <= max(hi - 1, 0) // STRETCH))
    return out.drop("ch", "stretch")


def mean_image(spark: SparkSession, rows: DataFrame, means: str, ch: int) -> DataFrame:
    """(r, c, mean) of a channel: the stored one where there is one, else from its rows."""
    try:
        stored = spark.read.parquet(means).filter(F.col("ch") == ch).select("r", "c", "mean")
        if not stored.isEmpty():
            return stored
    except AnalysisException:
        pass
    return channel(rows, ch).groupBy("r", "c").agg(F.avg("x").alias("mean"))
