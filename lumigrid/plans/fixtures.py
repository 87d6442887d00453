"""Views of the driver's tables in the shape of recordings, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CYCLE = 4
ROIS = [("A_R", 6, 2, 3), ("A_L", 1, 2, 3), ("B_R", 5, 5, 4), ("B_L", 2, 5, 4), ("EDGE", 0, 7, 5)]
EDITS = [(100, 400, 1), (300, None, 2), (-5, 50, -1)]
PULL = ((0.9, -0.1, 0.5), (0.1, 0.9, -0.3))
GRID = (12, 12)
SHAPE = (8, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 frames: (g, file_idx, p, r, c, x)."""
    px = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("g"), F.posexplode("embedding").alias("p", "v"))
    p = F.col("p").cast("long")
    return px.select("g", F.floor(F.col("g") / 50).alias("file_idx"), p.alias("p"), F.floor(p / 8).alias("r"), (p % 8).alias("c"), F.rint(1000 + 400 * F.col("v").cast("double")).alias("x"))


def channels(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """The same frames dealt to n channels: (ch, t, p, r, c, x)."""
    return frame(spark, sf_dir).select(F.pmod("g", F.lit(n)).alias("ch"), F.floor(F.col("g") / n).alias("t"), "p", "r", "c", "x")


def mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame-mean series: (g, file_idx, m), a file per day."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("g"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("file_idx"), F.col("value").alias("m"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean(spark, sf_dir).groupBy("file_idx").agg(F.count(F.lit(1)).alias("n"))


def rois(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROIS, "name string, x long, y long, size long")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region per supplier: a right one, a left one or one of neither side."""
    k = F.col("s_suppkey")
    side = F.when(k % 3 == 0, "_R").when(k % 3 == 1, "_L").otherwise("")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), k.cast("string"), side).alias("name"), (F.col("s_nationkey") % 8).cast("long").alias("x"), (k % 8).cast("long").alias("y"), (k % 6 + 1).cast("long").alias("size"))


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces per key: (k, t, s, d)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long").alias("t"), F.col("l_extendedprice").alias("s"), F.col("l_quantity").alias("d"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    r, c = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    return s.select(F.col("s_suppkey").alias("i"), r.alias("src_r"), c.alias("src_c"), (2 * r + 3 * c - 7).alias("ref_r"), (2 * c - 3 * r + 11).alias("ref_c"))


FRAME = "frame as (select vec_id g, cast(vec_id // 50 as bigint) file_idx, cast(p as bigint) p, cast(p // 8 as bigint) r, cast(p % 8 as bigint) c, round_even(1000 + 400 * cast(embedding[p + 1] as double), 0) x from embeddings, (select unnest(range(64)) p))"
CHANNELS = FRAME + ", chan as (select g % 2 ch, g // 2 t, p, r, c, x from frame)"
MEAN = "mean as (select event_id g, cast(date_diff('day', timestamp '2024-01-01', ts) as bigint) file_idx, value m from events)"
FILES = MEAN + ", files as (select file_idx, count(*) n from mean group by 1)"
ROI = "roi as (select * from (values ('A_R', 6, 2, 3), ('A_L', 1, 2, 3), ('B_R', 5, 5, 4), ('B_L', 2, 5, 4), ('EDGE', 0, 7, 5)) t(name, x, y, size))"
MASK = ROI + ", mask as (select name roi, cast(r as bigint) r, cast(c as bigint) c from roi, (select unnest(range(8)) r), (select unnest(range(8)) c) where (r - y) * (r - y) + (c - x) * (c - x) <= greatest(size / 2.0, 0.5) * greatest(size / 2.0, 0.5))"
SPOTS = "roi as (select 'S' || s_suppkey || case s_suppkey % 3 when 0 then '_R' when 1 then '_L' else '' end as \"name\", s_nationkey % 8 x, s_suppkey % 8 y, s_suppkey % 6 + 1 size from supplier)"
SPOT_MASK = SPOTS + ", mask as (select name roi, cast(r as bigint) r, cast(c as bigint) c from roi, (select unnest(range(8)) r), (select unnest(range(8)) c) where (r - y) * (r - y) + (c - x) * (c - x) <= greatest(size / 2.0, 0.5) * greatest(size / 2.0, 0.5))"
BULK = "bulk as (select l_suppkey k, cast(date_diff('day', timestamp '1992-01-01', l_shipdate) as bigint) t, l_extendedprice s, l_quantity d from lineitem)"
TAPS = (
    "place as (select r2, c2, 0.9::double * c2 - 0.1::double * r2 + 0.5::double x, 0.1::double * c2 + 0.9::double * r2 - 0.3::double y from (select unnest(range(12)) r2), (select unnest(range(12)) c2)), "
    "taps as (select r2, c2, cast(floor(y) as bigint) + j r, cast(floor(x) as bigint) + i c, (case when j = 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case when i = 1 then x - floor(x) else 1 - (x - floor(x)) end) w "
    "from place, (select unnest([0, 1]) j), (select unnest([0, 1]) i)), tap as (select * from taps where r between 0 and 7 and c between 0 and 7 and w <> 0)"
)
POINTS = "points as (select s_suppkey i, s_acctbal src_r, cast(s_nationkey as double) src_c, 2 * s_acctbal + 3 * s_nationkey - 7 ref_r, 2 * s_nationkey - 3 * s_acctbal + 11 ref_c from supplier)"
