"""The live folds agree with a batch over the same frames."""

import datetime

from pyspark.sql import functions as F

from lumigrid.streaming import live


def test_rolling_fold_and_gaps(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    rows = [("a", g, at(g if g < 100 else g + 200), [float(g % 3), float(g % 3) + 2]) for g in range(200)] + [("a", 10**6, at(100_000), [0.0])]
    frames = spark.createDataFrame(rows, "recording string, g long, ts timestamp, pix array<double>")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    for name, plan in (("fold", live.rolling_fold(live.frame_means(stream), 3)), ("gaps", live.gaps(live.frame_means(stream)))):
        q = plan.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    folds = spark.table("fold").groupBy("phase").agg(F.sum("n").alias("n"), F.max("mean").alias("m")).collect()
    assert {r.phase: (r.n, r.m) for r in folds} == {0: (67, 1.0), 1: (67, 2.0), 2: (66, 3.0)}
    assert sorted(r.n for r in spark.table("gaps").collect()) == [100, 100]
