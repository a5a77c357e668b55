"""The cache of candidates: what is missing, short or changed is written, the rest stays."""

import glob
import os

from pyspark.sql import functions as F

from seasonflow.sources import files as fl


def stamp(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/market=*/target_date=*/*.parquet")}


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [(m, d, k, float(k)) for m in ("US", "ETF") for d in ("2000-01-01", "2000-01-02") for k in range(20)]
    df = spark.createDataFrame(rows, "market string, target_date string, k int, x double")
    fl.write_cache(df, path)
    first = stamp(path)
    fl.write_cache(df, path)
    assert stamp(path) == first
    # as many rows, one of them other
    changed = df.withColumn("x", F.when((F.col("market") == "US") & (F.col("target_date") == "2000-01-02") & (F.col("k") == 3), 9.5).otherwise(F.col("x")))
    fl.write_cache(changed, path)
    now = stamp(path)
    assert {os.path.dirname(f) for f in set(now) ^ set(first)} == {f"{path}/market=US/target_date=2000-01-02"}
    read = lambda: sorted((r.market, str(r.target_date), r.k, r.x) for r in spark.read.parquet(path).collect())
    assert read() == sorted(map(tuple, changed.select("market", "target_date", "k", "x").collect()))
    # a row twice in place of another
    twice = changed.where("not (market = 'ETF' and k = 1 and target_date = '2000-01-01')").unionByName(changed.where("market = 'ETF' and k = 2 and target_date = '2000-01-01'"))
    fl.write_cache(twice, path)
    assert read() == sorted(map(tuple, twice.select("market", "target_date", "k", "x").collect()))
    # another column
    wider = twice.withColumn("y", F.lit(1))
    fl.write_cache(wider, path)
    assert spark.read.parquet(path).where("y = 1").count() == 80
    fl.write_cache(wider.limit(0), path)
    assert spark.read.parquet(path).count() == 80
