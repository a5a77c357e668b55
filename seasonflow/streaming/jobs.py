"""Two Structured Streaming jobs: opportunity files into the partitioned cache, requests into scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonflow.functions.core import written
from seasonflow.operators.metrics import calibrated
from seasonflow.operators.selection import validated
from seasonflow.sources.files import OPPS, combo_columns


PATTERN = ["combo", "symbol", "date", "days_out", "direction"]


def opps_stream(spark: SparkSession, path: str) -> DataFrame:
    """New opportunity files, typed and validated, with the time at which their file arrived."""
    df = spark.readStream.schema(OPPS).option("header", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).csv(path)
    df = df.select(
        "*", F.col("_metadata.file_modification_time").alias("arrived"),
        F.regexp_extract(F.col("_metadata.file_path"), r"combo=([^/]+)/", 1).alias("combo")
    )
    df = combo_columns(df).where("sym is not null and date is not null and daysOut > 0 and LorS in ('l', 's')")
    return df.select(
        "arrived", F.col("sym").alias("symbol"), "date", F.col("daysOut").alias("days_out"), F.col("LorS").alias("direction"), "combo",
        "sharpe_ratio", "avg_profit", F.coalesce("avg_profit2", "avg_profit").alias("avg_profit2")
    )


def add_new(batch: DataFrame, number: int, path: str, key: list[str], by: list[str], first: str) -> None:
    """Write those rows of a batch whose key no other batch has brought, into partitions of `by` and the batch's number.

    However long ago a key came, it isn't added again: the batch is held against what lies in the partitions that it
    touches, of which only the keys are read, so no state is kept and no watermark ends it. Of rows that share a key in
    the batch the one with the smallest `first` stays, then the smallest by its other columns. A batch owns its
    partitions and replaces them, leaving out its own earlier rows when it looks for known keys: tried again, even
    after it has failed halfway, it gives the same table. Keys have to hold the columns of `by`.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in key]
    order = [first, *[c for c in rest if c != first]]
    one = batch.groupBy(*key).agg(F.min(F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    one = written(one, "batch")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        # the partitions of a batch are folders to be listed anyway
        touched = one.select(*by).distinct().collect()
        there = spark.read.schema(T.StructType([*one.schema.fields, T.StructField("batch", T.LongType())])).parquet(path).where(F.col("batch") != number)
        for c in by:
            there = there.where(F.col(c).isin([r[c] for r in touched]))
        one = one.join(there.select(*key), key, "left_anti")
    out = one.withColumn("batch", F.lit(number).cast("long")).hint("rebalance", *[F.col(c) for c in by])
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path)


def ingest(df: DataFrame, path: str, checkpoint: str, by: list[str], key: list[str] = PATTERN, first: str = "arrived") -> None:
    """Add to the table at path what is there and new by its key, and stop; a later call goes on from the checkpoint."""
    write = lambda batch, number: add_new(batch, number, path, key, by, first)
    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scored_stream(requests: DataFrame, features: DataFrame, bins: DataFrame, tiers: list[str], out: str, checkpoint: str) -> None:
    """Requests joined with the static features and calibration; each batch gives scored and error rows.

    A batch owns the folder batch=<its id> and writes it whole: a batch that is tried again replaces its rows. Numbers are
    the checkpoint's, so the folder `out` belongs to one checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = validated(batch, tiers).withColumn("d", F.expr("try_to_date(date, 'yyyy-MM-dd')"))
        joined = checked.join(features.withColumnRenamed("symbol", "_s"), F.col("symbol") == F.col("_s"), "left").drop("_s")
        done = calibrated(joined, bins, "predicted")
        missing = F.when(F.col("error").isNull() & F.col("predicted").isNull(), "no features").otherwise(F.col("error"))
        done = done.withColumn("error", missing).withColumn("calibrated_score", F.when(F.col("error").isNull(), F.col("calibrated_score")))
        done.select("event_id", "symbol", "date", "days_out", "tier", "error", "calibrated_score").write.mode("overwrite").parquet(f"{out}/batch={number}")

    requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
