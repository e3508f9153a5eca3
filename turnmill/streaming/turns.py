"""Extras outside the blueprint's scope: the same measures over streams of turns, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text as T


def stream_parquet(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def running_lengths(turns: DataFrame) -> DataFrame:
    """Turns and words per conversation so far (update or complete mode)."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(T.word_count(F.col("text"))).alias("words"))


def event_windows(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", *by: str) -> DataFrame:
    """Counts in tumbling windows; events later than the watermark are dropped by the engine."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def resume_batch(path: str, key: str = "generation_idx"):
    """foreachBatch sink that appends only keys the target lacks, so a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        new = batch.dropDuplicates([key])
        if there:
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return write
