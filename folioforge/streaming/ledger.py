"""The usage ledger and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.summary import usage_by


def stream(spark: SparkSession, folder: str, schema, files: int = 8) -> DataFrame:
    """The Parquet files that arrive in a folder, at most `files` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def usage_totals(ledger: DataFrame) -> DataFrame:
    """Running usage by stage and model; the state holds one row for each."""
    return usage_by(ledger, "stage", "model")


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, event_type, n, value) by tumbling windows of `ts`; events that come more than `late` behind are dropped, and a window's state with them."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = at.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def finish(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is there, to its end, and return the table it left in `folder`, which executors write and read.

    mode 'append' writes each window once, when the watermark has passed it; 'complete' replaces the table with every trigger.
    """
    spark, out = df.sparkSession, f"{folder}/table"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
