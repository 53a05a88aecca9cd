"""Streaming queries, with batch SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.plans.catalogue import query, table
from folioforge.session import shared_dir
from folioforge.streaming import ledger


def _run(spark, d, name, make, mode):
    """The table as a one-file or one-folder stream source."""
    schema = table(spark, d, name).schema
    folder = f"{d}/{name}.parquet" if "," not in d else d
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    one = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    source = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d) if one else ledger.stream(spark, folder, schema)
    return ledger.finish(make(source), mode, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


@query("SELECT stage, model, count(*) AS calls, sum(coalesce(cache_hit, 0)) AS cached, sum(coalesce(completion_tokens, 0)) AS output FROM usage_ledger GROUP BY ALL")
def stream_usage(spark, d):
    return _run(spark, d, "usage_ledger", lambda s: ledger.usage_totals(s).select("stage", "model", "calls", "cached", "output"), "complete")


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events
GROUP BY ALL HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_daily_events(spark, d):
    """The days that the watermark, an hour behind the latest event, has closed."""
    found = _run(spark, d, "events", lambda s: ledger.windowed(s, "1 hour"), "append")
    return found.withColumn("value", F.round("value", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))
