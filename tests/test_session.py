"""Shared folder, sampling, streams with late rows."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from folioforge import session
from folioforge.operators.skew import hash_sample
from folioforge.streaming import ledger


def test_a_cluster_without_a_shared_folder_is_an_error():
    unset = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(spark)


def test_written_tables_can_be_dropped(spark):
    import os

    t = session.written(spark.range(5).withColumnRenamed("id", "n"))
    path = t._folioforge_path
    assert t.count() == 5 and os.path.exists(path)
    session.dropped(t)
    assert not os.path.exists(path)


def test_hash_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.lit("x" * 10).alias("t")).unionByName(spark.range(9000).select(F.lit(7).cast("long").alias("k"), F.lit("y").alias("t")))
    got = [sorted(r.k for r in hash_sample(rows, ["k"], 4000, 29_000).collect()) for _ in range(2)]
    assert got[0] == got[1] and len(set(got[0])) == len(got[0]) and 500 < len(got[0]) < 900
    assert hash_sample(rows, ["k"], 50_000).count() == 5000 and hash_sample(rows.where("false"), ["k"], 10).count() == 0


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    parts = [[(day(1, 5), "a", 1.0), (day(2, 9), "a", 2.0)], [(day(1, 6), "a", 8.0), (day(2, 8), "a", 4.0), (day(4, 1), "b", 5.0)]]
    source = str(tmp_path / "in")
    for rows in parts:
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(source)
        got = ledger.finish(ledger.windowed(ledger.stream(spark, source, df.schema), "1 hour"), "append", str(tmp_path / "out"))
    # the row of the first day came after its window was closed; the last window is still open
    assert sorted((r.start.day, r.event_type, r.n, r.value) for r in got.collect()) == [(1, "a", 1, 1.0), (2, "a", 2, 6.0)]
