"""Running values along a key's rows that stay balanced when one key holds a large share of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.session import written


def _carried(rows: DataFrame, key: str, order: list[str], local, left, over, out: str, combine) -> DataFrame:
    """Range-partitions by key and order, computes `local` in each partition, and combines it with what earlier partitions of the same key left.

    local: column over a window of one partition and key. left: what a partition leaves for its last key, an aggregate. over: how what is left adds up
    over a run of partitions of one key, given a column and a window. The table handed on has one row for each partition.
    """
    cut = written(rows.repartitionByRange(F.col(key), *(F.col(c) for c in order)).withColumn("__p", F.spark_partition_id()), "ranged")
    done = cut.withColumn(out, local(Window.partitionBy("__p", key).orderBy(*order)))
    ends = cut.groupBy("__p").agg(F.max_by(F.struct(F.col(key).alias("k")), F.struct(F.col(key).isNotNull().alias("some"), F.col(key))).alias("last"))
    tails = cut.join(F.broadcast(ends), "__p").where(F.col(key).eqNullSafe(F.col("last.k"))).groupBy("__p").agg(F.first("last.k").alias("__k"), left.alias("m"))
    every = Window.orderBy("__p")
    runs = tails.withColumn("n", F.row_number().over(every)).withColumn("new", F.when((F.col("n") > 1) & F.col("__k").eqNullSafe(F.lag("__k").over(every)), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(every.rowsBetween(Window.unboundedPreceding, 0)))
    sofar = over("m", Window.partitionBy("run").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
    carry = runs.withColumn("__m", sofar).withColumn("__next", F.lead("__p").over(every)).select("__next", "__k", "__m")
    joined = done.join(F.broadcast(carry), (F.col("__p") == F.col("__next")) & F.col(key).eqNullSafe(F.col("__k")), "left")
    return joined.withColumn(out, combine(F.col(out), F.col("__m"))).select(*rows.columns, out)


def forward_fill(rows: DataFrame, key: str, order: list[str], mark: str, out: str, before: bool = False) -> DataFrame:
    """`rows` with `out`: the last non-null `mark` of the key at or before the row in `order` - before it only, with `before` -, null if there is none.

    A window over the key would put a hot key into one task. Here rows are range-partitioned by key and order, so that such a key spans many
    partitions; each is filled by itself, and what it leaves for its last key is handed on in a table of one row for each partition.
    Ties of the order are taken as they come within a partition: make it full. Null keys are one key.
    """
    local = lambda w: F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    left = F.max_by(mark, F.when(F.col(mark).isNotNull(), F.struct(*order)))
    return _carried(rows, key, order, local, left, lambda m, w: F.last(m, ignorenulls=True).over(w), out, F.coalesce)


def row_numbers(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """`rows` with `out`: their place among the rows of the key in `order`, from 1; hot keys span partitions as in forward_fill."""
    local = lambda w: F.row_number().over(w)
    return _carried(rows, key, order, local, F.count(F.lit(1)), lambda m, w: F.sum(m).over(w), out, lambda n, m: n + F.coalesce(m, F.lit(0)))


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """`rows` with `out`: the sum of `value` over the rows of the key before this one in `order`, 0 for the first; hot keys span partitions as in forward_fill."""
    n = F.coalesce(F.col(value), F.lit(0))
    local = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _carried(rows, key, order, local, F.sum(n), lambda m, w: F.sum(m).over(w), out, lambda a, m: a + F.coalesce(m, F.lit(0)))
