"""Ranking, shortlists and ordered output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import number_or_zero


def top_of(rows: DataFrame, group: str, by: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank. `by` must order rows of a group fully. The optimiser cuts each task's rows to n before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("rank") <= n)


# What each mark weighs in the selection, by section; None stands for any other section.
WEIGHTS: dict[str | None, dict[str, float]] = {
    "reading_a": {"novelty": 3, "recommendation": 1.5, "exam": 1, "vocabulary": 0.5},
    "reading_b": {"difficulty": 3, "exam": 1.5, "vocabulary": 1, "grammar": 0.5},
    "reading_c": {"difficulty": 2, "novelty": 2, "exam": 1, "grammar": 0.5},
    "reading_d": {"difficulty": 2, "novelty": 2, "exam": 1, "grammar": 0.5},
    "gap_filling": {"novelty": 2, "exam": 1.5, "difficulty": 1, "recommendation": 1},
    "cloze": {"novelty": 2, "exam": 1.5, "difficulty": 1, "recommendation": 1},
    "grammar": {"grammar": 2, "novelty": 1.5, "exam": 1, "difficulty": 0.5},
    "practical_writing": {"writing": 2, "novelty": 1.5, "exam": 1, "recommendation": 1},
    "continuation_writing": {"writing": 2, "novelty": 1.5, "exam": 1, "recommendation": 1},
    None: {"recommendation": 1, "novelty": 1, "difficulty": 1, "exam": 1},
}


def selection_score(section: Column, marks: dict[str, Column], weights: dict[str | None, dict[str, float]] = WEIGHTS) -> Column:
    """The weighted sum of an item's marks by its section. marks: name to column, of any type; what is no number counts as 0."""
    number = {k: number_or_zero(c) for k, c in marks.items()}
    total = lambda w: sum((number[k] * F.lit(float(v)) for k, v in w.items()), F.lit(0.0))
    out = F.when(F.lit(False), F.lit(0.0))
    for name, w in weights.items():
        if name is not None:
            out = out.when(section == name, total(w))
    return out.otherwise(total(weights[None]))


def keep_some(rows: DataFrame, group: str, good: Column) -> DataFrame:
    """Rows that are good, and all rows of groups that have no good one."""
    has = rows.groupBy(group).agg(F.max(F.coalesce(good, F.lit(False))).alias("__some"))
    joined = rows.join(has, rows[group].eqNullSafe(has[group]), "left").drop(has[group])
    return joined.where(F.coalesce(good, F.lit(False)) | ~F.col("__some")).drop("__some")


def picked_first(shortlist: DataFrame, picks: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows of each group's shortlist (column rank): first those that were picked, in the order of `picks` (key, pick), then the others by rank."""
    joined = shortlist.join(picks.groupBy(key).agg(F.min("pick").alias("pick")), key, "left")
    w = Window.partitionBy(group).orderBy(F.col("pick").asc_nulls_last(), "rank")
    return joined.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def outline(rows: DataFrame, section: str, order: list[str]) -> DataFrame:
    """`rows` with ordinal, from 1 over the whole order, and opens: whether the section differs from the row before.

    The ordinal over all rows needs no single task: rows are range-partitioned by the order, ranked within their partition, and shifted by the sizes of the
    partitions before, of which there are few.
    """
    from folioforge.session import written

    sorted_ = rows.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy(*order)
    local = written(sorted_.withColumn("__r", F.row_number().over(w)).withColumn("__before", F.lag(F.coalesce(section, F.lit(""))).over(w)).withColumn("__last", F.lead(F.lit(1)).over(w).isNull()), "outline")
    parts = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.coalesce(section, F.lit("")), "__r").alias("__end"))
    all_ = Window.orderBy("__p")  # one row for each partition
    shift = parts.withColumn("__shift", F.coalesce(F.sum("__n").over(all_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__prev", F.lag("__end").over(all_)).select("__p", "__shift", "__prev")
    joined = local.join(F.broadcast(shift), "__p")
    before = F.when(F.col("__r") == 1, F.col("__prev")).otherwise(F.col("__before"))
    return joined.withColumn("ordinal", F.col("__r") + F.col("__shift")).withColumn("opens", before.isNull() | (before != F.coalesce(section, F.lit("")))).select(*rows.columns, "ordinal", "opens")
