"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, share: int = 2000) -> DataFrame:
    """Inner join of `rows` with `table`, which has one row per key and in `count` how many of `rows` carry it.

    Keys that hold at least 1/`share` of `total` rows are answered from a broadcast table - by that bound it has no
    more than `share` rows - and never meet in one task; all other keys take an ordinary shuffle join. Every row
    takes exactly one of both ways. Rows with a null key, and keys missing in `table`, give no result. `count` is
    not part of the result.
    """
    least = max(1, total // share)
    hot = table.where(F.col(count) >= least).drop(count)
    cold = table.where(F.col(count) < least).drop(count)
    flagged = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(flagged.join(cold, keys))


def hash_sample(rows: DataFrame, keys: list[str], most: int, total: int | None = None) -> DataFrame:
    """About `most` different rows (by `keys`) of `rows`, the same at every run: those whose keys' hash is below a threshold. All of them if there are fewer.

    `total` is the number of rows, counted if not given. Only sampled rows leave their task; none of them meet in one.
    """
    total = rows.count() if total is None else total
    if total > most:
        rows = rows.where(F.xxhash64(*keys) < int((most / total - 0.5) * 2**64))
    return rows.dropDuplicates(keys)
