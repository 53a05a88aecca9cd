"""Joins and set operations: filling, anti and semi joins, intervals, as-of, one-to-one matching, replacing and resuming."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill_missing(left: DataFrame, cached: DataFrame, key: str, column: str) -> DataFrame:
    """`left` with null values of `column` taken from `cached`, which has one row per key; `filled` tells where. Values that are there stay."""
    right = cached.select(F.col(key), F.col(column).alias("__cached"))
    joined = left.join(right, key, "left")
    return joined.withColumn("filled", F.col(column).isNull() & F.col("__cached").isNotNull()).withColumn(column, F.coalesce(column, "__cached")).drop("__cached")


def redirected(rows: DataFrame, pairing: DataFrame, key: str, to: str) -> DataFrame:
    """`rows` with `target`: what `pairing` (key, to) redirects the key to, or the key itself."""
    return rows.join(pairing.groupBy(key).agg(F.min(to).alias("__to")), key, "left").withColumn("target", F.coalesce("__to", key)).drop("__to")


def missing(needed: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Rows of `needed` whose key isn't in `covered`. A null key is never covered."""
    return needed.join(covered.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def present(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in `others`, each once."""
    return rows.join(others.select(key), key, "left_semi")


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """`new`, and of `old` the rows of groups that `new` hasn't. Rows of `old` without group stay."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def resume(todo: DataFrame, done: DataFrame, key: str, compute) -> DataFrame:
    """`done`, and the result of `compute` on the rows of `todo` whose key isn't there yet."""
    return done.unionByName(compute(missing(todo, done, key)))


def overlapping(blocks: DataFrame, spans: DataFrame, key: str, index: str, start: str, end: str, low: str, high: str) -> DataFrame:
    """`spans` with first, last: [min, max + 1) of the indices of the key's blocks that overlap [low, high); (0, 0) if none does.

    Blocks and spans meet by key and by the buckets of 4,096 offsets that they touch, so that a key with very many blocks isn't compared with all of
    its spans.
    """
    width = 4096
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    ids = spans.withColumn("__id", F.struct(*spans.columns))
    s = ids.where(F.col(high) > F.col(low)).select("__id", F.col(key), F.col(low).alias("__low"), F.col(high).alias("__high"), bucket(F.col(low), F.col(high)).alias("__bucket"))
    b = blocks.where(F.col(end) > F.col(start)).select(F.col(key), F.col(index).alias("__i"), F.col(start).alias("__s"), F.col(end).alias("__e"), bucket(F.col(start), F.col(end)).alias("__bucket"))
    hit = s.join(b, [key, "__bucket"]).where("__s < __high and __e > __low").groupBy("__id").agg(F.min("__i").alias("first"), (F.max("__i") + 1).alias("last"))
    joined = ids.join(hit, "__id", "left")
    return joined.select(*spans.columns, F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("last", F.lit(0)).alias("last"))


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """`rows` with `value` of the key's latest mark at or before `at`, null if there is none. Marks: (key, at, value); of equal times the largest value counts.

    One union and one running fill over key and time instead of a range join; marks sort before rows of the same time.
    """
    from folioforge.operators.scan import forward_fill

    both = rows.withColumn("__mark", F.lit(1)).withColumn("__value", F.lit(None).cast(marks.schema[value].dataType)).unionByName(
        marks.select(key, at, F.col(value).alias("__value"), F.lit(0).alias("__mark")), allowMissingColumns=True
    )
    return forward_fill(both, key, [at, "__mark", "__value"], "__value", value).where("__mark = 1").drop("__mark", "__value")


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio of two strings, 0 if either is empty or null."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """similarity() of two columns."""
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def one_to_one(pairs: DataFrame, left: str, right: str, score: str, least: float = 0.55, rounds: int = 1000, lone: bool = False) -> DataFrame:
    """(left, right, score): the greedy matching - best pair first, ties by left and right, each side used once - of pairs that score at least `least`.

    With `lone`, a single left side and a single right side match whatever they score.

    A pair that is the best of both its sides is what the greedy order would take; so each round takes all of these at once and drops the sides they
    use. The result is the sequential one, without putting all pairs in order in one task.
    """
    from folioforge.session import written

    if lone and (only := pairs.select(left, right, score).dropna().limit(2).collect()) and len(only) == 1:
        return pairs.select(left, right, score).dropna()
    rest = written(pairs.select(left, right, score).where(F.col(score) >= least).dropna().distinct(), "pairs")
    best = F.struct(-F.col(score), F.col(left), F.col(right))
    out = None
    for _ in range(rounds):
        marked = rest.withColumn("__b", best)
        a = marked.groupBy(left).agg(F.min("__b").alias("__l"))
        b = marked.groupBy(right).agg(F.min("__b").alias("__r"))
        taken = written(marked.join(a, left).join(b, right).where("__b = __l and __b = __r").select(left, right, score), "taken")
        out = taken if out is None else out.unionByName(taken)
        if taken.isEmpty():
            return out
        rest = written(rest.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti").select(left, right, score), "pairs")
    raise RuntimeError("one_to_one: more rounds needed")


def matched_lines(lines: DataFrame, blocks: DataFrame, key: str, owner: str, text: str, least: int = 8) -> DataFrame:
    """(owner, n_lines, hits) of owners at least two of whose lines, and half of them, are texts of blocks of the same key. Lines shorter than `least` don't count."""
    long = lines.where(F.length(text) >= least).select(key, owner, text)
    n = long.groupBy(owner).agg(F.count(F.lit(1)).alias("n_lines"))
    hits = long.join(blocks.select(key, text).distinct(), [key, text], "left_semi").groupBy(owner).agg(F.count(F.lit(1)).alias("hits"))
    return n.join(hits, owner).where("hits >= greatest(2, n_lines * 0.5)")
