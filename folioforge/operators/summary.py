"""Aggregations: usage, medians, deduplication and merging of entries, coverage, grading, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.reply import usage_record
from folioforge.functions.text import contained, merged_pos, sense_key, senses, strip
from folioforge.rules import DEFAULT, RulePack


def usage_by(ledger: DataFrame, *keys: str) -> DataFrame:
    """Calls, cached, fresh and output tokens, and seconds of each key. Nulls count as 0; fresh is what isn't cached, at least 0."""
    prompt, hit = (F.coalesce(c, F.lit(0)) for c in ("prompt_tokens", "cache_hit"))
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(hit).alias("cached"),
        F.sum(F.coalesce("cache_miss", F.greatest(prompt - hit, F.lit(0)))).alias("fresh"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("output"),
        F.sum(F.coalesce("seconds", F.lit(0.0))).alias("seconds"),
    )


def usage_or_older(ledger: DataFrame, replies: DataFrame, keys: tuple[str, ...] = ("stage", "model"), default: str = "?") -> DataFrame:
    """usage_by over the ledger, or, where it has no line, over what older runs kept: replies (stage, model, usage) with the vendor's usage record as JSON text.

    Null keys are `default`; replies without a usage object are left out.
    """
    named = [F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(default)).alias(k) for k in keys]
    if ledger.limit(1).count():
        return usage_by(ledger.select(*named, *(c for c in ledger.columns if c not in keys)), *keys)
    u = replies.where(F.rlike("usage", F.lit(r"^\s*\{"))).select(*named, usage_record(F.col("usage")).alias("u"))
    old = u.select(*keys, F.col("u.prompt").alias("prompt_tokens"), F.col("u.hit").alias("cache_hit"), F.col("u.miss").alias("cache_miss"), F.col("u.output").alias("completion_tokens"), F.lit(0.0).alias("seconds"))
    return usage_by(old, *keys)


def undefined(used: DataFrame, defined: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): names that a key uses and doesn't define, once each; null names use nothing."""
    return used.where(F.col(name).isNotNull()).select(key, name).distinct().join(defined.select(key, name).distinct(), [key, name], "left_anti")


def written_once(ledger: DataFrame, seq: str = "seq") -> DataFrame:
    """The ledger without lines that repeat another but for their sequence number; the smallest stays."""
    return ledger.groupBy(*(c for c in ledger.columns if c != seq)).agg(F.min(seq).alias(seq))


def hit_rate(ledger: DataFrame) -> DataFrame:
    """Calls, prompt and cached tokens, and the share of cached ones (0 without prompts)."""
    g = ledger.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt"), F.coalesce(F.sum("cache_hit"), F.lit(0)).alias("cached"))
    return g.withColumn("rate", F.coalesce(F.try_divide("cached", "prompt"), F.lit(0.0)))


def median_of_last(samples: DataFrame, keys: list[str], order: str, value: str, last: int = 20) -> DataFrame:
    """(keys, n, median) of each key's last positive values in order.

    row_number() <= n lets the optimiser cut each task's rows to the last ones before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return samples.where(F.col(value) > 0).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= last).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by `order` of each key, keys compared without letter case and white space around; rows without a full key are out."""
    named = {k: F.lower(strip(F.coalesce(F.col(k), F.lit("")))) for k in keys}
    marked = rows
    for i, k in enumerate(keys):
        marked = marked.withColumn(f"__k{i}", named[k]).where(F.col(f"__k{i}") != "")
    best = marked.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return best.select("r.*")


def merged_entries(rows: DataFrame, word: str, pos: str, meaning: str, order: str) -> DataFrame:
    """(key, word, pos, meaning, n): one row for each word, letter case apart: its first spelling, the union of its tags, and its senses.

    Senses are in order of first appearance; of the same sense the longest wording stays, the earlier one among equals; they are joined by ；. Senses
    are merged by sense before anything is gathered, so what is gathered for a word are its different senses and tags only. Words without text are out.
    """
    base = rows.select(strip(F.coalesce(word, F.lit(""))).alias("word"), F.coalesce(pos, F.lit("")).alias("pos"), F.coalesce(meaning, F.lit("")).alias("meaning"), F.col(order).alias("ord")).where("word <> ''").withColumn("key", F.lower("word"))
    words = base.groupBy("key").agg(F.min_by("word", "ord").alias("word"), F.count(F.lit(1)).alias("n"))
    tags = base.groupBy("key", "pos").agg(F.min("ord").alias("ord")).groupBy("key").agg(merged_pos(F.transform(F.sort_array(F.collect_list(F.struct("ord", "pos"))), lambda x: x["pos"])).alias("pos"))
    each = base.groupBy("key", "meaning").agg(F.min("ord").alias("ord")).select("key", "ord", F.posexplode(senses(F.col("meaning"))).alias("i", "sense")).withColumn("k", sense_key(F.col("sense")))
    one = each.groupBy("key", "k").agg(F.min(F.struct("ord", "i")).alias("at"), F.max_by("sense", F.struct(F.length("sense"), -F.col("ord"), -F.col("i"))).alias("sense"))
    joined = one.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "sense"))), lambda x: x["sense"]), "；").alias("meaning"))
    return words.join(tags, "key").join(joined, "key", "left").select("key", "word", "pos", F.coalesce("meaning", F.lit("")).alias("meaning"), "n")


def coverage(items: DataFrame, key: str, section: str, rules: RulePack = DEFAULT) -> DataFrame:
    """(key, n_<section> ...): how many items of each section a key has, for the pack's sections."""
    return items.groupBy(key).pivot(section, list(rules.order)).agg(F.count(F.lit(1))).na.fill(0)


def graded(items: DataFrame, key: str = "source_doc", section: str = "section", text: str = "text", rules: RulePack = DEFAULT) -> DataFrame:
    """(key, n, missing, duplicates, issues, grade) of each document by its sections.

    issues counts items whose text is shorter or longer than the pack allows or holds one of its leak tokens. FAIL: no item of a known section, or three or more sections
    missing that aren't optional; WARN: one missing, fewer than 8 or more than 12 items, a duplicate or an issue; else PASS.
    """
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    bad = (n < rules.least_chars) | (n > rules.most_chars) | (F.size(contained(F.coalesce(F.col(text), F.lit("")), rules.leak_tokens)) > 0)
    by = items.where(F.col(key).isNotNull()).groupBy(key, section).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("issues"))
    known = F.col(section).isin(*rules.order)
    docs = by.groupBy(key).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_set(F.when(known, F.col(section)))).alias("have"), F.count_if(known & (F.col("n") > 1)).alias("duplicates"), F.sum("issues").alias("issues"),
    )
    lacking = F.array_except(F.array(*(F.lit(s) for s in rules.order)), F.col("have"))
    critical = F.size(F.filter(lacking, lambda s: ~s.isin(*rules.optional)))
    grade = F.when((F.size("have") == 0) | (critical >= 3), "FAIL").when((critical > 0) | (F.col("n") < 8) | (F.col("n") > 12) | (F.col("duplicates") > 0) | (F.col("issues") > 0), "WARN").otherwise("PASS")
    return docs.select(key, "n", F.array_join(lacking, ",").alias("missing"), "duplicates", "issues", grade.alias("grade"))


def unpaired(starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has."""
    one = starts.select(key).distinct().join(ends.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("start"))
    return one.unionByName(ends.select(key).distinct().join(starts.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("end")))
