"""From the text of papers to their sections: starts, order, slices, answers, index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import strip
from folioforge.operators.extract import all_answers, lines
from folioforge.operators.segment import in_order, packed, slices
from folioforge.operators.scan import forward_fill
from folioforge.rules import DEFAULT, RulePack


def section_of(name: Column, rules: RulePack = DEFAULT) -> Column:
    """A section's own name for any name it goes by - an alias as it is written, its own in any case -, else 'unknown', also for null."""
    own = F.create_map(*(x for s in rules.order for x in (F.lit(s), F.lit(s))))
    alias = F.create_map(*(F.lit(x) for pair in rules.aliases.items() for x in pair))
    name = F.trim(name)
    return F.coalesce(F.element_at(alias, name), F.element_at(own, F.lower(name)), F.lit("unknown"))


def opened(line: Column, rules: RulePack = DEFAULT) -> Column:
    """The first section, in the pack's order, that a line opens; null if none."""
    c = None
    for s in rules.order:
        hit = F.rlike(line, F.lit("(?i)" + rules.openings[s]))
        c = F.when(hit, s) if c is None else c.when(hit, s)
    return c


def section_starts(docs: DataFrame, key: str, text: str, rules: RulePack = DEFAULT) -> DataFrame:
    """(key, pos, section, line): every line that opens a section, with its offset; one section a line."""
    each = lines(docs, key, text)
    return each.withColumn("section", opened(F.col("stripped"), rules)).where("section is not null").select(key, F.col("start").cast("long").alias("pos"), "section", F.col("stripped").alias("line"))


def segments(docs: DataFrame, key: str, text: str, rules: RulePack = DEFAULT, least: int = 80) -> DataFrame:
    """(item_id, key, section, pos, slice_end, char_count, body): the longest run of sections in the pack's order, each up to the next; slices under `least` characters are out.

    item_id is the key, the section and a running number of two digits. Texts without a start, null and empty ones give no row; keys must be unique.
    """
    starts = section_starts(docs, key, text, rules)
    first = starts.groupBy(key, "pos").agg(F.min("section").alias("section"))
    kept = in_order(first, key, "pos", "section", rules)
    ends = docs.select(docs[key], docs[text].alias("__text"), F.length(docs[text]).alias("__n"))
    cut = slices(kept.join(ends, key), key, "pos", "__n")
    body = strip(F.expr("substring(__text, cast(pos + 1 as int), cast(slice_end - pos as int))"))
    sized = cut.withColumn("body", body).withColumn("char_count", F.length("body")).where(F.col("char_count") >= least)
    n = F.row_number().over(Window.partitionBy(key, "section").orderBy("pos"))
    return sized.select(F.format_string("%s__%s__%02d", F.col(key).cast("string"), F.col("section"), n).alias("item_id"), key, "section", "pos", F.col("slice_end").cast("long").alias("slice_end"), "char_count", "body")


def with_answers(segs: DataFrame, tails: DataFrame, key: str, tail: str, rules: RulePack = DEFAULT) -> DataFrame:
    """`segs` with answers ARRAY<STRUCT<number, answer>> and answer_count: the answers in the tail of the same key within the section's numbers, in order; [] without any."""
    found = all_answers(tails, key, tail)
    sections = [(s, a, b) for s, (a, b) in rules.ranges.items()]
    section = None
    for s, a, b in sections:
        hit = F.col("number").between(a, b)
        section = F.when(hit, s) if section is None else section.when(hit, s)
    by = found.withColumn("section", section).where("section is not null").groupBy(key, "section").agg(F.sort_array(F.collect_list(F.struct("number", "answer"))).alias("answers"))
    none = F.array().cast("array<struct<number:int,answer:string>>")
    return segs.join(by, [key, "section"], "left").withColumn("answers", F.coalesce("answers", none)).withColumn("answer_count", F.size("answers"))


def rough_units(docs: DataFrame, key: str, text: str, most: int = 6500, least: int = 200) -> DataFrame:
    """(key, unit, body): the plain way: each text packed into chunks of `most` characters, those under `least` left out, numbered from 1."""
    each = docs.select(docs[key], F.posexplode(packed(docs[text], most)).alias("i", "body")).where(F.length("body") >= least)
    return each.select(key, F.row_number().over(Window.partitionBy(key).orderBy("i")).alias("unit"), "body")


def answer_text(answers: Column, fallback: str = "") -> Column:
    """`21: B; 22: D` of an array of (number, answer); the fallback for null and []."""
    return F.when(F.coalesce(F.size(answers), F.lit(0)) > 0, F.array_join(F.transform(answers, lambda x: F.concat_ws(": ", x["number"].cast("string"), x["answer"])), "; ")).otherwise(fallback)


def first_text(*columns: Column) -> Column:
    """The first column that isn't blank; null if all are."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


def between(text: Column, start: str, end: str, stops: list[str]) -> Column:
    """What follows a marker up to another one or the end, cut at the earliest of the stop words after its first character; null without the marker."""
    at = F.position(F.lit(start), text)
    body = F.when(at > 0, F.substring(text, at + len(start), F.length(text)))
    cuts = [F.nullif(F.position(F.lit(s), body), F.lit(0)) for s in (end, *stops)]
    cuts = [F.when(c > 1, c) for c in cuts]
    stop = F.least(*cuts, F.lit(None).cast("int"))
    return F.trim(F.when(stop.isNull(), body).otherwise(F.substring(body, F.lit(1), stop - 1)))


def above_junk(blocks: DataFrame, key: str, order: str, text: str, cuts: DataFrame, at: str, junk: str) -> DataFrame:
    """`cuts` (key, at) moved up over blank and junk lines: the row after the last line before `at` that is neither; 0 if there is none."""
    good = blocks.where(~F.coalesce(F.rlike(text, F.lit(junk)) | (F.trim(text) == ""), F.lit(True))).select(key, F.col(order).alias("__o"))
    marks = good.select(key, F.col("__o").cast("long").alias("__pos"), F.lit(1).alias("__kind"), F.col("__o").cast("long").alias("__mark"))
    asked = cuts.select(key, F.col(at).cast("long").alias("__pos"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("__mark")).distinct()
    filled = forward_fill(marks.unionByName(asked), key, ["__pos", "__kind"], "__mark", "__last").where("__kind = 0")
    kind = cuts.schema[at].dataType
    return filled.select(key, F.col("__pos").cast(kind).alias(at), F.coalesce(F.col("__last") + 1, F.lit(0)).cast("int").alias("moved"))


def body_text(spans: DataFrame, blocks: DataFrame, key: str, index: str, text: str, low: str, high: str, order: str, width: int = 64) -> DataFrame:
    """`spans` with body: the texts of the key's blocks with low <= index < high in order, joined by newlines; '' for none.

    Spans meet blocks by buckets of `width` indices, so that a key with very many of both isn't joined all with all. The blocks of a span are gathered, which is what a segment is.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    s = spans.select(key, low, high).distinct().where(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high) - 1))))
    told = blocks.select(key, F.col(index).alias("__i"), F.col(order).alias("__o"), F.col(text).alias("__t")).withColumn("__b", bucket(F.col("__i")))
    hit = s.join(told, [key, "__b"]).where((F.col("__i") >= F.col(low)) & (F.col("__i") < F.col(high)))
    body = hit.groupBy(key, low, high).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__o", "__t"))), lambda x: x["__t"]), "\n").alias("body"))
    return spans.join(body, [key, low, high], "left").withColumn("body", F.coalesce("body", F.lit("")))
