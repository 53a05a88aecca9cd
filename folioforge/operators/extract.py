"""Tables out of text: answers, runs, stems, tokens, tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import strip
from folioforge.rules import DEFAULT, RulePack

# How answer keys write ranges, single answers, words and runs of answers.
_RANGES = [r"(\d+)\s*[-—]\s*(\d+)\s*[.．]?\s*([A-G]+)", r"(\d+)\s*~\s*(\d+)\s*[.．]?\s*([A-G]+)", r"(\d+)\s*--\s*(\d+)\s*[.．]?\s*([A-G]+)"]
_SINGLE = r"(?U)(?<!\d)(\d+)\s*[.．]\s*([A-G])\b(?!\s*[.．])"
_WORDS = r"(5[6-9]|6[0-5])\s*[.．]\s*([^\n]+?)(?=\s*(?:5[6-9]|6[0-5])\s*[.．]|$)"
_TOKEN = r"(5[6-9]|6[0-5])\s*[.．]\s*(\S+)"
_GLUED = r"(?<!\d)(5[6-9]|6[0-5])\s*\."
_RUN = r"(?m)^\s*(\d{1,2})\s*[-—~－–]+\s*(\d{1,2})\s*[.．、:：]?\s*([A-G]{2,})(?=$|[^0-9A-Za-z_一-鿿])"

# What marks one question's explanation, and what a sheet for students must not hold.
EXPLAINED = r"【\d+题详解】"
FORBIDDEN = {"source": r"来源[：:]", "explanation": r"【导语】|【\d+题详解】|【详解】", "model essay": r"参考范文|One possible version", "markdown": r"\*\*"}


def _groups(text: Column, pattern: str, n: int) -> Column:
    """Array of structs _1.._n of the groups of all matches."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"_{k}") for k in range(1, n + 1)))


def answer_letters(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, answer): letters of ranges like `21-23 BDC` and singles like `21. B`.

    For a number named twice the first counts: ranges before singles, ranges with - or — before ~ before --, and within these the order of the
    text. Letters beyond a range are dropped, a short run fills its first numbers. Numbers too large for an int, null and empty texts
    give no row.
    """
    def told(rank: int, pattern: str) -> Column:
        single = pattern == _SINGLE
        one = lambda m, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), m["_1"].try_cast("int").alias("first"), m["_1" if single else "_2"].try_cast("int").alias("last"), m["_2" if single else "_3"].alias("letters"))
        return F.transform(_groups(docs[text], pattern, 2 if single else 3), one)

    every = [told(k, p) for k, p in enumerate([*_RANGES, _SINGLE])]
    each = docs.select(docs[key].alias(key), F.explode(F.concat(*every)).alias("m")).select(key, "m.*")
    size = F.least(F.length("letters"), F.col("last") - F.col("first") + 1)
    one = each.withColumn("size", size).where("size > 0").withColumn("off", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    one = one.select(key, "rank", "pos", "off", (F.col("first") + F.col("off")).alias("number"), F.substring("letters", F.col("off") + 1, F.lit(1)).alias("answer"))
    return one.groupBy(key, "number").agg(F.min_by("answer", F.struct("rank", "pos", "off")).alias("answer"))


def answer_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, answer): words for the numbers 56 to 65, also where they are glued to the next number; the first of a number counts.

    An answer ends at the next number or with the text. A number that has none so - its line ends before either - takes the token after it. Signs at an answer's end are
    taken off; of a token nothing may be left.
    """
    spaced = F.regexp_replace(docs[text], _GLUED, " $1. ")
    told = lambda c, pattern, rank: F.transform(_groups(c, pattern, 2), lambda m, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), m["_1"].cast("int").alias("number"), F.regexp_replace(strip(m["_2"]), r"[.,;，。；、]+$", "").alias("answer")))
    words = F.filter(told(spaced, _WORDS, 0), lambda m: m["answer"] != "")
    found = docs.select(docs[key].alias(key), F.explode(F.concat(words, told(docs[text], _TOKEN, 1))).alias("m")).select(key, "m.*")
    return found.groupBy(key, "number").agg(F.min_by("answer", F.struct("rank", "pos")).alias("answer"))


def all_answers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, answer): letters, overridden by words where both name a number."""
    both = answer_letters(docs, key, text).withColumn("rank", F.lit(1)).unionByName(answer_words(docs, key, text).withColumn("rank", F.lit(0)))
    return both.groupBy(key, "number").agg(F.min_by("answer", "rank").alias("answer"))


def valid_runs(text: Column) -> Column:
    """ARRAY<STRUCT<first, last, letters>>: runs at the start of a line with exactly one letter for each number."""
    found = F.transform(_groups(text, _RUN, 3), lambda m: F.struct(m["_1"].cast("int").alias("first"), m["_2"].cast("int").alias("last"), m["_3"].alias("letters")))
    return F.filter(found, lambda m: (m["last"] > m["first"]) & (F.length(m["letters"]) == m["last"] - m["first"] + 1))


def answer_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run, first, last, letters): the valid runs of each row's text; run counts from 1."""
    found = docs.select(docs[key].alias(key), F.posexplode(valid_runs(docs[text])).alias("pos", "m"))
    return found.select(key, (F.col("pos") + 1).alias("run"), "m.first", "m.last", "m.letters")


def answer_leaks(text: Column) -> Column:
    """ARRAY<STRING>: what in a question's text gives answers away: 'key 21-23 CBC' for the first valid run, 'explained' for a question's explanation. Null gives none."""
    run = F.get(valid_runs(text), F.lit(0))
    key = F.when(run.isNotNull(), F.concat(F.lit("key "), run["first"].cast("string"), F.lit("-"), run["last"].cast("string"), F.lit(" "), run["letters"]))
    return F.array_compact(F.array(key, F.when(F.rlike(text, F.lit(EXPLAINED)), F.lit("explained"))))


def forbidden(text: Column) -> Column:
    """ARRAY<STRING>: what a finished sheet for students must not hold: FORBIDDEN by name, then answer_leaks. Null gives none."""
    return F.concat(F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(p)), F.lit(n)) for n, p in FORBIDDEN.items()))), answer_leaks(text))


def assert_clean(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`docs`, if no text holds anything forbidden; else an error that names the first such row met and what it holds. It is raised where the rows are read."""
    found = forbidden(docs[text])
    said = F.concat(F.lit("not clean: "), docs[key].cast("string"), F.lit(": "), F.array_join(found, ", "))
    return docs.where(F.when(F.size(found) == 0, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def missing_stems(items: DataFrame, rules: RulePack = DEFAULT) -> DataFrame:
    """(item_id, number): question numbers of the item's section without a line `N.` in its text; only sections with numbers. Null texts miss all."""
    ranges = F.create_map(*(x for s, (a, b) in rules.ranges.items() if s.startswith("reading") for x in (F.lit(s), F.transform(F.sequence(F.lit(a), F.lit(b)), lambda n: n.cast("string")))))
    stems = F.coalesce(F.regexp_extract_all(items["text"], F.lit(r"(?m)^[ \t　]*(\d+)[.．、]"), F.lit(1)), F.array().cast("array<string>"))
    return items.select("item_id", F.explode(F.array_except(F.element_at(ranges, items["section"]), stems)).alias("n")).select("item_id", F.col("n").cast("int").alias("number"))


def table_cells(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, col, cell): cells of HTML tables, stripped, in document order from 0; cells with markup keep its text."""
    rows = docs.select(docs[key].alias(key), F.posexplode(F.regexp_extract_all(docs[html], F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    cells = rows.select(key, "row", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col", "c"))
    return cells.select(key, "row", "col", F.trim(F.regexp_replace("c", "<[^>]*>", "")).alias("cell"))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, end, stripped): lines with their offsets; the newline belongs to none. Null texts give no row, empty ones one.

    One pass without a shuffle, linear in the text, so texts of any length and repeated keys are no trouble.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, number, start, end, stripped = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                pos = 0
                for k, line in enumerate(t.split("\n") if t is not None else ()):
                    at.append(i)
                    number.append(k)
                    start.append(pos)
                    end.append(pos + len(line))
                    stripped.append(line.strip())
                    pos += len(line) + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int32()) for c in (number, start, end)), pa.array(stripped, pa.string())], names=["key", "line", "start", "end", "stripped"])

    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(run, f"key {kind}, line int, start int, end int, stripped string").withColumnRenamed("key", key)
