"""Column functions over text. All give null for null unless said otherwise; offsets are 0-based code points."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space, Unicode's included, so that Java, Python and RE2 agree.
WS = r"[\s\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The patterns that words, letters' outer lines, names, titles and senses are told by.
WORDISH = "[A-Za-z]+(?:[-'][A-Za-z]+)?"
BODY_WORD = "[A-Za-z][A-Za-z'’-]*"
OUTER_LINE = r"(?i)^\s*(Dear\b|To whom)|^\s*(Yours|Sincerely|Best wishes|Best regards|Regards|Faithfully)\b[,.\s]*$"
NAME_SIGNS = r"[^0-9A-Za-z_\-一-鿿]+"
TITLE_NOISE = r"[（）()【】\[\]{}_\-—–\s·、,，。.]+"
TITLE_ENDS = "试题卷?|试卷"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
BRACKETED = "[（(][^）)]*[）)]"
SENSE_SIGNS = "[\\s.,，、；;：:\\-—“”\"']"
TAG_SPLIT = r"[/、]|\s*&\s*"


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescaped(c: Column) -> Column:
    """HTML's entities, named and numbered, resolved. Only texts with an ampersand leave the JVM."""
    some = F.contains(c, F.lit("&"))
    return F.when(some, _unescaped(F.when(some, c))).otherwise(c)


def inline(c: Column) -> Column:
    """HTML entities resolved, no-break spaces plain, runs of blanks one, at most one empty line, stripped."""
    c = F.regexp_replace(F.replace(unescaped(c), F.lit("\u00a0"), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def wordish(c: Column) -> Column:
    """Number of Latin words; hyphens and apostrophes join."""
    return F.coalesce(F.regexp_count(c, F.lit(WORDISH)), F.lit(0))


def essay_words(c: Column) -> Column:
    """Words of a letter's body: lines of greeting and sign-off don't count."""
    body = F.filter(F.split(c, "\n"), lambda x: ~F.rlike(x, F.lit(OUTER_LINE)))
    return F.coalesce(F.regexp_count(F.array_join(body, "\n"), F.lit(BODY_WORD)), F.lit(0))


def token_estimate(c: Column) -> Column:
    """Tokens guessed from the length: 0 for empty and null, else a 2.6th of the characters, at least 1."""
    n = F.coalesce(F.length(c), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 2.6).cast("int")))


def safe_stem(c: Column, most: int = 80) -> Column:
    """A file name's stem as an identifier: extension off, white space to _, other signs out, cut; 'doc' if nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(c, r"(?<=.)\.[^.]*$", ""), f"{WS}+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(stem, NAME_SIGNS, ""), 1, most), F.lit("")), F.lit("doc"))


def safe_name(c: Column, most: int = 120) -> Column:
    """Like safe_stem without an extension; _ at the ends is taken off; 'item' if nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(c, f"{WS}+", "_"), NAME_SIGNS, ""), 1, most)
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit("item"))


def preview(c: Column, most: int) -> Column:
    """The first characters of the stripped text, with a note of how many are hidden."""
    s = strip(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, most), f"{WS}+$", ""), F.lit("\n... ["), (F.length(s) - most).cast("string"), F.lit(" more]")))


def sanitize(c: Column) -> Column:
    """Without control characters that XML forbids, ** and backticks, and # before headings."""
    c = F.regexp_replace(c, CONTROLS, "")
    return F.regexp_replace(F.regexp_replace(c, r"\*\*|`", ""), r"(?md)^#{1,6}[ \t]+", "")


def heading(c: Column) -> Column:
    """On one line, stripped."""
    return strip(F.regexp_replace(c, r"[\r\n]+", " "))


def title_key(c: Column, answer_words: str) -> Column:
    """What of a file name names the paper: without extension, words for answers, punctuation and words like 'paper' at the end."""
    stem = F.regexp_replace(F.regexp_replace(c, r"(?i)\.(docx|pdf)$", ""), answer_words, "")
    stem = F.regexp_replace(stem, TITLE_NOISE, "")
    return F.regexp_replace(stem, f"({TITLE_ENDS}|{answer_words}|版)+$", "")


def number_or_zero(c: Column) -> Column:
    """As a double, 0 where that fails."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def duration(seconds: Column) -> Column:
    """5s, 2m05s, 1h02m."""
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def contained(c: Column, tokens: list[str] | tuple[str, ...]) -> Column:
    """Those of `tokens` that the text contains, in their order; none for null."""
    return F.array_compact(F.array(*(F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in tokens)))


def senses(c: Column) -> Column:
    """A gloss split at ； ; ， , 、 outside brackets, each sense stripped, empty ones out."""
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(acc, ch):
        depth = F.when(ch.isin("（", "("), acc["depth"] + 1).when(ch.isin("）", ")"), F.greatest(F.lit(0), acc["depth"] - 1)).otherwise(acc["depth"])
        cut = (depth == 0) & ch.isin("；", ";", "，", ",", "、")
        last = F.element_at(acc["parts"], -1)
        parts = F.when(cut, F.concat(acc["parts"], F.array(F.lit("")))).otherwise(F.concat(F.slice(acc["parts"], 1, F.size(acc["parts"]) - 1), F.array(F.concat(last, ch))))
        return F.struct(depth.alias("depth"), parts.alias("parts"))

    found = F.aggregate(F.split(c, ""), start, step)["parts"]
    return F.filter(F.transform(found, strip), lambda x: x != "")


def sense_key(c: Column) -> Column:
    """What makes two senses the same: no bracketed notes, no white space or punctuation, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, BRACKETED, ""), SENSE_SIGNS, ""))


def merged_pos(values: Column) -> Column:
    """One tag list of an array of them: tags split at / 、 &, in order of first appearance, without those that begin or end another one."""
    tags = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(values, lambda v: F.split(v, TAG_SPLIT))), strip), lambda x: x != ""))
    keep = F.filter(tags, lambda t: ~F.exists(tags, lambda o: (o != t) & (F.startswith(o, t) | F.endswith(o, t))))
    return F.array_join(F.when(F.size(keep) > 0, keep).otherwise(tags), "/")


def filled(template: str, **fields: Column) -> Column:
    """The template with each {{NAME}} replaced by the field of that name, in the order given; null is empty."""
    c = F.lit(template)
    for name, value in fields.items():
        c = F.replace(c, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return c
