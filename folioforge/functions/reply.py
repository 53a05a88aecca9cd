"""Model replies: JSON out of chatter, fences and cuts; vendors' usage records; retry and size arithmetic."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n?(.*?)\n?\s*```\s*$", re.S)


def complete_objects(text: str, name: str) -> list:
    """The complete objects at the start of the array `name` in text that may end anywhere."""
    at = re.search(rf'"{re.escape(name)}"\s*:\s*\[', text)
    out, decoder = [], json.JSONDecoder()
    if not at:
        return out
    i = at.end()
    while True:
        while i < len(text) and text[i] in " \t\r\n,":
            i += 1
        if i >= len(text) or text[i] != "{":
            return out
        try:
            value, i = decoder.raw_decode(text, i)
        except ValueError:
            return out
        out.append(value)


def parse_reply(text: str | None, array: str = "segments") -> dict:
    """{'json': value or None, 'how': 'whole' | 'outer' | 'salvaged' | 'raw', 'truncated': bool} of a reply.

    A code fence is taken off; then the whole is tried, then from the first { to the last }, then the complete objects of `array`.
    """
    body = (text or "").strip()
    m = _FENCE.match(body)
    body = m[1].strip() if m else body
    for how, part in (("whole", body), ("outer", body[body.find("{") : body.rfind("}") + 1] if "{" in body else "")):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        if isinstance(value, (dict, list)):
            return {"json": value, "how": how, "truncated": False}
    found = complete_objects(body, array)
    return {"json": {array: found} if found else None, "how": "salvaged" if found else "raw", "truncated": bool(found)}


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("how", T.StringType()), T.StructField("truncated", T.BooleanType())]))
def parsed_reply(texts: pd.Series) -> pd.DataFrame:
    """parse_reply of each text, the value as JSON text."""
    got = [parse_reply(t) for t in texts]
    return pd.DataFrame({"json": [None if g["json"] is None else json.dumps(g["json"], ensure_ascii=False, separators=(",", ":")) for g in got], "how": [g["how"] for g in got], "truncated": [g["truncated"] for g in got]})


def start_index(reply: Column, low: Column, high: Column, field: str = "start_block") -> Column:
    """The index that a reply names - in JSON, as field: n, or its first number - if it lies strictly between low and high, else null."""
    plain = F.regexp_replace(reply, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    n = F.coalesce(
        F.get_json_object(plain, f"$.{field}").try_cast("int"),
        F.nullif(F.regexp_extract(plain, rf"{field}\W{{0,4}}(\d+)", 1), F.lit("")).try_cast("int"),
        F.when(~F.contains(plain, F.lit("null")), F.nullif(F.regexp_extract(plain, r"(\d+)", 1), F.lit("")).try_cast("int")),
    )
    return F.when((n > low) & (n < high), n)


def usage_record(usage: Column) -> Column:
    """One shape for the usage records (JSON text) of three kinds of vendor: prompt, hit, miss, output, reasoning. Absent numbers are 0; miss is at least 0."""
    get = lambda *paths: F.coalesce(*(F.get_json_object(usage, f"$.{p}").try_cast("long") for p in paths), F.lit(0))
    hit = get("prompt_cache_hit_tokens", "prompt_tokens_details.cached_tokens", "cache_read_input_tokens")
    fresh, made = get("input_tokens"), get("cache_creation_input_tokens")
    prompt = F.coalesce(F.get_json_object(usage, "$.prompt_tokens").try_cast("long"), fresh + made + get("cache_read_input_tokens"))
    miss = F.coalesce(F.get_json_object(usage, "$.prompt_cache_miss_tokens").try_cast("long"), F.greatest(prompt - hit, F.lit(0)))
    return F.struct(prompt.alias("prompt"), hit.alias("hit"), miss.alias("miss"), get("completion_tokens", "output_tokens").alias("output"), get("completion_tokens_details.reasoning_tokens").alias("reasoning"))


def retriable(status: Column) -> Column:
    """Whether a failed call may be tried again: no status, 408, 409, 425, 429, or 500 and above."""
    return status.isNull() | status.isin(408, 409, 425, 429) | (status >= 500)


def retry_delay(attempt: Column, after: Column) -> Column:
    """Seconds before the next attempt: what the server asks for up to 90, else 2^(attempt - 1) up to 60; jitter is the caller's."""
    return F.coalesce(F.when(after.isNotNull(), F.least(after, F.lit(90.0))), F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(60.0)))


def output_cap(base: Column, deepest: Column, most: Column) -> Column:
    """Tokens a reply may take: base up to the model's most; three times that, up to 64,000, at the deepest effort. A null or zero base stays."""
    return F.when(base.isNull() | (base == 0), base).when(deepest, F.least(base * 3, F.lit(64000), most)).otherwise(F.least(base, most))


def conversation_budget(window: Column, most: Column, share: Column) -> Column:
    """Tokens a conversation may take: a share of the window less the room for a reply, at least 8,000."""
    return F.greatest(F.floor(window * share).cast("int") - F.least(most, F.lit(64000)), F.lit(8000))


def pruned(record: Column, keep: list[str]) -> Column:
    """A map with only the keys to keep that it has."""
    return F.map_filter(record, lambda k, _: k.isin(*keep))


def idea(piece: Column, name: str = "ideas") -> Column:
    """One object, as JSON text, of `{name: [x]}`, `{name: x}` or x itself; null for anything else."""
    inner = F.coalesce(F.get_json_object(piece, f"$.{name}[0]"), F.get_json_object(piece, f"$.{name}"), piece)
    return F.when(F.rlike(inner, F.lit(r"^\s*\{")), inner)


def progress(line: Column) -> Column:
    """The share done that a log line like `(3/18)` tells, at most 1; null without one or of nothing."""
    done, all_ = (F.nullif(F.regexp_extract(line, r"\((\d+)/(\d+)\)", k), F.lit("")).try_cast("double") for k in (1, 2))
    return F.when(all_ > 0, F.least(done / all_, F.lit(1.0)))


def reordered(children: Column, order: list[str]) -> Column:
    """An array of names in a fixed order, stable; names that aren't in the order come last."""
    ranks = F.array(*map(F.lit, order))
    rank = lambda x: F.coalesce(F.nullif(F.array_position(ranks, x), F.lit(0)), F.lit(len(order) + 1))
    return F.transform(F.array_sort(F.transform(children, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x.alias("x")))), lambda s: s["x"])


def explanation_lines(questions: Column) -> Column:
    """Text of ARRAY<STRUCT<number, answer, reason, notes ARRAY<STRING>>>: `21. B`, the reason, and a line for each note; empty parts are left out."""

    def one(q: Column) -> Column:
        head = F.concat_ws(". ", q["number"].cast("string"), F.when(q["answer"] != "", q["answer"]))
        notes = F.when(F.size(q["notes"]) > 0, F.array_join(F.transform(q["notes"], lambda n: F.concat(F.lit("- "), n)), "\n"))
        return F.concat_ws("\n", head, F.when(q["reason"] != "", q["reason"]), notes)

    return F.array_join(F.transform(questions, one), "\n")


# The fields of a score, of an analysis (scalars and lists), and the marks that selection weighs.
_WHO = ("item_id", "source_doc", "section", "item_label")
_TOPIC, _WHY = ("topic", "topic_category"), ("selection_reason", "classroom_suggestion")
_MARKS = ("novelty_score", "difficulty_score", "vocabulary_value_score", "grammar_value_score", "exam_value_score")
_SCORED = (*_TOPIC, *_MARKS, "writing_angle_novelty_score", "recommendation_score", "best_fit_selection_bucket", "score_summary", *_WHY)
_ANALYSED = (*_TOPIC, *_MARKS, "recommendation_score", "best_fit_selection_bucket", *_WHY)
_LISTS = (
    "core_high_frequency_words", "familiar_words_new_meanings", "difficult_or_low_frequency_words", "topic_words", "word_formation_and_grammar", "long_difficult_sentences", "exam_skills", "main_difficulty_sources",
)


def _flat(rows: DataFrame, record: str, own: tuple[str, ...], told: tuple[str, ...]) -> list[Column]:
    """Columns `own`, from the row or else the JSON object in `record`, and `told` from the object; absent and null ones are ''. Anything but an object tells nothing."""
    fields = F.from_json(rows[record], "map<string,string>")
    get = lambda name: F.try_element_at(fields, F.lit(name))
    has = lambda name: rows[name].cast("string") if name in rows.columns else F.lit(None).cast("string")
    return [*(F.coalesce(has(c), get(c), F.lit("")).alias(c) for c in own), *(F.coalesce(get(c), F.lit("")).alias(c) for c in told)]


def _score_columns(rows: DataFrame, score: str) -> list[Column]:
    who = _flat(rows, score, _WHO, _SCORED)
    shown = F.coalesce(rows["display_section"], F.lit("")) if "display_section" in rows.columns else F.lit("")
    return [*who[:3], shown.alias("display_section"), *who[3:]]


def flat_score(rows: DataFrame, score: str = "score") -> DataFrame:
    """The 18 columns of a scored item: who it is, its display name, and the fields of the JSON object in `score`; blanks for what is missing."""
    return rows.select(*_score_columns(rows, score))


def flat_analysis(rows: DataFrame, analysis: str = "analysis") -> DataFrame:
    """The 15 scalars of an older analysis and its 8 lists as JSON text; blanks for what is missing."""
    return rows.select(*_flat(rows, analysis, _WHO, (*_ANALYSED, *_LISTS)))


def shortlist_row(rows: DataFrame, score: str = "score", local: str = "selection_score") -> DataFrame:
    """What a shortlist tells of each item: flat_score with the section by its display name, if it has one, and the score the selection gave."""
    kept = rows.select(*_score_columns(rows, score), F.coalesce(rows[local].cast("string"), F.lit("")).alias("local_selection_score"))
    return kept.withColumn("section", F.coalesce(F.nullif("display_section", F.lit("")), "section")).drop("display_section")


def row_mode(mode: Column, item: Column, modes: tuple[str, str]) -> Column:
    """Which of two modes, (by item, by paper), made a row: what it says, or else its shape: rows by item name one."""
    return F.when(mode.isin(*modes), mode).when(F.coalesce(item, F.lit("")) != "", F.lit(modes[0])).otherwise(F.lit(modes[1]))
