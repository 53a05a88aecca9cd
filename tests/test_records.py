"""Gates, chunks, projections, recognised order, fallbacks: nulls, empties, ties, clashing names."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioforge.functions import reply, text
from folioforge.operators import extract, rank, scan, segment, summary
from folioforge.sources import files


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_entities(spark):
    assert one(spark, text.unescaped, "&hellip;&#20320;&#x4f60;&lt;b&gt; &amp;amp; R&D") == "…你你<b> &amp; R&D"
    assert one(spark, text.unescaped, None) is None and one(spark, text.unescaped, "") == "" and one(spark, text.unescaped, "plain") == "plain"


def test_word_answers_at_a_lines_end(spark):
    said = "56. marking\n57. has been\n\nThe rest. 58. ;"
    got = {r.number: r.answer for r in extract.answer_words(spark.createDataFrame([(1, said)], "k int, t string"), "k", "t").collect()}
    assert got == {56: "marking", 57: "has", 58: ""}


def test_gate(spark):
    df = spark.createDataFrame([("a", "A plain text."), ("b", None), ("c", "")], "k string, t string")
    assert extract.assert_clean(df, "k", "t").count() == 3
    bad = df.unionByName(spark.createDataFrame([("z", "来源：x\n21—23. CBC\n【21题详解】")], "k string, t string"))
    assert bad.where("k = 'z'").select(extract.forbidden(F.col("t")).alias("f")).first().f == ["source", "explanation", "key 21-23 CBC", "explained"]
    with pytest.raises(Exception, match="not clean: z: source"):
        extract.assert_clean(bad, "k", "t").collect()
    assert one(spark, extract.answer_leaks, "21—23. CB\nIn 21-23 it was") == []


def test_chunks_of_a_budget(spark):
    f = lambda t, budget, least: one(spark, lambda c: segment.token_chunks(c, budget, least, F.length), t)
    assert f(None, 10, 1) is None and f(" \n ", 10, 1) == [] and f(" short ", 10, 1) == ["short"]
    assert one(spark, lambda c: segment.token_chunks(c, 10), None) is None
    assert f("aaaa\n\nbbbb\n \ncc", 10, 1) == ["aaaa", "bbbb", "cc"] and f("aaaa\n\nbbbb\n \ncc", 11, 6) == ["aaaa", "bbbb\n\ncc"]
    assert f("a long line\nsecond one\n\nx", 20, 5) == ["a long line", "second one", "x"]  # lines are never split


def test_recognised_order(spark):
    block = lambda label, order, said: {"block_label": label, "block_order": order, "block_content": said}
    page = lambda *bs: {"prunedResult": {"parsing_res_list": list(bs)}}
    body = lambda *pages: json.dumps({"result": {"layoutParsingResults": list(pages)}})
    rows = [
        ("d", 0, body(page(block("text", 3, "a"), block("footer", None, "f"), block("table", None, "b"), block("text", 4, "c")), page())),
        ("d", 1, body(page(block(None, None, "x"), block("table", None, None), block("text", 1, "y"), block("text", 1, "z")))),
        ("e", 0, "no json"),
    ]
    got = files.recognised_blocks(spark.createDataFrame(rows, "doc string, line int, body string")).orderBy("place", "seq").collect()
    assert [(r.place, r.text) for r in got] == [(6, "a"), (7, "b"), (8, "c"), (20001, "x"), (20002, ""), (20002, "y"), (20002, "z")]
    assert got[3].label == "text"


def test_running_sum_over_a_hot_key(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.lit(2).alias("v")).unionByName(spark.createDataFrame([("b", 1, None), ("b", 2, 5), ("b", 3, 1)], "k string, o long, v int"))
    got = {(r.k, r.o): r.s for r in scan.running_sum(rows.repartition(7), "k", ["o"], "v", "s").collect()}
    assert got["hot", 2999] == 2 * 2999 and [got["b", k] for k in (1, 2, 3)] == [0, 0, 5]


def test_projections(spark):
    rows = [("i", None, '{"topic": "t", "section": "cloze", "exam_value_score": 7, "item_id": "no"}', '{"topic_words": ["a"], "exam_skills": "read"}'), ("j", "Shown", "text", None)]
    df = spark.createDataFrame(rows, "item_id string, display_section string, score string, analysis string").withColumn("topic", F.lit("clash")).withColumn("selection_score", F.lit(1.5))
    flat = reply.flat_score(df).orderBy("item_id").collect()
    assert len(flat[0]) == 18 and (flat[0].item_id, flat[0].topic, flat[0].section, flat[0].exam_value_score, flat[0].display_section) == ("i", "t", "cloze", "7", "")
    assert {v for k, v in flat[1].asDict().items()} == {"j", "Shown", ""}
    old = reply.flat_analysis(df).orderBy("item_id").collect()
    assert len(old[0]) == 23 and (old[0].topic_words, old[0].exam_skills, old[1].topic_words) == ('["a"]', "read", "")
    short = reply.shortlist_row(df).orderBy("item_id").collect()
    assert len(short[0]) == 18 and (short[0].section, short[1].section, short[0].local_selection_score) == ("cloze", "Shown", "1.5")
    assert reply.flat_score(df.where("false")).count() == 0


def test_selection_score(spark):
    df = spark.createDataFrame([("reading_a", "2"), ("grammar", "x"), (None, "3"), ("other", None)], "s string, m string")
    marks = {k: F.col("m") for k in ("novelty", "difficulty", "vocabulary", "grammar", "exam", "writing", "recommendation")}
    assert [r.x for r in df.select(rank.selection_score(F.col("s"), marks).alias("x")).collect()] == [12.0, 0.0, 12.0, 0.0]


def test_usage_without_a_ledger(spark):
    ledger = spark.createDataFrame([("score", "m", 10, 4, None, 1, 2.0)], "stage string, model string, prompt_tokens long, cache_hit long, cache_miss long, completion_tokens long, seconds double")
    replies = spark.createDataFrame([("score", "m", '{"prompt_tokens": 5, "completion_tokens": 2}'), (None, "", '{"prompt_tokens": 1}'), ("score", "m", None), ("score", "m", "broken")], "stage string, model string, usage string")
    assert [(r.calls, r.fresh) for r in summary.usage_or_older(ledger, replies).collect()] == [(1, 6)]
    got = sorted((r.stage, r.model, r.calls, r.fresh, r.output) for r in summary.usage_or_older(ledger.where("false"), replies).collect())
    assert got == [("?", "?", 1, 1, 0), ("score", "m", 1, 5, 2)]


def test_undefined(spark):
    used = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b"), ("e", "a"), ("d", None)], "k string, n string")
    assert sorted(map(tuple, summary.undefined(used, spark.createDataFrame([("d", "a")], "k string, n string"), "k", "n").collect())) == [("d", "b"), ("e", "a")]


def test_row_mode(spark):
    df = spark.createDataFrame([("whole", "i"), ("odd", "i"), (None, ""), ("", None)], "m string, i string")
    assert [r.x for r in df.select(reply.row_mode(F.col("m"), F.col("i"), ("chunked", "whole")).alias("x")).collect()] == ["whole", "chunked", "whole", "whole"]
