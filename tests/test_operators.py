"""Operators on small fixtures: formats, ties, nulls, empty tables, clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import reply, text
from folioforge.operators import extract, graph, rank, relate, segment, skew, summary


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def answers(spark, f, t):
    return {r.number: r.answer for r in f(docs(spark, t), "id", "text").collect()}


@pytest.mark.parametrize(
    "t, some",
    [
        ("21-23 BDC 24-27 CCBA 28-31 CBCB 32-35 ADBD 36-40 BEGAC", {21: "B", 23: "C", 27: "A", 37: "E", 40: "C"}),
        ("21—23. BDB 24—27. ACBA 28—31. CDAB 32—35 CACC 36—40. DBCAG", {21: "B", 32: "C", 40: "G"}),
        ("21~23DBC 24—27 CADA", {21: "D", 24: "C", 27: "A"}),
        ("41--45. DADBA 46—50. ABBCD 51—55. BCABD", {41: "D", 45: "A", 55: "D"}),
        ("21. B 22. D 23. C", {21: "B", 22: "D", 23: "C"}),
        ("21-23 ABC\n21-23 DEF", {21: "A", 22: "B", 23: "C"}),
    ],
)
def test_answer_letters(spark, t, some):
    assert some.items() <= answers(spark, extract.answer_letters, t).items()


def test_answer_words(spark):
    assert answers(spark, extract.answer_words, "56. marking 57. shows 58. impressive 59. a 60. to enhance")[60] == "to enhance"
    got = answers(spark, extract.answer_words, "56. would spark57. playfully58.with59. and 60. Driven")
    assert got[56] == "would spark" and got[58] == "with"
    assert answers(spark, extract.all_answers, "56. that/which 57. B")[56] == "that/which"
    assert answers(spark, extract.answer_letters, "") == {} and answers(spark, extract.answer_words, None) == {}


def test_runs_need_one_letter_for_each_number(spark):
    assert rows(extract.answer_runs(docs(spark, "21-23 BD\n24—27. ACBA\npages 5-7 ABC\n28-29 AB词", None), "id", "text")) == [(0, 1, 24, 27, "ACBA")]


def test_lines(spark):
    assert rows(extract.lines(docs(spark, "a\n b\n", "", None), "id", "text")) == [(0, 0, 0, 1, "a"), (0, 1, 2, 4, "b"), (0, 2, 5, 5, ""), (1, 0, 0, 0, "")]
    long = "x\n" * 200_000
    assert extract.lines(docs(spark, long), "id", "text").agg(F.max("end")).first()[0] == len(long)


def test_boundary(spark):
    got = docs(spark, "a 参考答案 b 答案", "none", "", None).select("id", segment.earliest(F.col("text"), [("参考答案", 0.0), ("答案", 0.5)]).alias("at"))
    assert rows(got) == [(0, 2), (1, None), (2, None), (3, None)]


def test_packing_matches_a_loop(spark):
    rng = random.Random(1)
    texts = ["\n".join("x" * rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", "x" * 200]

    def loop(t, most):
        out, cur, n = [], [], 0
        for line in (x.strip() for x in t.split("\n")):
            if not line:
                continue
            if cur and n + len(line) > most:
                out.append("\n".join(cur))
                cur, n = [], 0
            cur.append(line)
            n += len(line) + 1
        return out + (["\n".join(cur)] if cur else [])

    got = {r.id: r.p for r in docs(spark, *texts).select("id", segment.packed(F.col("text"), 50).alias("p")).collect()}
    assert got == {i: loop(t, 50) for i, t in enumerate(texts)}


def test_longest_order(spark):
    s = ["reading_a", "cloze", "reading_b", "reading_c", "nonsense", "reading_a", "grammar"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(s)], "doc string, pos int, section string")
    assert [r[2] for r in sorted(segment.in_order(df, "doc", "pos", "section").collect(), key=lambda r: r[1])] == ["reading_a", "reading_b", "reading_c", "grammar"]
    assert segment.in_order(df.where("false"), "doc", "pos", "section").count() == 0
    from itertools import combinations

    from folioforge.rules import DEFAULT

    rng = random.Random(9)
    data = [(f"d{d}", p, rng.choice(DEFAULT.order)) for d in range(15) for p in range(rng.randint(1, 9))]
    got = {}
    for r in segment.in_order(spark.createDataFrame(data, "doc string, pos int, section string"), "doc", "pos", "section").collect():
        got.setdefault(r.doc, []).append((r.pos, r.section))
    for d in {x[0] for x in data}:
        own = [x[1:] for x in data if x[0] == d]
        rising = [c for k in range(1, len(own) + 1) for c in combinations(own, k) if all(DEFAULT.rank(a[1]) < DEFAULT.rank(b[1]) for a, b in zip(c, c[1:]))]
        best = max(map(len, rising))
        mine = tuple(sorted(got[d]))
        assert mine in rising and len(mine) == best and mine[-1][0] == min(c[-1][0] for c in rising if len(c) == best)


def test_owned_spans_void(spark):
    df = spark.createDataFrame([("d", i, o) for i, o in enumerate([21, 21, None, 22, 22, 23, 22])], "doc string, i int, owner int")
    assert rows(segment.owned_spans(df, "doc", "i")) == [("d", 21, 0, 2), ("d", 22, None, None), ("d", 23, None, None)]


def test_restarts(spark):
    df = spark.createDataFrame([("a", i, 4) for i in range(5)] + [("b", 0, None), ("b", 1, 30)], "k string, i int, n int")
    got = {(r.k, r.i): (r.conversation, r.running) for r in segment.restarts(df, "k", "i", "n", 10).collect()}
    assert got == {("a", 0): (0, 4), ("a", 1): (0, 8), ("a", 2): (1, 4), ("a", 3): (1, 8), ("a", 4): (2, 4), ("b", 0): (0, 0), ("b", 1): (0, 30)}


def test_matching_is_the_greedy_one(spark):
    rng = random.Random(3)
    pairs = [(f"l{i}", f"r{j}", rng.choice([0.5, 0.6, 0.7, 0.8, 0.9])) for i in range(12) for j in range(12) if rng.random() < 0.6]
    want, used = [], set()
    for score, a, b in sorted(((-s, a, b) for a, b, s in pairs if s >= 0.55)):
        if a not in used and b not in used:
            want.append((a, b, -score))
            used |= {a, b}
    df = spark.createDataFrame(pairs, "a string, b string, s double")
    assert rows(relate.one_to_one(df, "a", "b", "s")) == sorted(want)
    assert relate.one_to_one(df.where("false"), "a", "b", "s").count() == 0


def test_similarity():
    assert relate.similarity("abc", "abc") == 1.0 and relate.similarity(None, "a") == 0.0


def test_overlap_and_as_of(spark):
    b = spark.createDataFrame([("d", i, i * 3000, i * 3000 + 2999) for i in range(6)], "doc string, i int, s int, e int")
    s = spark.createDataFrame([("d", 2999, 3000), ("d", 2998, 9001), ("d", 5, 5), ("x", 0, 9)], "doc string, lo int, hi int")
    assert rows(relate.overlapping(b, s, "doc", "i", "s", "e", "lo", "hi")) == [("d", 2998, 9001, 0, 4), ("d", 2999, 3000, 0, 0), ("d", 5, 5, 0, 0), ("x", 0, 9, 0, 0)]
    m = spark.createDataFrame([("d", 1, 10), ("d", 3, 30)], "k string, t int, v int")
    r = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2), ("d", 9)], "k string, t int")
    assert rows(relate.as_of(r, m, "k", "t", "v")) == [("d", 0, None), ("d", 1, 10), ("d", 2, 10), ("d", 9, 30)]


def test_lines_match(spark):
    lines = spark.createDataFrame([("d", "x", "long line one"), ("d", "x", "long line two"), ("d", "x", "short"), ("d", "y", "another line"), ("d", "y", "long line one")], "doc string, owner string, t string")
    blocks = spark.createDataFrame([("d", "long line one"), ("d", "long line two"), ("e", "another line")], "doc string, t string")
    assert rows(relate.matched_lines(lines, blocks, "doc", "owner", "t")) == [("x", 2, 2)]


def test_merge_entries(spark):
    df = spark.createDataFrame(
        [(1, "yield", "n.", "产量（熟词生义）"), (2, "Yield", "v.", "屈服，让步"), (3, "abundance", "n.", "大量，丰富"), (4, "abundance", "n.", "丰富，充裕"), (5, "abundance", "n.", "充裕，大量"), (6, " ", "n.", "x"), (7, None, None, None), (8, "split", "n. phr.", "（尤指灾难，或事件的）后果；余波"), (9, "split", "phr.", None)],
        "id int, word string, pos string, meaning string",
    )
    got = {r.key: (r.word, r.pos, r.meaning, r.n) for r in summary.merged_entries(df, "word", "pos", "meaning", "id").collect()}
    assert got == {"yield": ("yield", "n./v.", "产量（熟词生义）；屈服；让步", 2), "abundance": ("abundance", "n.", "大量；丰富；充裕", 3), "split": ("split", "n. phr.", "（尤指灾难，或事件的）后果；余波", 2)}


def test_first_of(spark):
    df = spark.createDataFrame([(2, " Apple"), (1, "apple "), (3, ""), (4, None), (5, "b")], "id int, w string")
    assert rows(summary.first_of(df, ["w"], "id")) == [(1, "apple "), (5, "b")]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 2), (None, 1)] + [(i, i + 1) for i in range(100, 180)], "a long, b long")
    got = dict(rows(graph.components(e)))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | dict.fromkeys(range(100, 181), 100)
    assert graph.components(e.where("false")).count() == 0


def test_heavy_lookup(spark):
    r = spark.createDataFrame([("hot", i) for i in range(90)] + [(f"k{i}", i) for i in range(10)] + [(None, 0)], "k string, i int")
    t = r.groupBy("k").count().withColumn("v", F.upper("k"))
    assert rows(skew.heavy_lookup(r, t, ["k"], "count", 101, 5)) == rows(r.where("k is not null").withColumn("v", F.upper("k")))


def test_rank(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(6)] + [("b", 9, None)], "g string, id int, s int")
    assert [r.id for r in rank.top_of(df, "g", [F.desc_nulls_last("s"), F.col("id")], 2).orderBy("g", "rank").collect()] == [2, 5, 9]
    assert {r.id for r in rank.keep_some(df, "g", F.col("s") == 1).collect()} == {1, 4, 9}


def test_replies(spark):
    p = reply.parse_reply
    assert p('```json\n{"a": 1}\n```') == {"json": {"a": 1}, "how": "whole", "truncated": False}
    assert p('Sure: {"a": {"b": 2}} done')["json"] == {"a": {"b": 2}}
    assert p('{"segments": [{"x": "}{"}, {"x": 2}, {"x": ')["json"] == {"segments": [{"x": "}{"}, {"x": 2}]}
    assert p("no")["how"] == "raw" and p(None)["json"] is None
    said = ['{"start_block": 135}', '```json\n{"start_block": 135}\n```', "135", "9999", '{"start_block": null}', "", "114", "200"]
    df = spark.createDataFrame([(s,) for s in said], "s string").select(reply.start_index(F.col("s"), F.lit(114), F.lit(149)).alias("n"))
    assert [r.n for r in df.collect()] == [135, 135, 135, None, None, None, None, None]


def test_model_stage(spark):
    from folioforge.sources.model import ask_for_json

    class Says:
        name = "script"

        def __init__(self, *said):
            self.said = list(said)

        def ask(self, history, prompt):
            return self.said.pop(0)

    assert ask_for_json(Says('{"a":1}'), "p")[2] == 1
    assert ask_for_json(Says('{"a":"x"y"}', '{"a":2}'), "p")[0::2] == ('{"a": 2}', 2)
    assert ask_for_json(Says("x", "y", "z"), "p") == (None, "z", 3)
    assert ask_for_json(Says('{"segments":[{"a":1},{'), "p")[2] == 1


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(text.inline, " a&nbsp;b\n\n\n\nc&amp;d ") == "a b\n\nc&d"
    assert one(text.sanitize, "## **T**`x`\x01 a_b\n# z") == "Tx a_b\nz"
    assert one(text.essay_words, "Dear Sir,\nI am writing to update you on our project.\nYours,") == 9
    assert one(lambda c: text.safe_stem(c), "a b（1）.docx") == "a_b1" and one(lambda c: text.safe_name(c), "！") == "item"
    assert one(text.duration, "125") == "2m05s"
    assert one(text.strip, "　A\n") == "A" and one(text.wordish, None) == 0


def test_graded_empty(spark):
    df = spark.createDataFrame([], "source_doc string, section string, text string")
    assert summary.graded(df).count() == 0


def test_segmenter(spark):
    from folioforge.operators import segmenter

    body = "head\nA\n" + "x" * 100 + "\nB\n" + "y" * 90 + "\nC\nshort\n完形填空\n" + "z" * 200 + "\n参考答案\n21-23 ABC 24-27 DDAA\n41-43 ABC"
    df = docs(spark, body, None, "", "no section")
    segs = segmenter.segments(df, "id", "text")
    got = {r.section: (r.item_id, r.char_count, r.answer_count) for r in segmenter.with_answers(segs, df, "id", "text").collect()}
    assert got == {"reading_a": ("0__reading_a__01", 102, 3), "reading_b": ("0__reading_b__01", 92, 4), "cloze": ("0__cloze__01", 241, 3)}
    assert all(body[r.pos : r.slice_end].strip() == r.body for r in segs.collect())
    names = spark.createDataFrame([("阅读A",), ("a",), ("CLOZE",), (None,)], "n string").select(segmenter.section_of(F.col("n")).alias("s"))
    assert [r.s for r in names.collect()] == ["reading_a", "unknown", "cloze", "unknown"]


def test_small_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(reply.idea, '{"ideas":[{"a":1}]}') == '{"a":1}' and one(reply.idea, "text") is None and one(reply.idea, None) is None
    assert one(reply.progress, "score (3/18) x") == pytest.approx(1 / 6) and one(reply.progress, "(1/0)") is None
    assert one(lambda c: reply.reordered(F.split(c, ","), ["a", "b"]), "z,b,a,y") == ["a", "b", "z", "y"]


def test_pipeline(spark, tmp_path):
    from folioforge.plans.pipeline import Pipeline

    p = Pipeline(spark, str(tmp_path))
    p.add("a", lambda: spark.range(3))
    p.add("b", lambda a: a.selectExpr("id + 1 AS id"), "a")
    p.add("c", lambda a, b: a.union(b), "a", "b")
    assert p.order("c") == ["a", "b", "c"] and p.dependents("a") == {"b", "c"}
    assert p.table("c", tag="t").count() == 6 and p.ran == ["a", "b", "c"]
    p.table("c")
    p.table("b", force=True)
    assert p.ran == ["a", "b", "c", "b"] and not p.done("c")
    with pytest.raises(ValueError):
        p.add("d", lambda x: x, "none")


def test_lone_pair_and_redirect(spark):
    df = spark.createDataFrame([("a", "b", 0.1)], "a string, b string, s double")
    assert relate.one_to_one(df, "a", "b", "s").count() == 0 and relate.one_to_one(df, "a", "b", "s", lone=True).count() == 1
    rows_ = spark.createDataFrame([("p",), ("q",)], "k string")
    assert rows(relate.redirected(rows_, spark.createDataFrame([("p", "x")], "k string, t string"), "k", "t")) == [("p", "x"), ("q", "q")]


def test_forward_fill_spans_partitions(spark):
    from folioforge.operators.scan import forward_fill

    rng = random.Random(2)
    data = [("hot", i, rng.choice([None, None, None, None, i])) for i in range(4000)] + [(f"k{i % 7}", i, None if i % 3 else i) for i in range(200)] + [(None, i, 5 if i == 3 else None) for i in range(6)] + [("bare", i, None) for i in range(900)]
    want, last = {}, {}
    for k, i, m in sorted(data, key=lambda r: (str(r[0]), r[1])):
        last[k] = m if m is not None else last.get(k)
        want[k, i] = last[k]
    df = spark.createDataFrame(data, "k string, i int, m int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small data are one partition
    try:
        got = {(r.k, r.i): r.f for r in forward_fill(df, "k", ["i"], "m", "f").collect()}
        ranged = df.repartitionByRange("k", "i").where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranged > 1 and got == want
    assert forward_fill(df.where("false"), "k", ["i"], "m", "f").count() == 0


def test_row_numbers_and_slices_span_partitions(spark):
    from folioforge.operators.scan import row_numbers

    data = [("hot", i * 3, 99999) for i in range(3000)] + [("b", 5, 7), (None, 1, 2), (None, 4, 9)]
    df = spark.createDataFrame(data, "k string, pos int, e int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.pos): r.n for r in row_numbers(df, "k", ["pos"], "n").collect()}
        ends = {(r.k, r.pos): r.slice_end for r in segment.slices(df, "k", "pos", "e").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {("hot", i * 3): i + 1 for i in range(3000)} | {("b", 5): 1, (None, 1): 1, (None, 4): 2}
    assert ends == {("hot", i * 3): (i * 3 + 3 if i < 2999 else 99999) for i in range(3000)} | {("b", 5): 7, (None, 1): 4, (None, 4): 9}
