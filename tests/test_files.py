"""Sources and sinks, there and back."""

from __future__ import annotations

import json

import pytest

from folioforge.sources import files, sinks


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    parts = ["第一节 Reading", "a\nb", [["Word", "POS"], ["muse", "n."], ["", "x & <y>"]], " ", "end"]
    (tmp_path / "sub/one.docx").write_bytes(sinks.docx_bytes(parts))
    (tmp_path / "~$one.docx").write_bytes(b"lock")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    return str(tmp_path)


def test_docx(spark, folder):
    got = sorted(map(tuple, files.read_docx(files.listing(spark, folder, "docx")).collect()), key=str)
    good = [r for r in got if r[0] == "one.docx"]
    assert [(r[1], r[2], r[3], r[4]) for r in good] == [(0, 0, "p", "第一节 Reading"), (1, 1, "p", "a\nb"), (2, 2, "tbl", "Word | POS"), (3, 2, "tbl", "muse | n."), (4, 2, "tbl", "x & <y>"), (5, 4, "p", "end")]
    flat = "\n".join(r[4] for r in good)
    assert all(flat[r[5] : r[6]] == r[4] for r in good)
    assert [r[0] for r in got if r[7]] == ["bad.docx"]
    tables = files.handout_tables(files.listing(spark, folder, "docx"), {"reading": ["W ord", "POS"]})
    assert sorted(map(tuple, tables.collect())) == [("one.docx", "reading", 0, ["muse", "n."]), ("one.docx", "reading", 1, ["", "x & <y>"])]


def test_written_docx_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", None, "y"]), ("b", [])], "name string, ps array<string>")
    for r in sinks.docx_files(df, "name", "ps").collect():
        (tmp_path / f"{r.name}.docx").write_bytes(bytes(r.content))
    got = files.read_docx(files.listing(spark, str(tmp_path), "docx"))
    assert [r.text for r in got.orderBy("ord").collect()] == ["x", "y"]


def test_ledger_and_csv(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"seq": 1, "stage": "score", "prompt_tokens": 5}\n\nnot json\n{"seq": 2}\n')
    assert [r.seq for r in files.read_ledger(spark, str(tmp_path / "l.jsonl")).orderBy("seq").collect() if r.seq] == [1, 2]
    assert files.read_ledger(spark, str(tmp_path / "none.jsonl")).count() == 0
    df = spark.createDataFrame([(1, "好, \"x\"", None)], "a int, b string, c string")
    sinks.write_csv(df, str(tmp_path / "c"), ["b", "a"])
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["b", "a"] and tuple(back.first()) == ("好, \"x\"", "1")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert "好" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))


def test_recognised(spark):
    page = lambda *bs: {"prunedResult": {"parsing_res_list": [dict(zip(("block_label", "block_content", "block_order"), b)) for b in bs]}}
    body = lambda *ps: json.dumps({"result": {"layoutParsingResults": list(ps)}})
    rows = [("d", 0, body(page(("header", "h", None), ("text", "t0", 1), ("table", "t1", None), ("text", "t2", 2)))), ("d", 1, body(page(("text", "u", None))))]
    got = files.recognised_blocks(spark.createDataFrame(rows, "doc string, line int, body string")).orderBy("place").collect()
    assert [(r.page, r.text) for r in got] == [(0, "t0"), (0, "t1"), (0, "t2"), (1, "u")]
    other = spark.createDataFrame([("d", 0, "text", "T", 1, 0, None), ("d", 1, "table", None, None, 0, "<table>"), ("d", 2, "discarded", "x", None, 0, None)], "doc string, idx int, type string, text string, text_level int, page_idx int, table_body string")
    assert [(r.label, r.text) for r in files.content_list(other).orderBy("place").collect()] == [("paragraph_title", "T"), ("table", "<table>")]


def test_markdown_and_publish(spark, tmp_path):
    df = spark.createDataFrame([("d", "s1", "t\n1", "b1", 1), ("d", "s1", "t2", None, 2), ("d", "s2", "t3", "b3", 3)], "doc string, section string, title string, body string, o int")
    text = sinks.markdown(df, "doc", "section", "title", "body", "o").first().text
    assert text.count("# s1") == 1 and text.index("## t 1") < text.index("## t2") < text.index("# s2")
    sinks.publish(df, f"{tmp_path}/out/x", f"{tmp_path}/out")
    for bad in (f"{tmp_path}/x", f"{tmp_path}/out/../x"):
        with pytest.raises(ValueError):
            sinks.publish(df, bad, f"{tmp_path}/out")
    with pytest.raises(ValueError):
        sinks.publish(df.where("false"), f"{tmp_path}/out/y", f"{tmp_path}/out")
    good, bad = sinks.quarantined(df, "body is not null")
    assert good.count() == 2 and bad.count() == 1


def test_docx_subset_and_merge():
    one, two = sinks.docx_bytes(["a", "b", [["c", "d"]]]), sinks.docx_bytes(["e"])
    texts = lambda c: [b[2] for b in files.docx_blocks(c)]
    assert texts(sinks.docx_subset(one, [0, 2])) == ["a", "c | d"]
    assert texts(sinks.docx_merge([one, two])) == ["a", "b", "c | d", "e"]


def test_json_by_key(spark, tmp_path):
    sinks.write_json_by(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), str(tmp_path / "o"), "k")
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if p.is_dir()) == ["k=a", "k=b"]
