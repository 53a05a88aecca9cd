"""Problems 3, 5, 6, 7, 8: exact against brute force, round trips and SQL."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import p3_format_dups as p3
from folioforge.llm import p5_token_budget as p5
from folioforge.llm import p6_lookalike as p6
from folioforge.llm import p7_encode as p7
from folioforge.llm import p8_packing as p8
from folioforge.llm import vocab
from folioforge.llm.trie import BpeCount, DoubleArrayTrie, unigram_count

RANKS = f"{vocab.TOKENIZERS}/byte_bpe_50k.tiktoken"
ODD = ["", None, " ", "\n\n", "<|endoftext|> is text", "a" * 3000, "中文，没有空格。" * 50, "x\xa0y　z", "é é 😀 \x1c", "it's  3,000\t\tThe   end \r\n"]


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{vocab.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch([x or "" for x in xs], add_special_tokens=False)]


def noise(seed, n, size):
    rng, signs = random.Random(seed), [*"ab  \n\t'sd1 2，。中文é́　\xa0\x1c!? ", "<|endoftext|>", "The ", "tion"]
    return ["".join(rng.choices(signs, k=rng.randint(0, size))) for _ in range(n)]


# ---- 7


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_p7_equals_the_tokenizer(hf, bits):
    texts = [*ODD, *noise(bits, 300, 400)]
    enc = p7.ChunkEncoder(vocab.read_ranks(RANKS), bits)
    assert enc.batch(pa.array(texts, pa.string())).to_pylist() == hf(texts)
    assert enc.batch(pa.array([], pa.string())).to_pylist() == []


def test_p7_shared_chunks_are_encoded_once():
    long = " ".join(noise(1, 1, 9000))
    enc = p7.ChunkEncoder(vocab.read_ranks(RANKS), 6)
    enc.batch(pa.array([long]))
    before = enc.encoded
    enc.batch(pa.array(["Another beginning. " + long]))
    assert enc.encoded - before < 0.1 * before


def test_p7_query(spark, data, hf):
    rows = p7.p7_ids(spark, data).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(docs)
    assert [list(r.ids) for r in rows] == hf([docs[r.doc_id] for r in rows])


def test_p7_clashing_names_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (None, None, "x")], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, list(r.ids)) for r in p7.encode(df).collect()), key=str)
    assert got == [(1, [64, 275]), (1, [64, 275]), (None, [])]
    assert p7.encode(df.where("false")).count() == 0


# ---- 5


def test_p5_counts_equal_the_tokenizer(hf):
    ranks = vocab.read_ranks(RANKS)
    count = p5.segment_counter(ranks, DoubleArrayTrie(ranks))
    texts = [x for x in [*ODD, *noise(9, 300, 300)] if x]
    assert [count(t) for t in texts] == [len(i) for i in hf(texts)]


def test_p5_unigram_path_is_the_best():
    rng = random.Random(2)
    tokens = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(25)} | {b"a", b"b", b"c"}
    ids = {t: i for i, t in enumerate(sorted(tokens))}
    scores = [-rng.uniform(1, 9) for _ in ids]
    trie = DoubleArrayTrie(ids)

    def best(s):
        table = [(0.0, 0)]
        for j in range(1, len(s) + 1):
            table.append(max(((table[i][0] + scores[ids[s[i:j]]], -(-table[i][1] + 1) if False else table[i][1] - 1) for i in range(max(0, j - 4), j) if s[i:j] in ids)))
        return -table[-1][1]

    for _ in range(200):
        s = bytes(rng.choices(b"abc", k=rng.randint(1, 15)))
        assert unigram_count(trie, scores, s) == best(s)
    assert unigram_count(trie, scores, b"") == 0 and unigram_count(trie, scores, b"zz") == 2
    assert BpeCount({b"a": 0, b"b": 1, b"ab": 2}, DoubleArrayTrie({b"a": 0, b"b": 1, b"ab": 2})).count(b"aabb") == 3


def test_p5_slices(spark):
    items = spark.createDataFrame(
        [("i1", "p1", "cloze", "a b"), ("i1", "p1", "cloze", "a b"), ("i2", "p1", None, None), ("i3", "gone", "cloze", "a"), ("i4", None, "x", ""), (None, "p2", "x", "a b c")],
        "item_id string, source_doc string, section string, text string",
    ).withColumn("paper", pytest.importorskip("pyspark.sql.functions").lit(1))
    papers = spark.createDataFrame([("p1", "s", "EN"), ("p2", None, "zh-CN"), (None, "z", "z")], "source_doc string, source string, lang string")
    got = {(r.slice, r.source, r.lang, r.section): (r.n_items, r.n_tokens) for r in p5.token_budget(items, papers).collect()}
    assert got == {
        ("source_lang", "s", "en", None): (2, 2), ("source_lang", "unknown", "zh", None): (1, 3), ("source_lang", "unknown", "unknown", None): (2, 1),
        ("section", None, None, "cloze"): (2, 3), ("section", None, None, "unknown"): (1, 0), ("section", None, None, "x"): (2, 3),
    }
    each = sorted((tuple(r) for r in p5.item_tokens(items, papers).collect()), key=str)
    assert each == sorted([("i1", "s", "en", "cloze", 2), ("i2", "s", "en", "unknown", 0), ("i3", "unknown", "unknown", "cloze", 1), ("i4", "unknown", "unknown", "x", 0), (None, "unknown", "zh", "x", 3)], key=str)
    assert p5.token_budget(items.where("false"), papers).count() == 0


# ---- 8


def test_p8_every_document_placed_once_and_nothing_overflows(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, 7, 7, 7, 50, 100, 101, 250, 256, 257, 1000])) for i in range(3000)] + [(9001, 256), (9002, 257), (9001, 256)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    rows = p8.pack(df, 256, 4).collect()
    total, parts = Counter(), defaultdict(list)
    for r in rows:
        total[r.container] += r.tokens
        parts[r.doc_id].append((r.part, r.tokens))
    assert max(total.values()) <= 256 and set(total) == set(range(len(total)))
    for i, n in Counter(dict(sizes[:3000])).items():
        assert sum(t for _, t in parts[i]) == n and (n > 256 or len(parts[i]) <= 1)
        assert sorted(t for _, t in parts[i])[1:] == [256] * (len(parts[i]) - 1) or not parts[i]
    assert len(parts[9001]) == 2  # repeated rows are documents of their own
    room: list[int] = []  # first fit, decreasing, one by one
    for n in sorted((t for ps in parts.values() for _, t in ps), reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(256 - n)
        else:
            room[k] -= n
    assert len(total) <= len(room) * 1.01 + 1
    assert p8.pack(df.where("false")).count() == 0 and p8.pack(df.where("tokens = 0")).count() == 0


def test_p8_plan_uses_the_histogram_exactly():
    rng = np.random.default_rng(1)
    hist = np.zeros(101, np.int64)
    hist[1:] = rng.integers(0, 400, 100)
    hist[17] = 50_000
    used = np.zeros(101, np.int64)
    for pattern, n in p8.plan(hist, 100):
        assert n > 0 and sum(k * m for k, m in pattern.items()) <= 100
        for k, m in pattern.items():
            used[k] += n * m
    assert (used == hist).all()


def test_p8_query(spark, data):
    r = p8.p8_fill(spark, data).first()
    assert r.containers <= r.least * 1.05 + 1
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert p8.p8_containers(spark, data).select("doc_id").distinct().count() == docs.where("text <> ''").count()


# ---- 3


def test_p3_fields(spark):
    reading = spark.createDataFrame([(1, "Take  off", "V.", "起飞；"), (2, "take\xa0off!", "v", "起 飞"), (5, None, " ", "…"), (6, "", None, None), (8, "x", "n.", None), (8, "x", "n.", None)], "entry_id long, word string, pos string, meaning string")
    forms = spark.createDataFrame([(3, "take off", "v", "起飞")], "entry_id long, base string, base_pos string, note string").withColumnRenamed("note", "name")
    raw = spark.createDataFrame(
        [(4, "reading", '{"MEANING":"起飞","Word":"TAKE-OFF","pos":"v"}'), (7, "reading", None), (9, "reading", "no json"), (10, "Reading ", '{"word":"takeoff","meaning":"起飞"}'), (11, None, '{"word":"x"}'), (None, "reading", "{}"), (12, "reading", '{"word":"q","Word":"z","word":"y"}'), (13, "reading", "[1]")],
        "entry_id long, list_name string, payload string",
    )
    entries = p3.typed_entries(reading, "reading", p3.FIELDS["reading"]).unionByName(p3.typed_entries(forms, "forms", p3.FIELDS["forms"])).unionByName(p3.raw_entries(raw))
    assert sorted(map(tuple, p3.pairs_found(entries).collect())) == [(1, 2), (1, 4), (5, 6), (5, 7)]
    assert p3.pairs_found(entries.where("false")).count() == 0


def test_p3_many_fields_and_repeated_ids(spark):
    wide = [{"name": f"f{k}", "value": f"v{k}"} for k in range(2000)]
    rows = [(1, "l", wide), (2, "l", wide[::-1]), (3, "l", wide[:-1]), (7, "l", [{"name": "a", "value": "x"}]), (7, "l", [{"name": "a", "value": "y"}]), (8, "l", [{"name": "a", "value": "Y!"}]), (9, "l", [{"name": "a", "value": "xy"}])]
    entries = spark.createDataFrame(rows, "entry_id long, list string, fields array<struct<name:string,value:string>>")
    assert sorted(map(tuple, p3.pairs_found(entries).collect())) == [(1, 2), (7, 8)]


# ---- 6


@pytest.fixture(scope="module")
def rewriter():
    return p6.Rewriter(p6.rewrites({chr(i): 5 for i in range(128)}))


@pytest.mark.parametrize(
    "text, to, kinds",
    [
        ("ｎｅａｒ the ２４", "near the 24", ["wide"]),
        ("soufflé pīnyīn", "soufflé pīnyīn", ["accent"]),
        ("cos‌tu­me﻿", "costume", ["invisible"]),
        ("a　b c\n", "a b c\n", ["space"]),
        ("lоngіtudіnаl Νelνi", "longitudinal Nelvi", ["mixed"]),
        ("σοφία спасибо (α) 25℃ Ⅱ ① café，“好”", "σοφία спасибо (α) 25℃ Ⅱ ① café，“好”", []),
        ("ｅ́", "é", ["wide", "accent"]),
        ("", "", []),
        (None, None, []),
    ],
)
def test_p6_forms(rewriter, text, to, kinds):
    assert rewriter.rewrite(text) == (to, kinds)


def test_p6_one_form_only(rewriter):
    signs = [*"abéα а", "é", "ｅ", "​", "\xa0", "о", "中"]
    rng = random.Random(4)
    for _ in range(500):
        once, _ = rewriter.rewrite("".join(rng.choices(signs, k=12)))
        assert rewriter.rewrite(once)[0] == once


def test_p6_representatives_follow_the_corpus():
    assert p6.rewrites({"a": 9, "ａ": 1, "а": 99})["ａ"] == "a" and p6.rewrites({"a": 9})["а"] == "a"
    wide = p6.rewrites({"a": 1, "ｂ": 9})
    assert wide["a"] == "ａ" and wide["b"] == "ｂ"
    assert p6.Rewriter(wide).rewrite("ａb\u200b")[1] == ["wide", "invisible"]
    assert all(unicodedata.normalize("NFC", k) == v for k, v in p6.composed().items())


def test_p6_table(spark):
    df = spark.createDataFrame([("k1", "ｘ y"), ("k1", "ｘ y"), (None, None), ("k2", "ok")], "rec_key string, text string").withColumnRenamed("rec_key", "kinds_of")
    got = sorted(((r.kinds_of, r.text, r.kinds) for r in p6.normalised(df, ["kinds_of"]).collect()), key=str)
    assert got == sorted([("k1", "x y", ["wide"]), ("k1", "x y", ["wide"]), ("k2", "ok", []), (None, None, [])], key=str)
    assert p6.normalised(df.where("false"), ["kinds_of"]).count() == 0
