"""Problems 1, 2, 4, 9: brute force, held-out accuracy, fixtures."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import p1_reading_level as p1
from folioforge.llm import p2_ocr as p2
from folioforge.llm import p4_near_dups as p4
from folioforge.llm import p9_truncation as p9
from folioforge.llm.boost import Boosted

# ---- 4


def words(text):
    return __import__("re").findall("[a-z0-9]+|[一-鿿]", (text or "").lower())


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (words(a), words(b)))
    return len(a & b) / len(a | b) if a & b else 0.0


def test_p4_brute_force(spark):
    rng = random.Random(7)
    lexicon = [f"w{i}" for i in range(4000)] + list("环境文化旅行")
    base = [[rng.choice(lexicon) for _ in range(rng.randint(20, 90))] for _ in range(120)]
    texts = [" ".join(b) for b in base]
    for b in base[:60]:
        c = list(b)
        for _ in range(rng.randint(1, 8)):
            c[rng.randrange(len(c))] = "edit"
        texts.append("\n".join(c))
    texts += [texts[0], texts[0].upper(), "two words", "", None]
    rows = [(f"i{k:03}", t) for k, t in enumerate(texts)] + [("i000", texts[0]), (None, texts[0])]
    df = spark.createDataFrame(rows, "item_id string, text string").withColumn("cls", F.lit(1)).withColumn("id", F.lit("x"))
    got = {tuple(r) for r in p4.near_pairs(df).collect()}
    named = {k: t for k, t in rows if k}
    want = {(a, b) for a in named for b in named if a < b and jaccard(named[a], named[b]) >= 0.5}
    assert got <= want and len(got) >= len(want) - 1 and len(want) > 30
    groups = {r.item_id: r.group for r in p4.near_groups(df).collect()}
    assert set(groups) == set(named) and all(groups[a] == groups[b] for a, b in got)
    assert p4.near_pairs(df.where("false")).count() == 0 and p4.near_groups(df.where("false")).count() == 0


def test_p4_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    make, errors = p4.Circulant(), []
    for _ in range(60):
        both, a, b = (rng.integers(1, 1 << 62, n, dtype=np.uint64) for n in (100, 50, 50))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        errors.append((make.signature(x) == make.signature(y)).mean() - p4.similarity(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_p4_batches_equal_single_texts():
    texts = ["a b c d", None, "", "x y", "环境文化旅行 The the THE", "a b c " * 40]
    for a, b in zip(p4.shingle_batch(texts), map(p4.shingles, texts)):
        assert a.tolist() == b.tolist()
    assert p4.shingle_batch([]) == []


# ---- 1


def test_p1_isotonic():
    s, v = p1.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert v.tolist() == [1, 2.5, 4] and s.tolist() == [1, 2.5, 4]


def test_p1_held_out(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    items, labels = spark.read.parquet(f"{folder}/items.parquet"), spark.read.parquet(f"{folder}/level_labels.parquet")
    held = F.pmod(F.xxhash64("item_id"), F.lit(4)) == 0
    got = p1.levels(items, labels.where(~held)).where("level is not null").dropDuplicates(["item_id"])
    r = got.join(labels.where(held).groupBy("item_id").agg(F.avg("read_level").alias("y")).where("y is not null"), "item_id").collect()
    assert len(r) >= 12 and np.mean([abs(x.level - x.y) <= 1 for x in r]) >= 0.85


def test_p1_odd_tables(spark):
    items = spark.createDataFrame([("a", "The cat sat."), ("a", "The cat sat."), ("b", None), ("c", ""), ("d", "全是中文，没有英文。"), (None, "Hello there."), ("e", "word " * 50_000)], "item_id string, text string").withColumn("level", F.lit(9))
    none = spark.createDataFrame([], "item_id string, read_level int")
    assert {r.level for r in p1.levels(items, none).collect()} == {None}
    labels = spark.createDataFrame([("a", 1), ("e", 5), ("b", None), ("zz", 3)], "item_id string, read_level int")
    got = {r.item_id: r.level for r in p1.levels(items, labels).collect()}
    assert got["d"] is None and got["b"] is None and got["c"] is None and got["a"] in range(1, 7)
    assert p1.levels(items.where("false"), labels).count() == 0


def test_boost():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Boosted(x[:1500], y[:1500]).chance(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9
    assert Boosted(np.zeros((0, 4)), np.zeros(0)).chance(x[:3]).shape == (3,)


# ---- 2


def test_p2_misreadings():
    assert p2.misreadings("morning", "morriirig") == (2, pytest.approx(0.0))
    assert p2.misreadings("blanket", "bl@nket") == (1, pytest.approx(0.0))
    assert p2.misreadings("book", "books") == (0, pytest.approx(1.0))
    assert p2.skeleton("morriirig") == p2.skeleton("morning")
    assert len({*p2.grams("reacling")} & {*p2.grams("reading")}) >= 2


def test_p2_line_ends():
    assert p2.tail_of("Neither Quo- ") == ("quo", "-") and p2.tail_of("exam\xad") == ("exam", "\xad") and p2.tail_of("end.") is None
    assert p2.head_of("  “ined the") == ("ined", "") and p2.head_of("") == ("", "")
    assert p2.number_of("- 12 -") == 12 and p2.number_of("xiv") == 14 and p2.number_of("text") is None


def scans(spark):
    """Three papers with planted defects, and odd rows."""
    rng = random.Random(8)
    lexicon = ["morning", "blanket", "school", "window", "garden", "teacher", "machine", "village", "remember", "silent", "careful", "journey", "picture", "station", "kitchen", "weather"]
    sentence = lambda: "The " + " ".join(rng.choice(lexicon) for _ in range(9)) + "."
    rows, truth, b = [], {}, 0
    for d in range(25):
        for page in range(6):
            order = 0
            for kind in ("head", "body", "body", "foot"):
                b += 1
                label = rng.choice(["text", "header"]) if kind == "head" else "page_number" if kind == "foot" and rng.random() < 0.7 else "text"
                text = f"Paper {d} Practice" if kind == "head" else f"- {page + 1} -" if kind == "foot" else "\n".join(sentence() for _ in range(3))
                if kind == "body" and rng.random() < 0.15:
                    text = text.replace("window", "wind0w", 1).replace("silent", "si|ent", 1)
                    if "0" in text or "|" in text:
                        truth.setdefault("char", set()).add(b)
                if kind == "body" and rng.random() < 0.2:
                    text += "\nThe teach-\ner saw a well-\nknown garden, well-known to all."
                    truth.setdefault("hyphen", set()).add(b)
                if kind in ("head", "foot"):
                    truth.setdefault("furniture", set()).add(b)
                rows.append((b, f"doc{d}", page, order, label, text))
                order += 1
    return rows, truth


def test_p2_found(spark):
    rows, truth = scans(spark)
    rows += [rows[0], (9001, "odd", 0, None, None, None), (9002, None, None, None, None, ""), (9003, "odd", 1, 0, "text", "x" * 50_000), (None, "odd", 1, 1, "text", "y")]
    df = spark.createDataFrame(rows, "block_id long, source_doc string, page int, block_order int, label string, text string").withColumn("word", F.lit("w")).withColumn("doc", F.lit("d"))
    got = {}
    for r in p2.defects(df).collect():
        got.setdefault(r.defect, set()).add(r.block_id)
    for kind in ("furniture", "char", "hyphen"):
        assert len(got[kind] & truth[kind]) >= 0.95 * len(truth[kind]), kind
        assert len(got[kind] - truth[kind]) <= 0.05 * len(truth[kind]) + 1, kind
    assert "split" not in got
    assert p2.defects(df.where("false")).count() == 0


def test_p2_paragraphs(spark):
    rows, _ = scans(spark)
    rows = [r for r in rows if r[1] != "doc0"] + [
        (5001, "doc0", 0, 0, "text", "The silent machine was near the gar-\nden and the tea‐"), (5002, "doc0", 0, 1, "page_number", "- 1 -"), (5003, "doc0", 1, 0, "text", "cher was careful.\nThe end."), (5004, "doc0", 1, 1, "text", "- 2 -"),
    ]
    df = spark.createDataFrame(rows, "block_id long, source_doc string, page int, block_order int, label string, text string")
    got = [r.text for r in p2.paragraphs(df).where("source_doc = 'doc0'").orderBy("page", "place").collect()]
    assert got == ["The silent machine was near the garden and the teacher was careful. The end."]
    assert p2.paragraphs(df.where("false")).count() == 0


# ---- 9


def test_p9_cut_never_leaves_a_whole_sentence():
    rng = np.random.default_rng(3)
    text = "The first sentence is here. The second one follows it. " * 20
    for _ in range(200):
        c = p9.cut(text, [100, 600], rng)
        assert c is None or not c[0].rstrip(" .…[]-\r\n").endswith("here.") and len(c[0]) <= len(text) + 6
    assert p9.cut("short", [], rng) is None


def test_p9_planted(spark):
    rng = random.Random(6)
    lexicon = "the garden teacher walked slowly near remarkable station yesterday because everyone wanted another picture of window and kitchen".split()
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join((" ".join(rng.choice(lexicon) for _ in range(8)) + ".").capitalize() for _ in range(rng.randint(12, 30)))
        if i % 11 == 0:
            text = text[:500] if i % 2 else text[: rng.randint(200, 450)]
            if not text.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, text, "s" + str(i % 3), "passage"))
    rows += [(5000, None, "s0", None), (5001, "", None, None), (5002, " \n", None, None), (5003, "word " * 60_000 + "end.", None, "passage")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, doc_kind string").withColumn("word", F.lit(1)).withColumn("size", F.lit(1))
    got = {r.doc_id for r in p9.scored(df).where("cut").collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.05 * len(cut) + 2
    assert p9.scored(df.where("false")).count() == 0
    assert p9.scored(df.where("doc_id >= 5000 and doc_id < 5003")).count() == 0
