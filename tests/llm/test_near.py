"""Problem 4: any similarity, and one class in every partition."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioforge.llm import p4_near_dups as p4


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    lexicon = [f"w{k}" for k in range(4000)]
    out = []
    for _ in range(60):
        words = rng.choices(lexicon, k=80)
        out.append(words)
        for _ in range(4):
            edited = list(words)
            for _ in range(rng.randint(1, 16)):
                edited[rng.randrange(len(edited))] = rng.choice(lexicon)
            out.append(edited)
    return {f"i{k:04}": " ".join(w) for k, w in enumerate(out)}


@pytest.mark.parametrize("least", [0.25, 0.5, 0.8])
def test_p4_recall_at_any_similarity(spark, texts, least):
    sets = {k: p4.shingles(t) for k, t in texts.items()}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if p4.similarity(sets[a], sets[b]) >= least}
    got = {tuple(r) for r in p4.near_pairs(spark.createDataFrame(list(texts.items()), "item_id string, text string"), least=least).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 30


def test_p4_shape():
    assert p4.shape(0.5) == (80, 4, 157) and p4.shape(1)[0] == 1
    for least in (0.05, 0.3, 0.7, 0.95):
        bands, rows, _ = p4.shape(least)
        assert (1 - least**rows) ** bands <= p4.MISSED
    with pytest.raises(ValueError, match="similarity"):
        p4.shape(0)


def test_p4_a_class_is_banded_once(spark, texts):
    """One text stands in every partition: its bands come from every task and are made distinct before they are joined."""
    some = [("i0000", texts["i0000"], "note"), ("i0001", texts["i0000"] + " more", "note")] + [(f"c{k}", texts["i0000"], "note") for k in range(64)]
    df = spark.createDataFrame(some, "item_id string, text string, keys string").repartition(8)
    members, links = p4.near_classes(df)
    assert members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] == 65 and links.count() == 1
    assert p4.near_pairs(df).count() == 65 * 64 // 2 + 65
    assert {r.links for r in p4.near_groups(df).collect()} == {1}
