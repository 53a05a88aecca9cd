"""Problem 5: operators over a vocabulary of tokens and scores."""

from __future__ import annotations

from folioforge.llm import p5_token_budget as p5
from folioforge.llm.trie import DoubleArrayTrie, unigram_count

SCORES = {b"a": -3.0, b"b": -3.0, b"ab": -4.0, b"ba": -3.5, b" a": -2.5, b" ": -5.0, b"bab": -9.0}
TEXTS = ["abab baba", "  aab\nb a", "", None, "zz ab", "a b a b"]


def test_p5_operators_take_scores(spark):
    for scores in (SCORES, SCORES | {b"a b": -1.0}):
        trie, values = DoubleArrayTrie({t: k for k, t in enumerate(scores)}), list(scores.values())
        want = {i: unigram_count(trie, values, (t or "").encode()) for i, t in enumerate(TEXTS)}
        rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
        assert {r.id: r.n_tokens for r in p5.token_counts(rows, vocabulary=scores, keep=["id"]).collect()} == want
        items = spark.createDataFrame([(str(i), "p", "s", t) for i, t in enumerate(TEXTS)], "item_id string, source_doc string, section string, text string")
        papers = spark.createDataFrame([("p", "here", "en")], "source_doc string, source string, lang string")
        assert {int(r.item_id): r.n_tokens for r in p5.item_tokens(items, papers, scores).collect()} == want
        assert {r.n_tokens for r in p5.token_budget(items, papers, scores).collect()} == {sum(want.values())}
    assert want[5] != unigram_count(DoubleArrayTrie({t: k for k, t in enumerate(SCORES)}), list(SCORES.values()), b"a b a b")
