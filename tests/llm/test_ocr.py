"""Problem 2: what the repair must not leave out."""

from __future__ import annotations

from folioforge.llm import p2_ocr as p2

COMMONEST = """morning blanket school window garden teacher machine village remember silent careful journey picture station kitchen weather
because during reading spring summer winter question answer passage student library science history language practice evening market
customer mountain harbour festival delivered different important children together another through between without against""".split()


def test_p2_true_words_that_are_rare_in_a_large_corpus(spark):
    """2.4 million words, of which COMMON is 49; all of these true words are far below it."""
    rare = [("tickets", 16), ("tickcts", 1), ("shoes", 14), ("sh0es", 1), ("drivers", 11), ("drivcrs", 1), ("experiments", 14), ("exper1ments", 2), ("cats", 9), ("coats", 8)]
    read_twice = [("bccause", 10), ("bccausc", 1)]
    words = spark.createDataFrame([(w, 48_000) for w in COMMONEST] + rare + read_twice, "word string, n long")
    got = {r.word: r.meant for r in p2.replacements(words).collect()}
    want = {"tickcts": "tickets", "sh0es": "shoes", "drivcrs": "drivers", "exper1ments": "experiments", "bccause": "because", "bccausc": "because"}
    assert got == want


def page_turns():
    """Papers whose pages end and begin within a word, in two of them with a misread character in one half."""
    line = " ".join(COMMONEST)
    rows = [(k, f"doc{k % 40}", k // 40, 0, "text", f"The {line}.\nThe {line}.") for k in range(120)]
    turned = [("The teacher saw the beau-", "tiful village."), ("The teacher saw the rem-", "embcr village."), ("The teacher saw the k1t-", "chen village.")]
    for d, (last, first) in enumerate(turned):
        rows += [(1000 + 2 * d, f"turn{d}", 0, 0, "text", f"The {line}.\n{last}"), (1001 + 2 * d, f"turn{d}", 1, 0, "text", f"{first}\nThe {line}.")]
    return rows


def test_p2_words_broken_between_blocks(spark):
    df = spark.createDataFrame(page_turns(), "block_id long, source_doc string, page int, block_order int, label string, text string")
    got = {r.block_id for r in p2.defects(df).where("defect = 'char'").collect()}
    assert got == {1002, 1003, 1004, 1005}


def test_p2_only_the_half_at_a_blocks_end_is_left_out(spark):
    text = "school\tgarden\nbeau-"
    paged = p2.pages(spark.createDataFrame([(1, "d", 0, 0, "text", text)], "block_id long, source_doc string, page int, block_order int, label string, text string"))
    assert {r.word: r.n for r in p2.block_tokens(paged).collect()} == {"school": 1, "garden": 1}


def test_p2_halves_are_looked_up_among_all_words(spark):
    """The halves of a compound are too short for the sample or rare; misread forms reach three occurrences and are no examples."""
    total = 1_000_000
    rare = [("by", 400), ("gone", 4), ("by-gone", 300), ("self", 0), ("bccause", 3), ("schoo1", 5)]
    words = spark.createDataFrame([("school", total - 712), *rare], "word string, n long").where("n > 0")
    x, y = p2.broken_examples(words, total)
    f = lambda a, b, first, second: p2.pair_features(a, b, "-", 0.0, 300 / total, first / total, second / total, 0.0)
    assert f("by", "gone", 400, 4) in x and len(x) == 7 and sum(y) == 2
    alone = spark.createDataFrame([("school", total - 300), ("by-gone", 300)], "word string, n long")
    assert f("by", "gone", 0, 0) in p2.broken_examples(alone, total)[0]


def test_p2_furniture_inside_a_block_and_of_any_length(spark):
    header = "The running header of this collection of papers for the final term, " + "with a long subtitle " * 2
    line = " ".join(COMMONEST)
    rows, truth = [], set()
    for d in range(30):
        for page in range(5):
            b = (d * 5 + page) * 10
            inner = d % 6 == 0
            if not inner:
                rows.append((b, f"doc{d}", page, 0, "header" if (d + page) % 4 else "text", f"{header}{d}"))
            body = [f"{line} {d} {page} {k}." for k in range(3)]
            rows.append((b + 1, f"doc{d}", page, 1, "text", "\n".join([body[0], f"{header}{d}", *body[1:]] if inner else body)))
            rows.append((b + 2, f"doc{d}", page, 2, "text", f"{line} again {d} {page}."))
            truth.add(b + 1 if inner else b)
    df = spark.createDataFrame(rows, "block_id long, source_doc string, page int, block_order int, label string, text string")
    got = {(r.block_id, r.i) for r in p2.furniture(p2.written(p2.pages(df))).collect()}
    assert {b for b, _ in got} == truth and {i for b, i in got if b % 10 == 1} == {1}


def test_p2_long_words_are_corrected(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    words = spark.createDataFrame([(w, 48_000) for w in COMMONEST] + [(long, 30), (long.replace("silico", "si|ic0"), 1)], "word string, n long")
    assert [(r.word, r.meant) for r in p2.replacements(words).collect()] == [(long.replace("silico", "si|ic0"), long)]


def test_p2_candidates_by_prefix_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(8)
    true = {"".join(rng.choices("abcdeilmnorstu", k=rng.randint(2, 9))): rng.randint(6, 400) for _ in range(150)}
    words = dict(true)
    for w in list(true)[:80]:
        t, r = rng.choice(p2.MISREAD)
        words.setdefault(w.replace(t, r), 1)
        words.setdefault(w + rng.choice("aeiou"), 1)
    want = set()
    for w, n in words.items():
        for t, tn in words.items():
            a, b = set(p2.grams(w)), set(p2.grams(t))
            both = len(a & b)
            if w != t and t.isascii() and t.isalpha() and tn > 5 * n and (not w.isalpha() or not w.isascii() or n - 1.5 * n**0.5 <= tn / 25):
                if both and both >= max(len(a), len(b)) - p2.LOST:
                    want.add((w, t))
    got = {(r.word, r.meant) for r in p2.candidates(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == want and len(want) > 100
