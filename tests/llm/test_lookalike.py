"""Problem 6: kinds of case follow from what the automaton matched; accents of any number."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
import regex

from folioforge.llm import p6_lookalike as p6

CASES = {
    "wide": regex.compile(f"[{p6.WIDE}]"), "invisible": regex.compile(f"[{p6.INVISIBLE}]"), "space": regex.compile(f"[{p6.SPACES}]"),
    "accent": regex.compile(rf"\p{{L}}[{p6.INVISIBLE}]*[{p6.ACCENTS}]"), "mixed": regex.compile(rf"{p6.FOREIGN}{p6.BETWEEN}{p6.LATIN}|{p6.LATIN}{p6.BETWEEN}{p6.FOREIGN}"),
}


@pytest.fixture(scope="module")
def rewriter():
    return p6.Rewriter(p6.rewrites({chr(i): 5 for i in range(128)}))


def test_p6_kinds_are_those_of_the_definition(rewriter):
    rng = random.Random(11)
    signs = [*"abe  zAq", "\u0301", "\u0323", "\u0302", "\uff45", "\uff12", "\u200b", "\u00ad", "\u00a0", "\u3000", "\u0430", "\u043e", "\u03bf", "\u03bb", "\u4e2d", "\u00e9", "1", "."]
    for _ in range(4000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 9)))
        new, kinds = rewriter.rewrite(text)
        assert {k for k, p in CASES.items() if p.search(text)} <= set(kinds), ascii(text)
        assert not any(CASES[k].search(new) for k in ("wide", "invisible", "space", "accent")), ascii(text)
        if not any(p.search(text) for p in CASES.values()):
            assert kinds == [] and new == text, ascii(text)


@pytest.mark.parametrize(
    "text, to",
    [("a" + "\u0301" * 10, "\u00e1"), ("q\u0301", "q"), ("a\u0323\u0302", "\u1ead"), ("e\u200b\u0301", "\u00e9"), ("\u03bb\u03bf\u0301\u03b3", "\u03bb\u03cc\u03b3"), ("1\u0301", "1\u0301"), ("x" + "\u0301" * 50_000 + "y", "xy")],
)
def test_p6_accents(rewriter, text, to):
    assert rewriter.rewrite(text) == (to, [k for k in p6.KINDS if k in {"accent" if to != text else "", "invisible" if "\u200b" in text else ""}])
    assert re.sub("1\u0301", "", to) == unicodedata.normalize("NFC", re.sub("1\u0301", "", to))
