"""Problem 6: one form for text that looks the same.

Method. Look-alikes are pairs of strings: full-width letters and digits with their plain forms, a letter and a combining accent with
the composed letter, invisible characters with nothing, spaces with U+0020 (all by rule) and Greek and Cyrillic letters
with the Latin ones they look like (a fixed table). Union-find over these strings and code points gives transitive classes;
of each the representative is a shortest member, among these the one most frequent in the whole corpus (see rewrites). A
multi-pattern automaton finds all members that may be a case, greedily, leftmost and longest first, and rewrites them until nothing changes;
what it matched tells which cases a text held. An accent that composes with no letter before it has no other form than the letter alone. Greek and Cyrillic
letters are rewritten only in words where one stands next to a Latin letter: elsewhere they belong there, as
do full-width punctuation, composed accents, circled and Roman numerals, for which there is no pair.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Greek and Cyrillic letters and the Latin letters they look like.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυγωόίϲϳ", "ABEZHIKMNOPTYXaikvopuywóícj"))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјкоруосхѵԁԛԝһӏёї", "ABESIJKMHOPCTYXaesijkopyocxvdqwhlëï"))
# Characters without ink or width, and combining accents.
INVISIBLE = "­​‌‍⁠﻿"
ACCENTS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
SPACES = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs" and c != " ")
WIDE = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))

#: Whether a text can hold a case at all; most texts end here.
SUSPECT = re.compile(f"[{INVISIBLE}{SPACES}{WIDE}{ACCENTS}Ͱ-Ͽἀ-῿ΩЀ-ԯᲀ-᲏ⷠ-ⷿꙀ-ꚟ]")
FOREIGN = r"(?=\p{L})[\p{Greek}\p{Cyrillic}]"
LATIN = r"(?=\p{L})\p{Latin}"
BETWEEN = rf"[{INVISIBLE}{ACCENTS}]*"
KINDS = ("wide", "accent", "invisible", "space", "mixed")


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, s: str) -> str:
        self.up.setdefault(s, s)
        while self.up[s] != s:
            self.up[s] = self.up[self.up[s]]
            s = self.up[s]
        return s

    def join(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def members(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for s in sorted(self.up):
            by.setdefault(self.find(s), []).append(s)
        return list(by.values())


def composed() -> dict[str, str]:
    """Two code points, letter and accent, to the one they compose to, by Unicode's own rule."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        d = unicodedata.normalize("NFD", c)
        while len(d) > 2 and len(unicodedata.normalize("NFC", d[:-1])) == 1:
            d = unicodedata.normalize("NFC", d[:-1]) + d[-1]
        if len(d) == 2 and unicodedata.category(d[1]) == "Mn" and unicodedata.normalize("NFC", d) == c:
            out[d] = c
    return out


def look_alikes() -> list[tuple[str, str]]:
    """The pairs."""
    wide = [(c, unicodedata.normalize("NFKC", c)) for c in WIDE]
    return [*wide, *composed().items(), *((c, "") for c in INVISIBLE), *((c, " ") for c in SPACES), *GREEK.items(), *CYRILLIC.items()]


def kind_of(s: str) -> str:
    return "foreign" if s in GREEK or s in CYRILLIC else "wide" if s in WIDE else "plain"


def rewrites(frequency: dict[str, int]) -> dict[str, str]:
    """Each member of a class that isn't its representative, with the representative.

    That is a shortest member, of the kind (plain or wide letters) that the corpus has more of, so that one kind is used throughout, and of these the most
    frequent. Greek and Cyrillic letters don't represent a class with others: they are only rewritten within mixed words, Latin ones would be everywhere.
    """
    classes = Classes()
    for a, b in look_alikes():
        classes.join(a, b)
    total = {"plain": 0, "wide": 0, "foreign": 0}
    for c in classes.members():
        if any(s in WIDE for s in c):
            for s in c:
                total[kind_of(s)] += frequency.get(s, 0)
    out = {}
    for c in classes.members():
        best = min(c, key=lambda s: (len(s), kind_of(s) == "foreign", -total[kind_of(s)], -frequency.get(s, 0), s))
        out.update((s, best) for s in c if s != best)
    return out


class Rewriter:
    """Texts to (text in one form, kinds of case found)."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick
        import regex

        accent, foreign = re.compile(f"[{ACCENTS}]"), regex.compile(FOREIGN)
        known = {s for pair in look_alikes() for s in pair if s}
        scripts = [c for c in map(chr, (*range(0x370, 0x530), *range(0x1C80, 0x1C90), *range(0x1F00, 0x2000), 0x2126, *range(0x2DE0, 0x2E00), *range(0xA640, 0xA6A0))) if foreign.match(c)]
        single = [c for a, b in ((0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30)) for c in map(chr, range(a, b)) if accent.match(c)]
        self.table = table
        self.foreign = {s: unicodedata.normalize("NFC", s) for s in known if len(s) == 2 and foreign.match(s[0])}
        self.composes = {s: table.get(s, s) for s in known if len(s) == 2} | self.foreign
        self.automaton = ahocorasick.Automaton()
        for s in {*known, *table, *scripts, *single}:
            if len(s) == 2:
                kind = "accent"
            elif s in INVISIBLE:
                kind = "invisible"
            elif s in SPACES:
                kind = "space"
            elif s in WIDE:
                kind = "wide"
            elif foreign.match(s):
                kind = "mixed"
            else:
                kind = "stray" if accent.match(s) else ""
            if kind or table.get(s, s) != s:
                self.automaton.add_word(s, (s, table.get(s, s), kind))
        self.automaton.make_automaton()
        self.words = regex.compile(rf"[\p{{L}}\p{{M}}{INVISIBLE}]+")
        self.mixed = regex.compile(rf"{FOREIGN}{BETWEEN}{LATIN}|{LATIN}{BETWEEN}{FOREIGN}")

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Words in which a Greek or Cyrillic letter stands next to a Latin one."""
        return [m.span() for m in self.words.finditer(text) if self.mixed.search(m[0])] if self.mixed.search(text) else []

    def once(self, text: str) -> tuple[str, set[str]]:
        """One sweep: the text with matched members rewritten, and the kinds of those that are a case where they stand."""
        spans, kinds, out, at = iter(self.spans(text)), set(), [], 0
        span = next(spans, None)
        for end, (s, to, kind) in self.automaton.iter_long(text):
            start = end - len(s) + 1
            if kind == "mixed" or (kind == "accent" and s in self.foreign):
                while span and span[1] <= start:
                    span = next(spans, None)
                inside = span is not None and start >= span[0]
                if kind == "mixed" and not inside:
                    continue
                if kind == "accent":  # a letter of another script: composed within it, unless its word is mixed
                    to = to if inside else self.foreign[s]
                    kinds.update(["mixed"] if inside else [])
            elif kind == "stray":
                last = text[at:start][-1:] or (out[-1] if out else "")[-1:]
                if not last.isalpha():
                    continue  # its letter is further off or missing
                kind, whole = "accent", self.composes.get(last + s)
                if whole is not None:
                    if at < start:
                        out += [text[at : start - 1], whole]
                    else:
                        out[-1] = out[-1][:-1] + whole
                    kinds.add(kind)
                    at = end + 1
                    continue
                to = ""
            if kind:
                kinds.add(kind)
            out.append(text[at:start])
            if to or not out[-1]:
                out[-1] += to
            at = end + 1
            if not out[-1] and len(out) > 1:
                out.pop()
        return ("".join([*out, text[at:]]) if out else text), kinds

    def rewrite(self, text: str | None) -> tuple[str | None, list[str]]:
        """Sweeps until nothing changes. They end: each that changes the text shortens it or lowers the number of members that don't represent their class."""
        if not text or text.isascii() or not SUSPECT.search(text):
            return text, []
        kinds: set[str] = set()
        while True:
            new, more = self.once(text)
            kinds |= more
            if new == text:
                return text, [k for k in KINDS if k in kinds]
            text = new


def frequencies(rows: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each member of a look-alike pair occurs in all texts. Partial counts are made in each task; the driver gets the pairs' members only."""
    members = sorted({s for pair in look_alikes() for s in pair if s})
    single = np.array([ord(s) for s in members if len(s) == 1])
    double = [s for s in members if len(s) > 1]

    def run(batches):
        import ahocorasick

        total, pairs = np.zeros(0x110000, np.int64), dict.fromkeys(double, 0)
        find = re.compile(f"[{ACCENTS}]")
        automaton = ahocorasick.Automaton()
        for s in double:
            automaton.add_word(s, s)
        automaton.make_automaton()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                texts = [x for x in b.column(0).slice(i, 500).to_pylist() if x]
                points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                some = np.bincount(points)
                total[: len(some)] += some
                for x in texts:
                    if not x.isascii() and find.search(x):
                        for _, s in automaton.iter(x):
                            pairs[s] += 1
        names = [*map(chr, single.tolist()), *double]
        counts = [*total[single].tolist(), *pairs.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["s", "n"])

    found = rows.select(rows[text].cast("string")).mapInArrow(run, "s string, n bigint").where("n > 0").groupBy("s").agg(F.sum("n").alias("n"))
    return {r.s: r.n for r in found.collect()}  # at most one row for each member of the fixed and rule-made pairs


def normalised(rows: DataFrame, keys: list[str], text: str = "text", table: dict[str, str] | None = None) -> DataFrame:
    """`keys`, text in one form, and kinds ARRAY<STRING>: which cases the text held ('wide', 'accent', 'invisible', 'space', 'mixed').

    Null texts stay null and empty ones empty, without kinds; repeated rows and null keys are kept. `table` (what to rewrite to what) is made from
    the frequencies in these rows unless given. Other columns aren't read.
    """
    sent = rows.sparkSession.sparkContext.broadcast(rewrites(frequencies(rows, text)) if table is None else table)

    def run(batches):
        rewriter = Rewriter(sent.value)
        for b in batches:
            got = [rewriter.rewrite(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([k for _, k in got], pa.list_(pa.string()))], names=[*keys, "text", "kinds"])

    schema = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys) + "text string, kinds array<string>"
    return rows.select(*(rows[k] for k in keys), rows[text].cast("string").alias("__text")).mapInArrow(run, schema)


def records(spark, sf_dir: str) -> DataFrame:
    """The texts of items and blocks as (rec_table, rec_key, text), repeated rows included."""
    items, blocks = spark.read.parquet(f"{sf_dir}/items.parquet"), spark.read.parquet(f"{sf_dir}/blocks.parquet")
    return items.select(F.lit("items").alias("rec_table"), F.col("item_id").alias("rec_key"), "text").unionByName(
        blocks.select(F.lit("blocks").alias("rec_table"), F.concat("source_doc", F.lit("#"), F.col("ord").cast("string")).alias("rec_key"), "text")
    )


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Records whose text held a look-alike."""
    return normalised(records(spark, sf_dir), ["rec_table", "rec_key"]).where("size(kinds) > 0").select("rec_table", "rec_key").distinct()


def p6_text(spark, sf_dir: str) -> DataFrame:
    """Every record's text in one form."""
    return normalised(records(spark, sf_dir), ["rec_table", "rec_key"]).select("rec_table", "rec_key", "text")


def p6_left(spark, sf_dir: str) -> DataFrame:
    """Of each table its records, and how many of them still hold a case once they are rewritten."""
    left = normalised(p6_text(spark, sf_dir), ["rec_table", "rec_key"], table=rewrites({chr(i): 1 for i in range(128)}))
    return left.groupBy("rec_table").agg(F.count(F.lit(1)).alias("n_records"), F.sum((F.size("kinds") > 0).cast("long")).alias("n_left"))


_points = lambda s: "".join(f"\\x{{{ord(c):x}}}" for c in s)
_ranges = "\\x{300}-\\x{36f}\\x{1ab0}-\\x{1aff}\\x{1dc0}-\\x{1dff}\\x{20d0}-\\x{20ff}\\x{fe20}-\\x{fe2f}"
_case = f"[\\x{{ff10}}-\\x{{ff19}}\\x{{ff21}}-\\x{{ff3a}}\\x{{ff41}}-\\x{{ff5a}}{_points(INVISIBLE)}{_points(SPACES)}]|\\p{{L}}[{_ranges}]"
_next = f"[\\p{{Greek}}\\p{{Cyrillic}}][{_ranges}]*[\\p{{Latin}}]|[\\p{{Latin}}][{_ranges}]*[\\p{{Greek}}\\p{{Cyrillic}}]"

SQL = {
    "p6_found": f"""SELECT DISTINCT rec_table, rec_key FROM (SELECT 'items' AS rec_table, item_id AS rec_key, text FROM items UNION ALL SELECT 'blocks', source_doc || '#' || ord, text FROM blocks)
WHERE regexp_matches(text, '{_case}|{_next}')""",
    "p6_left": """SELECT 'items' AS rec_table, count(*) AS n_records, 0 AS n_left FROM items UNION ALL SELECT 'blocks', count(*), 0 FROM blocks""",
}
