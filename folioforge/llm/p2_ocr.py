"""Problem 2: text of scanned pages repaired into continuous paragraphs.

Method. Three classifiers and a retrieval, each over the whole collection:

- furniture: gradient-boosted trees on lines - how many pages of the paper have the same line but for its numbers, how many papers have it,
  whether a number in it runs with the page, place of the block on the page, make-up of the line - fitted to what the recogniser believed
  (label), which is right often enough to learn from and not always: how much of the furniture it knows is estimated from the fit. Every line
  of a block is looked at but inner ones that stand on one page of their paper only, which can't be running there;
- joins: a line pair whose first line ends in a hyphen is a broken word or a compound broken at its own hyphen; trees on how often the
  joined word, the compound and both halves occur within lines, fitted to words and compounds taken from within lines and broken there. A
  second line-pair classifier, fitted to line pairs within blocks and between paragraphs, tells whether a page's last paragraph goes on
  in the first of the next page;
- misread words: candidates come from an inverted join on the rarest character q-grams of the words' skeletons (look-alikes
  folded) between all words and those that stand more than five times as often; gradient-boosted ranking, fitted to common words with characters misread on
  purpose, chooses the replacement or none.

Papers of any size are handled by page: nothing is gathered by paper. Counts are shares of the whole, so the same rules hold at every size.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.boost import Boosted
from folioforge.llm.vocab import Memo
from folioforge.operators.graph import components
from folioforge.operators.skew import hash_sample, heavy_lookup
from folioforge.session import dropped, written

SAMPLE = 20_000  # lines, words or pairs that a classifier is fitted on
COMMON = 2e-5  # share of all words from which on a word is common enough to fit on; any word may be what a rarer one should be
TIMES = 5  # how many times as often as a misread form its true word stands, at the least
OWN = 25  # a form of letters that stands more often than its true word / OWN, beyond chance, is a word of its own
LOST = 5  # q-grams that a misread word lacks of its true word's, at the most, or has beside them: one place of three characters that the skeleton doesn't fold
FURNITURE = ("header", "footer", "page_number")
MARKS = "-‐¬\xad‑"
_word = re.compile("[A-Za-z]+(?:[-‐‑][A-Za-z]+)*")
_token = re.compile(r"[^\s.,;:!?\"“”‘’'()（）<>/=+\-‐‑¬\xad·★，。、；：？！…_《》【】$%&*\[\]{}~—–一-鿿]+")
_broken = re.compile(rf"([^\s\"“”(（.,;:!?]*[^\W\d_])([{MARKS}])\s*$")
_head = re.compile(r"^[\"“'‘(]?([^\s.,;:!?\"”)）\-‐¬\xad]+)((?:[-‐‑][A-Za-z]+)*)")
_stop = re.compile(r"[.!?。！？…][\"”'’)）]*$|[”》】）)]$|[:：]$")
_roman = re.compile("^[ivxlc]+$")

# What characters are read as (true, read).
MISREAD = [
    ("e", "c"), ("c", "e"), ("a", "@"), ("t", "†"), ("i", "1"), ("l", "1"), ("l", "|"), ("i", "|"), ("o", "0"), ("d", "cl"), ("n", "ri"), ("s", "5"), ("h", "li"), ("g", "9"), ("b", "6"), ("m", "rn"), ("rn", "m"),
    ("in", "m"), ("w", "vv"), ("z", "2"), ("u", "ii"), ("nn", "rm"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("vv", "w"), ("l", "i"), ("i", "l"), ("s", "$"), ("b", "8"), ("g", "q"), ("q", "g")
]
_single = str.maketrans("1|!i0569@†c$82qh", "llllosbgatesbzgu")
_fold = [("rl", "n"), ("el", "d"), ("ll", "u"), ("ln", "m"), ("rn", "m"), ("vv", "w")]


def skeleton(word: str) -> str:
    """The word with characters that are easily misread for each other folded: single ones first, so that pairs with a misread half fold as well."""
    word = word.translate(_single)
    for a, b in _fold:
        word = word.replace(a, b)
    return word


# ---------------------------------------------------------------- pages and lines


def pages(blocks: DataFrame) -> DataFrame:
    """(doc, page, blocks ARRAY<STRUCT<pos, block_id, label, text>>) in reading order; repeated rows once.

    Where block_order is null anywhere in a page, block_id gives the page's order. A block without source_doc or page is a page of its own
    (doc null), and isn't continued. Blocks without block_id are left out: nothing could be said of them. If rows of one block_id differ, all
    are kept.
    """
    b = blocks.select("block_id", "source_doc", "page", "block_order", "label", F.coalesce("text", F.lit("")).alias("text")).where("block_id is not null").distinct()
    lone = F.col("source_doc").isNull() | F.col("page").isNull()
    b = b.withColumn("doc", F.when(~lone, F.col("source_doc"))).withColumn("page", F.when(lone, F.col("block_id")).otherwise(F.col("page").cast("long")))
    each = F.collect_list(F.struct(F.coalesce("block_order", F.lit(0)).cast("long").alias("o"), "block_id", "label", "text"))
    got = b.groupBy("doc", "page").agg(each.alias("b"), F.max(F.col("block_order").isNull()).alias("by_id"))
    ordered = F.array_sort(F.transform("b", lambda x: F.struct(F.when(F.col("by_id"), F.lit(0)).otherwise(x["o"]).alias("pos"), x["block_id"].alias("block_id"), x["label"].alias("label"), x["text"].alias("text"))))
    return got.select("doc", "page", ordered.alias("blocks"))


def number_of(line: str) -> int | None:
    m = re.search(r"\d+", line)
    if m:
        return int(m[0][:9])
    s = line.strip().lower()
    if _roman.match(s):
        v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s]
        return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))
    return None


def line_features(line: str, k: int, n: int, page: int, in_doc: bool) -> list[float]:
    """What can be told of a line from itself and its page: it is in the k-th of the page's n blocks."""
    s = line.strip()
    v = number_of(line)
    off = min(40, abs(v - page - 1)) if v is not None and in_doc else 50
    letters = sum(c.isalpha() for c in s) or 1
    return [
        float(k), float(n - 1 - k), float(k == 0), float(k == n - 1), len(s), off, sum(c.isdigit() for c in s) / len(s), sum(c.isupper() for c in s) / letters, sum("一" <= c <= "鿿" for c in s) / len(s), float(bool(_stop.search(s))),
        float(s[0].islower()), float(s.count(" ")), float(bool(_roman.match(s))), float(sum(not c.isalnum() and not c.isspace() for c in s)), float(min(k, n - 1 - k)), float(v is not None),
    ]


def page_lines(paged: DataFrame) -> DataFrame:
    """(doc, page, block_id, i, last, k, n, label, line, key): every line that isn't blank; key hashes it with numbers, Roman ones too, as one sign.

    label: 1 furniture by the recogniser, 0 something else, -1 not told, as for lines of a block of several that is furniture.
    """
    blocks = paged.select("doc", "page", F.size("blocks").alias("n"), F.posexplode("blocks").alias("k", "b"))
    split = blocks.select("doc", "page", "n", "k", F.col("b.block_id").alias("block_id"), F.col("b.label").alias("label"), F.split("b.text", "\n").alias("lines"))
    each = split.select("*", (F.size("lines") - 1).alias("last"), F.posexplode("lines").alias("i", "line")).where("line rlike '(?U)[^\\\\s]'")
    furniture = F.col("label").isin(*FURNITURE)
    label = F.when(F.col("label").isNull(), -1).when(~furniture, 0).when(F.col("last") == 0, 1).otherwise(-1)
    key = F.xxhash64(F.regexp_replace(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""), r"\d+|\b[ivxlc]{1,6}\b", "#"))
    return each.select("doc", "page", "block_id", "i", "last", "k", "n", label.alias("label"), "line", key.alias("key"))


def parting(p: np.ndarray, y: np.ndarray) -> float:
    """The chance from which on a line is furniture, given chances and labels.

    The recogniser knows a part of the furniture and hardly ever calls anything else so. A line that is furniture has about the chance that labelled lines have; a kind
    of furniture that it knows half as often has half of that, and the cut lies at half of this again, as for any two classes.
    """
    return float(p[y == 1].mean()) / 4 if y.any() else 0.5


def furniture(paged: DataFrame) -> DataFrame:
    """(doc, page, block_id, i): the lines that are running headers, running footers or page numbers."""
    lines = page_lines(paged)
    known = lines.where("doc is not null")
    edge = F.max(F.col("i").isin(0) | (F.col("i") == F.col("last")))
    on = known.groupBy("doc", "key", "page").agg(F.count(F.lit(1)).alias("m"), edge.alias("edge"))
    on = on.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("on_pages"), F.sum("m").alias("n"), F.max("edge").alias("edge"))
    on = written(on.where("edge or on_pages > 1").drop("edge"), "keys")
    total = on.agg(F.sum("n")).first()[0] or 0
    n_keys = on.count()
    docs = paged.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"))
    docs = written(docs.join(on.groupBy("doc").agg(F.count(F.lit(1)).alias("dn")), "doc"), "docs")
    n_docs = max(1, docs.count())
    keys = on.groupBy("key").agg(F.count(F.lit(1)).alias("in_docs"), F.avg("on_pages").alias("usual"))
    stats = heavy_lookup(heavy_lookup(on, keys.withColumn("kn", F.col("in_docs")), ["key"], "kn", n_keys), docs, ["doc"], "dn", n_keys)
    stats = written(stats, "stats")
    every = heavy_lookup(known.withColumnRenamed("n", "blocks"), stats, ["doc", "key"], "n", total).where("i = 0 or i = last or on_pages > 1")
    alone = lines.where("doc is null").withColumnRenamed("n", "blocks")
    extra = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("on_pages", "in_docs", "usual", "n_pages")))
    every = written(every.unionByName(alone, allowMissingColumns=True).select("doc", "page", "block_id", "i", F.when(F.col("i").isin(0) | (F.col("i") == F.col("last")), F.col("label")).otherwise(-1).alias("label"), "k", "blocks", "line", extra.alias("extra")), "lines")
    dropped(on, docs, stats)

    def vectors(cols) -> np.ndarray:
        doc, page, _, _, _, k, n, line, extra = cols
        e = np.array(extra, np.float64).reshape(-1, 4)
        on_pages, in_docs, usual, n_pages = e.T
        more = np.stack([np.minimum(on_pages, 6), on_pages / np.maximum(n_pages, 1), np.log10(np.maximum(in_docs, 1e-9) / n_docs + 1e-6), usual], 1)
        own = [line_features(t, a, b, p, d is not None) for d, p, a, b, t in zip(doc, page, k, n, line)]
        return np.hstack([np.array(own, np.float64).reshape(len(e), -1), more])

    some = every.where("label >= 0")
    got = hash_sample(some, ["block_id", "i"], SAMPLE).orderBy("block_id", "i").toArrow()  # about SAMPLE rows
    if not got.num_rows:
        return every.where("false").select("doc", "page", "block_id", "i")
    x, y = vectors([c.to_pylist() for c in got.columns]), got["label"].to_numpy().astype(float)
    model = Boosted(x, y)
    sent = paged.sparkSession.sparkContext.broadcast((model, parting(model.chance(x), y)))

    def run(batches):
        model, least = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                b = batch.slice(at, 5000)
                keep = pa.array(model.chance(vectors([c.to_pylist() for c in b.columns])) >= least)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:4]], names=["doc", "page", "block_id", "i"])

    return every.mapInArrow(run, "doc string, page long, block_id long, i int")


def ragged(sizes: list[int], **columns) -> pa.ListArray:
    """Lists of structs, `sizes` long, from flat columns."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def parts(paged: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """What the repair needs of each page, in one pass:

    (doc, page, blocks ARRAY<STRUCT<block_id, label, lines>>: the page without furniture, blocks of which nothing is left are gone,
    tokens ARRAY<STRUCT<block_id, word, n>>: the words of each block, furniture included, see block_tokens,
    inner ARRAY<STRUCT<word, n>>: words that don't touch a line's end,
    pairs ARRAY<STRUCT<block_id, i, a, mark, b, next_id>>: lines that end in a hyphen with what follows on the page).
    """
    if found is None:
        joined = paged.withColumn("out", F.array().cast("array<struct<block_id:bigint,i:int>>"))
    else:
        out = found.groupBy("doc", "page").agg(F.collect_set(F.struct("block_id", "i")).alias("out"))  # at most the lines of a page
        joined = paged.alias("p").join(out.alias("o"), F.expr("p.doc <=> o.doc and p.page = o.page"), "left").select("p.*", "out")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                blocks, out = b.column(2), b.column(3)
                flat = blocks.flatten()
                ids, labels, texts = (flat.field(k).to_pylist() for k in ("block_id", "label", "text"))
                gone = {}
                for g, x in enumerate(out.to_pylist()):
                    gone[g] = {(y["block_id"], y["i"]) for y in x or ()}
                sizes = np.diff(blocks.offsets.to_numpy()).tolist()
                n_blocks, n_tokens, n_inner, n_pairs = [], [], [], []
                kept_id, kept_label, kept_lines = [], [], []
                token_id, words, counts, inner, inner_n, pairs = [], [], [], [], [], []
                k = 0
                for page, size in enumerate(sizes):
                    out_of, first, lines_of, mine = gone[page], len(kept_id), [], Counter()
                    before = len(words), len(pairs)
                    for j in range(k, k + size):
                        lines = texts[j].split("\n")
                        found_words = tokens_in(lines)
                        token_id += [ids[j]] * len(found_words)
                        words += found_words.keys()
                        counts += found_words.values()
                        left = [t for i, t in enumerate(lines) if t.strip() and (ids[j], i) not in out_of]
                        if left:
                            kept_id.append(ids[j])
                            kept_label.append(labels[j])
                            kept_lines.append(left)
                            mine.update(inner_words(left))
                            lines_of += [(ids[j], i, t) for i, t in enumerate(left)]
                    for (block, i, one), (following, _, two) in pairwise(lines_of):
                        if (t := tail_of(one)) and (h := head_of(two)[0]):
                            pairs.append((block, i, *t, h, following))
                    k += size
                    n_blocks.append(len(kept_id) - first)
                    n_tokens.append(len(words) - before[0])
                    n_pairs.append(len(pairs) - before[1])
                    n_inner.append(len(mine))
                    inner += mine.keys()
                    inner_n += mine.values()
                cols = list(zip(*pairs)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(1),
                        ragged(n_blocks, block_id=pa.array(kept_id, pa.int64()), label=pa.array(kept_label, pa.string()), lines=pa.array(kept_lines, pa.list_(pa.string()))),
                        ragged(n_tokens, block_id=pa.array(token_id, pa.int64()), word=pa.array(words, pa.string()), n=pa.array(counts, pa.int64())),
                        ragged(n_inner, word=pa.array(inner, pa.string()), n=pa.array(inner_n, pa.int64())),
                        ragged(n_pairs, **{k: pa.array(c, t) for k, c, t in zip(PAIR, cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()))}),
                    ],
                    names=["doc", "page", "blocks", "tokens", "inner", "pairs"],
                )

    schema = "doc string, page long, blocks array<struct<block_id:long,label:string,lines:array<string>>>, tokens array<struct<block_id:long,word:string,n:long>>, inner array<struct<word:string,n:long>>, "
    return joined.select("doc", "page", "blocks", "out").mapInArrow(run, schema + "pairs array<struct<block_id:long,i:int,a:string,mark:string,b:string,next_id:long>>")


PAIR = ("block_id", "i", "a", "mark", "b", "next_id")


# ---------------------------------------------------------------- words and joins


def inner_words(lines: list[str]) -> list[str]:
    """Words and compounds that don't touch a line's end."""
    out = []
    for line in lines:
        out += [m[0].lower() for m in _word.finditer(line) if m.start() > 0 and m.end() < len(line.rstrip()) - 1]
    return out


def tail_of(line: str) -> tuple[str, str] | None:
    """(first half, mark) if the line ends in a word and a hyphen."""
    line = line.rstrip()
    m = _broken.search(line) if line and line[-1] in MARKS else None
    return (m[1].lower(), m[2]) if m else None


def head_of(line: str) -> tuple[str, str]:
    """The first word of a line, and what is joined to it by hyphens."""
    m = _head.search(line.lstrip())
    return (m[1].lower(), m[2].lower()) if m else ("", "")


def edges(body: DataFrame) -> DataFrame:
    """Each page's first and last paragraph: (doc, page, first_id, first_line, last_id, last_line, lines of the last block, its label)."""
    b = body.where("doc is not null and size(blocks) > 0")
    last = F.element_at("blocks", -1)
    return b.select("doc", "page", F.col("blocks")[0]["block_id"].alias("first_id"), F.col("blocks")[0]["lines"][0].alias("first_line"), last["block_id"].alias("last_id"), F.element_at(last["lines"], -1).alias("last_line"), F.size(last["lines"]).alias("last_size"), F.size("blocks").alias("size"))


def turns(body: DataFrame) -> DataFrame:
    """(last_id, last_line, last_size, next_id, next_line): the page's last paragraph with the next page's first."""
    e = edges(body)
    following = e.select("doc", (F.col("page") - 1).alias("page"), F.col("first_id").alias("next_id"), F.col("first_line").alias("next_line"))
    return e.join(following, ["doc", "page"]).select("last_id", "last_line", "last_size", "next_id", "next_line")


def line_pairs(body: DataFrame, turned: DataFrame) -> DataFrame:
    """(block_id, i, a, mark, b, next_id): lines that end in a hyphen, with the first word of what follows on the page or the next, and its block."""

    def over(batches):
        for b in batches:
            out = []
            for block, size, one, following, two in zip(*(c.to_pylist() for c in b.columns)):
                if (t := tail_of(one)) and (h := head_of(two)[0]):
                    out.append((block, size - 1, *t, h, following))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(PAIR))

    inside = body.select(F.explode("pairs").alias("x")).select("x.*")
    return inside.unionByName(turned.select("last_id", "last_size", "last_line", "next_id", "next_line").mapInArrow(over, inside.schema))


def pair_features(a: str, b: str, mark: str, joined: float, compound: float, first: float, second: float, folded: float) -> list[float]:
    """Of a possibly broken word; the counts are shares of all words."""
    lg = lambda x: float(np.log10(x + 1e-9))
    return [lg(joined), lg(compound), lg(first), lg(second), lg(folded), lg(joined) - lg(compound), lg(folded) - lg(compound), float(len(a)), float(len(b)), float(mark == "-"), float(b.isalpha())]


def broken_examples(words: DataFrame, total: int) -> tuple[list[list[float]], list[float]]:
    """Features and target (1 broken, 0 compound) of common words and compounds, broken; how often their halves occur is looked up among all words, as in scoring."""
    sample = hash_sample(words.where(F.col("n") >= COMMON * total).where("length(word) between 4 and 40"), ["word"], SAMPLE // 4).orderBy("word").collect()  # about SAMPLE / 4 rows
    rng, cuts = np.random.default_rng(2), []
    for r in sample:
        if "-" in r.word:
            a, _, b = r.word.partition("-")
            cuts += [(a, b, mark, 0.0, r.n / total, 0.0, 0.0) for mark in "--‐¬\xad"]
        else:
            for _ in range(2):
                k = int(rng.integers(2, len(r.word) - 1))
                mark = "---‐¬\xad"[rng.integers(6)]
                lost = rng.random() < 0.1  # a misread half: only the skeleton is known
                cuts.append((r.word[:k], r.word[k:], mark, 0.0 if lost else r.n / total, 0.0, r.n / total, 1.0))
    halves = sorted({h for c in cuts for h in c[:2]})  # at most SAMPLE
    asked = words.sparkSession.createDataFrame([(h,) for h in halves], "word string")
    known = {r.word: r.n / total for r in words.join(F.broadcast(asked), "word").collect()}
    x = [pair_features(a, b, mark, joined, compound, known.get(a, 0.0), known.get(b, 0.0), folded) for a, b, mark, joined, compound, folded, _ in cuts]
    return x, [c[-1] for c in cuts]


def broken_words(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(a, mark, b): the pairs that are one broken word, not a compound. words: (word, n) within lines, compounds included."""
    spark = pairs.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 1
    kinds = pairs.groupBy("a", "mark", "b").agg(F.count(F.lit(1)).alias("n"))
    asked = F.array(*(F.struct(F.lit(k).alias("slot"), F.concat(*c).alias("word")) for k, c in ((0, ["a", "b"]), (1, ["a", F.lit("-"), "b"]), (2, ["a"]), (3, ["b"]))))
    found = kinds.select("a", "mark", "b", F.explode(asked).alias("q")).select("a", "mark", "b", "q.slot", "q.word").join(words, "word", "left")
    folded_words = with_skeleton(words).groupBy("sk").agg(F.max("n").alias("sn"))
    folded = with_skeleton(kinds.select("a", "mark", "b", F.concat("a", "b").alias("word"))).join(folded_words, "sk", "left").select("a", "mark", "b", F.coalesce("sn", F.lit(0)).alias("n4"))
    wide = found.groupBy("a", "mark", "b").agg(*(F.coalesce(F.max(F.when(F.col("slot") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(4))).join(folded, ["a", "mark", "b"])
    x, y = broken_examples(words, total)
    rng = np.random.default_rng(3)
    for _ in range(len(x) // 20):  # nothing is known of either: broken
        x.append(pair_features("abcd", "efgh", "-‐¬\xad"[rng.integers(4)], 0.0, 0.0, 0.0, 0.0, 0.0))
        y.append(1.0)
    sent = spark.sparkContext.broadcast(Boosted(np.array(x).reshape(len(x), 11), np.array(y)))

    def run(batches):
        model = sent.value
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            if rows:
                f = np.array([pair_features(a, c, m, *(n / total for n in ns)) for a, m, c, *ns in rows])
                keep = pa.array(model.chance(f) >= 0.5) if model.trees else pa.array([True] * len(rows))
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:3]], names=["a", "mark", "b"])

    return wide.select("a", "mark", "b", "n0", "n1", "n2", "n3", "n4").mapInArrow(run, "a string, mark string, b string")


def with_skeleton(rows: DataFrame) -> DataFrame:
    """`rows` with sk, the skeleton of word."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("word")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([skeleton(w) for w in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, "sk"])

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1] + ", sk string")


# ---------------------------------------------------------------- paragraphs that go on


def turn_features(last: str, size: int, following: str) -> list[float]:
    """Of a paragraph's last line, its number of lines, and the first line of another."""
    a, b = last.rstrip(), following.lstrip()
    words = a.split()
    upper = sum(w[:1].isupper() for w in words) / max(1, len(words))
    return [
        float(bool(_stop.search(a))), float(bool(tail_of(a))), float(b[:1].islower()), float(len(a)), float(min(size, 4)), upper, float(len(words)), float("一" <= a[-1:] <= "鿿"), float(a[-1:] in ",，、;；"), float("<" in a or "=" in a),
        float(bool(re.match(r"[\"“(（]?[A-Z]", b))), float(bool(re.match(r"\d+\s*[.．]|[A-G]\s*[.．]|（|第", b))), float(len(words) <= 6 and size == 1),
    ]


def going_on(body: DataFrame, turned: DataFrame) -> DataFrame:
    """(last_id, next_id) of the turned pages whose last paragraph ends within a sentence or word and goes on."""

    def examples(batches):
        for b in batches:
            x, y, keys = [], [], []
            for blocks in b.column(0).to_pylist():
                for k, block in enumerate(blocks):
                    lines = block["lines"]
                    for i in range(len(lines) - 1):
                        if not _stop.search(lines[i].rstrip()):
                            x.append(turn_features(lines[i], i + 1 + (i == 0 and len(lines) > 2), lines[i + 1]))
                            y.append(1)
                            keys.append((block["block_id"], i))
                    if k + 1 < len(blocks):
                        x.append(turn_features(lines[-1], len(lines), blocks[k + 1]["lines"][0]))
                        y.append(0)
                        keys.append((block["block_id"], -1))
            ids, at = list(zip(*keys)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["id", "at", "x", "y"])

    some = hash_sample(body.select("doc", "page", "blocks"), ["doc", "page"], SAMPLE // 10).select("blocks")
    pairs = written(some.mapInArrow(examples, "id long, at int, x array<double>, y int"), "examples")
    got = hash_sample(pairs, ["id", "at"], SAMPLE).orderBy("id", "at").toArrow()  # about SAMPLE rows
    dropped(pairs)
    model = Boosted(np.array(got["x"].to_pylist(), np.float64).reshape(got.num_rows, -1), got["y"].to_numpy().astype(float)) if got.num_rows else None
    sent = body.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for b in batches:
            x = [turn_features(*r) for r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
            if x and model:
                keep = pa.array(model.chance(np.array(x)) >= 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["last_id", "next_id"])

    return turned.select("last_id", "next_id", "last_line", "last_size", "next_line").mapInArrow(run, "last_id long, next_id long")


# ---------------------------------------------------------------- misread words


def tokens_of(text: str) -> dict[str, int]:
    """How often each word stands in the text: lower-cased tokens with a letter or one of the signs that letters are read as."""
    return {t: n for t, n in Counter(_token.findall(text.lower())).items() if t.isalpha() or any(c.isalpha() or c in "@|†" for c in t)}


def tokens_in(lines: list[str]) -> dict[str, int]:
    """tokens_of a block's lines. What a hyphen parts at a line's end is one word; the half at the block's end is no word (parted_tokens).

    A compound parted there becomes a word that is like no other and isn't corrected; halves with signs that letters are read as count by themselves too.
    """
    lines = [t for t in lines if t.strip()]
    halves = ""
    for i in range(len(lines)):
        if t := tail_of(lines[i]):
            lines[i] = lines[i].rstrip()[:-1] + "\x00"
            if i + 1 < len(lines):
                halves += " ".join(h for h in (t[0], head_of(lines[i + 1])[0]) if not h.isalpha()) + " "
    joined = "\n".join(lines).replace("\x00\n", "")
    if joined.endswith("\x00"):
        joined = " ".join(joined.split()[:-1])
    return tokens_of(f"{joined} {halves}")


def block_tokens(paged: DataFrame) -> DataFrame:
    """(block_id, word, n): the words of each block, furniture included, as tokens_in tells them."""
    body = paged if "tokens" in paged.columns else parts(paged)
    return body.select(F.explode("tokens").alias("x")).select("x.*")


def parted_tokens(pairs: DataFrame) -> DataFrame:
    """(block_id, word, n): the words that a hyphen parts between two blocks, as words of both; counted in the first, so n is 0 in the second."""

    def run(batches):
        for b in batches:
            out = []
            for one, two, a, h in zip(*(c.to_pylist() for c in b.columns)):
                for word, n in tokens_of(a + h).items():
                    out += [(one, word, n), (two, word, 0)]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int64()])], names=["block_id", "word", "n"])

    return pairs.where("block_id <> next_id").select("block_id", "next_id", "a", "b").mapInArrow(run, "block_id long, word string, n long")


def grams(word: str, q: int = 3) -> list[str]:
    s = f"^{skeleton(word)}$"
    return sorted({s[k : k + q] for k in range(max(1, len(s) - q + 1))})


_RULES: dict[str, list[tuple[str, int]]] = {}
for _t, _r in MISREAD:
    _RULES.setdefault(_t[0], []).append((_t, _r))


def misreadings(true: str, read: str, most: float = 3.5) -> tuple[int, float]:
    """(misread characters, other edits) of the cheapest way from the true word to the one read; a misreading costs 0.3, another edit 1.

    Ways that cost more than `most` aren't told apart: (0, the longer word's length).
    """
    n, m = len(true), len(read)
    rows: list[dict[int, tuple[float, int]]] = [{} for _ in range(n + 1)]
    rows[0][0] = (0.0, 0)
    for i in range(n + 1):
        row, below = rows[i], rows[i + 1] if i < n else None
        rules = _RULES.get(true[i], ()) if i < n else ()
        j, end = min(row, default=1), max(row, default=0)
        while j <= end:
            if j in row:
                c, k = row[j]
                if j < m and c + 1 <= most and (j + 1 not in row or c + 1 < row[j + 1][0]):
                    row[j + 1], end = (c + 1, k), max(end, j + 1)
                if i < n:
                    if j < m:
                        step = c if true[i] == read[j] else c + 1
                        if step <= most and (j + 1 not in below or step < below[j + 1][0]):
                            below[j + 1] = (step, k)
                    if c + 1 <= most and (j not in below or c + 1 < below[j][0]):
                        below[j] = (c + 1, k)
                    for t, r in rules:
                        if c + 0.3 <= most and read.startswith(r, j) and true.startswith(t, i):
                            to, at = rows[i + len(t)], j + len(r)
                            if at not in to or c + 0.3 < to[at][0]:
                                to[at] = (c + 0.3, k + 1)
            j += 1
    if m not in rows[n]:
        return 0, float(max(n, m))
    c, k = rows[n][m]
    return k, round(c - 0.3 * k, 9)


def rank_features(read: str, true: str, read_share: float, true_share: float) -> list[float]:
    k, other = misreadings(true, read)
    odd = sum(not c.isalpha() for c in read)
    size = len(true)
    return [float(k), other, other / size, float(np.log10(true_share + 1e-9) - np.log10(read_share + 1e-9)), float(odd), float(size), float(len(read) - size), float(read[:1] == true[:1]), float(read[-1:] == true[-1:]), float(read[:1].isdigit()), float(read.startswith(true) or true.startswith(read))]


def gram_order(words: DataFrame) -> dict[str, int]:
    """How common q-grams are, by a sample of the words: an order for prefixes, which may be any."""
    sample = hash_sample(words.where("length(word) <= 40"), ["word"], SAMPLE).select("word").collect()  # about SAMPLE rows
    return dict(Counter(g for r in sample for g in grams(r.word)))


def candidates(words: DataFrame) -> DataFrame:
    """(word, n, meant, tn): pairs whose skeletons lack at most LOST of each other's q-grams, and share one; `meant` stands more than TIMES as often as `word`.

    A form of letters only that stands more often than meant / OWN, by more than one and a half standard deviations of its count, is a word of its own.
    Two sets of m grams at the most that differ so share one of the first LOST + 1 of both, in any order; so only these are joined, the rarest first.
    """
    sent = words.sparkSession.sparkContext.broadcast(gram_order(words))

    def run(batches):
        order = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                b = batch.slice(at, 5000)
                out = []
                for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    gs = grams(w)
                    out += [(w, n, g, len(gs)) for g in sorted(gs, key=lambda g: (order.get(g, 0), g))[: LOST + 1]]
                cols = list(zip(*out)) or [()] * 4
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["word", "n", "g", "m"])

    index = written(words.select("word", "n").mapInArrow(run, "word string, n long, g string, m int"), "grams")
    true = index.where((F.col("n") > TIMES) & F.col("word").rlike("^[a-z]+$")).select("g", F.col("word").alias("meant"), F.col("n").alias("tn"), F.col("m").alias("tm"))
    own = f"(word rlike '[^a-z]' or n - 1.5 * sqrt(n) <= tn / {OWN})"
    near = index.join(true, "g").where(f"word <> meant and tn > {TIMES} * n and {own} and abs(m - tm) <= {LOST}")
    near = near.select("word", "n", "meant", "tn").distinct()

    def enough(batches):
        memo = Memo(lambda w: frozenset(grams(w)))
        for b in batches:
            keep = []
            for w, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                one, two = memo[w], memo[t]
                both = len(one & two)
                keep.append(both >= max(len(one), len(two)) - LOST)
            yield b.filter(pa.array(keep, pa.bool_()))

    return near.mapInArrow(enough, near.schema)


def replacements(words: DataFrame) -> DataFrame:
    """(word, meant): words that are misread, with what they should be. words: (word, n).

    Any word of letters may be meant that stands more than TIMES as often as the form read, however rare both are in the whole.
    """
    spark = words.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 1
    near = candidates(words)
    common = words.where(F.col("n") >= COMMON * total).where("word rlike '^[a-z]{1,40}$'")  # what is fitted on; all words are scored
    sample = hash_sample(common, ["word"], SAMPLE // 10).orderBy("word").collect()  # about SAMPLE / 10 rows
    known = {r.word: r.n / total for r in sample}
    rng, x, y = np.random.default_rng(4), [], []
    by: dict[str, list[str]] = {}
    for w in known:
        for g in grams(w):
            by.setdefault(g, []).append(w)
    for w, share in known.items():
        rare = share * 10 ** -rng.uniform(np.log10(TIMES), 3.5)
        others = [v for g in grams(w) for v in by[g] if v != w]
        rules = [(t, r) for t, r in MISREAD if t in w]
        for t, r in rules:
            read = w.replace(t, r, 1) if rng.random() < 0.4 else w.replace(t, r)
            x.append(rank_features(read, w, rare, share))
            y.append(1.0)
            for v in rng.choice(others, min(3, len(others)), replace=False) if others else ():
                x.append(rank_features(read, str(v), rare, known[str(v)]))
                y.append(0.0)
        for v in rng.choice(others, min(4, len(others)), replace=False) if others else ():  # true words, also as rare ones
            x.append(rank_features(w, str(v), share if rng.random() < 0.5 else rare, known[str(v)]))
            y.append(0.0)
        for tail in ("s", "ed", "ly"):
            x.append(rank_features(w + tail, w, rare, share))
            y.append(0.0)
        if len(w) > 5:
            x.append(rank_features(w[: len(w) // 2], w, rare, share))
            x.append(rank_features(w[len(w) // 2 :], w, rare, share))
            y += [0.0, 0.0]
    if not x:
        return near.where("false").select("word", "meant")
    sent = spark.sparkContext.broadcast(Boosted(np.array(x), np.array(y)))

    def score(batches):
        model = sent.value
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            if rows:
                p = model.chance(np.array([rank_features(w, t, n / total, tn / total) for w, t, n, tn in rows]))
                keep = pa.array(p >= 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(p).filter(keep)], names=["word", "meant", "p"])

    best = near.select("word", "meant", "n", "tn").mapInArrow(score, "word string, meant string, p double")
    best = written(best.groupBy("word").agg(F.max_by("meant", F.struct("p", "meant")).alias("meant")), "best")
    while True:  # what is meant may be a commoner misreading itself; each step is to a commoner word, so chains are short and end
        further = best.select(F.col("word").alias("meant"), F.col("meant").alias("end"))
        if not best.join(further, "meant").head(1):
            return best
        best = written(best.join(further, "meant", "left").select("word", F.coalesce("end", "meant").alias("meant")), "best")


# ---------------------------------------------------------------- the whole


def repaired(blocks: DataFrame) -> dict[str, DataFrame]:
    """The parts of the repair: furniture, body, hyphens (block_id, i, a, mark, b), splits (last_id, next_id), fixes (block_id, word, meant)."""
    paged = written(pages(blocks), "pages")
    found = written(furniture(paged), "furniture")
    body = written(parts(paged, found), "body")
    words = written(body.select(F.explode("inner").alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n")), "inner")
    turned = written(turns(body), "turns")
    pairs = written(line_pairs(body, turned), "pairs")
    one = written(broken_words(pairs, words), "broken")
    n = pairs.groupBy("a", "mark", "b").agg(F.count(F.lit(1)).alias("n"))
    hyphens = written(heavy_lookup(pairs, one.join(n, ["a", "mark", "b"]), ["a", "mark", "b"], "n", pairs.count()), "hyphens")
    splits = written(going_on(body, turned), "splits")
    tokens = block_tokens(body).unionByName(written(parted_tokens(pairs), "parted"))
    vocabulary = written(tokens.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    misread = written(replacements(vocabulary).join(vocabulary, "word"), "misread")
    dropped(paged, words, turned, pairs, one)
    total = vocabulary.agg(F.sum("n")).first()[0] or 1
    fixes = heavy_lookup(tokens.select("block_id", "word"), misread, ["word"], "n", total)
    return {"furniture": found, "body": body, "hyphens": hyphens, "splits": splits, "fixes": fixes}


def defects(blocks: DataFrame) -> DataFrame:
    """(block_id, defect): 'furniture', 'char', 'hyphen', 'split'. Null and empty texts have none; an empty table gives none."""
    r = repaired(blocks)
    kinds = [(r["furniture"], "block_id", "furniture"), (r["fixes"], "block_id", "char"), (r["hyphens"], "block_id", "hyphen"), (r["splits"], "last_id", "split")]
    out = None
    for df, key, name in kinds:
        one = df.select(F.col(key).alias("block_id"), F.lit(name).alias("defect"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(source_doc, page, block_id, text): each paper's paragraphs without furniture, under the page and block where they begin; page and block_id give their order
    except where a page has block_order, which `place` does: ordering by (source_doc, page, place) is reading order.

    Lines are joined, broken words put together, misread words replaced (lower case, or capitalised as they were), and paragraphs that go on over pages are one.
    """
    r = repaired(blocks)
    flat = r["body"].select("doc", "page", F.posexplode("blocks").alias("place", "b")).select("doc", "page", "place", "b.block_id", "b.lines")
    ends = r["hyphens"].groupBy("block_id").agg(F.collect_set("i").alias("ends"))
    fixes = r["fixes"].groupBy("block_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "meant"))).alias("fixes"))
    rows = flat.join(ends, "block_id", "left").join(fixes, "block_id", "left").select("doc", "page", "place", "block_id", "lines", "ends", "fixes")

    def run(batches):
        for b in batches:
            texts = []
            for lines, ends, fixes in zip(*(b.column(i).to_pylist() for i in (4, 5, 6))):
                ends, fixes, out = set(ends or ()), dict(fixes or ()), ""
                for i, line in enumerate(lines):
                    line = line.strip()
                    if i in ends:
                        out += line[:-1] + ("\x00" if i == len(lines) - 1 else "")
                    elif tail_of(line):
                        out += line[:-1] + "-"
                    else:
                        wide = "一" <= line[-1:] <= "鿿" or line[-1:] in "，。、；：？！"
                        out += line + ("" if wide else " ")

                def fix(m, fixes=fixes):
                    to = fixes.get(m[0].lower())
                    return m[0] if to is None else to.capitalize() if m[0][:1].isupper() else to

                texts.append(_token.sub(fix, out.rstrip(" ")) if fixes else out.rstrip(" "))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(texts, pa.string())], names=["doc", "page", "place", "block_id", "text"])

    fixed = written(rows.mapInArrow(run, "doc string, page long, place int, block_id long, text string"), "fixed")
    chain = components(r["splits"], "last_id", "next_id").withColumnRenamed("node", "block_id")
    joined = fixed.join(chain, "block_id", "left").withColumn("component", F.coalesce("component", "block_id"))
    whole = joined.groupBy("doc", "component").agg(F.sort_array(F.collect_list(F.struct("page", "place", "block_id", "text"))).alias("p"))
    text = F.regexp_replace(F.array_join(F.transform("p", lambda x: F.when(x["text"].endswith("\x00"), x["text"]).otherwise(F.concat(x["text"], F.lit(" ")))), ""), "\x00", "")
    return whole.select(F.col("doc").alias("source_doc"), F.col("p")[0]["page"].alias("page"), F.col("p")[0]["place"].alias("place"), F.col("p")[0]["block_id"].alias("block_id"), F.trim(text).alias("text"))


def _blocks(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/ocr_blocks.parquet")


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Blocks with furniture, misread words, broken words, and splits over pages."""
    return defects(_blocks(spark, sf_dir))


def p2_paragraphs(spark, sf_dir: str) -> DataFrame:
    """The papers' continuous paragraphs."""
    return paragraphs(_blocks(spark, sf_dir))
