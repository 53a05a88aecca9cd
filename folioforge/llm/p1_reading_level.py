"""Problem 1: reading level of each English item.

Method. A linear pairwise ranker (logistic loss on the difference of two graded texts) over syntax features - lengths of sentences and
clauses, subordination, inversion, passive and punctuation - and vocabulary features - word length, syllables,
derivational endings, variety, and hashed words, from which it learns which words are hard. Options, numbered lines and greetings are left out of
them - unless nothing else is there -, and their share is a feature. Isotonic regression turns scores into the
levels of the labels. The ranker is fitted on the driver on at most `most` labelled items, chosen by a hash of their id; every
item of the corpus is then scored on its whole text in one pass without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.p6_lookalike import SUSPECT, Rewriter, rewrites
from folioforge.llm.vocab import Memo
from folioforge.operators.skew import hash_sample

MOST_LABELLED = 8000
HASHED = 1024
DENSE = 27
_word = re.compile("[a-z]+(?:['’-][a-z]+)*").findall
_latin = re.compile("[A-Za-z]")
_cjk = re.compile("[一-鿿]")
_option = re.compile(r"(?m)^\s*(?:[A-G]\s*[.．].*|\d{1,3}\s*[.．].*|Dear [^\n]{1,30},|Yours[^\n]{0,12},[^\n]*|Best wishes,[^\n]*)$|_+\d*_+(?:\s*\([a-z]+\))?")
_end = re.compile(r"[.!?。！？]+[\"”']?(?:\s|$)|\n")
_vowels = re.compile("[aeiouy]+")
# English endings of derived words, and words that open or join clauses.
_ENDINGS = re.compile("(?:tion|sion|ity|ness|ment|ance|ence|ism|ology|ography|ous|ive|ical|ial|ised|ized|ated|ably|ally|ively|ously)s?$")
_JOINING = frozenset("although because while whereas if unless until when whenever wherever which whose whom that whoever whatever since though than rather had neither nor whether might would must".split())
_SIMPLE = frozenset("and but so then i my we our he she his her it they is was are were me you".split())


class Features:
    """Vectors of texts."""

    def __init__(self):
        self.words = Memo(self.of_word, 100_000, 64)
        self.rewriter = Rewriter(rewrites({chr(i): 1 for i in range(128)}))

    @staticmethod
    def of_word(w: str) -> np.ndarray:
        import xxhash

        n, syl = len(w), max(1, len(_vowels.findall(w)))
        return np.array([n, n * n, n >= 7, n >= 9, n >= 11, n >= 13, syl, syl >= 3, syl >= 4, syl >= 5, bool(_ENDINGS.search(w)), w in _JOINING, w in _SIMPLE, xxhash.xxh32_intdigest(w) % HASHED], np.float64)

    def plain(self, text: str) -> str:
        return self.rewriter.rewrite(text)[0] if not text.isascii() and SUSPECT.search(text) else text

    def english(self, text: str | None) -> np.ndarray | None:
        """The vector of a text in which Latin words outnumber Chinese characters, else None."""
        if not text:
            return None
        text = self.plain(text)
        if not text.isascii():
            chinese = len(_cjk.findall(text))
            if chinese and len(_word(text.lower())) <= chinese:
                return None
        return self.vector(text) if _latin.search(text) else None

    def vector(self, text: str) -> np.ndarray:
        body = _option.sub(" ", text)
        share = len(body) / len(text)
        words = _word(body.lower())
        if not words:  # nothing but options
            body, words = text, _word(text.lower())
        if not words:
            return np.zeros(DENSE + HASHED, np.float32)
        n = len(words)
        t = np.concatenate(list(map(self.words.__getitem__, words))).reshape(n, 14)
        m = t[:, :13].mean(0)
        ends = [m.start() for m in _end.finditer(body)]
        sizes = np.diff([0, *ends, len(body)])
        sizes = np.sort(sizes[sizes > 5]) if (sizes > 5).any() else np.array([len(body)])
        commas = body.count(",")
        dense = [
            share, m[0], np.sqrt(max(0.0, m[1] - m[0] ** 2)), *m[2:], len(set(words)) / n, np.log(sizes.mean()), np.log((sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2), np.log(sizes[-1]), np.log(sizes[len(sizes) // 4]), np.log(sizes[3 * len(sizes) // 4]),
            commas / n, body.count(";") / n, body.count('"') / n, body.count("?") / n, body.count("-") / n, commas / len(sizes), np.log(1 + n),
        ]
        return np.concatenate([dense, np.sqrt(np.bincount(t[:, 13].astype(np.int64), minlength=HASHED) / n)]).astype(np.float32)


def rank(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, rounds: int = 400, decay: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights w of the linear pairwise ranker: x @ w tends to be larger where y is. y may hold ties and halves; pairs of equal y don't count."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(y), (2, pairs))
    a, b = np.where(y[a] > y[b], a, b), np.where(y[a] > y[b], b, a)
    keep = y[a] > y[b]
    a, b = a[keep], b[keep]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    if not len(a):
        return w
    gap = y[a] - y[b]
    gap = gap / gap.mean()
    for step in range(1, rounds + 1):
        s = x @ w
        pull = gap / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        on = np.bincount(a, pull, len(y)) - np.bincount(b, pull, len(y))
        g = -(x.T @ on) / len(a) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, values), a rising step function to be interpolated."""
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(s[order], y[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, b2, n2 = blocks.pop()
            a1, b1, n1 = blocks[-1]
            blocks[-1] = [(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


class Model:
    """Scale, weights and calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.std
        z[:, DENSE:] *= 0.3
        self.w = rank(z, y)
        s = z @ self.w
        # for each step k, the chance that a text of score s is of level k or more
        self.scaled = self.w * np.where(np.arange(x.shape[1]) < DENSE, 1.0, 0.3) / self.std
        self.steps = [isotonic(s, np.clip(y - k + 1, 0, 1)) for k in range(2, 7)]

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Of each text, the calibrated chances of level 2, 3, ... 6 or more; falling in the level, rising in the score."""
        s = x @ self.scaled - self.mean @ self.scaled
        return np.minimum.accumulate(np.stack([np.interp(s, *f) for f in self.steps], 1), 1)


def graded(items: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and mean levels of about `most` labelled English items, chosen by a hash of item_id."""
    means = labels.where("read_level between 1 and 6 and item_id is not null").groupBy("item_id").agg(F.avg("read_level").alias("y"))
    some = hash_sample(means, ["item_id"], most)
    rows = items.select("item_id", "text").join(F.broadcast(some), "item_id").groupBy("item_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def run(batches):
        f = Features()
        for b in batches:
            out = [(y, v.tolist()) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (v := f.english(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.float64()), pa.array([v for _, v in out], pa.list_(pa.float32()))], names=["y", "v"])

    got = rows.select("text", "y").mapInArrow(run, "y double, v array<float>").toArrow()  # about `most` rows
    x = got["v"].combine_chunks().flatten().to_numpy().reshape(len(got), -1) if len(got) else np.zeros((0, DENSE + HASHED))
    return x.astype(np.float64), got["y"].to_numpy()


def levels(items: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(item_id, level, expected): level 1 to 6 of every English item - the highest that it reaches with a chance of a half - and its calibrated mean.

    Items without text, or with no more Latin words than Chinese characters, get null levels; so does every item if no two labels differ.
    Repeated rows, null ids and other columns are kept out of it: one row for each row of items in, ids as they are.
    """
    x, y = graded(items, labels, most)
    model = Model(x, y) if len(y) > 1 and len(set(y.tolist())) > 1 else None
    sent = items.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        f, model = Features(), sent.value
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                texts = part.column(1).to_pylist()
                vectors = {k: v for k, t in enumerate(texts) if model and (v := f.english(t)) is not None}
                out: list = [None] * len(texts)
                if vectors:
                    chances = model.chances(np.array(list(vectors.values()), np.float64))
                    for k, level, e in zip(vectors, (1 + (chances >= 0.5).sum(1)).tolist(), (1 + chances.sum(1)).tolist()):
                        out[k] = (level, e)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o and o[0] for o in out], pa.int32()), pa.array([o and o[1] for o in out], pa.float64())], names=["item_id", "level", "expected"])

    return items.select(items["item_id"].cast("string").alias("item_id"), items["text"].cast("string")).mapInArrow(run, "item_id string, level int, expected double")


def _levels(spark, sf_dir: str) -> DataFrame:
    return levels(spark.read.parquet(f"{sf_dir}/items.parquet"), spark.read.parquet(f"{sf_dir}/level_labels.parquet"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """English items of level 5 or 6."""
    return _levels(spark, sf_dir).where("level >= 5 and item_id is not null").select("item_id").distinct()


def p1_levels(spark, sf_dir: str) -> DataFrame:
    """Each item's level."""
    return _levels(spark, sf_dir).select("item_id", "level").distinct()
